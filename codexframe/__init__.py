"""codexframe: a Spark-native engine for searchable document collections."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
