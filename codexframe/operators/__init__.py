"""DataFrame operators: relational reads and writes, search, recommendation, tag resolution."""
