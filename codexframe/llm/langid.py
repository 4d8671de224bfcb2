"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams in order. A document's own most frequent
n-grams are compared with each profile by out-of-place distance: the sum, over the document's n-grams,
of how far their rank lies from their rank in the profile, and a fixed penalty for one that the profile
lacks. The nearest profile is the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexframe.llm.common import materialize, slices

#: Length of profiles and of documents' n-gram lists, and the longest n-gram.
PROFILE, LONGEST = 400, 3
#: Documents of each language, about, that profiles are learned from.
SAMPLE = 4000
#: Up to so many languages their shares are broadcast, one row each.
FEW_LANGUAGES = 10_000


def _letter_table():
    """For each code point its lower-case letter, or a space for what is no letter."""
    import sys

    import numpy as np

    table = np.full(sys.maxunicode + 1, 32, np.int64)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def gram_counts(text: str, table):
    """The n-grams of up to three letters of a text's words, each word between spaces, and their counts.

    An n-gram is one integer of 21 bits per character. Both arrays are empty if the text has no letter.
    """
    import numpy as np

    codes = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    codes = np.concatenate(([32], codes, [32]))
    blank = codes == 32
    codes = codes[~(blank & np.concatenate(([False], blank[:-1])))]  # one space between words
    if len(codes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = codes == 32
    two = codes[:-1] << 21 | codes[1:]
    three = two[:-1] << 21 | codes[2:]
    grams = np.concatenate((codes[~blank], two, three[~blank[1:-1]]))
    grams.sort()
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.diff(np.concatenate((first, [len(grams)])))


def _top(grams, counts, n: int):
    """The ``n`` most frequent, ties to the smaller n-gram."""
    import numpy as np

    return grams[np.lexsort((grams, -counts))[:n]]


def learn(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample: int = SAMPLE, profile: int = PROFILE
) -> DataFrame:
    """Profiles from labelled rows: ``lang, gram, rank`` (from 0).

    Of each language about ``sample`` rows are used, those whose key hashes lowest in proportion to the
    language's number of rows; all rows if it has fewer. Rows with a null text or language teach
    nothing. Counts are summed within a task, then over tasks.
    """
    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(key_col).alias("key"))
    rows = rows.where("lang is not null and text is not null")
    share = materialize(rows.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("share")), "shares")
    share = F.broadcast(share) if share.count() <= FEW_LANGUAGES else share
    dice = F.pmod(F.xxhash64(F.lit("langid"), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(share, "lang").where(dice < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = _letter_table()
        for batch in slices(batches, 512):
            by_lang: dict[str, list] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                by_lang.setdefault(lang, []).append(gram_counts(text, table))
            for lang, found in by_lang.items():
                grams, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([c for _, c in found]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts)], names=["lang", "gram", "n"]
                )

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranks = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return counts.withColumn("rank", ranks - 1).where(F.col("rank") < profile).select("lang", "gram", "rank")


def identify(df: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", profile: int = PROFILE) -> DataFrame:
    """Language of every row: ``id, lang_pred, score``.

    ``lang_pred`` is ``und``, with score 0, for a null text and one without a letter, and where nothing
    was learned. Ties go to the first language by name. The score is the nearest profile's weight, each
    weighing ``exp(-distance / 0.05)`` with distances as shares of the largest possible one. Whole texts
    are counted; repeated rows are judged each; other columns are ignored. Map only: the profiles, a few
    hundred n-grams per language, go with the tasks.
    """
    ranked: dict[str, dict[int, int]] = {}
    for r in profiles.collect():  # languages * profile rows
        ranked.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    langs = sorted(ranked)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = _letter_table()
        vocabulary = np.array(sorted({g for p in ranked.values() for g in p}), np.int64)
        places = np.full((len(vocabulary) + 1, len(langs)), -1, np.int64)  # the last row: an n-gram of no profile
        for at, lang in enumerate(langs):
            for gram, rank in ranked[lang].items():
                places[np.searchsorted(vocabulary, gram), at] = rank
        for batch in slices(batches):
            names, scores = [], []
            for text in batch.column(1).to_pylist():
                top = _top(*gram_counts(text, table), profile) if text and langs else ()
                if not len(top):
                    names.append("und")
                    scores.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(vocabulary, top), len(vocabulary) - 1)
                mine = places[np.where(vocabulary[at] == top, at, len(vocabulary))]
                off = np.where(mine < 0, profile, np.abs(mine - np.arange(len(top))[:, None]))
                distance = off.sum(0) / (profile * len(top))
                best = int(distance.argmin())
                names.append(langs[best])
                scores.append(float(1 / np.exp((distance[best] - distance) / 0.05).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
