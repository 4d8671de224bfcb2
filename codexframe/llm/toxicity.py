"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from its words, and the document's is
their noisy-or: one minus the product of the sentences' complements. Only documents carry labels; the
gradient runs through the noisy-or, so the sentences that explain a label take its weight, and the same
weights locate the offending sentences of any document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import slices

#: Labelled documents, about, that the model is fitted on.
SAMPLE = 8000
#: Characters of them in all, about, and of the longest of them.
SAMPLE_CHARS, LONGEST_TEXT = 1 << 26, 1 << 20
#: A feature weighs only if it is commoner in documents of label 1 with this likelihood-ratio statistic.
EVIDENCE = 15.0
#: Lengths of the word beginnings that are features, besides the whole word.
PREFIXES = (4, 5, 6, 7, 8)
#: Most words whose summed weight a task remembers.
REMEMBERED = 200_000
#: A sentence ends at one of these, and after so many words at the latest.
ENDS, LONGEST = ".!?\n", 64

_PATTERN = rf"[^\W\d_]+|[{ENDS}]"


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words of each sentence that has any."""
    import re

    out: list[list[str]] = [[]]
    for token in re.findall(_PATTERN, (text or "").lower()):
        if token in ENDS or len(out[-1]) >= LONGEST:
            if out[-1]:
                out.append([])
            if token in ENDS:
                continue
        out[-1].append(token)
    return out if out[-1] else out[:-1]


def features(word: str) -> list[str]:
    """The word itself and its proper beginnings."""
    return [f"{word}$", *(word[:k] for k in PREFIXES if len(word) > k)]


def evidence(in_toxic, in_clean, n_toxic: int, n_clean: int):
    """Likelihood-ratio statistic (G squared) of presence against label; 0 where label 1 has less of it."""
    import numpy as np

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    with_it, n = in_toxic + in_clean, n_toxic + n_clean
    g = part(in_toxic, with_it * n_toxic / n) + part(in_clean, with_it * n_clean / n)
    g += part(n_toxic - in_toxic, (n - with_it) * n_toxic / n) + part(n_clean - in_clean, (n - with_it) * n_clean / n)
    return np.where(in_toxic * n_clean > in_clean * n_toxic, 2 * g, 0.0)


def fit(
    df: DataFrame,
    text_col: str = "text",
    label_col: str = "toxic",
    key_col: str = "doc_id",
    sample: int = SAMPLE,
    least: float = EVIDENCE,
    steps: int = 150,
    chars_col: str | None = None,
) -> tuple[float, dict[str, float]]:
    """``(bias, feature weights)`` learned from rows labelled 0 or 1; other labels teach nothing.

    The driver gets about ``sample`` labelled rows, those whose key hashes lowest (all, if fewer), of about
    ``SAMPLE_CHARS`` characters in all, whatever the size of the input; texts above ``LONGEST_TEXT`` teach
    nothing. ``chars_col`` holds the texts' lengths, if they are known: where ``df`` is a join, the labelled rows are
    then counted without any text, and only those of the sample go through its shuffle. Without a labelled row, or with label 0 only, the bias is -20 (any score is about 0); with label
    1 only it is 0 (any sentence scores 0.5). No feature weighs then.
    """
    import numpy as np

    chars = F.length(F.col(text_col).cast("string")) if chars_col is None else F.col(chars_col)
    rows = df.where(F.col(label_col).isin(0, 1)).select(
        F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("y"), F.col(key_col).alias("key"), F.coalesce(chars, F.lit(0)).alias("chars")
    )
    rows = rows.where(F.col("chars") <= LONGEST_TEXT)
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    dice = F.pmod(F.xxhash64(F.lit("toxicity"), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = rows.where(dice < F.lit(min(sample / max(n, 1), SAMPLE_CHARS / max(chars, 1)))).orderBy(F.xxhash64("key"), "key")
    got = part.select("text", "y").toPandas()
    y = got["y"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return (-20.0 if not len(y) or y.max() == 0 else 0.0), {}
    pool: dict[str, str] = {}  # one object for each distinct word
    bags = [[sorted({pool.setdefault(w, w) for w in s}) for s in sentences(t)] for t in got["text"]]
    seen: dict[str, list[int]] = {}
    for bag, label in zip(bags, y):
        for f in {f for s in bag for w in s for f in features(w)}:
            seen.setdefault(f, [0, 0])[int(label)] += 1
    names = sorted(seen)
    clean_docs, toxic_docs = np.array([seen[f] for f in names], np.float64).reshape(-1, 2).T
    strong = evidence(toxic_docs, clean_docs, int(y.sum()), int(len(y) - y.sum())) >= least
    vocabulary = {names[i]: at for at, i in enumerate(np.flatnonzero(strong))}
    doc_of, word_of, sentence_of = [], [], []
    for doc, bag in enumerate(bags):
        for s in bag:
            known = [vocabulary[f] for w in s for f in features(w) if f in vocabulary]
            word_of += known
            sentence_of += [len(doc_of)] * len(known)
            doc_of.append(doc)
    doc_of, word_of, sentence_of = (np.array(x, np.int64) for x in (doc_of, word_of, sentence_of))
    n_docs, n_sent, n_words = len(y), len(doc_of), len(vocabulary)
    w, b = np.zeros(n_words), -4.0
    m, v, mb, vb = np.zeros(n_words), np.zeros(n_words), 0.0, 0.0
    for step in range(1, steps + 1):
        z = b + np.bincount(sentence_of, w[word_of], n_sent)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs)
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        pull = np.where(y == 1, -np.exp(clean) / toxic, 1.0)  # of the loss by -log(1 - p)
        g = pull[doc_of] * p
        gw = np.bincount(word_of, g[sentence_of], n_words) / n_docs + 1e-4 * w
        gb = g.sum() / n_docs
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.1 * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= 0.1 * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return float(b), {word: float(w[i]) for word, i in vocabulary.items() if abs(w[i]) > 1e-3}


def score(df: DataFrame, model: tuple[float, dict[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, n_sentences, offending`` of every row; ``offending`` has the numbers and words of
    sentences whose own probability is 0.5 or more.

    Whole texts are scored. A text without words, null too, has no sentence and scores 0. Repeated rows
    are scored each; other columns are ignored. Map only; the weights go with the tasks, those of the
    bounded sample's telling features.
    """
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

    bias, weights = model
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sentence = StructType([StructField("sentence", LongType()), StructField("words", StringType()), StructField("score", DoubleType())])
    fields = [StructField("id", rows.schema["id"].dataType), StructField("score", DoubleType()), StructField("n_sentences", LongType())]
    schema = StructType([*fields, StructField("offending", ArrayType(sentence))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        kind = pa.list_(pa.struct([("sentence", pa.int64()), ("words", pa.string()), ("score", pa.float64())]))
        known: dict[str, float] = {}

        def weight(word: str) -> float:
            if word not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = sum(weights.get(f, 0.0) for f in features(word))
            return known[word]

        log_rest = lambda z: -math.log1p(math.exp(min(z, 30.0)))  # noqa: E731  log(1 - p)
        for batch in slices(batches):
            scores, counts, found = [], [], []
            for text in batch.column(1).to_pylist():
                bag, clean, bad = sentences(text), 0.0, []
                for at, words in enumerate(bag):
                    z = bias + sum(map(weight, set(words)))
                    clean += log_rest(z)
                    if z >= 0:
                        bad.append({"sentence": at, "words": " ".join(words), "score": 1 / (1 + math.exp(-min(z, 30.0)))})
                scores.append(-math.expm1(clean))
                counts.append(len(bag))
                found.append(bad)
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "score", "n_sentences", "offending"])

    return rows.mapInArrow(run, schema)
