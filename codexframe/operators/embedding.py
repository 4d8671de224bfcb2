"""Vectors of texts from an injected model, for the rows that lack one."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexframe.sources.scratch import key_join, written

Embedder = Callable[[list[str]], np.ndarray]

# fixed values: texts in a request, and characters in a text
MOST_TEXTS, MOST_CHARS = 32, 20_000
#: Most words whose hash the built-in model remembers.
REMEMBERED = 100_000


class BadInput(ValueError):
    """A text the model must not get."""


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic model for tests and offline runs: signed word hashes, unit length."""
    known: dict[str, int] = {}

    def place(word: str) -> int:
        """Twice the component, and 1 more for a positive sign; hashed once while it is remembered."""
        if len(known) >= REMEMBERED:
            known.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        known[word] = found = h % dim * 2 + (h >> 63)
        return found

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in enumerate(texts):
            times = np.bincount([known[w] if w in known else place(w) for w in text.lower().split()], minlength=2 * dim)
            out[row] = times[1::2] - times[::2]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    return embed


def checked(embedder: Embedder, dim: int) -> Embedder:
    """The same model behind its contract: texts neither empty nor too long, one finite unit vector each."""

    def embed(texts: list[str]) -> np.ndarray:
        if any(not t.strip() for t in texts):
            raise BadInput("a text is empty")
        if any(len(t) > MOST_CHARS for t in texts):
            raise BadInput(f"a text has more than {MOST_CHARS} characters")
        got = np.asarray(embedder(texts), np.float32)
        if got.shape != (len(texts), dim):
            raise ValueError(f"the model gave {got.shape}, not {(len(texts), dim)}")
        if not np.isfinite(got).all():
            raise ValueError("the model gave a component that is not finite")
        return got

    return embed


def embed_column(embedder: Embedder, dim: int, batch: int = MOST_TEXTS) -> Callable[[Column], Column]:
    """An Arrow function from text to vector; null text gives null. The model is made once per task."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = checked(embedder, dim)
        for texts in series:
            at = [i for i, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for first in range(0, len(at), batch):
                part = at[first : first + batch]
                for i, v in zip(part, model([texts.iloc[i] for i in part])):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return run


def embed_missing(rows: DataFrame, embedder: Embedder, dim: int, text: Column, vec_col: str = "embedding") -> DataFrame:
    """``rows`` with a vector where there was none; others keep theirs and never reach the model."""
    fresh = embed_column(embedder, dim)(F.when(F.col(vec_col).isNull(), text))
    return rows.withColumn(vec_col, F.coalesce(F.col(vec_col), fresh))


#: Characters that a request holds at most, whatever its number of texts; a single text may hold more.
BUDGET = 200_000
#: Calls that a failing request gets before it is halved, and the seconds that one may take.
ATTEMPTS, TIMEOUT = 3, 60.0


def _within(seconds: float, model: Embedder, texts: list[str]) -> np.ndarray:
    """The model's answer, or ``TimeoutError``; a call that hangs is left behind in a thread of its own."""
    answer: list = []

    def call() -> None:
        try:
            answer.append((model(texts), None))
        except Exception as problem:  # handed to the caller's thread
            answer.append((None, problem))

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(seconds)
    if not answer:
        raise TimeoutError(f"no answer within {seconds:g} s")
    found, problem = answer[0]
    if problem is not None:
        raise problem
    return found


def requests(texts: list[str], most_texts: int = MOST_TEXTS, budget: int = BUDGET) -> Iterator[list[int]]:
    """Places of ``texts`` cut into requests: of similar lengths together, each within the number of texts and characters."""
    held: list[int] = []
    size = 0
    for at in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if held and (len(held) >= most_texts or size + len(texts[at]) > budget):
            yield held
            held, size = [], 0
        held.append(at)
        size += len(texts[at])
    if held:
        yield held


def answer(model: Embedder, texts: list[str], attempts: int = ATTEMPTS, timeout: float = TIMEOUT, pause: float = 0.5) -> list[tuple[np.ndarray | None, str | None, int]]:
    """Vector, error and number of calls for each text of a request.

    A request that fails is repeated, each time after twice the pause; one that fails to the end is halved, so that a
    text the model can't take fails alone. Bad input isn't repeated, as it would fail again.
    """
    problem: Exception | None = None
    for attempt in range(attempts):
        try:
            return [(v, None, attempt + 1) for v in _within(timeout, model, texts)]
        except BadInput as bad:
            problem, attempt = bad, 0
            break
        except Exception as failed:  # whatever the model raises is the text's error
            problem = failed
            if attempt + 1 < attempts:
                time.sleep(pause * 2**attempt)
    if len(texts) == 1:
        return [(None, f"{type(problem).__name__}: {problem}"[:500], attempt + 1)]
    half = len(texts) // 2
    return [(v, e, n + attempt + 1) for part in (texts[:half], texts[half:]) for v, e, n in answer(model, part, attempts, timeout, pause)]


def dispatch(
    texts: DataFrame,
    text_col: str,
    embedder: Embedder,
    dim: int,
    most_texts: int = MOST_TEXTS,
    budget: int = BUDGET,
    attempts: int = ATTEMPTS,
    timeout: float = TIMEOUT,
    pause: float = 0.5,
    window: int = 2048,
) -> DataFrame:
    """A vector or an error for each distinct text: ``text_col, vector, error, calls``.

    Null texts have no row. Equal texts are sent once. A task takes ``window`` texts at a time, sorts them by length
    and sends them in requests of at most ``most_texts`` texts and ``budget`` characters. Empty texts and those above
    ``MOST_CHARS`` characters never reach the model; they, and texts the model fails on after retries and halving, are rows
    with their error. Spark may run a task twice, so the model should answer alike.
    """
    asked = texts.select(F.col(text_col).cast("string").alias(text_col)).where(F.col(text_col).isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = checked(embedder, dim)
        for batch in batches:
            for first in range(0, batch.num_rows, window):
                given = batch.column(0).slice(first, window)
                lines = given.to_pylist()
                out: list = [None] * len(lines)
                fit = []
                for at, text in enumerate(lines):
                    bad = "a text is empty" if not text.strip() else f"a text has more than {MOST_CHARS} characters" if len(text) > MOST_CHARS else None
                    out[at] = (None, bad, 0)
                    if bad is None:
                        fit.append(at)
                for places in requests([lines[at] for at in fit], most_texts, budget):
                    places = [fit[p] for p in places]
                    for at, found in zip(places, answer(model, [lines[p] for p in places], attempts, timeout, pause)):
                        out[at] = found
                vectors = pa.array([None if v is None else v.tolist() for v, _, _ in out], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([given, vectors, pa.array([e for _, e, _ in out], pa.string()), pa.array([n for _, _, n in out], pa.int32())], names=[text_col, "vector", "error", "calls"])

    return asked.mapInArrow(run, f"`{text_col}` string, vector array<float>, error string, calls int")


def embed_rows(rows: DataFrame, text_col: str, embedder: Embedder, dim: int, vec_col: str = "embedding", error_col: str = "embed_error", **how) -> DataFrame:
    """``rows`` with vectors by :func:`dispatch` where they had none, and the error of those that got none.

    Rows that have a vector, or a null text, keep what they have and send nothing. Contents that many rows
    share are told apart by a key of 128 bits, and hot ones are sent to their rows.
    """
    key = [F.xxhash64(F.col(text_col)).alias("__a"), F.xxhash64(F.lit(1), F.col(text_col)).alias("__b")]
    lacks = F.col(vec_col).isNull() & F.col(text_col).isNotNull()
    told = written(dispatch(rows.where(lacks).select(text_col), text_col, embedder, dim, **how).select("vector", "error", *key), "vectors")
    open_rows = rows.where(lacks).select("*", *key)
    many = open_rows.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("n"))
    found = key_join(open_rows, written(told.join(many, ["__a", "__b"]), "vectors"), ["__a", "__b"])
    found = found.withColumn(vec_col, F.col("vector").cast(rows.schema[vec_col].dataType)).select(*rows.columns, F.col("error").alias(error_col))
    return rows.where(~lacks).withColumn(error_col, F.lit(None).cast("string")).unionByName(found)


def embed_texts(texts: DataFrame, embedder: Embedder, text_col: str = "name") -> DataFrame:
    """``text_col, v`` in double precision for each row of distinct texts, in requests of ``MOST_TEXTS``; an error ends the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, out = batch.column(0).to_pylist(), []
            for first in range(0, len(lines), MOST_TEXTS):
                out += np.asarray(embedder(lines[first : first + MOST_TEXTS]), np.float64).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=[text_col, "v"])

    return texts.select(text_col).mapInArrow(run, f"`{text_col}` string, v array<double>")


def tag_text(name: Column, description: Column) -> Column:
    """``name: description``, or the name alone."""
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat_ws(": ", name, description)).otherwise(name)


def project_text(title: Column, description: Column, keywords: Column) -> Column:
    """Title, description and keywords on lines of their own, without empty ones."""
    joined = F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), ", ")
    return F.concat_ws("\n", *[F.when(F.coalesce(c, F.lit("")) != "", c) for c in (title, description, joined)])


def health(embedder: Embedder, name: str, dim: int) -> dict:
    """Whether the model answers: ``status, model, dimensions, max_texts``."""
    try:
        checked(embedder, dim)(["ok"])
        status = "ready"
    except Exception as problem:  # whatever it is, the probe reports it
        status = f"failed: {problem}"
    return {"status": status, "model": name, "dimensions": dim, "max_texts": MOST_TEXTS}


def embed_tags(tags: DataFrame, embedder: Embedder, dim: int, ids: list | None = None) -> DataFrame:
    """``tags`` with fresh vectors of their texts: all of them, or those with the given ids."""
    chosen = F.lit(True) if ids is None else F.col("id").isin(ids)
    fresh = embed_column(embedder, dim)(F.when(chosen, tag_text(F.col("name"), F.col("description"))))
    return tags.withColumn("embedding", F.coalesce(fresh, F.col("embedding")))
