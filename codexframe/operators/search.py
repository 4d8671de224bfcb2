"""Vector search: exact cosine top-k with filters, one hit per document, neighbours per owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexframe.functions.vectors import cosine, cosine_to
from codexframe.operators import tiles
from codexframe.sources.layout import BucketedTable

# fixed values: candidates read per wanted result, and the bounds of a limit
OVERFETCH, LEAST_LIMIT, MOST_LIMIT = 5, 1, 20


def clamp_limit(limit: float, default: int = 10) -> int:
    """A whole limit between 1 and 20."""
    return max(LEAST_LIMIT, min(MOST_LIMIT, int(limit if limit is not None else default)))


def clamped_limit(limit: Column, default: int = 10) -> Column:
    """:func:`clamp_limit` of a column; null takes the default."""
    whole = F.coalesce(limit, F.lit(default)).cast("double")
    return F.greatest(F.lit(LEAST_LIMIT), F.least(F.lit(MOST_LIMIT), whole.cast("int")))


def scored(vectors: DataFrame, query: list[float], vec_col: str = "embedding") -> DataFrame:
    """Rows that have a vector, with their cosine ``score`` to one query, worked out in Arrow batches."""
    return vectors.where(F.col(vec_col).isNotNull()).withColumn("score", cosine_to(query)(F.col(vec_col))).where("score is not null")


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str, vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The ``k`` rows most like the query among those that pass ``where``, ties to the smaller id."""
    rows = vectors if where is None else vectors.where(where)
    return scored(rows, query, vec_col).orderBy(F.desc("score"), id_col).limit(k)


def semantic_search(
    chunks: DataFrame,
    documents: DataFrame,
    owner: object,
    query: list[float],
    limit: int = 10,
    chunk_id: str = "id",
    document_id: str = "document_id",
    owner_col: str = "user_id",
) -> DataFrame:
    """Best chunk of each of the owner's documents: ``OVERFETCH * limit`` chunks, one per document, ``limit`` of those.

    The owner's filter comes before the ranking. Few documents with many good chunks may give fewer rows
    than ``limit``; that is the contract.
    """
    mine = documents.where(F.col(owner_col) == owner)
    joined = chunks.join(mine, document_id)
    best = scored(joined, query).drop("embedding").orderBy(F.desc("score"), chunk_id).limit(OVERFETCH * limit)
    place = Window.partitionBy(document_id).orderBy(F.desc("score"), chunk_id)
    return best.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n").orderBy(F.desc("score"), chunk_id).limit(limit)


def semantic_search_stored(
    chunks: BucketedTable, owner: object, query: list[float], limit: int = 10, chunk_id: str = "id", document_id: str = "document_id"
) -> DataFrame:
    """:func:`semantic_search` over chunks stored in buckets of their owner: the owner's folder alone is opened.

    The score is a column expression, so chunks go from the scan to the ranking without leaving the JVM.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    near = chunks.of(owner).withColumn("score", cosine(F.col("embedding"), q)).where("score is not null").drop("embedding")
    best = near.orderBy(F.desc("score"), chunk_id).limit(OVERFETCH * limit)
    place = Window.partitionBy(document_id).orderBy(F.desc("score"), chunk_id)
    return best.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n").orderBy(F.desc("score"), chunk_id).limit(limit)


#: Rows of a group that one task compares with as many others.
TILE = 4096


def neighbours_per_group(rows: DataFrame, group: str, id_col: str, vec_col: str = "embedding", k: int = 1) -> DataFrame:
    """Each row's ``k`` most similar others within its group: ``id, other_id, score, rank``.

    A group is cut into tiles, so that a large one is dealt to many tasks; a tile pair is one matrix
    product and keeps ``k`` per row. Rows without a vector, or with a zero one, take no part.
    """
    base = tiles.prepared(rows, group, id_col, vec_col)
    return tiles.nearest(base, base, k, itself=False, tile=TILE).select("id", "other_id", "score", "rank")


def approximate_top_k(vectors: DataFrame, query: list[float], k: int, id_col: str, vec_col: str = "embedding", tables: int = 8, width: float = 1.0) -> DataFrame:
    """An approximate mode over unit vectors: random-projection buckets, then exact cosine of the candidates."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.where(F.col(vec_col).isNotNull()).withColumn("__f", array_to_vector(F.col(vec_col).cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="__f", outputCol="__h", bucketLength=width, numHashTables=tables, seed=7).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense(query), 4 * k).drop("__f", "__h", "distCol")
    return top_k(near, query, k, id_col, vec_col)
