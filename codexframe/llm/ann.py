"""Approximate nearest neighbours over learned partitions.

A bounded sample's neighbour graph is cut into balanced parts. A small classifier learns, from a vector
alone, how its neighbours spread over the parts; it assigns every row to a part and routes each query to
its most probable parts, whose rows are reranked by the exact inner product. The parts of a large table are
cut again in the same way, each by a classifier of its own, as often as it takes to make them small.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexframe.llm.common import discard, heavy_join, keyed, materialize

#: Rows, about, that graph and classifier are fitted on.
SAMPLE = 12_000
#: The most parts that a sample can teach, and the rows of a part above which parts are cut again.
MOST_PARTS, ROWS_PER_PART = 64, 4096
#: Neighbours in the graph; share of a query's probable neighbours that its parts must cover.
DEGREE, COVER = 16, 0.95
#: Rows of a part that one task compares at a time.
BLOCK = 8192


@dataclass(frozen=True)
class Router:
    """A classifier of one hidden layer; ``scale`` divides vectors before it."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x / self.scale) @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Each row's ``degree`` nearest others by inner product, in blocks."""
    degree = min(degree, len(x) - 1)
    out = np.empty((len(x), degree), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 30, slack: float = 0.05) -> np.ndarray:
    """Cut the neighbour graph into parts of nearly equal size with few edges between them.

    Starts from halvings along the directions of largest variance; then, round by round, rows move to the
    part that holds most of their neighbours, largest gain first, as far as its room allows.
    """
    n = len(x)
    part = np.zeros(n, np.int64)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[rows] = first
            return
        centred = x[rows] - x[rows].mean(0)
        _, axes = np.linalg.eigh(centred.T @ centred)
        order = rows[np.argsort(centred @ axes[:, -1], kind="stable")]
        left = count // 2
        cut = len(rows) * left // count
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, count - left)

    halve(np.arange(n), 0, parts)
    most = int(np.ceil(n / parts * (1 + slack)))
    source = np.repeat(np.arange(n), graph.shape[1])
    ends = np.concatenate((source, graph.ravel())), np.concatenate((graph.ravel(), source))
    for _ in range(rounds):
        ties = np.bincount(ends[0] * parts + part[ends[1]], minlength=n * parts).reshape(n, parts)
        best = ties.argmax(1)
        gain = ties[np.arange(n), best] - ties[np.arange(n), part]
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for row in np.argsort(-gain, kind="stable"):
            if gain[row] <= 0:
                break
            to, at = best[row], part[row]
            if sizes[to] < most and (row + moved) % 2:  # half of the rows: neighbours don't swap places at once
                part[row] = to
                sizes[to] += 1
                sizes[at] -= 1
                moved += 1
        if moved < n // 1000:
            break
    return part


def train_router(x: np.ndarray, parts: int, degree: int = DEGREE, hidden: int = 128, epochs: int = 40, seed: int = 7) -> Router:
    """Fit the classifier on a sample: targets are the shares of a row's neighbours, itself included, by part."""
    scale = float(np.sqrt((x * x).sum() / max(1, x.size))) or 1.0
    if parts == 1 or len(x) < 2:
        d = x.shape[1]
        return Router(scale, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, degree)
    part = balanced_parts(graph, x, parts)
    target = np.zeros((len(x), parts))
    near = np.concatenate((np.arange(len(x))[:, None], graph), 1)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    weights = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    z = x / scale
    for epoch in range(epochs):
        rate = 0.003 * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            step += 1
            h = z[rows] @ weights[0] + weights[1]
            r = np.maximum(h, 0)
            o = r @ weights[2] + weights[3]
            o = np.exp(o - o.max(1, keepdims=True))
            g = (o / o.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (g @ weights[2].T) * (h > 0)
            grads = [z[rows].T @ back + 1e-4 * weights[0], back.sum(0), r.T @ g + 1e-4 * weights[2], g.sum(0)]
            for w, mm, vv, grad in zip(weights, m, v, grads):
                mm *= 0.9
                mm += 0.1 * grad
                vv *= 0.999
                vv += 0.001 * grad * grad
                w -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return Router(scale, *weights)


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, v`` of the rows that take part: ids set, vectors of the table's usual length, finite, not zero."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def part_count(rows: int, most: int = MOST_PARTS) -> int:
    """A quarter of the square root of the rows: routing and comparing then grow alike. Fewer than 64 rows teach nothing."""
    return max(1, min(most, int(rows**0.5 / 4)))


def _chosen(p: np.ndarray, cover: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and part of the most probable part of each row, or of all that cover this share of its neighbours."""
    if cover is None:
        return np.arange(len(p)), p.argmax(1)
    order = np.argsort(-p, axis=1, kind="stable")
    sorted_p = np.take_along_axis(p, order, 1)
    row, at = np.nonzero(np.cumsum(sorted_p, 1) - sorted_p < cover)
    return row, order[row, at]


def _dealt(x: np.ndarray, own: np.ndarray, routers: dict[int, Router], cover: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows taken and the part that ``routers[own]`` finds in each. A part without a router stays whole."""
    taken, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in np.unique(own):
        mine = np.flatnonzero(own == part)
        row, sub = np.arange(len(mine)), np.zeros(len(mine), np.int64)
        if part in routers:
            row, sub = _chosen(routers[part].probabilities(x[mine]), cover)
        taken.append(mine[row])
        parts.append(int(part) * MOST_PARTS + sub)
    return np.concatenate(taken), np.concatenate(parts)


def _route(rows: DataFrame, routers: dict[int, Router], cover: float | None) -> DataFrame:
    """``rows`` (``id, v, part``) with the part that ``routers[part]`` finds in it, or all that cover the share of neighbours.

    Parts are numbered through: ``MOST_PARTS`` for each one before. The routers, ``MOST_PARTS`` at most, go with the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            taken, parts = _dealt(_matrix(batch.column(1)), batch.column(2).to_numpy(), routers, cover)
            out = batch.take(pa.array(taken))
            yield pa.RecordBatch.from_arrays([*out.columns[:2], pa.array(parts, pa.int64())], names=["id", "v", "part"])

    return rows.mapInArrow(run, "id long, v array<double>, part long")


def _route_far(rows: DataFrame, sizes: DataFrame, models: DataFrame, cover: float | None) -> DataFrame:
    """As :func:`_route`, for any number of routers (``part, model``): each block of a part's rows meets its own in a shuffle.

    ``sizes`` (``part, n``) counts ``rows`` by part.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = keyed(rows, sizes, ["part"], "inner").select("id", "v", "part", F.pmod(F.xxhash64(F.lit("block"), "id"), blocks).cast("int").alias("block"))
    spread = models.join(sizes, "part").select("part", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "model")

    def run(got: pa.Table, model: pa.Table) -> pa.Table:
        if not got.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64())), "part": pa.array([], pa.int64())})
        own = got.column("part").to_numpy()
        routers = {own[0]: _unpickled(model.column("model")[0].as_py())} if model.num_rows else {}
        taken, parts = _dealt(_matrix(got.column("v")), own, routers, cover)
        out = got.select(["id", "v"]).take(pa.array(taken))
        return out.append_column("part", pa.array(parts, pa.int64()))

    key = ["part", "block"]
    return mine.groupBy(*key).cogroup(spread.groupBy(*key)).applyInArrow(run, "id long, v array<double>, part long")


def _unpickled(model: bytes) -> Router:
    return Router(*pickle.loads(model))


def _part_routers(dealt: DataFrame, sizes: DataFrame, sample: int, most_parts: int) -> DataFrame:
    """``part, model``: a classifier for each part of ``dealt``, fitted in a task on about ``sample`` of the part's rows."""
    dice = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        part, size = rows.column("part")[0].as_py(), rows.column("n")[0].as_py()
        router = train_router(_matrix(rows.column("v")), part_count(size, min(most_parts, max(1, rows.num_rows // 128))))
        return pa.table({"part": pa.array([part], pa.int64()), "model": pa.array([pickle.dumps((router.scale, router.w1, router.b1, router.w2, router.b2))], pa.binary())})

    taught = keyed(dealt, sizes, ["part"], "inner").where(dice < F.lit(float(sample)) / F.col("n"))
    return materialize(taught.groupBy("part").applyInArrow(fit, "part long, model binary"), "routers")


def _sizes(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "sizes")


def _levels(rows: int, parts: int, rows_per_part: int, most_parts: int) -> int:
    """How often the table is cut until a part holds ``rows_per_part`` rows at most, on average."""
    levels, left = 1, rows / parts
    while left > rows_per_part and parts > 1:
        parts = part_count(int(left), most_parts)
        left /= parts
        levels += parts > 1
    return levels


def _tiles(rows: DataFrame, mine: DataFrame, other: DataFrame, own: str, replicated: str) -> DataFrame:
    """``rows`` with their own block of their part, by hash, and once for each block of the other side.

    ``mine`` and ``other`` count both sides' rows by part; one row a part is joined.
    """
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(c), F.lit(0)) / BLOCK)).cast("int")
    table = mine.join(other.withColumnRenamed("n", "m"), "part", "left").select("part", blocks("n").alias("here"), blocks("m").alias("there"))
    sent = keyed(rows, materialize(table, "blocks"), ["part"], "inner")
    one = F.pmod(F.xxhash64("id"), F.col("here")).cast("int").alias(own)
    return sent.select("id", "v", "part", one, F.explode(F.sequence(F.lit(0), F.col("there") - 1)).alias(replicated))


def nearest(
    df: DataFrame,
    is_query: str,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    cover: float = COVER,
    sample: int = SAMPLE,
    rows_per_part: int = ROWS_PER_PART,
    most_parts: int = MOST_PARTS,
) -> DataFrame:
    """Each query row's ``k`` nearest other rows: ``query_id, rank`` (from 1), ``id, score``.

    ``is_query`` is a condition on ``id``. Nearness is the inner product in double precision, ties to the
    smaller id. Every row is indexed; ``cover`` is the share of a query's neighbours, as the classifier
    estimates it, that the parts it is sent to must hold, and so about the recall. There are ``part_count``
    parts; while they hold more than ``rows_per_part`` rows on average, each is cut again by a classifier of its own. Fewer
    than 64 rows are one part. The classifiers learn from ``sample`` rows each, all rows are indexed. Vectors
    that are null, zero, of another length than most (no inner product with them exists), or that hold null
    or non-finite components take no part; no valid row, no result. Rows equal in id and vector are one row; an
    id with several vectors is several rows, each a candidate and, as a query, answered by a list of its own
    that may hold the id's other rows.

    Rows of one vector form a class: a class is compared once, and of its members the ``k + 1`` smallest
    ids suffice, so copies neither fill a part nor a task. A part's rows and queries meet in tiles of at
    most about ``BLOCK`` rows a side.
    """
    valid = materialize(valid_vectors(df, id_col, vec_col).distinct(), "vectors")
    members = valid.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    # numbered in order of their smallest ids, one by one: an id with several vectors is in several classes
    numbered = members.where("n = 1").select(F.col("id").alias("low"), "v").sort("low").withColumn("class", F.monotonically_increasing_id())
    numbered = materialize(numbered, "classes")
    members = materialize(members.join(numbered, "v").select("class", "id"), "members")
    base = numbered.select(F.col("class").alias("id"), "v")
    n_base = numbered.count()
    asked = valid.where(is_query)
    by_query = asked.groupBy("v").agg(F.count(F.lit(1)).alias("n")).join(numbered, "v").select("v", F.col("class").alias("q"), "n")
    by_query = materialize(by_query, "by_query")
    queries = by_query.select(F.col("q").alias("id"), "v")
    parts = part_count(n_base, min(most_parts, max(1, sample // 128)))
    dice = F.pmod(F.xxhash64(F.lit("ann"), "low"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taught = numbered.where(dice < F.lit(sample / max(n_base, 1))).orderBy("class").select("v").toArrow()  # about `sample` rows
    if taught.num_rows < 2 * DEGREE:
        parts = 1
    d = len(taught.column(0)[0]) if taught.num_rows else 1
    x = _matrix(taught.column(0)) if taught.num_rows else np.zeros((0, d))
    routers = {0: train_router(x, parts)}
    levels = _levels(n_base, parts, rows_per_part, most_parts)
    share = cover ** (1 / levels)
    root = lambda rows: rows.withColumn("part", F.lit(0).cast("long"))
    dealt = materialize(_route(root(base), routers, None), "base")
    sent = materialize(_route(root(queries), routers, share if parts > 1 else 1.0), "queries")
    n_rows, n_sent = _sizes(dealt), _sizes(sent)
    for level in range(1, levels):
        models = _part_routers(dealt, n_rows, sample, most_parts)
        if level == 1:  # as many as the first has parts
            few = {r["part"]: _unpickled(r["model"]) for r in models.collect()}
            finer, asks = _route(dealt, few, None), _route(sent, few, share)
        else:
            finer, asks = _route_far(dealt, n_rows, models, None), _route_far(sent, n_sent, models, share)
        coarse, dealt, sent = (dealt, sent, n_rows, n_sent, models), materialize(finer, "base"), materialize(asks, "queries")
        n_rows, n_sent = _sizes(dealt), _sizes(sent)
        discard(*coarse)
    left = _tiles(sent, n_sent, n_rows, "qb", "bb")
    right = _tiles(dealt, n_rows, n_sent, "bb", "qb")
    want = k + 1

    def compare(q: pa.Table, b: pa.Table) -> pa.Table:
        out_q, out_b, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if q.num_rows and b.num_rows:
            qv, bv = _matrix(q.column("v")), _matrix(b.column("v"))
            qi, bi = q.column("id").to_numpy(), b.column("id").to_numpy()
            order = np.argsort(bi, kind="stable")
            bv, bi = bv[order], bi[order]
            # twice what rounding can move a sum of products, relative to the vectors
            off = np.sqrt((qv * qv).sum(1)) * np.sqrt((bv * bv).sum(1).max()) * (qv.shape[1] + 8) * 5e-16
            for at in range(0, len(qv), 512):
                s = qv[at : at + 512] @ bv.T
                if len(bi) > want:
                    least = np.partition(s, len(bi) - want, axis=1)[:, len(bi) - want]
                    row, col = np.nonzero(s >= (least - off[at : at + 512])[:, None])
                else:
                    row, col = (x.ravel() for x in np.indices(s.shape))
                exact = (qv[at + row] * bv[col]).sum(1)
                best = np.lexsort((bi[col], -exact, row))
                row, col, exact = row[best], col[best], exact[best]
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                place = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate((first, [len(row)]))))
                keep = place < want
                out_q.append(qi[at + row[keep]])
                out_b.append(bi[col[keep]])
                out_s.append(exact[keep])
        return pa.table({"q": np.concatenate(out_q), "class": np.concatenate(out_b), "score": np.concatenate(out_s)})

    tile = ["part", "qb", "bb"]
    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(compare, "q long, class long, score double")
    top = lambda rows, key, n: rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("score").desc(), "id"))
    ).where(F.col("rank") <= n)
    near = materialize(top(found.withColumnRenamed("class", "id"), ["q"], want).select("q", F.col("id").alias("class"), "score"), "near")
    hits = near.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    ids = members.join(hits, "class").groupBy("class").agg(F.collect_list("id").alias("ids"), F.first("n").alias("n"))  # k + 1 at most
    lists = heavy_join(near, ids, ["class"]).select("q", "class", "score", F.explode("ids").alias("id"))
    lists = top(lists, ["q"], want).groupBy("q").agg(F.collect_list(F.struct("class", "id", "score")).alias("list"))
    askers = heavy_join(asked.select(F.col("id").alias("query_id"), "v"), by_query, ["v"]).select("query_id", "q")
    answers = heavy_join(askers, lists.join(by_query.select("q", "n"), "q"), ["q"]).select("query_id", "q", F.inline("list"))
    answers = answers.where("query_id != id or q != class")
    return top(answers, ["query_id", "q"], k).select("query_id", "rank", "id", "score")
