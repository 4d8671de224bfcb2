"""Tags: canonical lookup, similarity bands, and the order-dependent resolution of new names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexframe.functions.text import normalize_tag, trim
from codexframe.operators import tiles
from codexframe.operators.embedding import Embedder, embed_texts
from codexframe.operators.search import top_k
from codexframe.sources.scratch import key_join, written

# fixed values: similarity from which a name is merged, and from which it is reviewed
MERGE, REVIEW = 0.90, 0.78


def resolve_exact(names: DataFrame, tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """``names`` (``owner, name``) with ``normalized`` and ``tag_id``: by canonical name, else by earliest alias, else null."""
    return _resolved(names, tags, aliases, tags)


def band(score: Column) -> Column:
    """``MERGE`` from 0.90, ``REVIEW`` from 0.78, else (and without a neighbour) ``NEW``."""
    return F.when(score >= MERGE, "MERGE").when(score >= REVIEW, "REVIEW").otherwise("NEW")


def similar_tags(tags: DataFrame, owner: object, query: list[float], limit: int = 5) -> DataFrame:
    """The owner's most similar tags: ``id, name, normalized_name, score``."""
    rows = top_k(tags, query, limit, "id", where=F.col("created_by_user_id") == owner)
    return rows.select("id", "name", "normalized_name", "score")


def nearest_tags(candidates: DataFrame, tags: DataFrame, k: int = 1, tile: int = tiles.TILE) -> DataFrame:
    """Each candidate's (``owner, id, v``) ``k`` most similar tags (``owner, id, v``) of its owner: ``owner, id, rank, tag_id, score, band``.

    Candidates and tags meet in tiles. A candidate without any tag, or without a usable vector, has one row
    with a null tag and the band ``NEW``.
    """
    ready = lambda rows: tiles.prepared(rows, "owner", "id", "v")
    found = tiles.nearest(ready(candidates), ready(tags), k, tile=tile).select(F.col("g").alias("owner"), "id", "rank", F.col("other_id").alias("tag_id"), "score")
    met = candidates.select("owner", "id").join(found, ["owner", "id"], "left")
    return met.select("owner", "id", F.coalesce("rank", F.lit(1)).alias("rank"), "tag_id", "score", band(F.col("score")).alias("band"))


#: Decimals of a score; scores that agree in these tie.
DIGITS = 9


def _close(schema: str, floor: float) -> tuple[tiles.Compare, str]:
    """All pairs of at least this similarity but of one id: ``id`` and the right row's ``id, t, tag``, with ``score``."""

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        near = tiles.cosines(x, y, DIGITS) if x.num_rows and y.num_rows else np.zeros((0, 0))
        row, at = np.nonzero(near >= floor)
        mine, theirs = x.column("id").to_numpy(), y.column("id").to_numpy()
        other = mine[row] != theirs[at]
        row, at = row[other], at[other]
        told = [mine[row], y.column("t").to_numpy()[at], y.column("tag").take(pa.array(at, pa.int64())), near[row, at]]
        return pa.table(dict(zip(("id", "tag_t", "tag", "score"), told)))

    return compare, schema


def _earliest(x: pa.Table, y: pa.Table) -> pa.Table:
    """The earliest other right row in reach of each left row: ``id, t``, one row a tile at most."""
    if not x.num_rows or not y.num_rows:
        return pa.table({"id": np.zeros(0, np.int64), "t": np.zeros(0, np.int64)})
    mine, theirs, time = x.column("id").to_numpy(), y.column("id").to_numpy(), y.column("t").to_numpy()
    hit = (tiles.cosines(x, y, DIGITS) >= REVIEW) & (mine[:, None] != theirs[None, :])
    first = np.where(hit, time[None, :], np.iinfo(np.int64).max).min(1)
    some = hit.any(1)
    return pa.table({"id": mine[some], "t": first[some]})


def _new_tags(variants: DataFrame, occurrences: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Which names become tags, as if each were judged in turn: ``id`` of those, and ``id, tag_t, tag, score`` of the names in their reach.

    ``variants`` (``id, owner, name, normalized, t, v, known_score``) are the distinct names that no tag or alias has,
    ``t`` their first place in the order; ``occurrences`` holds ``owner, name, t``. A name becomes a tag at its first place
    or never: its score only grows with the tags, and it must be below ``REVIEW``. Other spellings of its normalized
    form matter too, as an earlier one may have become a tag or been merged.

    A round settles all names that no unsettled earlier name can touch, in parallel; the earliest one always
    is such. What the new tags reach is then found, and the rest goes on. Of the names in reach only the earliest
    is handed on by a tile; pairs are kept with new tags alone, which lie apart from each other.
    """
    spark, group = variants.sparkSession, ["owner", "normalized"]
    ready = lambda rows, *more: tiles.prepared(rows, "owner", "id", "v", *more)
    several = variants.groupBy(*group).count().where("count > 1").select(*group)
    spelled = written(variants.join(several, group, "left_semi"), "spelled")  # names with further spellings
    times = written(occurrences.join(spelled.select("owner", "name", "id"), ["owner", "name"]).select("id", "t"), "spelled_at")
    left = written(variants.where(F.col("known_score") < REVIEW).drop("known_score"), "open")
    pairs_schema = "id long, tag_t long, tag string, score double"
    made, pairs = spark.createDataFrame([], "id long"), spark.createDataFrame([], pairs_schema)
    known = spelled.where(F.col("known_score") >= MERGE).select(*group, F.col("t").alias("done"))
    settled_groups = known
    while not left.isEmpty():
        watching = left.select("id", "owner", "v").unionByName(spelled.join(left.select("id"), "id", "left_anti").select("id", "owner", "v"))
        first = tiles.meet(ready(watching), ready(left, "t"), _earliest, "id long, t long", tile).groupBy("id").agg(F.min("t").alias("reach"))
        first = written(first, "reach")
        # the earliest time from which a group's outcome hangs on a name that isn't settled
        hang = spelled.join(left.select("id", F.lit(True).alias("unsettled")), "id", "left").join(first, "id", "left").select(
            *group, F.when(F.col("unsettled"), F.col("t")).when(F.col("reach").isNotNull(), F.greatest("t", "reach")).alias("hang")
        ).groupBy(*group).agg(F.min("hang").alias("hang"))
        done = settled_groups.groupBy(*group).agg(F.min("done").alias("done"))
        judged = left.join(first, "id", "left").join(hang, group, "left").join(done, group, "left")
        free = ~F.coalesce(F.col("reach") < F.col("t"), F.lit(False)) & ~F.coalesce(F.col("hang") < F.col("t"), F.lit(False))
        taken = F.coalesce(F.col("done") < F.col("t"), F.lit(False))
        judged = written(judged.select(*left.columns, free.alias("free"), taken.alias("taken")), "judged")
        fresh = judged.where("free and not taken").select(*left.columns)
        tag = F.concat(F.lit("new:"), "owner", F.lit(":"), "normalized").alias("tag")
        reached = tiles.meet(ready(variants), ready(fresh.select("*", tag), "t", "tag"), *_close(pairs_schema, REVIEW), tile)
        reached = written(reached, "reached")
        merged = reached.where(F.col("score") >= MERGE).join(times, "id").where("t > tag_t").groupBy("id").agg(F.min("t").alias("done"))
        settled_groups = written(
            settled_groups.unionByName(fresh.join(several, group, "left_semi").select(*group, F.col("t").alias("done")))
            .unionByName(spelled.select("id", *group).join(merged, "id").select(*group, "done")),
            "settled_groups",
        )
        made, pairs = made.unionByName(fresh.select("id")), pairs.unionByName(reached)
        rest = judged.where("not free").select(*left.columns)
        touched = reached.join(rest.select("id", "t"), "id").where("tag_t < t").select("id").distinct()
        left = written(rest.join(touched, "id", "left_anti"), "open")
    return made, pairs


def sync_tags(names: DataFrame, tags: DataFrame, aliases: DataFrame, embedder: Embedder, tile: int = tiles.TILE) -> DataFrame:
    """What resolving each document's names in order does: one row per name, with ``action``.

    ``names``: ``owner, document_id, names`` (array). Names are trimmed, null, empty and repeated raw ones left out;
    rows without an owner are left out, equal rows count once. Each name sees the tags and aliases that earlier
    names of the owner made, documents by id. Actions: ``LINK`` (known tag, confidence 1), ``MERGE`` (new alias
    of a tag at least 0.90 alike), ``REVIEW`` (from 0.78, no link), ``CREATE``, and ``REJECT`` for a name
    without letters and digits. Scores are rounded to ``DIGITS`` decimals, ties go to the smaller tag id.

    The outcome is that of judging one name after the other, but names are judged in rounds: distinct names
    are embedded once, their nearest known tags found in tiles, the names that become tags settled by
    :func:`_new_tags`, and every occurrence then reads its outcome from the tags made before it. No step
    gathers an owner, a document or a name in one task.
    """
    owned = lambda c: F.col(c).cast("string").alias("owner")
    listed = F.array_distinct(F.filter(F.transform("names", trim), lambda x: x != ""))
    asked = names.select(owned("owner"), F.col("document_id").cast("string").alias("document_id"), "names").where("owner is not null")
    each = asked.select("owner", "document_id", F.posexplode(listed).alias("position", "name")).distinct()
    rows = written(each.sort("document_id", "position", "owner", "name").withColumn("t", F.monotonically_increasing_id()), "occurrences")
    counted = rows.groupBy("owner", "name").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("n"))

    exact = tags.select(owned("created_by_user_id"), F.col("id").cast("string").alias("id"), "normalized_name", "embedding")
    canonical = exact.groupBy(F.col("owner").alias("created_by_user_id"), "normalized_name").agg(F.min("id").alias("id"))
    owners = exact.select("id", F.col("owner").alias("created_by_user_id"))
    also = aliases.select(F.col("tag_id").cast("string").alias("tag_id"), "normalized_alias", "created_at")
    looked = _resolved(counted, canonical, also, owners)
    looked = written(looked.select("owner", "name", "normalized", "tag_id", "t", "n").withColumn("id", F.monotonically_increasing_id()), "names")

    open_names = looked.where("normalized != '' and tag_id is null")
    texts = open_names.select("name").distinct()
    vector = embed_texts(texts, embedder)
    variants = written(open_names.join(vector, "name").select("id", "owner", "name", "normalized", "t", "v"), "variants")
    ready = lambda df: tiles.prepared(df, "owner", "id", "v")
    near = tiles.nearest(ready(variants), ready(exact.withColumnRenamed("embedding", "v")), 1, digits=DIGITS, tile=tile)
    near = near.select("id", F.col("other_id").alias("known"), F.col("score").alias("known_score"))
    variants = variants.join(near, "id", "left").withColumn("known_score", F.coalesce("known_score", F.lit(-2.0)))
    variants = written(variants, "variants")
    made, pairs = _new_tags(variants.drop("known"), rows.select("owner", "name", "t"), tile)

    told = pairs.groupBy("id").agg(F.collect_list(F.struct("tag_t", "score", "tag")).alias("near"))  # new tags lie apart: few are in reach
    facts = looked.join(variants.select("id", "known", "known_score"), "id", "left").join(told, "id", "left")
    facts = facts.join(made.withColumn("made", F.lit(True)), "id", "left").withColumn("first", F.col("t")).drop("t", "id")
    seen = key_join(rows, written(facts, "facts"), ["owner", "name"])
    start = F.struct(F.col("known_score").alias("score"), F.col("known").alias("tag"))
    better = lambda a, b: F.when((b["score"] > a["score"]) | ((b["score"] == a["score"]) & (b["tag"] < a["tag"])), F.struct(b["score"].alias("score"), b["tag"].alias("tag"))).otherwise(a)
    before = F.filter(F.coalesce("near", F.array().cast("array<struct<tag_t:bigint,score:double,tag:string>>")), lambda x: x["tag_t"] < F.col("t"))
    seen = seen.withColumn("best", F.aggregate(before, start, better))
    fresh_id = F.concat(F.lit("new:"), "owner", F.lit(":"), "normalized")
    creates = F.coalesce(F.col("made"), F.lit(False)) & (F.col("t") == F.col("first"))
    settles = F.when(creates, F.struct("t", F.lit("CREATE").alias("action"), fresh_id.alias("tag"))).when(
        F.col("best.score") >= MERGE, F.struct("t", F.lit("MERGE").alias("action"), F.col("best.tag").alias("tag"))
    )
    seen = written(seen.withColumn("settles", F.when(F.col("tag_id").isNull() & (F.col("normalized") != ""), settles)).drop("near"), "seen")
    settled = seen.groupBy("owner", "normalized").agg(F.min("settles").alias("settled"), F.count(F.lit(1)).alias("n"))
    judged = key_join(seen.drop("n"), written(settled, "settled"), ["owner", "normalized"])
    action = (
        F.when(F.col("normalized") == "", "REJECT")
        .when(F.col("tag_id").isNotNull() | F.coalesce(F.col("settled.t") < F.col("t"), F.lit(False)), "LINK")
        .when(F.col("settled.t") == F.col("t"), F.col("settled.action"))
        .otherwise("REVIEW")
    )
    judged = judged.withColumn("action", action)
    linked = F.col("action") == "LINK"
    judged = judged.select(
        "owner", "document_id", "position", "name", "normalized", "action",
        F.when(linked, F.coalesce("tag_id", "settled.tag")).when(F.col("action") == "CREATE", F.col("settled.tag")).when(F.col("action") != "REJECT", F.col("best.tag")).alias("tag_id"),
        F.when(linked | (F.col("action") == "CREATE"), 1.0).when(F.col("action") != "REJECT", F.col("best.score")).alias("confidence"),
        F.when(F.col("action").isin("LINK", "CREATE"), "AI").when(F.col("action") == "MERGE", "MERGED").alias("source"),
    )
    judged = written(judged, "judged")
    plain = judged.where("action in ('LINK', 'REJECT')").withColumn("vector", F.lit(None).cast("array<float>"))
    rest = judged.where("action not in ('LINK', 'REJECT')")
    kept = rest.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n")).join(variants.select("owner", "name", F.col("v").cast("array<float>").alias("vector")), ["owner", "name"])
    return plain.unionByName(key_join(rest, written(kept, "kept"), ["owner", "name"]))


def _resolved(names: DataFrame, canonical: DataFrame, aliases: DataFrame, owners: DataFrame) -> DataFrame:
    """:func:`resolve_exact` over tags of which only the smallest id of a normalized name is canonical, while any can have aliases."""
    asked = names.withColumn("normalized", normalize_tag(F.col("name")))
    exact = canonical.select(F.col("created_by_user_id").alias("owner"), F.col("normalized_name").alias("normalized"), F.col("id").alias("exact_id"))
    owned = aliases.join(owners.select(F.col("id").alias("tag_id"), F.col("created_by_user_id").alias("owner")), "tag_id")
    by_alias = owned.groupBy("owner", F.col("normalized_alias").alias("normalized")).agg(F.min(F.struct("created_at", "tag_id"))["tag_id"].alias("alias_id"))
    joined = asked.join(exact, ["owner", "normalized"], "left").join(by_alias, ["owner", "normalized"], "left")
    return joined.withColumn("tag_id", F.when(F.col("normalized") != "", F.coalesce("exact_id", "alias_id"))).drop("exact_id", "alias_id")


def document_links(resolved: DataFrame) -> DataFrame:
    """The links that a resolution leaves: of several on one tag of a document the last counts."""
    last = Window.partitionBy("document_id", "tag_id").orderBy(F.desc("position"))
    links = resolved.where(F.col("action").isin("LINK", "MERGE", "CREATE")).withColumn("n", F.row_number().over(last)).where("n = 1")
    return links.select("document_id", "tag_id", "confidence", "source")


def reset_document_tags(document_tags: DataFrame, reviews: DataFrame, document_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Before a new resolution: the documents' AI and MERGED links and PENDING reviews go; USER links stay.

    Only rows that may go meet the documents, and the documents are the side that is held in a task: nothing
    is sorted, and a document's rows pass by.
    """
    known = document_ids.select("document_id").hint("shuffle_hash")

    def left(rows: DataFrame, may_go: Column) -> DataFrame:
        may_go = F.coalesce(may_go, F.lit(False))
        return rows.where(~may_go).unionByName(rows.where(may_go).join(known, "document_id", "left_anti").select(*rows.columns))

    return left(document_tags, F.col("source").isin("AI", "MERGED")), left(reviews, F.col("status") == "PENDING")


def review_outcome(reviews: DataFrame, tags: DataFrame, action: str) -> DataFrame:
    """What approving or rejecting pending reviews writes: the link's tag, confidence and source, and the alias.

    Approved: an alias of the suggested tag, linked with the similarity as MERGED. Rejected: the owner's
    tag of that normalized name, or a new one (``tag_id`` null) that takes the candidate's vector.
    """
    pending = reviews.where("status = 'PENDING'")
    if action == "APPROVE":
        return pending.select(
            "id", "document_id", F.col("suggested_tag_id").alias("tag_id"), F.col("similarity").alias("confidence"), F.lit("MERGED").alias("source"),
            F.col("candidate_tag_name").alias("alias"), F.lit("APPROVED").alias("status"),
        )
    own = tags.select(F.col("created_by_user_id").alias("user_id"), F.col("normalized_name").alias("candidate_normalized_name"), F.col("id").alias("tag_id"))
    return pending.join(own, ["user_id", "candidate_normalized_name"], "left").select(
        "id", "document_id", "tag_id", F.lit(1.0).alias("confidence"), F.lit("AI").alias("source"), F.lit(None).cast("string").alias("alias"), F.lit("REJECTED").alias("status")
    )


def name_conflicts(names: DataFrame, tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names (``owner, name``) that a new or renamed tag may not take: canonical names and aliases in use.

    ``tag_id`` tells whose it is; renaming a tag to its own name is no conflict for the caller.
    """
    return resolve_exact(names, tags, aliases).where("tag_id is not null")


def copy_candidate_vectors(tags: DataFrame, outcome: DataFrame, reviews: DataFrame) -> DataFrame:
    """``tags`` where those that a rejected review settled on take the candidate's vector."""
    settled = outcome.join(reviews.select("id", "candidate_embedding"), "id").where("tag_id is not null and candidate_embedding is not null")
    chosen = settled.groupBy("tag_id").agg(F.max_by("candidate_embedding", "id").alias("__v"))
    joined = tags.join(chosen, tags["id"] == chosen["tag_id"], "left").drop("tag_id")
    return joined.withColumn("embedding", F.coalesce("__v", "embedding")).drop("__v").select(*tags.columns)
