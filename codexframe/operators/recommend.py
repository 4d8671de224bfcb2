"""Documents for a project: vector candidates, then a blend of four scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexframe.functions.text import normalize_tag, overlap, percent, word_set
from codexframe.operators.search import scored

# fixed values: candidates, results, excerpt length, and the weights of the scores
CANDIDATES, RESULTS, EXCERPT = 80, 8, 500
WEIGHTS = {"semantic_score": 0.65, "topic_score": 0.15, "difficulty_score": 0.10, "tag_score": 0.10}


def candidates(chunks: DataFrame, documents: DataFrame, owner: object, query: list[float], owner_col: str = "user_id", status_col: str = "status") -> DataFrame:
    """The 80 best chunks of the owner's READY documents."""
    mine = documents.where((F.col(owner_col) == owner) & (F.col(status_col) == "READY")).select("document_id")
    return scored(chunks.join(mine, "document_id"), query).drop("embedding").orderBy(F.desc("score"), "chunk_id").limit(CANDIDATES)


def best_chunks(found: DataFrame) -> DataFrame:
    """Each document's best candidate: ``document_id, best_chunk_id, excerpt, semantic_score`` (0 to 1)."""
    first = Window.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id")
    best = found.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return best.select("document_id", F.col("chunk_id").alias("best_chunk_id"), F.substring("content", 1, EXCERPT).alias("excerpt"), clamped.alias("semantic_score"))


def blend() -> Column:
    return sum((F.col(name) * F.lit(weight) for name, weight in WEIGHTS.items()), F.lit(0.0))


def fallback_reason(semantic: Column, difficulty: Column, tags: Column) -> Column:
    """The reason shown without a model's."""
    # fixed values: the wording
    near = F.concat(F.lit("Nội dung gần với đề tài ("), percent(semantic).cast("string"), F.lit("% tương đồng)"))
    level = F.when(difficulty > 0, F.lit("phù hợp độ khó mục tiêu"))
    about = F.when(F.size(tags) > 0, F.concat(F.lit("liên quan các tag "), F.array_join(F.slice(tags, 1, 3), ", ")))
    return F.concat(F.concat_ws(", ", near, level, about), F.lit("."))


def rank_documents(best: DataFrame, documents: DataFrame, document_tags: DataFrame, project: dict) -> DataFrame:
    """The 8 best documents with all four scores, their blend and the fallback reason.

    ``documents``: ``document_id, title, primary_topic, difficulty, keywords``; ``document_tags``:
    ``document_id, name, normalized_name``; ``project``: ``title, description, keywords,
    target_difficulty``. Topic score is the word overlap of project and document; tag score the share of
    a document's tags that are a project keyword or share a word with the project.
    """
    spark = best.sparkSession
    one = spark.createDataFrame([(project["title"], project["description"], list(project["keywords"]))], "t string, d string, k array<string>")
    said = F.concat_ws(" ", "t", "d", F.array_join("k", " "))
    exploded = one.select(word_set(normalize_tag(said)).alias("project_words"), F.explode_outer("k").alias("w"))
    wanted = exploded.groupBy("project_words").agg(F.collect_set(normalize_tag(F.col("w"))).alias("project_tags"))
    rows = best.join(documents, "document_id").crossJoin(F.broadcast(wanted))  # one project, one row
    doc_words = word_set(normalize_tag(F.concat_ws(" ", F.coalesce("primary_topic", F.lit("")), F.array_join("keywords", " "))))
    target = F.lit(project.get("target_difficulty")).cast("string")
    rows = rows.withColumn("topic_score", overlap(F.col("project_words"), doc_words))
    rows = rows.withColumn("difficulty_score", F.when(F.coalesce(F.col("difficulty") == target, F.lit(False)), 1.0).otherwise(0.0))
    tags = document_tags.join(best.select("document_id"), "document_id", "left_semi").crossJoin(F.broadcast(wanted))
    hit = F.array_contains("project_tags", F.col("normalized_name")) | (overlap(F.col("project_words"), word_set(normalize_tag(F.col("name")))) > 0)
    per_doc = tags.groupBy("document_id").agg(
        F.avg(hit.cast("int")).alias("tag_score"), F.sort_array(F.collect_list("name")).alias("tags")
    )
    rows = rows.join(per_doc, "document_id", "left").withColumn("tag_score", F.coalesce("tag_score", F.lit(0.0)))
    rows = rows.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("score", blend())
    rows = rows.withColumn("reason", fallback_reason(F.col("semantic_score"), F.col("difficulty_score"), F.col("tags")))
    return rows.drop("project_words", "project_tags").orderBy(F.desc("score"), "document_id").limit(RESULTS)


def with_reasons(ranked: DataFrame, reasons: DataFrame | None) -> DataFrame:
    """A model's reasons (``document_id, model_reason``) where there are any, else the fallback."""
    if reasons is None:
        return ranked
    return ranked.join(reasons, "document_id", "left").withColumn("reason", F.coalesce("model_reason", "reason")).drop("model_reason")
