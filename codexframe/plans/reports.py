"""Reports and list pages over the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexframe.sources.scratch import key_join, written


def dashboard(documents: DataFrame, n_projects: DataFrame) -> DataFrame:
    """``total, extracted, projects`` in one pass over the documents."""
    counts = documents.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("EXTRACTED", "READY")).alias("extracted"))
    return counts.crossJoin(n_projects.agg(F.count(F.lit(1)).alias("projects")))  # one row each


def latest(rows: DataFrame, n: int, time: str = "created_at", key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(time), F.desc(key)).limit(n)


def coverage(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document with chunks: chunks, located ones, embedded ones."""
    counts = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count("source_label").alias("located"), F.count("embedding").alias("embedded")
    )
    return documents.join(counts, "document_id").select("document_id", "title", "chunks", "located", "embedded")


def throughput(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks per second: all embedded chunks over the seconds of the newest completed embedding job.

    The two sides don't match, one job against all documents; that is how the report is defined.
    """
    done = jobs.where("type = 'EMBED_DOCUMENT' and status = 'COMPLETED' and started_at is not null and finished_at is not null")
    newest = done.agg(F.max(F.struct("finished_at", "id", "started_at")).alias("j"))
    seconds = (F.unix_micros(F.col("j.finished_at").cast("timestamp")) - F.unix_micros(F.col("j.started_at").cast("timestamp"))) / 1e6
    n = chunks.agg(F.count("embedding").alias("embedded"))
    joined = newest.select(seconds.alias("seconds")).crossJoin(n)
    return joined.withColumn("chunks_per_second", F.when(F.col("seconds") > 0, F.col("embedded") / F.col("seconds")))


def document_detail(documents: DataFrame, jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their jobs in order of creation and the state of their chunks."""
    from codexframe.plans.jobs import chunk_state

    steps = jobs.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "id", "type", "status"))).alias("jobs"))
    return chunk_state(documents, chunks).join(steps, "document_id", "left")


def document_page(documents: DataFrame, jobs: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """One row a request of ``asked`` (``document_id, chunk_id``): the document's detail and the chunk that a search matched.

    ``matched`` is that chunk if it is the document's own, else null, as for a request without a chunk.
    Requests for documents that don't exist have no row. However many requests name one document, its
    detail is worked out once and no task gathers them.
    """
    own = chunks.select("document_id", F.col("id").alias("chunk_id"), F.struct(*[c for c in chunks.columns if c not in ("document_id", "embedding")]).alias("matched"))
    times = asked.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    details = document_detail(documents, jobs, chunks)
    return key_join(asked.join(own, ["document_id", "chunk_id"], "left"), written(details.join(times, "document_id"), "details"), ["document_id"])


def tag_list(tags: DataFrame, aliases: DataFrame, document_tags: DataFrame) -> DataFrame:
    """Tags by name with how many aliases and documents they have."""
    n_aliases = aliases.groupBy(F.col("tag_id").alias("id")).agg(F.count(F.lit(1)).alias("aliases"))
    n_documents = document_tags.groupBy(F.col("tag_id").alias("id")).agg(F.count(F.lit(1)).alias("documents"))
    joined = tags.join(n_aliases, "id", "left").join(n_documents, "id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("aliases", "documents")}).orderBy("name", "id")


def document_list(documents: DataFrame, owner: object) -> DataFrame:
    """The owner's documents, newest first, without their text."""
    mine = documents.where(F.col("user_id") == owner)
    return mine.select("id", "title", "file_type", "file_size", "status", "created_at").orderBy(F.desc("created_at"), F.desc("id"))


def project_list(projects: DataFrame, recommendations: DataFrame, owner: object) -> DataFrame:
    """The owner's projects, last changed first, with how many recommendations they have."""
    counts = recommendations.groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("recommendations"))
    joined = projects.where(F.col("user_id") == owner).join(counts, "id", "left")
    return joined.withColumn("recommendations", F.coalesce("recommendations", F.lit(0))).orderBy(F.desc("updated_at"), "id")


def project_detail(projects: DataFrame, recommendations: DataFrame, documents: DataFrame) -> DataFrame:
    """Each project with its recommendations by score, each with its document's title."""
    titled = recommendations.join(documents.select(F.col("id").alias("document_id"), "title"), "document_id")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("__o"), "document_id", "title", "score", "reason")))
    lists = titled.groupBy(F.col("project_id").alias("id")).agg(F.transform(ordered, lambda r: r.dropFields("__o")).alias("recommendations"))
    return projects.join(lists, "id", "left")


def pending_reviews(reviews: DataFrame, tags: DataFrame, documents: DataFrame, owner: object) -> DataFrame:
    """The owner's open reviews, oldest first, with the suggested tag's name and the document's title, if it still exists."""
    mine = reviews.where((F.col("user_id") == owner) & (F.col("status") == "PENDING"))
    named = mine.join(tags.select(F.col("id").alias("suggested_tag_id"), F.col("name").alias("suggested_name")), "suggested_tag_id", "left")
    titled = named.join(documents.select(F.col("id").alias("document_id"), "title"), "document_id", "left")
    return titled.orderBy("created_at", "id")


def provider_list(providers: DataFrame, owner: object) -> DataFrame:
    """The owner's providers, the active one first, then the newest, without secrets."""
    from codexframe.functions.providers import public_columns

    mine = providers.where(F.col("user_id") == owner)
    return mine.select(*public_columns(mine)).orderBy(F.desc("is_active"), F.desc("created_at"), "id")
