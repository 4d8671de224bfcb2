"""Processing states: what is missing, what to run next, and what a failure means for later stages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexframe.functions.text import round_half_up
from codexframe.schemas import JOB_TYPE

# fixed values: messages on stages that can't run after an earlier one failed
SKIPPED = {
    ("EXTRACT_TEXT", "CHUNK_DOCUMENT"): "Không thể chunk vì bước trích xuất thất bại",
    ("EXTRACT_TEXT", "EMBED_DOCUMENT"): "Không thể embed vì bước trích xuất thất bại",
    ("EXTRACT_TEXT", "ANALYZE_DOCUMENT"): "Không thể phân tích vì bước trích xuất thất bại",
    ("CHUNK_DOCUMENT", "EMBED_DOCUMENT"): "Không thể embed vì bước chunking thất bại",
    ("CHUNK_DOCUMENT", "ANALYZE_DOCUMENT"): "Không thể phân tích vì bước chunking thất bại",
    ("EMBED_DOCUMENT", "ANALYZE_DOCUMENT"): "Không thể phân tích vì bước embedding thất bại",
}


def chunk_state(documents: DataFrame, chunks: DataFrame, id_col: str = "document_id") -> DataFrame:
    """``documents`` with ``n_chunks`` and ``n_missing`` (chunks without a vector)."""
    counts = chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("embedding").isNull()).alias("n_missing"))
    joined = documents.join(counts, id_col, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_chunks", "n_missing")})


def resume_stages(active: Column, text: Column, n_chunks: Column, n_missing: Column, complete: Column) -> Column:
    """Stages to run again, in order; null if a job is active or nothing is missing (a conflict)."""
    stages = lambda *names: F.array(*[F.lit(x) for x in names])
    return (
        F.when(active, F.lit(None).cast("array<string>"))
        .when((F.coalesce(text, F.lit("")) == "") | (n_chunks == 0), stages(*JOB_TYPE))
        .when((n_missing > 0) & complete, stages("EMBED_DOCUMENT"))
        .when(n_missing > 0, stages("EMBED_DOCUMENT", "ANALYZE_DOCUMENT"))
        .when(~complete, stages("ANALYZE_DOCUMENT"))
    )


def needs_processing(text: Column, n_chunks: Column, n_missing: Column, complete: Column) -> Column:
    return (F.coalesce(text, F.lit("")) == "") | (n_chunks == 0) | (n_missing > 0) | ~complete


def latest_jobs(jobs: DataFrame, by: list[str], time: str = "created_at", key: str = "id") -> DataFrame:
    """The newest job of each group."""
    place = Window.partitionBy(*by).orderBy(F.desc(time), F.desc(key))
    return jobs.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def fail_cascade(failures: DataFrame) -> DataFrame:
    """``document_id, failed_stage, message`` to the failed jobs of each document and its status.

    Rows ``document_id, type, status, error_message, document_status``: the stage itself and all later
    ones. The document is FAILED if extraction failed, EXTRACTED if a later stage did before any vector,
    READY if only the analysis failed.
    """
    order = {name: i for i, name in enumerate(JOB_TYPE)}
    place = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("failed_stage"))
    later = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("type")) for name, i in order.items()]), lambda x: x["i"] >= place)
    rows = failures.select("document_id", "failed_stage", "message", F.explode(later).alias("s"))
    said = F.create_map(*[F.lit(x) for (a, b), text in SKIPPED.items() for x in (f"{a}>{b}", text)])
    error = F.when(F.col("s.type") == F.col("failed_stage"), F.substring("message", 1, 500)).otherwise(
        F.element_at(said, F.concat("failed_stage", F.lit(">"), F.col("s.type")))
    )
    status = F.when(F.col("failed_stage") == "EXTRACT_TEXT", "FAILED").when(F.col("failed_stage") == "ANALYZE_DOCUMENT", "READY").otherwise("EXTRACTED")
    return rows.select("document_id", F.col("s.type").alias("type"), F.lit("FAILED").alias("status"), error.alias("error_message"), status.alias("document_status"))


def progress(done: Column, total: Column) -> Column:
    """Percent of a running stage, 99 at most."""
    return F.least(F.lit(99), round_half_up(done / total * 100)).cast("int")


def resumable(jobs: DataFrame, documents: DataFrame, job_type: str = "EMBED_DOCUMENT") -> DataFrame:
    """Unfinished jobs of a type, oldest first, with their document's title."""
    open_jobs = jobs.where((F.col("type") == job_type) & F.col("status").isin("PENDING", "PROCESSING"))
    return open_jobs.join(documents.select("document_id", "title"), "document_id", "left").orderBy("created_at", "id")


def run_pipeline(files: DataFrame, embedder, dim: int) -> dict[str, DataFrame]:
    """Files (``path, length, content``) through all stages up to vectors: ``documents, chunks, jobs, rejected``.

    A document's status follows from what it has: FAILED without text, EXTRACTED with a chunk too long to embed, READY with all vectors. Each stage
    is one DataFrame step over what the stage before left; nothing is updated in place.
    """
    from codexframe.functions.chunking import chunk_sections
    from codexframe.operators.embedding import MOST_CHARS, embed_missing
    from codexframe.sources.files import extract_files, intake

    judged = intake(files)
    accepted = judged.where("reject is null")
    found = extract_files(accepted.withColumn("document_id", F.sha2("path", 256)), "document_id").withColumnRenamed("id", "document_id")
    good = found.where("error is null")
    chunks = chunk_sections(good, "document_id").withColumn("embedding", F.lit(None).cast("array<float>"))
    long = F.length("content") > MOST_CHARS  # never reaches the model; its document alone fails
    stuck = chunks.where(long).groupBy("document_id").agg(F.lit(f"a chunk has more than {MOST_CHARS} characters").alias("stuck"))
    chunks = embed_missing(chunks, embedder, dim, F.when(~long, F.col("content")))
    chunks = chunks.withColumn("id", F.concat_ws(":", "document_id", "chunk_index"))
    named = accepted.select(F.sha2("path", 256).alias("document_id"), "path", "title", "file_type", F.col("length").alias("file_size"))
    documents = named.join(found.select("document_id", "text", "error"), "document_id", "left").join(stuck, "document_id", "left")
    status = F.when(F.col("error").isNotNull(), "FAILED").when(F.col("stuck").isNotNull(), "EXTRACTED").otherwise("READY")
    documents = documents.withColumn("status", status).withColumn("error", F.coalesce("error", "stuck")).drop("stuck")
    failures = found.where("error is not null").select("document_id", F.lit("EXTRACT_TEXT").alias("failed_stage"), F.col("error").alias("message"))
    failures = failures.unionByName(stuck.select("document_id", F.lit(JOB_TYPE[2]).alias("failed_stage"), F.col("stuck").alias("message")))
    stages = [F.array(*[F.lit(x) for x in JOB_TYPE[:n]]) for n in (2, 3)]
    done = F.when(F.col("stuck").isNotNull(), stages[0]).otherwise(stages[1])
    finished = good.join(stuck, "document_id", "left").select("document_id", F.explode(done).alias("type"), F.lit("COMPLETED").alias("status"))
    jobs = fail_cascade(failures).select("document_id", "type", "status", "error_message").unionByName(
        finished.withColumn("error_message", F.lit(None).cast("string"))
    )
    return {"documents": documents, "chunks": chunks, "jobs": jobs, "rejected": judged.where("reject is not null").drop("content")}


def analyze(documents: DataFrame, chat, id_col: str = "document_id", text_col: str = "text", longest: int = 100_000) -> DataFrame:
    """Analyses of documents by an injected model (``chat(prompt) -> reply``): parsed, checked, distinct lists.

    ``id, analysis, violations, error``; a failed call or an invalid reply is a row with its reason and
    leaves the document READY. A document without text is an error and never reaches the model.
    """
    from codexframe.functions.replies import analysis_violations, json_object
    from codexframe.functions.text import distinct_trimmed

    @F.pandas_udf("struct<reply:string,error:string>")
    def ask(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            if not text:
                out.append((None, "no text to analyze"))
                continue
            try:
                out.append((chat(text), None))
            except Exception as problem:  # the model's failure is data here
                out.append((None, f"AI: {problem}"[:500]))
        return pd.DataFrame(out, columns=["reply", "error"])

    asked = documents.select(F.col(id_col).alias("id"), ask(F.substring(F.col(text_col), 1, longest)).alias("a"))
    parsed = asked.select("id", json_object(F.col("a.reply")).alias("analysis"), F.col("a.error").alias("error"))
    lists = parsed.withColumn(
        "analysis",
        F.when(
            F.col("analysis").isNotNull(),
            F.col("analysis").withField("subtopics", distinct_trimmed(F.col("analysis.subtopics"))).withField("keywords", distinct_trimmed(F.col("analysis.keywords"))),
        ),
    )
    return lists.withColumn("violations", analysis_violations(F.col("analysis")))


def document_status(text: Column, n_chunks: Column, n_missing: Column, extracting_failed: Column, analysis_running: Column) -> Column:
    """A document's status from what it has: READY comes with the last vector, before any analysis, and stays
    READY when an analysis fails."""
    ready = (n_chunks > 0) & (n_missing == 0)
    return (
        F.when(extracting_failed, "FAILED")
        .when(ready & analysis_running, "ANALYZING")
        .when(ready, "READY")
        .when(F.coalesce(text, F.lit("")) != "", "EXTRACTED")
        .otherwise("UPLOADED")
    )
