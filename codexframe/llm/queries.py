"""One query for each training-data operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexframe.llm import alignment, ann, codes, langid, linededup, mixing, packing, pii, quality, simhash, tokencount, toxicity, urlfilter
from codexframe.llm.common import materialize
from codexframe.llm.oracles import ORACLES

#: The URL query's rules.
URL_RULES = [
    urlfilter.parse_rule("block", "com/en/"),
    urlfilter.parse_rule("allow", "example.com/en/7"),
    urlfilter.parse_rule("allow", "net/de/"),
    urlfilter.parse_rule("block", "example.net/de/8"),
    urlfilter.parse_rule("block", "org/es/"),
]
#: The PII query's key; a real corpus takes its own from a secret store.
PII_KEY = b"codexframe demonstration key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(by: int, id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % by


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all."""
    found = ann.nearest(_table(spark, sf_dir, "embeddings"), "id % 20 = 0", k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 1024."""
    return packing.pack_documents(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labelled ones."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _remainder(4) == 2)
    profiles = materialize(langid.learn(docs.where("not held_out")), "profiles")
    return langid.identify(docs, profiles).select(
        F.col("id").alias("doc_id"), (_remainder(4, "id") == 2).alias("held_out"), "lang_pred", "score"
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    scored = quality.score(_table(spark, sf_dir, "documents"))
    return scored.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept"
    )


def op5_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page."""
    judged = urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how much of it there was."""
    done = pii.pseudonymize(_table(spark, sf_dir, "documents"), PII_KEY)
    return done.select(F.col("id").alias("doc_id"), "text", F.size("spans").cast("long").alias("n_replaced"))


def op7_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(_remainder(5) != 0)
    model = toxicity.fit(docs.withColumn("chars", F.length("text")).join(labels, "doc_id"), chars_col="chars")
    scored = toxicity.score(docs, model)
    return scored.select(
        F.col("id").alias("doc_id"),
        (_remainder(5, "id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        F.size("offending").cast("long").alias("n_offending"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    classes = simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)
    hex16 = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return classes.select(F.col("id").alias("doc_id"), hex16.alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source, and how many it lost."""
    cleaned = linededup.drop_boilerplate(_table(spark, sf_dir, "documents"), ratio=0.1, min_pages=3, count_col="n_dropped")
    return cleaned.select("doc_id", "source", "text", "n_dropped")


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, in training order; documents that it doesn't reach come last.

    ``position`` is the training position of the document's first reading; ``op10_training_positions`` has all of them.
    """
    read = mixing.readings(_mix(spark, sf_dir), most=3.0)
    taken = F.aggregate("readings", F.lit(0).cast("long"), lambda sum, r: sum + r["take"])
    place = F.get(F.col("readings"), F.lit(0))["position"]
    rows = read.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), place.alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op10_training_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of a document that the mix takes, with its training position, in that order."""
    return mixing.positions(_mix(spark, sf_dir), most=3.0).withColumnRenamed("id", "doc_id")


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.plan(docs, cycle=(1, 2, 3), most=3.0, schedule=mixing.curriculum(docs))


def op11_elementary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two public tokenizers overlap in every document."""
    found = alignment.align(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_products")


def op12_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and how many of its pre-tokens needed no merging."""
    found = tokencount.count_tokens(_table(spark, sf_dir, "documents"), path=tokencount.public_file("byte_bpe_50k.json"), limit=1024)
    return found.withColumnRenamed("id", "doc_id")


def op13_vantage_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every vector under codebooks that all vectors moved."""
    found = codes.compress(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_learned_partitions": op1_learned_partitions,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_rank_order_language": op3_rank_order_language,
        "op4_quality_rules": op4_quality_rules,
        "op5_redirect_equivalence": op5_redirect_equivalence,
        "op6_feistel_pseudonyms": op6_feistel_pseudonyms,
        "op7_instance_toxicity": op7_instance_toxicity,
        "op8_simhash": op8_simhash,
        "op9_line_dedup": op9_line_dedup,
        "op10_curriculum_mix": op10_curriculum_mix,
        "op10_training_positions": op10_training_positions,
        "op11_elementary_intervals": op11_elementary_intervals,
        "op12_whole_tokens": op12_whole_tokens,
        "op13_vantage_codes": op13_vantage_codes,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
