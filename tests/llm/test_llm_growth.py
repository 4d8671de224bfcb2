"""Steps whose memory or disk must not outgrow the input."""

from __future__ import annotations

from codexframe.llm import common, simhash


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_crowd_links_never_send_their_variants_through_the_driver(spark):
    fps = common.materialize(spark.range(200).selectExpr("id * 7919 as fp"), "fps")
    shown = plan(simhash.leader_links(fps))
    assert "SortMergeJoin [k" in shown and "BroadcastHashJoin [k" not in shown


def test_links_never_send_their_variants_through_the_driver(spark):
    fps = common.materialize(spark.range(200).selectExpr("id * 7919 as fp"), "fps")
    shown = plan(simhash.links(fps))
    assert "SortMergeJoin [k" in shown and "BroadcastHashJoin [k" not in shown


def test_toxicity_shuffles_the_texts_of_its_sample_alone(spark, tmp_path, monkeypatch):
    import random

    from codexframe.llm import queries, toxicity

    dice = random.Random(7)
    docs = [(k, " ".join(f"{dice.getrandbits(64):x}" for _ in range(600))) for k in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k, _ in docs], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", sum(len(t) for _, t in docs) // 20)
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        return sum(stage.shuffleWriteBytes() for stage in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))

    sent, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        queries.op7_instance_toxicity(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    assert written() - before < sum(len(t) for _, t in docs) / 5
