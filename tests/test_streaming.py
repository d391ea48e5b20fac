"""Streams against their batch twins."""

from pyspark.sql import functions as F

from quadloom.plans import sessions as twin
from quadloom.sources.graphs import event_graph
from quadloom.streaming import sessions


def test_attention_follows_its_batch_twin(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 6")
    rows = events.select(F.concat(F.lit("u:"), "user_id").alias("session"), "ts", "event_id", F.concat(F.lit("k:"), F.regexp_extract("props", '"k": *([0-9]+)', 1)).alias("concept"))
    ordered = rows.orderBy("ts", "event_id")
    at = ordered.limit(rows.count() // 2).agg(F.max("ts")).first()[0]
    rows.where(F.col("ts") <= at).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = sessions.attention(stream).writeStream.outputMode("update").format("memory").queryName("attention_stream").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    rows.where(F.col("ts") > at).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM attention_stream").collect()
    last = {}
    for r in out:
        last[r.session] = max(last.get(r.session, -1), r.turn)
    got = {(r.session, r.concept, r.attention) for r in out if r.turn == last[r.session]}
    want = {(r.graph_id, r.concept, r.attention) for r in twin.attention(spark, sf).where("graph_id < 'u:6' AND length(graph_id) = 3").collect()}
    assert got == want and got


def test_first_uses(spark, sf, tmp_path):
    acts = event_graph(spark, sf).select("graph_id", "o").distinct()
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit("u:"), "user_id").alias("session"), "ts", F.concat(F.lit("k:"), F.regexp_extract("props", '"k": *([0-9]+)', 1)).alias("concept"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = sessions.first_uses(stream, "400 days").writeStream.format("memory").queryName("first_uses").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT session, concept FROM first_uses").count() == acts.count()
