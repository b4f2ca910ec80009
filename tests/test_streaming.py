"""Incremental buckets equal the batch result."""

from faultloom.operators.buckets import exact_buckets
from faultloom.streaming import incremental as inc


def test_stream_equals_batch(spark, data, tmp_path):
    cards = spark.read.parquet(f"{data}/crash_cards.parquet").select("card_id", "cluster_key", "case_id", "big_bucket", "ingested_at")
    cards.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "card_id long, cluster_key string, case_id string, big_bucket string, ingested_at timestamp"
    stream = inc.card_stream(spark, str(tmp_path / "in"), schema, 1)
    inc.maintain_buckets(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = {(r["cluster_key"], r["size"], r["first_case"]) for r in exact_buckets(cards).collect()}
    assert {(r["cluster_key"], r["size"], r["first_case"]) for r in inc.current_buckets(spark, str(tmp_path / "out")).collect()} == want


def test_windows_and_repeated_deliveries(spark, data, tmp_path):
    cards = spark.read.parquet(f"{data}/crash_cards.parquet").select("card_id", "cluster_key", "case_id", "big_bucket", "ingested_at")
    cards.unionByName(cards).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "card_id long, cluster_key string, case_id string, big_bucket string, ingested_at timestamp"
    stream = inc.first_deliveries(inc.card_stream(spark, str(tmp_path / "in"), schema), delay="4000 days")
    q = inc.windowed_counts(stream, delay=None).writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
