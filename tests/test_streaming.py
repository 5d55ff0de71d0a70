from pyspark.sql import functions as F

from tempo.functions import windows as W
from tempo.operators.policy import PolicyConfig, apply_policy
from tempo.sources.panel import shipment_panel
from tempo.streaming.policy_stream import hourly_panel, stream_decisions


def test_stream_decides_like_the_batch(spark, sf, tmp_path):
    panel = shipment_panel(spark.read.parquet(f"{sf}/lineitem.parquet"))
    scores = panel.select("iso", "quote_date", "available_on", (1 - W.rolling_rank("rub_per_unit", 90, 20)).alias("score")).filter("score is not null").cache()
    config = PolicyConfig(cooldown_observations=1)
    for n, (low, high) in enumerate((("1990-01-01", "1997-01-01"), ("1997-01-01", "1999-01-01"), ("1999-01-01", "2010-01-01"))):
        scores.filter((F.col("quote_date") >= low) & (F.col("quote_date") < high)).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = stream_decisions(stream, config).writeStream.format("memory").queryName("decisions").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.iso, r.quote_date): r.decision_reason for r in spark.table("decisions").collect()}
    want = {(r.iso, r.quote_date): r.decision_reason for r in apply_policy(scores, config).collect()}
    assert got == want and len(got) > 500


def test_hourly_panel(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    query = hourly_panel(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("hours").agg(F.sum("nominal")).first()[0] == events.count()
