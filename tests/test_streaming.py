"""Leases in batch form and on a stream."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomgraph.streaming import leases

QUEUE = "id long, status string, token string, claimed_at timestamp, attempts int, cluster string, domain string"


def queue(spark):
    at = datetime(2024, 1, 1)
    rows = [
        (1, "pending", None, None, 0, "c1", "d1"),
        (2, "pending", "old", at, 2, "c1", "d1"),
        (3, "pending", "late", at + timedelta(hours=1), 0, None, "d1"),
        (4, "done", None, None, 0, "c2", "d2"),
        (5, "pending", "soon", at + timedelta(days=9), 0, "c2", "d2"),
    ]
    return spark.createDataFrame(rows, QUEUE)


def now():
    return F.to_timestamp(F.lit("2024-01-01 01:01:00"))


def test_claims_take_free_rows_once(spark):
    out = {r["id"]: r["token"] for r in leases.claim(queue(spark), "new", now(), 10, 300).collect()}
    assert out == {1: "new", 2: "new", 3: "late", 4: None, 5: "soon"}
    assert leases.claim(queue(spark), "new", now(), 1, 300).where("token = 'new'").count() == 1
    assert leases.claim(queue(spark).limit(0), "new", now(), 1, 300).count() == 0


def test_group_claim_stays_in_the_group(spark):
    rows = queue(spark).withColumn("claimed_at", F.lit(None).cast("timestamp")).where("status = 'pending'")
    out = leases.claim_group(rows, "new", now(), 10, 300, ["cluster", "domain"]).where("token = 'new'")
    assert out.select("domain").distinct().count() == 1


def test_stale_and_future_claims_are_reset(spark):
    out = {r["id"]: r["token"] for r in leases.reset_stale(queue(spark), now(), 300).collect()}
    assert out == {1: None, 2: None, 3: "late", 4: None, 5: None}


def test_failures_count_and_end(spark):
    out = {r["id"]: (r["attempts"], r["status"], r["token"]) for r in leases.mark_failed(queue(spark), "old", 3).collect()}
    assert out[2] == (3, "failed", None) and out[3] == (0, "pending", "late")
    kept = {r["id"]: r["token"] for r in leases.release(queue(spark), spark.createDataFrame([(2,), (3,)], "id long"), "old").collect()}
    assert kept[2] is None and kept[3] == "late"


def test_cost_is_split_evenly(spark):
    members = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, g string")
    out = {r["id"]: r["cost"] for r in leases.share_cost(members, spark.createDataFrame([("a", 3.0)], "g string, cost double"), "g", "cost").collect()}
    assert out == {1: 1.5, 2: 1.5, 3: None, 4: None}


def test_first_claim_on_a_stream_wins(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 5)], "id long, token string, at long").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("id long, token string, at long").json(str(source))
    run = leases.stream_leases(stream, 600).writeStream.format("memory").queryName("granted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r["id"], r["token"], r["event"]) for r in spark.table("granted").collect()) == [(1, "a", "granted"), (2, "c", "granted")]
    assert all(r["expires_ms"] > time.time() * 1000 for r in spark.table("granted").collect())


def test_stream_upsert_keeps_the_latest(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "id long, v string, at long"
    spark.createDataFrame([(1, "x", 1), (1, "y", 3), (2, "z", 1)], schema).coalesce(1).write.json(str(source))
    stream = spark.readStream.schema(schema).json(str(source))
    leases.latest_stream_upsert(stream, str(out), str(tmp_path / "cp"), ["id"], "at").awaitTermination(120)
    assert sorted(tuple(r) for r in leases.current_snapshot(spark, str(out)).select("id", "v").collect()) == [(1, "y"), (2, "z")]
    more = [[(1, "w", 2), (3, "n", 1)], [(3, "m", 2)], [(3, "l", 3)]]
    for rows in more:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        leases.latest_stream_upsert(spark.readStream.schema(schema).json(str(source)), str(out), str(tmp_path / "cp"), ["id"], "at").awaitTermination(120)
    assert sorted(tuple(r) for r in leases.current_snapshot(spark, str(out)).select("id", "v").collect()) == [(1, "y"), (2, "z"), (3, "l")]
    versions = {p.name for p in out.glob("version=*/bucket=*")}
    assert len(list(out.glob("version=*/bucket=*"))) <= 2 * len(versions)
