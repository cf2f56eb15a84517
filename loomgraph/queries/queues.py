"""Queue and window queries over ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.operators import commits
from loomgraph.plans.shared import ensure_checkpoint_dir, table
from loomgraph.queries.registry import query
from loomgraph.streaming import leases

NOW = "2024-01-15 00:00:00"


def queue(spark, sf_dir):
    """Events as work: errors are done, purchases are claimed at their time, the rest is free."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(kind == "error", "done").otherwise("pending").alias("status"),
        F.when(kind == "purchase", F.lit("old")).alias("token"),
        F.when(kind == "purchase", F.col("ts").cast("timestamp")).alias("claimed_at"),
        (F.col("event_id") % 4).cast("int").alias("attempts"),
        F.col("user_id").alias("user"),
        F.col("value"),
    )


def now():
    return F.to_timestamp(F.lit(NOW))


@query(f"""WITH q AS (SELECT event_id AS id, value, event_type = 'error' AS done, CASE WHEN event_type = 'purchase' THEN ts END AS c FROM events)
  SELECT id FROM q WHERE NOT done AND (c IS NULL OR c < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND) ORDER BY value DESC, id LIMIT 50""")
def lease_claim(spark, sf_dir):
    """The fifty rows that a claim by value gets."""
    after = leases.claim(queue(spark, sf_dir), "mine", now(), 50, 300, [F.desc("value"), F.col("id")])
    return after.where("token = 'mine'").select("id")


@query(f"""WITH q AS (SELECT event_id AS id, value, event_type = 'error' AS done, CASE WHEN event_type = 'purchase' THEN ts END AS c FROM events)
  SELECT id, CASE WHEN place <= 40 THEN 'a' ELSE 'b' END AS token FROM (SELECT id, row_number() OVER (ORDER BY value DESC, id) AS place FROM q WHERE NOT done AND (c IS NULL OR c < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND)) WHERE place <= 80""")
def atomic_claims(spark, sf_dir):
    """Two claims of forty rows each, one after the other, on a queue kept in a folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/queue-{uuid.uuid4().hex}"
    commits.begin(queue(spark, sf_dir), folder)
    for token in "ab":
        leases.claim_atomically(spark, folder, token, now(), 40, 300, [F.desc("value"), F.col("id")])
    return commits.current(spark, folder).where(F.col("token").isin("a", "b")).select("id", "token")


@query("""SELECT 'orders' AS name, l_orderkey AS a, min(l_suppkey) AS b FROM lineitem GROUP BY 2 UNION ALL SELECT 'parts', l_partkey, count(*) FROM lineitem GROUP BY 2
  UNION ALL SELECT 'supplies', l_suppkey, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def published_scan(spark, sf_dir):
    """A scan's rows fanned out to tables of entities and links, published at once and read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/scan-{uuid.uuid4().hex}"
    scan = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    tables = commits.scan_tables(scan, {"orders": ("l_orderkey", ["l_suppkey"]), "parts": ("l_partkey", [])}, {"supplies": ("l_suppkey", "l_partkey")})
    commits.write_tables(spark, folder, tables)
    read = {name: commits.read_table(spark, folder, name) for name in tables}
    rows = [read[n].select(F.lit(n).alias("name"), F.col(a).alias("a"), F.col(b).alias("b")) for n, a, b in (("orders", "id", "l_suppkey"), ("parts", "id", "n"), ("supplies", "src", "dst"))]
    return rows[0].union(rows[1]).union(rows[2])


@query(f"""SELECT event_id AS id, CASE WHEN event_type = 'purchase' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 300 SECOND AND ts <= TIMESTAMP '{NOW}' THEN 'old' END AS token FROM events""")
def reset_stale_claims(spark, sf_dir):
    return leases.reset_stale(queue(spark, sf_dir), now(), 300).select("id", "token")


@query("""SELECT event_id AS id, CASE WHEN event_type = 'purchase' AND event_id % 4 + 1 >= 3 THEN 'failed' WHEN event_type = 'error' THEN 'done' ELSE 'pending' END AS status,
  (event_id % 4 + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::INT AS attempts FROM events""")
def mark_failed(spark, sf_dir):
    return leases.mark_failed(queue(spark, sf_dir), "old", 3).select("id", "status", "attempts")


@query("""WITH g AS (SELECT user_id, count(*) AS n, round(max(value), 2) AS cost FROM events GROUP BY 1) SELECT event_id AS id, round(cost / n, 8) AS cost FROM events JOIN g USING (user_id)""")
def shared_enrichment_cost(spark, sf_dir):
    members = queue(spark, sf_dir).select("id", "user")
    costs = queue(spark, sf_dir).groupBy("user").agg(F.round(F.max("value"), 2).alias("cost"))
    return leases.share_cost(members, costs, "user", "cost").select("id", F.round("cost", 8).alias("cost"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def hourly_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = leases.windowed_counts(events, "ts", ["event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
