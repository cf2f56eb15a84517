"""Work queues with leases, as batch transforms of a queue table and as a stream.

A row is free if it is unclaimed or its claim is older than the time allowed. A claim picks rows by priority and a
hash of a seed; a claim holds only where a later read still finds its token.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.operators import commits
from loomgraph.plans.shared import cut

STATUS = ("pending", "claimed", "done", "failed")


def is_free(claimed_at: Column, now: Column, seconds: int) -> Column:
    """Unclaimed, or claimed longer ago than ``seconds``."""
    return claimed_at.isNull() | (claimed_at < now - F.make_dt_interval(secs=F.lit(seconds)))


def claim(queue: DataFrame, token: str, now: Column, n: int, seconds: int, order: Sequence[Column] = (), seed: str = "0") -> DataFrame:
    """The queue after a claim of at most ``n`` free pending rows, by order and then a hash of seed and id.

    Only the ids of the claimed rows are gathered: at most ``n`` rows.
    """
    free = queue.where((F.col("status") == "pending") & is_free(F.col("claimed_at"), now, seconds))
    draw = F.xxhash64(F.lit(seed), F.col("id"))
    picked = free.orderBy(*order, draw, "id").limit(n).select("id", F.lit(token).alias("new_token"))
    out = queue.join(F.broadcast(picked), "id", "left")  # at most n rows
    hit = F.col("new_token").isNotNull()
    return out.withColumns({"token": F.when(hit, F.col("new_token")).otherwise(F.col("token")), "claimed_at": F.when(hit, now).otherwise(F.col("claimed_at"))}).drop("new_token")


def claim_group(queue: DataFrame, token: str, now: Column, n: int, seconds: int, group: Sequence[str]) -> DataFrame:
    """Claim a first row and then others that share its first non-null group column, up to ``n``.

    ``group`` lists columns from the narrowest to the widest.
    """
    free = queue.where((F.col("status") == "pending") & is_free(F.col("claimed_at"), now, seconds))
    first = free.orderBy(F.xxhash64("id"), "id").limit(1).select(F.col("id").alias("first_id"), *[F.col(g).alias(f"first_{g}") for g in group])
    near = F.when(F.col("id") == F.col("first_id"), 0)
    for k, g in enumerate(group):
        near = near.when(F.col(f"first_{g}").isNotNull() & (F.col(g) == F.col(f"first_{g}")), k + 1)
    ranked = free.crossJoin(F.broadcast(first)).withColumn("near", near).where(F.col("near").isNotNull())  # one row
    picked = ranked.orderBy("near", "id").limit(n).select("id", F.lit(token).alias("new_token"))
    out = queue.join(F.broadcast(picked), "id", "left")
    hit = F.col("new_token").isNotNull()
    return out.withColumns({"token": F.when(hit, F.col("new_token")).otherwise(F.col("token")), "claimed_at": F.when(hit, now).otherwise(F.col("claimed_at"))}).drop("new_token")


def claim_atomically(spark: SparkSession, folder: str, token: str, now: Column, n: int, seconds: int, order: Sequence[Column] = (), group: Sequence[str] = ()) -> DataFrame:
    """Claim rows of a queue kept in a folder (see ``commits``) and read them back: two claimers never hold the same row.

    With ``group`` the rows after the first one share its first non-null group column. A claimer that was overtaken picks again among
    what is still free.
    """

    def picked(queue: DataFrame) -> DataFrame:
        queue = cut(queue)
        after = claim_group(queue, token, now, n, seconds, group) if group else claim(queue, token, now, n, seconds, order)
        return after.where(F.col("token") == token).join(queue.where(F.col("token") == token).select("id"), "id", "left_anti")

    commits.transact(spark, folder, picked)
    return commits.current(spark, folder).where(F.col("token") == token)


def reset_stale(queue: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Claims older than allowed, or from the future, are freed."""
    stale = F.col("claimed_at").isNotNull() & (is_free(F.col("claimed_at"), now, seconds) | (F.col("claimed_at") > now))
    return queue.withColumns({"claimed_at": F.when(~stale, F.col("claimed_at")), "token": F.when(~stale, F.col("token"))})


def release(queue: DataFrame, ids: DataFrame, token: str) -> DataFrame:
    """The queue without the claims of ``token`` on some ids."""
    hit = queue.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    mine = F.coalesce("hit", F.lit(False)) & (F.col("token") == token)
    return hit.withColumns({"claimed_at": F.when(~mine, F.col("claimed_at")), "token": F.when(~mine, F.col("token"))}).drop("hit")


def mark_failed(queue: DataFrame, token: str, most_attempts: int) -> DataFrame:
    """One more attempt for the rows of a claim; failed for good once there were ``most_attempts``."""
    mine = F.col("token").eqNullSafe(F.lit(token))
    attempts = F.col("attempts") + F.when(mine, 1).otherwise(0)
    status = F.when(mine & (attempts >= most_attempts), "failed").otherwise(F.col("status"))
    return queue.withColumns({"attempts": attempts, "status": status, "claimed_at": F.when(~mine, F.col("claimed_at")), "token": F.when(~mine, F.col("token"))})


def share_cost(members: DataFrame, enrichment: DataFrame, group: str, cost: str) -> DataFrame:
    """Members with the values found for their group; its cost is split evenly over them."""
    counted = members.groupBy(group).agg(F.count("*").alias("n_members"))
    priced = enrichment.join(counted, group).withColumn(cost, F.col(cost) / F.col("n_members")).drop("n_members")
    return members.join(priced, group, "left")


LEASE = "id long, token string, expires_ms long"


def stream_leases(claims: DataFrame, seconds: int) -> DataFrame:
    """A stream of granted and expired leases from a stream of claims (id, token, at).

    The first claim of a free id wins; later ones are ignored until the lease runs out in processing time.
    """

    def grant(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (token, expires) = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "token": [token], "event": ["expired"], "expires_ms": [expires]})
            return
        wanted = pd.concat(list(batches)).sort_values(["at", "token"])
        if not state.exists and len(wanted):
            expires = state.getCurrentProcessingTimeMs() + 1000 * seconds
            state.update((wanted["token"].iloc[0], expires))
            state.setTimeoutDuration(1000 * seconds)
            yield pd.DataFrame({"id": [key[0]], "token": [wanted["token"].iloc[0]], "event": ["granted"], "expires_ms": [expires]})

    return claims.groupBy("id").applyInPandasWithState(grant, "id long, token string, event string, expires_ms long", "token string, expires_ms long", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Parts of a snapshot by hash of the key; a micro-batch rewrites only those it touches.
BUCKETS = 64


def current_snapshot(spark: SparkSession, path: str, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
    """The latest version of each bucket, as ``latest_stream_upsert`` left it; of versions under ``before`` and some buckets if given."""
    rows = spark.read.option("basePath", path).parquet(path)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(*buckets))
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # only folder names are read for this
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi").drop("bucket", "version")


def latest_stream_upsert(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: str):
    """Keep a snapshot of the latest row of each key; read it with ``current_snapshot``.

    Keys are dealt to BUCKETS. A micro-batch reads and rewrites the buckets it has keys of, under its own version, so a
    batch that is run again writes the same files. A bucket's versions before the last two are deleted; the one before the
    last stays for those who are still reading.
    """
    from loomgraph.operators.upsert import latest

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        new = cut(latest(batch, keys, [F.col(order)]))
        touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
        if _versions(spark, path, touched, number):
            new = latest(current_snapshot(spark, path, number, touched).unionByName(new), keys, [F.col(order)])
        new.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
        for b in touched:
            for old in sorted(_versions(spark, path, [b], number))[:-1]:
                _folder(spark, f"{path}/version={old}/bucket={b}", delete=True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str, delete: bool = False) -> list[str]:
    """Names in a folder of any file system that Spark knows, none if it is missing; or delete the folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if delete:
        fs.delete(p, True)
    return [s.getPath().getName() for s in fs.listStatus(p)] if not delete and fs.exists(p) else []


def _versions(spark: SparkSession, path: str, buckets: Sequence[int], before: int) -> set[int]:
    """Versions under ``before`` that hold any of the buckets."""
    found = [int(n.split("=")[1]) for n in _folder(spark, path) if n.startswith("version=")]
    wanted = {f"bucket={b}" for b in buckets}
    return {v for v in found if v < before and wanted & set(_folder(spark, f"{path}/version={v}"))}


def windowed_counts(events: DataFrame, at: str, by: Sequence[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out of closed windows."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
