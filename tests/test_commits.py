"""Tables that change at once or not at all, and claims that never overlap."""

import threading

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import commits
from loomgraph.streaming import leases

QUEUE = "id long, status string, token string, claimed_at timestamp, grp string"
WHEN = "2024-01-01 10:00:00"


def now():
    return F.lit(WHEN).cast("timestamp")


def queue(spark, n=60):
    return spark.createDataFrame([(i, "pending" if i % 10 else "done", None, None, f"g{i % 3}") for i in range(n)], QUEUE)


def test_a_failed_write_leaves_the_old_tables(spark, tmp_path):
    folder = str(tmp_path / "t")
    a = spark.range(5).toDF("x")
    assert commits.write_tables(spark, folder, {"a": a, "b": a}) == 0
    with pytest.raises(Exception):
        commits.write_tables(spark, folder, {"a": a, "b": a.select(F.raise_error(F.lit("no")).alias("x"))})
    assert commits.read_table(spark, folder, "a").count() == commits.read_table(spark, folder, "b").count() == 5
    assert commits.write_tables(spark, folder, {"a": a.withColumn("y", F.lit(1))}) == 1
    assert commits.read_table(spark, folder, "a").count() == 10 and commits.read_table(spark, folder, "a", 0).count() == 5
    commits.write_tables(spark, folder, {"b": a.where("x < 2")}, replace=True)
    assert commits.read_table(spark, folder, "b").count() == 2 and commits.read_table(spark, folder, "a").count() == 10
    with pytest.raises(KeyError):
        commits.read_table(spark, folder, "none")


def test_one_number_is_given_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    won = []
    writers = [threading.Thread(target=lambda k=k: won.append(k) if commits.publish(spark, folder, 0, {"by": k}) else None) for k in range(6)]
    [w.start() for w in writers], [w.join() for w in writers]
    assert len(won) == 1 and commits.manifest(spark, folder) == (0, {"by": won[0]})


def test_concurrent_claims_never_share_a_row(spark, tmp_path):
    folder = str(tmp_path / "q")
    commits.begin(queue(spark), folder)
    got, failed = {}, []

    def work(name):
        try:
            got[name] = {r["id"] for r in leases.claim_atomically(spark, folder, name, now(), 15, 300).collect()}
        except Exception as e:  # told in the test's own thread
            failed.append(e)

    claimers = [threading.Thread(target=work, args=(f"c{k}",)) for k in range(4)]
    [c.start() for c in claimers], [c.join() for c in claimers]
    assert not failed
    every = [i for ids in got.values() for i in ids]
    assert len(every) == len(set(every)) == 54 and not any(i % 10 == 0 for i in every)
    assert commits.manifest(spark, folder)[0] == 4
    assert leases.claim_atomically(spark, folder, "late", now(), 5, 300).count() == 0


def test_a_claim_that_was_overtaken_picks_again(spark, tmp_path):
    folder = str(tmp_path / "q")
    commits.begin(queue(spark), folder)
    asked = []

    def slow(rows):
        asked.append(1)
        if len(asked) == 1:
            leases.claim_atomically(spark, folder, "fast", now(), 54, 300)
        return leases.claim(rows, "slow", now(), 5, 300).where("token = 'slow'")

    assert commits.transact(spark, folder, slow).count() == 0 and len(asked) == 2
    with pytest.raises(commits.Conflict):
        commits.begin(queue(spark), folder)


def test_claims_by_group_and_rewriting(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "MOST_CHANGES", 2)
    folder = str(tmp_path / "q")
    commits.begin(queue(spark), folder)
    seen = []
    for k in range(4):
        rows = leases.claim_atomically(spark, folder, f"t{k}", now(), 6, 300, group=["grp"]).collect()
        assert len(rows) == 6 and len({r["grp"] for r in rows}) == 1
        seen += [r["id"] for r in rows]
    assert len(set(seen)) == 24 and commits.current(spark, folder).count() == 60
    assert len(commits.manifest(spark, folder)[1]["changes"]) == 1


def test_scan_tables(spark):
    scan = spark.createDataFrame([("d1", "f1", 3), ("d1", "f2", 1), (None, "f1", 2), ("d2", None, 5)], "dir string, file string, size int")
    out = commits.scan_tables(scan, {"dirs": ("dir", ["size"]), "files": ("file", [])}, {"holds": ("dir", "file")})
    assert {tuple(r) for r in out["dirs"].collect()} == {("d1", 1), ("d2", 5)}
    assert {tuple(r) for r in out["files"].collect()} == {("f1", 2), ("f2", 1)}
    assert {tuple(r) for r in out["holds"].collect()} == {("d1", "f1"), ("d1", "f2")}
