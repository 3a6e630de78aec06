"""Streams that stop, fail and start again against batch operators."""

import os

import pytest
from pyspark.sql import functions as F

from lodestead.operators import dedup, lifecycle
from lodestead.operators import watchdogs as W
from lodestead.sources.adapter import listings, notifications
from lodestead.sources.adapter import watchdogs as dogs
from lodestead.streaming import duplicates, ingest, notifier


def landed(df, path, n, order="id"):
    """``n`` files, in order of their names and times."""
    bounds = df.approxQuantile(order, [k / n for k in range(1, n)], 0.0)
    part = sum((F.when(F.col(order) > b, 1).otherwise(0) for b in bounds), F.lit(0)) if n > 1 else F.lit(0)
    for k in range(n):
        df.withColumn("_part", part).where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)


def test_duplicates_across_batches_equal_the_batch_operator(spark, sf, tmp_path):
    rows = listings(spark, sf).where("is_active").withColumns({"cluster_id": F.lit(None).cast("string"), "is_canonical": F.lit(True)})
    landed(rows.select("id", "is_active", "transaction_type", "latitude", "longitude", "size_m2", "price", "scraped_at"), str(tmp_path / "in"), 3)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    query = duplicates.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), schema, (20_000,), late="9000 days")
    query.awaitTermination()
    assert query.exception() is None
    found = {r.id: (r.cluster_id, r.is_canonical, r.existing_cluster) for r in spark.read.parquet(str(tmp_path / "out")).where("kind = 'member'").collect()}
    bounds = [*rows.approxQuantile("id", [1 / 3, 2 / 3], 0.0), 1e18]
    state, wanted = None, {}
    for low, high in zip([-1, *bounds], bounds, strict=False):
        batch = rows.where((F.col("id") > low) & (F.col("id") <= high))
        state = batch if state is None else state.unionByName(batch)
        new = dedup.incremental(state)
        wanted |= {r.id: (r.cluster_id, r.is_canonical, r.existing_cluster) for r in new.collect()}
        state = spark.createDataFrame(dedup.assigned(state, new).collect(), state.schema)
    assert found == wanted and sum(c for _, c, _ in found.values()) > 10


def test_quiet_hashes_are_told_and_forgotten(spark, tmp_path):
    schema = "id long, is_active boolean, transaction_type string, latitude double, longitude double, size_m2 double, price double, scraped_at timestamp_ntz"
    place = lambda k, day: (k, True, "sale", 50.0 + (k % 10) / 100, 14.0, 50.0, 1.0, f"2020-01-{day:02d} 00:00:00")
    batches = [[place(1, 1), place(2, 1)], [place(11, 2), place(21, 5)], [place(3, 6)], [place(4, 20)], [place(5, 21), place(31, 21)], [place(6, 30)]]
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, schema.replace("timestamp_ntz", "string")).withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = duplicates.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), schema)
        query.awaitTermination()
        assert query.exception() is None, k
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    hash_of = {r.id: r.cluster_id for r in rows if r.kind == "member"}
    assert set(hash_of) == {1, 11, 21}  # 31 came after its hash was forgotten
    assert {r.id for r in rows if r.is_canonical} == {1}
    quiet = sorted(r.days for r in rows if r.kind == "quiet" and r.cluster_id == hash_of[1])
    assert quiet == [3, 3, 7, 7, 14]  # once until it was forgotten, once more after 31


def test_duplicates_without_a_time_and_a_batch_tried_again(spark, tmp_path):
    """A listing without a time counts; a batch that fails after its state was written is tried again to the same rows; nothing calls Python."""
    schema = "id long, is_active boolean, transaction_type string, latitude double, longitude double, size_m2 double, price double, scraped_at timestamp_ntz"
    place = lambda k, day: (k, k % 7 != 0, "sale", 50.0 + (k % 10) / 100, 14.0, 50.0, 1.0, day and f"2020-01-{day:02d} 00:00:00")
    go = lambda: duplicates.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), schema)
    whole = duplicates.found

    def land(rows):
        df = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string")).withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def fails(after, rows, horizons):
        raise RuntimeError("between the writes")

    land([place(12, 2), place(2, None), place(3, 2), place(7, 2), place(17, 2)])
    go().awaitTermination()
    land([place(13, 3), place(22, None), place(23, 4), place(33, 1), place(27, 4)])
    duplicates.found = fails
    try:
        with pytest.raises(Exception, match="between the writes"):
            go().awaitTermination()
    finally:
        duplicates.found = whole
    go().awaitTermination()
    rows = {(r.id, r.is_canonical, r.existing_cluster) for r in spark.read.parquet(str(tmp_path / "out")).where("kind = 'member'").collect()}
    assert rows == {(2, True, False), (12, False, False), (22, False, True), (3, True, False), (13, False, False), (23, False, False), (17, True, False), (27, False, False)}  # 33 is late, 7 inactive
    rows, state = spark.createDataFrame([], "effective_hash string, id long, seen_ms long"), spark.createDataFrame([], duplicates.STATE)
    out = whole(duplicates.followed(state, rows, F.lit(0), (3,)), rows, (3,))
    assert "Python" not in (plan := out._jdf.queryExecution().toString()) and "Pandas" not in plan


def test_notifier_fails_between_its_writes_and_runs_again(spark, sf, tmp_path):
    rows, some, sent = listings(spark, sf), dogs(spark, sf).where("id < 60"), notifications(spark, sf).limit(0)
    landed(rows, str(tmp_path / "in"), 2)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    now = lambda n: F.lit(f"2001-09-0{n + 1} 00:00:00").cast("timestamp_ntz")
    tried = []

    def break_after_audit(self, number):
        tried.append(number)
        if tried == [0]:
            raise RuntimeError("between the writes and the mark")
        whole(self, number)

    whole, notifier.Log.mark = notifier.Log.mark, break_after_audit
    try:
        go = lambda: notifier.start(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "check"), schema, some, sent, now)
        with pytest.raises(Exception, match="between the writes"):
            go().awaitTermination()
        log = notifier.Log(spark, str(tmp_path / "log"))
        assert log.marked() == [] and log.audit().count() == 0 and os.path.exists(tmp_path / "log/audit/0")
        go().awaitTermination()
    finally:
        notifier.Log.mark = whole
    assert log.marked() == [0, 1]
    audit = log.audit().collect()
    assert len(audit) == len(set(audit)) > 0
    bumps = log.bumps().groupBy("watchdog_id", "notified_at").count().collect()
    assert bumps and all(r["count"] == 1 for r in bumps)
    # A search that was told is told of nothing older again.
    first = {r.watchdog_id for r in log.bumps(1).collect()}
    assert first and not {r.watchdog_id for r in log.bumps().collect() if str(r.notified_at).startswith("2001-09-02")} & first
    expected = W.shown(W.matches(spark.read.parquet(str(tmp_path / "in")), some)).select("watchdog_id").distinct().count()
    assert expected == log.bumps().select("watchdog_id").distinct().count()


def test_sources_in_one_loop_restart_in_mid_cycle(spark, sf, tmp_path):
    rows = listings(spark, sf)
    some = rows.withColumns({"price": F.col("price") + 5, "scraped_at": F.lit("2001-08-30 00:00:00").cast("timestamp_ntz")})
    for source in ("low", "high"):
        landed(some.where(F.col("source") == source), str(tmp_path / "in" / source), 2)
    schema = spark.read.parquet(str(tmp_path / "in" / "low")).schema
    now = lambda n: F.lit(f"2001-09-0{n + 1} 00:00:00").cast("timestamp_ntz")

    def run(name, sweep):
        folder = str(tmp_path / name)
        if not os.path.exists(folder):
            rows.write.parquet(ingest.snapshot(folder, 0))
        return ingest.watch(spark, str(tmp_path / "in"), {"low": 1, "high": 2}, folder, str(tmp_path / f"{name}-check"), schema, now, (sweep,))

    assert run("whole", lifecycle.expire)
    failures = []

    def fails_once(state, at):
        failures.append(1)
        if len(failures) == 2:
            raise RuntimeError("mid-cycle")
        return lifecycle.expire(state, at)

    with pytest.raises(Exception, match="mid-cycle"):
        run("parts", fails_once)
    assert run("parts", fails_once)
    last = lambda name: sorted(map(str, spark.read.parquet(ingest.snapshot(str(tmp_path / name), 2)).select("external_id", "price", "is_active", "deactivation_reason", "cluster_id", "is_canonical").collect()))
    assert last("parts") == last("whole") and any("'ttl'" in x for x in last("whole"))
    assert not os.path.exists(ingest.snapshot(str(tmp_path / "whole"), 3))  # high has both its files in the first cycle, low one in each


def test_a_scan_lands_with_all_its_writes(spark, sf, tmp_path, monkeypatch):
    """No pass over whole rows before they land: the cycle deals a scan out once, for the last write of each id and for the upsert."""
    from lodestead.plans.extras import QUERIES
    from lodestead.plans.lifecycle import incoming
    from lodestead.sources.adapter import now

    landed_as, whole = [], ingest.start
    monkeypatch.setattr(ingest, "start", lambda *a: landed_as.append(a[1]) or whole(*a))
    assert QUERIES["stream_ingest_equals_batch"][0](spark, sf).count() > 0
    scan = spark.read.parquet(landed_as[0])
    assert scan.count() == incoming(spark, sf).count() > scan.select("external_id").distinct().count()
    listings(spark, sf).write.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ingest.apply(spark.read.parquet(str(tmp_path / "rows")), scan, now())._jdf.queryExecution().executedPlan().initialPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt, todo = 0, [plan]
    while todo:
        node = todo.pop()
        dealt += node.nodeName() == "Exchange" and node.output().size() > 25
        todo += [node.children().apply(k) for k in range(node.children().size())]
    assert dealt <= 3  # the listings, the scan, and of the scan what has no external id
