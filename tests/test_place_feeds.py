"""Feeds of many places: a partitioned source, and progress as state with timers."""

import random
import time
import uuid

import pytest

from gleaner.sources import place_pages
from gleaner.streaming import ingest, progress


def _calls(seed, places=30, longest=40):
    """Recorded calls of places: tokens are followed, some calls fail, some feeds end early, some go on."""
    rng, rows = random.Random(seed), []
    for p in range(places):
        token, page = None, 0
        for call in range(rng.randrange(1, longest)):
            if rng.random() < 0.2:
                rows.append((f"p{p}", call, token, None, None, True))
                continue
            items = [f"p{p}-{page}-{k}" for k in range(10 if rng.random() < 0.95 else 0)]
            following = f"t{p}-{page + 1}" if rng.random() < 0.97 else None
            rows.append((f"p{p}", call, token, following, items, False))
            token, page = following, page + 1
    return rows


def _by_force(rows, most=1 << 30):
    """Rows and cursors, place by place, one call after another."""
    out, at = [], {}
    for p in sorted({r[0] for r in rows}):
        page, cursor = 0, None
        for _, call, token, following, items, failed in sorted((r for r in rows if r[0] == p), key=lambda r: r[1]):
            if failed:
                cursor = (call + 1, token, False)
                continue
            if call < most:
                out += [(p, call, token, page * 10 + k, x) for k, x in enumerate(items)]
            page += 1
            cursor = (call + 1, following if items else None, not items or following is None)
            if cursor[2]:
                break
        at[p] = cursor
    return sorted(out, key=repr), at


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("slots", "block"), [(4, 7), (32, 1000)])
def test_places_are_read_in_parts(spark, tmp_path, slots, block):
    rows = _calls(1)
    folder = f"{tmp_path}/feed"
    df = spark.createDataFrame(rows + rows[:5], place_pages.CALLS).selectExpr("*", "'x' AS slot", "1 AS block", "2 AS page")
    place_pages.record(df, folder, slots, block)
    want, at = _by_force(rows)
    feed = place_pages.read(spark, folder)
    assert _got(feed) == want
    assert feed.rdd.getNumPartitions() > (2 * slots if block == 7 else 10)
    assert _got(place_pages.read(spark, folder, maxCalls=3)) == _by_force(rows, 3)[0]
    assert {r.poi_id: (r.calls, r.next_page_token, r.exhausted) for r in place_pages.cursors(spark, folder).collect()} == at


def test_chosen_places_and_calls(spark, tmp_path):
    rows = _calls(2)
    folder = f"{tmp_path}/feed"
    place_pages.record(spark.createDataFrame(rows, place_pages.CALLS), folder, 8, 5)
    want, _ = _by_force(rows)
    feed = place_pages.read(spark, folder)
    some = place_pages.read(spark, folder, places=["p3", "p4", "none"], fromCall=5, toCall=11)
    assert _got(some) == [r for r in want if r[0] in ("p3", "p4") and 5 <= r[1] < 11]
    assert some.rdd.getNumPartitions() <= 4 < feed.rdd.getNumPartitions()
    assert place_pages.read(spark, folder, places=[]).count() == 0
    # Filters of one query of a DataFrame leave its others alone.
    assert _got(feed.filter("poi_id = 'p5' AND call = 1")) == [r for r in want if r[:2] == ("p5", 1)]
    assert _got(feed) == want


def test_stream_resumes_each_place(spark, tmp_path):
    """Every run takes only calls that are new, of each place from its own; a failed call's token is taken up by a later one."""
    rows = _calls(3)
    folder, seen = f"{tmp_path}/feed", []
    rng = random.Random(4)
    cut = {p: rng.randrange(0, 40) for p in {r[0] for r in rows}}
    for part in ([r for r in rows if r[1] < cut[r[0]]], [r for r in rows if r[1] >= cut[r[0]]], []):
        if part:
            place_pages.record(spark.createDataFrame(part, place_pages.CALLS), folder, 4, 6)
        got = []
        q = place_pages.stream(spark, folder).writeStream.foreachBatch(lambda b, n, got=got: got.extend(tuple(r) for r in b.collect()))
        q.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
        seen.append(got)
    want, _ = _by_force(rows)
    assert sorted(seen[0] + seen[1], key=repr) == want and seen[2] == []
    assert set(seen[0]) == {r for r in want if r[1] < cut[r[0]]}


def test_places_edges(spark, tmp_path):
    none = spark.createDataFrame([], place_pages.CALLS)
    place_pages.record(none, f"{tmp_path}/none")
    assert place_pages.read(spark, f"{tmp_path}/none").count() == 0
    assert place_pages.cursors(spark, f"{tmp_path}/none").count() == 0 == place_pages.cursors(spark, f"{tmp_path}/missing").count()
    with pytest.raises(Exception, match="without place or number"):
        place_pages.record(spark.createDataFrame([(None, 0, None, None, [], False)], place_pages.CALLS), f"{tmp_path}/bad")
    long = spark.createDataFrame([("ü/=", 0, None, "t", ["x" * 3_000_000, "", "line\nbreak   é"], None)], place_pages.CALLS)
    place_pages.record(long, f"{tmp_path}/long")
    assert [r.item for r in place_pages.read(spark, f"{tmp_path}/long").orderBy("offset").collect()] == ["x" * 3_000_000, "", "line\nbreak   é"]


@pytest.fixture
def rocks(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": progress.PROVIDER, "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in wanted}
    for own in (wanted, before):
        for k, v in own.items():
            spark.conf.set(k, v)
        if own is wanted:
            yield


def _run(spark, path, checkpoint, **rules):
    stream = spark.readStream.schema(progress.EVENTS).parquet(path)
    q = progress.track(stream, **rules).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    progress.catch_up(spark, q.foreachBatch(lambda b, n: b.write.format("noop").mode("overwrite").save()))


def test_progress_goes_on_after_a_restart(spark, tmp_path, rocks):
    rng = random.Random(5)
    events = [(f"p{p}", k, rng.choice(["page"] * 6 + ["error", "odd"]), rng.choice([0, 1, 5, None])) for p in range(8) for k in range(12)] + [("p0", 12, "end", 0), ("p0", 13, "page", 3), (None, 0, "page", 2), (None, 1, "error", 0)]
    path, checkpoint = f"{tmp_path}/e", f"{tmp_path}/c"
    for low, high in ((0, 5), (5, 20)):
        part = [e for e in events if low <= e[1] < high]
        rng.shuffle(part)
        spark.createDataFrame(part, progress.EVENTS).coalesce(1).write.mode("append").parquet(path)
        _run(spark, path, checkpoint, wait_ms=10**9, most_wait_ms=10**9)
        want, failed = {}, {}
        for p, seq, kind, n in sorted((e for e in events if e[1] < high), key=lambda e: (str(e[0]), e[1])):
            own = want.setdefault(p, ingest.Progress())
            if own.exhausted:
                continue
            name = kind if kind in ("page", "end") else "error"
            own.see(name, n or 0)
            failed[p] = failed.get(p, []) + [(seq, own.next_offset)] if name == "error" and not own.exhausted else []
        got = {r[0]: tuple(r)[1:] for r in progress.progress_table(spark, checkpoint).collect()}
        assert got == {p: (x.next_offset, x.error_streak, x.pages, x.reviews, x.exhausted) for p, x in want.items()}
        waiting = sorted((tuple(r) for r in progress.failed_fetches(spark, checkpoint).collect()), key=repr)
        assert waiting == sorted(((p, *x) for p, own in failed.items() for x in own), key=repr)


def test_a_failed_fetch_falls_due(spark, tmp_path, rocks):
    path, name = f"{tmp_path}/e", "due" + uuid.uuid4().hex[:8]
    spark.createDataFrame([("a", 0, "page", 4), ("a", 1, "error", 0), ("b", 0, "page", 1)], progress.EVENTS).coalesce(1).write.parquet(path)
    q = progress.track(spark.readStream.schema(progress.EVENTS).parquet(path), wait_ms=1_000).writeStream.outputMode("update")
    q = q.option("checkpointLocation", f"{tmp_path}/c").format("memory").queryName(name).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 100
        while time.time() < until and not spark.table(name).filter("what = 'retry'").count():
            time.sleep(1)
        time.sleep(3)
        rows = sorted(tuple(r) for r in spark.table(name).collect())
    finally:
        q.stop()
    assert rows == [("a", "progress", 10, 1, 1, 4, False), ("a", "retry", 10, 1, 1, 4, False), ("b", "progress", 10, 0, 1, 1, False)]
    assert progress.failed_fetches(spark, f"{tmp_path}/c").count() == 0


def test_track_needs_its_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError, match="RocksDB"):
        progress.track(spark.createDataFrame([], progress.EVENTS))
    spark.conf.set(name, before)
