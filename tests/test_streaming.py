"""Guards and continuations on streams, and jobs that send nothing twice."""

import time

import pandas as pd
import pytest

from leafmill.streaming import guards

SCHEMA = "stream_id string, seq long, delta string, finish string, items_in int, chars_in int"


def follow(pieces, items_in=0, chars_in=0):
    """The events of pieces in order, without Spark."""
    state, out = guards.begun(), []
    for delta, finish in pieces:
        out += [e for _, e in guards.taken(state, {"delta": delta, "finish": finish, "items_in": items_in, "chars_in": chars_in}) if e != "delta"]
    return out, state


def test_guards():
    varied = [f"Piece number {i} of a text that doesn't repeat, since {i * i} differs. " for i in range(60)]
    assert follow([(p, None) for p in varied])[0] == []
    assert follow([(f"({i}", None) if j else (f") item {i * i} here\n", None) for i in range(60) for j in (1, 0)])[0] == ["stopped:items"]
    assert follow([(f"({i}) item {i * i} here\n", None) for i in range(60)], items_in=60)[0] == []
    assert follow([(f"({i}) the same body here ", None) for i in range(30)], items_in=20)[0] == ["stopped:same_body"]
    assert follow([("One sentence that is long enough for this! ", None)] * 20)[0] == ["stopped:sentence"]
    assert follow([("ab" * 250, None)])[0] == ["stopped:characters"]
    assert follow([(v, None) for i in range(8) for v in (f"{i}{j}{v}" for j, v in enumerate(varied))], chars_in=100)[0] == ["stopped:length"]
    assert follow([(v, None) for i in range(8) for v in (f"{i}{j}{v}" for j, v in enumerate(varied))], chars_in=9000)[0] == []
    assert follow([("ab" * 240, None), (None, "stop"), ("late", None)])[0] == ["closed:done"]  # no look before 500 characters


def test_state_is_bounded():
    _, state = follow([(f"word {i * 7919} ", None) for i in range(30_000)], chars_in=10**9)
    assert len(state["end"]) == guards.KEPT and len(state["carry"]) <= 40 and state["chars"] > 300_000


def test_continuations():
    text = [f"Part {i}: {' '.join(str(i * j * 7 + j) for j in range(400))}. " for i in range(9)]
    events, _ = follow([x for t in text for x in ((t, None), (None, "length"))])
    assert events == [f"continue:{i}" for i in range(1, 6)] + ["closed:continuations"]
    again = "The very same long ending that comes over and over, word for word, as if nothing had been said before it at all. " * 4
    assert follow([(text[0], "length"), (again * 3, "length"), (again, "length")])[0] == ["continue:1", "closed:loop"]
    assert follow([("a", "length"), ("b", "stop"), ("c", None)])[0] == ["continue:1", "closed:done"]


def piece(stream, seq, delta, finish=None):
    return (stream, seq, delta, finish, 0, 0)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def run(spark, folder, checkpoint, out, n, **options):
    """The rows once there are ``n``: with timers a query has no end of its own."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = guards.guarded(stream, **options).writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(out)).trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(240):
            time.sleep(0.25)
            assert query.exception() is None
            found = spark.read.schema(guards.OUT).parquet(str(out)).collect() if (out / "_spark_metadata").exists() else []
            if len(found) >= n:
                break
    finally:
        query.stop()
    return sorted(((r["stream_id"], r["seq"], r["delta"], r["event"]) for r in found), key=str)


def test_late_and_split_batches(rocks, tmp_path):
    """Pieces come in any order and over restarts; what comes early waits, what comes twice counts once."""
    spam = "ab" * 130
    batches = [
        [piece("a", 1, "two "), piece("b", 0, spam), piece("c", 0, "x", "length")],
        [piece("a", 0, "one "), piece("b", 2, "after"), piece("a", 0, "one ")],
        [piece("b", 1, spam), piece("a", 3, "four", "stop"), piece("c", 1, "y", "stop")],
        [piece("a", 2, "three "), piece("a", 4, "never"), piece("b", 3, "never")],
    ]
    for i, (rows, n) in enumerate(zip(batches, (3, 4, 9, 12))):
        rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i in (1, 3):  # the query ends and goes on from its checkpoint
            got = run(rocks, tmp_path / "in", tmp_path / "ck", tmp_path / "out", n)
    assert [(q, d, e) for s, q, d, e in got if s == "a"] == [(0, "one ", "delta"), (1, "two ", "delta"), (2, "three ", "delta"), (3, "four", "delta"), (3, None, "closed:done")]
    assert {(q, e) for s, q, _, e in got if s == "b"} == {(0, "delta"), (1, "delta"), (1, "stopped:characters")}
    assert {(q, e) for s, q, _, e in got if s == "c"} == {(0, "delta"), (0, "continue:1"), (1, "delta"), (1, "closed:done")}
    assert len(got) == 12


def test_state_goes_after_its_time(rocks, tmp_path):
    """A stream begins anew once its state has outlived its time."""
    put = lambda rows: rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([piece("a", 0, "x", "stop")])
    run(rocks, tmp_path / "in", tmp_path / "ck", tmp_path / "out", 2, ttl_ms=1500, idle_ms=0)
    time.sleep(3)
    put([piece("a", 0, "y", "stop")])
    got = run(rocks, tmp_path / "in", tmp_path / "ck", tmp_path / "out", 4, ttl_ms=1500, idle_ms=0)
    assert sorted(d for *_, d, e in got if d) == ["x", "y"]


def test_silent_streams_are_closed(rocks, tmp_path):
    put = lambda rows: rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([piece("a", 0, "x"), piece("b", 0, "x", "stop")])
    got = run(rocks, tmp_path / "in", tmp_path / "ck", tmp_path / "out", 4, idle_ms=500)
    assert [(s, q, e) for s, q, _, e in got if e.startswith("closed:silent")] == [("a", 1, "closed:silent")]


def test_tables_give_the_same(spark):
    rows = [piece("a", 1, "two"), piece("a", 0, "one"), piece("a", 2, None, "length"), piece("b", 0, "ab" * 300), piece("b", 1, "z")]
    got = {(r["stream_id"], r["seq"], r["event"]) for r in guards.guarded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", 0, "delta"), ("a", 1, "delta"), ("a", 2, "continue:1"), ("b", 0, "delta"), ("b", 0, "stopped:characters")}


def test_nothing_is_sent_twice(spark, tmp_path):
    """A batch that runs again sends the same; another within eight days sends what is new, and later ones all again."""
    log = f"file://{tmp_path}/log"
    due = spark.createDataFrame([(1, 7), (2, 3), (2, 3)], "id long, days int")
    more = spark.createDataFrame([(1, 7), (3, 1)], "id long, days int")
    send = lambda rows, batch, now: sorted(r["id"] for r in guards.send_once(spark, rows, batch, log, ["id", "days"], now).collect())
    assert send(due, 0, "2024-01-30") == [1, 2]
    assert send(due.union(more), 0, "2024-01-30") == [1, 2]
    assert send(more, 1, "2024-02-01") == [3]
    assert send(due, 2, "2024-02-09") == [1, 2]
    assert send(more.limit(0), 3, "2024-02-10") == []


def test_a_periodic_job_goes_on_after_a_failure(spark, tmp_path):
    log, seen, failed = f"file://{tmp_path}/log", [], []
    due = lambda ids: pd.DataFrame({"id": ids, "days": [7] * len(ids)})
    for part, ids in enumerate(([1, 2], [2, 3])):
        spark.createDataFrame(due(ids), "id long, days int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, days int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def work(rows, batch):
        sent = [r["id"] for r in guards.send_once(rows.sparkSession, rows, batch, log, ["id", "days"], "2024-01-30").collect()]
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("after the marker, before the end of the batch")
        seen.extend(sent)

    with pytest.raises(Exception):
        guards.periodic(stream, work, str(tmp_path / "ck"), once=True).awaitTermination(120)
    guards.periodic(stream, work, str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert sorted(seen) == [1, 2, 3]


def test_replays_go_within_the_watermark(spark, tmp_path):
    from leafmill.streaming import folds

    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-01 01:00:00"), (1, "2024-01-01 06:00:00")]
    spark.createDataFrame(rows, "id long, ts string").selectExpr("id", "cast(ts as timestamp) ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in"))
    query = folds.deduplicated(stream, "id", "ts").writeStream.format("memory").queryName("replays").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(r["id"] for r in spark.table("replays").collect()) == [1, 2]
