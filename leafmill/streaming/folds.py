"""Keyed state over ordered rows: message folds, fixed windows from a first hit, replay suppression.

The batch forms sort within partitions and carry one small state along, so no
key is ever held whole; the streaming forms keep the same state with Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FRAME = "stream_id string, seq long, delta string, text string, done boolean, error string"


def frames(raw: DataFrame) -> DataFrame:
    """(stream_id, seq, delta, text, done, error): the events of server-sent text (stream_id, body); broken JSON is skipped."""
    blocks = raw.select("stream_id", F.posexplode(F.split("body", r"\n\n")).alias("seq", "frame")).where(F.col("frame").startswith("data: "))
    parsed = blocks.select("stream_id", F.col("seq").cast("long").alias("seq"), F.from_json(F.substring("frame", 7, 2_000_000_000), "delta string, text string, done boolean, error string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return parsed.where("e._bad is null").select("stream_id", "seq", "e.delta", "e.text", "e.done", "e.error")


def folded(events: DataFrame) -> DataFrame:
    """(stream_id, content): deltas joined in order, from the last ``text`` on and up to ``done``.

    Rows of other streams never meet, and what is before the last text is dropped before it is gathered.
    """
    own = Window.partitionBy("stream_id")
    ended = events.withColumn("end", F.min(F.when(F.col("done"), F.col("seq"))).over(own))
    live = ended.where(F.col("end").isNull() | (F.col("seq") < F.col("end")))
    begun = live.withColumn("begin", F.max(F.when(F.col("text").isNotNull(), F.col("seq"))).over(own))
    taken = begun.where(F.col("begin").isNull() | (F.col("seq") >= F.col("begin")))
    parts = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("text", "delta", F.lit("")).alias("part"))))  # one answer's pieces
    return taken.groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("content"))


def limited(hits: DataFrame, key: str, seconds: int, limit: int, order: str = "id") -> DataFrame:
    """(order, key, n, accepted): a fixed window from a key's first hit; later hits count without prolonging it.

    A hit after the window's end begins the next. Rejected hits count as well.
    Hits without a time or key are left out.
    """
    rows = hits.select(order, F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where("key is not null and at is not null")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, n = None, 0, 0
        for batch in batches:
            counts = []
            for k, at in zip(batch["key"].tolist(), batch["at"].tolist()):
                if k != now or at >= start + seconds * 1_000_000:
                    now, start, n = k, at, 0
                n += 1
                counts.append(n)
            yield pd.DataFrame({order: batch[order], key: batch["key"], "n": counts, "accepted": [c <= limit for c in counts]})

    dealt = rows.repartition("key").sortWithinPartitions("key", "at", order)
    return dealt.mapInPandas(run, f"{order} {kinds[order]}, {key} {kinds['key']}, n long, accepted boolean")


def once(hits: DataFrame, key: str, seconds: int = 86_400, order: str = "id") -> DataFrame:
    """The hits that begin a window: replays within it are dropped."""
    return limited(hits, key, seconds, 1, order).where("accepted").select(order, key)


def deduplicated(stream: DataFrame, key: str, time: str, within: str = "24 hours") -> DataFrame:
    """Replay suppression on a stream: late rows and replays within the watermark go."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


class WindowCounter(StatefulProcessor):
    """The state of one key: when its window began (microseconds) and how many hits it has."""

    def __init__(self, seconds: int, limit: int, ttl_ms: int = 0) -> None:
        self.seconds, self.limit, self.ttl_ms = seconds, limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start long, n long", self.ttl_ms or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.state.get() if self.state.exists() else (None, 0)
        start, n = known[0], known[1]
        hits = pd.concat(rows).sort_values(["at", "id"])  # a key's hits of one trigger, in order
        counts = []
        for at in hits["at"].tolist():
            if start is None or at >= start + self.seconds * 1_000_000:
                start, n = at, 0
            n += 1
            counts.append(n)
        yield pd.DataFrame({"id": hits["id"], "key": hits["key"], "n": counts, "accepted": [c <= self.limit for c in counts]})
        self.state.update((start, n))

    def close(self) -> None:
        pass


def limited_stream(hits: DataFrame, seconds: int, limit: int, ttl_ms: int = 0) -> DataFrame:
    """(id, key, n, accepted) of a stream of hits (id, key, at): ``limited``, with its state kept by Spark.

    With ``ttl_ms``, which should be longer than a window, a key's state goes so long after its last hit.
    """
    work, mode = WindowCounter(seconds, limit, ttl_ms), "processingTime" if ttl_ms else "none"
    return hits.select("id", "key", "at").groupBy("key").transformWithStateInPandas(work, "id long, key long, n long, accepted boolean", "append", mode)
