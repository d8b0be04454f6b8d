"""Guards on streams of generated text, continuations, and periodic jobs that send nothing twice.

``guarded`` follows each stream of pieces with one state: pieces are taken in
their order (early ones wait), every ``SCAN`` characters five guards look at what
has come, and a stream that breaks one is stopped: no later piece passes. A part
that ends for its length is continued, up to ``CONTINUATIONS`` times, unless its
end repeats what stands before it. State is bounded (the end of the text, counts,
and the pieces that wait) and goes after the time to live; a stream that falls
silent is closed by a timer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Characters between two looks, and continuations at most.
SCAN, CONTINUATIONS = 500, 5
#: Characters of the raw end that a state keeps: more than any guard looks at once tags are out.
KEPT = 12_000
#: Least input that counts for the guard on lengths, and how many times as long an output may be.
LEAST_INPUT, LONGEST = 2000, 10
#: Numbers in brackets, items of lists, bodies of numbered items, sentences.
NUMBERED = re.compile(r"[（(]\s*[0-9]+\s*[）)]")
ITEM = re.compile(r"<li\b", re.I)
BODY = re.compile(r"[（(]\s*[0-9]+\s*[）)]\s*([^\n（）()]{8,100})")
SENTENCE = re.compile(r"[^。！？!?\n]{20,150}[。！？!?]")
OUT = "stream_id string, seq long, delta string, event string"


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text))


def same_bodies(text: str) -> bool:
    """Five of the last eight numbered items have the last one's body."""
    bodies = [m.strip() for m in BODY.findall(squeezed(text)[-3000:])][-8:]
    return len(bodies) >= 5 and len(bodies[-1]) >= 8 and bodies.count(bodies[-1]) >= 5


def same_sentences(text: str) -> bool:
    """A sentence five times among the last ten."""
    found = [m.strip() for m in SENTENCE.findall(squeezed(text)[-2500:])]
    return len(found) >= 8 and max(map(found[-10:].count, found[-10:])) >= 5


def short_groups(text: str) -> bool:
    """A group of up to six characters fifteen times in a row."""
    return bool(re.search(r"(.{1,6})\1{14,}", re.sub(r"<[^>]+>", "", text)[-600:]))


def repeats_itself(text: str) -> bool:
    """Whether the last 300 characters stand in the 900 before them."""
    end = squeezed(text).strip()[-1200:]
    last = end[-300:].strip()
    return len(last) > 100 and last in end[:900]


def begun() -> dict:
    """The state of a stream that has had no piece yet."""
    return {"next": 0, "chars": 0, "numbered": 0, "items": 0, "carry": "", "end": "", "since": 0, "part": 0, "closed": ""}


def broken(state: dict, items_in: int, chars_in: int) -> str | None:
    """The first guard that the text so far breaks."""
    if max(state["numbered"], state["items"]) > max(2 * items_in + 5, 20):
        return "items"
    for name, test in (("same_body", same_bodies), ("sentence", same_sentences), ("characters", short_groups)):
        if test(state["end"]):
            return name
    return "length" if state["chars"] > LONGEST * max(chars_in, LEAST_INPUT) else None


def taken(state: dict, piece: dict) -> Iterator[tuple[str | None, str]]:
    """What one piece in order gives: (delta, event) rows; changes ``state``."""
    if state["closed"]:
        return
    delta = piece["delta"] or ""
    if delta:
        state["chars"] += len(delta)
        state["end"] = (state["end"] + delta)[-KEPT:]
        window = state["carry"] + delta
        at = 0
        for kind, pattern in (("numbered", NUMBERED), ("items", ITEM)):
            found = list(pattern.finditer(window))
            state[kind] += len(found)
            at = max([at, *(m.end() for m in found)])
        state["carry"] = window[at:][-40:]  # a number in brackets may be cut between pieces
        state["since"] += len(delta)
        yield delta, "delta"
        if state["part"] == 0 and state["since"] >= SCAN:
            state["since"] = 0
            if why := broken(state, piece["items_in"] or 0, piece["chars_in"] or 0):
                state["closed"] = why
                yield None, f"stopped:{why}"
                return
    if piece["finish"] is not None:
        if piece["finish"] != "length":
            state["closed"] = "done"
        elif state["part"] and repeats_itself(state["end"]):
            state["closed"] = "loop"
        elif state["part"] >= CONTINUATIONS:
            state["closed"] = "continuations"
        else:
            state["part"] += 1
            yield None, f"continue:{state['part']}"
            return
        yield None, f"closed:{state['closed']}"


class Guards(StatefulProcessor):
    """The state of one stream: what ``begun`` has, as JSON, and the pieces that came before their turn."""

    def __init__(self, ttl_ms: int, idle_ms: int) -> None:
        self.ttl_ms, self.idle_ms = ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("text", "body string", self.ttl_ms or None)
        self.waiting = handle.getMapState("waiting", "seq long", "piece string", self.ttl_ms or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = json.loads(self.state.get()[0]) if self.state.exists() else begun()
        early = {k[0]: json.loads(v[0]) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        pieces = dict(early)
        for batch in rows:
            for r in batch.itertuples():
                if r.seq >= state["next"]:  # what was taken before is a repetition
                    pieces.setdefault(int(r.seq), {"delta": r.delta, "finish": r.finish, "items_in": _whole(r.items_in), "chars_in": _whole(r.chars_in)})
        out = []
        while state["next"] in pieces:
            seq = state["next"]
            out += [(key[0], seq, delta, event) for delta, event in taken(state, pieces.pop(seq))]
            state["next"] += 1
        if state["closed"]:
            pieces = {}
        for seq in set(early) - set(pieces):
            self.waiting.removeKey((seq,))
        for seq in set(pieces) - set(early):
            self.waiting.updateValue((seq,), (json.dumps(pieces[seq]),))
        self.state.update((json.dumps(state),))
        if self.idle_ms and not state["closed"]:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "delta", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = json.loads(self.state.get()[0]) if self.state.exists() else begun()
        self.state.clear()
        self.waiting.clear()
        silent = [] if state["closed"] else [(key[0], state["next"], None, "closed:silent")]
        yield pd.DataFrame(silent, columns=["stream_id", "seq", "delta", "event"])

    def close(self) -> None:
        pass


def _whole(value: object) -> int:
    return 0 if value is None or value != value else int(value)


def guarded(pieces: DataFrame, ttl_ms: int = 3_600_000, idle_ms: int = 900_000) -> DataFrame:
    """(stream_id, seq, delta, event) of pieces (stream_id, seq from 0, delta, finish, items_in, chars_in).

    ``finish`` is null but for a part's last piece; ``items_in`` and ``chars_in``
    are those of the text that the stream answers. An event is ``delta``,
    ``stopped:guard``, ``continue:n`` or ``closed:why``. On a table instead of a
    stream there are no timers. The session's state store has to be RocksDB.
    """
    own = pieces.select("stream_id", "seq", "delta", "finish", "items_in", "chars_in")
    live = pieces.isStreaming
    if not live:
        pieces.sparkSession.streams.active  # noqa: B018  the coordinator of state stores starts with it
    work = Guards(ttl_ms if live else 0, idle_ms if live else 0)
    return own.groupBy("stream_id").transformWithStateInPandas(work, OUT, "append", "processingTime" if live else "none")


# -- periodic jobs -----------------------------------------------------------


def periodic(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 minutes", once: bool = False) -> StreamingQuery:
    """Run ``work`` on what has come, at intervals; ``once``: on all that is there, then end."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def unsent(due: DataFrame, sent: DataFrame, keys: list[str], now: str, days: int = 8) -> DataFrame:
    """The rows of ``due`` without a marker (keys, sent_at) of the last ``days`` days."""
    recent = sent.where(F.col("sent_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return due.join(recent.select(*keys).distinct(), keys, "left_anti")


def send_once(spark: SparkSession, due: DataFrame, batch: int, log: str, keys: list[str], now: str, days: int = 8) -> DataFrame:
    """Mark and return what a batch sends: due rows that no other batch has marked within ``days``.

    A batch writes its own folder of the log, whole or not at all. One that runs
    again finds its folder and sends what stands in it, and no more, so receivers
    that know a batch's number get nothing twice.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/batch={batch}/_SUCCESS")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        kinds = ", ".join(f"{k} {due.schema[k].dataType.simpleString()}" for k in keys)
        marked = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{log}/batch=*/_SUCCESS"))
        others = [str(s.getPath().getParent()) for s in marked or []]
        sent = spark.read.schema(f"{kinds}, sent_at timestamp").parquet(*others) if others else spark.createDataFrame([], f"{kinds}, sent_at timestamp")
        new = unsent(due.dropDuplicates(keys), sent, keys, now, days).withColumn("sent_at", F.lit(now).cast("timestamp"))
        new.write.mode("overwrite").parquet(f"{log}/batch={batch}")
    return spark.read.parquet(f"{log}/batch={batch}")
