"""Structure, quality and folds on small cases worked out by hand, and invariants on generated texts."""

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import billing, documents, quality, structure
from leafmill.sources import files
from leafmill.streaming import folds


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n<h2>/p_IMG1", max_size=400), st.integers(20, 80))
def test_pieces_join_to_the_text(text, most):
    found = list(documents.pieces(text, most))
    assert "".join(text[a:b] for a, b, _ in found) == text
    assert all(a < b for a, b, _ in found) or text == ""


def test_pieces_never_cut_a_placeholder_and_prefer_headings():
    text = "x" * 95 + "__IMG_12__" + "y" * 100
    assert all("__IMG_12__" in text[a:b] or not set(range(a, b)) & set(range(95, 105)) for a, b, _ in documents.pieces(text, 100))
    text = "a" * 80 + "<h2>next</h2>" + "b" * 100
    assert next(documents.pieces(text, 100)) == (0, 80, "heading")


@pytest.mark.parametrize("left, right", [("a" * 100, "a" * 90), ("x" + "ab" * 60, "ab" * 60 + "y"), ("abc", "abc"), ("", "a" * 200)])
def test_overlap(left, right):
    want = max((n for n in range(80, min(len(left), len(right)) + 1) if left.endswith(right[:n])), default=0)
    assert tx.overlap(left, right) == want


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_heading_texts(spark):
    assert values(spark, tx.without_number, "第一章 绪论", "1.2.3 Methods", "（二）范围", "三、结论", "2024年度", "5G", "1.", "1. 2. Deep") == ["绪论", "Methods", "范围", "结论", "2024年度", "5G", "1.", "Deep"]
    assert values(spark, tx.is_front_matter, "摘 要", "Abstract", "Results") == [True, True, False]
    assert values(spark, tx.is_back_matter, "致谢", "Preface") == [True, False]
    assert values(spark, lambda c: tx.chinese(c.cast("int")), "1", "10", "11", "20", "99", "100") == ["一", "十", "十一", "二十", "九十九", "100"]
    assert values(spark, tx.plain, "<p>a&nbsp;&lt;b&gt;</p>　<i>c</i>", None) == ["a <b> c", None]


def test_numbers_restart_below_each_chapter(spark):
    rows = [(1, i, level) for i, level in enumerate([2, 1, 2, 3, 3, 2, 3, 1, 2])]
    df = spark.createDataFrame(rows, "doc_id int, pos int, level int")
    got = lambda scheme: [r.number for r in structure.heading_numbers(df, scheme).orderBy("pos").collect()]
    assert got("decimal") == ["", "1.", "1.1", "1.1.1", "1.1.2", "1.2", "1.2.1", "2.", "2.1"]
    assert got("chinese-hierarchical") == ["", "一、", "（一）", "1.", "2.", "（二）", "1.", "二、", "（一）"]
    assert got("chapter")[1:4] == ["第一章", "第一节", "一、"]


def test_integrity_rules(spark):
    full = "<h2>a</h2>" + "<p>word word word word</p>" * 70 + "<img src=1><table ></table>"
    rows = [(1, full, full), (2, full, "<p>short</p>"), (3, "", "")]
    got = {r.id: r for r in quality.integrity(spark.createDataFrame(rows, "id int, a string, b string"), "id", "a", "b").collect()}
    assert (got[1].issues, got[1].retention, got[1].low_quality) == ("", 100, False)
    assert got[2].issues == "images:critical,tables:critical,paragraphs:critical,content:critical" and got[2].low_quality
    assert got[3].retention == 100


def test_diff_and_repetition(spark):
    pairs = spark.createDataFrame([(1, "The first sentence stands! The second one goes away!", "<p>The first sentence stands!</p>"), (2, "", "")], "id int, a string, b string")
    got = {r.id: r for r in quality.content_diff(pairs, "id", "a", "b").collect()}
    assert (got[1].removed, got[1].added, got[1].retention) == (1, 0, 50) and got[2].retention == 100
    texts = ["ab" * 40, "A sentence that comes again and again! " * 9, "".join(f"({i}) the same body text " for i in range(8)), "Nothing of the kind stands here.", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.char_spam, r.sentence_loop, r.same_body) for r in quality.repetition(rows).collect()}
    assert got[0][0] and got[1][1] and got[2][2] and got[3] == (False, False, False) and got[4] == (False, False, False)


def test_images_once_each(spark):
    rows = spark.createDataFrame([(1, "a __IMG_1__ b __IMG_1__ __IMG_7__ <img src='x'>", ["__IMG_1__", "__IMG_2__"])], "id int, html string, want array<string>")
    r = quality.images(rows, "id", "html", "want").first()
    assert (r.html, r.missing, r.duplicated) == ("a __IMG_1__ b   <p>__IMG_2__</p>", 1, 1)


def test_alignment_and_repair(spark):
    pairs = spark.createDataFrame([(1, ["one", "two", "one", "a longer title"], ["one", "one", "a longer titel!", "zzz"])], "doc_id int, outline array<string>, found array<string>")
    assert documents.aligned(pairs).first().matches == [0, 2, 3, -1]
    rows = spark.createDataFrame([("<p><b>x</p></i>",), (None,)], "html string")
    assert [r.html for r in documents.repaired(rows).collect()] == ["<p><b>x</b></p>", None]


def test_clamped_periods_drift(spark):
    row = spark.sql("SELECT date '2024-01-31' AS a, date '2024-05-01' AS now, cast(null AS date) AS none")
    got = row.select(billing.period_start(F.col("a"), F.col("now")).cast("string").alias("x"), billing.period_start(F.col("none"), F.col("now")).cast("string").alias("y")).first()
    assert (got.x, got.y) == ("2024-04-29", "2024-05-01")


def walked(hits, seconds, limit):
    state, out = {}, {}
    for i, k, at in sorted(hits, key=lambda h: (h[1], h[2], h[0])):
        start, n = state.get(k, (None, 0))
        if start is None or at >= start + seconds:
            start, n = at, 0
        state[k] = start, n + 1
        out[i] = n + 1 <= limit
    return out


def test_windows_from_the_first_hit(spark):
    rng = random.Random(1)
    hits = [(i, rng.randrange(3) if i % 2 else 0, rng.randrange(5000)) for i in range(3000)]
    df = spark.createDataFrame(hits, "id long, user long, at long").select("id", "user", F.timestamp_seconds("at").alias("ts"))
    got = {r.id: r.accepted for r in folds.limited(df, "user", 60, 4).collect()}
    assert got == walked(hits, 60, 4)


def test_stream_keeps_the_same_windows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(3)
    hits = sorted(((i, rng.randrange(4), rng.randrange(600)) for i in range(300)), key=lambda h: h[2])
    frame = pd.DataFrame(hits, columns=["id", "key", "at"]).assign(at=lambda d: d["at"] * 1_000_000)
    for part in range(3):
        spark.createDataFrame(frame.iloc[part * 100 : part * 100 + 100]).coalesce(1).write.parquet(str(tmp_path / f"in/part={part}"))
    stream = spark.readStream.schema("id long, key long, at long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    out = folds.limited_stream(stream, 60, 4).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    assert out.awaitTermination(240)
    assert {r.id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == walked(hits, 60, 4)


def test_sse_frames(spark):
    body = 'data: {"delta":"a"}\n\ndata: {broken\n\n: ping\n\ndata: {"text":"whole"}\n\ndata: {"delta":"!"}\n\ndata: {"done":true}\n\ndata: {"delta":"late"}'
    rows = folds.frames(spark.createDataFrame([("s", body), ("t", 'data: {"delta":"x"}')], "stream_id string, body string"))
    assert {r.stream_id: r.content for r in folds.folded(rows).collect()} == {"s": "whole!", "t": "x"}


def test_files(spark, tmp_path):
    (tmp_path / "A-1.html").write_text("one\ntwo")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(8))
    (tmp_path / "r.json").write_bytes("﻿{\"a\": 1}".encode())
    assert files.texts(spark, str(tmp_path / "A-1.html")).first().text == "one\ntwo"
    assert [r.name for r in files.listing(spark, str(tmp_path), "^[A-Z]+-.+[.]html$").collect()] == ["A-1.html"]
    assert files.images(spark, str(tmp_path / "b.png")).first().url.startswith("data:image/png;base64,iVBORw0KGgo")
    assert files.results(spark, str(tmp_path / "r.json"), "a int").first().a == 1
    raw = spark.read.format("binaryFile").load(str(tmp_path / "b.png"))
    assert raw.select(files.image_kind(F.col("content")).alias("k")).first().k == "png"
    rows = spark.createDataFrame([("a.doc", 1, "PRO"), ("b.docx", 150 << 20, "FREE"), ("b.docx", 150 << 20, "PRO")], "name string, size long, tier string")
    assert [r.tier for r in files.admitted(rows).collect()] == ["PRO"]


def test_skeleton_alignment_covers_every_line(spark):
    from leafmill.plans.documents import neighbours, skeleton_align

    sf = "/root/testdata/sf0.001"
    lines = {r.doc_id: r.n for r in neighbours(spark, sf).select("doc_id", F.size(F.split("a", "\n")).alias("n")).collect()}
    got = {r.doc_id: len(r.matches) for r in skeleton_align(spark, sf).collect()}
    assert got == lines and max(got.values()) > 40
