"""The pipeline over tables with nulls, repeated rows, clashing columns, and without rows."""

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, h string"


def tables(spark, folder, docs):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 1, 0), (6, 1, 0), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "Which of these metals is liquid at room temperature and has been used in thermometers?"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def row(i, text):
    return (i, text, "en", None, None if text is None else len(text), "s", "p", "h")


@pytest.mark.parametrize("empty", [False, True])
def test_edges(spark, tmp_path, empty):
    words = lambda k: " ".join(f"w{k}x{j * j % 97}y{j}" for j in range(60)) + "."
    leak = words(8) + " Which of these metals is liquid at room temperature and has been used in thermometers? " + words(9)
    docs = [row(1, words(1)), row(2, None), row(3, ""), row(4, words(4)), row(5, words(4)), row(6, words(6)), row(6, words(6)), row(None, words(7)), row(8, leak), row(9, "long " * 30_000)]
    tables(spark, str(tmp_path), [] if empty else docs)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    if empty:
        assert got == []
    else:
        assert 8 not in ids and {1, 4} <= ids  # the leak goes, clean documents stay
        assert None in ids and 9 in ids
