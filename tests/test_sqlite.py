"""SQLite files: types, ranges of row ids, missing tables, copies with their counts."""

import sqlite3

import pytest

from leafmill.sources import files, sqlite


@pytest.fixture
def file(tmp_path):
    path = str(tmp_path / "old.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "User" (id INTEGER PRIMARY KEY, email VARCHAR(20), score REAL, raw BLOB, createdAt DATETIME, "odd ""name" TEXT)')
        db.executemany('INSERT INTO "User" VALUES (?, ?, ?, ?, ?, ?)', [(i * 3, f"u{i}@x.org" if i % 2 else None, i / 2, bytes([i % 256]), ["2024-01-30 10:00:00", "no date", None, 1706608800000][i % 4], "é") for i in range(1000)])
        db.execute("INSERT INTO \"User\" VALUES (5000, 'text', 'not a number', 'text', '', 7)")
        db.execute("CREATE TABLE pairs (a TEXT, b TEXT, PRIMARY KEY (a, b)) WITHOUT ROWID")
        db.execute("INSERT INTO pairs VALUES ('x', 'y')")
        db.execute("CREATE TABLE empty (a INT)")
    return path


def test_rows_and_types(spark, file):
    df = sqlite.table(spark, file, "User", 7)
    assert dict(df.dtypes) == {"id": "bigint", "email": "string", "score": "double", "raw": "binary", "createdAt": "string", 'odd "name': "string"}
    assert df.rdd.getNumPartitions() == 7
    rows = {r["id"]: r for r in df.collect()}
    assert len(rows) == 1001 and rows[3]["email"] == "u1@x.org" and rows[0]["email"] is None and rows[6]["score"] == 1.0 and rows[9]["raw"] == b"\x03"
    assert rows[5000]["score"] is None and rows[5000]["raw"] == b"text" and rows[5000]['odd "name'] == "7"
    assert [tuple(r) for r in sqlite.table(spark, file, "pairs").collect()] == [("x", "y")] and sqlite.table(spark, file, "empty").count() == 0
    assert sqlite.exists(file, "User") and not sqlite.exists(file, "Order")


def test_copies_are_counted_and_bad_dates_replaced(spark, file, tmp_path):
    to = str(tmp_path / "new")
    report = sqlite.migrated(spark, file, to, {"User": ["createdAt"], "Order": ["createdAt"], "pairs": []}, "2024-02-01 00:00:00")
    assert sorted(map(tuple, report.collect())) == [("User", 1001, 1001, True), ("pairs", 1, 1, True)]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = {r["id"]: r["at"] for r in spark.read.parquet(f"{to}/User").selectExpr("id", "cast(createdAt as string) at").collect()}
    assert got[0] == "2024-01-30 10:00:00" and got[3] == got[6] == got[5000] == "2024-02-01 00:00:00" and got[9] == "2024-01-30 10:00:00"


def test_appended_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, part string")
    for _ in range(2):
        files.append(rows, str(tmp_path / "t"), "part")
    assert sorted((r["id"], r["part"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]
