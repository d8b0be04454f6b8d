"""Line dedup against a plain version, and its edge cases."""

import random
import re

from leafmill.llm import line_dedup


def passage(rng, n):
    return " ".join(rng.choice("red green blue black white grey pink teal".split()) + str(rng.randrange(900)) for _ in range(n))


def text_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    return {r.doc_id: r for r in line_dedup.dedup(docs).collect()}


def test_chunks_concatenate_to_the_text(spark):
    texts = ["one. two! three\nfour\n\nfive", "", "\n", "no end", "a. b. c. d. e. f. g."]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in line_dedup.chunked(docs).collect():
        assert "".join(r["__parts"]) == r["text"]


def test_boundaries_resist_shifts(spark):
    rng = random.Random(4)
    lines = [passage(rng, 6) + ". " for _ in range(200)]
    docs = spark.createDataFrame([("".join(lines),), ("Something new stands here. " + "".join(lines),)], "text string")
    a, b = (r["__parts"] for r in line_dedup.chunked(docs).collect())
    assert len(set(a) - set(b)) <= 2


def test_repeated_passages_go_and_the_first_place_stays(spark):
    rng = random.Random(8)
    shared = "\n".join(passage(rng, 15) for _ in range(6)) + "\n"
    own = {i: passage(rng, 40) + "\n" for i in range(8)}
    rows = [(i, own[i] + shared + f"end {i} of its own\n", 0) for i in range(8)]
    got = text_of(spark, rows)
    assert got[0].text == rows[0][1]
    for i in range(1, 8):
        assert got[i].text == own[i] + f"end {i} of its own\n"
        assert got[i].n_chars == len(got[i].text)


def test_clean_documents_are_untouched(spark):
    rng = random.Random(9)
    rows = [(i, f"{passage(rng, 60)}. {passage(rng, 50)}\n{passage(rng, 30)}\n", 3) for i in range(30)]
    got = text_of(spark, rows)
    assert all(got[i].text == t and got[i].n_chars == 3 for i, t, _ in rows)


def test_single_short_lines_stay(spark):
    got = text_of(spark, [(1, "Thank you for reading.\nalpha one\n", 0), (2, "Thank you for reading.\nbeta two\n", 0)])
    assert re.match("Thank you", got[2].text)


def test_edge_cases(spark):
    long = "The very same words stand in this line, which is long enough to be taken for a passage of its own, as all of us can see.\n" * 2
    rows = [(1, None, None), (2, "", 0), (3, long, 1), (4, long, 1), (None, long, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumnsRenamed({"doc_id": "doc_id"})
    extra = docs.selectExpr("*", "'x' as `owner`", "'y' as `h`", "'z' as `met.t`")
    got = {r.doc_id: r for r in line_dedup.dedup(extra).collect()}
    assert got[1].text is None and got[2].text == "" and got[None].text == long and got[None].n_chars == 7
    assert got[4].text == "" and got[4].n_chars == 0 and got[4]["met.t"] == "z"
    assert got[3].text == long[: len(long) // 2]  # its second line repeats the first
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_passages_within_a_paragraph_go(spark):
    rng = random.Random(12)
    shared = "tail of a sentence " + " ".join(passage(rng, 12) + "." for _ in range(4)) + " and the head of another sentence that"
    rows = [(i, f"{passage(rng, 30)}. {passage(rng, 7)} {shared} {passage(rng, 9)}. {passage(rng, 20)}\n", 0) for i in range(12)]
    got = text_of(spark, rows)
    assert got[0].text == rows[0][1]
    for i, t, _ in rows[1:]:
        a = t.index(shared)
        left = t[:a] + t[a + len(shared) :]
        assert abs(len(got[i].text) - len(left)) <= line_dedup.LEAST_CHARS + 1 and got[i].text.split()[:37] == left.split()[:37]


def test_passages_of_short_and_blank_lines_go(spark):
    rng = random.Random(13)
    shared = "\n\n".join(passage(rng, 2) for _ in range(20)) + "\n"
    rows = [(i, passage(rng, 40) + "\n" + shared + passage(rng, 40) + "\n", 0) for i in range(3)]
    got = text_of(spark, rows)
    assert got[0].text == rows[0][1]
    assert all(shared[40:] not in got[i].text and len(got[i].text) < len(rows[i][1]) - len(shared) + 40 for i in (1, 2))
