"""Benchmark decontamination: copies and re-parameterised questions are found, others left alone."""

from leafmill.llm import decontaminate

ITEMS = [
    (1, "A train leaves Boston at 7 hours and travels 120 km to reach Denver before the second train which left 3 hours earlier. How far did Denver lie?"),
    (2, "Which of these metals is liquid at room temperature and has been used in thermometers for over two centuries now?"),
    (3, "short item"),
    (4, None),
    (None, "A question without an id stands here in more than eight words for the test."),
    (2, "Which of these metals is liquid at room temperature and has been used in thermometers for over two centuries now?"),
]
FILLER = "we walked along the river and talked about nothing in particular until the evening came and the lamps were lit "


def leaked(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect() if r.leaked}


def test_copies_and_new_parameters_are_found(spark):
    again = ITEMS[0][1].replace("120", "95.5").replace("Boston", "Lyon").replace("Denver", "Turin").replace("7 hours", "9 hours").replace("3 hours", "2 hours")
    twisted = ITEMS[0][1].replace("Denver before", "Turin before")  # the name no longer stands for one name throughout
    got = leaked(spark, [FILLER + ITEMS[0][1] + " " + FILLER, FILLER + again + FILLER, FILLER, FILLER + ITEMS[1][1].lower(), twisted])
    assert (0, 1) in got and (1, 1) in got and (3, 2) in got
    assert not any(d == 2 for d, _ in got) and (4, 1) not in got


def test_single_shared_window_is_no_leak(spark):
    assert leaked(spark, [FILLER + "which of these metals is liquid at room temperature one may ask " + FILLER]) == set()


def test_edge_cases(spark):
    rows = [(1, None, 5), (2, "", 5), (None, ITEMS[1][1], 5), (3, ITEMS[1][1], 5), (3, FILLER, 6), (4, FILLER, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int").selectExpr("*", "'q' as `a.b`")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.keep(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (True, 0)]
    assert decontaminate.keep(docs, items.limit(0)).count() == 6
    assert decontaminate.keep(docs.limit(0), items).count() == 0


def test_each_occurrence_is_judged_alone(spark):
    other = ITEMS[0][1].replace("Denver before", "Turin before").replace("120", "95")
    got = leaked(spark, [ITEMS[0][1] + " " + FILLER * 3 + other, other + " " + FILLER * 3 + ITEMS[0][1]])
    assert (0, 1) in got and (1, 1) in got


def test_items_of_names_and_numbers_are_found_verbatim(spark):
    text = "12 7 14 3 88 1 5 2 19 6"
    items = spark.createDataFrame([(1, text), (2, "The Last Emperor Of Old China")], "item_id long, text string")
    docs = spark.createDataFrame([(1, FILLER + text + " " + FILLER), (2, "of The Last Emperor Of Old China and"), (3, FILLER + text.replace("14", "15").replace("88", "81"))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect() if r.leaked} == {(1, 1), (2, 2)}


def test_rows_that_repeat_an_id_are_judged_by_their_own_texts(spark):
    twisted = ITEMS[0][1].replace("Denver before", "Turin before")
    for rows in ([(1, twisted), (1, FILLER)], [(1, FILLER + FILLER), (1, twisted)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        items = spark.createDataFrame([*ITEMS, (1, "Another question that carries the same number as the first one does here.")], "item_id long, text string")
        got = [r for r in decontaminate.matches(docs, items).collect() if (r.doc_id, r.item_id) == (1, 1)]
        assert len(got) == 1 and got[0].n_slots > 0 and not got[0].leaked
