"""Benchmark decontamination by templates of word windows.

Texts are brought to a canonical form: punctuation goes, letters become small,
and numbers, units after numbers, and names (capitalised words that don't begin
a sentence) become typed placeholders. Windows of ``WINDOW`` words are hashed on
both sides and joined; windows of the bare words are a second key. Matches of one
alignment (place in the document less that in the item), and of alignments not
more than ``GAP`` apart, are an occurrence. What a placeholder stands for is a
slot: an occurrence holds only if each value of the question's slots stands for
one value in it throughout, so re-parameterised questions are found and chance
matches of templates with other fillings are not; one that has all the words of
the item holds in any case. Each pair is judged by its best occurrence.
Everything is DataFrame functions.

Edge cases: null and empty texts have no windows; items of fewer words than a
window give one window of all their words if they have at least ``LEAST``,
and none below that; windows of which less than half are plain words are
matched by their bare words only; repeated items are found each; rows that
repeat a doc_id or item_id are judged each by its own text, and the best result
is given; rows with a null doc_id or item_id are left out of the pairs, and
``keep`` keeps such documents. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import common

WINDOW, LEAST = 8, 5
#: A match is a leak from this share of the item's windows on, or this many windows.
SHARE, WINDOWS = 0.5, 6
#: Words that may be put in or left out within an occurrence.
GAP = 3
#: Rows of hashes or ids that are sent to every executor; beyond this count they are joined by a shuffle.
MAX_BROADCAST = 1_000_000
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
#: Units of measure and money that follow a number.
UNITS = "km|cm|mm|kg|mg|ml|kw|kwh|mph|kmh|hz|khz|mhz|ghz|gb|mb|kb|tb|miles|mile|meters|metres|meter|metre|feet|foot|inches|inch|pounds|pound|ounces|ounce|grams|gram|tons|ton|liters|litres|liter|litre|gallons|gallon|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|dollars|dollar|cents|cent|euros|euro|percent|degrees|degree|usd|eur|gbp|m|g|l|s|h|v|w|a"
PUNCTUATION = ".,;:!?\"'()[]{}<>*_#|`~^…«»“”„’‘–—"


def templates(text: Column) -> Column:
    """The canonical form of a text."""
    named = F.regexp_replace(text, r"(?<=[\p{L}\p{N},;][ \n])\p{Lu}[\p{L}\p{N}'’-]*", NAME)
    numbered = F.regexp_replace(named, r"[0-9]+(?:[.,][0-9]+)*", NUMBER)
    units = F.regexp_replace(numbered, rf"{NUMBER}( ?)(?i:{UNITS}|[%°])(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1{UNIT}")
    return F.lower(F.translate(units, PUNCTUATION, ""))


def words(text: Column) -> Column:
    """The words of a text without punctuation; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\x0B\f]+"), lambda w: w != "")


def windows_of(size: int, column: str, whole: bool) -> Column:
    """The hashes of the windows of the words hashed in ``column``, by place. (slice() for each would copy the array each time.)"""
    n, exact = F.size(column), F.lit(column == "__e")
    hashes = F.transform(column, lambda h, i: F.xxhash64(exact, h, *(F.get(column, i + k) for k in range(1, size))))
    if whole and size < WINDOW:  # a short text is one window
        return F.when(n == size, F.slice(hashes, 1, 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= size, F.slice(hashes, F.lit(1), n - size + 1)).otherwise(F.array().cast("array<bigint>"))


def word_hashes(column: str) -> Column:
    """Each word is hashed once, and its windows from the hashes."""
    return F.transform(column, lambda w: F.xxhash64(w))


def windows(rows: DataFrame, key: str, sizes: list[int], whole: bool = False) -> DataFrame:
    """(key, pos, size, exact, h, w): every window's place, length in words and hash, of the template and of the bare words.

    With ``whole``, a text of fewer words than a window is one window of its own.
    """
    own = rows.where(F.col(key).isNotNull()).select(key, words(templates(F.col("text"))).alias("__w"), words(F.lower(raw(F.col("text")))).alias("__b"))
    own = own.select(key, "__w", word_hashes("__w").alias("__t"), word_hashes("__b").alias("__e"))
    kinds = [(size, column) for size in sizes for column in ("__t", "__e")]
    # plain arrays of numbers, so that nothing is made for a window but its hash until it has matched
    spread = own.select(key, *(["__w"] if whole else []), F.posexplode(F.array(*(windows_of(*k, whole) for k in kinds))).alias("__k", "__hs"))
    taken = spread.select(key, *(["__w"] if whole else []), "__k", F.posexplode_outer("__hs").alias("pos", "h")).where("h is not null")
    known = lambda values: F.get(F.array(*map(F.lit, values)), F.col("__k"))
    size = known([size for size, _ in kinds])
    extra = [F.slice("__w", F.col("pos") + 1, size).alias("w")] if whole else []
    return taken.select(key, "pos", size.alias("size"), known([column == "__e" for _, column in kinds]).alias("exact"), "h", *extra)


def bounded(df: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if its count allows it."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, n_slots, consistent, leaked): every pair that shares a window."""
    # rows that repeat an id are told apart by their texts until the end
    docs = docs.where("doc_id is not null").select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("doc"), "text")
    benchmark = benchmark.where("item_id is not null").select(F.struct("item_id", F.xxhash64("text").alias("hash")).alias("item"), "text")
    items = windows(benchmark, "item", list(range(LEAST, WINDOW + 1)), whole=True)
    plain = F.size(F.filter("w", lambda w: ~w.rlike(f"[{NAME}{NUMBER}{UNIT}]")))
    items, _ = common.stage(items.where(F.col("exact") | (2 * plain >= F.col("size"))).drop("w"), "items")
    sizes = [r["size"] for r in items.select("size").distinct().collect()] or [WINDOW]  # four at most
    hashes, _ = common.stage(items.select("h").distinct(), "hashes")
    found, _ = common.stage(windows(docs, "doc", sizes).join(bounded(hashes), "h", "left_semi").distinct(), "found")
    # the words of both sides, for the few documents that matched
    ids, _ = common.stage(found.select("doc").distinct(), "ids")
    own = docs.join(bounded(ids), "doc", "left_semi")
    doc_words = own.groupBy("doc").agg(F.max("text").alias("text")).select("doc", words(templates(F.col("text"))).alias("t"), words(raw(F.col("text"))).alias("d"))
    item_words = benchmark.groupBy("item").agg(F.max("text").alias("text")).select("item", words(raw(F.col("text"))).alias("b"))
    pairs = found.select("doc", F.col("pos").alias("at"), "h").join(items.select("item", F.col("pos").alias("in"), "size", "exact", "h"), "h")
    shift = F.col("at") - F.col("in")
    by_shift = Window.partitionBy("doc", "item").orderBy("shift")
    apart = pairs.withColumn("shift", shift).withColumn("new", F.when(F.col("shift") - F.lag("shift").over(by_shift) > GAP, 1).otherwise(0))
    near = apart.withColumn("near", F.sum("new").over(by_shift))
    placed = near.withColumn("occurrence", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("shift").cast("long").alias("v")), F.struct(F.lit(1).alias("k"), F.col("near").alias("v")))))
    met = placed.groupBy("doc", "item", "occurrence").agg(F.collect_set(F.struct("at", "in", "size", "exact")).alias("m"))  # bounded by the item's windows and the document's
    both = met.join(doc_words, "doc").join(item_words, "item")
    steps = F.flatten(F.transform("m", lambda x: F.transform(F.sequence(F.lit(0), x["size"] - 1), lambda k: F.struct((x["at"] + k).alias("at"), (x["in"] + k).alias("in")))))
    slots = F.array_distinct(F.transform(F.filter(steps, lambda s: F.get("t", s["at"]).rlike(f"[{NAME}{NUMBER}{UNIT}]")), lambda s: F.struct(F.lower(F.get("b", s["in"])).alias("b"), F.lower(F.get("d", s["at"])).alias("d"))))
    totals = items.groupBy("item").agg(F.count_distinct("pos").alias("all_windows"), F.count_distinct(F.when(~F.col("exact"), F.col("pos"))).alias("template_windows"))
    seen = lambda exact: F.size(F.array_distinct(F.transform(F.filter("m", lambda x: x["exact"] == F.lit(exact)), lambda x: x["in"]))).cast("long")
    counted = both.select("doc", "item", seen(False).alias("n_template"), seen(True).alias("n_exact"), slots.alias("slots")).join(totals, "item")
    # a value of the question must stand for one value in the occurrence
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["b"])))
    by_words = (F.col("n_template") == 0) | (F.col("n_exact") * F.col("template_windows") > F.col("n_template") * F.col("all_windows"))
    n, total = (F.when(by_words, F.col(e)).otherwise(F.col(t)) for e, t in (("n_exact", "n_template"), ("all_windows", "template_windows")))
    coverage = F.round(n / total, 6)
    judged = counted.select("doc", "item", n.alias("n_windows"), total.alias("item_windows"), coverage.alias("coverage"), F.size("slots").cast("long").alias("n_slots"), (consistent | (F.col("n_exact") == F.col("all_windows"))).alias("consistent"))
    told = judged.withColumn("leaked", F.col("consistent") & ((F.col("coverage") >= SHARE) | (F.col("n_windows") >= WINDOWS)))
    best = told.groupBy("doc.doc_id", "item.item_id").agg(F.max(F.struct("leaked", "coverage", "n_windows", "consistent", "n_slots", "item_windows")).alias("x"))
    return best.select("doc_id", "item_id", *(f"x.{c}" for c in ("n_windows", "item_windows", "coverage", "n_slots", "consistent", "leaked")))


def raw(text: Column) -> Column:
    """A text without punctuation, word for word beside its template."""
    return F.translate(F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", ""), PUNCTUATION, "")


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak."""
    gone = matches(docs, benchmark).where("leaked").select("doc_id").distinct()
    gone, _ = common.stage(gone, "leaks")
    return docs.join(bounded(gone), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
