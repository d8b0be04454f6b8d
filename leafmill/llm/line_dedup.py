"""Line dedup: passages of several lines that stand elsewhere first are removed, wherever in a line they begin and end.

A text is cut into units, its lines and the sentences within them; blank lines
belong to the unit before them. Each unit is hashed, and a rolling hash over
these hashes looks back from every unit over as many as have ``SPAN`` bytes
(``MOST`` units at most). A chunk is a run of such windows that the corpus holds
more than once and that lie one after another in an earlier place too, so its
boundaries follow from the contents alone and a shift moves them along. What is
in a chunk is then compared byte for byte with the first place (least doc_id,
then position), and so are the units beside it, word by word, since passages
may begin and end within a sentence: an edge of ``LEAST_CHARS`` characters, or
a whole unit, goes with the chunk. Chunks of ``MIN_CHARS`` characters in all are
removed. All else stays byte for byte, and so does the first place of every unit.

Hashes alone are moved to find chunks; the texts of the chunks and of the units
beside them are moved once to be compared, in blocks of ``BLOCK`` units of the
earlier place, so that a place that many documents repeat is moved a bounded
number of times; at last each text meets what is removed from it. Everything is
DataFrame functions.

Edge cases: null texts stay null, empty ones empty; a text that is removed whole
becomes empty and its row stays; rows with a null doc_id are left alone; rows
that repeat a doc_id are one document when first places are chosen, so rows that
are equal stay so. ``n_chars``, where the table has it, becomes the length of
the new text; other columns pass through, whatever their names. An empty table
gives no rows. No step takes time in the square of a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import common

#: Chunks of so many characters are removed; windows have the span, in bytes, and edges the least.
MIN_CHARS, SPAN, LEAST_CHARS = 120, 60, 20
#: Units of a window at most, and of a block of the earlier place.
MOST, BLOCK = 6, 16
#: Removed stretches that are sent to every executor; beyond this count they are joined by a shuffle.
MAX_BROADCAST = 1_000_000
DOC = ["doc_id", "text_hash"]
MARK = "\u0000"


def bare(text: Column) -> Column:
    """A unit without closing white space."""
    return F.rtrim(text, F.lit(" \n\r\t"))


def chunked(docs: DataFrame, out: str = "__parts") -> DataFrame:
    """``docs`` with ``out``: the units of ``text``, whose concatenation it is; null for null.

    Plain replacing and splitting at one mark is several times as fast as the
    pattern, which is left to texts that hold the mark themselves.
    """
    marked = F.col("text")
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    quick = F.split(F.replace(marked, F.lit(f"{MARK}\n"), F.lit("\n")), MARK)
    return docs.withColumn(out, F.when(F.contains("text", F.lit(MARK)), F.split("text", r"(?<=\n)(?!\n)|(?<=[.!?] )(?!\n)")).otherwise(quick))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) of the rows that take part."""
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, windows): for each unit the rolling hash of the window that ends with it (h) and its number of units (m)."""
    cut = chunked(texts(docs)).select(*DOC, "__parts")
    own = cut.select(*DOC, F.transform("__parts", lambda t: F.xxhash64(t)).alias("__own"), F.transform("__parts", lambda t: F.octet_length(t)).alias("__size"))

    def window(_: Column, i: Column) -> Column:
        size, hashes, found = F.lit(0), [], F.lit(None).cast("struct<m:tinyint,h:bigint>")
        cases = []
        for m in range(1, MOST + 1):
            size = size + F.get("__size", i - (m - 1))  # null before the first unit
            hashes.append(F.get("__own", i - (m - 1)))
            cases.append((size >= (SPAN if m < MOST else 1), F.struct(F.lit(m).cast("tinyint").alias("m"), F.xxhash64(*hashes).alias("h"))))
        for full, value in reversed(cases):
            found = F.when(full, value).otherwise(found)
        return found

    return own.select(*DOC, F.transform("__own", window).alias("windows"))


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, owner, owner_hash, shift, a, b): units a to b may equal those of the owner whose numbers are less by the shift."""
    spark = docs.sparkSession
    every, to = common.stage(windows(docs), "windows")
    # the outer forms of explode: the plain ones push a filter on the arrays down
    counted = every.select("doc_id", F.explode_outer("windows.h").alias("h")).where("h is not null").groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"))
    repeated, at = common.stage(counted.where("n > 1").select("h", "owner"), "repeated")
    rows = every.select(*DOC, F.posexplode_outer("windows").alias("no", "w")).select(*DOC, "no", "w.m", "w.h").where("h is not null")
    met, found = common.stage(rows.join(repeated.hint("merge"), "h"), "met")
    common.unstage(spark, to)
    common.unstage(spark, at)
    first = met.where("doc_id = owner").groupBy("h").agg(F.min(F.struct("no", "text_hash")).alias("f")).select("h", F.col("f.no").alias("first"), F.col("f.text_hash").alias("owner_hash"))
    first, places = common.stage(first, "first")  # as a table, so that the join can split the rows of a hot window
    copies = met.join(first.hint("merge"), "h").where("doc_id != owner or no != first").select(*DOC, "no", "m", "owner", "owner_hash", (F.col("no") - F.col("first")).alias("shift"))
    line = [*DOC, "owner", "owner_hash", "shift"]
    island = F.col("no") - F.dense_rank().over(Window.partitionBy(*line).orderBy("no"))
    out = copies.repartition(*DOC).withColumn("island", island).groupBy(*line, "island").agg(F.min(F.col("no") - F.col("m") + 1).alias("a"), F.max("no").alias("b"))
    out, _ = common.stage(out.select(*line, "a", "b"), "segments")
    common.unstage(spark, found)
    common.unstage(spark, places)
    return out


def pieces(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, owner, owner_hash, c, d, no, opens, closes, t, sizes, before, after): texts of segments, cut at the blocks of the owner.

    Each has the units that equal c to d of the owner's, and the units beside
    them. Rows without an owner are the texts that others are compared with.
    """
    cut = F.transform(F.sequence(F.floor((F.col("a") - F.col("shift")) / BLOCK), F.floor((F.col("b") - F.col("shift")) / BLOCK)), lambda k: F.struct(F.greatest(k * BLOCK, F.col("a") - F.col("shift")).cast("int").alias("c"), F.least(k * BLOCK + BLOCK - 1, F.col("b") - F.col("shift")).cast("int").alias("d")))
    mine = found.select("*", F.explode(cut).alias("x")).select(*DOC, F.struct("owner", "owner_hash", "x.c", "x.d", (F.col("x.c") + F.col("shift")).alias("no"), (F.col("x.c") + F.col("shift") == F.col("a")).alias("opens"), (F.col("x.d") + F.col("shift") == F.col("b")).alias("closes")).alias("piece"))
    kind = mine.schema["piece"].dataType
    asked = mine.select("piece.owner", "piece.owner_hash", "piece.c", "piece.d").distinct()
    none = F.lit(None)
    theirs = asked.select(F.col("owner").alias("doc_id"), F.col("owner_hash").alias("text_hash"), F.struct(none.cast(kind["owner"].dataType).alias("owner"), none.cast("bigint").alias("owner_hash"), "c", "d", F.col("c").alias("no"), F.lit(True).alias("opens"), F.lit(True).alias("closes")).alias("piece"))
    wanted = mine.unionByName(theirs).groupBy(*DOC).agg(F.collect_list("piece").alias("pieces"))  # a document's windows, and its blocks' parts, at most
    of = chunked(texts(docs).join(wanted.hint("shuffle_hash"), DOC)).select(*DOC, "pieces", "__parts")

    def row(x: Column) -> Column:
        units = F.slice("__parts", x["no"] + 1, x["d"] - x["c"] + 1)
        beside = lambda asks, no: F.when(asks, bare(F.get("__parts", no)))
        return F.struct(*(x[k].alias(k) for k in kind.names), F.array_join(units, "").alias("t"), F.when(x["owner"].isNotNull(), F.transform(units, lambda t: F.length(t))).alias("sizes"), beside(x["opens"], x["no"] - 1).alias("before"), beside(x["closes"], x["no"] + x["d"] - x["c"] + 1).alias("after"))

    return of.select(*DOC, F.explode_outer(F.transform("pieces", row)).alias("x")).select(*DOC, "x.*")


def agreed(mine: Column, other: Column, back: bool) -> Column:
    """How many characters two bare units agree in at their beginnings (``back``: their ends), in whole words.

    Fewer than ``LEAST_CHARS`` are none, unless it's the whole unit.
    """
    a, b = (F.split(x, " ") for x in (mine, other))
    if back:
        a, b = F.reverse(a), F.reverse(b)
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    n = F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")
    space = 0 if back else 1  # the words around a removed passage stay apart by the space before it
    size = F.least(F.length(F.array_join(F.slice(a, 1, n), " ")) + F.when(n > 0, space).otherwise(0), F.length(mine))
    begins = (lambda x: F.right(x, F.lit(LEAST_CHARS))) if back else (lambda x: F.left(x, F.lit(LEAST_CHARS)))
    alike = F.when(begins(mine) == begins(other), F.when(size >= LEAST_CHARS, size))
    return F.coalesce(F.when(mine == other, F.length(mine)), alike, F.lit(0))


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, cuts): in order, the stretches of units (a to b) that go.

    Each says too how many characters go at the end of the unit before it (tail)
    and at the beginning of the next (head), and has b and head of the stretch
    before it (last_b, last_head).
    """
    texts_of, to = common.stage(pieces(docs, segments(docs)), "pieces")
    place = ["owner", "owner_hash", "c", "d"]
    owned = texts_of.where("owner is null").select(F.col("doc_id").alias("owner"), F.col("text_hash").alias("owner_hash"), "c", "d", F.struct("t", "before", "after").alias("o")).dropDuplicates(place)
    owned, owners = common.stage(owned, "owned")  # a table for the same reason
    met = texts_of.where("owner is not null").join(owned.hint("merge"), place).where(F.col("t") == F.col("o.t"))
    tail, head = (F.when(F.col(asks), agreed(F.col(c), F.col(f"o.{c}"), c == "before")).otherwise(0) for asks, c in (("opens", "before"), ("closes", "after")))
    same = met.select(*DOC, F.col("no").alias("a"), (F.col("no") + F.col("d") - F.col("c")).alias("b"), "sizes", tail.alias("tail"), head.alias("head"))
    same, at = common.stage(same, "same")
    # stretches: pieces that overlap or touch, each unit counted once
    line = Window.partitionBy(*DOC).orderBy("a", "b")
    reach = F.coalesce(F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2))
    fresh = F.greatest(F.col("b") - F.greatest("reach", F.col("a") - 1), F.lit(0))
    chars = F.aggregate(F.slice("sizes", F.size("sizes") - fresh + 1, fresh), F.lit(0), lambda n, x: n + x)
    spread = same.repartition(*DOC).withColumn("reach", reach).withColumns({"chars": chars, "stretch": F.sum((F.col("a") > F.col("reach") + 1).cast("int")).over(line)})
    best = spread.groupBy(*DOC, "stretch").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("chars").alias("chars"), F.max(F.struct(-F.col("a"), "tail"))["tail"].alias("tail"), F.max(F.struct("b", "head"))["head"].alias("head"))
    whole = best.where(F.col("chars") + F.col("tail") + F.col("head") >= MIN_CHARS)
    line = Window.partitionBy(*DOC).orderBy("a")
    cuts = whole.withColumns({"last_b": F.coalesce(F.lag("b").over(line), F.lit(-1)), "last_head": F.coalesce(F.lag("head").over(line), F.lit(0))})
    out = cuts.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("a", "b", "tail", "head", "last_b", "last_head"))).alias("cuts"))
    out, _ = common.stage(out, "removed")
    for path in (to, at, owners):
        common.unstage(docs.sparkSession, path)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``."""
    gone = removed(docs).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("cuts").alias("__cuts"))
    n = gone.agg(F.sum(F.size("__cuts"))).first()[0] or 0
    side = F.broadcast(gone) if n <= MAX_BROADCAST else gone.hint("shuffle_hash")
    met = docs.join(side, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    cut = chunked(met.withColumn("__whole", F.col("text")).withColumn("text", F.when(F.col("__cuts").isNotNull(), F.col("text"))))

    def kept(x: Column) -> Column:
        """What stands between two stretches, without what the edges lose."""
        t = F.array_join(F.slice("__parts", x["last_b"] + 2, F.greatest(x["a"] - x["last_b"] - 1, F.lit(0))), "")
        n = F.when(x["tail"] > 0, F.length(bare(t)) - x["tail"]).otherwise(F.length(t))
        return F.substring(t, x["last_head"] + 1, F.greatest(n - x["last_head"], F.lit(0)))

    last = F.element_at("__cuts", -1)
    end = F.struct(F.size("__parts").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("tail"), F.lit(0).alias("head"), last["b"].alias("last_b"), last["head"].alias("last_head"))
    left = F.array_join(F.transform(F.concat("__cuts", F.array(end)), kept), "")
    out = cut.withColumn("text", F.when(F.col("__cuts").isNotNull(), left).otherwise(F.col("__whole")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cuts").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
