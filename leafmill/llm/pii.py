"""PII: patterns, and terms that give a protected entity away.

E-mail addresses, IP addresses, card and phone numbers are found by pattern.
Each value found is a protected entity. Terms (words of ``LETTERS`` letters and
more, without those inside e-mail addresses) and entities are counted over the
corpus, document by document and over whole texts: in how many documents each
stands, and in how many both do. A term discloses an entity if a document that
has the term has the entity with a chance of ``MIN_CHANCE`` at least, if that is
no accident (``MIN_EVIDENCE`` bits: how much likelier the counts are by that chance
than by the entity's share of all documents), and if the term stands in
``MIN_CONTEXTS`` different pairs of neighbouring words in documents with the
entity, so that copies of a text, near ones too, are no evidence. A frequent
entity takes more documents, but no entity and no table is out of reach.
Disclosing terms become spans of kind ``term`` wherever they occur. Everything is
DataFrame functions.

Only entities of ``MIN_CONTEXTS`` documents and more can be disclosed, so only
texts with one of these are read again for pairs; the pairs that remain by their
counts are few, and only these are looked up in the corpus.

Edge cases: a null text counts as empty, an empty one has no spans; rows that
repeat a doc_id are handled apart, unless their texts are equal too; null
doc_ids are carried along. Spans of different kinds may overlap; ``sanitised``
replaces the first of them and passes all other columns through. The patterns
are written so that no text, however long, makes them slow: possessive where
nothing needs to be given back, and tried only where a run of characters begins.
Places of matches are added up block by block (``spans.BLOCK``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common
from leafmill.llm.spans import SPAN, bounded, document_counts, occurrences, spans

KINDS = ("email", "ip", "card", "phone")
#: Letters of a term at least.
LETTERS = 2
#: What makes a term disclose an entity: different contexts, chance of the entity given the term, bits of evidence.
MIN_CONTEXTS, MIN_CHANCE, MIN_EVIDENCE = 3, 0.5, 16.0
#: What sanitised texts have in place of a span.
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole run of digits, each after one space or hyphen at most, of 16 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn test."""
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    parts = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10).cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def n_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def small_parts(value: Column) -> Column:
    """Whether all parts of a dotted number are 255 at most, whatever zeros they begin with."""
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, email, ip, card, phone): the spans of each kind, and what stands around each."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("text")
    found = text.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        "text",
        spans(t, EMAIL, t.contains("@")).alias("email"),
        F.filter(spans(t, IP), lambda s: small_parts(s["value"])).alias("ip"),
        F.filter(spans(t, CARD), lambda s: luhn(s["value"])).alias("card"),
        F.filter(spans(t, PHONE, t.contains("+")), lambda s: n_digits(s["value"]).between(8, 15)).alias("phone"),
    )

    entities = F.array_distinct(F.transform(F.concat(*KINDS), lambda s: F.lower(s["value"])))
    return found.select("doc_id", "text_hash", *KINDS, entities.alias("entities"))


def same_row(left: str, right: str) -> Column:
    """Whether two rows are of one document: by id, nulls too, and text."""
    return (F.col(f"{left}.text_hash") == F.col(f"{right}.text_hash")) & F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))


def words(text: Column) -> Column:
    """The words of a text outside e-mail addresses, in order; short ones too."""
    bare = F.when(text.contains("@"), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.filter(F.split(F.lower(bare), r"[^\p{L}]+"), lambda w: w != "")


def evidence(together: Column, n: Column, share: Column) -> Column:
    """Bits by which ``together`` of ``n`` documents are likelier at their own rate than at ``share``."""
    rate = together / n
    part = lambda k, p, q: F.when(k > 0, k * F.log2(p / q)).otherwise(0.0)
    return part(together, rate, share) + part(n - together, 1 - rate, F.greatest(1 - share, F.lit(1e-12)))


def disclosing(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(term, entity, together, n, contexts): the terms that give an entity away."""
    spark = docs.sparkSession
    each = base.where(F.size("entities") > 0).select("doc_id", "text_hash", F.explode("entities").alias("entity"))
    counted = each.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= MIN_CONTEXTS)
    frequent, frequent_path = common.stage(counted, "entities")
    kept = each.join(bounded(frequent).select("entity"), "entity", "left_semi").distinct()
    holders, holders_path = common.stage(kept.groupBy("doc_id", "text_hash").agg(F.collect_list("entity").alias("entities")), "holders")  # a document's entities
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    one = text.alias("t").join(bounded(holders).alias("h"), same_row("t", "h"))
    read, read_path = common.stage(one.select("h.entities", words(F.col("t.text")).alias("words")), "words")
    terms = read.select("entities", F.explode_outer(F.array_distinct("words")).alias("term")).where(F.length("term") >= LETTERS)
    pairs = terms.select("term", F.explode("entities").alias("entity")).groupBy("term", "entity").agg(F.count("*").alias("together"))
    # a term stands in the documents with any frequent entity at least: what is too frequent there needs no count over the corpus
    beside = terms.groupBy("term").agg(F.count("*").alias("n_beside"))
    joint = pairs.where(F.col("together") >= MIN_CONTEXTS).join(beside, "term").where(F.col("together") >= MIN_CHANCE * F.col("n_beside"))
    joint, joint_path = common.stage(joint.drop("n_beside"), "joint")
    asked, asked_path = common.stage(joint.select("term").distinct(), "terms")
    total = base.count()
    known = joint.join(document_counts(docs, asked, words), "term").join(bounded(frequent), "entity")
    enough = (F.col("together") >= MIN_CHANCE * F.col("n")) & (evidence(F.col("together"), F.col("n"), F.col("n_entity") / F.lit(float(max(total, 1)))) >= MIN_EVIDENCE)
    likely, likely_path = common.stage(known.where(enough).select("term", "entity", "together", "n"), "likely")
    # the neighbours of the terms that are left
    around = F.transform("words", lambda w, i: F.struct(w.alias("term"), F.xxhash64(F.get("words", i - 1), F.get("words", i + 1)).alias("context")))
    stands = read.select("entities", F.explode_outer(F.array_distinct(around)).alias("x")).select("entities", "x.term", "x.context")
    stands = stands.join(bounded(likely.select("term").distinct()), "term", "left_semi").select("term", "context", F.explode("entities").alias("entity")).distinct()
    contexts = stands.groupBy("term", "entity").agg(F.count("*").alias("contexts"))
    out, _ = common.stage(likely.join(contexts.where(F.col("contexts") >= MIN_CONTEXTS), ["term", "entity"]), "disclosing")
    for path in (frequent_path, holders_path, read_path, joint_path, asked_path, likely_path):
        common.unstage(spark, path)
    return out


def all_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, email, ip, card, phone, term): the spans of every document."""
    base, _ = common.stage(base_spans(docs), "spans")
    flagged = disclosing(docs, base).select("term").distinct()
    text = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    holders = occurrences(text, flagged, ["doc_id", "text_hash"], words).distinct().groupBy("doc_id", "text_hash").agg(F.array_join(F.sort_array(F.collect_list("term")), "|").alias("terms"))  # a document's words at most
    holders, _ = common.stage(holders, "holders")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("terms"), F.lit(r")(?!\p{L})"))
    terms = text.alias("t").join(bounded(holders).alias("h"), same_row("t", "h")).select(F.col("t.doc_id").alias("doc_id"), F.col("t.text_hash").alias("text_hash"), spans(F.col("t.text"), pattern).alias("term")).distinct()
    terms, _ = common.stage(terms, "term_spans")
    joined = base.alias("b").join(bounded(terms).alias("h"), same_row("b", "h"), "left")
    return joined.select("b.doc_id", "b.text_hash", *(f"b.{k}" for k in KINDS), F.coalesce("h.term", F.array().cast(SPAN)).alias("term"))


def named(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def placed(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(PLACEHOLDERS[kind]).alias("by"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind, then place."""
    return F.array_join(F.concat(*(F.transform(k, named(k)) for k in kinds)), ",")


def report(docs: DataFrame) -> DataFrame:
    """The query's columns: counts, digest of the base spans, and all spans."""
    found = all_spans(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(KINDS), 256).alias("base_sha256"), listed((*KINDS, "term")).alias("spans"), F.size("term").cast("long").alias("n_term"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` generalised to its kind."""
    found = all_spans(docs).distinct()
    every = F.sort_array(F.concat(*(F.transform(k, placed(k)) for k in (*KINDS, "term"))))
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), every.alias("__spans")).where(F.size("__spans") > 0)
    joined = docs.join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash")), "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), s["by"])
        return F.struct(F.when(fresh, s["end"]).otherwise(acc["at"]).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    text = F.aggregate("__spans", begin, cut, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    return joined.withColumn("text", F.when(F.col("__spans").isNotNull(), text).otherwise(F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns))
