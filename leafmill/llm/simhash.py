"""SimHash near-duplicates through an inverted index on the bytes of fingerprints.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their
8 bytes, place by place. Postings of single bytes would hold a 256th of all
fingerprints each, so the index joins three places a posting: among any 5 of 8
places, 3 lie in the first or in the second half, hence the 8 triples within a
half find every such pair. Within a posting the shared bytes of each pair are
tallied, pairs with fewer than 5 are dropped and the rest is verified by its
differing bits. A posting gives a spanning forest of its links, never all pairs;
one with more than ``BLOCK`` fingerprints is dealt out in pairs of blocks.

That contract links only texts that are almost equal. ``similar`` takes the same
index to groups of texts of a given similarity: with wider fingerprints, more
places, a loose bound on the differing bits, and an exact check of the shingles.

Equal fingerprints are one node, so exact copies never meet each other. Edge
cases: null and empty texts, and texts without words, have fingerprint zero and
are linked like any other; texts of fewer words than a shingle are one shingle.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common
from leafmill.llm.components import components

SHINGLE, DISTANCE, BLOCK = 3, 3, 2048
#: For groups by similarity: shingles of so many words, bytes of a fingerprint.
WIDE_SHINGLE, WIDE, SIMILARITY = 5, 128, 0.8
#: Postings in which a pair right at the similarity meets on average, postings cut at a time, partners that are tried first.
MEETINGS, PASS, NEAREST = 4.7, 64, 4
#: Share of bits in which texts of five shingles differ of which one has four (the most at 0.8, as ties count as zero).
SHORTEST = 3 / 16
#: Keys that are sent to every executor; beyond this count they are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: The triples of byte places within a half.
PLACES = [t for half in (range(4), range(4, 8)) for t in itertools.combinations(half, 3)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, unsigned: bits set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.array([digest(join(t), 42) for t in zip(*(words[i:] for i in range(shingle)))], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    common.prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(found.view(np.int64))}

    return common.per_batch(docs.select("doc_id", "text"), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that join what is within ``distance`` bits in a posting: breadth first, each fingerprint reached once."""
    least = 8 - distance  # shared bytes that such a pair has for certain
    left, edges = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            apart = (left ^ at).view(np.uint64)  # of signed numbers, bitwise_count would count those of the absolute value
            tally = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = (tally >= least) & (np.bitwise_count(apart) <= distance)
            if near.any():
                hit, left = left[near], left[~near]
                edges += [(int(at), int(x)) for x in hit]
                queue.extend(hit)
    return edges


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that keep every component whole."""
    if distance > 3:
        raise ValueError("the triples of places find differences of up to 3 bits")
    spark = fps.sparkSession
    masks = [sum(0xFF << 8 * p for p in places) for places in PLACES]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    postings = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)))).alias("p")).select("fp", "p.g", "p.k")
    sizes = postings.groupBy("g", "k").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = postings.join(sizes, ["g", "k"]).withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = met.select("g", "k", "fp", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"))
    groups = dealt.groupBy("g", "k", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi")).agg(F.collect_list("fp").alias("fps"))

    def work(batch: pa.RecordBatch) -> dict:
        found = [e for x in batch.column(0) for e in forest(np.unique(np.asarray(x.values, np.int64)), distance)]
        u, v = zip(*found) if found else ((), ())
        return {"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())}

    common.prepare(spark)
    return common.per_batch(groups.select("fps"), work, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id that links reach."""
    prints, _ = common.stage(fingerprints(docs, shingle), "fingerprints")
    nodes, _ = common.stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots, _ = common.stage(components(links(nodes, distance)), "roots")
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named, _ = common.stage(placed.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hexed(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, fingerprint as 16 lower-case hex digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The hashes of the distinct shingles of a text, ascending; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    windows = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    return np.sort(np.array(list({digest(join(t), 42) for t in windows}), np.uint64))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """A SimHash of 8 * WIDE bits over the distinct shingles of a text; zeros if it has none."""
    ones = np.zeros(8 * WIDE, np.int64)
    salts = np.arange(1, WIDE // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 255):  # so many fit a byte's count
        z = h[at : at + 255, None] + salts
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += np.add.reduce(np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def angle(similarity: float) -> float:
    """The share of bits in which texts of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def allowed(similarity: float, n: Any, least: Callable = np.minimum, root: Callable = np.sqrt) -> Any:
    """Differing bits that hardly any pair of this similarity exceeds, n shingles being in the smaller text: four deviations beyond the mean.

    With the functions of Spark for ``least`` and ``root``, n is a column.
    """
    base = angle(similarity)
    apart = base + max(SHORTEST - base, 0.0) * least(5 / n, n * 0 + 1)
    return 8 * WIDE * apart + 4 * root(8 * WIDE * apart * (1 - apart))


def triples(n: int, similarity: float) -> np.ndarray:
    """The byte places of the postings for n fingerprints: as many bytes a posting as keep chance meetings below one a text, and as many postings as a pair of this similarity meets in ``MEETINGS`` of them on average."""
    each = max(3, math.ceil(math.log2(max(n, 1)) / 8))
    postings = math.ceil(MEETINGS / (1 - angle(similarity)) ** (8 * each))
    return np.random.default_rng(7).permuted(np.tile(np.arange(WIDE), (postings, 1)), axis=1)[:, :each]


def postings(nodes: DataFrame, places: np.ndarray, first: int) -> DataFrame:
    """(node, key): the postings of fingerprints at these places; ``first`` is the number of the first of them."""
    each = places.shape[1]

    def work(batch: pa.RecordBatch) -> dict:
        fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WIDE).astype(np.int64)
        keys = np.tile(np.arange(first, first + len(places), dtype=np.int64) << 8 * each, (len(fps), 1))
        for k in range(each):
            keys |= fps[:, places[:, k]] << 8 * k
        return {"node": pa.array(np.repeat(batch.column(0).to_numpy(), len(places))), "key": pa.array(keys.reshape(-1))}

    return common.per_batch(nodes.select("node", "fp"), work, "node long, key long")


def meetings(nodes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """((key, node) of postings of three and more, (u, v) with the least node of each posting), pass by pass, so that a part of the postings is on disk at a time."""
    places = triples(nodes.count(), similarity)
    spread = nodes.repartition("node")
    met, pairs = [], []
    for at in range(0, len(places), PASS):
        own = postings(spread, places[at : at + PASS], at)
        centres = own.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre"), F.max("node").alias("last")).where("n > 1")
        centres, _ = common.stage(centres, "centres")
        many = centres.where("n > 2").select("key", "centre")  # a posting of two is known by its least and largest
        some, _ = common.stage(own.join(common.bounded(many, MAX_BROADCAST), "key"), "met")
        met.append(some.select("key", "node"))
        pairs += [some.where("node != centre").select(F.col("centre").alias("u"), F.col("node").alias("v")), centres.where("n = 2").select(F.col("centre").alias("u"), F.col("last").alias("v"))]
    return reduce(DataFrame.union, met), reduce(DataFrame.union, pairs).distinct()


def longs_of(fp: str) -> Column:
    """A wide fingerprint as an array of longs."""
    return F.transform(F.sequence(F.lit(0), F.lit(WIDE // 8 - 1)), lambda i: F.conv(F.hex(F.substring(fp, 8 * i + 1, F.lit(8))), 16, -10).cast("long"))


def close(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose fingerprints and numbers of shingles allow the similarity."""
    bits = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    own = nodes.select("node", longs_of("fp").alias("a"), "n")
    both = pairs.join(own.select(F.col("node").alias("u"), "a", "n"), "u").join(own.select(F.col("node").alias("v"), F.col("a").alias("b"), F.col("n").alias("m")), "v")
    return both.where((F.least("n", "m") >= similarity * F.greatest("n", "m")) & (bits <= allowed(similarity, F.greatest(F.least("n", "m"), F.lit(1)).cast("double"), F.least, F.sqrt))).select("u", "v")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(u, v): the staged ``pairs`` whose sets of shingles have the similarity, exactly."""
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes.select("node", "doc_id", "text_hash"), "node")
    asked, to = common.stage(asked, "asked")

    def work(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column(0), "s": pa.array([shingles(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))}

    texts = docs.join(common.bounded(asked, MAX_BROADCAST), ["doc_id", "text_hash"]).select("node", "text")
    sets, at = common.stage(common.per_batch(texts, work, "node long, s array<long>").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    total = F.size("a") + F.size("b") - shared
    found, _ = common.stage(both.where((total == 0) | (shared / total >= similarity)).select("u", "v"), "links")
    common.unstage(docs.sparkSession, to)
    common.unstage(docs.sparkSession, at)
    return found


def nearest(seeds: np.ndarray, nodes: np.ndarray, labels: np.ndarray, fps: np.ndarray, sizes: np.ndarray, similarity: float, most: int) -> list[tuple[int, int | None]]:
    """For each seed (a row's number) the ``most`` nearest of another label that may be similar enough; (seed, None) if there are more."""
    found: list[tuple[int, int | None]] = []
    for x in seeds:
        apart = np.bitwise_count(fps ^ fps[x]).sum(axis=1, dtype=np.int64)
        less = np.minimum(sizes, sizes[x])
        fits = (labels != labels[x]) & (apart <= allowed(similarity, np.maximum(less, 1))) & (less >= similarity * np.maximum(sizes, sizes[x]))
        at = np.flatnonzero(fits)
        if len(at) > most:
            at = at[np.argsort(apart[at], kind="stable")[:most]]
            found.append((int(nodes[x]), None))
        found += [(int(nodes[x]), int(nodes[y])) for y in at]
    return found


def crossing(met: DataFrame, labels: DataFrame, nodes: DataFrame, similarity: float, most: int, block: int = BLOCK) -> DataFrame:
    """(u, v): of postings that hold several labels, each member beyond the least label with its nearest of other labels."""
    tagged, _ = common.stage(met.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label")), "tagged")
    open_keys = tagged.groupBy("key").agg(F.min("label").alias("home"), F.max("label").alias("top"), F.count("*").alias("n")).where("home != top").drop("top")
    members = tagged.join(open_keys, "key").withColumn("seed", F.col("label") != F.col("home"))
    counted = members.where("seed").groupBy("key").agg(F.count("*").alias("n_seeds"))
    blocks, others = (F.ceil(F.col(c) / block).cast("int") for c in ("n", "n_seeds"))
    dealt = members.join(counted, "key").join(nodes.select("node", "fp", F.col("n").alias("size")), "node").withColumns({"blocks": blocks, "others": others})
    own, other = (F.pmod(F.xxhash64("node"), F.col(c)).cast("int") for c in ("blocks", "others"))
    spread = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    one = F.transform(spread("others"), lambda k: F.struct(own.alias("g"), k.alias("s"), F.lit(False).alias("asks")))
    two = F.when(F.col("seed"), F.transform(spread("blocks"), lambda k: F.struct(k.alias("g"), other.alias("s"), F.lit(True).alias("asks"))))
    rows = dealt.select("key", "node", "label", "fp", "size", F.explode(F.concat(one, F.coalesce(two, F.array().cast("array<struct<g:int,s:int,asks:boolean>>")))).alias("x"))
    groups = rows.groupBy("key", "x.g", "x.s").agg(F.collect_list(F.struct("node", "label", "fp", "size", "x.asks")).alias("m"))

    def work(batch: pa.RecordBatch) -> dict:
        found: list[tuple[int, int | None]] = []
        for m in batch.column(0):
            rows = m.as_py()
            fps = np.frombuffer(b"".join(r["fp"] for r in rows), np.uint64).reshape(-1, WIDE // 8)
            asks, *columns = (np.array([r[k] for r in rows]) for k in ("asks", "node", "label", "size"))
            found += nearest(np.flatnonzero(asks), columns[0], columns[1], fps, columns[2], similarity, most)
        u, v = zip(*found) if found else ((), ())
        return {"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())}

    return common.per_batch(groups.select("m"), work, "u long, v long")


def wide_links(nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, most: int = NEAREST) -> DataFrame:
    """(u, v): each of the staged ``nodes`` with the least node of its component, as links verified by the shingles themselves join them.

    Each member of a posting is held against the least of it. What stays apart is
    then held against its nearest of other components, and if these fail against
    more and more of them, until no pair that may be similar is left untested;
    what has been joined meanwhile needs no test.
    """
    met, pairs = meetings(nodes, similarity)
    tested, _ = common.stage(close(pairs, nodes, similarity), "tested")
    links = verified(tested, nodes, docs, similarity, shingle)
    labels, stale = None, True
    while True:
        if stale:
            labels, _ = common.stage(components(links), "labels")
            links = labels.select(F.col("node").alias("u"), F.col("root").alias("v"))  # the same components in fewer rows
        found, _ = common.stage(crossing(met, labels, nodes, similarity, most), "crossing")
        fresh = found.where("v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(tested, ["u", "v"], "left_anti")
        fresh, _ = common.stage(fresh, "fresh")
        stale = False
        if not fresh.isEmpty():
            more = verified(fresh, nodes, docs, similarity, shingle)
            tested, stale = tested.union(fresh), not more.isEmpty()
            links = links.union(more)
        if not stale and found.where("v is null").isEmpty():
            return links
        most *= 64


def similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """(doc_id, component_id): groups of texts linked by a Jaccard similarity of their sets of five-word shingles.

    Candidates meet in postings of bytes of wide fingerprints: a pair right at
    the similarity misses all with a chance of about 1 in 100 (MEETINGS), one of
    very short texts somewhat oftener. Those whose bits allow it are verified
    exactly. Rows without a doc_id are left out.
    """
    common.prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, shingle) for t in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "text_hash": batch.column(1), "fp": pa.array(map(wide_fingerprint, sets), pa.binary()), "n": pa.array(map(len, sets), pa.int32())}

    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    prints, _ = common.stage(common.per_batch(own, work, "doc_id long, text_hash long, fp binary, n int"), "prints")
    # texts with equal fingerprints and numbers of shingles are one node
    node = F.xxhash64("fp", "n")
    first = prints.groupBy("fp", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("f"))
    nodes, _ = common.stage(first.select(node.alias("node"), "fp", "n", "f.doc_id", "f.text_hash"), "nodes")
    # rows that repeat a doc_id with other texts hang together as one document
    placed = prints.select("doc_id", node.alias("node"))
    again = placed.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("top")).where("u != top")
    same = placed.join(common.stage(again, "again")[0], "doc_id").select("u", F.col("node").alias("v")).where("u != v")
    roots, _ = common.stage(components(wide_links(nodes, own, similarity, shingle).union(same)), "roots")
    named = placed.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    least, _ = common.stage(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(least, "root").select("doc_id", "component_id")


def keep(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of similar texts, the one with the smallest doc_id; rows without a doc_id stay.

    Empty texts and texts without words are one group. Rows that repeat a
    doc_id are one document: all of them stay, or none.
    """
    gone, _ = common.stage(similar(docs, similarity).where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct(), "copies")
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("__gone"), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
