"""Token ids in binary files: canonical length-limited Huffman coding in independent blocks.

Texts are encoded by a public tokenizer, an end id follows each, and the ids are
written in ascending doc_id order. The code comes from the counts of all ids;
no code word is longer than ``MAX_BITS`` (package-merge gives the best such
lengths), and the words are canonical, so the code book stores lengths alone.

The file format is a folder with two tables. ``codebook`` has a row for each
id that occurs: id, bits. ``blocks`` has a row for each block: part (the
range of doc_id it belongs to), block (its number in the part), n_ids, before
(ids of the part before it) and payload:

    magic "LMH1", then little-endian: uint32 documents, uint64 ids, uint32
    checkpoints, uint64 bits; int64 doc_id and uint32 count of each document;
    uint64 bit offset of each checkpoint (every ``STRIDE`` ids); the code
    words, most significant bit first, padded with zeros.

A block holds whole documents and is decoded alone: all stretches between its
checkpoints advance together, each step one table look-up for every stretch.

Edge cases: a null or empty text has the end id only; repeated doc_ids stay
separate documents; an id that occurs alone gets one bit; an empty table gives
an empty folder and no rows. Rows with a null doc_id come first.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import common

MAX_BITS, STRIDE, BLOCK_IDS = 20, 128, 1 << 16
#: Words, and their letters without the marks around them, whose ids a worker keeps (about 250 MB).
MAX_WORDS, MAX_CORES = 600_000, 600_000
#: Marks that are split off a word's ends: ASCII, without what begins a contraction or a special token.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
HEAD = struct.Struct("<4sIQIQ")
NULL_ID = -(1 << 63)


class Tokens:
    """A tokenizer of the tokenizers library, with a memory of words.

    The tokenizers here drop white space and never join across it, so a text's
    ids are those of the stretches between spaces and line feeds. From a stretch
    that isn't known yet the marks at its ends are split off if letters alone
    stay, and ASCII letters become small, as the tokenizer would make them. What
    is then unknown goes to the library, many words as one text; the end-of-word
    tokens that close each piece tell the words apart.
    """

    made: dict[str, Tokens] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.width = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that close a piece
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def looked_up(self, plain: list[str], other: list[str]) -> dict[str, bytes]:
        """What the library makes of words: those of letters alone as one text, each of them one piece."""
        out = {}
        for at in range(0, len(plain), 8192):
            some = plain[at : at + 8192]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, self.width)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                data = ids.tobytes()
                size = ids.itemsize
                out.update({w: data[size * a : size * b] for w, a, b in zip(some, [0, *cuts.tolist()], cuts.tolist())})
            else:  # small letters of some alphabets hold marks, which are pieces of their own
                other = other + some
        for at in range(0, len(other), 512):
            some = other[at : at + 512]
            out.update({w: np.array(e.ids, self.width).tobytes() for w, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False))})
        return out

    def looked_over(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't kept; they are kept as long as there is room, and so are their letters."""
        parts = [("", w.lower() if w.isascii() else w, "") if w.isalpha() else parted(w) for w in words]
        new = set(itertools.chain.from_iterable(parts)).difference(self.cores)
        fresh = self.looked_up([x for x in new if x.isalpha()], [x for x in new if not x.isalpha()])
        cores = ChainMap(fresh, self.cores) if len(self.cores) >= MAX_CORES else self.cores
        if cores is self.cores:
            self.cores.update(fresh)
        found = {w: cores[a] + cores[b] + cores[c] if a or c else cores[b] for w, (a, b, c) in zip(words, parts)}
        self.known.update(itertools.islice(found.items(), max(0, MAX_WORDS - len(self.known))))
        return found

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with the end id, and how many each text has).

        A batch's words are told apart once; then each word's ids are copied to its places.
        """
        stretches = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = stretches.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
        known = self.known
        found = self.looked_over([w for w in names if w not in known])
        own = pa.array([known[w] if w in known else found[w] for w in names], pa.large_binary()).take(coded.indices)
        _, offsets, data = own.buffers()
        size = np.dtype(self.width).itemsize
        ends = np.frombuffer(offsets, np.int64, len(own) + 1) // size if len(own) else np.zeros(1, np.int64)
        ids = np.frombuffer(data, self.width, ends[-1]) if ends[-1] else np.zeros(0, self.width)
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(stretches).to_numpy())])]
        closed = np.insert(ids.astype(np.promote_types(self.width, np.min_scalar_type(end))), bounds[1:], end)
        return closed, np.diff(bounds) + 1


def parted(word: str) -> tuple[str, str, str]:
    """The marks before a word, its letters, and the marks after it; words of another form stay whole, in the middle.

    The letter at the end must be one that stays a letter when it is made small
    and composed, else its own mark would join those that follow.
    """
    core = word.strip(MARKS)
    if not core.isalpha():
        return "", word, ""
    small = core.lower() if core.isascii() else core
    if len(core) == len(word):
        return "", small, ""
    if core[-1] >= "\u0250" or core[-1] == "\u0130":
        return "", word, ""
    at = len(word) - len(word.lstrip(MARKS))
    return word[:at], small, word[at + len(core) :]


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, n, width, ids): the ids of every text, the end id last, as little-endian integers of so many bytes."""
    common.prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> dict:
        ids, counts = Tokens.of(path).encode(batch.column(1), end)
        bounds = np.concatenate([[0], np.cumsum(counts)]) * ids.itemsize
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids.tobytes())])
        return {"doc_id": batch.column(0).cast(pa.int64()), "n": pa.array(counts, pa.int64()), "width": pa.array(np.full(len(counts), ids.itemsize, np.int32)), "ids": flat.cast(pa.binary())}

    return common.per_batch(docs.select("doc_id", "text"), work, "doc_id long, n long, width int, ids binary")


def widen(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, f"<u{width}").astype(np.uint32)


def counted(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents: each task adds up its own first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for width, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.bincount(widen(ids, width))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return tokens.select("width", "ids").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Best code word lengths of at most ``limit`` bits, by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        row = np.concatenate([weights, packages])
        rank = np.argsort(row, kind="stable")
        levels.append(rank < n)  # which of the merged list are ids
        row = row[rank]
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_id in reversed(levels):
        own = int(is_id[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: words ascend by length, then by id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray) -> None:
        self.width = int(bits.max()) if len(bits) else 1
        size = int(ids.max()) + 1 if len(ids) else 0
        order = np.lexsort((ids, bits))
        ids, bits = ids[order], bits[order]
        steps = np.uint64(1) << (self.width - bits).astype(np.uint64)
        first = np.concatenate([[0], np.cumsum(steps)[:-1]]).astype(np.uint64)
        self.bits, self.words = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.bits[ids] = bits
        self.words[ids] = first >> (self.width - bits).astype(np.uint64)
        self.table = np.zeros(1 << self.width, np.uint32)  # window to id
        filled = np.repeat(ids.astype(np.uint32), steps.astype(np.int64))
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """(code words, bit offset of each checkpoint, bits)."""
        bits, words = self.bits[ids], self.words[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        cell, over = starts >> 6, (starts & 63) + bits - 64
        high = np.where(over <= 0, words << np.maximum(0, -over).astype(np.uint64), words >> np.maximum(0, over).astype(np.uint64))
        out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        heads = np.flatnonzero(np.diff(cell, prepend=-1))
        out[cell[heads]] = np.bitwise_or.reduceat(high, heads)
        split = over > 0
        out[cell[split] + 1] |= words[split] << (64 - over[split]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::STRIDE], int(ends[-1])

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ids of a block, all stretches at once."""
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        at, out = checkpoints.astype(np.int64), np.zeros((STRIDE, len(checkpoints)), np.uint32)
        last = n - (len(checkpoints) - 1) * STRIDE
        shift = np.uint32(32 - self.width)
        for k in range(STRIDE):
            if k == last:
                at = at[:-1]  # the last stretch may be shorter
            if not len(at):
                break
            got = self.table[window[at >> 3] << (at & 7).astype(np.uint32) >> shift]
            out[k, : len(at)] = got
            at = at + self.bits[got]
        return out.T.reshape(-1)[:n]


def pack(code: Code, doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    """The payload of a block."""
    flat = np.concatenate(ids)
    data, checkpoints, bits = code.encode(flat)
    return HEAD.pack(b"LMH1", len(doc_ids), len(flat), len(checkpoints), bits) + np.array(doc_ids, "<i8").tobytes() + np.array([len(x) for x in ids], "<u4").tobytes() + checkpoints.astype("<u8").tobytes() + data


def unpack(code: Code, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a block."""
    magic, docs, n, marks, _ = HEAD.unpack_from(payload)
    if magic != b"LMH1":
        raise ValueError("not a block of this format")
    at = HEAD.size
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    counts = np.frombuffer(payload, "<u4", docs, at := at + 8 * docs)
    checkpoints = np.frombuffer(payload, "<u8", marks, at := at + 4 * docs)
    return doc_ids, counts, code.decode(payload[at + 8 * marks :], checkpoints, n)


def write(docs: DataFrame, path: str, end: int, to: str) -> None:
    """Encode the texts of ``docs`` and write them to the folder ``to``, in ascending doc_id order."""
    spark = docs.sparkSession
    tokens, staged = common.stage(tokenised(docs, path, end), "tokens")
    counts = counted(tokens).orderBy("id").toPandas()  # at most a row for each id of the vocabulary
    bits = code_lengths(counts["n"].to_numpy())
    spark.createDataFrame(list(zip(counts["id"].tolist(), bits.tolist())), "id long, bits long").coalesce(1).write.parquet(f"{to}/codebook")
    shared = spark.sparkContext.broadcast((counts["id"].to_numpy(np.int64), bits))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, number, before = Code(*shared.value), None, 0, 0
        doc_ids: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def full() -> pa.RecordBatch:
            nonlocal number, before, held
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int64()), "n_ids": pa.array([held], pa.int64()), "before": pa.array([before], pa.int64()), "payload": pa.array([pack(code, doc_ids, ids)], pa.binary())})
            number, before, held = number + 1, before + held, 0
            doc_ids.clear()
            ids.clear()
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                part = row[0]
                found = widen(row[3], row[2])
                if held and held + len(found) > BLOCK_IDS:
                    yield full()
                doc_ids.append(NULL_ID if row[1] is None else row[1])
                ids.append(found)
                held += len(found)
        if held:
            yield full()

    dealt = tokens.select("doc_id", "width", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "width", "ids")
    dealt.mapInArrow(blocks, "part int, block long, n_ids long, before long, payload binary").write.option("compression", "uncompressed").parquet(f"{to}/blocks")
    common.unstage(spark, staged)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a written folder."""
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").toPandas()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast((book["id"].to_numpy(np.int64), book["bits"].to_numpy(np.int64)))
    blocks = spark.read.schema("part int, block long, n_ids long, before long, payload binary").parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each range of doc_id
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    placed = blocks.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("before")).alias("start"), "payload")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value)
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, counts, ids = unpack(code, payload.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                data = ids.astype("<u4").tobytes()
                own = [data[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), "start": pa.array(first + ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(map(zlib.crc32, own), pa.int64())})

    return placed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
