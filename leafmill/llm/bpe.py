"""Byte-level BPE as a lazily determinised transducer, and streaming UTF-8 decoding.

The merges are compiled on demand. Reading bytes from left to right, the
transducer keeps every place at which a token that is still open began: how far
into the vocabulary's trie the bytes since then have come, and the token that
ended at that place. Two neighbours ``a b`` can stand in an encoding only if
encoding the bytes of both gives ``a b`` again; since merges on two sides of a
place that no merge crosses don't affect each other, a sequence all of whose
neighbours are such pairs *is* the encoding. Hence exactly one token can end at
each place, and a token is settled as soon as all open places descend from it,
after at most as many bytes as the longest token has. The set of open places,
taken relative to the current one, is the state of the determinised machine:
states and transitions are made the first time they are met and looked up from
then on.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common

#: States, tested pairs and cached pieces that a worker keeps; beyond them it works without keeping.
MAX_STATES, MAX_PAIRS, MAX_PIECES = 150_000, 400_000, 300_000
#: Bytes of a long piece after which the settled tokens are written.
FLUSH = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a ``.tiktoken`` file: token bytes to id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class State(dict):
    """Transitions of a state: byte to (next state, token that ends there), made when first looked up.

    ``places`` has for each open place: trie node * 2^32 + token that ended there + 1 (0 at the start).
    """

    __slots__ = ("machine", "places")

    def __init__(self, machine: Transducer, places: tuple[int, ...]) -> None:
        self.machine, self.places = machine, places

    def __missing__(self, byte: int) -> tuple[State, int]:
        out = self.machine.step(self.places, byte)
        if self.places in self.machine.states:  # a machine that is full makes no more lasting states
            self[byte] = out
        return out


class Transducer:
    """Encodes single pieces of text by the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.child: dict[int, int] = {}  # of the trie: node * 256 + byte to node
        self.depth, self.token_at, self.inner = [0], [-1], [True]
        for token, i in ranks.items():
            node = 0
            for depth, byte in enumerate(token, 1):
                below = self.child.get(node << 8 | byte)
                if below is None:
                    below = self.child[node << 8 | byte] = len(self.depth)
                    self.inner[node] = True
                    self.depth.append(depth)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = below
            self.token_at[node] = i
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple[int, ...], State] = {}
        self.start = self.states[0,] = State(self, (0,))

    def merged(self, text: bytes) -> list[int]:
        """The encoding by merging the neighbours of lowest rank, for the short strings of the pair test."""
        parts, ranks, none = [text[i : i + 1] for i in range(len(text))], self.ranks, len(self.ranks)
        scores = [ranks.get(text[i : i + 2], none) for i in range(len(text) - 1)]
        while scores:
            rank = min(scores)
            if rank == none:
                break
            at = scores.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = ranks.get(parts[at] + parts[at + 1], none)
        return [ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the token ``right`` can follow ``left - 1``; 0 is the start of a piece."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            whole = self.bytes_of[left - 1] + self.bytes_of[right] if left else self.bytes_of[right]
            found = self.merged(whole) == ([left - 1, right] if left else [right])
            if len(self.pairs) < MAX_PAIRS:
                self.pairs[key] = found
        return found

    def step(self, open_places: tuple[int, ...], byte: int) -> tuple[State, int]:
        """Make a transition: (next state, token that ends here)."""
        places, ended, child = [], -1, self.child.get
        for place in open_places:
            node = child((place >> 32) << 8 | byte)
            if node is None:
                continue
            if ended < 0 and self.token_at[node] >= 0 and self.fits(place & 0xFFFFFFFF, self.token_at[node]):
                ended = self.token_at[node]
            if self.inner[node]:
                places.append(node << 32 | place & 0xFFFFFFFF)
        if ended < 0:
            raise ValueError(f"no token ends at byte {byte}: the vocabulary lacks single bytes or merges")
        places.append(ended + 1)
        key = tuple(places)
        found = self.states.get(key)
        if found is None:
            found = State(self, key)
            if len(self.states) < self.max_states:
                self.states[key] = found
        return found, ended

    def back(self, ended: list[int], end: int, start: int) -> list[int]:
        """The tokens between two places, last first."""
        out = []
        while end > start:
            out.append(ended[end - 1])
            end -= self.length[out[-1]]
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece. A piece that is itself a token is that token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        state, out, ended = self.start, [], []
        for at in range(0, len(piece), FLUSH):
            if at:
                out += self.settle(state, ended)
            for byte in piece[at : at + FLUSH]:
                state, token = state[byte]
                ended.append(token)
        return out + self.back(ended, len(ended), 0)[::-1]

    def settle(self, state: State, ended: list[int]) -> list[int]:
        """Write what all open places agree on, and cut it from ``ended``."""
        chains = [self.back(ended, len(ended) - self.depth[p >> 32], 0)[::-1] for p in state.places]
        agreed = 0
        while all(len(c) > agreed for c in chains) and len({c[agreed] for c in chains}) == 1:
            agreed += 1
        written = chains[0][:agreed]
        del ended[: sum(self.length[t] for t in written)]
        return written


#: UTF-8 as a machine: the state is the bytes of a character begun but not ended.
def utf8_step(pending: bytes, more: bytes) -> tuple[str, bytes]:
    """Read ``more``: (text that is complete now, bytes still pending). Malformed bytes become U+FFFD."""
    data, out, at = pending + more, [], 0
    while at < len(data):
        lead = data[at]
        need = 1 if lead < 0x80 else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
        end = at + 1
        while need and end < min(at + need, len(data)) and (low if end == at + 1 else 0x80) <= data[end] <= (high if end == at + 1 else 0xBF):
            end += 1
        if need and end == at + need:
            out.append(data[at:end].decode())
        elif need and end == len(data):
            return "".join(out), data[at:]
        else:
            out.append("�")
        at = end
    return "".join(out), b""


class Decoder:
    """Turns ids back into text, one id at a time, holding at most three pending bytes."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of = bytes_of
        self.memo: dict[bytes, dict[int, tuple[str, bytes]]] = {}
        self.whole = {i: text for i, b in bytes_of.items() for text, rest in [utf8_step(b"", b)] if not rest and text.encode() == b}

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; U+FFFD stands for bytes that are not UTF-8."""
        ids = list(ids)
        parts = list(map(self.whole.get, ids))  # the machine stays in its first state over all of these
        if None not in parts:
            return "".join(parts)
        out, pending = [], b""
        for i, text in zip(ids, parts):
            if text is not None and not pending:
                out.append(text)
                continue
            known = self.memo.setdefault(pending, {})
            if i not in known:
                known[i] = utf8_step(pending, self.bytes_of[i])
            text, pending = known[i]
            out.append(text)
        if pending:
            out.append("�")
        return "".join(out)


_made: dict[tuple[str, str], tuple] = {}


class Codec:
    """A worker's transducer, decoder and piece cache for one vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        self.machine = Transducer(load_ranks(path))
        self.decoder = Decoder(self.machine.bytes_of)
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    @staticmethod
    def of(path: str, pattern: str) -> Codec:
        if (path, pattern) not in _made:
            _made[path, pattern] = Codec(path, pattern)
        return _made[path, pattern]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for piece in self.find(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.machine.encode(piece.encode())
                if len(cache) < MAX_PIECES and len(piece) <= 64:
                    cache[piece] = ids
            out += ids
        return out


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a column ``out`` of token ids (array<int>), one row in, one row out.

    Nulls and empty texts give an empty array. Lone surrogates can't occur in
    Spark strings. All other columns pass through, whatever their names, except
    that an existing ``out`` is replaced.
    """
    common.prepare(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        codec = Codec.of(path, pattern)
        return texts.map(lambda t: codec.encode(t) if t else [])

    return docs.withColumn(out, ids(F.col(f"`{text}`")))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text.

    The ids are made and decoded in the same task, batch by batch, so no id
    crosses the network.
    """
    common.prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> dict:
        codec = Codec.of(path, pattern)
        n, sha_ids, sha_text = [], [], []
        for text in batch.column(1).to_pylist():
            ids = codec.encode(text) if text else []
            n.append(len(ids))
            sha_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            sha_text.append(hashlib.sha256(codec.decoder.decode(ids).encode()).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha_ids, pa.string()), "decoded_sha256": pa.array(sha_text, pa.string())}

    return common.per_batch(docs.select("doc_id", "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
