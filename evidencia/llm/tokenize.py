"""Problem 6: ids of every text by a public byte-level BPE vocabulary.

Method: the words of a batch, each once, are laid out in padded numpy matrices, one for each bucket of lengths. In
every round each row merges its leftmost pair of least rank; ranks come from an open-addressed hash table of pairs
in numpy arrays; merged rows close up, finished rows leave the matrix. No tokenizer library runs here.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..runtime import col

#: Where the vocabulary files of the public tokenizers lie; a parameter of every function below.
TOKENIZERS = "/opt/tokenizers"

# How byte_bpe_50k cuts a text into words, and the white space of Unicode.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_WORD = regex.compile(PATTERN)
#: No word runs from a visible character into white space, so a text may be cut before each run of white space.
_CHUNK = regex.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

MULT = np.uint64(0x9E3779B97F4A7C15)
BUCKETS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
NONE = np.int32(2**31 - 1)


def read_ranks(vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> dict[bytes, int]:
    with open(f"{tokenizers}/{vocabulary}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Pairs of ids whose bytes joined are a token, hashed into arrays; a lookup takes whole arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, ids = [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ids.append(i)
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.id = np.full(1 << self.bits, NONE, np.int32)
        k, v = np.array(keys, np.int64), np.array(ids, np.int32)
        slot, self.probes = self._slot(k), 0
        while len(k):  # each round the first comer takes a free slot, the others go one further
            self.probes += 1
            free = np.flatnonzero(self.key[slot] == -1)
            place, first = np.unique(slot[free], return_index=True)
            self.key[place], self.id[place] = k[free[first]], v[free[first]]
            rest = self.key[slot] != k
            k, v, slot = k[rest], v[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of each pair's merge, which is its rank; NONE where it has none."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        out = np.full(key.shape, NONE, np.int32)
        open_ = np.flatnonzero(np.ones(key.shape, bool))
        key, slot = key.ravel(), slot.ravel()
        flat = out.ravel()
        for _ in range(self.probes):
            at = slot[open_]
            found = self.key[at]
            hit = found == key[open_]
            flat[open_[hit]] = self.id[at[hit]]
            open_ = open_[~hit & (found != -1)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)

    def one(self, a: int, b: int) -> int:
        return int(self.lookup(np.array([a]), np.array([b]))[0])


@lru_cache(maxsize=4)
def pair_table(vocabulary: str, tokenizers: str) -> PairTable:
    return PairTable(read_ranks(vocabulary, tokenizers))


def merge_matrix(rows: np.ndarray, length: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge padded rows of ids to the end; gives back the rows and their new lengths."""
    n, width = rows.shape
    rows, length = rows.copy(), length.copy()
    column = np.arange(width)
    live = np.arange(n)
    m, size = rows.copy(), length.copy()
    rank = np.full((n, max(width - 1, 1)), NONE, np.int32)
    if width > 1:
        rank = pairs.lookup(m[:, :-1], m[:, 1:])
        rank[column[None, 1:] >= size[:, None]] = NONE
    while len(live):
        at = rank.argmin(axis=1)  # the leftmost of the least
        best = rank[np.arange(len(live)), at]
        done = best == NONE
        if done.any():
            rows[live[done], : m.shape[1]] = m[done]
            length[live[done]] = size[done]
            keep = ~done
            live, m, size, rank, at, best = live[keep], m[keep], size[keep], rank[keep], at[keep], best[keep]
            if not len(live):
                break
            width = int(size.max())
            m, rank = m[:, :width], rank[:, : width - 1]
        r = np.arange(len(live))
        m[r, at] = best
        take = np.minimum(column[None, :width] + (column[None, :width] > at[:, None]), width - 1)
        m = np.take_along_axis(m, take, axis=1)
        size -= 1
        pos = np.minimum(column[None, : width - 1] + (column[None, : width - 1] > at[:, None]), width - 2)
        rank = np.take_along_axis(rank, pos, axis=1)
        rank[column[None, 1:width] >= size[:, None]] = NONE
        for side in (at - 1, at):  # only the new id's two neighbours change
            ok = np.flatnonzero((side >= 0) & (side + 1 < size))
            rank[ok, side[ok]] = pairs.lookup(m[ok, side[ok]], m[ok, side[ok] + 1])
    return rows, length


def merge_long(ids: list[int], pairs: PairTable) -> list[int]:
    """The same merges for one very long word, by a heap of ranks and linked neighbours."""
    n = len(ids)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    rank = pairs.lookup(np.array(ids[:-1]), np.array(ids[1:])).tolist()
    heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(rank) if r != NONE]
    heapq.heapify(heap)
    known: dict[tuple[int, int], int] = {}
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], right[i] = r, False, right[j]
        if right[i] >= 0:
            left[right[i]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0:
                pair = (ids[x], ids[y])
                got = known.get(pair)
                if got is None:
                    got = known[pair] = pairs.one(*pair)
                if got != NONE:
                    heapq.heappush(heap, (got, x, *pair))
    return [ids[i] for i in range(n) if alive[i]]


def encode_words(words: list[bytes], pairs: PairTable) -> list[list[int]]:
    """Ids of each word, by buckets of byte lengths."""
    out: list[list[int]] = [[]] * len(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    low = 0
    for high in BUCKETS:
        index = np.flatnonzero((size > low) & (size <= high))
        low = high
        if not len(index):
            continue
        flat = pairs.byte[np.frombuffer(b"".join(words[i] for i in index), np.uint8)]
        rows = np.zeros((len(index), high), np.int32)
        rows[np.arange(high)[None, :] < size[index, None]] = flat
        for part in range(0, len(index), 65536):
            cut = slice(part, part + 65536)
            merged, length = merge_matrix(rows[cut], size[index[cut]], pairs)
            for i, ids, k in zip(index[cut], merged.tolist(), length.tolist(), strict=True):
                out[i] = ids[:k]
    for i in np.flatnonzero(size > BUCKETS[-1]):
        out[i] = merge_long(pairs.byte[np.frombuffer(words[i], np.uint8)].tolist(), pairs)
    return out


class Encoder:
    """Encodes batches of texts; chunks met before are kept, up to a bound, for the next batch of the same worker."""

    def __init__(self, vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, keep: int = 100_000):
        self.pairs, self.keep = pair_table(vocabulary, tokenizers), keep
        self.chunks: dict[str, np.ndarray] = {}

    def _learn(self, chunks: set[str]) -> None:
        if len(self.chunks) > self.keep:
            self.chunks = {}
        new = [c for c in chunks if c not in self.chunks]
        cut = [_WORD.findall(c) for c in new]
        words = list({w for ws in cut for w in ws})
        ids = dict(zip(words, encode_words([w.encode("utf-8", "surrogatepass") for w in words], self.pairs), strict=True))
        for c, ws in zip(new, cut, strict=True):
            self.chunks[c] = np.array([i for w in ws for i in ids[w]], np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids, as an Arrow list array has them."""
        cut = [_CHUNK.findall(t) if t else [] for t in texts]
        need = set().union(*cut) if cut else set()
        self._learn(need)
        known = self.chunks
        flat = [known[c] for cs in cut for c in cs]
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        per = np.cumsum([0, *map(len, cut)])
        return ends[per].astype(np.int32), np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)


def _pieces(n: int, texts: pa.Array, most: int) -> Iterator[slice]:
    """Row ranges of about `most` bytes of text, so that a batch of very long texts needs no more memory."""
    size = np.cumsum([0, *(len(x) if x is not None else 0 for x in texts.to_pylist())]) if n else np.zeros(1)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(size, size[start] + most, "right")) - 1)
        yield slice(start, min(stop, n))
        start = min(stop, n)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, ids: str = "ids", piece: int = 4_000_000) -> DataFrame:
    """One row (key, ids) for each row of df.

    Null and empty texts get an empty list; strings that look like special tokens are ordinary text; repeated rows
    each get their row; other columns of df, whatever their names, are not read. No shuffle.
    """
    kind = df.schema[key].dataType
    source = df.select(col(df, key).alias("k"), col(df, text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(vocabulary, tokenizers)
            for cut in _pieces(batch.num_rows, batch.column(1), piece):
                part = batch.slice(cut.start, cut.stop - cut.start)
                ends, flat = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=[key, ids])

    return source.mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, out: str = "tokens", piece: int = 4_000_000) -> DataFrame:
    """One row (key, keep..., out) with the number of ids of each text; the ids themselves never leave the worker."""
    fields = [df.schema[c] for c in (key, *keep)]
    source = df.select(col(df, text).cast("string").alias("__t"), *[col(df, c).alias(f"__{i}") for i, c in enumerate((key, *keep))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(vocabulary, tokenizers)
            for cut in _pieces(batch.num_rows, batch.column(0), piece):
                part = batch.slice(cut.start, cut.stop - cut.start)
                ends, _ = encoder.encode(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(ends).astype(np.int64))], names=[key, *keep, out])

    return source.mapInArrow(run, T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField(out, T.LongType())]))
