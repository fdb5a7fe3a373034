"""Language-model scores from an n-gram trie in Elias-Fano levels.

Method: words, and pairs of a word with the word before it, are counted over the training rows. A trie
holds the words in its first level and, below each word, the contexts it was seen after. Both levels are
monotone sequences in Elias-Fano code, as are the pointers from words to their contexts; pairs carry an
8-bit quantised gain in log probability over the word alone, in steps that reach the largest gain the training
rows can give. A lookup is a successor search: of the word
in the first level, then of the context among those of that word only. Levels are files in the shared
folder, one for each shard, and are memory-mapped where the file system allows it.

The model is p(w | v) = (c(v, w) + mu p(w)) / (c(v) + mu), with p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).
Its logarithm is a sum of a part for w, a part for v, and a gain for pairs that were seen, so a text's
score is a sum over its tokens and no shard needs what another one holds.

Words are told apart by 64-bit hashes, contexts of one word by 40 bits. Shards are ranges of the word's
hash. Words with at least N / ``HEADS`` tokens, of which there are no more than ``HEADS``, and such pairs,
are in two small tables that every task has; they are scored where the text is, and pairs of a common
word are dealt by word and context. So no shard's load depends on how common a word or pair is.

Defined results: null and empty texts are one end token. Without training rows every word is
unknown and the base score is 0. A null id counts as the empty text for the split into training and
held-out rows. Repeated rows count, and are scored, each for itself. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ruletrace.llm.common import (BLANK_WORDS, LOWERED, byte_column, crc_mod, doc_slices, mixed, prefix_sums, settled,
                                  shared_path, span_hash, table, utf8, word_spans)
from ruletrace.llm.warc import opened

MU, HEADS = 2.0, 1 << 15
SHARD_BYTES, BATCH_BYTES = 16 << 20, 8 << 20
#: Smallest step of a quantised gain; 255 steps reach the largest gain (``Numbers.step``).
STEP = 1 / 32
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
CONTEXT = np.uint64((1 << 40) - 1)


# ---- Elias-Fano ------------------------------------------------------------------------------------


@dataclass
class EliasFano:
    """A sorted sequence: low bytes of each value as they are, the rest in unary."""

    low: np.ndarray   # n x bytes
    high: np.ndarray  # bitmap, bit (value >> bits) + i is set for value i
    n: int

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        spare = int(values[-1]) // n if n else 0
        wide = min(7, -(-spare.bit_length() // 8))
        bits = np.uint64(8 * wide)
        low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :wide]
        ones = (values >> bits).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(np.ascontiguousarray(low), np.packbits(high, bitorder="little"), n)

    def dump(self) -> dict[str, bytes]:
        return {"low": self.low.tobytes(), "high": self.high.tobytes(), "n": self.n}

    @classmethod
    def load(cls, low: memoryview, high: memoryview, n: int) -> EliasFano:
        low = np.frombuffer(low, np.uint8)
        return cls(low.reshape(n, -1) if n else low.reshape(0, 0), np.frombuffer(high, np.uint8), n)

    def select(self) -> None:
        """The places of the set bits, found once for many lookups."""
        self.ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]

    def at(self, i: np.ndarray) -> np.ndarray:
        wide = self.low.shape[1]
        out = (self.ones[i] - i).astype(np.uint64) << np.uint64(8 * wide)
        for k in range(wide):
            out |= self.low[i, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each x the first place in [lo, hi) whose value is not below it, or hi."""
        lo, hi = lo.copy(), hi.copy()
        going = np.flatnonzero(lo < hi)
        while len(going):
            mid = (lo[going] + hi[going]) >> 1
            below = self.at(mid) < x[going]
            lo[going[below]] = mid[below] + 1
            hi[going[~below]] = mid[~below]
            going = going[lo[going] < hi[going]]
        return lo

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of each x in [lo, hi), or -1."""
        at = self.successor(x, lo, hi)
        out = np.full(len(x), -1, np.int64)
        near = np.flatnonzero(at < hi)
        same = near[self.at(at[near]) == x[near]]
        out[same] = at[same]
        return out


class Trie:
    """Words with counts; below each word its contexts with quantised gains."""

    def __init__(self, words: EliasFano, counts: np.ndarray, pointers: EliasFano, contexts: EliasFano, gains: np.ndarray,
                 step: float):
        self.words, self.counts, self.pointers, self.contexts, self.gains = words, counts, pointers, contexts, gains
        self.step = step
        for level in (words, pointers, contexts):
            level.select()

    @staticmethod
    def rows(words: np.ndarray, counts: np.ndarray, firsts: np.ndarray, contexts: np.ndarray, gains: np.ndarray,
             step: float) -> dict:
        """Cells of a trie from sorted words, first context of each (and the end), and contexts sorted by word."""
        node = np.repeat(np.arange(len(words), dtype=np.uint64), np.diff(firsts))
        levels = {"words": EliasFano.of(words), "pointers": EliasFano.of(firsts.astype(np.uint64)),
                  "contexts": EliasFano.of((node << np.uint64(40)) | contexts)}
        cells = {f"{k}_{c}": v for k, level in levels.items() for c, v in level.dump().items()}
        gains = np.rint(gains / step)
        assert not len(gains) or gains.max() <= 255, "a gain is over the largest one"
        return cells | {"counts": counts.astype("<u4").tobytes(), "gains": gains.astype(np.uint8).tobytes(),
                        "step": np.array([step], "<f8").tobytes()}

    @classmethod
    def read(cls, path: str) -> Trie:
        where, inner = opened(path)
        source = pa.memory_map(inner) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(inner)
        row = pa.ipc.open_file(source).get_batch(0)
        cell = {name: row.column(i)[0] for i, name in enumerate(row.schema.names)}
        levels = [EliasFano.load(cell[f"{k}_low"].as_buffer(), cell[f"{k}_high"].as_buffer(), cell[f"{k}_n"].as_py())
                  for k in ("words", "pointers", "contexts")]
        return cls(levels[0], np.frombuffer(cell["counts"].as_buffer(), "<u4"), levels[1], levels[2],
                   np.frombuffer(cell["gains"].as_buffer(), np.uint8), float(np.frombuffer(cell["step"].as_buffer(), "<f8")[0]))

    @staticmethod
    def write(folder: str, cells: dict) -> str:
        where, top = opened(folder)
        where.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.trie"  # an attempt that is retried leaves its file unused
        row = pa.RecordBatch.from_pylist([cells], schema=pa.schema(
            [(k, pa.int64() if isinstance(v, int) else pa.large_binary()) for k, v in cells.items()]))
        with where.open_output_stream(f"{top}/{name}", compression=None) as out, pa.ipc.new_file(out, row.schema) as file:
            file.write_batch(row)
        return f"{folder}/{name}"

    def word(self, words: np.ndarray) -> np.ndarray:
        return self.words.find(words, np.zeros(len(words), np.int64), np.full(len(words), self.words.n))

    def gain(self, node: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Gain of each context under its node; 0 where the node is -1 or was not seen after it."""
        out = np.zeros(len(node))
        known = np.flatnonzero(node >= 0)
        lo, hi = (self.pointers.at(node[known] + k).astype(np.int64) for k in (0, 1))
        at = self.contexts.find((node[known].astype(np.uint64) << np.uint64(40)) | context[known], lo, hi)
        out[known[at >= 0]] = self.gains[at[at >= 0]] * self.step
        return out


# ---- tokens ------------------------------------------------------------------------------------------


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, word before and text of every token; each text ends with one end token."""
    parts = []
    for lo, hi in doc_slices(offsets):
        part = LOWERED[raw[offsets[lo]:offsets[hi]]]
        starts, ends, firsts = word_spans(part, offsets[lo:hi + 1] - offsets[lo], BLANK_WORDS)
        parts.append((span_hash(prefix_sums(part), starts, ends), np.diff(firsts)))
    words = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    sizes = np.concatenate([p[1] for p in parts]) + 1 if parts else np.zeros(0, np.int64)
    stops = np.cumsum(sizes)
    word = np.empty(int(stops[-1]) if len(stops) else 0, np.uint64)
    ends = np.zeros(len(word), bool)
    ends[stops - 1] = True
    word[ends], word[~ends] = END, words
    before = np.concatenate([[START], word[:-1]]) if len(word) else word
    before[stops[:-1]] = START
    return word, before, np.repeat(np.arange(len(sizes)), sizes)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def paired(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(word ^ mixed(before + np.uint64(1)))


@dataclass
class Heads:
    """Common words and pairs with their training counts; at most HEADS of each."""

    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray

    @staticmethod
    def _find(known: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(x), -1, np.int64)
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return np.where(known[at] == x, at, -1)

    def word(self, x: np.ndarray) -> np.ndarray:
        return self._find(self.words, x)

    def pair(self, x: np.ndarray) -> np.ndarray:
        return self._find(self.pairs, x)


@dataclass
class Model:
    """What is needed to score: totals, common words and pairs, and a table of the shards' files."""

    n_tokens: int
    n_types: int
    n_texts: int
    heads: Heads
    shards: int
    files: DataFrame | None
    mu: float = MU

    def numbers(self) -> Numbers:
        return Numbers(self.n_tokens + 0.1 * (self.n_types + 1), self.n_texts, self.mu)


@dataclass
class Numbers:
    total: float
    n_texts: int
    mu: float

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / self.total)

    def alone(self, count: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What a token adds to the score without its gain: its own part, and its part as the next one's context."""
        return np.log10(self.mu) + self.base(count) - np.where(ends, 0.0, np.log10(count + self.mu))

    def gain(self, pair: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.log10(1 + pair * self.total / (self.mu * (count + 0.1)))

    @property
    def step(self) -> float:
        """What 255 of reach the gain of any pair, which is seen no more often than its word."""
        return max(STEP, float(np.log10(1 + self.total / self.mu)) / 255)


def _batches(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES):
    for batch in batches:
        raw, offsets = byte_column(batch.column(column))
        for lo, hi in doc_slices(offsets, most):
            yield batch.slice(lo, hi - lo), raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard.astype(np.uint16 if shards < 1 << 16 else np.int64), kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), order[cuts[k]:cuts[k + 1]]


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs; the width is the number of bytes by the count."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _large(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, {0: np.uint8, 1: np.uint8, 2: np.uint16, 4: np.uint32}[len(x) // n if n else 0]).astype(np.int64)


def _forty(x: np.ndarray) -> bytes:
    return np.ascontiguousarray((x & CONTEXT).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_forty(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


# ---- training ----------------------------------------------------------------------------------------


def _counted(texts: DataFrame, shards: int, least: float, words: np.ndarray | None):
    """Per shard: number of different keys, and the keys with at least ``least`` tokens. Keys are words, or pairs of
    the given words. Each batch sends a key once, with its count."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, offsets in _batches(batches, 0):
            key, before, _ = tokens(raw, offsets)
            known = shared.value
            if known is not None:
                both = (Heads._find(known, key) >= 0) & ((Heads._find(known, before) >= 0) | (before == START))
                key = paired(key[both], before[both])
            key, n = np.unique(key, return_counts=True)
            rows = list(_by_shard(shard_of(mixed(key), shards), shards))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([key[i].tobytes() for _, i in rows], pa.binary()),
                 pa.array([_small(n[i]) for _, i in rows], pa.binary())], ["shard", "keys", "counts"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, np.uint64) for x in rows["keys"]]
        counts = np.concatenate([_large(c, len(k)) for c, k in zip(rows["counts"], keys, strict=True)])
        keys, code = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(code, weights=counts).astype(np.int64)
        common = counts >= least
        return pd.DataFrame({"n": np.append(counts[common], len(keys)),
                             "key": np.append(keys[common].view(np.int64), 0),
                             "common": np.append(np.ones(int(common.sum()), bool), False)})

    return texts.mapInArrow(count, "shard int, keys binary, counts binary").groupBy("shard") \
        .applyInPandas(merge, "n long, key long, common boolean")


def _table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    rows = settled(rows, "heads")
    types = rows.where("NOT common").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = rows.where("common").select("key", "n").toPandas()  # HEADS rows at most
    keys, counts = common["key"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order], int(types)


def _shards(word: np.ndarray, before: np.ndarray, heads: Heads, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard of each token, place of its word and of its pair among the common ones (-1: not common)."""
    head = heads.word(word)
    pair_key = paired(word, before)
    pair = np.where(head >= 0, heads.pair(pair_key), -1)
    return shard_of(np.where(head >= 0, pair_key, mixed(word)), shards), head, pair


def train(docs: DataFrame, mu: float = MU) -> Model:
    """The model of the rows of ``docs`` (text)."""
    spark = docs.sparkSession
    texts = docs.select(utf8(F.col("text")).alias("text"))
    n_texts, n_words, size = docs.agg(
        F.count("*"), F.sum(F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")),
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()
    n_tokens, shards = n_texts + (n_words or 0), 1 + (size or 0) // SHARD_BYTES
    least = max(n_tokens / HEADS, 2)
    words, word_counts, n_types = _table(_counted(texts, shards, least, None))
    pairs, pair_counts, _ = _table(_counted(texts, shards, least, words))
    model = Model(n_tokens, n_types, n_texts, Heads(words, word_counts, pairs, pair_counts), shards, None, mu)
    numbers, heads, folder = model.numbers(), spark.sparkContext.broadcast(model.heads), shared_path(spark, "model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, offsets in _batches(batches, 0):
            word, before, _ = tokens(raw, offsets)
            shard, head, pair = _shards(word, before, heads.value, shards)
            rest = np.flatnonzero(pair < 0)
            rows = []
            for k, i in _by_shard(shard[rest], shards):
                own, code = np.unique(word[rest[i]], return_inverse=True)
                both, n = np.unique((code.astype(np.uint64) << np.uint64(40)) | (before[rest[i]] & CONTEXT), return_counts=True)
                rows.append((k, own.tobytes(), len(both), _small((both >> np.uint64(40)).astype(np.int64)), _forty(both), _small(n)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             ["shard", "words", "n", "word", "context", "counts"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(x, np.uint64) for x in rows["words"]]
        known, code = np.unique(np.concatenate(own), return_inverse=True)
        cuts = np.cumsum([0, *map(len, own)])
        pair, count = [], []
        for i, (n, word, context, counts) in enumerate(zip(rows["n"], rows["word"], rows["context"], rows["counts"], strict=True)):
            node = code[cuts[i]:cuts[i + 1]][_large(word, n)].astype(np.uint64)
            pair.append((node << np.uint64(40)) | _from_forty(context))
            count.append(_large(counts, n))
        pair, same = np.unique(np.concatenate(pair), return_inverse=True)
        count = np.bincount(same, weights=np.concatenate(count))
        node = (pair >> np.uint64(40)).astype(np.int64)
        firsts = np.searchsorted(node, np.arange(len(known) + 1))
        totals = np.bincount(node, weights=count, minlength=len(known))
        head = heads.value.word(known)
        totals[head >= 0] = heads.value.word_counts[head[head >= 0]]
        cells = Trie.rows(known, totals, firsts, pair & CONTEXT, numbers.gain(count, totals[node]), numbers.step)
        return pd.DataFrame({"of": [int(rows["shard"].iloc[0])], "file": [Trie.write(folder, cells)]})

    model.files = settled(texts.mapInArrow(
        count, "shard int, words binary, n long, word binary, context binary, counts binary")
        .groupBy("shard").applyInPandas(build, "of int, file string"), "model-files")
    return model


# ---- scoring -------------------------------------------------------------------------------------------

# What a batch of texts asks a shard: which of its texts have tokens there and how many (docs, sizes, n), and
# the tokens. One row of a batch also has the texts' ids and what was scored on the spot.
QUERY = ("shard int, batch string, ids binary, local binary, n int, docs binary, sizes binary, words binary, "
         "word binary, context binary")
ANSWER = "batch string, ids binary, local binary, n int, docs binary, known binary, base binary, score binary"


def _sum(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of ``docs`` (doc_id, text)."""
    numbers, shards = model.numbers(), model.shards
    heads = docs.sparkSession.sparkContext.broadcast(model.heads)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Named by partition and place, so that a task that runs again names its batches alike.
        part = TaskContext.get().partitionId()
        for number, (batch, raw, offsets) in enumerate(_batches(batches, 1)):
            n_docs = batch.num_rows
            word, before, doc = tokens(raw, offsets)
            shard, head, pair = _shards(word, before, heads.value, shards)
            local = np.zeros((4, n_docs))
            local[0] = np.bincount(doc, minlength=n_docs)
            common = np.flatnonzero(head >= 0)
            counts = heads.value.word_counts[head[common]].astype(float)
            local[1] = _sum(doc[common], np.ones(len(common)), n_docs)
            local[2] = _sum(doc[common], numbers.base(counts), n_docs)
            local[3] = _sum(doc[common], numbers.alone(counts, word[common] == END), n_docs) - np.log10(numbers.n_texts + numbers.mu)
            both = np.flatnonzero(pair >= 0)
            gains = numbers.gain(heads.value.pair_counts[pair[both]], heads.value.word_counts[head[both]])
            local[3] += _sum(doc[both], gains, n_docs)
            ids = zlib.compress(np.concatenate([batch.column(0).fill_null(0).to_numpy(),
                                                batch.column(0).is_valid().to_numpy(zero_copy_only=False)]).astype(np.int64).tobytes(), 1)
            name, rest, rows = f"{part}-{number}", np.flatnonzero(pair < 0), []
            for k, i in _by_shard(shard[rest], shards):
                at = rest[i]  # tokens of a text stay together
                own, code = np.unique(word[at], return_inverse=True)
                docs_in, sizes = np.unique(doc[at], return_counts=True)
                rows.append([k, name, None, None, len(docs_in), _small(docs_in), _small(sizes), own.tobytes(), _small(code),
                             _forty(before[at])])
            if not rows:
                rows.append([0, name, None, None, 0, b"", b"", b"", b"", b""])
            rows[0][2:4] = ids, local.tobytes()
            types = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                             [c.split(" ")[0] for c in QUERY.split(", ")])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        trie = Trie.read(rows["file"].iloc[0]) if isinstance(rows["file"].iloc[0], str) else None
        out = []
        for r in rows.itertuples():
            doc = np.repeat(np.arange(r.n), _large(r.sizes, r.n))
            own = np.frombuffer(r.words, np.uint64)
            code = _large(r.word, len(doc))
            node = trie.word(own) if trie else np.full(len(own), -1, np.int64)
            count = np.zeros(len(own))
            count[node >= 0] = trie.counts[node[node >= 0]] if trie else 0
            tail = (heads.value.word(own) < 0)[code] if len(own) else np.zeros(0, bool)
            known = _sum(doc, tail & (count > 0)[code], r.n).astype(np.int64)
            base = _sum(doc, np.where(tail, numbers.base(count)[code], 0.0), r.n)
            score = _sum(doc, np.where(tail, numbers.alone(count, own == END)[code], 0.0), r.n)
            if trie:
                score += _sum(doc, trie.gain(node[code], _from_forty(r.context)), r.n)
            out.append((r.batch, r.ids, r.local, r.n, r.docs, _small(known), base.tobytes(), score.tobytes()))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in ANSWER.split(", ")])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        whole = rows[rows["local"].notna()].iloc[0]
        ids = np.frombuffer(zlib.decompress(whole["ids"]), np.int64)
        ids, valid = ids[:len(ids) // 2], ids[len(ids) // 2:].astype(bool)
        sums = np.frombuffer(whole["local"]).reshape(4, -1).copy()
        for r in rows.itertuples():
            docs_in = _large(r.docs, r.n)
            sums[1, docs_in] += _large(r.known, r.n)
            sums[2, docs_in] += np.frombuffer(r.base)
            sums[3, docs_in] += np.frombuffer(r.score)
        return pd.DataFrame({"doc_id": pd.array(np.where(valid, ids, 0), "Int64").copy() if valid.all() else
                             pd.array([int(i) if v else pd.NA for i, v in zip(ids, valid, strict=True)], "Int64"),
                             "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64),
                             "base_score": sums[2], "score": sums[3]})

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")).mapInArrow(ask, QUERY)
    answers = asked.join(model.files, F.col("shard") == F.col("of"), "left").drop("of") \
        .groupBy("shard").applyInPandas(answer, ANSWER)
    return settled(answers, "answers").groupBy("batch").applyInPandas(
        add, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, mu: float = MU) -> DataFrame:
    """Scores of all rows by the model of those whose crc32 of the id, modulo 10, is not 0."""
    model = train(docs.where(crc_mod(F.col("doc_id"), 10) != 0), mu)
    return scored(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))
