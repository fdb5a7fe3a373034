"""Benchmark decontamination by greedy string tiling.

Method: texts and items become words (lower-cased runs of letters and digits). Windows of ``min_match``
words of the items are the seeds; a document is joined with the items it shares a seed with, and tiled
against each: the longest match of unmarked words is found with running Karp-Rabin hashes, marked, and
so on until no match of ``min_match`` words is left. Order does not matter, so reordered passages
count. For an item of fewer words its own number takes the place of ``min_match``: it is found where it stands as a whole. An item whose words are covered to at least ``min_cover`` contaminates the document.

The items are a stated query set. They are dealt into blocks of a bounded size by hash, and every block
meets all documents; a larger benchmark means more blocks, not a larger broadcast.

Defined results: null and empty texts share nothing, and an item without words is not looked for. A null item_id is an item like others; equal items are each reported. Repeated documents
are each judged. An empty table on either side gives no finding. Other columns do not matter.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ruletrace.llm.common import (ALNUM_WORDS, LOWERED, byte_column, chained, doc_slices, fresh, prefix_sums, span_hash, table,
                                  utf8, word_spans)

MIN_MATCH, MIN_COVER = 5, 0.5
BLOCK_BYTES = 16 << 20


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of all texts, and the number of words before each text."""
    raw = LOWERED[raw]
    starts, ends, firsts = word_spans(raw, offsets, ALNUM_WORDS)
    return span_hash(prefix_sums(raw), starts, ends), firsts


def _runs(free: list[bool], at: int, n: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the runs of unmarked words in a range."""
    start = None
    for k in range(n + 1):
        if k < n and free[at + k]:
            start = k if start is None else start
        elif start is not None:
            yield start, k - start
            start = None


def tiles(item: list[int], text: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """(place in item, place in text, words): longest first, then first in the item, then in the text."""
    free_i, free_t = [True] * len(item), [True] * len(text)
    out: list[tuple[int, int, int]] = []
    size = max(min_match, min(len(item), len(text)) // 2)
    while True:
        # Karp-Rabin: windows of the item by hash, windows of the text by a running hash.
        base, mod = 1_000_003, (1 << 61) - 1
        top = pow(base, size - 1, mod)

        def windows(words: list[int], free: list[bool]) -> Iterator[tuple[int, int]]:
            value = run = 0
            for k, word in enumerate(words):
                if not free[k]:
                    value = run = 0
                    continue
                if run == size:
                    value = (value - words[k - size] * top) % mod
                    run -= 1
                value = (value * base + word) % mod
                run += 1
                if run == size:
                    yield k - size + 1, value

        known = defaultdict(list)
        for i, value in windows(item, free_i):
            known[value].append(i)
        heap: list[tuple[int, int, int]] = []
        for t, value in windows(text, free_t):
            for i in known.get(value, ()):
                if item[i:i + size] != text[t:t + size]:
                    continue
                if i and t and free_i[i - 1] and free_t[t - 1] and item[i - 1] == text[t - 1]:
                    continue  # part of the match that starts before
                n = size
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] \
                        and item[i + n] == text[t + n]:
                    n += 1
                heapq.heappush(heap, (-n, i, t))
        while heap:
            n, i, t = heapq.heappop(heap)
            both = [a and b for a, b in zip(free_i[i:i - n], free_t[t:t - n], strict=True)]
            if all(both):
                out.append((i, t, -n))
                free_i[i:i - n] = free_t[t:t - n] = [False] * -n
                continue
            for at, length in _runs(both, 0, -n):
                if length >= size:
                    heapq.heappush(heap, (-length, i + at, t + at))
        if size == min_match:
            return out
        size = max(min_match, size // 2)


class Items:
    """One block of benchmark items with its seeds."""

    def __init__(self, rows: list[tuple[int | None, bytes]], min_match: int, min_cover: float):
        self.min_match, self.min_cover = min_match, min_cover
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])]).astype(np.int64)
        words, firsts = word_hashes(np.frombuffer(b"".join(t for _, t in rows), np.uint8), offsets)
        self.ids = [i for i, _ in rows]
        self.words = [words[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        sizes = np.minimum(np.diff(firsts), min_match)
        # Seeds by their number of words: min_match, or fewer for items that are shorter.
        self.seeds = {int(n): self._seeds(words, firsts, n, sizes == n) for n in np.unique(sizes) if n}

    @staticmethod
    def _seeds(words: np.ndarray, firsts: np.ndarray, n: int, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different seeds of some items, where the items of each begin, and those items."""
        windows = chained(words, n)
        item = np.searchsorted(firsts, np.arange(len(windows)), "right") - 1
        whole = (np.arange(len(windows)) + n <= firsts[1:][item]) & mine[item]
        pairs = np.unique(np.stack([windows[whole], item[whole].astype(np.uint64)], 1), axis=0)
        seeds, at = np.unique(pairs[:, 0], return_index=True)
        return seeds, np.append(at, len(pairs)), pairs[:, 1].astype(np.int64)

    def found(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, float, int, list]]:
        """(text, item, coverage, shared words, tiles) of every pair over the limit."""
        for n in self.seeds:
            yield from self._found(words, firsts, n)

    def _found(self, words: np.ndarray, firsts: np.ndarray, size: int) -> Iterator[tuple[int, int, float, int, list]]:
        seeds, first, items = self.seeds[size]
        windows = chained(words, size)
        if not len(windows):
            return
        at = np.minimum(np.searchsorted(seeds, windows), len(seeds) - 1)
        hits = np.flatnonzero(seeds[at] == windows)
        text = np.searchsorted(firsts, hits, "right") - 1
        hits, text = (x[hits + size <= firsts[1:][text]] for x in (hits, text))
        shared: dict[tuple[int, int], list[int]] = defaultdict(list)
        for h, t in zip(hits.tolist(), text.tolist(), strict=True):
            for item in items[first[at[h]]:first[at[h] + 1]].tolist():
                shared[t, item].append(h)
        for (t, item), places in shared.items():
            known = self.words[item].tolist()
            # A tile lies where seeds of the item stand; the rest of the text is left out.
            cover = np.unique(np.add.outer(np.array(places), np.arange(size)))
            parts = np.split(cover, np.flatnonzero(np.diff(cover) > 1) + 1)
            near, back = [], []
            for p in parts:
                near += [-1, *words[p].tolist()]
                back += [-1, *(p - firsts[t]).tolist()]
            made = tiles(known, near, size)
            n = sum(x for *_, x in made)
            if n >= self.min_cover * len(known):
                yield t, item, n / len(known), n, [(i, back[k], x) for i, k, x in sorted(made)]


def item_blocks(benchmark: DataFrame, min_match: int, min_cover: float) -> Iterator[Items]:
    """Blocks of about BLOCK_BYTES of item texts, each small enough for every task."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), utf8(F.col("text")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        yield Items([(r["item_id"], bytes(r["text"])) for r in mine.toLocalIterator()], min_match, min_cover)


TILES = "array<struct<item_word: int, text_word: int, n: int>>"
TILE_TYPE = pa.list_(pa.struct([("item_word", pa.int32()), ("text_word", pa.int32()), ("n", pa.int32())]))
SCHEMA = f"doc_id long, item_id long, coverage double, n_shared long, tiles {TILES}"


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH,
                 min_cover: float = MIN_COVER) -> DataFrame:
    """One row per document and item that contaminates it; clean documents give none."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for items in item_blocks(benchmark, min_match, min_cover):
        block = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = block.value
            for batch in batches:
                raw, offsets = byte_column(batch.column(1))
                ids = batch.column(0)
                found = []
                for lo, hi in doc_slices(offsets):
                    words, firsts = word_hashes(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                    for t, item, cover, n, made in items.found(words, firsts):
                        found.append((ids[lo + t].as_py(), items.ids[item], cover, n,
                                      [dict(item_word=i, text_word=k, n=x) for i, k, x in made]))
                columns = list(zip(*found, strict=True)) or [[]] * 5
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), TILE_TYPE]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                                 ["doc_id", "item_id", "coverage", "n_shared", "tiles"])

        out = out.unionByName(rows.mapInArrow(run, SCHEMA))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH,
                      min_cover: float = MIN_COVER) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    names, schema = docs.columns, StructType(docs.schema.fields)
    mark = fresh(docs, "_bytes")
    for items in item_blocks(benchmark, min_match, min_cover):
        block = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = byte_column(batch.column(len(names)))
                keep = np.ones(batch.num_rows, bool)
                for lo, hi in doc_slices(offsets):
                    words, firsts = word_hashes(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                    for t, *_ in block.value.found(words, firsts):
                        keep[lo + t] = False
                yield batch.select(names).filter(pa.array(keep))

        docs = docs.withColumn(mark, utf8(F.col("text"))).mapInArrow(run, schema)
    return docs


def op7_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
