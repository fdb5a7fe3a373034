"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Method: a document of more than ``capacity`` words fills whole bins and leaves a rest; rests are packed
best fit, largest first. Bins stand in order of what they have left and carry bitmaps of the sources
and duplicate clusters in them. The search starts at the tightest bin that has room and goes on to
its successors until one has no bit in common with the document. No bin holds two documents of one
source or of one cluster.

Rests are dealt into blocks of about ``block_rows`` documents, each packed by one task on its own; the
number of blocks grows with the input, a block's size does not. Rows are dealt by their place in the
input, so that no id, source or cluster makes a block large.

Defined results: a text without words is one piece of 0 words and packed like others. Repeated rows
are pieces of their own (and conflict, being copies). A null source is in conflict with no source; a null
doc_id is carried along. A row of a null cluster, where clusters are given, is a copy of none. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ruletrace.llm.common import lower_ascii, settled, table

CAPACITY, BLOCK_ROWS = 2048, 4096
CHUNK = 128
PIECES = "doc_id long, piece int, start long, n_tokens long, source string, bin string"


def pack(sizes: np.ndarray, conflicts: list[np.ndarray], capacity: int) -> np.ndarray:
    """The bin of each item, best fit in the order given. ``conflicts``: group numbers per item, -1 for none."""
    n = len(sizes)
    words, masks = [], []
    width = 0
    for groups in conflicts:
        # Only groups with several members in the block can conflict; each of them is one bit.
        known, code, count = np.unique(groups, return_inverse=True, return_counts=True)
        bit = np.where((count > 1) & (known >= 0), np.cumsum((count > 1) & (known >= 0)) - 1, -1)[code] if n else code
        words.append(np.where(bit >= 0, width + bit // 64, 0))
        masks.append(np.where(bit >= 0, np.uint64(1) << (np.maximum(bit, 0) % 64).astype(np.uint64), np.uint64(0)))
        width += int(bit.max(initial=-1)) // 64 + 1
    bits = np.zeros((n, max(width, 1)), np.uint64)
    left, slots, where = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    bins = 0
    for i in range(n):
        size, at, found = int(sizes[i]), bisect_left(left, sizes[i], 0, bins), -1
        while at < bins:
            part = slots[at:min(at + CHUNK, bins)]
            clash = np.zeros(len(part), np.uint64)
            for word, mask in zip(words, masks, strict=True):
                clash |= bits[part, word[i]] & mask[i]
            free = np.flatnonzero(clash == 0)
            if len(free):
                found = at + int(free[0])
                break
            at += CHUNK
        if found < 0:
            slot, found, rest = bins, bins, capacity - size
            bins += 1
        else:
            slot, rest = int(slots[found]), int(left[found]) - size
        to = bisect_left(left, rest, 0, found)
        left[to + 1:found + 1] = left[to:found].copy()
        slots[to + 1:found + 1] = slots[to:found].copy()
        left[to], slots[to], where[i] = rest, slot, slot
        for word, mask in zip(words, masks, strict=True):
            bits[slot, word[i]] |= mask[i]
    return where


def pieces(docs: DataFrame, capacity: int, cluster: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` words, with source and cluster (a column, or else texts equal but for case and blanks)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = r"[\x20\x09-\x0D]+"
    plain = lower_ascii(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), blank, " "))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"),
        (F.xxhash64(plain) if cluster is None else F.col(cluster).cast("string")).alias("cluster"), F.monotonically_increasing_id().alias("row"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1)
    return rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))) \
        .withColumn("n_tokens", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity))


def packing(docs: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, start (first word), n_tokens, source and bin of every piece of ``docs`` (doc_id, text, source).

    ``cluster`` names a column with the duplicate cluster of a row, such as the component of ``simhash_groups``; null is in
    conflict with none. Without it, a cluster is texts that are equal but for case and blanks.
    """
    cut = settled(pieces(docs, capacity, cluster), "packing-pieces")
    blocks = max(1, -(-cut.where(F.col("n_tokens") < capacity).count() // block_rows))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["n_tokens", "doc_id", "row"], ascending=[False, True, True], kind="stable",
                                  na_position="first").reset_index(drop=True)
        source = pd.factorize(block["source"])[0]  # -1 for null
        cluster = pd.factorize(block["cluster"])[0]
        found = pack(block["n_tokens"].to_numpy(), [source, cluster], capacity)
        block["bin"] = [f"{b}:{x}" for b, x in zip(block["block"], found, strict=True)]
        return block[["doc_id", "piece", "start", "n_tokens", "source", "bin"]]

    start = (F.col("piece") * capacity).alias("start")
    full = cut.where(F.col("n_tokens") == capacity).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), start, F.col("n_tokens").cast("long").alias("n_tokens"),
        "source", F.concat_ws(":", F.lit("whole"), F.col("row"), F.col("piece")).alias("bin"))
    rests = cut.where(F.col("n_tokens") < capacity).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), start, F.col("n_tokens").cast("long").alias("n_tokens"),
        "source", "cluster", "row", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    return full.unionByName(rests.groupBy("block").applyInPandas(run, PIECES))


def op4_best_fit_packing(spark, sf_dir):
    return packing(table(spark, sf_dir, "documents"))
