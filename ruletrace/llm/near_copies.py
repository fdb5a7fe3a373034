"""Near copies for the corpus: documents whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Method: documents with equal sets are one node. Every node has ``BANDS`` keys, each the hash of ``ROWS``
independent min-hashes: two nodes of similarity s share no key with chance (1 - s^ROWS)^BANDS, which is 6e-5 at
0.8 and less above. Nodes whose SimHash fingerprints (of the same shingles) are in one group of links of at most three bits, found
with the Golay keys of ``simhash``, are candidates too: each with the first of its group. Keys only name candidates. Of these, pairs that agree in under ``AGREE`` of all BANDS * ROWS marks go, where
a mark is 4 bits of a min-hash (a pair of 0.8 does so with chance below 1e-8), and a link is a pair whose exact similarity, of
whole sets, is ``LEAST`` or more. Groups are connected components of links.

Large groups give no pairs of all with all: the members of a key first meet the one of them that shares most
keys with others. The members of a key that still has several groups are then dealt into cells of about ``CELL``, and each cell meets
itself, which is done for a few of the keys first. After that they are dealt into ``BLOCKS`` larger cells, however many they are, and
each meets itself and then all others, at doubling distances in turn. So a member is handed on at most 1 + BLOCKS times or so, and what
grows with the square of a key are comparisons inside tasks only. Only keys of more than BLOCKS * BLOCK_SHINGLES shingles or
BLOCKS * BLOCK_MEMBERS members have more blocks, for a block has to fit a task. Members that are in one group by then do not meet, and of those that do only pairs with enough
equal marks leave the task, and no more of them than the cell has members. Cells with more (``crowded``: a family whose members are
all alike, but mostly not alike enough) meet once more with whole sets: their links are found inside the task, ``CELL`` by ``CELL`` members
at a time, and those leave it that join what they link, less than one for each member. At the end any two members of a key have met or
are in one group: nothing else is left to chance.

Why not the Golay keys of ``simhash`` alone: their links differ in at most three of 64 bits, and pairs of similarity 0.8 to 1 mostly
differ in four to eleven.

Defined results: words are separated by blanks and told apart without the case of A-Z. Fewer than five words
are one shingle; null and empty texts are copies of each other. Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ruletrace.llm.common import (BASE, BLANK_WORDS, LOWERED, byte_column, chained, doc_slices, fresh, mixed, prefix_sums, settled,
                                  span_hash, utf8, word_spans, workspace)
from ruletrace.llm.components import components
from ruletrace.llm.simhash import grouped

WIDTH, BANDS, ROWS, CELL = 5, 32, 6, 128
BLOCKS, BLOCK_MEMBERS, BLOCK_SHINGLES = 5, 1 << 15, 1 << 20
AGREE = 123
#: The first rounds take 1, then 3, then the other 12 of 16 parts of the keys.
FIRST_PARTS, PARTS = ((0, 1), (1, 4), (4, 16)), 16
#: Similarity as a fraction: shared shingles x (up + down) >= up x (sizes of both sets).
LEAST = (4, 5)
CHUNK, PAIRS_AT_ONCE, SHINGLES_AT_ONCE = 1 << 12, 1 << 17, 1 << 15
CELL_KEY = ["key", "distance", "cell"]
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted different hashes of each text's shingles."""
    for lo, hi in doc_slices(offsets):
        part = LOWERED[raw[offsets[lo]:offsets[hi]]]
        starts, ends, firsts = word_spans(part, offsets[lo:hi + 1] - offsets[lo], BLANK_WORDS)
        words = span_hash(prefix_sums(part), starts, ends)
        whole = chained(words, width)
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            yield np.unique(whole[a:b - width + 1] if b - a >= width else chained(words[a:b], b - a) if b > a else words[:0])


def node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), len(shingles))


def set_fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(shingles), CHUNK):
        ones += np.unpackbits(shingles[lo:lo + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def band_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sets x BANDS) of sets that are not empty, and 4 bits of each min-hash (sets x BANDS * ROWS / 2 bytes)."""
    least = np.full((len(sets), BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64)
    for i, s in enumerate(sets):
        for lo in range(0, len(s), CHUNK):
            np.minimum(least[i], (FACTORS[:, None] * s[lo:lo + CHUNK]).min(1), out=least[i])
    marks = (least >> np.uint64(60)).astype(np.uint8)
    marks = marks[:, ::2] << 4 | marks[:, 1::2]
    least = least.reshape(len(sets), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), least.shape[:2])
    for k in range(ROWS):
        out = mixed(out * np.uint64(BASE) + least[:, :, k])
    return out, marks


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"), _spelled(docs).alias("spelled"))


def _spelled(docs: DataFrame) -> Column:
    """Tells texts of one id apart; null is empty."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, node, size of the set, its fingerprint, band keys and min-hash marks of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = byte_column(batch.column(1))
            for lo, hi in doc_slices(offsets):
                sets = list(shingle_sets(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]))
                sizes = np.array([len(s) for s in sets])
                keys, marks = band_keys([s for s in sets if len(s)])
                marks = iter(marks)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(np.array([node(s) for s in sets], np.uint64).view(np.int64)), pa.array(sizes),
                     pa.array(np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64)),
                     pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(BANDS * (sizes > 0))]).astype(np.int32), pa.array(keys.view(np.int64).ravel())),
                     pa.array([next(marks).tobytes() if n else b"" for n in sizes], pa.binary())],
                    ["doc_id", "spelled", "node", "n", "fp", "keys", "marks"])

    return _texts(docs).mapInArrow(run, "doc_id long, spelled long, node long, n long, fp long, keys array<long>, marks binary")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles of every node in ``wanted`` (column of), once each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = byte_column(batch.column(1))
            for lo, hi in doc_slices(offsets):
                sets = list(shingle_sets(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array([node(s) for s in sets], np.uint64).view(np.int64)),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], ["node", "shingles"])

    return _texts(docs).mapInArrow(run, "node long, shingles array<long>") \
        .join(wanted, F.col("node") == F.col("of"), "left_semi").dropDuplicates(["node"])


def _equal(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many places marks agree."""
    x = one ^ two
    return ((x & 0xF0) == 0).sum(-1) + ((x & 0x0F) == 0).sum(-1)


def _marks(column: pa.Array, n: int) -> np.ndarray:
    return byte_column(column)[0].reshape(n, -1)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose marks (columns one and two) agree in AGREE places or more."""
    for batch in batches:
        one, two = (_marks(batch.column(k), batch.num_rows) for k in (2, 3))
        yield batch.select(["a", "b"]).filter(pa.array(_equal(one, two) >= AGREE))


def _sides(members: pa.Array, itself: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Members (a struct array) of all cells in order, the first one each meets, how many, and each cell's first and last place.

    A cell has its own members (far = 0), and those of the one at a distance (far = 1) if it does not meet itself.
    """
    fields, ends = members.flatten(), members.offsets.to_numpy() - members.offsets[0].as_py()
    cell, far = np.repeat(np.arange(len(members)), np.diff(ends)), fields.field("far").to_numpy()
    fields = fields.take(pa.array(np.lexsort((far, cell))))
    own = np.bincount(cell[far == 0], minlength=len(members))
    place = np.arange(len(cell))
    first = np.where(itself[cell], place + 1, (ends[:-1] + own)[cell])
    count = np.where(place < (ends[:-1] + own)[cell], np.maximum(ends[1:][cell] - first, 0), 0)
    return fields, first, count, ends


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of two cells that may be links: other labels, fitting sizes, enough equal marks.

    A row has a key, distance and cell, whether the cell meets itself, and a list of members (far, node, n, label, marks). All cells
    of a batch are paired at once, some of the pairs at a time. A cell with more pairs than members gives one row without a pair.
    """
    up, down = LEAST
    for batch in batches:
        fields, first, count, ends = _sides(batch.column("members"), batch.column("itself").to_numpy(zero_copy_only=False))
        cell = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        node, n, label = (fields.field(k).to_numpy() for k in ("node", "n", "label"))
        marks, total, lo = _marks(fields.field("marks"), len(fields)), np.cumsum(count), 0
        kept, found = np.zeros(batch.num_rows, np.int64), [np.zeros((3, 0), np.int64)]
        while lo < len(cell):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] - count[lo] + PAIRS_AT_ONCE, "right")))
            x = np.repeat(np.arange(lo, hi), count[lo:hi])
            y = np.arange(len(x)) + np.repeat(first[lo:hi] - (total[lo:hi] - count[lo:hi] - total[lo] + count[lo]), count[lo:hi])
            apart = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * down >= np.maximum(n[x], n[y]) * up)
            x, y = x[apart], y[apart]
            good = _equal(marks[x], marks[y]) >= AGREE
            x, y = x[good], y[good]
            kept += np.bincount(cell[x], minlength=len(kept))
            few = kept[cell[x]] <= np.diff(ends)[cell[x]]
            x, y = x[few], y[few]
            found.append(np.stack([cell[x], np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]))
            lo = hi
        at, a, b = np.concatenate(found, 1)
        crowded = kept > np.diff(ends)
        at, a, b = (v[~crowded[at]] for v in (at, a, b))
        crowd = np.flatnonzero(crowded)
        at, none = pa.array(np.concatenate([at, crowd])), pa.nulls(len(crowd), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in CELL_KEY), pa.concat_arrays([pa.array(a), none]),
                                          pa.concat_arrays([pa.array(b), none])], [*CELL_KEY, "a", "b"])


def _shared(sets: list[np.ndarray], own: int, itself: bool) -> np.ndarray:
    """How many shingles each of the first ``own`` sets (rows) shares with each that it meets (all, or those after them)."""
    others = 0 if itself else own
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((own, len(sets) - others))
    for lo in range(0, len(values), SHINGLES_AT_ONCE):
        i, k = np.searchsorted(at, (lo, lo + SHINGLES_AT_ONCE))
        has = np.zeros((len(sets), min(SHINGLES_AT_ONCE, len(values) - lo)), np.float32)
        has[row[i:k], at[i:k] - lo] = 1  # sums of at most SHINGLES_AT_ONCE ones are exact
        out += has[:own] @ has[others:].T
    return out


def _strips(n: int, own: int, itself: bool) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of about CELL of n members that meet: the first ``own`` and all, or the first ``own`` and the others."""
    for lo in range(0, own, CELL):
        for first in range(lo if itself else own, n, CELL):
            yield lo, min(lo + CELL, own), first, min(first + CELL, n)


def _crowd_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of members of two cells with whole sets, those that join two groups of the cells' members first."""
    up, down = LEAST
    for batch in batches:
        found = []
        for members, itself in zip(batch.column("members"), batch.column("itself").to_pylist(), strict=True):
            fields = members.values
            fields = fields.take(pa.array(np.argsort(fields.field("far").to_numpy(), kind="stable")))
            node, label = fields.field("node").to_numpy(), fields.field("label").to_numpy()
            lists = fields.field("shingles")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            sets = [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
            own = int((fields.field("far").to_numpy() == 0).sum())
            n, (groups, group) = np.diff(ends), np.unique(label, return_inverse=True)
            root = np.arange(len(groups))
            for lo, hi, first, last in _strips(len(sets), own, itself):
                here = root[group]
                if len(np.unique(np.concatenate([here[lo:hi], here[first:last]]))) == 1:
                    continue
                alone = lo == first
                shared = _shared(sets[lo:hi] if alone else sets[lo:hi] + sets[first:last], hi - lo, alone)
                links = shared * (up + down) >= up * (n[lo:hi, None] + n[None, first:last])
                links &= here[lo:hi, None] != here[None, first:last]
                for x, y in zip(*np.nonzero(links), strict=True):
                    r, q = root[group[lo + x]], root[group[first + y]]
                    if r != q:
                        root[root == r] = q
                        found.append(sorted((int(node[lo + x]), int(node[first + y]))))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def likely(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in enough marks."""
    marks = nodes.select(F.col("node").alias("a"), F.col("marks").alias("one"))
    both = pairs.join(marks, "a").join(marks.withColumnsRenamed({"a": "b", "one": "two"}), "b").select("a", "b", "one", "two")
    return both.mapInArrow(_agreeing, "a long, b long")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity is LEAST or more."""
    up, down = LEAST
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    shared = F.size(F.array_intersect("one", "two"))
    return pairs.join(first, "a").join(other, "b") \
        .where(shared * (up + down) >= up * (F.size("one") + F.size("two"))).select("a", "b")


def _fits(na: str, nb: str):
    """Sets whose sizes alone do not rule the similarity out."""
    return F.least(na, nb) * LEAST[1] >= F.greatest(na, nb) * LEAST[0]


def distances(turn: int) -> tuple[int, int]:
    """Distances of cells that meet in a turn: 0, 1, 2 to 3, 4 to 7 and so on."""
    return (0, 0) if turn == 0 else (1 << turn - 1, (1 << turn) - 1)


def rounds(cells: int) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """(nearest, farthest, parts of the keys) of all rounds for keys of at most so many cells."""
    for parts in FIRST_PARTS:
        yield 0, 0, parts
    turn = 1
    while distances(turn)[0] <= cells // 2:
        yield *distances(turn), (0, PARTS)
        turn += 1


def turns(blocks: int, larger: bool) -> Iterator[tuple[str, int, int, tuple[int, int]]]:
    """(column with the number of cells, nearest, farthest, parts of the keys) of all rounds, for keys of at most so many blocks.

    ``larger`` says whether blocks of some key are larger than its cells.
    """
    all_rounds = list(rounds(blocks))
    yield from (("cells", *r) for r in all_rounds if not r[0])
    if larger:
        yield "blocks", 0, 0, (0, PARTS)
    yield from (("blocks", *r) for r in all_rounds if r[0])


def divided(members: str, shingles: str) -> list[Column]:
    """Into how many cells and blocks a key with so many members and shingles is dealt."""
    cells = F.ceil(F.col(members) / CELL)
    blocks = F.greatest(F.lit(BLOCKS), F.ceil(F.col(members) / BLOCK_MEMBERS), F.ceil(F.col(shingles) / BLOCK_SHINGLES))
    return [cells.alias("cells"), F.least(cells, blocks).alias("blocks")]


def seated(dealt: DataFrame, nearest: int, farthest: int) -> DataFrame:
    """The members (key, node, n, label, marks, in a cell of so many) at every place where they meet others in a round."""
    # A key of k cells needs distances up to k / 2: farther ones are near from the other side.
    far = F.sequence(F.lit(nearest), F.least(F.lit(farthest), F.greatest(F.lit(nearest), F.floor(F.col("cells") / 2).cast("int"))))
    rows = dealt.withColumn("distance", F.explode(far))
    member = [F.struct(F.lit(k).alias("far"), "node", "n", "label", "marks") for k in (0, 1)]
    own = rows.select("key", "distance", "cell", member[0].alias("member"))
    if nearest:
        own = own.unionByName(rows.select(
            "key", "distance", F.pmod(F.col("cell") - F.col("distance"), F.col("cells")).alias("cell"), member[1].alias("member")))
    return own


def alike_in_bits(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a node and the smallest one of its group of fingerprints, at most three bits from link to link."""
    rows = settled(nodes.select(F.col("node").alias("doc_id"), "fp"), "fingerprints")
    groups = grouped(rows).withColumnsRenamed({"fp": "of", "component_id": "least_node"})
    both = rows.join(groups, F.col("fp") == F.col("of")).where(F.col("doc_id") != F.col("least_node"))
    return both.select(F.least("doc_id", "least_node").alias("a"), F.greatest("doc_id", "least_node").alias("b"))


def linked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """node and root of every node that is linked to a smaller one; ``marks`` as ``signed`` gives them."""
    with workspace(docs.sparkSession):
        return settled(_linked(docs, marks), "roots", stay=True)


def _linked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    nodes = settled(marks.select("node", "n", "fp", "keys", "marks").dropDuplicates(["node"]), "nodes")
    keys = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = settled(keys.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
                     .where("members > 1").select("of", "members", *divided("members", "shingles")), "shared-keys")
    members = settled(keys.join(shared, F.col("key") == F.col("of")).drop("of"), "members")
    degrees = members.groupBy(F.col("node").alias("of")).agg(F.sum("members").alias("degree"))
    ranked = members.join(degrees, F.col("node") == F.col("of")).drop("of")
    hubs = settled(ranked.groupBy(F.col("key").alias("of")).agg(F.max(F.struct("degree", "node", "n")).alias("hub"))
                   .select("of", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    pairs = members.join(hubs, F.col("key") == F.col("of")).where(F.col("node") != F.col("hub")).where(_fits("n", "hub_n"))
    pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    pairs = pairs.unionByName(alike_in_bits(nodes.where("n > 0"))).distinct()
    met = settled(likely(nodes, pairs), "pairs")
    # Texts are read once more for the sets of nodes that share a key or are in a pair; all rounds read these.
    wanted = members.select(F.col("node").alias("of")).unionByName(met.select(F.explode(F.array("a", "b")).alias("of"))).distinct()
    sets = settled(sets_of(docs, wanted), "sets")
    links = settled(verified(sets, met), "links")
    roots = settled(components(links), "components")
    # Labels and marks are looked up once for each node, not for each of its keys.
    holders = members.groupBy(F.col("node").alias("of")).agg(F.collect_list(F.struct("key", "cells", "blocks")).alias("own"))
    holders = settled(nodes.select("node", "n", "marks").join(holders, F.col("node") == F.col("of")).drop("of"), "holders")
    labelled = _labelled(holders, roots)
    blocks, larger = shared.agg(F.max("blocks"), F.max(F.col("cells") > F.col("blocks"))).first()
    for into, nearest, farthest, (lo, hi) in turns(blocks or 0, bool(larger)):
        named = labelled.select("node", "n", "label", "marks", F.explode("own").alias("_own")) \
            .where(F.pmod("_own.key", F.lit(PARTS)).between(lo, hi - 1)) \
            .where("_own.cells > _own.blocks" if into == "blocks" and not nearest else F.col(f"_own.{into}") >= 2 * nearest) \
            .select("_own.key", "node", "n", "label", "marks", F.col(f"_own.{into}").alias("cells"))
        several = named.groupBy(F.col("key").alias("of")).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        dealt = settled(named.join(several.select("of"), F.col("key") == F.col("of"), "left_semi")
                        .withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells"))), "dealt")
        if dealt.isEmpty():
            if nearest:  # keys of later rounds are among these, and groups only grow
                break
            continue
        own = seated(dealt, nearest, farthest)
        # About as many members as a cell or two have, however many the key has.
        itself = (F.col("distance") == 0).alias("itself")
        found = settled(own.groupBy(*CELL_KEY).agg(F.collect_list("member").alias("members")).select(*CELL_KEY, itself, "members")
                        .mapInArrow(_met, "key long, distance int, cell long, a long, b long"), "found")
        pairs = settled(found.where("a IS NOT NULL").select("a", "b").distinct().join(met, ["a", "b"], "left_anti"), "pairs")
        crowded = found.where("a IS NULL").select(*[F.col(c).alias(f"_{c}") for c in CELL_KEY])
        more = []
        if not pairs.isEmpty():
            met = met.unionByName(pairs)
            more.append(settled(verified(sets, pairs), "links"))
        if not crowded.isEmpty():
            # Sets are looked up once for each node, not for each of its places.
            places = own.join(crowded, [F.col(c) == F.col(f"_{c}") for c in CELL_KEY], "left_semi") \
                .groupBy("member.node", "member.label").agg(F.collect_list(F.struct(*CELL_KEY, "member.far")).alias("places"))
            crowd = places.join(sets.withColumnRenamed("node", "of"), F.col("node") == F.col("of")) \
                .select("node", "label", "shingles", F.explode("places").alias("_place")).select("_place.*", "node", "label", "shingles")
            crowd = crowd.groupBy(*CELL_KEY).agg(F.collect_list(F.struct("far", "node", "label", "shingles")).alias("members"))
            more.append(settled(crowd.select(itself, "members").mapInArrow(_crowd_links, "a long, b long").distinct(), "links"))
        more = [m for m in more if not m.isEmpty()]
        if more:
            links = reduce(DataFrame.unionByName, more, links)
            roots = settled(components(links), "components")
            labelled = _labelled(holders, roots)
    return roots


def _labelled(holders: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes that share keys, with the root of each in ``label``."""
    return settled(holders.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
                   .select("node", "n", "marks", "own", F.coalesce("root", "node").alias("label")), "labelled")


def one_of_near_copies(docs: DataFrame) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each group of near copies, with all its columns.

    Of rows that repeat that id in one group the one with the smallest text stays. Rows without id cannot be
    named in a group, and all stay.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    marks = settled(signed(named), "signed")
    roots = linked(named, marks)
    mark, group, own, place = (fresh(docs, c) for c in ("_spelled", "_group", "_own", "_place"))
    rows = marks.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left") \
        .select("doc_id", "spelled", F.coalesce("root", "node").alias("label"))
    least = settled(rows.groupBy(F.col("label").alias("of")).agg(F.min("doc_id").alias("least_id")), "least")
    keep = settled(rows.join(least, (F.col("label") == F.col("of")) & (F.col("doc_id") == F.col("least_id"))).select(
        F.col("doc_id").alias(own), F.col("spelled").alias(mark), F.col("label").alias(group)).distinct(), "kept")
    stays = named.join(keep, (F.col("doc_id").cast("long") == F.col(own)) & (_spelled(named) == F.col(mark)))
    # One id's rows in one group.
    stays = stays.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy("doc_id", "text"))).where(F.col(place) == 1)
    return stays.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
