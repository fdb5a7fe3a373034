"""Near copies against brute-force Jaccard similarity."""

import random

from pyspark.sql import functions as F

from ruletrace.llm import near_copies
from tests.llm.samples import blank_words, doc_rows, docs, lowered

SF_DIR = "/root/testdata/sf0.001"


def shingles(text):
    w = blank_words(lowered(text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(texts):
    sets = [shingles(t) for t in texts]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            shared = len(a & b)
            if group[i] != group[k] and (a == b or 5 * shared >= 4 * (len(a) + len(b) - shared)):
                group = [group[k] if g == group[i] else g for g in group]
    return group


def check(spark, rows, got):
    named = [r for r in rows if r[0] is not None]
    least = {}
    for g, r in zip(plain_groups([r[1] for r in named]), named):
        least[g] = min(least.get(g, (r[0], r[1] or "")), (r[0], r[1] or ""))
    kept = [(r["doc_id"], r["text"] or "") for r in got.where("doc_id IS NOT NULL").collect()]
    assert sorted(kept) == sorted(least.values())


def edited_rows():
    """Near copies at all similarities around 0.8, in which SimHash bits differ, and a group larger than a cell."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for _ in range(40):
        base = words(rng.randrange(30, 200))
        rows.append(base)
        for _ in range(rng.randrange(1, 3)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randrange(1, 1 + len(copy) // 25)):
                copy[at] = "edit"
            rows.append(copy)
    base = words(60)
    for i in range(60):  # similar to the base, but hardly to each other
        rows.append([*base[:i % 50 + 5], f"x{i}", *base[i % 50 + 6:]])
    rows.append(base)
    rng.shuffle(rows)
    return [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(rows)]


def test_groups_are_those_of_brute_force(spark):
    rows = edited_rows()
    frame = docs(spark, rows, extra=True)
    got = near_copies.one_of_near_copies(frame)
    assert got.dtypes == frame.dtypes
    check(spark, rows, got)


def test_odd_rows_and_repeated_ids(spark):
    rows = doc_rows()
    rows += [(0, "another text of the id that is the smallest of its group " + "and so on " * 9, "en", "s", 0)]
    got = near_copies.one_of_near_copies(docs(spark, rows, extra=True))
    check(spark, rows, got)
    assert got.where("doc_id IS NULL").count() == 2 and got.where("doc_id = 0").count() == 2


def test_table_of_documents(spark):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    check(spark, [(r["doc_id"], r["text"]) for r in frame.collect()], near_copies.one_of_near_copies(frame))


def family_rows(pairs):
    """Pairs of near copies of one family: all share keys, but only the two of a pair are similar enough."""
    rng = random.Random(17)
    base = [f"b{i}" for i in range(240)]
    rows = []
    for k in range(pairs):
        own = list(base)
        for at in rng.sample(range(0, 240, 6), 8):
            own[at] = f"p{k}-{at}"
        copy = list(own)
        copy[3 + 6 * rng.randrange(39)] = f"q{k}"
        rows += [own, copy]
    return [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(rows)]


def test_a_family_larger_than_many_cells(spark, monkeypatch):
    """Keys with hundreds of members of different groups: every link is found, whichever cell it lies in."""
    rows = family_rows(150)
    monkeypatch.setattr(near_copies, "CELL", 16)
    got = near_copies.one_of_near_copies(docs(spark, rows))
    want = plain_groups([r[1] for r in rows])
    assert len(set(want)) == 150
    check(spark, rows, got)


def crowd_rows(n):
    """A family alike in about 0.7, of which every tenth text has a near copy: few links, and pairs of all with all that may be links."""
    rng = random.Random(23)
    base = [f"b{i}" for i in range(240)]
    rows = []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(0, 240, 6), 4):
            own[at] = f"p{k}-{at}"
        rows.append(own)
        if k % 10 == 0:
            rows.append([*own[:-1], f"q{k}"])
    return [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(rows)]


def test_a_crowded_family_gives_no_pairs_of_all_with_all(spark, monkeypatch):
    rows, verified, looked_at = crowd_rows(120), near_copies.verified, []

    def counted(sets, pairs):
        looked_at.append(pairs.count())
        return verified(sets, pairs)

    monkeypatch.setattr(near_copies, "verified", counted)
    check(spark, rows, near_copies.one_of_near_copies(docs(spark, rows)))
    assert sum(looked_at) < 12 * len(rows)  # of 8646 pairs


def test_nodes_of_like_fingerprints_are_candidates(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(400)) + f" x{i}", "en", "s", 0) for i in range(5)] + [(9, "of its own " * 9, "en", "s", 0)]
    nodes = near_copies.signed(docs(spark, rows)).select("node", "fp")
    fps = {r["node"]: r["fp"] & (1 << 64) - 1 for r in nodes.collect()}
    close = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3}
    pairs = {tuple(r) for r in near_copies.alike_in_bits(nodes).collect()}
    assert close and {n for p in pairs for n in p} == {n for p in close for n in p}


def test_cells_at_all_distances_meet():
    for cells in range(1, 40):
        seen = set()
        for lo, hi, (first, last) in near_copies.rounds(cells):
            assert lo or (first, last) in near_copies.FIRST_PARTS
            seen |= {frozenset((i, (i + d) % cells)) for d in range(lo, max(lo, min(hi, cells // 2)) + 1) for i in range(cells)}
        assert len(seen) == cells * (cells + 1) // 2
    assert sorted(k for lo, hi in near_copies.FIRST_PARTS for k in range(lo, hi)) == list(range(near_copies.PARTS))


def handed_on(spark, n):
    """Rows that all rounds make of one key with n members, none of which are ever in one group."""
    members = spark.range(n).selectExpr("7L AS key", "id AS node", "10L AS n", "id AS label", "CAST('' AS BINARY) AS marks")
    (cells, blocks), = spark.sql(f"SELECT {n}L AS m, {10 * n}L AS s").select(*near_copies.divided("m", "s")).collect()
    rows = 0
    for into, nearest, farthest, parts in near_copies.turns(blocks, cells > blocks):
        dealt = members.withColumn("cells", F.lit(cells if into == "cells" else blocks)) \
            .withColumn("cell", F.expr("pmod(xxhash64(node), cells)"))
        rows += near_copies.seated(dealt, nearest, farthest).count() if parts in ((0, 1), (0, near_copies.PARTS)) else 0
    return rows


def test_members_of_a_large_key_are_not_handed_on_to_all_others(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CELL", 16)
    assert handed_on(spark, 6000) == 10 * handed_on(spark, 600) == 6 * 6000


def test_blocks_fit_a_task(spark):
    rows = spark.createDataFrame([(100, 1000), (10_000, 10_000), (1 << 20, 1 << 20), (10_000, 100 << 20)], "m long, s long")
    assert [tuple(r) for r in rows.select(*near_copies.divided("m", "s")).collect()] == [(1, 1), (79, 5), (8192, 32), (79, 79)]


def test_strips_of_a_crowd_meet_once(monkeypatch):
    monkeypatch.setattr(near_copies, "CELL", 4)
    for n, own, itself in ((11, 11, True), (11, 6, False), (3, 3, True), (9, 1, False)):
        met = [frozenset((x, y)) for lo, hi, first, last in near_copies._strips(n, own, itself)
               for x in range(lo, hi) for y in range(first, last) if lo != first or x < y]
        assert len(met) == len(set(met)) == (n * (n - 1) // 2 if itself else own * (n - own))


def test_no_rows(spark):
    assert near_copies.one_of_near_copies(docs(spark, []).limit(0)).count() == 0


def test_stars_are_known_as_such(spark, monkeypatch):
    from ruletrace.llm import components as stars
    names, settled = [], stars.settled
    monkeypatch.setattr(stars, "settled", lambda df, name: names.append(name) or settled(df, name))
    star = spark.createDataFrame([(1, 5), (7, 1), (2, 9), (9, 2), (3, 3)], "a long, b long")
    assert sorted(map(tuple, stars.components(star).collect())) == [(5, 1), (7, 1), (9, 2)]
    assert names == ["edges"]
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(40, 30), (40, 31)], "a long, b long")
    assert sorted(map(tuple, stars.components(chain).collect())) == [(k, 0) for k in range(1, 21)] + [(31, 30), (40, 30)]
