"""The Merkle manifest against a plain tree, and the copies of its versions."""

import hashlib

import duckdb

from ruletrace.llm import merkle
from tests.llm.samples import crc, doc_rows, docs, lowered

SF_DIR = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, at, node):
    """Siblings up to the top, and the top made from the node."""
    seen = []
    for nodes in levels[:-1]:
        run = at // 8 * 8
        left, right = nodes[run:at], nodes[at + 1:run + 8]
        seen += left + right
        node, at = h(*left, node, *right), at // 8
    return seen, node


def plain(rows):
    langs = {}
    for r in rows:
        langs.setdefault("" if r["lang"] is None else "=" + r["lang"], []).append(r)
    for group in langs.values():
        group.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    names = sorted(langs, key=lambda n: n.encode())
    trees = {n: tree([leaf(r, r["text"]) for r in langs[n]]) for n in names}
    upper, out = tree([trees[n][-1][0] for n in names]), []
    for k, n in enumerate(names):
        for i, r in enumerate(langs[n]):
            now = leaf(r, None if r["text"] is None else lowered(r["text"])) if crc(r["doc_id"], 3) == 0 else trees[n][0][i]
            own, top = climb(trees[n], i, now)
            over, root = climb(upper, k, top)
            out.append((r["doc_id"], trees[n][0][i], trees[n][-1][0], upper[-1][0], h(*own, *over), root, root == upper[-1][0]))
    return out


def same(got, rows):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(plain(rows), key=repr)


def test_small_rows(spark):
    frame = docs(spark, extra=True)
    got = merkle.manifest(frame).collect()
    same(got, frame.collect())
    assert all(r["copies"][-1] == r["folded_root"] for r in got if r["copies"])


def test_many_tiers(spark):
    """Blocks of eight, so that trees of few rows have several tiers; many languages, one of them with most rows."""
    rows = [(i, f"Text {i % 50}", f"l{i % 40}" if i % 3 == 0 else None if i % 7 == 0 else "en", "s", i) for i in range(700)]
    frame = docs(spark, rows)
    got = merkle.manifest(frame, 1).collect()
    same(got, frame.collect())
    assert {r["verified"] for r in got if r["copies"]} == {False} and all(r["verified"] for r in got if not r["copies"])


def test_table_and_sql(spark):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = merkle.manifest(frame).drop("copies").collect()
    same(got, frame.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = con.execute(merkle.ORACLE).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)


def test_one_lone_leaf_and_none(spark):
    frame = docs(spark, [(5, "Lone", None, None, None)])
    same(merkle.manifest(frame).collect(), frame.collect())
    assert merkle.manifest(docs(spark, [])).count() == 0
