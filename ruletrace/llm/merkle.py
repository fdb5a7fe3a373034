"""Merkle manifest of a dataset: a digest tree per language, proofs, and what tampering does to the root.

Method: a persistent tree with path copying. Leaves are numbered per language, and the tree is built in tiers: the
nodes of a tier lie in aligned blocks of 8**``TIER_LEVELS`` neighbours, a task builds the levels over a block, and the tops of
the blocks are the nodes of the next tier, until one node is left. The subroots of the languages are the nodes of one
more tree. On the way down each block learns the siblings above its top. A tampered leaf makes a version of its
own: in its block only the ancestors of the leaf are copied, all other nodes are shared with the original, and from the top
of the block the version goes on along the upper tiers to a root of its own. No task holds more than one block and the
siblings above it.

Defined results: a null column counts as ``-``; a null language is a language of its own and comes first; rows without
doc_id come first in their language and count as tampered (the checksum of an empty text is 0). Rows that repeat a doc_id
are ordered by their leaf, and rows that repeat as a whole are leaves of their own. Other columns are ignored. An
empty table has no leaf and gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ruletrace.llm.common import crc_mod, lower_ascii, settled, table

#: Nodes that become one, and levels that one task builds over a block.
ARITY, TIER_LEVELS = 8, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PLACE_BITS = 33  # of monotonically_increasing_id


def digest(parts: list[bytes]) -> bytes:
    """H: the lowercase hex sha256 of the parts, one after the other."""
    return sha256(b"".join(parts)).hexdigest().encode()


def framed(value: Column) -> Column:
    """A value as the leaf reads it: its number of bytes, a colon and the value, or ``-``."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the language as a key that is never null), leaf, and the leaf after tampering where a row is tampered with."""
    head = [framed(F.col(c)) for c in COLUMNS[:-1]]
    leaf = lambda text: F.sha2(F.concat(*head, framed(text)).cast("binary"), 256)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        leaf(F.col("text")).alias("leaf"),
        F.when(crc_mod(F.col("doc_id"), 3) == 0, leaf(lower_ascii(F.col("text")))).alias("changed"))


# ---- one block ----------------------------------------------------------------------------------


def levels_over(n: int, most: int) -> int:
    """Levels until one of n nodes is left, within a tier of ``most`` levels."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Block:
    """Nodes of an aligned block and the levels over them. Versions share all nodes but the ones they copy."""

    def __init__(self, nodes: list[bytes], size: int, most: int):
        self.levels = [nodes]
        for _ in range(levels_over(size, most)):
            below = self.levels[-1]
            self.levels.append([digest(below[i:i + ARITY]) for i in range(0, len(below), ARITY)])
        self.top = self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[bytes, bytes]]:
        """Per level the siblings left and right of the node and its ancestors."""
        out = []
        for nodes in self.levels[:-1]:
            run = at // ARITY * ARITY
            out.append((b"".join(nodes[run:at]), b"".join(nodes[at + 1:run + ARITY])))
            at //= ARITY
        return out


def copied(node: bytes, path: list[tuple[bytes, bytes]]) -> list[bytes]:
    """The ancestors that a version with this node copies, from its parent to its root."""
    out = []
    for left, right in path:
        node = digest([left, node, right])
        out.append(node)
    return out


# ---- numbering and tiers -------------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with ``place``, their number in the order within their tree, and ``size``, the rows of the tree.

    Rows are dealt by ranges of tree and order, so a tree of any size is spread; one small row per range and tree then
    tells how many come before.
    """
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    dealt = settled(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), name)
    dealt = dealt.select(*rows.columns, F.shiftright("_id", PLACE_BITS).alias("_part"),
                         F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1).alias("_at"))
    along = Window.partitionBy("_tree")
    earlier = along.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (dealt.groupBy(F.col("tree").alias("_tree"), F.col("_part").alias("_of"))
              .agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
              .select("_tree", "_of", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
                      F.sum("_rows").over(along).alias("size")))
    return (dealt.join(ranges, (F.col("tree") == F.col("_tree")) & (F.col("_part") == F.col("_of")))
            .select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"), "size"))


NODE = "tree string, place long, size long, node string"


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("place", 3 * levels))


def _columns(rows: pa.Table, *names: str) -> list[list]:
    return [rows.column(n).to_pylist() for n in names]


def _block_of(rows: pa.Table, levels: int) -> tuple[pa.Table, Block, int]:
    rows = rows.sort_by("place")
    size = rows.column("size")[0].as_py()
    return rows, Block([n.encode() for n in rows.column("node").to_pylist()], size, levels), size


def tier_above(nodes: DataFrame, name: str, levels: int) -> DataFrame:
    """The tops of the blocks of a tier, which are the nodes of the next one."""
    def run(rows: pa.Table) -> pa.Table:
        _, block, size = _block_of(rows, levels)
        return pa.table({"tree": [rows.column("tree")[0].as_py()], "place": [rows.column("block")[0].as_py()],
                         "size": [-(-size // ARITY ** levels)], "node": [block.top.decode()]}, pa.schema(
                             [("tree", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("node", pa.string())]))

    few = nodes.select("tree", "place", "size", "node")
    return settled(_blocks(few, levels).groupBy("tree", "block").applyInArrow(run, NODE), name)


def tiers(nodes: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """The tiers from the given nodes up to the one with a single node per tree."""
    out = [nodes]
    while (out[-1].agg(F.max("size")).first()[0] or 1) > 1:
        out.append(tier_above(out[-1], name, levels))
    return out


PATH = "tree string, place long, lefts array<string>, rights array<string>"


def paths_below(nodes: DataFrame, above: DataFrame, name: str, levels: int) -> DataFrame:
    """What is left and right of every node of a tier on the way to the root, given the same for the tops of its blocks."""
    def run(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows, block, _ = _block_of(rows, levels)
        lefts, rights = (upper.column(c)[0].as_py() for c in ("lefts", "rights"))
        tree, places = _columns(rows, "tree", "place")
        paths = [block.siblings(i) for i in range(len(places))]
        return pa.table({"tree": tree, "place": places, "lefts": [[a.decode() for a, _ in p] + lefts for p in paths],
                         "rights": [[b.decode() for _, b in p] + rights for p in paths]}, pa.schema(
                             [("tree", pa.string()), ("place", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))]))

    few = _blocks(nodes.select("tree", "place", "size", "node"), levels)
    return settled(few.groupBy("tree", "block").cogroup(above.groupBy("tree", "place")).applyInArrow(run, PATH), name)




def manifest(docs: DataFrame, levels: int = TIER_LEVELS) -> DataFrame:
    """Per document: doc_id, lang's subroot, root, leaf, proof_sha256, folded_root, verified, and the copied nodes of its version."""
    rows = numbered(leaves(docs), ["doc_id", "leaf"], "leaves")
    nodes = rows.withColumn("node", F.col("leaf"))
    own = tiers(nodes, "tier", levels)
    # The languages' subroots are the nodes of one more tree.
    subroots = own[-1].select("tree", F.col("node").alias("subroot"))
    langs = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("node")), ["name"], "languages")
    over = tiers(langs, "over", levels)
    root = over[-1].select("tree", F.col("node").alias("root"))
    above = over[-1].select("tree", "place", *[F.array().cast("array<string>").alias(c) for c in ("lefts", "rights")])
    for tier in reversed(over[:-1]):
        above = paths_below(tier, above, "paths", levels)
    # A row for each language, with the way from its subroot to the root; its single node has place 0.
    above = settled(langs.select("tree", "place", "name", F.col("node").alias("subroot")).join(above, ["tree", "place"]).join(root, "tree")
                    .select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "lefts", "rights", "subroot", "root"), "ways")
    ends = above.select(F.col("tree").alias("_tree"), "subroot", "root")
    above = above.select("tree", "place", "lefts", "rights")
    for tier in reversed(own[1:-1]):
        above = paths_below(tier, above, "paths", levels)
    return _judged(nodes, above, ends, levels)


OUT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
       "copies array<string>")


def _judged(nodes: DataFrame, above: DataFrame, ends: DataFrame, levels: int) -> DataFrame:
    """Every leaf's proof and its version's root; a row of ``above`` per block of leaves."""
    def run(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows, block, _ = _block_of(rows, levels)
        way = [(a.encode(), b.encode()) for a, b in zip(*(upper.column(c)[0].as_py() for c in ("lefts", "rights")), strict=True)]
        subroot, root = (upper.column(c)[0].as_py() for c in ("subroot", "root"))
        ids, leaf, changed = _columns(rows, "doc_id", "leaf", "changed")
        proofs, folded, copies = [], [], []
        for i, (was, now) in enumerate(zip(leaf, changed, strict=True)):
            path = block.siblings(i) + way
            proofs.append(digest([x for level in path for x in level]).decode())
            new = [n.decode() for n in copied((now or was).encode(), path)]
            folded.append(new[-1] if new else now or was)
            copies.append(new if now else [])
        return pa.table([pa.array(ids, pa.int64()), pa.array(leaf, pa.string()), pa.array([subroot] * len(ids), pa.string()),
                         pa.array([root] * len(ids), pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string()),
                         pa.array([f == root for f in folded], pa.bool_()), pa.array(copies, pa.list_(pa.string()))],
                        ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "copies"])

    upper = above.join(ends, F.col("tree") == F.col("_tree")).drop("_tree")
    return _blocks(nodes, levels).groupBy("tree", "block").cogroup(upper.groupBy("tree", "place")).applyInArrow(run, OUT)


def op12_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents")).drop("copies")


#: The same levels as rows: recursion over the level, one aggregate a node, then a fold of every leaf along its siblings.
ORACLE = """
WITH RECURSIVE
table_of AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
         CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
rows_of AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, text,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x))), lambda c, b:
             xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS tampered
  FROM documents, table_of),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen(text) || ':' || translate(text,
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM rows_of),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size
  FROM leaves),
own AS (
  SELECT 0 AS level, tree, place, size, leaf AS node FROM placed
  UNION ALL
  SELECT level + 1, tree, place // 8, (any_value(size) + 7) // 8, sha256(string_agg(node, '' ORDER BY place))
  FROM own WHERE size > 1 GROUP BY level, tree, place // 8),
tops AS (SELECT tree, level, node AS subroot FROM own WHERE size = 1),
over AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size, subroot AS node FROM tops
  UNION ALL
  SELECT level + 1, place // 8, (any_value(size) + 7) // 8, sha256(string_agg(node, '' ORDER BY place))
  FROM over WHERE size > 1 GROUP BY level, place // 8),
langs AS (SELECT tree, level AS height, subroot, row_number() OVER (ORDER BY tree) - 1 AS number FROM tops),
-- Every node by its step on the way up: first those of the language, then those above.
steps AS (
  SELECT o.tree, o.level AS step, o.place, o.node FROM own o JOIN langs USING (tree) WHERE o.level < height
  UNION ALL
  SELECT tree, height + v.level, v.place, v.node FROM langs, over v WHERE v.size > 1),
ways AS (
  SELECT p.doc_id, p.place AS leaf_place, p.tree, s.step, s.place, s.node,
         CASE WHEN s.step < height THEN p.place // (8 ** s.step)::BIGINT ELSE number // (8 ** (s.step - height))::BIGINT END AS mine
  FROM placed p JOIN langs USING (tree) JOIN steps s ON s.tree = p.tree
   AND s.place // 8 = CASE WHEN s.step < height THEN p.place // (8 ** (s.step + 1))::BIGINT ELSE number // (8 ** (s.step - height + 1))::BIGINT END),
beside AS (
  SELECT tree, leaf_place, step, coalesce(string_agg(node, '' ORDER BY place) FILTER (WHERE place < mine), '') AS lefts,
         coalesce(string_agg(node, '' ORDER BY place) FILTER (WHERE place > mine), '') AS rights
  FROM ways GROUP BY tree, leaf_place, step),
proofs AS (SELECT tree, leaf_place, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof FROM beside GROUP BY tree, leaf_place),
fold AS (
  SELECT tree, place, 0 AS step, coalesce(changed, leaf) AS node FROM placed
  UNION ALL
  SELECT f.tree, f.place, f.step + 1, sha256(b.lefts || f.node || b.rights)
  FROM fold f JOIN beside b ON b.tree = f.tree AND b.leaf_place = f.place AND b.step = f.step)
SELECT p.doc_id, p.leaf, l.subroot, (SELECT node FROM over WHERE size = 1) AS root,
       coalesce(r.proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = (SELECT node FROM over WHERE size = 1) AS verified
FROM placed p JOIN langs l USING (tree) LEFT JOIN proofs r ON r.tree = p.tree AND r.leaf_place = p.place
JOIN (SELECT tree, place, max_by(node, step) AS node FROM fold GROUP BY tree, place) f ON f.tree = p.tree AND f.place = p.place
"""
