"""Merkle manifest of a dataset by superblocks.

Leaves are digests of rows; each tree (one a language) takes its leaves in order of doc_id, every
``FANOUT`` consecutive nodes become one, until one is left, the subroot; the subroots of all trees are
the leaves of a last tree in the same way.

A node's place in its tree comes from a range partitioning: its place in the part plus the rows of the
tree in the parts before.  Places are cut in superblocks of ``FANOUT ** depth``; one grouped task
collapses the ``depth`` levels of a superblock, and the superblocks' roots, as the nodes of the next
round, are reduced in the same way.  Proofs go down again: a superblock gets the path from its root to
the root of all (the upper proof), and each of its nodes' own path within the superblock is put before
it.  So a task holds one superblock, whatever the size of a tree; texts are read once and never
shuffled; what is written is some 100 bytes a row.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FANOUT = 8
#: Levels that one task collapses: 512 nodes.
DEPTH = 3
#: Parts and trees whose offsets may be broadcast; beyond it they are joined by a shuffle.
FEW = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sealed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of a row: each value with its byte count before it, or ``-`` if null."""
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def steps(n: int, fanout: int) -> int:
    """Levels from n nodes to one."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def collapse(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of a superblock and of the ``levels`` levels above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([sealed("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def paths(levels: list[list[str]], fanout: int = FANOUT) -> list[list[tuple[str, str]]]:
    """For each node of the lowest level, the siblings (before it, after it) of every level up to the last."""
    found: list[list[tuple[str, str]]] = [[] for _ in levels[-1]]
    for nodes in levels[-2::-1]:
        below = []
        for i in range(len(nodes)):
            run = i - i % fanout
            below.append([("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])), *found[i // fanout]])
        found = below
    return found


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings lead to."""
    for before, after in path:
        node = sealed(before + node + after)
    return node


def placed(nodes: DataFrame, order: list[str], scratch: Scratch, parts: int) -> DataFrame:
    """nodes (with ``tree``) and each one's place ``idx`` in its tree by ``order``, and its tree's size ``n``.

    The rows are written once in ranges of (tree, order), so that a place is a row number within a part
    and a count of the parts before it; a tree of any share of the rows lies in as many parts.
    """
    ranges = nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    rows = scratch.keep(ranges.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.keep(counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("tree")).alias("n")))
    few = offsets.count() <= FEW
    return rows.join(F.broadcast(offsets) if few else offsets, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _levels(n: int, fanout: int, depth: int) -> int:
    """Levels that a round collapses in a tree of n nodes: a tree of one superblock ends at its root."""
    return min(depth, steps(n, fanout))


def rounds(nodes: DataFrame, scratch: Scratch, fanout: int, depth: int) -> list[DataFrame]:
    """nodes (tree, idx, node binary, n), and their superblocks' roots, and so on until every tree has one node."""
    span = fanout**depth

    def run(key, group):
        group, n = group.sort_values("idx"), int(group["n"].iloc[0])
        top = collapse([x.hex() for x in group["node"]], _levels(n, fanout, depth), fanout)[-1]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "node": [bytes.fromhex(top[0])], "n": [-(-n // span)]})

    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        cut = out[-1].select("tree", "idx", "node", "n", F.expr(f"idx div {span}").alias("block"))
        out.append(scratch.keep(cut.groupBy("tree", "block").applyInPandas(run, "tree string, idx long, node binary, n long")))
        most = -(-most // span)
    return out


def _below(nodes: DataFrame, above: DataFrame, fanout: int, depth: int, run, schema: str) -> DataFrame:
    """run(a superblock's rows, their paths to the root of all, the superblock's row of ``above``) for every superblock.

    above: (tree, idx, before, after) of the superblocks' roots, one row each, and what run needs beside it.
    """

    def block(rows, upper):
        rows, upper = rows.sort_values("idx"), upper.iloc[0]
        rest = list(zip(upper["before"], upper["after"]))
        levels = collapse([x.hex() for x in rows["node"]], _levels(int(rows["n"].iloc[0]), fanout, depth), fanout)
        return run(rows, [[*own, *rest] for own in paths(levels, fanout)], upper)

    cut = nodes.withColumn("block", F.expr(f"idx div {fanout**depth}"))
    return cut.groupBy("tree", "block").cogroup(above.withColumnRenamed("idx", "block").groupBy("tree", "block")).applyInPandas(block, schema)


def _down(levels: list[DataFrame], above: DataFrame, scratch: Scratch, fanout: int, depth: int) -> DataFrame:
    """(tree, idx, before, after) of the nodes of the first of ``levels``, from those of the round after the last."""

    def told(rows, found, _):
        return pd.DataFrame({"tree": rows["tree"].to_numpy(), "idx": rows["idx"].to_numpy(), "before": [[b for b, _ in p] for p in found], "after": [[a for _, a in p] for p in found]})

    for nodes in levels[::-1]:
        above = scratch.keep(_below(nodes.select("tree", "idx", "node", "n"), above, fanout, depth, told, "tree string, idx long, before array<string>, after array<string>"))
    return above


def manifest(docs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH, parts: int | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of docs.

    A row's proof is the digest of its siblings on the way up, level by level through the subroot to the
    root, each level's from left to right.  Rows whose doc_id has a CRC-32 that 3 divides are tampered
    with (A-Z of their text lower-cased): folded_root is what the tampered row and the original
    siblings lead to, and verified says whether that is the root.

    Every column may be null: a null doc_id comes first in its tree and is never tampered with, rows of
    the null language are the first tree, and a null text stays null.  Empty texts are values; texts of
    any length are digested whole.  Rows of one language and doc_id follow each other by their leaf, and
    repeated rows are leaves of their own, in any order.  A row that is alone has an empty proof.
    Columns other than doc_id, source, lang, n_chars and text are not looked at; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(*own[:4], F.translate("text", UPPER, LOWER)))
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))
    # Digests are made once and written: to find ranges, rows are read twice.
    leaves = scratch.keep(docs.select(tree.alias("tree"), "doc_id", F.unhex(leaf(*own)).alias("node"), F.unhex(lowered).alias("tampered")))
    rows = placed(leaves, ["doc_id", "node"], scratch, parts)
    trees = rounds(rows, scratch, fanout, depth)
    subroots = placed(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"], scratch, parts)
    tops = rounds(subroots, scratch, fanout, depth)
    root = tops[-1].first()
    nothing = F.array().cast("array<string>")
    above = _down(tops[:-1], tops[-1].select("tree", "idx", nothing.alias("before"), nothing.alias("after")), scratch, fanout, depth)
    above = subroots.select("name", "idx").join(above, "idx").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "before", "after")
    above = _down(trees[1:-1], above, scratch, fanout, depth).join(subroots.select(F.col("name").alias("tree"), F.hex("node").alias("subroot")), "tree")
    above = above.withColumn("root", F.lit(root["node"].hex() if root else None).cast("string"))

    def proved(rows, found, upper):
        leaves = [x.hex() for x in rows["node"]]
        shown = [x.hex() if x is not None else own for x, own in zip(rows["tampered"], leaves)]
        proofs = [sealed("".join(b + a for b, a in path)) for path in found]
        ends = [folded(x, path) for x, path in zip(shown, found)]
        return pd.DataFrame({"id": rows["id"].to_numpy(), "leaf": leaves, "subroot": upper["subroot"].lower(), "root": upper["root"], "proof_sha256": proofs, "folded_root": ends, "verified": [x == upper["root"] for x in ends]})

    numbered = rows.select("tree", "idx", "n", "node", "tampered", F.col("doc_id").cast("string").alias("id"))
    out = _below(numbered, above, fanout, depth, proved, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.select(F.col("id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def query(spark, sf_dir):
    from .common import read

    return manifest(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE facts AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS lowered,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS front,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) AS crc FROM documents
), leaves AS (
  SELECT doc_id, tree, sha256(front || body) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(front || lowered) ELSE sha256(front || body) END AS shown FROM facts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes AS (
  SELECT 0 AS level, tree, idx, leaf AS node, n FROM ranked
  UNION ALL
  SELECT level + 1, tree, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (max(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY level, tree, idx // 8
), subroots AS (
  SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, '' AS tree, idx, node, n FROM subroots
  UNION ALL
  SELECT level + 1, tree, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (max(n) + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, tree, idx // 8
), around AS (
  SELECT kind, level, tree, idx, n, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (SELECT 0 AS kind, * FROM nodes UNION ALL SELECT 1, * FROM tops) WHERE n > 1
  WINDOW w AS (PARTITION BY kind, level, tree, idx // 8 ORDER BY idx)
), climb AS (
  SELECT doc_id, leaf, tree AS lang, 0 AS kind, 0 AS level, tree, idx, n, shown AS node, '' AS proof FROM ranked
  UNION ALL
  SELECT c.doc_id, c.leaf, c.lang, CASE WHEN c.n = 1 THEN 1 ELSE c.kind END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END, CASE WHEN c.n = 1 THEN '' ELSE c.tree END,
    CASE WHEN c.n = 1 THEN s.idx ELSE c.idx // 8 END, CASE WHEN c.n = 1 THEN s.n ELSE (c.n + 7) // 8 END,
    CASE WHEN c.n = 1 THEN c.node ELSE sha256(a.before || c.node || a.after) END, CASE WHEN c.n = 1 THEN c.proof ELSE c.proof || a.before || a.after END
  FROM climb c JOIN subroots s ON c.lang = s.tree LEFT JOIN around a ON a.kind = c.kind AND a.level = c.level AND a.tree = c.tree AND a.idx = c.idx WHERE c.kind = 0 OR c.n > 1
)
SELECT c.doc_id, c.leaf, s.node AS subroot, t.node AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = t.node AS verified
FROM climb c JOIN subroots s ON c.lang = s.tree JOIN tops t ON t.n = 1 WHERE c.kind = 1 AND c.n = 1
"""
