"""Merkle manifest of a dataset, with proofs from checkpoints.

A leaf is the hash of a row; every ``FANOUT`` consecutive nodes become the hash of their hex digests,
per source up to a subroot and over the subroots up to the root. Only every ``EVERY``-th level is
stored. A proof needs the siblings on all levels: the missing ones are regenerated for each aligned
subtree (``FANOUT ** EVERY`` stored nodes, one row) from its stored descendants, handed to the nodes
below as their path, and dropped.

Rows are placed in their source by range partitions, so a hot source is spread over all tasks, and a
group never holds more than one aligned subtree. Everything is DataFrame code.

Defined results: a null field is ``-``; ids come in ascending order, null first, rows of one id by
their leaf; a null id is not tampered with; a null source is a source, before all others; rows alike
in all five fields have equal leaves and places of their own; no rows give no rows. Other columns
have no effect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm.common import group_name, positions, table
from renewlens.session import stage

FANOUT = 16
EVERY = 2  # levels from one stored level to the next
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PATH = "array<struct<left:string,right:string>>"


def h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return h(*[field(columns[f]) for f in FIELDS])


@dataclass(frozen=True)
class Tree:
    """Stored levels of a forest. ``levels[k]`` holds level ``k * EVERY``: tree, pos, node, size,
    where ``size`` is the number of the tree's nodes on level 0; ``roots``: tree, root."""

    levels: list[DataFrame]
    roots: DataFrame
    fanout: int
    every: int


def _regenerated(nodes: Column, fanout: int) -> Column:
    """Hashes of the runs of an array of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * fanout + 1, fanout), ""), 256))


def _subtrees(level: DataFrame, fanout: int, every: int, *more: str) -> DataFrame:
    """Aligned subtrees of a stored level, one row each: tree, size, block, items (pos order)."""
    block = F.floor(F.col("pos") / fanout**every).cast("bigint")
    item = F.struct("pos", "node", *more)
    return level.groupBy("tree", "size", block.alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _grown(level: DataFrame, height: int, fanout: int, every: int) -> DataFrame:
    """The next stored level, or the root where a tree ends before it."""
    trees = _subtrees(level, fanout, every).withColumn("n0", F.col("items.node"))
    node = F.element_at("n0", 1)
    for k in range(every):
        trees = trees.withColumn(f"n{k + 1}", _regenerated(F.col(f"n{k}"), fanout))
        node = F.when(F.col("size") > fanout ** (height + k), F.element_at(f"n{k + 1}", 1)).otherwise(node)
    return trees.select("tree", F.col("block").alias("pos"), node.alias("node"), "size")


def build(leaves: DataFrame, *, fanout: int = FANOUT, every: int = EVERY) -> Tree:
    """Stored levels over ``leaves`` (tree, pos, node, size and any further columns)."""
    levels, height, roots = [stage(leaves, "merkle")], 0, None
    while True:
        grown = stage(_grown(levels[-1], height, fanout, every), "merkle")
        height += every
        done = grown.where(F.col("size") <= fanout**height).select("tree", F.col("node").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        grown = grown.where(F.col("size") > fanout**height)
        if grown.isEmpty():
            return Tree(levels, roots, fanout, every)
        levels.append(grown)


def _steps(items: str, i: Column, size: Column, height: int, fanout: int, every: int) -> list[tuple[Column, Column, Column]]:
    """For item i of a subtree, per level: whether the tree has it, siblings to the left and right."""
    out = []
    for k in range(every):
        at, nodes = F.floor(i / fanout**k).cast("int"), F.col(f"{items}{k}")
        first = F.floor(at / fanout).cast("int") * fanout
        left = F.array_join(F.slice(nodes, first + 1, at - first), "")
        right = F.array_join(F.slice(nodes, at + 2, first + fanout - 1 - at), "")
        out.append((size > fanout ** (height + k), left, right))
    return out


def _with_missing_levels(trees: DataFrame, fanout: int, every: int) -> DataFrame:
    trees = trees.withColumn("n0", F.col("items.node"))
    for k in range(1, every):
        trees = trees.withColumn(f"n{k}", _regenerated(F.col(f"n{k - 1}"), fanout))
    return trees


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """Subtrees of the stored leaves with what is above them: tree, size, items, n0.., path, and the
    further columns of ``above`` (tree, path, ...), which says what follows a tree's root."""
    f, e = tree.fanout, tree.every
    extra = [c for c in above.columns if c not in ("tree", "path")]
    upper = None
    for k in range(len(tree.levels) - 1, -1, -1):
        more = [c for c in tree.levels[k].columns if c not in ("tree", "pos", "node", "size")]
        trees = _with_missing_levels(_subtrees(tree.levels[k], f, e, *more), f, e)
        top = trees.where(F.col("size") <= f ** (e * (k + 1))).join(above, "tree")
        if upper is not None:
            deep = trees.where(F.col("size") > f ** (e * (k + 1)))
            top = top.unionByName(deep.join(upper, ["tree", "block"]))
        if k == 0:
            return top

        def one(x: Column, i: Column) -> Column:
            here = [
                F.when(has, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(_PATH))
                for has, left, right in _steps("n", i, F.col("size"), e * k, f, e)  # noqa: B023
            ]
            return F.struct(x["pos"].alias("block"), F.concat(*here, F.col("path")).alias("path"))

        rows = top.withColumn("row", F.explode(F.transform("items", one)))
        upper = stage(rows.select("tree", "row.block", "row.path", *extra), "paths")
    raise AssertionError("a tree has a level")


def folded(node: Column, path: Column) -> Column:
    return F.aggregate(path, node, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def manifest(docs: DataFrame, *, fanout: int = FANOUT, every: int = EVERY) -> tuple[Tree, Tree]:
    """Trees of the sources (leaves with doc_id and the tampered leaf) and the tree over them."""
    columns = {f: F.col(f) for f in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    bad = leaf_of({**columns, "text": F.translate("text", UPPER, LOWER)})
    leaves = docs.select(
        group_name(F.col("source")).alias("tree"),
        F.col("doc_id"),
        leaf_of(columns).alias("node"),
        F.when(F.coalesce(hit, F.lit(False)), bad).alias("tampered"),
    )
    placed = positions(leaves, "tree", ["doc_id", "node"], "leaves")
    sizes = placed.groupBy("tree").agg(F.count("*").alias("size"))
    sources = build(placed.join(sizes, "tree"), fanout=fanout, every=every)
    roots = stage(sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node")), "roots")
    above = positions(roots, "tree", ["source"], "roots")
    return sources, build(above.withColumn("size", F.lit(roots.count()).cast("bigint")), fanout=fanout, every=every)


def proofs(sources: Tree, top: Tree) -> DataFrame:
    """One row per leaf: doc_id, leaf, tampered, subroot, root, siblings (text), folded_root."""
    end = top.roots.select("tree", F.array().cast(_PATH).alias("path"), "root")
    f, e = sources.fanout, sources.every

    def subroot(x: Column, i: Column) -> Column:
        here = [
            F.when(has, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(_PATH))
            for has, left, right in _steps("n", i, F.col("size"), 0, f, e)
        ]
        return F.struct(x["source"].alias("tree"), x["node"].alias("subroot"), F.concat(*here, F.col("path")).alias("path"))

    above = paths(top, end).withColumn("row", F.explode(F.transform("items", subroot))).select("row.*", "root")
    blocks = paths(sources, stage(above, "subroots"))
    rest = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    blocks = blocks.withColumn("rest", rest)

    def leaf(x: Column, i: Column) -> Column:
        steps = _steps("n", i, F.col("size"), 0, f, e)
        node, siblings = F.coalesce(x["tampered"], x["node"]), []
        for has, left, right in steps:
            node = F.when(has, h(left, node, right)).otherwise(node)
            siblings.append(F.when(has, F.concat(left, right)).otherwise(F.lit("")))
        return F.struct(
            x["doc_id"].alias("doc_id"),
            x["node"].alias("leaf"),
            F.sha2(F.concat(*siblings, F.col("rest")), 256).alias("proof_sha256"),
            node.alias("part"),
        )

    rows = blocks.select(F.explode(F.transform("items", leaf)).alias("row"), "subroot", "root", "path")
    rows = rows.select("row.*", "subroot", "root", folded(F.col("row.part"), F.col("path")).alias("folded_root"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumns({"doc_id": F.col("doc_id").cast("bigint")})
    return proofs(*manifest(docs))


# trees as levels of grouped rows, paths and folding as a recursion over (row, level); crc32 bit by bit
ORACLE = """
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, text, list_transform(
        [doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS head,
        xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
            string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda c, b: list_reduce(
            list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
            lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 5 = 0 AS hit
    FROM documents
), l AS (
    SELECT doc_id, tree, sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN hit THEN sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || translate(text,
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
    FROM d
), n AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY tree) AS size
    FROM l
), s AS (
    SELECT tree, 0 AS level, pos, leaf AS node, size FROM n
    UNION ALL
    SELECT tree, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (any_value(size) + 15) // 16
    FROM s WHERE size > 1 GROUP BY tree, level, pos // 16
), r AS (
    SELECT tree, node, level AS height, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size
    FROM s WHERE size = 1
), t AS (
    SELECT 0 AS level, pos, node, size FROM r
    UNION ALL
    SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (any_value(size) + 15) // 16
    FROM t WHERE size > 1 GROUP BY level, pos // 16
), step AS (
    SELECT tree, level AS g, pos, coalesce(string_agg(node, '') OVER lo, '') AS a, coalesce(string_agg(node, '') OVER hi, '') AS z
    FROM s WHERE size > 1
    WINDOW lo AS (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        hi AS (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
    UNION ALL
    SELECT r.tree, r.height + x.level, -1, x.a, x.z FROM r JOIN (
        SELECT level, pos, coalesce(string_agg(node, '') OVER lo, '') AS a, coalesce(string_agg(node, '') OVER hi, '') AS z
        FROM t WHERE size > 1
        WINDOW lo AS (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            hi AS (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
    ) x ON x.pos = r.pos // (16 ** x.level)::BIGINT
), f AS (
    SELECT doc_id, tree, leaf, 0 AS g, pos, coalesce(tampered, leaf) AS node, '' AS proof FROM n
    UNION ALL
    SELECT doc_id, f.tree, leaf, f.g + 1, f.pos // 16, sha256(a || node || z), proof || a || z
    FROM f JOIN step ON step.tree = f.tree AND step.g = f.g AND step.pos IN (f.pos, -1)
), top AS (SELECT node AS root FROM t WHERE size = 1)
SELECT doc_id, leaf, r.node AS subroot, root, sha256(proof) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM f JOIN r USING (tree), top WHERE f.g = (SELECT max(g) + 1 FROM step WHERE step.tree = f.tree)
"""
