"""Merkle manifest of a table: leaves, subroots, one root, and proofs.

Every row is a leaf: the SHA-256 of its fields, each written as ``-`` if null,
else as its UTF-8 byte count, a colon and its value. Within a group the leaves
ascend by key; every ``FAN`` consecutive nodes become one parent, level by
level, until one node, the subroot, is left (a lone leaf is its own subroot).
The subroots, null group first, then by UTF-8 bytes, make the root likewise.

Method: one window per level. ``lag`` and ``lead`` columns with the fixed
offsets 1 to FAN - 1, masked by a node's slot and its run's length, give every
node its siblings on the left and on the right, and each run's first row hashes
its parent. Window partitions are blocks of ``BLOCK`` nodes, whole runs of one
group, so a group that holds most rows is spread like any other. Rows are numbered by
ranges of (group, key): inside the range, plus the counts of the ranges before.
Levels shrink by FAN; proofs come down from the root, each level joined to its
parents, and only the last join is as large as the table. The driver sees one
number, the size of the largest group, which fixes the number of levels.

Rows with a null key come first. Rows of equal group and key are ordered by their leaf,
so equal rows are interchangeable and get equal leaves, but each has its place
and its proof. Empty and very long texts are hashed like any value. An empty
table gives an empty manifest. Columns that are not fields change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probengine.llm.common import discard, written

#: Nodes per parent, and nodes per window partition (whole runs).
FAN, BLOCK = 8, 64


def canonical(fields: Sequence[Column]) -> Column:
    """The fields as one string that no two different rows share."""
    def one(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.concat(*map(one, fields))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``i``, the place in its group from 0, and ``n``, the
    group's size. Written once, so the ranges are the same for all readers."""
    ranged = written(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
                           F.sum("_size").over(Window.partitionBy(group)).alias("n"))
    inside = Window.partitionBy(group, "_range").orderBy(*order)
    placed = ranged.withColumn("i", F.row_number().over(inside) - F.lit(1)).join(offsets, [group, "_range"])
    out = written(placed.withColumn("i", F.col("i") + F.col("_before")).drop("_range", "_before"))
    discard(ranged)
    return out


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, i, n, h) with ``left`` and ``right``: the run's nodes on
    either side, joined."""
    slot = F.col("i") % FAN
    run = F.least(F.lit(FAN), F.col("n") - (F.col("i") - slot))
    block = Window.partitionBy("g", F.floor(F.col("i") / BLOCK)).orderBy("i")
    left = [F.when(slot >= k, F.lag("h", k).over(block)) for k in range(FAN - 1, 0, -1)]
    right = [F.when(slot + k < run, F.lead("h", k).over(block)) for k in range(1, FAN)]
    return nodes.withColumn("left", F.concat_ws("", *left)).withColumn("right", F.concat_ws("", *right))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above, from the first row of each run."""
    first = nodes.where((F.col("i") % FAN == 0) & (F.col("n") > 1))
    return first.select("g", (F.col("i") / FAN).cast("bigint").alias("i"),
                        F.ceil(F.col("n") / FAN).alias("n"), digest(F.col("h"), F.col("right")).alias("h"))


def tree(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops) of all groups of ``leaves`` (g, i, n, h): every level
    with its siblings, written, and the one node left of each group."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [written(with_siblings(leaves))]
    while most > 1:
        most = -(-most // FAN)
        levels.append(written(with_siblings(parents(levels[-1]))))
    tops = levels[0].where("n = 1").select("g", "h")
    for level in levels[1:]:
        tops = tops.unionByName(level.where("n = 1").select("g", "h"))
    return levels, tops


_STEPS = "array<struct<left:string,right:string>>"


def paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest of ``levels`` with ``subroot`` and ``steps``: the (left, right)
    siblings of a node, of its parent and so on up to the group's top, whose
    own steps and subroot ``tops`` (g, steps, subroot) gives."""
    known = None
    for level in reversed(levels):
        found = level.where("n = 1").join(tops, "g")
        if known is not None:
            up = known.select("g", F.col("i").alias("_up"), "steps", "subroot")
            inner = level.where("n > 1").withColumn("_up", (F.col("i") / FAN).cast("bigint")).join(up, ["g", "_up"])
            own = F.array(F.struct("left", "right")).cast(_STEPS)
            found = found.unionByName(inner.withColumn("steps", F.concat(own, "steps")).drop("_up"))
        known = found
    return known


def build(df: DataFrame, key: str, group: str, fields: Sequence[str], tampered: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of ``df``: key, ``leaf``, ``subroot``, ``root``, and
    ``steps``, the siblings on the path to the root (the left ones and the right
    ones of each level, joined). With ``tampered``, fields replaced by expressions, ``claimed``
    is the leaf of the row so changed."""
    changed = [tampered.get(f, F.col(f)) if tampered else F.col(f) for f in fields]
    # null is the empty string, any other group has a mark before it: null first, then by bytes
    name = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    rows = df.select(F.col(key).alias("key"), name.alias("g"), F.sha2(canonical([F.col(f) for f in fields]), 256).alias("h"),
                     F.sha2(canonical(changed), 256).alias("claimed"))
    # the claimed leaf travels only where it differs
    rows = rows.withColumn("claimed", F.when(F.col("claimed") != F.col("h"), F.col("claimed")))
    leaves = numbered(rows, "g", ["key", "h"])
    low, subroots = tree(numbered(rows, "g", ["key", "h"]))
    listed = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), "g", ["name"])
    high, roots = tree(listed)
    end = roots.select("g", F.array().cast(_STEPS).alias("steps"), F.lit("").alias("subroot"))
    tops = written(paths(high, end).select(F.col("name").alias("g"), "steps", F.col("h").alias("subroot")))
    root = F.broadcast(roots.select(F.col("h").alias("root")))    # one row
    return paths(low, tops).crossJoin(root).select(
        F.col("key").alias(key), F.col("h").alias("leaf"), F.coalesce("claimed", "h").alias("claimed"), "subroot", "root", "steps")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(steps, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof(steps: Column) -> Column:
    """All siblings of a path, joined."""
    return F.array_join(F.transform(steps, lambda step: F.concat(step["left"], step["right"])), "")


_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_letters(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, *_LETTERS)


def _oracle() -> str:
    """DuckDB SQL for ``op13_manifest``: levels by recursion, one list of runs
    a level instead of windows; paths are followed down from the roots."""
    def field(name: str, value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c, text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""

    def tree(name: str) -> str:
        return f"""{name} AS (
    SELECT g, 0 AS level, i, n, h FROM {name}_leaves
    UNION ALL
    SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, level, n, i // 8),
{name}_sides AS (
    SELECT g, level, i, n, h,
           coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name}),
{name}_paths AS (
    SELECT g, i AS leaf_i, 0 AS level, i, n, l || r AS proof, h AS top,
           f0 AS f FROM (SELECT s.*, x.f AS f0 FROM {name}_sides s JOIN {name}_leaves x USING (g, i) WHERE s.level = 0)
    UNION ALL
    SELECT p.g, p.leaf_i, p.level + 1, u.i, u.n, p.proof || u.l || u.r, u.h, sha256(c.l || p.f || c.r)
    FROM {name}_paths p JOIN {name}_sides c ON c.g = p.g AND c.level = p.level AND c.i = p.i
         JOIN {name}_sides u ON u.g = p.g AND u.level = p.level + 1 AND u.i = p.i // 8 WHERE p.n > 1)"""

    changed = f"CASE WHEN {crc} % 3 = 0 THEN translate(text, '{_LETTERS[0]}', '{_LETTERS[1]}') ELSE text END"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('+' || lang, '') AS g, {leaf("text")} AS h, {leaf(changed)} AS f FROM documents),
low_leaves AS (SELECT g, doc_id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, h, f FROM d),
{tree("low")},
low_done AS (SELECT * FROM low_paths WHERE n = 1),
high_leaves AS (SELECT '' AS g, s.g AS name, row_number() OVER (ORDER BY s.g) - 1 AS i, count(*) OVER () AS n, h, '' AS f FROM low s WHERE n = 1),
{tree("high")},
high_done AS (SELECT name, h0, top, proof FROM high_paths JOIN (SELECT name, i AS leaf_i, h AS h0 FROM high_leaves) USING (leaf_i) WHERE n = 1),
up AS (
    SELECT low_done.g, low_done.leaf_i, 0 AS level, x.i, low_done.f FROM low_done JOIN high_leaves x ON x.name = low_done.g
    UNION ALL
    SELECT u.g, u.leaf_i, u.level + 1, u.i // 8, sha256(c.l || u.f || c.r)
    FROM up u JOIN high_sides c ON c.level = u.level AND c.i = u.i WHERE c.n > 1),
ends AS (SELECT g, leaf_i, f FROM up QUALIFY row_number() OVER (PARTITION BY g, leaf_i ORDER BY level DESC) = 1)
SELECT x.doc_id, x.h AS leaf, hd.h0 AS subroot, hd.top AS root, sha256(p.proof || hd.proof) AS proof_sha256, e.f AS folded_root, e.f = hd.top AS verified
FROM low_leaves x JOIN low_done p ON p.g = x.g AND p.leaf_i = x.i JOIN high_done hd ON hd.name = x.g JOIN ends e ON e.g = x.g AND e.leaf_i = x.i"""


ORACLE_SQL = _oracle()
