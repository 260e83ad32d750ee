"""The manifest against a plain recursive version, and its awkward rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from probengine.llm import manifest, queries
from tests_llm_helpers import DOC, LONG, by_id, save

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def up(nodes):
    """(root, [siblings of each node, level by level, as (left, right)])"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in enumerate(at):
            lo = i - i % 8
            paths[p].append(("".join(nodes[lo:i]), "".join(nodes[i + 1:lo + 8])))
        nodes = [h(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def plain(rows):
    """{doc_id: expected row}"""
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r["lang"] == g), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for g in langs]
    tops = [up([leaf(r) for r in g]) for g in groups]
    root, above = up([t for t, _ in tops])
    out = []
    for g, (top, paths), rest in zip(groups, tops, above, strict=True):
        for r, path in zip(g, paths, strict=True):
            steps = path + rest
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                changed["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            node = leaf(changed)
            for left, right in steps:
                node = h(left, node, right)
            out.append((r["doc_id"], leaf(r), top, root, h(*[x + y for x, y in steps]), node, node == root))
    return sorted(out, key=str)


def run(spark, folder, rows):
    df = spark.createDataFrame(rows, DOC)
    got = queries.QUERIES["op13_manifest"](spark, save(spark, folder, documents=df))
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 1}, {"en": 9, None: 3, "é": 65},
                                   {"en": 150, "": 17, **{f"l{i}": 1 + i % 3 for i in range(9)}}])
def test_equals_the_plain_tree(spark, tmp_path, sizes):
    rng, rows, at = random.Random(3), [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            at += rng.randrange(1, 4)
            rows.append((at, rng.choice(["Some Text é", "", None, "lower", LONG]), lang, rng.choice(["s", None]), rng.choice([3, None])))
    rng.shuffle(rows)
    names = ("doc_id", "text", "lang", "source", "n_chars")
    assert run(spark, tmp_path, rows) == plain([dict(zip(names, r, strict=True)) for r in rows])


def test_null_ids_and_repeated_rows(spark, tmp_path):
    rows = [(None, "A", "en", "s", 1), (None, "b", "en", "s", 1), (5, "A", "en", "s", 1), (5, "A", "en", "s", 1), (5, "B", None, "s", 1)]
    names = ("doc_id", "text", "lang", "source", "n_chars")
    got = run(spark, tmp_path, rows)
    assert got == plain([dict(zip(names, r, strict=True)) for r in rows])
    assert len(got) == 5


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_fields_cannot_run_together_and_other_columns_do_not_count(spark):
    df = spark.createDataFrame([("a", "1:b"), ("a1", ":b"), ("-", None), (None, "-")], "x string, y string")
    assert df.select(manifest.canonical([F.col("x"), F.col("y")]).alias("c")).distinct().count() == 4
    df = spark.createDataFrame([(1, "g", "t")], "k int, lane string, text string")
    clash = df.select("*", *[F.lit(0).alias(c) for c in ("h", "i", "n", "g", "left", "claimed", "steps")])
    one, two = (manifest.build(d, "k", "lane", ("k", "text")).select("k", "leaf", "subroot", "root") for d in (df, clash))
    assert by_id(one, "k") == by_id(two, "k")


def test_windows_hold_whole_runs_of_bounded_blocks(spark):
    """One group with all rows is still cut into blocks, none larger than BLOCK."""
    nodes = spark.range(1000).selectExpr("'' AS g", "id AS i", "1000L AS n", "sha2(string(id), 256) AS h")
    got = manifest.with_siblings(nodes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert got.where("length(left) + length(right) <> 64 * 7").count() == 0     # 1000 = 125 whole runs
    assert manifest.BLOCK % manifest.FAN == 0
