import random

import numpy as np
import pytest

from probengine.llm import minhash as m
from tests_llm_helpers import DOC, LONG, by_id, documents


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(texts):
    """component of each document (1, 2, ...) over all pairs."""
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return {i + 1: (len(s), c + 1) for i, (s, c) in enumerate(zip(sets, comp))}


def chain(rng, n, words, edits):
    """Near copies of one text, each with some words replaced."""
    base = [f"b{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    line = "this very common line stands in many of the short documents here"
    texts = chain(rng, 60, 150, 6) + chain(rng, 20, 900, 25) + chain(rng, 12, 30, 1)
    texts += [f"{line} " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(4, 60))) for _ in range(60)]
    texts += ["", None, "  \n\t ", "One", "one", "a b c d", "A B C D", "a b c", LONG, LONG + " end", LONG]
    got = by_id(m.components(documents(spark, texts)))
    assert {k: (v["n_shingles"], v["component_id"]) for k, v in got.items()} == brute(texts)
    assert all(v["kept"] == (k == v["component_id"]) for k, v in got.items())


def test_null_ids_repeated_rows_extra_columns_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, "en", "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (3, text, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS kept", "2 AS component_id", "3 AS class")
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in m.components(df).collect()), key=str)
    assert got == [(0, None, True), (2, 2, True), (2, 2, True), (3, 2, False)]
    left = m.deduplicate(df)
    assert left.columns == df.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 2]
    assert m.components(df.limit(0)).count() == 0


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(0)
    for size, form, buckets in ((300, 0, 1), (5000, 1, m.REGISTERS)):
        off = []
        for _ in range(30):
            both = rng.integers(0, 1 << 64, size=size, dtype=np.uint64)
            own = rng.integers(0, 1 << 64, size=(2, size // 8), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, x])) for x in own)
            regs = [np.frombuffer(m.registers(s)[form], dtype=np.uint16) for s in (a, b)]
            off.append(m.estimate(*regs, len(a), len(b), buckets)[0] - size / (size + 2 * (size // 8)))
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


@pytest.mark.parametrize("n", [0, 1, 4, 5, 511, 512, 683, 684])
def test_register_forms(n):
    s = m.shingles(" ".join(f"w{i}" for i in range(n + 4 if n >= 5 else n)))
    small, large = m.registers(s)
    assert (small is not None) == (0 < len(s) <= m.SMALL) and (large is not None) == (len(s) >= m.LARGE)


def test_a_giant_bucket_is_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK", 8)
    texts = chain(random.Random(9), 50, 120, 5)
    got = by_id(m.components(documents(spark, texts)))
    assert {k: (v["n_shingles"], v["component_id"]) for k, v in got.items()} == brute(texts)


def test_a_long_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(1, 60)] + [(100, 90)], "a bigint, b bigint")
    got = {r.node: r.comp for r in m.connected(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 90: 90, 100: 90}
    assert m.connected(links.limit(0)).count() == 0
