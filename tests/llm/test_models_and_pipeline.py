import collections
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from probengine.llm import ngram_lm as lm
from probengine.llm import queries, topk
from tests_llm_helpers import LONG, by_id, documents, save


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def brute_top(rows, k):
    ok = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    ints = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in ok]
    out = {}
    for q, a in ints:
        if q % 50 == 0:
            found = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q and len(a) == len(b)]
            out.setdefault(q, set()).update(found)
    return {(q, r, i, -s) for q, found in out.items() for r, (s, i) in enumerate(sorted(found)[:k], 1)}


def f32(rng, n):
    return [float(np.float32(rng.uniform(-1, 1))) for _ in range(n)]


def test_top_k_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = random.Random(7)
    common = f32(rng, 16)
    rows = [(i, common if i % 3 == 0 else f32(rng, 16), 0) for i in range(600)]
    rows += [(1000, None, 0), (1050, [], 0), (1100, [1.0, None] * 8, 0), (1150, [float("nan")] * 16, 0), (1200, [float("inf")] * 16, 0),
             (1250, [0.5, 0.25], 0), (1251, [0.5, -0.25], 0), (1300, [0.5] * 3, 0), (None, common, 0), (50, rows[50][1], 1)]
    sf = save(spark, tmp_path, embeddings=vectors(spark, rows).selectExpr("*", "1 AS rank", "2 AS score", "3 AS id"))
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in queries.QUERIES["op2_top_k"](spark, sf).collect()}
    assert got == brute_top(rows, 5)


def test_top_k_of_large_numbers_ties_and_nothing(spark):
    big = vectors(spark, [(0, [3e9, 1.0], 0), (1, [1e4, 2.0], 0), (2, [1e4, 2.0], 0), (3, [-5.0, 1.0], 0)])
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(big, F.col("vec_id") == 0, k=2).orderBy("rank").collect()]
    first = int(math.floor(256 * float(np.float32(3e9)))) * 2560000 + 256 * 512
    assert got == [(1, 1, first), (2, 2, first)]
    assert topk.top_k(big.limit(0), F.col("vec_id") == 0).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), min_size=0, max_size=200, unique=True), st.integers(0, 63))
def test_elias_fano_finds_and_reads(values, shift):
    numbers = np.unique(np.array([v >> shift for v in values], dtype=np.uint64))
    ef = lm.EliasFano(memoryview(lm.EliasFano.encode(numbers, (1 << (64 - shift)) - 1)))
    assert ef.at(np.arange(len(numbers))).tolist() == numbers.tolist()
    asked = np.array(sorted({*numbers.tolist(), *[min(int(n) + 1, (1 << 64) - 1) for n in numbers], 0}), dtype=np.uint64)
    place = {n: i for i, n in enumerate(numbers.tolist())}
    assert ef.find(asked).tolist() == [place.get(int(a), -1) for a in asked]


def test_trie_lookup_children_and_codes():
    context = np.array([3, 3, 9, 2 ** 64 - 1], dtype=np.uint64)
    tail = np.array([1, 7, 1, 2 ** 40 - 1], dtype=np.uint64)
    trie = lm.Trie(lm.Trie.build(context, tail, np.array([5, 6, 7, 8], dtype=np.uint8)))
    asked = [(3, 1, 5), (3, 7, 6), (3, 2, 0), (9, 1, 7), (9, 7, 0), (4, 1, 0), (2 ** 64 - 1, 2 ** 40 - 1, 8), (0, 0, 0)]
    got = trie.lookup(*(np.array(x, dtype=np.uint64) for x in list(zip(*asked))[:2]))
    assert got.tolist() == [c for _, _, c in asked]
    assert [trie.children(c).tolist() for c in (3, 9, 2 ** 64 - 1, 4)] == [[5, 6], [7], [8], []]
    p = np.array([1.0, 0.5, 1e-3, 1e-9])
    assert np.abs(np.log10(lm.PROBABILITY[lm.quantise(p)]) - np.log10(p)).max() < 0.02


def brute_scores(texts, held):
    end, start = object(), object()
    docs = [((t or "").encode().lower().split() + [end], h) for t, h in zip(texts, held)]
    c, c2 = collections.Counter(), collections.Counter()
    for w, h in docs:
        if not h:
            c.update(w)
            c2.update(zip([start, *w], w))
    n, v = sum(c.values()), len(c)
    seen = {**c, start: sum(not h for _, h in docs)}
    base = lambda x: (c[x] + 0.5) / (n + 0.5 * (v + 1))
    for w, _ in docs:
        yield (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(base(x)) for x in w),
               sum(math.log10((c2[a, x] + lm.MASS * base(x)) / (seen.get(a, 0) + lm.MASS)) for a, x in zip([start, *w], w)))


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_scores_equal_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the The of a river house stone".split()) for _ in range(rng.randrange(30))) for _ in range(80)]
    texts += [None, "", "unseen words only here", "\x0b\x1c x"] + ([LONG] if block > 40 else [])
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(1, len(texts) + 1)]
    sf = save(spark, tmp_path, documents=documents(spark, texts).selectExpr("*", "true AS held_out", "1 AS score"))
    got = by_id(queries.QUERIES["op7_ngram_lm"](spark, sf))
    for i, (want, h) in enumerate(zip(brute_scores(texts, held), held), 1):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, *want[:3])
        assert r["base_score"] == pytest.approx(want[3], abs=1e-6)
        assert r["score"] == pytest.approx(want[4], abs=0.02 * want[0])  # codes of eight bits


def test_held_out_texts_are_likelier_than_by_unigrams(spark):
    rows = queries.QUERIES["op7_ngram_lm"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > 0.98 * sum(r.base_score for r in rows) and len(rows) > 100


def test_no_training_text(spark):
    got = lm.score(documents(spark, ["a b", None]), F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 0, 0), (3, 0, 0)]


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    clean = [" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(30)]
    texts = [*clean, clean[0], clean[1] + " tail", "spam " * 100, None, "", "mail me: a.b@c.org " + clean[2].replace("w", "v"), LONG]
    docs = documents(spark, texts).withColumn("posterior", F.lit(1))
    sf = save(spark, tmp_path / "in", documents=docs)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            kept[name] = by_id(docs)
        else:
            pieces = out.collect()
    n = len(clean)
    assert set(kept["quality_rules"]) >= {*range(1, n + 3), n + 6} and not {n + 3, n + 4, n + 5} & set(kept["quality_rules"])
    assert set(kept["quality_rules"]) - set(kept["near_duplicates"]) == {n + 1, n + 2}
    masked = kept["personal_data"][n + 6]
    assert masked["text"].startswith("mail me: [EMAIL] v") and masked["n_chars"] == len(masked["text"])
    assert {p.doc_id for p in pieces} == set(kept["personal_data"])
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(p.doc_id for p in whole) == sorted(p.doc_id for p in pieces)


def test_pipeline_of_nothing(spark, tmp_path):
    sf = save(spark, tmp_path, documents=documents(spark, []))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_registered_queries():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
