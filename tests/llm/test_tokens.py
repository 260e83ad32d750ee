import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from probengine.llm import bpe, packing, queries, token_counts
from probengine.llm.segments import blank_words
from tests_llm_helpers import LONG, by_id, documents, save

ODD = "abé  \n\t\x1c\x85\xa0 ▁  123'!?.,stve日本🙂   <|endoftext|></s>"
TEXTS = ["", None, " ", "  a  b ", "it's they've  \n\n x", "é" * 3000, "xq" * 20_000, LONG, "1234567 89", "<|endoftext|> and <s> </s>", "\x00\x01 ok"]


def samples(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return bpe.LinearBpe(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def rank_encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_segments_join_to_the_text(text):
    head, words = blank_words(text)
    assert head + "".join(" " + w for w in words) == text


def test_bpe_equals_the_library_and_round_trips(codec, rank_encoder):
    for t in samples(4000) + [t or "" for t in TEXTS]:
        ids = codec.encode(t)
        assert ids.tolist() == rank_encoder.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_on_pieces_that_need_steps_back():
    """A vocabulary whose longest matches are often wrong."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"cd", b"abcd", b"bcd", b"dd", b"cdd"]
    codec = bpe.LinearBpe(tokens, r"\S+|\s+")
    library = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30)))
        assert codec.encode(t).tolist() == library.encode_ordinary(t), t


def test_byte_bpe_query(spark, tmp_path, rank_encoder):
    sf = save(spark, tmp_path, documents=documents(spark, TEXTS))
    got = by_id(queries.QUERIES["op8_byte_bpe"](spark, sf))
    for i, t in enumerate(TEXTS, 1):
        ids = rank_encoder.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_decoding_null_and_foreign_ids(spark):
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    df = spark.createDataFrame([(1, [39, 72]), (2, None), (3, []), (4, [0])], "k int, ids array<int>").coalesce(1)
    assert {r.k: bytes(r.decoded) for r in bpe.decode(df, vocabulary).collect()} == {1: b"Hi", 2: b"", 3: b"", 4: b"!"}
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([([50256],)], "ids array<int>"), vocabulary).collect()


def test_token_counts_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = open(path, "rb").read()
    counter = token_counts._Counter(model, token_counts.frequent_lengths(model))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for t in samples(4000) + [t or "" for t in TEXTS]:
        assert counter.count(t) == len(library.encode(t)), repr(t)


def test_token_counts_query(spark, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sf = save(spark, tmp_path, documents=documents(spark, TEXTS).selectExpr("*", "7 AS n_tokens", "8 AS n_bytes"))
    got = by_id(queries.QUERIES["op10_token_counts"](spark, sf))
    for i, t in enumerate(TEXTS, 1):
        n = len(library.encode(t or ""))
        assert got[i] == {"doc_id": i, "n_bytes": len((t or "").encode()), "n_tokens": n, "over_limit": n > 4096}


def test_rank_encoder_of_packing_equals_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = packing.Encoder(open(path).read()), Tokenizer.from_file(path)
    for t in samples(3000, 5) + [t or "" for t in TEXTS]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def check_packing(rows, ids_of):
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        docs.setdefault(r["doc_id"], []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    for doc, pieces in docs.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            ids = ids_of[doc][at:at + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids_of[doc])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids_of[doc])
    assert docs.keys() == ids_of.keys()
    return padding


def test_pack_query(spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = TEXTS + [" ".join("the cat" for _ in range(n)) for n in range(0, 1500, 37)]
    sf = save(spark, tmp_path, documents=documents(spark, texts).coalesce(1))
    rows = [r.asDict() for r in queries.QUERIES["op9_pack"](spark, sf).collect()]
    ids_of = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts, 1)}
    assert check_packing(rows, ids_of) <= 2048
    assert {r["tier"] for r in rows} >= {2048, 1024}


def test_step_groups_are_balanced():
    rng = random.Random(0)
    sequences = [(2048, [(n, 0, 0)]) for n in (rng.randrange(1, 2049) for _ in range(128))]
    cost = [0] * 4
    for (_, pieces), g in zip(sequences, packing.step_groups(sequences, 32)):
        cost[g] += sum(p[0] ** 2 for p in pieces)
    assert max(cost) < 1.05 * min(cost)


def test_empty_table(spark, tmp_path):
    sf = save(spark, tmp_path, documents=documents(spark, []))
    for name in ("op6_personal_data", "op8_byte_bpe", "op9_pack", "op10_token_counts", "op1_minhash", "op3_quality", "op7_ngram_lm"):
        assert queries.QUERIES[name](spark, sf).count() == 0, name
