"""Alignment against the two libraries and a plain version of the links."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from probengine.llm import alignment, queries
from probengine.llm.packing import _byte_alphabet
from tests_llm_helpers import LONG, documents, save

TEXTS = ["Hello world, it's a test.", "", None, " ", "  two  blanks  ", "a ▁ b", "日本語 🙂 é é   x", "naïve café\n\nfoo\tbar\r\n",
         "<|endoftext|> and </s> <s>", "x" * 3000, LONG, "Hello world, it's a test.", "\x00\x01 zero", "Hello hello world WORLD 1234567890"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spans(pieces):
    out, at = [], 0
    for token, data in pieces:
        out.append((token, at, at + len(data)))
        at += len(data)
    return out


def plain(libraries, texts):
    """Every pair of tokens is compared, no windows."""
    a, b = libraries
    alphabet = _byte_alphabet()
    docs = []
    for t in texts:
        whole = (" " + (t or "")).encode()
        left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + (t or ""), add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
                 for i, p in ((i, b.id_to_piece(i)) for i in b.encode(t or ""))]
        if not t or b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            docs.append(([], [], [], []))
            continue
        left, right = spans(left), spans(right)
        links = [(x, y) for x, s, e in left for y, u, v in right if s < v and u < e] if len(left) < 4000 else None
        if links is None:
            links, j = [], 0
            for x, s, e in left:
                while right[j][2] <= s:
                    j += 1
                k = j
                while k < len(right) and right[k][1] < e:
                    links.append((x, right[k][0]))
                    k += 1
        ends = sorted({e for *_, e in left} & {e for *_, e in right})
        groups, at = [], 0
        for e in ends:
            groups.append(",".join(str(x) for x, s, f in left if at <= s and f <= e) + "|" + ",".join(str(x) for x, s, f in right if at <= s and f <= e)
                          if len(left) < 4000 else None)
            at = e
        docs.append((left, right, links, groups))
    count = Counter(p for *_, links, _ in docs for p in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return [(len(left), len(right), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
             "" if not left else None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest())
            for left, right, links, groups in docs]


def run(spark, folder, df):
    got = queries.QUERIES["op11_alignment"](spark, save(spark, folder, documents=df)).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return [tuple(r[n] for n in names) for r in sorted(got, key=lambda r: r.doc_id)]


def test_equals_the_plain_version(spark, tmp_path, libraries, monkeypatch):
    want = plain(libraries, TEXTS)
    for name, rows in (("one", 4096), ("many", 2)):     # one block, several blocks
        monkeypatch.setattr(alignment, "BLOCK_ROWS", rows)
        got = run(spark, tmp_path / name, documents(spark, TEXTS).coalesce(1))
        for g, w, t in zip(got, want, TEXTS, strict=True):
            assert g[:6] == w[:6], repr(t)[:60]
            assert w[6] is None or g[6] == w[6], repr(t)[:60]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abTé  \n\t▁'1日🙂.,", max_size=60))
def test_tokens_are_those_of_the_libraries(libraries, text):
    a, b = libraries
    aligner = _aligner()
    left, right = (memoryview(x).cast("I").tolist() for x in aligner.tokens(text))
    assert left == a.encode(" " + text, add_special_tokens=False).ids
    assert not text or right == b.encode(text)


_KEPT = []


def _aligner():
    if not _KEPT:
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
            _KEPT.append(alignment.Aligner(f.read(), g.read()))
    return _KEPT[0]


def test_awkward_rows(spark, tmp_path):
    df = documents(spark, ["a b", "a b", None])
    doubled = df.union(df).selectExpr("CASE WHEN doc_id = 1 THEN NULL ELSE doc_id END AS doc_id", "text", "1 AS block", "2 AS n_a", "'x' AS groups")
    out = alignment.align(doubled, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id is None, r.n_a, r.count_sum) for r in out) == sorted([(True, 2, 8)] * 2 + [(False, 2, 8)] * 2 + [(False, 0, 0)] * 2)
    assert {r.groups for r in out if r.n_a} == {"257|264;275|287"}
    assert run(spark, tmp_path, documents(spark, ["x"]).where("doc_id < 0")) == []


def test_a_known_word_is_neither_encoded_nor_aligned_again(monkeypatch):
    aligner, calls = _aligner(), []
    texts = [" ".join(f"{c}{i}" for i in range(3000)) for c in ("zq", "qz", "zq")]
    encode = aligner.processor.encode
    monkeypatch.setattr(aligner, "processor", type("Counted", (), {"encode": staticmethod(lambda text: calls.append(len(text)) or encode(text))}))
    first = alignment.block_row(aligner, 0, [0, 1, 2], texts)
    assert len(texts[0]) * 2 - 100 < sum(calls) < len(texts[0]) * 2 + 10    # less the blanks between calls
    assert max(calls) < 2000        # the libraries take longer a word for long texts
    calls.clear()
    monkeypatch.setattr(aligner, "align", None)
    assert alignment.block_row(aligner, 0, [0, 1, 2], texts) == first and calls == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="abé  \n\t▁'1日\x85　", max_size=30), min_size=1, max_size=8))
def test_a_block_equals_the_plain_version(libraries, texts):
    for memo in (1 << 18, 0):       # the worker's words are kept, or forgotten behind the block
        with pytest.MonkeyPatch.context() as patched:
            patched.setattr(alignment, "MEMO", memo)
            row = alignment.block_row(_aligner(), 0, list(range(len(texts))), texts)
        found, (n_a, n_b, sizes, words, n_groups, n_links, _) = alignment.unpack(row["packed"])
        at = 0
        for (left, right, links, groups), a, b, n in zip(_plain_rows(libraries, texts), n_a, n_b, sizes, strict=True):
            own, at = words[at:at + n], at + n
            assert (a, b, n_links[own].sum(), n_groups[own].sum()) == (left, right, links, groups[0])
            assert hashlib.sha256(";".join(map(found.__getitem__, own)).encode()).hexdigest() == groups[1] or not a


def _plain_rows(libraries, texts):
    return [(w[0], w[1], w[3], (w[2], w[6])) for w in plain(libraries, texts)]
