"""Alignment of two tokenizers' tokens, with corpus-wide counts of the links.

Tokenizer A is byte-level, B is a SentencePiece model that writes blanks as
U+2581 and puts one before the text, so A encodes a blank and the text. Both
then cover the same bytes. Offsets where tokens of both end cut the tokens into
groups; an A and a B token are linked where their bytes overlap.

Method: both tokenizers cut the text before a blank that follows another
character than white space, so tokens of both end there. These cuts are anchors: they split the
document into windows, mostly one word long. A window's tokens and alignment
depend only on its word: a worker memoises words, and each new one of a block is
encoded and aligned once, all of them in one numpy pass.

Documents are gathered into blocks of at most ``BLOCK_ROWS`` rows and about
``BLOCK_BYTES`` bytes of text (one longer text makes a block of its own). A
block is one row of a written table: its distinct windows, its distinct id pairs with
the number of its documents that hold them, and each document as a list of windows. Only the
pairs are exchanged, once per block and not per document, so a pair that every
document holds is one row per block; the counts come back to the block, whose
documents are then written out. Nothing goes through the driver and nothing but the vocabularies,
which are bounded by their files, is broadcast.

Texts that are null or empty, or whose joined token bytes differ from a blank
and the text in A or in B (U+2581 in a text), have no tokens: zeros and the
empty ``groups``. Special tokens' strings are plain text. Very long texts are
aligned whole. Every row is a document of its own, whatever its key (null keys
stay null). An empty table gives no rows. Other columns are not returned.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from probengine.llm import token_counts
from probengine.llm.common import prepare, written
from probengine.llm.packing import Encoder, _byte_alphabet
from probengine.llm.segments import _SPACE_AFTER_SPACE, blank_words

BLOCK_ROWS, BLOCK_BYTES = 4096, 2 << 20
#: Words in a worker's memo, and an eighth of their links; beyond it the memo is emptied behind the block.
MEMO = 1 << 18
#: Words that are encoded as one text; longer texts cost the libraries more a word.
TOGETHER = 128
#: Bits of a B id in a pair's code.
_B_BITS = 32


class Numbers(dict):
    """Numbers of keys, in the order of their first use."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


def segments(text: str) -> list[str]:
    """Words of a text, each to be read with a blank before it: both tokenizers
    cut a blank and the text before a blank that follows another character than
    white space. A text that holds the mark itself is not cut."""
    if token_counts.MARK in text:
        return [text]
    if text.startswith(" ") or _SPACE_AFTER_SPACE.search(text):
        return blank_words(" " + text)[1]
    return text.split(" ")


class Aligner:
    """Both tokenizers, and the aligned windows of the words seen so far."""

    def __init__(self, spec: str, model: bytes):
        self.ranked = Encoder(spec).ranked
        vocab, alphabet = json.loads(spec)["model"]["vocab"], _byte_alphabet()
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            a_bytes[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else b""
        self.processor = token_counts.load(model)
        pieces = [self.processor.id_to_piece(i) for i in range(len(self.processor))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace(token_counts.MARK, " ").encode() for i, p in enumerate(pieces)]
        self.blank = [self.processor.piece_to_id(token_counts.MARK)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), dtype=np.int64) for x in (a_bytes, self.b_bytes))
        # each id as it is written before the next one of its kind, or as the last of its side of a group
        sizes = len(a_bytes), len(pieces)
        self.written = [f"{i}{end}" for n, (inner, last) in zip(sizes, (",|", ",;"), strict=True) for end in (inner, last) for i in range(n)]
        self.written_sizes = np.array(list(map(len, self.written)), dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        """Empty the memo, which bounds its memory and changes no value."""
        #: Of each word its row, and of each row n_a, n_b, n_groups, n_links, the groups and where its links begin.
        self.rows, self.counts, self.groups, self.starts = Numbers(), np.empty((4, 0), dtype=np.int32), [], np.empty(0, dtype=np.int64)
        #: Numbers of the links' codes, row by row, and the codes by their numbers.
        self.links, self.numbers, self.codes = np.empty(0, dtype=np.int32), Numbers(), np.empty(0, dtype=np.int64)

    def learn(self) -> None:
        """Encode and align the words that ``rows`` has numbered since the last call."""
        new = list(islice(self.rows, len(self.groups), None))
        if not new:
            return
        a, n_a, b, n_b = self.encoded(new)
        groups, n_groups, n_links, codes = self.align(a, n_a, b, n_b)
        found, which = np.unique(codes, return_inverse=True)
        self.groups += groups
        self.counts = np.concatenate([self.counts, np.array([n_a, n_b, n_groups, n_links], dtype=np.int32)], axis=1)
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, np.array(list(map(self.numbers.__getitem__, found.tolist())), dtype=np.int32)[which]])
        self.codes = np.fromiter(self.numbers, dtype=np.int64, count=len(self.numbers))

    def _both(self, text: str) -> tuple[list[int], list[int]]:
        return self.ranked.encode_ordinary(" " + text), self.processor.encode(text) or self.blank

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A (for a blank and the word) and of B, word by word, and their
        numbers. Words are encoded many at once, as one text: its ids fall apart at
        their ends. A word behind which the next blank is no cut ends its text, one that holds the mark is a text
        of its own. A word whose joined bytes differ in A or in B has no ids."""
        cuts = {len(words), *range(0, len(words), TOGETHER)}
        for i, w in enumerate(words):
            if token_counts.MARK in w:
                cuts.update((i, i + 1))
            elif not w or w[-1].isspace():
                cuts.add(i + 1)
        a_ids, b_ids = array("I"), array("I")
        lengths = np.array(list(map(len, map(str.encode, words))), dtype=np.int64) + 1
        cuts = sorted(cuts)
        todo = list(zip(cuts, cuts[1:], strict=False))[::-1]
        while todo:
            start, end = todo.pop()
            text = " ".join(words[start:end])
            a, b = self._both(text)
            whole = (" " + text).encode()
            # the ids of A always give its bytes back, so their number of bytes is compared only
            if self.a_sizes[a].sum() == len(whole) and b"".join(map(self.b_bytes.__getitem__, b)) == whole:
                a_ids.extend(a)
                b_ids.extend(b)
            elif end - start > 1:
                todo += [(i, i + 1) for i in reversed(range(start, end))]
            else:
                lengths[start] = 0
        ends, out = np.cumsum(lengths), []
        for ids, sizes in ((a_ids, self.a_sizes), (b_ids, self.b_sizes)):
            ids = np.frombuffer(ids, dtype=np.uint32).astype(np.int64)
            out += [ids, np.diff(np.searchsorted(np.cumsum(sizes[ids]), ends, side="right"), prepend=0)]
        return tuple(out)

    def tokens(self, text: str) -> tuple[bytes, bytes]:
        """Ids of A (for a blank and the text) and of B, as 32-bit bytes."""
        if token_counts.MARK in text:
            a, b = self._both(text)
        else:
            a, _, b, _ = self.encoded(segments(text))
        return np.asarray(a, dtype=np.uint32).tobytes(), np.asarray(b, dtype=np.uint32).tobytes()

    def align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each window its groups, written out, their number and the number
        of its links, and the codes of all links, window by window. The windows' ids are
        given behind each other: A and B cover the same bytes, every end of either closes one link,
        every end of both closes a group. A window may have no ids."""
        if not len(a):
            return [""] * len(n_a), np.zeros_like(n_a), np.zeros_like(n_a), a
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        last = np.concatenate([[0], a_ends])[np.cumsum(n_a)]
        ends = _distinct(np.concatenate([a_ends, b_ends]))
        codes = a[np.searchsorted(a_ends, ends)] << _B_BITS | b[np.searchsorted(b_ends, ends)]
        a_last, b_last = (x[np.searchsorted(x, y)] == y for x, y in ((b_ends, a_ends), (a_ends, b_ends)))
        shared = a_ends[a_last]
        n_links, n_groups = (np.bincount(np.searchsorted(last, x), minlength=len(n_a)) for x in (ends, shared))
        # a group's ids of A, then of B: each id goes behind those of the other side that come first
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        items = np.empty(len(a) + len(b), dtype=np.int64)
        n_a_ids, n_b_ids = len(self.a_sizes), len(self.b_sizes)
        items[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a + n_a_ids * a_last
        items[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = 2 * n_a_ids + b + n_b_ids * b_last
        text = "".join(map(self.written.__getitem__, items.tolist()))
        cuts = np.concatenate([[0], np.cumsum(self.written_sizes[items])])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        return [text[s:max(s, e - 1)] for s, e in zip(cuts, cuts[1:], strict=False)], n_groups, n_links, codes


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, sorted."""
    values = np.sort(values)
    return values[np.diff(values, prepend=values[:1] - 1) > 0]


def _numbered(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below ``bound``, sorted, and of each value its place there."""
    used = np.zeros(bound, dtype=bool)
    used[values] = True
    return np.flatnonzero(used), (np.cumsum(used) - 1)[values]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; a run may be empty."""
    ends = np.cumsum(sizes)
    sums = np.concatenate([[0], np.cumsum(values)]).astype(np.int64)
    return sums[ends] - sums[ends - sizes]


def block_row(aligner: Aligner, number: int, keys: list, texts: list[str | None]) -> dict:
    """Documents of one block, as lists of the block's distinct words."""
    row_of = aligner.rows.__getitem__
    found = [np.array(list(map(row_of, segments(t) if t else ())), dtype=np.int64) for t in texts]
    aligner.learn()
    words, sizes = np.concatenate(found), np.array(list(map(len, found)), dtype=np.int64)
    # a text with a word that has no tokens has none
    lost = _sums(aligner.counts[0][words] == 0, sizes) > 0
    if lost.any():
        words, sizes = words[~np.repeat(lost, sizes)], np.where(lost, 0, sizes)
    place, words = _numbered(words, len(aligner.groups))
    counts = aligner.counts[:, place].astype(np.int64)
    n_a, n_b = (_sums(c[words], sizes) for c in counts[:2])
    n_groups, n_links = counts[2:]
    starts = np.cumsum(n_links) - n_links
    linked = aligner.links[np.repeat(aligner.starts[place] - starts, n_links) + np.arange(n_links.sum())]
    pairs, linked = _numbered(linked, len(aligner.codes))
    order = np.argsort(aligner.codes[pairs])
    pairs, linked = aligner.codes[pairs[order]], np.argsort(order)[linked]
    # each document's distinct words, then its distinct pairs
    doc, word = np.divmod(_distinct(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(place)) + words), max(1, len(place)))
    n = n_links[word]
    flat = np.repeat(starts[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    held = _distinct(np.repeat(doc, n) * max(1, len(pairs)) + linked[flat])
    docs = np.bincount(held % max(1, len(pairs)), minlength=len(pairs))
    written_groups = list(map(aligner.groups.__getitem__, place.tolist()))
    if len(aligner.rows) > MEMO or len(aligner.links) > 8 * MEMO:
        aligner.forget()
    return {"block": number, "keys": keys, "pairs": pairs.tobytes(), "docs": docs.astype(np.int32).tobytes(),
            "packed": pack(written_groups, n_a, n_b, sizes, words, n_groups, n_links, linked)}


def pack(written_groups: list[str], *arrays: np.ndarray) -> bytes:
    """Strings without line feeds and arrays of 32-bit numbers, compressed."""
    parts = ["\n".join(written_groups).encode(), *[a.astype(np.int32).tobytes() for a in arrays]]
    head = np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *parts]))


def unpack(packed: bytes) -> tuple[list[str], list[np.ndarray]]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
    ends = np.cumsum(np.frombuffer(data, dtype=np.int64, count=n, offset=8)) + 8 * (n + 1)
    parts = [data[e - s:e] for e, s in zip(ends.tolist(), np.diff(ends, prepend=8 * (n + 1)).tolist(), strict=True)]
    return parts[0].decode().split("\n"), [np.frombuffer(p, dtype=np.int32).astype(np.int64) for p in parts[1:]]


_BUILT: dict[str, Aligner] = {}


def blocks(df: DataFrame, a_path: str, b_path: str, key: str, text: str) -> DataFrame:
    """One row per block of documents, see above."""
    spark = df.sparkSession
    prepare(spark)
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        files = f.read(), g.read()
    digest = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    shared = spark.sparkContext.broadcast(files)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(df.schema[key].dataType)),
                           *[T.StructField(c, T.BinaryType()) for c in ("pairs", "docs", "packed")]])
    arrow = to_arrow_schema(schema)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _BUILT:
            _BUILT.clear()
            _BUILT[digest] = Aligner(*shared.value)
        aligner, number = _BUILT[digest], TaskContext.get().partitionId() << 32
        keys, held, size = [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([block_row(aligner, number, keys, held)], schema=arrow)

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                held.append(t)
                size += len(t or "")
                if len(keys) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield full()
                    number, keys, held, size = number + 1, [], [], 0
        if keys:
            yield full()

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(gathered, schema)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes, n = np.frombuffer(pairs, dtype=np.int64), np.frombuffer(docs, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(n), block, dtype=np.int64)), pa.array((codes >> _B_BITS).astype(np.int32)),
                pa.array((codes & ((1 << _B_BITS) - 1)).astype(np.int32)), pa.array(n)], names=["block", "a_id", "b_id", "docs"])


def pair_counts(held: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs, best) of all linked id pairs; ``best`` marks the
    pairs with the highest count of their A id. ``held``: (block, a_id, b_id, docs)."""
    counts = held.groupBy("a_id", "b_id").agg(F.sum("docs").alias("n_docs"))
    # an A id has no more partners than B has ids
    most = F.max("n_docs").over(Window.partitionBy("a_id"))
    return counts.withColumn("best", F.col("n_docs") == most)


def align(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best`` (links of an A id's commonest pair), ``count_sum`` (over links,
    the number of documents that hold their pair) and ``groups``, each group's
    A ids and B ids (``a1,a2|b1;a3|b2,b3``)."""
    made = written(blocks(df, a_path, b_path, key, text))
    held = made.select("block", "pairs", "docs").mapInArrow(_pairs, "block long, a_id int, b_id int, docs int")
    back = held.join(pair_counts(held), ["a_id", "b_id"]).select("block", "a_id", "b_id", "n_docs", "best")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                           T.StructField("groups", T.StringType())])
    arrow = to_arrow_schema(schema)

    def finish(block: pa.Table, counted: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        found, (n_a, n_b, sizes, words, n_groups, n_links, linked) = unpack(row["packed"])
        pairs = np.frombuffer(row["pairs"], dtype=np.int64)
        codes = (counted["a_id"].to_numpy().astype(np.int64) << _B_BITS) | counted["b_id"].to_numpy().astype(np.int64)
        order = np.argsort(codes)
        if not np.array_equal(codes[order], pairs):
            raise ValueError("the counts of a block's pairs are not complete")

        count = counted["n_docs"].to_numpy()[order][linked]
        best = counted["best"].to_numpy(zero_copy_only=False)[order][linked]
        per_window = [n_groups, n_links, _sums(best, n_links), _sums(count, n_links)]
        per_doc = [_sums(v[words], sizes) for v in per_window]
        ends, at = np.cumsum(sizes).tolist(), words.tolist()
        groups = [";".join(map(found.__getitem__, at[e - n:e])) for e, n in zip(ends, sizes.tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(row["keys"], type=arrow.field(0).type), *map(pa.array, (n_a, n_b, *per_doc)), pa.array(groups)], schema=arrow)

    return made.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, schema)
