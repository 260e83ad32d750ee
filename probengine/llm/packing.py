"""Hierarchical packing of token sequences into several context sizes.

Documents (ids and an end id) are routed to tiers, the context sizes: whole
windows of the largest tier are cut off first, and what is left of a document
goes to the smallest tier that holds it. The largest tier is packed first;
the gap behind a piece is filled with the largest pieces of the shorter tiers
that fit, and closed by cutting one more. Then the shorter tiers are packed
likewise, each into windows of its own size. So every sequence is full but
for the last ones of a task. All tiers are powers of two; what a task has
left at its end goes into ever smaller full tiers, and fewer ids than the
smallest tier holds make one padded sequence. Then the sequences are dealt to step groups so
that each has about the same attention cost (the sum over pieces of the
squared length).

Every task packs its own documents: there is no shuffle, a window of about
``window_tokens`` is in memory at once, and padding is below one sequence per
task. The input's split decides the sequences, so a rerun task gives the same
rows. Null and empty texts hold the end id only. Very long documents are cut
into many pieces. Other columns of the input are not returned.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probengine.llm.common import Memo, prepare, texts
from probengine.llm.segments import blank_words

#: What the byte-level pre-tokenizer splits by (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TIERS = (2048, 1024, 512, 256, 128, 64)
SCHEMA = ("doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, tier int, step_group bigint")


def _byte_alphabet() -> dict[str, int]:
    """Character of each byte in a byte-level vocabulary: printable Latin-1
    stands for itself, the other bytes are moved up behind 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Encoder:
    """Ids as little-endian 32-bit bytes, equal to those of the tokenizer
    whose JSON is given. Its merges are those of falling rank, which is
    checked, so that the faster rank encoder can do them; segments are cached."""

    def __init__(self, spec: str, limit: int = 1 << 19):
        rules = json.loads(spec)
        pre, model = rules["pre_tokenizer"], rules["model"]
        vocab, added = model["vocab"], rules["added_tokens"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = len(vocab) - len(pairs)
        if (rules["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]
                or any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "byte_fallback"))
                or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
                or any(vocab[a + b] != first + i for i, (a, b) in enumerate(pairs))):
            raise ValueError("only plain byte-level tokenizers with merges in the order of ids are known")
        alphabet = _byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocab.items() if t not in {x["content"] for x in added}}
        self.ranked = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")" if added else r"(?!)()")
        self.blank = Memo(lambda w: self._ranked(" " + w), limit=limit)
        self.head = Memo(self._ranked, limit=limit)

    def _ranked(self, text: str) -> bytes:
        return array("I", self.ranked.encode_ordinary(text)).tobytes()

    def _plain(self, text: str) -> bytes:
        head, words = blank_words(text)
        return b"".join([self.head[head], *map(self.blank.__getitem__, words)])

    def encode(self, text: str) -> bytes:
        """Ids of a text; the added tokens in it are found first."""
        if not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added.get(part) or self._plain(part) for part in self.at_added.split(text))


class Packer:
    """Packs one task's pieces; a piece is (length, document, start)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
            raise ValueError("tiers must be falling powers of two")
        self.tiers = tiers
        self.waiting: list[list[tuple]] = [[] for _ in tiers]  # per tier, by rising length

    def add(self, doc: int, n: int) -> Iterator[tuple[int, list[tuple]]]:
        """Routes a document; yields its whole windows of the largest tier."""
        top = self.tiers[0]
        for start in range(0, n - top + 1, top):
            yield top, [(top, doc, start)]
        if n % top:
            self._route((n % top, doc, n - n % top))

    def _route(self, piece: tuple) -> None:
        k = max(i for i, t in enumerate(self.tiers) if t >= piece[0])
        bisect.insort(self.waiting[k], piece)

    def _fill(self, room: int, k: int) -> list[tuple]:
        """Takes pieces of tier k and shorter ones until ``room`` is full; the
        last may be cut. The caller knows that enough ids wait."""
        out = []
        while room:
            for pieces in self.waiting[k:]:
                i = bisect.bisect_right(pieces, (room, float("inf"))) - 1
                if i >= 0:
                    piece = pieces.pop(i)
                    break
            else:  # none fits whole: cut the shortest
                n, doc, start = next(p for p in reversed(self.waiting[k:]) if p).pop(0)
                piece = (room, doc, start)
                self._route((n - room, doc, start + room))
            out.append(piece)
            room -= piece[0]
        return out

    def pack(self, final: bool = False) -> Iterator[tuple[int, list[tuple]]]:
        """Full sequences (tier, pieces) of what waits; if ``final``, all."""
        for k, tier in enumerate(self.tiers):
            # windows of a tier are opened by its own pieces and filled from it and the shorter tiers
            while self.waiting[k] and sum(p[0] for pieces in self.waiting[k:] for p in pieces) >= tier:
                first = self.waiting[k].pop()
                yield tier, [first, *self._fill(tier - first[0], k)]
            while final and self.waiting[k] and k + 1 < len(self.tiers):  # too few ids are left for this tier
                n, doc, start = self.waiting[k].pop()
                half = self.tiers[k + 1]
                self._route((half, doc, start))
                self._route((n - half, doc, start + half))
        if final and self.waiting[-1]:
            yield self.tiers[0], self.waiting[-1]
            self.waiting[-1] = []


def step_groups(sequences: list[tuple[int, list[tuple]]], size: int) -> list[int]:
    """Group of each sequence: sequences by falling attention cost are dealt
    back and forth over as many groups as hold ``size`` sequences each."""
    groups = max(1, len(sequences) // size)
    order = sorted(range(len(sequences)), key=lambda i: (-sum(p[0] ** 2 for p in sequences[i][1]), i))
    out = [0] * len(sequences)
    for rank, i in enumerate(order):
        turn, at = divmod(rank, groups)
        out[i] = at if turn % 2 == 0 else groups - 1 - at
    return out


def pack_batches(batches, encode, end: bytes, tiers, window_tokens: int, group_size: int, task: int):
    """Arrow batches of pieces for one task's batches of (doc_id, text)."""
    packer, held = Packer(tiers), {}
    sequences: list[tuple[int, list[tuple]]] = []
    counts = {"doc": 0, "sequence": 0, "group": 0}

    def flush(final: bool) -> pa.RecordBatch:
        sequences.extend(packer.pack(final))
        rows = []
        for (tier, pieces), group in zip(sequences, step_groups(sequences, group_size), strict=True):
            offset = 0
            for n, doc, start in pieces:
                doc_id, ids = held[doc]
                rows.append((doc_id, start, ids[4 * start:4 * (start + n)], len(ids) // 4,
                             (task << 33) + counts["sequence"], offset, tier, (task << 33) + counts["group"] + group))
                offset += n
            counts["sequence"] += 1
        counts["group"] += max(1, len(sequences) // group_size)
        sequences.clear()
        alive = {doc for pieces in packer.waiting for _, doc, _ in pieces}
        for doc in held.keys() - alive:
            del held[doc]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    fresh = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
            ids = encode(text) + end
            held[counts["doc"]] = (doc_id, ids)
            sequences.extend(packer.add(counts["doc"], len(ids) // 4))
            counts["doc"] += 1
            fresh += len(ids) // 4
            if fresh >= window_tokens:
                yield flush(False)
                fresh = 0
    yield flush(True)


_BUILT: dict[str, Encoder] = {}


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS,
         window_tokens: int = 1 << 18, group_size: int = 32) -> DataFrame:
    """Pieces of the documents' ids, one row each: where it starts in its
    document, its ids (little-endian 32-bit), and its sequence and offset."""
    spark = df.sparkSession
    prepare(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    digest = hashlib.sha256(spec.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(spec)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        if digest not in _BUILT:
            _BUILT.clear()
            _BUILT[digest] = Encoder(shared.value)
        task = TaskContext.get().partitionId()
        return pack_batches(batches, _BUILT[digest].encode, end, tiers, window_tokens, group_size, task)

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, SCHEMA)
