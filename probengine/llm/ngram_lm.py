"""Language-model scores from a bigram trie in Elias-Fano form.

*Blocks.* Texts are tokenised once into blocks of bounded size: the hashes of
a block's words, most frequent first, and each text's words as places in that
list. Blocks are written, so every later step reads the same ones.

*Level one.* Every block sends its words and their training counts to shards
by hash; a shard adds them up and answers each block. N, V and the few words
that make up more than 1 / HOT of all tokens come from sums over the shards.

*Level two.* A block's distinct bigrams go to shards by their context; the
successors of hot contexts are spread by their own hash, as one word may lead
a third of all bigrams. A shard adds up the training counts and builds its
part of the trie: sorted contexts, the monotone pointers to their successors,
and the successors, which are monotone behind their context's rank, are
Elias-Fano lists; each successor has an eight-bit logarithm of its probability
c(v, w) / (c(v) + MASS). All lie in one flat buffer that is read in place. A
block's bigrams are then looked up in it by context-relative successor search.

*Scores.* P(w | v) = c(v, w) / (c(v) + MASS) + MASS / (c(v) + MASS) * P(w),
Dirichlet smoothing towards the add-half unigram P(w), with the first part
from the trie. A block joins the answers of its shards and adds up each text.

Words are told apart by 64-bit hashes, successors of one context by 40 bits.
Every block and shard is bounded: their number grows with the input.

Null and empty texts hold the end token only; long texts are scored whole.
Rows that repeat an id are trained on and scored one by one; a null id is held
in for training. With no training text every count is 0 and the base is
uniform over one unseen type. Other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probengine.llm.common import Memo, prepare, texts, written

#: Tokens of a block, about; one text more at most.
BLOCK_TOKENS = 1 << 20
#: A word is hot if it makes up more than one in HOT tokens, so HOT are at most.
HOT = 512
#: Shards over which a hot context's successors are spread.
SPREAD = 64
#: Prior mass of the unigrams.
MASS = 200.0
#: Base-10 logarithms of the codes 1 to 255; 0 stands for an unseen bigram.
LOWEST = -9.0
TAIL_BITS = 40

_U = np.uint64
#: Hashes of the end of a text and of its start, the context of the first word.
END, START = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_WORD_HASH = Memo(xxhash.xxh3_64_intdigest)


def _tail(h: np.ndarray) -> np.ndarray:
    """The 40 bits that tell successors apart."""
    return (h * _U(0xD6E8FEB86659FD93)) >> _U(64 - TAIL_BITS)


class EliasFano:
    """A monotone list of n numbers below ``top`` in a flat buffer: the low
    bits packed, and the high bits as one bit array with a one for each number
    and a zero for each step of the high part."""

    def __init__(self, buffer: memoryview):
        self.n, self.top, self.low_bits, self.size = (int(x) for x in np.frombuffer(buffer[:32], dtype=_U))
        words = -(-self.n * self.low_bits // 64) + 1
        self.low = np.frombuffer(buffer[32:32 + 8 * words], dtype=_U)
        high = np.frombuffer(buffer[32 + 8 * words:self.size], dtype=np.uint8)
        bits = np.unpackbits(high, bitorder="little")
        # directory: how many numbers have a smaller high part, for each high part
        zeros = np.flatnonzero(bits == 0)
        self.before = np.concatenate([[0], zeros - np.arange(len(zeros))])

    @staticmethod
    def encode(values: np.ndarray, top: int) -> bytes:
        n = len(values)
        low_bits = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        packed = np.zeros(-(-n * low_bits // 64) + 1, dtype=_U)
        if low_bits:
            low = values & _U((1 << low_bits) - 1)
            at = np.arange(n, dtype=_U) * _U(low_bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            np.bitwise_or.at(packed, word, low << shift)
            over = shift + _U(low_bits) > _U(64)
            np.bitwise_or.at(packed, word[over] + 1, low[over] >> (_U(64) - shift[over]))
        high = (values >> _U(low_bits)).astype(np.int64)
        bits = np.zeros(n + (int(top) >> low_bits) + 1, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        rest = np.packbits(bits, bitorder="little").tobytes()
        rest += bytes(-len(rest) % 8)
        head = np.array([n, top, low_bits, 32 + 8 * len(packed) + len(rest)], dtype=_U)
        return head.tobytes() + packed.tobytes() + rest

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=_U)
        at = i.astype(_U) * _U(self.low_bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        second = np.where(shift > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((_U(64) - shift) & _U(63)), _U(0))
        return ((self.low[word] >> shift) | second) & _U((1 << self.low_bits) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        high = np.searchsorted(self.before, i, side="right") - 1
        return (high.astype(_U) << _U(self.low_bits)) | self._low(i)

    def find(self, values: np.ndarray, begin: np.ndarray | int = 0, stop: np.ndarray | int | None = None) -> np.ndarray:
        """The place of each value between the places ``begin`` and ``stop``,
        or -1: the successor of its low bits among the numbers of its high part there."""
        high = np.minimum(values >> _U(self.low_bits), _U(len(self.before) - 2)).astype(np.int64)
        low = values & _U((1 << self.low_bits) - 1)
        first, last = np.maximum(self.before[high], begin), np.minimum(self.before[high + 1], self.n if stop is None else stop)
        end = last.copy()
        while (open_ := np.flatnonzero(first < last)).size:
            middle = (first[open_] + last[open_]) // 2
            less = self._low(middle) < low[open_]
            first[open_] = np.where(less, middle + 1, first[open_])
            last[open_] = np.where(less, last[open_], middle)
        found = np.full(len(values), -1, dtype=np.int64)
        inside = np.flatnonzero(first < end)
        hit = inside[(self._low(first[inside]) == low[inside]) & ((values[inside] >> _U(self.low_bits)).astype(np.int64) == high[inside])]
        found[hit] = first[hit]
        return found


class Trie:
    """One shard's contexts and successors, in one flat buffer."""

    def __init__(self, buffer):
        view = memoryview(buffer)
        self.contexts = EliasFano(view)
        at = self.contexts.size
        self.pointers = EliasFano(view[at:])
        at += self.pointers.size
        self.successors = EliasFano(view[at:])
        at += self.successors.size
        self.codes = np.frombuffer(view[at:at + self.successors.n], dtype=np.uint8)

    @staticmethod
    def build(context: np.ndarray, tail: np.ndarray, codes: np.ndarray) -> bytes:
        """From distinct (context, tail) in rising order."""
        own, first = np.unique(context, return_index=True)
        rank = np.searchsorted(own, context).astype(_U)
        return (EliasFano.encode(own, (1 << 64) - 1) + EliasFano.encode(first.astype(_U), len(context))
                + EliasFano.encode((rank << _U(TAIL_BITS)) | tail, max(len(own), 1) << TAIL_BITS) + codes.tobytes())

    def ranges(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where to where the successors of the contexts of some ranks lie, by the pointers."""
        begin = self.pointers.at(rank).astype(np.int64)
        behind = self.pointers.at(np.minimum(rank + 1, self.pointers.n - 1)).astype(np.int64)
        return begin, np.where(rank + 1 < self.pointers.n, behind, self.successors.n)

    def lookup(self, context: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Code of each bigram, 0 if unseen: the successor is sought between
        its context's pointer and the next one."""
        out = np.zeros(len(context), dtype=np.uint8)
        rank = self.contexts.find(context)
        known = np.flatnonzero(rank >= 0)
        own, at = np.unique(rank[known], return_inverse=True)
        begin, stop = self.ranges(own)
        place = self.successors.find((rank[known].astype(_U) << _U(TAIL_BITS)) | tail[known], begin[at], stop[at])
        seen = place >= 0
        out[known[seen]] = self.codes[place[seen]]
        return out

    def children(self, context: int) -> np.ndarray:
        """Codes of one context's successors, by the pointers."""
        rank = self.contexts.find(np.array([context], dtype=_U))
        if rank[0] < 0:
            return self.codes[:0]
        begin, stop = self.ranges(rank)
        return self.codes[begin[0]:stop[0]]


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(255 - np.log10(p) / LOWEST * 254), 1, 255).astype(np.uint8)


#: Probability of each code.
PROBABILITY = np.where(np.arange(256) > 0, 10.0 ** ((255 - np.arange(256)) / 254 * LOWEST), 0.0)


def _batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


_BLOCK = [("block", pa.int64()), ("docs", pa.binary()), ("held", pa.binary()), ("sizes", pa.binary()),
          ("vocab", pa.binary()), ("words", pa.binary())]
_BLOCK_DDL = "block bigint, docs binary, held binary, sizes binary, vocab binary, words binary"
#: One exchange format for questions and answers: a shard, a block, flat arrays.
_PART = [("shard", pa.int64()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
_PART_DDL = "shard bigint, block bigint, a binary, b binary, c binary"


def _tokenise(batches):
    """Blocks of (doc_id, text, held_out) rows. A null id is 0 with flag 2."""
    task, count = TaskContext.get().partitionId(), itertools.count()
    docs, held, sizes, words, total = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        flat = np.concatenate(words) if words else np.empty(0, dtype=_U)
        vocab, place, n = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        row = ((task << 32) + next(count), np.array(docs, dtype=np.int64).tobytes(), np.array(held, dtype=np.uint8).tobytes(),
               np.array(sizes, dtype=np.int32).tobytes(), vocab[order].tobytes(), rank[place].tobytes())
        for x in (docs, held, sizes, words):
            x.clear()
        return _batch(_BLOCK, [row])

    for batch in batches:
        for doc, text, out in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")),
                                  batch.column("held_out").to_pylist(), strict=True):
            found = text.encode("utf-8", "surrogatepass").lower().split()
            docs.append(doc or 0)
            held.append(int(bool(out)) + 2 * (doc is None))
            sizes.append(len(found))
            words.append(np.fromiter(map(_WORD_HASH.__getitem__, found), dtype=_U, count=len(found)))
            total += len(found) + 1
            if total >= BLOCK_TOKENS:
                yield block()
                total = 0
    if docs:
        yield block()


class _Block:
    """A block's arrays, read in place."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.block, self.docs, self.held = row["block"], read("docs", np.int64), read("held", np.uint8)
        self.sizes, self.vocab, self.words = read("sizes", np.int32), read("vocab", _U), read("words", np.uint32)
        self.trains = (self.held & 1) == 0

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, token, document) of every token, as places in the
        vocabulary; the end is place V, the start V + 1."""
        v, n = len(self.vocab), len(self.sizes)
        lengths = self.sizes.astype(np.int64) + 1
        ends = np.cumsum(lengths) - 1
        token = np.full(int(lengths.sum()), v, dtype=np.int64)
        is_word = np.ones(len(token), dtype=bool)
        is_word[ends] = False
        token[is_word] = self.words
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[ends - lengths + 1] = v + 1
        return context, token, np.repeat(np.arange(n), lengths)

    def hashes(self) -> np.ndarray:
        return np.concatenate([self.vocab, np.array([END, START], dtype=_U)])


def _split(shard: np.ndarray):
    """(shard, places) of every shard."""
    order = np.argsort(shard, kind="stable")
    ids, first = np.unique(shard[order], return_index=True)
    return zip(ids.tolist(), np.split(order, first[1:]), strict=True)


def _word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U(20)) % _U(shards)).astype(np.int64)


def _ask_words(shards: int):
    """Every block's words with their training counts, by shard."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                _, token, doc = b.tokens()
                counts = np.bincount(token, weights=b.trains[doc], minlength=len(b.vocab) + 1).astype(np.int64)
                h = b.hashes()[:-1]
                for shard, at in _split(_word_shard(h, shards)):
                    yield _batch(_PART, [(shard, b.block, h[at].tobytes(), counts[at].tobytes(), None)])
    return run


def _flat(parts: list[dict], name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(p[name] for p in parts), dtype=kind)


def _answer_words(table: pa.Table) -> pa.Table:
    """One shard: total counts for each block, and one row (block -1) with the
    shard's own sums: types, tokens, and its commonest words with counts."""
    parts = table.to_pylist()
    words, place = np.unique(_flat(parts, "a", _U), return_inverse=True)
    totals = np.bincount(place, weights=_flat(parts, "b", np.int64), minlength=len(words)).astype(np.int64)
    cuts = np.cumsum([len(p["a"]) // 8 for p in parts])[:-1]
    rows = [(p["shard"], p["block"], totals[at].tobytes(), None, None) for p, at in zip(parts, np.split(place, cuts), strict=True)]
    top = np.union1d(np.argsort(-totals, kind="stable")[:HOT], np.flatnonzero(words == _U(END)))
    sums = np.array([(totals > 0).sum(), totals.sum()], dtype=np.int64)
    rows.append((parts[0]["shard"], -1, sums.tobytes(), words[top].tobytes(), totals[top].tobytes()))
    return pa.Table.from_batches([_batch(_PART, rows)])


def _bigrams(b: _Block, hot: np.ndarray, shards: int):
    """A block's distinct bigrams: their place per token, hashes and shards."""
    context, token, doc = b.tokens()
    width = len(b.vocab) + 2
    pairs, place = np.unique(context * width + token, return_inverse=True)
    h = b.hashes()
    left, right = h[pairs // width], h[pairs % width]
    shard = _word_shard(left, shards)
    is_hot = np.isin(left, hot)
    shard[is_hot] = (shard[is_hot] + (_tail(right[is_hot]) % _U(SPREAD)).astype(np.int64)) % shards
    return context, token, doc, place, left, right, shard


def _ask_bigrams(hot: dict[int, int], shards: int):
    """Every block's distinct bigrams with their training counts, by shard:
    contexts once with their numbers of successors, successors as 40 bits."""
    hot_words = np.array(sorted(hot), dtype=_U)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                _, _, doc, place, left, right, shard = _bigrams(b, hot_words, shards)
                counts = np.bincount(place, weights=b.trains[doc], minlength=len(left)).astype(np.uint32)
                tail = _tail(right)
                for s, at in _split(shard):
                    # the pairs are in the order of their contexts' places
                    first = np.flatnonzero(np.concatenate([[True], left[at][1:] != left[at][:-1]]))
                    size = np.diff(np.append(first, len(at))).astype(np.uint32)
                    low, high = (tail[at] & _U(0xFFFFFFFF)).astype(np.uint32), (tail[at] >> _U(32)).astype(np.uint8)
                    head = np.array([len(first), len(at)], dtype=np.int64).tobytes()
                    yield _batch(_PART, [(s, b.block, head + left[at][first].tobytes() + size.tobytes(),
                                          low.tobytes() + high.tobytes(), counts[at].tobytes())])
    return run


def _answer_bigrams(hot: dict[int, int]):
    """One shard: build its trie and look every block's bigrams up in it."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        contexts, tails = [], []
        for p in parts:
            n, m = np.frombuffer(p["a"][:16], dtype=np.int64).tolist()
            own, size = np.frombuffer(p["a"][16:16 + 8 * n], dtype=_U), np.frombuffer(p["a"][16 + 8 * n:], dtype=np.uint32)
            contexts.append(np.repeat(own, size))
            tails.append(np.frombuffer(p["b"][:4 * m], dtype=np.uint32).astype(_U) | (np.frombuffer(p["b"][4 * m:], dtype=np.uint8).astype(_U) << _U(32)))
        counts = _flat(parts, "c", np.uint32).astype(np.int64)
        context, tail = np.concatenate(contexts), np.concatenate(tails)
        order = np.lexsort((tail, context))
        c, t = context[order], tail[order]
        first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])]))
        total = np.add.reduceat(counts[order], first)
        c, t, total = c[first][total > 0], t[first][total > 0], total[total > 0]
        trie = None
        if len(c):
            own, start = np.unique(c, return_index=True)
            size = np.add.reduceat(total, start)
            for i in np.flatnonzero(np.isin(own, np.array(sorted(hot), dtype=_U))):
                size[i] = hot[int(own[i])]  # of a hot context, this shard has a part only
            share = total / (np.repeat(size, np.diff(np.append(start, len(c)))) + MASS)
            trie = Trie(Trie.build(c, t, quantise(share)))
        rows = []
        for p, own, ends in zip(parts, contexts, tails, strict=True):
            codes = trie.lookup(own, ends) if trie else np.zeros(len(own), dtype=np.uint8)
            rows.append((p["shard"], p["block"], codes.tobytes(), None, None))
        return pa.Table.from_batches([_batch(_PART, rows)])
    return run


_SCORE = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
          ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
_SCORE_DDL = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double")


def _score(hot: dict[int, int], shards: int, types: int, tokens: int, starts: int):
    """One block's scores, from the block and its shards' answers."""
    hot_words = np.array(sorted(hot), dtype=_U)

    def run(_key, own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        replies: dict[bool, dict] = {True: {}, False: {}}
        for r in answers.to_pylist():
            replies[r["level"] == 1][r["shard"]] = r["a"]
        for row in own.to_pylist():
            b = _Block(row)
            context, token, doc, place, _, _, shard = _bigrams(b, hot_words, shards)
            count = np.empty(len(b.vocab) + 2, dtype=np.int64)
            for s, at in _split(_word_shard(b.hashes()[:-1], shards)):
                count[at] = np.frombuffer(replies[True][s], dtype=np.int64)
            count[-1] = starts  # each training text has one start
            codes = np.empty(len(shard), dtype=np.uint8)
            for s, at in _split(shard):
                codes[at] = np.frombuffer(replies[False][s], dtype=np.uint8)
            base = (count + 0.5) / (tokens + 0.5 * (types + 1))
            seen = count[context]
            p = PROBABILITY[codes[place]] + MASS / (seen + MASS) * base[token]
            n = len(b.docs)
            add = lambda x: np.bincount(doc, weights=x, minlength=n)
            rows += zip([None if f & 2 else d for d, f in zip(b.docs.tolist(), b.held.tolist(), strict=True)],
                        (b.held & 1).astype(bool).tolist(), (b.sizes.astype(np.int64) + 1).tolist(),
                        add(count[token] > 0).astype(np.int64).tolist(), [tokens] * n,
                        add(np.log10(base)[token]).tolist(), add(np.log10(p)).tolist(), strict=True)
        return pa.Table.from_batches([_batch(_SCORE, rows)])
    return run


def score(df: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """Train on the rows for which ``held_out`` does not hold and score all:
    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    blocks = written(rows.mapInArrow(_tokenise, _BLOCK_DDL))
    # as many shards as blocks, so a shard gathers about what a block holds
    shards = max(16, blocks.count())

    def exchange(ask, answer) -> DataFrame:
        return written(blocks.mapInArrow(ask, _PART_DDL).groupBy("shard").applyInArrow(answer, _PART_DDL))

    words = exchange(_ask_words(shards), _answer_words)
    sums = words.where("block = -1").mapInArrow(_sums, "types bigint, tokens bigint, word bigint, n bigint, end boolean")
    total = sums.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("types"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
                     F.coalesce(F.max(F.when(F.col("end"), F.col("n"))), F.lit(0)).alias("texts")).first()
    common = sums.where(F.col("n") > F.lit(total["tokens"] / HOT)).select("word", "n").collect()  # HOT rows at most
    hot = {r["word"] % (1 << 64): r["n"] for r in common} | {START: total["texts"]}
    bigrams = exchange(_ask_bigrams(hot, shards), _answer_bigrams(hot))
    answers = (words.where("block >= 0").select("block", "shard", F.col("a"), F.lit(1).alias("level"))
               .union(bigrams.select("block", "shard", "a", F.lit(2).alias("level"))))
    run = _score(hot, shards, total["types"], total["tokens"], total["texts"])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SCORE_DDL)


def _sums(batches):
    """The shards' own rows, spread out: sums, and a row for each common word."""
    schema = [("types", pa.int64()), ("tokens", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("end", pa.bool_())]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            types, tokens = np.frombuffer(r["a"], dtype=np.int64).tolist()
            rows.append((types, tokens, None, None, None))
            for w, n in zip(np.frombuffer(r["b"], dtype=_U).tolist(), np.frombuffer(r["c"], dtype=np.int64).tolist(), strict=True):
                rows.append((None, None, w - (1 << 64) if w >> 63 else w, n, w == END))
        yield _batch(schema, rows)
