"""Byte-level BPE encoding and decoding in linear time.

Method: the tokens' bytes are mapped to Latin-1 strings and put into an
Aho-Corasick automaton. One scan of a pre-token gives the longest token that
starts at every byte. The encoder then walks forward, always trying the
longest token; a token may follow another only if the two are *compatible*,
that is if merging their joined bytes by rank gives back exactly these two
tokens. If no prefix of the match is compatible, the encoder steps back over
the last token and marks the place as a dead end. Each place is left at most
once, so the walk is linear in the pre-token's length, and as a sequence whose
adjacent tokens are all compatible is the only merge result, the ids are those
of the exact merges. Compatibility of two tokens is memoised.

Null text: the empty list. Very long pre-tokens cost linear time and are not
cached. Every byte is a token, so any text can be encoded. Extra columns pass
through; a column of the output's name is replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from probengine.llm.common import Memo, list_array, prepare, texts
from probengine.llm.segments import blank_words


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of base64 token and rank."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    ranks = {int(n): base64.b64decode(t) for t, n in rows}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


class LinearBpe:
    """Encoder and decoder for one vocabulary (tokens by rank) and pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.id_of = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in self.id_of for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.lengths = [len(t) for t in tokens]
        self.shorter = [self._prefix(t) for t in tokens]
        self.halves: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        for i in range(len(tokens)):
            self.halves.append(self._last_merge(i))
        self.compatible = functools.lru_cache(1 << 20)(self._compatible)
        self.pieces = Memo(lambda m: array("i", self.encode_piece(m.encode())).tobytes())
        # whether the pattern leaves a blank and letters in one piece
        letters = self.pattern.findall(" word") == [" word"]
        self.blank = Memo(lambda w: self.pieces[" " + w] if letters and w.isalpha() else self._packed(" " + w))
        self.head = Memo(self._packed)

    def _prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        return next((self.id_of[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.id_of), -1)

    def _last_merge(self, i: int) -> tuple[int, int]:
        """The two tokens whose merge makes token ``i``; (i, i) for a byte or
        a token that merges never reach."""
        token, left = self.tokens[i], self.shorter[i]
        while left >= 0:
            right = self.id_of.get(token[self.lengths[left]:], -1)
            if 0 <= right < i and left < i and self._compatible(left, right):
                self.merged[left, right] = i
                return left, right
            left = self.shorter[left]
        return i, i

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the merges of the joined bytes keep the border of a and b.

        The merges are undone in reverse order of rank, from the border
        outwards: a pair across the border that merges earlier than the
        later of the two parts was made would have crossed the border."""
        bound = len(self.tokens)
        while True:
            if self.merged.get((a, b), bound) < bound:
                return False
            # undo the later of the two parts; on a tie the right one was merged later
            for side in ("left", "right") if a > b else ("right", "left"):
                part = a if side == "left" else b
                inner = self.halves[part][1 if side == "left" else 0]
                if inner != part:
                    if side == "left":
                        bound, a = part, inner
                    else:
                        bound, b = part + 1, inner
                    break
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.id_of.get(piece)
        if whole is not None:
            return [whole]
        size, lengths, shorter, compatible = len(piece), self.lengths, self.shorter, self.compatible
        latin = piece.decode("latin-1")
        # if the leftmost longest matches happen to be compatible, they are the ids
        greedy = [i for _, (i, _) in self.automaton.iter_long(latin)]
        if all(map(compatible, greedy, greedy[1:])):
            return greedy
        longest = [-1] * size
        for end, (i, n) in self.automaton.iter(latin):
            longest[end + 1 - n] = i  # matches come by their end, so the longest is last
        dead: set[int] = set()
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < size:
            while token >= 0:
                end = at + lengths[token]
                if end not in dead and (last < 0 or compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < size else -1
            else:
                if last < 0:
                    raise ValueError("no merge result: the ranks are no BPE vocabulary")
                dead.add(at)
                out.pop()
                at -= lengths[last]
                token, last = shorter[last], out[-1] if out else -1
        return out

    def _packed(self, text: str) -> bytes:
        """Ids of a text as int32 bytes, each match of the pattern encoded by
        itself."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        head, words = blank_words(text)
        return np.frombuffer(b"".join([self.head[head], *map(self.blank.__getitem__, words)]), dtype=np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_BUILT: dict[str, LinearBpe] = {}


class Vocabulary:
    """A vocabulary broadcast to the workers: about 1 MB for 50,000 tokens,
    bounded by the file, not by the data."""

    MOST_BYTES = 64 << 20

    def __init__(self, spark, path: str, pattern: str):
        tokens = read_ranks(path)
        if sum(map(len, tokens)) > self.MOST_BYTES:
            raise ValueError("the vocabulary is too large to broadcast")
        self.digest = hashlib.sha256(b"\0".join(tokens) + pattern.encode()).hexdigest()
        self.shared = spark.sparkContext.broadcast((tokens, pattern))

    def codec(self) -> LinearBpe:
        if self.digest not in _BUILT:
            _BUILT.clear()
            _BUILT[self.digest] = LinearBpe(*self.shared.value)
        return _BUILT[self.digest]

    def __getstate__(self):
        return {"digest": self.digest, "shared": self.shared}


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out`` (array of int): the ids of ``text``."""
    prepare(df.sparkSession)

    @arrow_udf("array<int>")
    def ids_of(column: pa.Array) -> pa.Array:
        codec = vocabulary.codec()
        return list_array([codec.encode(t) for t in texts(column)], pa.int32())

    return df.withColumn(out, ids_of(F.col(text)))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the bytes that the ids stand for; null ids give
    empty bytes, an id outside the vocabulary raises."""
    prepare(df.sparkSession)

    @arrow_udf("binary")
    def bytes_of(column: pa.Array) -> pa.Array:
        tokens = vocabulary.codec().tokens
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and not 0 <= flat.min() <= flat.max() < len(tokens):
            raise ValueError("an id outside the vocabulary")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        return pa.array([b"".join(map(tokens.__getitem__, x.tolist())) for x in np.split(flat, ends)[:-1]], type=pa.binary())

    return df.withColumn(out, bytes_of(F.col(ids)))
