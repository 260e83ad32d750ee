"""Token counts by a two-tier lookup on the map side.

A SentencePiece BPE model marks blanks with U+2581, and here no piece holds
that mark after another character. So the normalised text falls apart before
every mark that follows another character, no merge crosses such a place, and
the text's token count is the sum over these pre-tokens.

Tier one is a compact hash table of frequent pre-tokens and their lengths: the
whole words of the model's own vocabulary, which BPE training has put there
because they were frequent. Its size is bounded by the vocabulary and checked;
it is broadcast. Tier two encodes what the table misses and keeps it in the
worker's bounded cache. No pre-token is ever shuffled, there is no exchange at
all, and a lost executor's tasks just run again.

Null and empty texts have no tokens. Text of any length is counted whole, one
pre-token at a time. Extra columns pass through; a column named like an output
is replaced.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from sentencepiece import sentencepiece_model_pb2

from probengine.llm.common import Memo, prepare, texts

MARK = "▁"
#: Entries of the broadcast table at most; beyond it the later words of the
#: vocabulary, which are the rarer ones, are left to the workers' caches.
TABLE_LIMIT = 1 << 16
_RUNS = re.compile(" +[^ ]+| +$")


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """The processor, if the model's text rules allow the lookup."""
    spec = sentencepiece_model_pb2.ModelProto.FromString(model)
    rules = spec.normalizer_spec
    if (rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces
            or not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix):
        raise ValueError("the model rewrites its text in a way the lookup does not know")
    if any(MARK in p.piece.lstrip(MARK) or p.type == p.USER_DEFINED for p in spec.pieces):
        raise ValueError("the model has pieces that cross pre-tokens")
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def frequent_lengths(model: bytes) -> dict[str, int]:
    """Length in tokens of the vocabulary's whole words, without their mark,
    in the vocabulary's order."""
    processor = load(model)
    words = [p[1:] for p in map(processor.id_to_piece, range(len(processor)))
             if p.startswith(MARK) and p.strip(MARK)][:TABLE_LIMIT]
    return dict(zip(words, map(len, processor.encode(words, num_threads=1)), strict=True))


class _Counter:
    def __init__(self, model: bytes, frequent: dict[str, int]):
        processor = load(model)
        # a run of one blank at the text's end is a mark alone
        self.lengths = Memo(lambda w: len(processor.encode(w)), {**frequent, "": 1})

    def count(self, text: str) -> int:
        """Tokens of a text: the model puts one mark before it and writes
        every blank as a mark, so each run of blanks stands before a word."""
        if not text:
            return 0
        words = text.split(" ")
        if MARK in text or "" in words:
            words = [run[1:] for run in _RUNS.findall(" " + text.replace(MARK, " "))]
        return sum(map(self.lengths.__getitem__, words))


_BUILT: dict[str, _Counter] = {}


def count_tokens(df: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add ``out`` (long): the number of tokens of ``text``."""
    spark = df.sparkSession
    prepare(spark)
    with open(model_path, "rb") as f:
        model = f.read()
    digest = hashlib.sha256(model).hexdigest()
    shared = spark.sparkContext.broadcast((model, frequent_lengths(model)))

    @arrow_udf("bigint")
    def counts(column: pa.Array) -> pa.Array:
        if digest not in _BUILT:
            _BUILT.clear()
            _BUILT[digest] = _Counter(*shared.value)
        count = _BUILT[digest].count
        return pa.array([count(t) for t in texts(column)], type=pa.int64())

    return df.withColumn(out, counts(F.col(text)))
