"""Secrets: patterns, and formats learned from what the patterns find.

Three patterns give the base spans: ``assign``, a keyword and the value set to
it; ``access``, an access key; ``hex``, a long run of hexadecimal digits. A base span is the
whole match, offsets count code points, ends are exclusive.

Method: grammar inference. The base matches label their credentials (of an
assignment, the value). Of each kind a prefix tree of labelled values is built and its
states are merged while they are statistically compatible: two states are if the
frequencies of ending and of every next character differ by less than Hoeffding's
bound at ``ALPHA``, and so on down the tree. What is left is a probabilistic automaton of
the kind's format; one more is learned from runs of the same characters that no
pattern finds. Every candidate, a run of at least ``LEAST`` such characters outside the base spans, is
scored by the log-likelihood of each format over that of the ordinary runs. The
best kind adds a span ``like_<kind>`` if the gain is ``ODDS`` nats or more and
the log-likelihood per character is at most ``TAIL`` standard deviations below the mean of the labelled values.

The tree is fitted on a bounded sample: per kind the ``SAMPLE / BUCKETS``
distinct values of at most ``LONGEST`` characters with the smallest hashes in
each of ``BUCKETS`` hash buckets. Drawing it reads all documents, and all candidates are
scored. Copies of a value count once.

Null and empty texts have no spans; whole texts are searched, however long.
Without labelled values of a kind there is no automaton and no added span of
it. Repeated rows get equal results. Extra columns pass through; one named like the output is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from probengine.llm.common import prepare, texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, *(f"like_{k}" for k in BASE))
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
ALPHA, SAMPLE, BUCKETS, LONGEST = 0.05, 2048, 64, 128
LEAST, ODDS, TAIL = 16, 12.0, 4.0
#: Characters of values and candidates, and the share of probability that an
#: automaton keeps for characters it has not seen.
ALPHABET, UNSEEN = 68, 0.002

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", re.IGNORECASE | re.ASCII)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{LEAST},}}+")


def base_spans(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of every base match."""
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield "assign", m.start(), m.end(), m[2]
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= 20:
                yield "access", m.start(), m.end(), m[0]
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end(), m[0]


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs outside the taken spans, without full stops and dashes at their ends."""
    for m in _RUN.finditer(text):
        run = m[0]
        start = m.start() + len(run) - len(run.lstrip(".-"))
        end = m.end() - len(run) + len(run.rstrip(".-"))
        if end - start >= LEAST and all(end <= s or e <= start for s, e in taken):
            yield start, end


class Automaton:
    """A probabilistic automaton: per state the number of visits, of ends, and
    of moves by character, and where each move goes."""

    def __init__(self, visits: list[int], ends: list[int], moves: list[dict[str, tuple[int, int]]]):
        self.visits, self.ends, self.moves = visits, ends, moves
        self.logs = [{c: (math.log((1 - UNSEEN) * n / v + UNSEEN / ALPHABET), to) for c, (n, to) in m.items()}
                     for v, m in zip(visits, moves, strict=True)]
        self.stop = [math.log((1 - UNSEEN) * e / v + UNSEEN / ALPHABET) for v, e in zip(visits, ends, strict=True)]
        self.unseen = math.log(UNSEEN / ALPHABET)

    def log_likelihood(self, word: str) -> float:
        """Natural logarithm; a character that the state has not seen costs
        ``unseen`` and stays in the state."""
        at, total, logs, nothing = 0, 0.0, self.logs, (self.unseen, -1)
        for c in word:
            gain, to = logs[at].get(c, nothing)
            total += gain
            at = to if to >= 0 else at
        return total + self.stop[at]


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of ``words``: their prefix tree, with each state merged
    into the first compatible one, in breadth-first order."""
    visits, ends, moves = [0], [0], [{}]        # moves: character -> [count, state]
    for word in sorted(words):
        at = 0
        visits[0] += 1
        for c in word:
            if c not in moves[at]:
                moves[at][c] = [0, len(visits)]
                visits.append(0)
                ends.append(0)
                moves.append({})
            move = moves[at][c]
            move[0] += 1
            at = move[1]
            visits[at] += 1
        ends[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = visits[p], visits[q]
            # the difference is 1 at most, so rare states agree with any other
            if bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)) < 1:
                if differ(ends[p], n, ends[q], m):
                    return False
                mp, mq = moves[p], moves[q]
                for c in mp.keys() | mq.keys():
                    if differ(mp[c][0] if c in mp else 0, n, mq[c][0] if c in mq else 0, m):
                        return False
                todo += [(mp[c][1], mq[c][1]) for c in mp.keys() & mq.keys() if mp[c][1] != mq[c][1]]
        return True

    def fold(p: int, q: int) -> None:
        """Add the tree below ``q`` to ``p``."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            visits[p] += visits[q]
            ends[p] += ends[q]
            for c, (n, to) in sorted(moves[q].items()):
                if c in moves[p]:
                    moves[p][c][0] += n
                    todo.append((moves[p][c][1], to))
                else:
                    moves[p][c] = [n, to]

    kept, is_kept = [0], {0}
    while True:
        edge = next(((p, c) for p in kept for c in sorted(moves[p]) if moves[p][c][1] not in is_kept), None)
        if edge is None:
            break
        p, c = edge
        blue = moves[p][c][1]
        into = next((r for r in kept if compatible(r, blue)), None)
        if into is None:
            kept.append(blue)
            is_kept.add(blue)
        else:
            moves[p][c][1] = into
            fold(into, blue)
    place = {s: i for i, s in enumerate(kept)}
    return Automaton([visits[s] for s in kept], [ends[s] for s in kept],
                     [{c: (n, place[to]) for c, (n, to) in moves[s].items()} for s in kept])


_LABELLED = "array<struct<kind:string,value:string>>"


def labelled(df: DataFrame, text: str = "text") -> DataFrame:
    """The bounded sample (kind, value) that the automata are learned from;
    kind ``other`` holds runs that no pattern finds."""
    prepare(df.sparkSession)

    @arrow_udf(_LABELLED)
    def found(column: pa.Array) -> pa.Array:
        out = []
        for t in texts(column):
            base = list(base_spans(t))
            rows = {(k, v) for k, _, _, v in base} | {("other", t[s:e]) for s, e in candidates(t, [b[1:3] for b in base])}
            out.append([{"kind": k, "value": v} for k, v in sorted(rows) if len(v) <= LONGEST])
        return pa.array(out, type=pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))

    values = df.select(F.explode(found(F.col(text))).alias("x")).select("x.*").distinct()
    digest = F.xxhash64("kind", "value")
    first = Window.partitionBy("kind", "bucket").orderBy("digest", "value")
    return (values.withColumn("digest", digest).withColumn("bucket", F.pmod("digest", F.lit(BUCKETS)))
            .withColumn("place", F.row_number().over(first)).where(F.col("place") <= SAMPLE // BUCKETS).select("kind", "value"))


def learn(df: DataFrame, text: str = "text") -> dict[str, tuple[Automaton, float]]:
    """Per kind its automaton and the least log-likelihood per character. One
    task per kind fits at most ``SAMPLE`` values of ``LONGEST`` characters;
    the driver receives their states, never more than those characters."""
    schema = "kind string, state int, visits int, ends int, least double, letters array<string>, counts array<int>, goes array<int>"

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        words = sample["value"].tolist()
        made = infer(words)
        likely = np.array([made.log_likelihood(w) / (len(w) + 1) for w in words])
        least = float(likely.mean() - TAIL * likely.std())
        return pd.DataFrame([{"kind": sample["kind"].iloc[0], "state": i, "visits": v, "ends": e, "least": least, "letters": list(m),
                              "counts": [n for n, _ in m.values()], "goes": [to for _, to in m.values()]}
                             for i, (v, e, m) in enumerate(zip(made.visits, made.ends, made.moves, strict=True))])

    rows = labelled(df, text).groupBy("kind").applyInPandas(fit, schema).orderBy("kind", "state").collect()
    out = {}
    for kind in {r.kind for r in rows}:
        own = [r for r in rows if r.kind == kind]
        made = Automaton([r.visits for r in own], [r.ends for r in own],
                         [dict(zip(r.letters, zip(r.counts, r.goes, strict=True), strict=True)) for r in own])
        out[kind] = (made, own[0].least)
    return out


def best_format(word: str, formats: dict[str, tuple[Automaton, float]]) -> tuple[str, float] | None:
    """The kind that explains a candidate best and its gain, if it is enough."""
    plain = formats["other"][0].log_likelihood(word) if "other" in formats else -len(word) * math.log(ALPHABET)
    best = None
    for kind in BASE:
        if kind in formats:
            automaton, least = formats[kind]
            score = automaton.log_likelihood(word)
            if score - plain >= ODDS and score / (len(word) + 1) >= least and (best is None or score - plain > best[1]):
                best = kind, score - plain
    return best


def find_spans(text: str, formats: dict[str, tuple[Automaton, float]]) -> list[dict]:
    """All spans by start, then by kind as listed; the score of a base span is
    its credential's gain under its own kind's format, if that was learned."""
    base = list(base_spans(text))
    out = [{"kind": k, "start": s, "end": e, "score": formats[k][0].log_likelihood(v) if k in formats else None} for k, s, e, v in base]
    for s, e in candidates(text, [b[1:3] for b in base]):
        best = best_format(text[s:e], formats)
        if best:
            out.append({"kind": f"like_{best[0]}", "start": s, "end": e, "score": best[1]})
    return sorted(out, key=lambda x: (x["start"], KINDS.index(x["kind"])))


def detect(df: DataFrame, formats: dict[str, tuple[Automaton, float]], text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: the secrets in ``text`` (kind, start, end, score)."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(formats)      # bounded by the sample

    @arrow_udf(SPANS)
    def spans(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.array([find_spans(t, shared.value) for t in texts(column)], type=kind)

    return df.withColumn(out, spans(F.col(text)))
