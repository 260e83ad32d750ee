"""Near-duplicate groups by HyperMinHash, banding and exact confirmation.

*Sets.* A document's set are its distinct shingles of five words (ASCII
letters lower-cased), as 64-bit hashes; a shorter text is one shingle, a text
without words has the empty set and is linked with nothing. Documents with
equal sets form a class, and only its smallest id goes on.

*Registers.* A HyperMinHash register holds, of a minimum hash, the count of
leading zeros and the ten bits behind the leading one. Large sets (512
shingles or more) fill 128 buckets with one hash function; sets of up to 683
take 128 functions with one bucket each, as they would leave buckets empty.
Two sets of similarity 0.75 or more always share one of the two forms.

*Candidates.* 32 bands of four registers are hashed to buckets. A pair at the
threshold shares none of them in 5 of a million cases.

*Links.* First every class is compared with one pivot, the smallest id of a
bucket, of all its buckets' the one that it meets most often. Where all
classes of a bucket are connected by then, nothing is left to do. The other
buckets are compared within, in tasks of two chunks of bounded size, and only
pairs that are not yet connected there. So a group of thousands of near
copies costs a few links each, no pair is ever a row but a link, and no pair
of a bucket that could still connect something is left out.
A comparison estimates the similarity from the registers, corrected for
chance collisions, and drops pairs whose estimate is four standard deviations
below the threshold; the rest is confirmed on the full sets.

*Components.* Smallest labels are passed along the links, with pointer
jumping, until nothing changes.

Null text: no words. doc_id is a key; rows that repeat an id with one text are
kept or dropped together, with several texts each is judged by its own. A null
doc_id has no component and is kept. Very long texts are hashed whole. An empty table gives an empty result.
Extra columns are not read by ``components`` and pass through ``deduplicate``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from probengine.llm.common import Memo, prepare, texts, written

WORDS = 5
#: Similarity in hundredths from which two sets are linked.
THRESHOLD = 75
REGISTERS, ROWS = 128, 4
MANTISSA = 10
#: Sets of up to SMALL shingles have many-function registers, of LARGE or more
#: bucket registers; LARGE <= 0.75 * SMALL, so linked sets share a form.
SMALL, LARGE = 683, 512
#: Standard deviations that an estimate may be below the threshold.
SLACK = 4.0
#: Classes of a bucket that are compared in one task, at most twice as many.
CHUNK = 512

_U = np.uint64
_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, size=WORDS, dtype=_U) * _U(2) + _U(1)
_SEED = np.random.default_rng(6).integers(0, 1 << 63, size=REGISTERS, dtype=_U) * _U(2) + _U(1)
_WORD_HASH = Memo(xxhash.xxh3_64_intdigest)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def shingles(text: str) -> np.ndarray:
    """The text's set: sorted distinct 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=_U)
    h = np.fromiter(map(_WORD_HASH.__getitem__, words), dtype=_U, count=len(words))
    if len(h) < WORDS:  # shorter sequences differ by their length, too
        return _mix(np.array([(h * _ODD[:len(h)]).sum(dtype=_U) + _U(len(h))]))
    n = len(h) - WORDS + 1
    total = h[:n] * _ODD[0]
    for i in range(1, WORDS):
        total += h[i:i + n] * _ODD[i]
    return np.unique(_mix(total))


def _register(minimum: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of hashes, read as fractions; from 1."""
    # 52 bits are exact in a double; a zero counts as the smallest fraction
    fraction, exponent = np.frexp(np.maximum(minimum >> _U(12), _U(1)).astype(np.float64))
    zeros = 52 - exponent
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return ((zeros << MANTISSA) + mantissa + 1).astype(np.uint16)


def registers(hashes: np.ndarray) -> tuple[bytes | None, bytes | None]:
    """Many-function registers of a small set, bucket registers of a large
    one; an empty bucket is 0."""
    small = large = None
    if 0 < len(hashes) <= SMALL:
        small = _register(((hashes[:, None] ^ _SEED) * _ODD[0] ^ _SEED * _ODD[1]).min(axis=0)).tobytes()
    if len(hashes) >= LARGE:
        bits = int(math.log2(REGISTERS))
        # the hashes are sorted, so a bucket's first is its least
        bucket, first = np.unique(hashes >> _U(64 - bits), return_index=True)
        filled = np.zeros(REGISTERS, dtype=np.uint16)
        filled[bucket.astype(np.int64)] = _register(hashes[first] << _U(bits))
        large = filled.tobytes()
    return small, large


def estimate(a: np.ndarray, b: np.ndarray, size_a, size_b, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of register rows a and b, and how many registers it is read
    from. Two different minima agree by chance if they fall into one cell;
    for hashes with densities n e^(-nx) and cells that are x / 2**MANTISSA
    wide, times 0.72 on average, that is 0.72 / 2**MANTISSA * n m / (n + m)^2."""
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    equal = ((a == b) & (a != 0)).sum(axis=-1)
    n, m = np.maximum(size_a / buckets, 1), np.maximum(size_b / buckets, 1)
    chance = 0.72 / (1 << MANTISSA) * n * m / (n + m) ** 2
    return (equal / np.maximum(used, 1) - chance) / (1 - chance), used


def may_link(a: np.ndarray, b: np.ndarray, size_a, size_b, buckets: int) -> np.ndarray:
    near, used = estimate(a, b, size_a, size_b, buckets)
    t = THRESHOLD / 100
    return near >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact rule on full sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 0 < 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def _forms(row: dict) -> dict:
    return {k: np.frombuffer(row[k], dtype=np.uint16) for k in ("small", "large") if row[k] is not None}


_BUCKETS = {"small": 1, "large": REGISTERS}


def sketch(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class, small, large) of every document."""

    def run(batches):
        for batch in batches:
            rows = []
            for t in texts(batch.column("text")):
                s = shingles(t)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), *registers(s)))
            n, key, small, large = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(small, pa.binary()), pa.array(large, pa.binary())],
                ["doc_id", "n_shingles", "class", "small", "large"])

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, class binary, small binary, large binary")


def _band_keys(form: str) -> Column:
    """One key for each band of a form that is not empty throughout."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)),
                       lambda i: F.struct(i.alias("band"), F.substring(F.col(form), i * width + 1, F.lit(width)).alias("cells")))
    filled = F.filter(keys, lambda k: k["cells"] != F.lit(bytes(width)))
    hashed = F.transform(filled, lambda k: F.xxhash64(F.lit(form), k["band"], k["cells"]))
    return F.coalesce(hashed, F.array().cast("array<bigint>"))


@arrow_udf(T.BooleanType())
def _confirm(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two classes are linked: by estimate, then by their full sets."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        fx, fy = _forms(x), _forms(y)
        shared = [k for k in fx if k in fy]
        out.append(any(bool(may_link(fx[k], fy[k], x["n"], y["n"], _BUCKETS[k])) for k in shared)
                   and linked(shingles(x["text"] or ""), shingles(y["text"] or "")))
    return pa.array(out, pa.bool_())


def _join_chunks(left: list[dict], right: list[dict], same: bool) -> list[tuple[int, int]]:
    """Links that connect what was not connected, of two chunks' pairs: like
    Kruskal's, the most similar pairs first, so that most need no look."""
    rows = left if same else left + right
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    forms, sets, links = [_forms(r) for r in rows], {}, []

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(rows[i]["text"] or "")
        return sets[i]

    tried: list[tuple[float, int, int]] = []
    for form, buckets in _BUCKETS.items():
        at = [i for i, f in enumerate(forms) if form in f]
        if len(at) < 2:
            continue
        cells = np.stack([forms[i][form] for i in at])
        size = np.array([rows[i]["n"] for i in at], dtype=np.float64)
        group = np.array([rows[i]["comp"] for i in at])
        side = np.array([same or i < len(left) for i in at])
        for k in range(len(at) - 1):
            near, used = estimate(cells[k], cells[k + 1:], size[k], size[k + 1:], buckets)
            open_ = (group[k + 1:] != group[k]) & (same | (side[k + 1:] != side[k]))
            open_ &= near >= THRESHOLD / 100 - SLACK * np.sqrt(THRESHOLD * (100 - THRESHOLD) / 10000 / np.maximum(used, 1))
            tried += [(-float(near[j]), at[k], at[k + 1 + j]) for j in np.flatnonzero(open_).tolist()]
    for _, i, j in sorted(tried):
        a, b = root(rows[i]["comp"]), root(rows[j]["comp"])
        if a != b and linked(full(i), full(j)):
            parent[max(a, b)] = min(a, b)
            links.append((rows[i]["rep"], rows[j]["rep"]))
    return links


def _compare_within(table: pa.Table) -> pa.Table:
    """Links of one task's two chunks of a bucket."""
    rows = table.to_pylist()
    i, j = rows[0]["i"], rows[0]["j"]
    links = _join_chunks([r for r in rows if r["chunk"] == i], [r for r in rows if r["chunk"] == j], i == j)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def connected(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of a link
    (a, b). Each round takes the least label of the neighbours, then the label
    of that label, and is written, so a lost executor rereads it."""
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(seen, "node").select("node", F.least("comp", "near").alias("step"), F.col("comp").alias("before"))
        jump = labels.select(F.col("node").alias("step"), F.col("comp").alias("after"))
        moved = written(least.join(jump, "step").select("node", F.least("step", "after").alias("comp"), "before"))
        labels = moved.select("node", "comp")
        if moved.where("comp <> before").isEmpty():
            return labels


def components(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``df``."""
    prepare(df.sparkSession)
    sketches = written(sketch(df, text))
    classes = written(sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("small").alias("small"), F.first("large").alias("large")))
    keyed = classes.select("rep", F.explode(F.concat(_band_keys("small"), _band_keys("large"))).alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"),
                                       F.count(F.lit(1)).alias("size")).where("pivot <> last").drop("last")
    members = written(keyed.join(buckets, "key"))

    # the classes that meet any other, with their text
    meeting = members.select("rep").distinct()
    worded = (df.select(F.col("doc_id").cast("bigint").alias("rep"), F.col(text).alias("text")).join(meeting, "rep", "left_semi")
              .groupBy("rep", F.xxhash64("text").alias("version")).agg(F.first("text").alias("text")).drop("version"))
    met = written(classes.drop("class").join(worded, "rep"))

    def side(name: str, node: str) -> DataFrame:
        return met.select(F.col("rep").alias(node), F.struct("n", "small", "large", "text").alias(name))

    # each class and the pivot that it shares most buckets with
    pivots = (members.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("shared"))
              .groupBy("rep").agg(F.max(F.struct("shared", (-F.col("pivot")).alias("least"))).alias("best"))
              .select(F.col("rep").alias("a"), (-F.col("best.least")).alias("b")))
    checked = pivots.join(side("x", "a"), "a").join(side("y", "b"), "b")
    links = written(checked.where(_confirm("x", "y")).select("a", "b").distinct())

    # buckets that hold several components yet
    labels = connected(links)
    placed = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    open_ = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    rows = (placed.join(open_, "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
            .select("key", "rep", "comp", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")))
    more = (rows.join(met, "rep").groupBy("key", "i", "j").applyInArrow(_compare_within, "a bigint, b bigint"))
    found = written(links.union(more).distinct())
    final = connected(found)

    named = sketches.join(classes.select("class", F.col("rep").alias("node")), "class", "left").select("doc_id", "n_shingles", "node")
    labelled = named.join(final, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("comp", "node"))
    out = labelled.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose document is kept."""
    gone = components(df, text).where(~F.col("kept")).select("doc_id").distinct()
    return df.join(gone, "doc_id", "left_anti")


#: DuckDB twin: every pair that shares a shingle, then reachability.
ORACLE_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
