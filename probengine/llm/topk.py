"""Exact top-k inner products by a three-phase uniform threshold.

The vectors are cut into ``slices`` of their components. Slice j ranks all
vectors for a query by their partial product, and a vector's score is the sum
of its partial products.

1. *Gather.* Of every query's slice lists, the ``k`` first entries of each
   block are scored exactly and merged. The k-th best of these real scores is
   a safe cutoff: no vector below it can be in the result.
2. *Cutoff.* It goes back to the blocks with the queries, and is split
   uniformly among the slices, in excess of each slice's mean. A vector that
   is below its share in every slice is below the cutoff; only entries that
   reach their share somewhere are collected.
3. *Resolve.* The collected entries' other slices are added, scores below the
   cutoff dropped, and the rest merged into the k best.

Equal vectors have equal scores, so they are scored as one class, of which
only the k + 1 smallest ids can be in a result (a query leaves itself out).
Classes and queries are packed into blocks, and each pair of a class block
and a query block is one task's row; no pair of vectors is ever a row, only
entries that reach a cutoff. Both passes read the blocks again and keep k
entries a query, so memory is bounded by two blocks.

Scores are integers, exact while no product sum can reach 2**53,
else computed with Python integers; one that no long holds raises an error.
Vectors that are null, empty or hold a
null or non-finite component take no part; only vectors of one length are
compared. Ties go to the smaller id; equal rows count once, and rows of one id
are never candidates for each other. A query with fewer than k candidates gets
them all, an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probengine.llm.common import prepare, written

SCALE = 256
BLOCK = 2048
#: Tasks that share one query block's work.
SALTS = 16
_EXACT = float(1 << 53)


def scaled(vectors: DataFrame, vec: str, scale: int = SCALE) -> DataFrame:
    """Rows that take part, ``vec`` turned into floor(scale * component)."""
    x = F.col(vec)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & fine).withColumn(vec, whole)


def _pack(rows: DataFrame, extra: str, kind: str) -> DataFrame:
    """Rows (dim, vec, extra) packed into blocks of at most BLOCK rows of one
    length: (dim, n, values, extras)."""

    def run(batches):
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            got = held.pop(dim)
            values = np.array([v for v, _ in got], dtype=np.float64).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(got)], pa.int32()), pa.array([values], pa.binary()),
                 pa.array([[e for _, e in got]], pa.list_(types[kind]))], ["dim", "n", "vals", "extras"])

        types = {"array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64()}
        for batch in batches:
            for v, e in zip(batch.column("vec").to_pylist(), batch.column(extra).to_pylist(), strict=True):
                held.setdefault(len(v), []).append((v, e))
                if len(held[len(v)]) >= BLOCK:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return rows.select("vec", extra).mapInArrow(run, f"dim int, n int, vals binary, extras array<{kind}>")


def _matrix(blob: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.float64).reshape(n, dim)


def _parts(q: np.ndarray, c: np.ndarray, slices: int) -> list[np.ndarray]:
    """Partial products of each slice, queries by classes; exact integers."""
    bounds = np.linspace(0, q.shape[1], min(slices, q.shape[1]) + 1).astype(int)
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] >= _EXACT:
        exact = lambda m: np.vectorize(int, otypes=[object])(m)
        q, c = exact(q), exact(c)
    return [q[:, a:b] @ c[:, a:b].T for a, b in zip(bounds, bounds[1:])]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k largest values."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    if scores.dtype == object:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


_ENTRY = "query_id bigint, vec_id bigint, score bigint"


def _entries(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def _members(query: int, ids: list[int], score, k: int):
    others = [i for i in ids if i != query]
    return [(query, i, int(score)) for i in others[:k]]


def _gather(k: int, slices: int):
    """Phase 1: exact scores of the first entries of each slice's list."""

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                q, c = _matrix(b["q_vals"], b["q_n"], b["dim"]), _matrix(b["vals"], b["n"], b["dim"])
                parts = _parts(q, c, slices)
                total = sum(parts)
                # a class of the query alone has no candidate, so one entry more
                seen = np.concatenate([_best(p, k + 1) for p in parts], axis=1)
                rows = []
                for i, query in enumerate(b["q_ids"]):
                    found = [r for j in set(seen[i].tolist()) for r in _members(query, b["extras"][j], total[i, j], k)]
                    rows += sorted(found, key=lambda r: (-r[2], r[1]))[:k]
                yield _entries(rows)
    return run


def _collect(k: int, slices: int):
    """Phases 2 and 3: entries that reach their share of the cutoff in some
    slice, then those whose exact score reaches the cutoff."""

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                q, c = _matrix(b["q_vals"], b["q_n"], b["dim"]), _matrix(b["vals"], b["n"], b["dim"])
                parts = _parts(q, c, slices)
                low = b["cutoffs"]
                cutoff = np.array([-np.inf if x is None else x for x in low], dtype=np.float64)
                if parts[0].dtype == object:
                    reached = np.ones(parts[0].shape, dtype=bool)
                else:
                    means = [p.mean(axis=1) for p in parts]
                    share = (cutoff - sum(means)) / len(parts)
                    # half a unit less: rounding may never lose an entry
                    reached = np.zeros(parts[0].shape, dtype=bool)
                    for p, m in zip(parts, means, strict=True):
                        reached |= p >= (m + share - 0.5)[:, None]
                rows = []
                for i, query in enumerate(b["q_ids"]):
                    at = np.flatnonzero(reached[i])
                    scores = sum(p[i, at] for p in parts)
                    found = [r for j, s in zip(at.tolist(), scores.tolist(), strict=True) if low[i] is None or s >= low[i]
                             for r in _members(query, b["extras"][j], s, k)]
                    rows += sorted(found, key=lambda r: (-r[2], r[1]))[:k]
                yield _entries(rows)
    return run


def _merge(entries: DataFrame, k: int) -> DataFrame:
    """The k best entries of each query, best first: every block has sent k
    at most, ranked by score and then by smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return entries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 5, slices: int = 4, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for
    which ``is_query`` (a column) holds."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = scaled(vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vec).alias("vec"), is_query.alias("asks"))
                  .where(F.col("id").isNotNull()), "vec")
    rows = rows.groupBy("vec", "id").agg(F.max("asks").alias("asks"))
    # of a class, however large, each map task sends k + 1 rows (a group limit before the shuffle)
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    first_ids = rows.select("vec", "id").withColumn("place", place).where(F.col("place") <= k + 1)
    classes = first_ids.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    blocks = written(_pack(classes, "ids", "array<bigint>").withColumn("block", F.monotonically_increasing_id()))
    queries = written(_pack(rows.where("asks"), "id", "bigint").select(
        F.monotonically_increasing_id().alias("q_block"), "dim", F.col("n").alias("q_n"),
        F.col("vals").alias("q_vals"), F.col("extras").alias("q_ids")))
    # the pairs of blocks: a class block goes to every query block of its length, and a query block to every salt
    wanted = queries.groupBy("dim").agg(F.collect_list("q_block").alias("q_blocks"))
    paired = (blocks.join(wanted, "dim").withColumn("q_block", F.explode("q_blocks"))
              .withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS))).drop("q_blocks", "block"))

    def pass_over(asking: DataFrame, run) -> DataFrame:
        spread = asking.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        return paired.join(spread, ["dim", "q_block", "salt"]).mapInArrow(run, _ENTRY)

    first = _merge(pass_over(queries, _gather(k, slices)), k)
    cutoffs = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))
    placed = queries.select("q_block", F.posexplode("q_ids").alias("at", "query_id")).join(cutoffs, "query_id", "left")
    listed = placed.groupBy("q_block").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "cutoff"))), lambda s: s["cutoff"]).alias("cutoffs"))
    asking = queries.join(listed, "q_block")
    return _merge(pass_over(asking, _collect(k, slices)), k).select("query_id", "rank", "vec_id", "score")

