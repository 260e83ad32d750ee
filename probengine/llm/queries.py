"""One registered query per operator, over its whole table with production
parameters; ``QUERIES`` and their DuckDB twins ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probengine.llm import alignment, bpe, chat, manifest, minhash, ngram_lm, packing, pages, pii, quality, secret_scan, token_counts, topk
from probengine.llm.common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return minhash.components(table(spark, sf_dir, "documents"))


ORACLE_SQL["op1_minhash"] = minhash.ORACLE_SQL


@query
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLE_SQL["op2_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and the weakly supervised verdict of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in counts],
                         quality.base_failed().alias("base_failed"), "kept", F.round("posterior", 6).alias("posterior"))


ORACLE_SQL["op3_quality"] = quality.oracle_sql()


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.extract(found, pages.learn_weights(found)).select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, ordered, validated and serialised calls of all conversations."""
    return chat.link(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op5_tool_calls"] = chat.ORACLE_SQL


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, counted and written out."""
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.ALWAYS))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, ("email", "ip", "card", "phone")),
        F.sha2(pii.written_spans(base), 256).alias("base_sha256"),
        pii.written_spans(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


@query
def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return ngram_lm.score(table(spark, sf_dir, "documents"), held_out)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the rank file, and the bytes they decode to."""
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text")
    return bpe.decode(ids, vocabulary).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of all documents."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "tier", "step_group",
    )


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"),
    )


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned in every document."""
    aligned = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                              public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.withColumn("groups_sha256", digest).drop("groups")


@query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, counted and written out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.detect(documents, secret_scan.learn(documents)).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secret_scan.BASE), F.sha2(pii.written_spans(base), 256).alias("base_sha256"),
                        pii.written_spans(F.col("spans")).alias("spans"))


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; every third one's text
    is tampered with and must fail if that changed it."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = {"text": F.when(chosen, manifest.lower_letters(F.col("text"))).otherwise(F.col("text"))}
    built = manifest.build(table(spark, sf_dir, "documents"), "doc_id", "lang",
                           ("doc_id", "source", "lang", "n_chars", "text"), tampered)
    found = manifest.folded(F.col("claimed"), F.col("steps"))
    return built.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("steps")), 256).alias("proof_sha256"),
                        found.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL["op13_manifest"] = manifest.ORACLE_SQL
