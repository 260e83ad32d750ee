"""Tool-call linking for chat messages, in DataFrame functions only.

*Events.* A message whose text is a JSON object with ``tool_calls`` makes one
call per element (id, name, arguments, and ``after``: ids it waits for); an
object with ``tool_call_id`` is a result (``content``). A plain user turn is a
call of the tool ``reply`` with its text as ``prompt``, answered by a plain
assistant turn right behind it; it waits for the call of two turns before, whose
answer it follows. Other messages are neither.

*Linking.* Calls and results meet by (conversation, id) in a hash join, so a
long conversation is spread by its ids. Of several results of one call the
first turn counts, and of several calls of one id the first turn; the others
are ``repeated``. Calls without a result are ``unanswered``, results without a
call ``orphan``.

*Order.* A call that waits for none is at level 0, any other one level behind
the last it waits for. Waiting for an unknown id is no bar. Calls that wait for
one call only form chains: pointer doubling finds the head of each and the distance
to it in as many rounds as the logarithm of the longest. What is left, the
calls that wait for several, is levelled round by round, a round for each such
call on the longest path. Calls in a cycle, or behind one, get no level. Records
sort by (level, turn).

*Validation.* A tool's schema names its parameters with their JSON type,
whether they are required and, for strings, the most characters. Arguments are
valid if they are a JSON object whose parameters are all known and of their type,
with none missing or too long; an unknown tool is invalid.

*Serialisation.* Canonical JSON has its keys in order and no white space.

Null or empty text: a plain turn with an empty prompt or answer. Null conv_id
or turn: nothing can be linked by it, the record is unanswered or an orphan.
Repeated rows are repeated calls and results. Extra columns are not read. An
empty table gives no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probengine.llm.common import written

#: The longest prompt, in characters, that the tool ``reply`` takes.
PROMPT_MOST = 256
#: Tool: parameter: (type as schema_of_variant names it, required[, most characters]).
SCHEMAS = {"reply": {"prompt": ("STRING", True, PROMPT_MOST)}}
_MESSAGE = ("tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, "
            "tool_call_id string, content string")
_CALL = ["conv_id", "turn", "call_id", "name", "arguments", "after"]


def events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages (conv_id, turn, role, text)."""
    text = F.coalesce("text", F.lit(""))
    read = F.when(F.ltrim(text).startswith("{"), F.from_json(text, _MESSAGE))
    rows = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", text.alias("text"), read.alias("said"))
    plain = F.col("said.tool_calls").isNull() & F.col("said.tool_call_id").isNull()
    spoken = rows.where(F.col("said.tool_calls").isNotNull()).select("conv_id", "turn", F.explode("said.tool_calls").alias("c"))
    calls = spoken.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"),
                          F.col("c.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    asked = rows.where(plain & (F.col("role") == "user")).select(
        "conv_id", "turn", F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"),
        F.array(F.concat(F.lit("turn-"), (F.col("turn") - 2).cast("string"))).alias("after"))
    given = rows.where(F.col("said.tool_call_id").isNotNull()).select(
        "conv_id", "turn", F.col("said.tool_call_id").alias("call_id"), F.coalesce("said.content", F.lit("")).alias("content"))
    said = rows.where(plain & (F.col("role") == "assistant")).select(
        "conv_id", "turn", F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls.union(asked), given.union(said)


def _numbered(rows: DataFrame) -> DataFrame:
    """``nth``: place among the rows of one id by turn."""
    first = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", *[c for c in ("arguments", "content") if c in rows.columns]))
    return rows.withColumn("nth", F.when(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull(), first))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls outside of cycles."""
    known = calls.select("conv_id", "call_id").distinct()
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("before")).where("before IS NOT NULL")
    waits = written(edges.join(known.withColumnRenamed("call_id", "before"), ["conv_id", "before"], "left_semi")
                    .distinct().select("conv_id", "call_id", "before"))
    heads = known.join(waits, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("bigint"))
    number = waits.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("before"))
    chained, several = number.where("n = 1"), written(number.where("n > 1").select("conv_id", "call_id"))

    # (conv_id, call_id, head, far): ``far`` steps back from the call stands ``head``
    far = written(chained.select("conv_id", "call_id", F.col("before").alias("head"), F.lit(1).cast("bigint").alias("far")))
    longest = far.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < longest:
        onward = far.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"))
        far = written(far.join(onward, ["conv_id", "head"], "left").select(
            "conv_id", "call_id", F.coalesce("next", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
        reach *= 2
    # a head that is itself of a chain stands in a cycle
    far = far.join(chained.select("conv_id", F.col("call_id").alias("head")), ["conv_id", "head"], "left_anti")

    done = heads
    if not several.isEmpty():
        done, open_ = written(heads), several
        ends = far.select("conv_id", F.col("call_id").alias("before"), "head", "far").union(
            heads.select("conv_id", "call_id", "call_id", F.lit(0)).union(several.select("conv_id", "call_id", "call_id", F.lit(0))))
        paths = written(waits.join(several, ["conv_id", "call_id"], "left_semi").join(ends, ["conv_id", "before"], "left"))
        while not open_.isEmpty():
            known_heads = done.select("conv_id", F.col("call_id").alias("head"), "level")
            found = paths.join(open_, ["conv_id", "call_id"], "left_semi").join(known_heads, ["conv_id", "head"], "left")
            ready = written(found.groupBy("conv_id", "call_id").agg(
                F.max(F.col("level") + F.col("far") + 1).alias("level"), F.every(F.col("level").isNotNull()).alias("all")).where("all").drop("all"))
            if ready.isEmpty():
                break  # what is left waits for itself
            done = written(done.union(ready))
            open_ = written(open_.join(ready, ["conv_id", "call_id"], "left_anti"))
    behind = far.join(done.select("conv_id", F.col("call_id").alias("head"), "level"), ["conv_id", "head"])
    return done.union(behind.select("conv_id", "call_id", F.col("level") + F.col("far")))


def valid(name: Column, arguments: Column, schemas: dict) -> Column:
    """Whether arguments (JSON text) fit the schema of the tool ``name``."""
    parsed = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array(F.lit("\0")))
    out = F.lit(False)
    for tool, parameters in schemas.items():
        known = F.array(*[F.lit(p) for p in parameters]).cast("array<string>") if parameters else F.array().cast("array<string>")
        fits = F.size(F.array_except(keys, known)) == 0
        for parameter, (kind, required, *most) in parameters.items():
            found = F.schema_of_variant(F.try_variant_get(parsed, f"$.{parameter}", "variant"))
            fits = fits & F.coalesce(found == kind, F.lit(not required) & ~F.array_contains(keys, parameter))
            for n in most:
                fits = fits & (F.coalesce(F.char_length(F.try_variant_get(parsed, f"$.{parameter}", "string")), F.lit(0)) <= n)
        out = F.when(name == tool, fits).otherwise(out)
    return F.coalesce(parsed.isNotNull() & out, F.lit(False))


def canonical(arguments: Column) -> Column:
    """JSON text with its keys in order and no white space; null if it is no
    JSON."""
    return F.to_json(F.try_parse_json(arguments))


def link(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One record per call and per result without one: (conv_id, call_id,
    name, call_turn, result_turn, status, level, valid, json)."""
    schemas = SCHEMAS if schemas is None else schemas
    calls, results = events(messages)
    calls, results = _numbered(calls), _numbered(results)
    sides = calls.withColumnRenamed("turn", "call_turn").join(
        results.withColumnRenamed("turn", "result_turn"), ["conv_id", "call_id", "nth"], "full_outer")
    # what is not the first of its id may have met by chance of its number
    extra = F.coalesce(F.col("nth") > 1, F.lit(False))
    status = (F.when(extra, "repeated").when(F.col("name").isNull() & F.col("call_turn").isNull() & F.col("arguments").isNull(), "orphan")
              .when(F.col("content").isNull(), "unanswered").otherwise("linked"))
    placed = sides.join(levels(calls), ["conv_id", "call_id"], "left")
    # keys in order; the arguments go in as JSON, not as a text
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")),
        F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), _quoted(F.col("name")),
        F.lit(',"result":'), _quoted(F.col("content")), F.lit("}"))
    return placed.select("conv_id", "call_id", "name", "call_turn", "result_turn", status.alias("status"), "level",
                         valid(F.col("name"), F.col("arguments"), schemas).alias("valid"), body.alias("json"))


def _quoted(text: Column) -> Column:
    """A JSON string, or null: what to_json writes behind the only key."""
    written_ = F.to_json(F.struct(text.alias("s")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(written_, F.lit(6), F.char_length(written_) - 6))


#: DuckDB twin for tables whose messages are plain turns. A call's level is
#: its place in its run of user turns two apart.
ORACLE_SQL = f"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM m WHERE role = 'user'),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM m WHERE role = 'assistant'),
runs AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run
    FROM (SELECT DISTINCT conv_id, turn FROM c WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS level FROM runs),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn - 1) AS asked, c.turn AS call_turn, r.turn AS result_turn,
    coalesce(c.nth, r.nth) AS nth, c.text AS prompt, r.text AS answer
    FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn - 1 AND c.nth = r.nth)
SELECT j.conv_id, 'turn-' || asked AS call_id, CASE WHEN call_turn IS NOT NULL THEN 'reply' END AS name, call_turn, result_turn,
    CASE WHEN nth > 1 THEN 'repeated' WHEN call_turn IS NULL THEN 'orphan' WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    l.level, call_turn IS NOT NULL AND length(prompt) <= {PROMPT_MOST} AS valid,
    '{{"arguments":' || CASE WHEN call_turn IS NOT NULL THEN json_object('prompt', prompt)::VARCHAR ELSE 'null' END
    || ',"id":"turn-' || asked || '","name":' || CASE WHEN call_turn IS NOT NULL THEN '"reply"' ELSE 'null' END
    || ',"result":' || CASE WHEN result_turn IS NOT NULL THEN to_json(answer)::VARCHAR ELSE 'null' END || '}}' AS json
FROM j LEFT JOIN l ON j.conv_id = l.conv_id AND j.asked = l.turn
"""
