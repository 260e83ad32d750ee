"""Document quality by weak supervision, in DataFrame functions only.

Nine rules look at one text each and vote good (1), bad (-1) or abstain (0).
No rule is trusted beforehand: expectation-maximisation estimates, for every
rule, how often it votes good on good documents and bad on bad ones, together
with the share of good documents. The posterior probability that a document
is good, given all its votes, decides, instead of a filter that all rules must
pass.

The votes of all documents are first counted by pattern. There are at most
``3 ** len(RULES)`` patterns whatever the input's size, so each step of the
expectation-maximisation is one aggregation of a small table and returns two
numbers a rule. The scores are then a column expression over the votes.

Null and empty texts have no words, fail the base rule and get the posterior
that their votes give. A text's windows are compared by a 64-bit hash of their
words; work is n log n in the text's words, without a limit. With no document
at all the first estimates stay. Repeated rows count as often as they occur.
Other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probengine.llm.common import written

#: The word separators of the contracts: blank, and tab to carriage return.
BLANK = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
STEPS = 25
#: First estimates: a good document seldom gets a bad vote; a bad one gets it
#: only from the rules for its kind of badness.
START_SHARE, START_GOOD, START_BAD = 0.8, 0.98, 0.4
#: Estimates stay inside LEAST to MOST, so that no single vote is final. Rules
#: are written to be right about good documents: GOOD_LEAST is what they are
#: trusted with, else the commonest kind of badness would pass for good.
LEAST, GOOD_LEAST, MOST = 0.01, 0.97, 0.995


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more: the windows are sorted
    by hash, equal neighbours kept, and the kept places, in order, each add
    the words that the one before has not covered."""
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))

    def starts(rows: Column) -> Column:
        kept = F.filter(rows, lambda r, k: same(r, F.get(rows, k - 1)) | same(r, F.get(rows, k + 1)))
        return F.sort_array(F.transform(kept, lambda r: r["i"]))

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # as the element of an array, the sorted windows are made once, not once a lookup
    covered = F.aggregate(
        F.element_at(F.transform(F.array(placed), starts), 1),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered)


def with_stats(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Add ``out``: a struct of the counts that the rules look at."""
    body = F.coalesce(F.col(text), F.lit(""))
    parts = df.withColumn("__words", F.array_remove(F.split(body, BLANK + "+"), ""))
    words = F.col("__words")
    windows = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, WINDOW)]))
    parts = parts.withColumn("__hashes", F.slice(windows, 1, F.greatest(F.size(words) - WINDOW + 1, F.lit(0))))
    parts = parts.withColumn("__lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(BLANK.replace("[", "[^"))))
    # one scan leaves the few characters that are counted
    parts = parts.withColumn("__marks", F.regexp_replace(body, f"[^{SYMBOLS}!A-Z]+", ""))
    marks = F.col("__marks")

    def count(chars: str) -> Column:
        return (F.char_length(marks) - F.char_length(F.translate(marks, chars, ""))).cast("bigint")

    return parts.withColumn(out, F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("__hashes")).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("bigint").alias("n_stutter"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        count("!").alias("n_bangs"),
    )).drop("__words", "__hashes", "__lines", "__marks")


#: Rule: (when it votes bad, when it votes good), over the struct's counts.
RULES = {
    "length": ("n_words < 10", "n_words >= 20"),
    "repeats": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    "symbol_words": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "symbol_chars": ("100 * n_symbols > 3 * word_chars", "n_symbols = 0"),
    "capitals": ("10 * n_upper > 4 * word_chars", "10 * n_upper <= word_chars"),
    "shouting": ("10 * n_bangs > 2 * n_words", "100 * n_bangs <= 2 * n_words"),
    "lines": ("n_dup_lines >= 3 AND 100 * n_dup_lines > 50 * n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 15 * n_words",
                    "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    "stutter": ("10 * n_stutter > 3 * n_words", "100 * n_stutter <= 5 * n_words"),
}


def with_votes(df: DataFrame, stats: str = "stats", out: str = "votes") -> DataFrame:
    """Add ``out``: a struct with each rule's vote (1, -1 or 0)."""
    counts = df.schema[stats].dataType.fieldNames()

    def vote(bad: str, good: str) -> Column:
        said = f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
        return F.expr(" ".join(f"`{stats}`.{w}" if w in counts else w for w in said.split()))

    return df.withColumn(out, F.struct(*[vote(*r).alias(n) for n, r in RULES.items()]))


def log_odds(votes: dict[str, Column], model: dict) -> Column:
    """Log odds of good against bad, given the votes."""
    total = F.lit(math.log(model["share"] / (1 - model["share"])))
    for name, vote in votes.items():
        good, bad = model["good"][name], model["bad"][name]
        total = total + F.when(vote == 1, F.lit(math.log(good / (1 - bad)))).when(
            vote == -1, F.lit(math.log((1 - good) / bad))).otherwise(F.lit(0.0))
    return total


def fit(votes: DataFrame, names: list[str], steps: int = STEPS) -> dict:
    """Share of good documents and each rule's accuracy on good and on bad
    ones, by expectation-maximisation over the counted vote patterns."""
    patterns = written(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    model = {"share": START_SHARE, "good": dict.fromkeys(names, START_GOOD), "bad": dict.fromkeys(names, START_BAD)}
    for _ in range(steps):
        good = F.col("n") / (1 + F.exp(-log_odds({c: F.col(c) for c in names}, model)))
        scored = patterns.select("*", good.alias("g"), (F.col("n") - good).alias("b"))
        sums = [F.sum("g").alias("g"), F.sum("b").alias("b")]
        for c in names:
            sums += [F.sum(F.when(F.col(c) != 0, F.col("g"))).alias(f"{c}_g"), F.sum(F.when(F.col(c) == 1, F.col("g"))).alias(f"{c}_gg"),
                     F.sum(F.when(F.col(c) != 0, F.col("b"))).alias(f"{c}_b"), F.sum(F.when(F.col(c) == -1, F.col("b"))).alias(f"{c}_bb")]
        s = scored.agg(*sums).first()
        if not s["g"]:
            break
        held = lambda x, least=LEAST: min(max(x, least), MOST)
        rate = lambda part, whole, before, least: held((part or 0.0) / whole, least) if whole else before
        model = {"share": held(s["g"] / (s["g"] + s["b"])),
                 "good": {c: rate(s[f"{c}_gg"], s[f"{c}_g"], model["good"][c], GOOD_LEAST) for c in names},
                 "bad": {c: rate(s[f"{c}_bb"], s[f"{c}_b"], model["bad"][c], LEAST) for c in names}}
    return model


def base_failed(stats: str = "stats") -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < 10) | (100 * F.col(f"{stats}.n_repeat_words") > 20 * n)


def judge(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``stats``, ``votes``, ``posterior`` and ``kept``: not failed by the
    base rule, and good with a probability of one half or more. The rows with
    their votes are written once, as both the fit and the result read them;
    without ``keep_text`` the text itself is left out."""
    seen = with_votes(with_stats(df, text))
    seen = written(seen if keep_text else seen.drop(text))
    names = list(RULES)
    model = fit(seen.select("votes.*"), names)
    odds = log_odds({c: F.col(f"votes.{c}") for c in names}, model)
    scored = seen.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~base_failed() & (F.col("posterior") >= 0.5))


def oracle_sql(steps: int = STEPS) -> str:
    """DuckDB twin of the registered query: windows unnested and counted, and
    the steps of the expectation-maximisation written out one by one."""
    names = list(RULES)
    blank = "[\\x20\\x09-\\x0D]"
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {n}" for n, (bad, good) in RULES.items())
    odds = "ln(share / (1 - share))" + "".join(
        f" + CASE {n} WHEN 1 THEN ln(good_{n} / (1 - bad_{n})) WHEN -1 THEN ln((1 - good_{n}) / bad_{n}) ELSE 0 END" for n in names)

    def held(part: str, whole: str, before: str, least: float) -> str:
        return f"CASE WHEN {whole} > 0 THEN least(greatest(coalesce({part}, 0) / {whole}, {least}), {MOST}) ELSE any_value({before}) END"

    chain = ["m0 AS (SELECT " + ", ".join([f"{START_SHARE}::DOUBLE AS share", *[f"{START_GOOD}::DOUBLE AS good_{n}, {START_BAD}::DOUBLE AS bad_{n}" for n in names]]) + ")"]
    for k in range(steps):
        rates = [f"{held('sum(g)', 'sum(g + b)', 'share', LEAST)} AS share"]
        for n in names:
            rates += [f"{held(f'sum(g) FILTER ({n} = 1)', f'sum(g) FILTER ({n} <> 0)', f'good_{n}', GOOD_LEAST)} AS good_{n}",
                      f"{held(f'sum(b) FILTER ({n} = -1)', f'sum(b) FILTER ({n} <> 0)', f'bad_{n}', LEAST)} AS bad_{n}"]
        chain.append(f"m{k + 1} AS MATERIALIZED (SELECT {', '.join(rates)} FROM (SELECT *, n / (1 + exp(-({odds}))) AS g, n - g AS b FROM patterns, m{k}))")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '{blank}+'), lambda x: x <> '') AS ws FROM d),
windows AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{blank.replace("[", "[^")}') GROUP BY r),
counts AS (SELECT d.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs
    FROM d JOIN w USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r)),
votes AS MATERIALIZED (SELECT *, {votes} FROM counts),
patterns AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM votes GROUP BY ALL),
{(","+chr(10)).join(chain)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept,
    round(1 / (1 + exp(-({odds}))), 6) AS posterior
FROM votes, m{steps}
"""
