import collections
import hashlib
import json
import random
import re

import duckdb
import pytest

from probengine.llm import chat, pages, pii, quality, queries
from tests_llm_helpers import LONG, by_id, documents, save

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


CLEAN = [" ".join(f"{random.Random(i * 100 + j).choice(['river', 'house', 'green', 'walk'])}{random.Random(i * 999 + j).randrange(99)}"
                  for j in range(80)) + ".\nAnother line stands here." for i in range(60)]
JUNK = (["BUY NOW!! " * 3 + " ".join(f"CLICK{j}!!" for j in range(30)) for _ in range(5)]
        + [" ".join(f"w{j}### x{j}$$$" for j in range(60)) for _ in range(6)] + ["spam " * 60] * 3)
EDGE = ["", None, "a", "\n\n", "x y\nx y\nx y", "a b c d e a b c d e", LONG, "é\x85ü\xa0ö one two", "a  b\tc\x0bd\x0ce\rf"]


def test_quality_counts_and_verdicts(spark, tmp_path):
    texts = CLEAN + JUNK + EDGE
    sf = save(spark, tmp_path, documents=documents(spark, texts).selectExpr("*", "1 AS stats", "2 AS kept"))
    got = by_id(queries.QUERIES["op3_quality"](spark, sf))
    for i, t in enumerate(texts, 1):
        r, want = got[i], base_counts(t or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, repr(t)[:80]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert all(got[i]["kept"] for i in range(1, len(CLEAN) + 1))
    assert not any(got[i]["kept"] for i in range(len(CLEAN) + 1, len(CLEAN) + len(JUNK) + 1))


def test_quality_against_labels(spark):
    """On the labelled documents: clean ones stay, most bad ones go."""
    sf = "/root/testdata/sf0.01"
    got = by_id(queries.QUERIES["op3_quality"](spark, sf))
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    good = [got[d] for d, q in labels if q and not got[d]["base_failed"]]
    bad = [got[d] for d, q in labels if not q]
    assert all(r["kept"] for r in good)
    assert sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def test_quality_runs_no_python(spark):
    plan = quality.with_votes(quality.with_stats(documents(spark, ["a"]).select("text")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                    "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), list(PATTERNS).index(kind), kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_base_spans_equal_the_plain_patterns(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice("a1.@2 -+é()0") for _ in range(rng.randrange(50))) for _ in range(1500)]
    texts += ["mail a.b@c.d.e, ip 1.2.3.4.5 and 300.1.1.1, card 4111 1111 1111 1111, call +1 (212) 555-0100", None, "", LONG + " x@y.zz",
              "9" * 50_000 + "a@" * 20_000, "é 🙂 +44 20 7946 0958", "000255.0000.1.2"]
    sf = save(spark, tmp_path, documents=documents(spark, texts).selectExpr("*", "1 AS spans"))
    got = by_id(queries.QUERIES["op6_personal_data"](spark, sf))
    for i, t in enumerate(texts, 1):
        want = plain_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), repr(t)[:100]
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k + ":") for s in want) for k in PATTERNS]
        assert set(want) <= set(got[i]["spans"].split(","))


def test_checksums_and_context():
    kinds = lambda t: [s["kind"] for s in pii.find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00.") == []
    assert kinds("GB82WEST12345698765432") == ["iban"]
    assert kinds("ssn 123-45-6789") == ["national_id"] and kinds("part 123-45-6789") == []
    near, far = (pii.find_spans(t)[0]["score"] for t in ("credit card 4111111111111111", "4111111111111111"))
    against = pii.find_spans("order 4111111111111111")[0]["score"]
    assert near > far > against


@pytest.mark.parametrize("iban", ["BE68 5390 0754 7034", "BE68539007547034", "AT611904300234573201", "AT61 1904 3002 3457 3201",
                                  "ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "NO9386011117947"])
@pytest.mark.parametrize("behind", [" BIC GKCCBEBB", " EUR 500", " 2024", " BANK GIRO 12", " BE68 5390 0754 7034", ""])
def test_ibans_end_before_the_words_behind(iban, behind):
    text = f"to {iban}{behind}"
    found = [text[s["start"]:s["end"]] for s in pii.find_spans(text) if s["kind"] == "iban"]
    assert found == [iban] + [behind.strip()] * behind.startswith(" BE")
    assert pii.masked(text, [s for s in pii.find_spans(text) if s["kind"] == "iban"]).startswith("to [IBAN]")


def test_an_iban_behind_what_looks_like_one():
    text = "ref AB12 CDEF 3456 BE68 5390 0754 7034 BIC"
    assert [text[s["start"]:s["end"]] for s in pii.find_spans(text) if s["kind"] == "iban"] == ["BE68 5390 0754 7034"]
    assert not [s for s in pii.find_spans("AT611904300234573202 EUR 500") if s["kind"] == "iban"]


def test_masking(spark):
    df = documents(spark, ["to a@b.co or 4111111111111111!", None, "", "clean 12 text"])
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["to [EMAIL] or [CARD]!", None, "", "clean 12 text"]


PAGE = ('<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><h2>Site</h2></header>'
        '<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="ad-slot">Buy this</div>'
        '<div id="cookie-notice">We use cookies</div>%s<aside>More</aside><section class="comments"><p>First! Nice one.</p></section>'
        '<form><label>Name</label><input name="n"></form><footer>&copy; us</footer></body></html>')
BODY = "<h1>Head &amp; more</h1><p>First   line<br>goes\non.<p>Second <b>bold</b> &lt;here&gt; &#233;</p><ul><li>item one</li></ul><p>End.</p>"
TEXT = "Head & more\n\nFirst line goes on.\n\nSecond bold <here> é\n\nitem one\n\nEnd."


def test_main_text(spark, tmp_path):
    texts = [PAGE % f"<article>{BODY}</article>", PAGE % f'<main class="widget">{BODY}</main>', None, "", "<p>", "no tags at all",
             "<p>a < b and c</p>", PAGE % ("<article>" + "<p>word</p>" * 20_000 + "</article>"), "<article><p>cut off", "<div hidden>x</div><p>y z</p>",
             '<article><p>Text.</p><div class="ad">unclosed advert</article><p>outside', "<article>t<article class='comment'>c</article></article>"]
    rows = spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(texts)], "page_id bigint, url string, html string")
    sf = save(spark, tmp_path, pages=rows.selectExpr("*", "1 AS text", "2 AS n_chars"))
    got = by_id(queries.QUERIES["op4_main_text"](spark, sf), "page_id")
    want = [TEXT, TEXT, "", "", "", "no tags at all", "a < b and c", "\n\n".join(["word"] * 20_000), "cut off", "y z", "Text.", "t"]
    assert [got[i]["text"] for i in range(len(texts))] == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_region_of_unmarked_pages():
    """Weights learned on marked pages find the text where nothing is marked."""
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    counts = collections.Counter()
    for (h,) in rows:
        counts.update(pages.count_kinds(h))
    weight = pages.weights(counts)
    bare = lambda h: re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", h).replace(' class="ad"', "")
    same = sum(pages.main_text(bare(h), weight) == pages.main_text(h, weight) for (h,) in rows)
    assert same >= 0.95 * len(rows)
    assert pages.main_text("<p>some words</p>", pages.weights({})) == "some words"


def learned():
    counts = collections.Counter()
    for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        counts.update(pages.count_kinds(h))
    return pages.weights(counts)


@pytest.mark.parametrize("weight", [pages.weights({}), learned()], ids=["none", "learned"])
def test_every_page_is_scanned_whole(weight):
    long = " ".join(f"word{i}" for i in range(60))
    teaser = f"<article><h2>Teaser</h2><p>Read this too.</p></article><div><p>{long}</p><p>{long}</p></div>"
    assert pages.main_text(PAGE % teaser, weight).endswith(f"{long}\n\n{long}")
    # siblings, short or long, side by side or each in a part of its own
    for first, second in (("one two", "three"), ("one", "two three"), (long, "end"), ("start", long)):
        want = f"{first}\n\n{second}"
        one, two = f"<article><p>{first}</p></article>", f"<article><p>{second}</p></article>"
        assert pages.main_text(PAGE % (one + "\n" + two), weight) == want
        assert pages.main_text(PAGE % f"<div>{one}</div>\n<div>{two}</div>", weight) == want


def test_ids_made_from_titles_drop_nothing():
    weight = learned()
    for name in ("related-work", "search-algorithms", "social-history", "share", "comment", "menu", "alert", "notice", "banner", "navigation"):
        kept = f'<h2 id="{name}">Title</h2><section id="{name}"><p>Its text.</p></section><p class="{name}-of-kings">End.</p>'
        assert pages.main_text(PAGE % f"<article>{kept}</article>", weight) == "Title\n\nIts text.\n\nEnd."
    for name in ("ad", "ad-slot", "ad_slot-2", "big share-buttons", "related-posts", "comments-area", "cookie-notice", "newsletter"):
        left = f'<div class="{name}">No</div><section class="{name}">No</section><div id="{name}">No</div>'
        assert pages.main_text(PAGE % f"<article><p>Text.</p>{left}<p>End.</p></article>", weight) == "Text.\n\nEnd."


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_tool_calls_are_linked_levelled_and_validated(spark):
    calls = json.dumps({"tool_calls": [
        {"id": "b", "name": "add", "arguments": {"y": 2, "x": 1}, "after": ["a"]}, {"id": "a", "name": "add", "arguments": {"x": 1, "y": "2"}},
        {"id": "c", "name": "add", "arguments": {"x": 1}, "after": ["d"]}, {"id": "d", "name": "nope", "arguments": {}, "after": ["c", "zz"]},
        {"id": "e", "name": "add", "arguments": {"x": 1, "y": 2, "q": None}, "after": ["b", "gone"]}]})
    rows = [(1, 0, "system", "s"), (1, 1, "assistant", calls), (1, 2, "tool", '{"tool_call_id":"a","content":"A \\"q\\"\\n"}'),
            (1, 3, "tool", '{"tool_call_id":"b","content":"B"}'), (1, 4, "tool", '{"tool_call_id":"b","content":"again"}'),
            (1, 5, "tool", '{"tool_call_id":"lost","content":"L"}'), (1, 6, "user", "{no json"), (1, 7, "assistant", "ok"),
            (2, 0, "user", None), (None, 0, "user", "x"), (2, None, "assistant", "y")]
    schemas = {"add": {"x": ("BIGINT", True), "y": ("BIGINT", True)}, **chat.SCHEMAS}
    got = {(r.conv_id, r.call_id, r.status): r for r in chat.link(messages(spark, rows), schemas).collect()}
    brief = {k: (r.level, r.valid) for k, r in got.items()}
    assert brief == {
        (1, "a", "linked"): (0, False), (1, "b", "linked"): (1, True), (1, "c", "unanswered"): (None, False), (1, "d", "unanswered"): (None, False),
        (1, "e", "unanswered"): (2, False), (1, "b", "repeated"): (1, False), (1, "lost", "orphan"): (None, False), (1, "turn-6", "linked"): (0, True),
        (2, "turn-0", "unanswered"): (0, True), (None, "turn-0", "unanswered"): (None, True), (2, None, "orphan"): (None, False)}
    assert got[1, "b", "linked"].json == '{"arguments":{"x":1,"y":2},"id":"b","name":"add","result":"B"}'
    assert json.loads(got[1, "a", "linked"].json)["result"] == 'A "q"\n'


def test_plain_turns_wait_for_the_turn_they_follow(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], "x" * (t * 10)) for t in range(61) if t != 20]     # two chains: 0-18, 22-60
    rows += [(1, 62, "user", "again"), (1, 62, "user", "again"), (1, 63, "assistant", "z"), (2, 3, "user", "y" * 256), (2, 5, "user", "y" * 257)]
    got = {(r.conv_id, r.call_id): r for r in chat.link(messages(spark, rows)).collect() if r.call_turn is not None}
    want = {(1, f"turn-{t}"): (t // 2 if t < 20 else (t - 22) // 2, t == 62 or t * 10 <= 256) for t in range(0, 63, 2) if t != 20}
    want |= {(2, "turn-3"): (0, True), (2, "turn-5"): (1, False)}
    assert {k: (r.level, r.valid) for k, r in got.items()} == want


def test_levels_equal_the_longest_paths(spark):
    """Random graphs with chains, meets, cycles and unknown ids, against
    plain rounds."""
    rng, rows, want = random.Random(4), [], {}
    for conv in range(12):
        n = 14
        after = {i: [f"c{j}" for j in rng.sample(range(n + 2), rng.choice((0, 1, 1, 1, 2, 3))) if j < i or j >= n or rng.random() < 0.08] for i in range(n)}
        level, left = {}, dict(after)
        while True:
            ready = {i: 1 + max((level[int(b[1:])] for b in bs if int(b[1:]) < n), default=-1)
                     for i, bs in left.items() if all(int(b[1:]) in level or int(b[1:]) >= n for b in bs)}
            if not ready:
                break
            level |= ready
            left = {i: bs for i, bs in left.items() if i not in ready}
        rows += [(conv, i, f"c{i}", "t", "{}", bs) for i, bs in after.items()]
        want |= {(conv, f"c{i}"): v for i, v in level.items()}
    assert 0 < len(want) < len(rows)
    calls = spark.createDataFrame(rows, "conv_id bigint, turn bigint, call_id string, name string, arguments string, after array<string>")
    got = chat.levels(calls).collect()
    assert len(got) == len(want) and {(r.conv_id, r.call_id): r.level for r in got} == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(chat, "written", lambda df, keep=chat.written: tables.append(1) or keep(df))
    calls = spark.range(1000).selectExpr("1L AS conv_id", "id AS turn", "concat('c', id) AS call_id", "array(concat('c', id - 1)) AS after")
    got = {r.call_id: r.level for r in chat.levels(calls).collect()}
    assert got == {f"c{i}": i for i in range(1000)} and len(tables) < 16


def test_tool_calls_of_very_long_texts_and_extra_columns(spark):
    rows = [(1, 0, "user", "a" * 200_000, "p", 1), (1, 1, "assistant", "b" * 200_000, "q", 2)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, level string, nth bigint")
    one, = chat.link(df).collect()
    assert (one.status, one.level, one.valid) == ("linked", 0, False) and json.loads(one.json)["result"] == "b" * 200_000


def test_tool_calls_of_an_empty_table(spark):
    assert chat.link(messages(spark, [])).count() == 0


def test_tool_calls_run_no_python(spark):
    plan = chat.link(messages(spark, [(1, 0, "user", "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("name", ["op3_quality", "op5_tool_calls"])
def test_native_queries_are_registered_with_sql(name):
    assert name in queries.ORACLE_SQL


def test_a_quote_opens_a_value_only_behind_an_equals_sign():
    weight = pages.weights({})
    assert pages.main_text('<article><p align=center">Hello there friend of mine</p><p>More text of the story</p></article>', weight) == (
        "Hello there friend of mine\n\nMore text of the story")
    assert pages.main_text("<p title=don't>One two three</p><p>It's four five</p>", weight) == "One two three\n\nIt's four five"
    assert pages.main_text('<p title="a>b" class = \'c>d\'>One two three</p><p title="never closed>four five six</p>', weight) == "One two three\n\nfour five six"


@pytest.mark.parametrize("name", ["user-comment", "post-comments", "site-notice-bar", "reader_comments list", "home-advert"])
def test_containers_whose_class_ends_in_a_known_word_go(name):
    weight = pages.weights({})
    inner = f'<div class="{name}"><p>nice post</p></div>'
    assert pages.main_text(f"<article><p>One two three.</p>{inner}<p>Four five.</p></article>", weight) == "One two three.\n\nFour five."
    assert pages.main_text(f"<article><p>One two three.</p></article>{inner}", weight) == "One two three."


def test_containers_and_sections_that_speak_of_such_words_stay():
    weight = pages.weights({})
    page = ('<article><div class="comment-theory">Kept one here.</div><section class="climate-notice"><p>Kept two here.</p></section>'
            '<h2 class="on-comments">Kept three</h2></article>')
    assert pages.main_text(page, weight) == "Kept one here.\n\nKept two here.\n\nKept three"


def test_the_scan_finds_the_best_of_all_runs():
    """Against the sums of all contiguous runs of tokens."""
    rng = random.Random(11)
    for _ in range(300):
        weight = {k: -rng.random() * 3 for k in ("p", "/p", "a", "/a", "li", "/li")} | {"word": rng.random() + 0.1, "unseen": -1.0}
        parts = [rng.choice(["<p>", "</p>", "<a href=x>", "</a>", "<li>", "</li>", " w%d x " % i, " y%d " % i]) for i in range(rng.randrange(1, 25))]
        found = [t for t in pages.tokens("".join(parts)) if not t[3]]
        score = [weight["word"] * len(t.split()) if k == "word" else weight[k] for k, t, *_ in found]
        best = max((sum(score[i:j]) for i in range(len(found)) for j in range(i + 1, len(found) + 1)), default=0.0)
        words = [w for i in range(len(found)) for j in range(i + 1, len(found) + 1) if abs(sum(score[i:j]) - best) < 1e-9
                 for w in [" ".join(" ".join(t for k, t, *_ in found[i:j] if k == "word").split())]]
        got = " ".join(pages.main_text("".join(parts), weight).split())
        assert got in words if best > 1e-9 else got == ""


def test_empty_table_of_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert queries.QUERIES["op4_main_text"](spark, save(spark, tmp_path, pages=none)).collect() == []
