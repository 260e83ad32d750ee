"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of tokens, runs of words and tags. Parts that are
boilerplate by their own markup (menus, footers, sidebars, forms, adverts,
notices, reader comments, scripts, styles, hidden parts) are left out. Every
word then scores above zero and every tag at most zero, and one linear scan
finds the contiguous run of tokens with the greatest sum: the content region,
as menus and lists of links have many tags for few words.

The weights come from labelled pages, those that mark their article: for each
kind of token, the log of how much more often it occurs inside than outside.
The counts are taken over all pages; only some seventy sums reach the driver.
Every page is scanned whole, whether it marks an article or not. A mark is one
more kind of token: a tag inside one costs nothing, nor do the tags between two
marks that have no word between them. Its end costs what its kind does.

White space inside a block becomes one blank, blocks are joined by two line
feeds, character references are decoded. A null or empty page, and one without
words, gives the empty text. Unclosed tags, a cut last tag and stray ends are
tolerated. Long pages take linear time. Extra columns pass through; a column
named like the output is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from probengine.llm.common import prepare, texts

# a quote opens a value only behind =, and only if it is closed; else the tag ends at the next >
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")

BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
                   "h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del em font i ins kbd label mark q s samp small span strike strong sub sup td th time "
                   "tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math"))
ARTICLE = frozenset(("article", "main"))
#: Elements that are no main text by their name.
DROPPED = RAW | frozenset("head nav footer aside form button select menu dialog canvas object audio video fieldset".split())
#: Words in names of class, id or role that say the same.
MARKS = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
                  "gdpr masthead menu nav navbar navigation newsletter notice notices alert pagination popup promo promoted related replies "
                  "respond share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget complementary contentinfo search".split())
_COMMENTS = frozenset(("comment", "comments", "disqus", "respond"))
#: Words that name such a part together with one of them, as in "ad-slot".
_LAYOUT = frozenset("area bar block bottom box btn button buttons container form icons inner item items left link links list panel posts "
                    "right section signup site slot thread top unit wrap wrapper".split())
#: Containers that say nothing themselves.
_PLAIN = frozenset("div ul ol li span".split())
#: Elements whose id is made from their title.
_TITLED = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def _named(value: str, marks: frozenset[str]) -> bool:
    """Whether a whole name in ``value`` says so: all its words are known and
    one is of ``marks``."""
    for name in value.split():
        words = [w for w in _SPLIT.split(name) if w and not w.isdigit()]
        if not marks.isdisjoint(words) and all(w in MARKS or w in _LAYOUT for w in words):
            return True
    return False


def _ends_in(value: str, marks: frozenset[str]) -> bool:
    """Whether a name in ``value`` ends in one of ``marks``, but for words of
    layout ("user-comment", "site-notice-bar", not "comment-theory")."""
    for name in value.split():
        words = [w for w in _SPLIT.split(name) if w and not w.isdigit()]
        while words and words[-1] in _LAYOUT and words[-1] not in marks:
            words.pop()
        if words and words[-1] in marks:
            return True
    return False


def _dropped(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body"):
        return False
    # the article itself may be called anything but reader comments
    marks = _COMMENTS if name in ARTICLE and not in_article else MARKS
    titled = name in _TITLED or (in_article and name == "section")
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
        if (key in ("class", "role") or (key == "id" and not titled)) and _named(value, marks):
            return True
        # classes of plain containers need only end in such a word; those of sections and headings may speak of it
        if key == "class" and name in _PLAIN and _ends_in(value, marks):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, text, in article, left out): kind is "word" for a text run, else
    the tag's name with a slash for an end."""
    at, article, drop, depth = 0, 0, "", 0
    size = len(page)
    while at < size:
        start = page.find("<", at)
        found = _TAG.match(page, start) if start >= 0 else None
        while start >= 0 and found is None:  # a bare < is text
            start = page.find("<", start + 1)
            found = _TAG.match(page, start) if start >= 0 else None
        end = start if start >= 0 else size
        if end > at:
            yield "word", page[at:end], article > 0, bool(drop)
        if found is None:
            return
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        closing = bool(found[1])
        if drop:
            # an article, a body or the end of what holds it ends an unclosed part
            if closing and name == drop:
                depth -= 1
            elif not closing and name == drop and not found[3].endswith("/"):
                depth += 1
            if depth == 0 or name in ("body", "html") or (name in ARTICLE and drop not in DROPPED):
                done = depth == 0
                drop, depth = "", 0
                if done:
                    yield ("/" if closing else "") + name, "", article > 0, True
                    continue
            else:
                yield ("/" if closing else "") + name, "", article > 0, True
                continue
        if closing:
            if name in ARTICLE:
                article = max(0, article - 1)
            yield "/" + name, "", article > 0, False
            continue
        if name not in VOID and not found[3].endswith("/") and _dropped(name, found[3], article > 0):
            yield name, "", article > 0, True
            if name in RAW:  # its text is no markup
                stop = re.compile(f"</{name}", re.I).search(page, at)
                at = stop.start() if stop else size
            drop, depth = name, 1
            continue
        if name in ARTICLE:
            article += 1
        yield name, "", article > 0, False


def _kind(kind: str) -> str:
    name = kind.lstrip("/")
    return kind if kind == "word" or name in BLOCKS or name in INLINE or name in VOID else "other"


def count_kinds(page: str) -> Counter:
    """How often each kind occurs inside and outside the article that a page
    marks; nothing for a page that marks none."""
    counts: Counter = Counter()
    for kind, text, inside, _ in tokens(page):
        counts[_kind(kind), inside] += len(text.split()) if kind == "word" else 1
    return counts if any(inside for _, inside in counts) else Counter()


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of each kind; words at least 0.1, tags at most 0. What no
    labelled page has seen costs as much as the dearest kind of word gives."""
    total = {side: sum(n for (_, s), n in counts.items() if s == side) + 1.0 for side in (True, False)}
    odds = {k: math.log((counts.get((k, True), 0) + 0.5) / total[True]) - math.log((counts.get((k, False), 0) + 0.5) / total[False])
            for k in {k for k, _ in counts}}
    word = max(odds.get("word", 1.0), 0.1)
    return {k: min(v, 0.0) for k, v in odds.items() if k != "word"} | {"word": word, "unseen": -word}


def _in_marks(found: list[tuple[str, str, bool, bool]]) -> list[bool]:
    """For each token whether it is inside a mark, or between two with no word
    between them."""
    out, last = [t[2] for t in found], -1
    for i, (kind, text, inside, _) in enumerate(found):
        if inside:
            if last >= 0:
                out[last + 1:i] = [True] * (i - last - 1)
            last = i
        elif kind == "word" and not text.isspace():
            last = -1
    return out


def main_text(page: str, weight: dict[str, float]) -> str:
    """The blocks of the greatest-scoring contiguous region."""
    found = [t for t in tokens(page) if not t[3]]
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, ((kind, text, _, _), marked) in enumerate(zip(found, _in_marks(found), strict=True)):
        if kind == "word":
            total += weight["word"] * len(text.split())
        elif not marked:
            total += weight.get(_kind(kind), weight["unseen"])
        if total < 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_at = total, (start, i + 1)
    blocks: list[list[str]] = [[]]
    for kind, text, _, _ in found[slice(*best_at)]:
        name = kind.lstrip("/")
        if kind == "word":
            blocks[-1].append(text)
        elif name in BLOCKS:
            blocks.append([])
        elif name in ("br", "td", "th"):
            blocks[-1].append(" ")
    said = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(b for b in said if b)


def learn_weights(df: DataFrame, page: str = "html") -> dict[str, float]:
    """Weights from all rows whose page marks its article."""
    prepare(df.sparkSession)

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for p in texts(batch.column(0)):
                counts.update(count_kinds(p))
            kinds = sorted(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kinds], pa.string()), pa.array([s for _, s in kinds], pa.bool_()),
                                              pa.array([counts[k] for k in kinds], pa.int64())], ["kind", "inside", "n"])

    sums = df.select(page).mapInArrow(run, "kind string, inside boolean, n bigint").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weights({(r["kind"], r["inside"]): r["n"] for r in sums.collect()})


def extract(df: DataFrame, weight: dict[str, float], page: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the main text of ``page``."""
    prepare(df.sparkSession)

    @arrow_udf(T.StringType())
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p, weight) for p in texts(column)], type=pa.string())

    return df.withColumn(out, text_of(F.col(page)))
