"""HTML extraction: the maximum-scoring run of a page's tokens.

A page is a sequence of tokens: runs of words, which score positive, and tags, which score negative. The main
content is the contiguous run with the largest sum, found in one linear scan. Weights come from labelled pages, those
that mark their own content with an ``article`` element: a tag costs the more, the more often it stands outside of
articles rather than inside (log-odds), in units of the words that such text holds on average. ``FIT_PAGES`` such pages
are read at most, those with the smallest hash of their id; Spark counts their tags and scores all pages.

The words of an element's class, id and role are tokens, too, in front of its tag: those that labelled pages hold outside of
articles cost what a tag there does, others nothing. Elements that hold no article text whatever stands around them (scripts, forms,
menus) are taken out before the scan, and stand as one cheap tag each. So are elements named as adverts, notices, comments and the
like (``speaks``), of whatever length, since a contiguous run can't leave them out; but not one that holds the page's first article.
Tags that HTML lets out (of p, li, td and the like) end where the next ones say so.

Text: character references are decoded, white space inside a block becomes one space, blocks (split by block tags
and ``br``) are trimmed and joined by one newline, empty ones dropped. An inline element that is taken out (``svg``, ``button``)
doesn't end its block.

Defined results: a null or empty page, or one without words, gives an empty text; of runs with equal sums the first,
and of those the shortest, wins; unclosed elements end with the page; other
columns stay, but for ``text`` and ``n_chars``, which are replaced; repeated rows stay; an empty table gives an empty one; without
any labelled page a tag costs as much as a word gains.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIT_PAGES = 1000

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_LABEL = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: What the last telling word of a class, id or role says of its element: junk, junk unless inside of content, or content.
_JUNK = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter "
    "subscribe signup login comment comments disqus reply replies respond discussion menu menus nav navbar navigation breadcrumb breadcrumbs sidebar side widget widgets related recommended share sharing "
    "social footer header masthead topbar toolbar pagination pager complementary contentinfo byline".split()
)
_JUNK_OUTSIDE = set("search copyright legal disclaimer tags".split())
_CONTENT = set("article content entry main page post story text".split())
#: Words that say nothing, so that the word before them tells.
_PLAIN = set("area articles bar block body box button buttons column container content form group inner item items links list news panel posts section slot stories text thread title unit wrap wrapper".split())
#: A name with one of these tells how the element looks or what it lies beside.
_STATE = set("by disabled enabled has is no not with without".split())


def speaks(label: str) -> tuple[int, bool]:
    """-1 if a class, id or role names its element as no part of an article, 1 as one, else 0; whether -1 only counts outside of content."""
    words = [w.lower() for w in _SPLIT.split(label) if w]
    if not words or _STATE.intersection(words):
        return 0, False
    head = next((w for w in reversed(words) if w not in _PLAIN), words[-1])
    if head == "header" and _CONTENT.intersection(words):
        return 0, False
    if head in _JUNK:
        return -1, False
    return (-1, True) if head in _JUNK_OUTSIDE else (int(head in _CONTENT), False)


#: Elements whose content is not markup, up to their end tag.
_RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
#: Elements that are never article text.
_DROP = {"head", "nav", "footer", "aside", "form", "noscript", "template", "svg", "math", "canvas", "object", "select", "button", "dialog", "menu", "audio", "video", *_RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in _RAW}
#: What a start tag ends though no end tag is written: names, and the elements that it doesn't reach out of.
_TABLE = {"table"}
_ENDS: dict[str, tuple[set[str], set[str]]] = {
    "li": ({"li"}, _BLOCK - {"li", "div", "p", "address"}), **dict.fromkeys(("dd", "dt"), ({"dd", "dt"}, _BLOCK - {"dd", "dt", "div", "p", "address"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", *_TABLE})), "tr": ({"tr"}, _TABLE), **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr"}, _TABLE)),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
}
_P_ENDS = _BLOCK - {"br", "body", "html", "head", "title", "legend", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
DROPPED, DROPPED_INLINE = "dropped", "dropped inline"


def tokens(page: str) -> list[tuple[str | None, str]]:
    """(tag, text) in page order: tag is a name, "/name", "@word" of a class, id or role before its element, DROPPED or DROPPED_INLINE
    for an element taken out; None for a run of text."""
    out: list[tuple[str | None, str]] = []
    at, skip, depth, articles = 0, None, 0, 0
    # open elements, with their place in out if they are marked and whether they are content, how many of a name are open, and
    # where marked ones lie
    stack: list[tuple[str, int | None, bool]] = []
    is_open: Counter = Counter()
    marked: list[tuple[int, int, bool]] = []
    content, first = 0, -1

    def close(n: int) -> None:
        nonlocal content
        while len(stack) > n:
            tag, start, holds = stack.pop()
            is_open[tag] -= 1
            content -= holds
            # what holds the page's first article is no such block, whatever its name
            if start is not None and not start < first < len(out):
                marked.append((start, len(out), tag in _BLOCK))

    def end_before(names: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return close(k)
            if stack[k][0] in stop:
                return

    while True:
        m = _MARKUP.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and skip is None:
            out.append((None, text))
        if not m:
            close(0)
            return without(out, marked)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if skip is not None:
            # inside an element that is taken out only its own name counts
            if name == skip:
                depth += -1 if closing else not m[3].endswith("/")
                if not depth:
                    skip = None
            elif name in _RAW and not closing:
                at = _RAW_END[name].search(page, at).end()
            elif closing and name in ("body", "html"):
                skip = None
            continue
        if name == "article":
            articles = max(0, articles + (-1 if closing else 1))
        if closing:
            at_end = 0 if name in ("body", "html") else len(stack)
            if at_end and is_open[name]:
                at_end -= 1
                while stack[at_end][0] != name:
                    at_end -= 1
                close(at_end + 1)
            elif not at_end:
                close(0)
            out.append(("/" + name, ""))
            close(at_end)
            continue
        if name in _ENDS and any(is_open[x] for x in _ENDS[name][0]):
            end_before(*_ENDS[name])
        if name in _P_ENDS and is_open["p"]:
            end_before({"p"}, _BLOCK - {"p"})
        if name in _VOID or m[3].endswith("/"):
            out.append((name, ""))
            continue
        if name in _RAW:
            at = _RAW_END[name].search(page, at).end()
            out.append((DROPPED if name in _BLOCK else DROPPED_INLINE, ""))
            continue
        if name in _DROP or name == "header" and not articles:
            out.append((DROPPED if name in _BLOCK else DROPPED_INLINE, ""))
            skip, depth = name, 1
            continue
        labels = " ".join(a or b or c for a, b, c in _LABEL.findall(m[3])).split()
        says = [-1 if v < 0 and not (weak and content) else max(v, 0) for v, weak in map(speaks, labels)]
        marks = name not in ("html", "body", "main") and sum(says) < 0
        if name == "article" and first < 0 and not marks:
            first = len(out) + 1
        holds = name in ("article", "main") and not marks or sum(says) > 0
        stack.append((name, len(out) if marks else None, holds))
        is_open[name] += 1
        content += holds
        out += [("@" + w.lower(), "") for x in labels for w in _SPLIT.split(x) if w]
        out.append((name, ""))


def without(seq: list[tuple[str | None, str]], marked: list[tuple[int, int, bool]]) -> list[tuple[str | None, str]]:
    """The tokens with each marked run (start, end, whether it is a block) as one DROPPED or DROPPED_INLINE."""
    out, at = [], 0
    for a, b, block in sorted(marked, key=lambda x: (x[0], -x[1])):
        if a >= at:
            out += seq[at:a]
            out.append((DROPPED if block else DROPPED_INLINE, ""))
            at = b
    return out + seq[at:]


def count_tags(page: str) -> Counter:
    """Tags inside and outside the page's first article, and words and runs of words of both: {(tag, inside): n}."""
    counts: Counter = Counter()
    inside = False
    for tag, text in tokens(page):
        if tag is None:
            if n := len(text.split()):
                counts["", inside] += n
                counts["run", inside] += 1
            continue
        # the element's own tags stand outside of the content
        if tag == "/article":
            inside = False
        counts[f"<{tag}", inside] += 1
        if tag == "article":
            inside = True
    return counts


def weigh(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Score of a word ("") and of each tag; "<" for tags that the labelled pages don't have."""
    total = {side: sum(n for (k, s), n in counts.items() if k[:1] == "<" and k[:2] != "<@" and s == side) for side in (True, False)}
    if not total[True]:
        return {"": 1.0, "<": -1.0, "<" + DROPPED: -0.5, "<" + DROPPED_INLINE: -0.5}
    run = max(3.0, counts.get(("", False), 0) / max(1, counts.get(("run", False), 0)))
    # of tags that no labelled page has nothing is known: they cost what those of articles do
    out = {"": 1.0, "<": -0.1}
    for tag in {k for k, _ in counts if k[:1] == "<"}:
        odds = math.log((counts.get((tag, True), 0) + 0.5) / (total[True] + 1)) - math.log((counts.get((tag, False), 0) + 0.5) / (total[False] + 1))
        out[tag] = -0.1 if odds > 0 else -max(0.25, min(8.0, -odds) * run)
    # what is taken out gives no text, so that it may lie inside of an article of few words, too
    out["<" + DROPPED] = out["<" + DROPPED_INLINE] = -0.5
    return out


def score(token: tuple[str | None, str], weights: dict[str, float]) -> float:
    """Words by their number, tags by their weight; words of labels that no labelled page has say nothing."""
    tag, text = token
    return weights[""] * len(text.split()) if tag is None else weights.get("<" + tag, 0.0 if tag[0] == "@" else weights["<"])


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum; (0, 0) if no sum is positive."""
    best, here, start, found = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if here <= 0:
            here, start = 0.0, k
        here += s
        if here > best:
            best, found = here, (start, k + 1)
    return found


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    seq = tokens(page)
    a, b = best_run([score(t, weights) for t in seq])
    blocks, here = [], []
    for tag, text in seq[a:b]:
        if tag is None:
            here.append(text)
        elif tag == DROPPED or tag.lstrip("/") in _BLOCK:
            blocks.append("".join(here))
            here = []
    blocks.append("".join(here))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def fit_weights(pages: DataFrame, fit_pages: int = FIT_PAGES, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights from the pages that hold an article element."""
    labelled = pages.filter(F.lower(html_col).contains("<article")).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(fit_pages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total.update(count_tags(page or ""))
            yield pa.record_batch([pa.array([k for k, _ in total], pa.string()), pa.array([s for _, s in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["tag", "inside", "n"])

    picked = pages.select(id_col, html_col).join(F.broadcast(labelled), id_col).filter(F.lower(html_col).contains("<article")).select(html_col)
    summed = picked.mapInArrow(count, "tag string, inside boolean, n long").groupBy("tag", "inside").agg(F.sum("n").alias("n"))
    return weigh({(r.tag, r.inside): r.n for r in summed.collect()})  # the tags of at most fit_pages pages


def extract_text(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """Adds text (string) and n_chars (long) to the pages."""
    pages = pages.drop("text", "n_chars")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(batch.schema.get_field_index(html_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

    return pages.mapInArrow(extract, T.StructType([*pages.schema, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages, fit_weights(pages)).select("page_id", "url", "text", "n_chars")
