"""Main text of web pages by composite text density.

Every page becomes a DOM. Menus, forms, adverts, comments and the like go by element, role or class name; a form, or a
wrapper with such a name, stays if it holds the article. For each node left, characters per tag, adjusted for links, give its density; a node's density sum adds its children's. The
lowest density on the path from the body to the densest node is the threshold; the node of the largest density sum is
the content, widened to its ancestors below the body while they reach the threshold, and to its article element.

Defined cases: null and empty pages, and pages without text, give an empty string; repeated rows give equal rows; an
empty table gives an empty table; pages of any length are read whole, in time linear in their tags; of equal density sums
the first node counts; broken markup is closed where HTML closes it; extra columns are ignored.
"""
from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import table

_QUOTED = r"""(?:"[^"]*+"|'[^']*+'|[^'">])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|xmp|iframe|noembed|noframes|svg|math)(?=[\s/>])(?:{_QUOTED}>|[^>]*(?:>|\Z)).*?(?:</\1[^>]*>|\Z)|</([a-z][^\s>/]*)[^>]*(?:>|\Z)|<([a-z][^\s>/]*)({_QUOTED}>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)", re.IGNORECASE | re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GONE = frozenset("nav header footer aside button select option textarea dialog menu object embed template head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar".split())
_NAMES = frozenset("ad ads advert adverts advertisement adslot banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split())
_HEADS = frozenset("header head top".split())
_KEPT = frozenset("article content entry main post story text".split())
_COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: A class that starts or ends so tells what a page has or how it is laid out: has-sidebar, no-comments, comments-open.
_STATES, _STATES_LAST = frozenset("has with without no not is show hide".split()), frozenset("open closed enabled disabled".split())
#: A start tag closes these open elements, down to the nearest of the second set.
_ENDS = {t: ({"p"}, {"button", "table", "td", "th", "article", "section", "body"}) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()} | {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


def names_of(found: dict[str, str]) -> list[set[str]]:
    """The words of each class and id, without those that tell a state or layout."""
    split = [[x.lower() for x in _SPLIT.split(c)] for k in ("class", "id") for c in found.get(k, "").split()]
    return [set(w) for w in split if len(w) == 1 or w[0] not in _STATES and w[-1] not in _STATES_LAST]


def seen_as(tag: str, attributes: str) -> tuple[bool, str, bool]:
    """Whether an element is no part of an article by its element, role or style; whether its names say so ("" if not,
    "comments" or "other"); and whether it is named as an article."""
    if tag in _GONE:
        return True, "", False
    if tag == "form":  # goes as what has such a name; a form around the page or its article stays
        return False, "other", False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, "", tag in ("article", "main")
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")) or found.get("role", "").lower() in _ROLES:
        return True, "", False
    classes = names_of(found)
    names = set().union(*classes)
    own = any(c <= _KEPT for c in classes)  # 'content social-share', but not 'comment-content'
    if names & _NAMES or names & _HEADS and not names & _KEPT:
        return False, "comments" if names & _COMMENTS and not own else "other", own
    return False, "", bool(names & _KEPT)


def drop_named(parents: list[int], gone: list[bool], named: list[str], article: list[bool], chars: list[int]) -> None:
    """Marks what is gone by its names, and all below. A wrapper that is not named as comments stays if it holds most of
    the page's other text, articles outside it hold little beside it, and it holds an article (else nearly all the text)."""
    count = len(parents)
    held, holds, inside = list(chars), list(article), list(article)
    free: dict[int, int] = {}  # by the nearest element with a name that may go: text in articles
    owner = [-1] * count
    for k in range(1, count):
        gone[k] = gone[k] or gone[parents[k]] or named[k] == "comments"
        held[k] = 0 if gone[k] else chars[k]
        owner[k] = k if named[k] else owner[parents[k]]
        inside[k] = inside[k] or inside[parents[k]]
        if inside[k]:
            free[owner[k]] = free.get(owner[k], 0) + held[k]
    for k in range(count - 1, 0, -1):
        held[parents[k]] += held[k]
        holds[parents[k]] = holds[parents[k]] or holds[k] and held[k] > 0
    outside = free.get(-1, 0)
    for k in range(1, count):
        if gone[parents[k]]:
            gone[k] = True
        elif named[k] and not gone[k]:
            if held[k] * 10 >= held[0] * (5 if holds[k] else 9) and outside * 4 < held[k]:
                outside += free.get(k, 0)
            else:
                gone[k] = True


def extract(page: str) -> str:
    # nodes in page order: tag, parent, gone or below one that is
    tags, parents, gone = ["body"], [-1], [False]
    named, article = [""], [False]
    chars, links = [0], [0]
    texts: list[tuple[int, int, str]] = []  # node, block, text
    open_, block, at = [0], 0, 0
    inside, held = [False], Counter()  # whether a node is in a link; open elements by tag

    def text(raw: str) -> None:
        node = open_[-1]
        if not gone[node]:
            if "&" in raw:
                raw = html.unescape(raw)
            n = len("".join(raw.split()))
            if n:
                chars[node] += n
                if inside[node]:
                    links[node] += n
            texts.append((node, block, raw))

    def close_to(k: int) -> None:
        held.subtract([tags[i] for i in open_[k:]])
        del open_[k:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[3]:
            tag = m[3].lower()
            if tag in ("html", "body"):
                continue
            if tag not in _INLINE:
                block += 1
            if tag in _ENDS:
                close, within = _ENDS[tag]
                for k in range(len(open_) - 1, 0, -1):
                    if not any(held[t] for t in close):
                        break
                    if tags[open_[k]] in close:
                        close_to(k)
                    elif tags[open_[k]] in within:
                        break
            if tag == "br":
                text(" ")
            tags.append(tag)
            parents.append(open_[-1])
            out, name, own = seen_as(tag, m[4])
            gone.append(gone[open_[-1]] or out)
            named.append(name)
            article.append(own or tag in ("article", "main", "h1"))
            chars.append(0)
            links.append(0)
            inside.append(inside[open_[-1]] or tag == "a")
            if tag not in _VOID and not m[4].endswith("/>"):
                open_.append(len(tags) - 1)
                held[tag] += 1
        elif m[2]:
            tag = m[2].lower()
            if tag not in _INLINE:
                block += 1
            for k in range(len(open_) - 1, 0, -1) if held[tag] else ():
                if tags[open_[k]] == tag:
                    close_to(k)
                    break
                if tag in _INLINE and tags[open_[k]] not in _INLINE:
                    break
    if at < len(page):
        text(page[at:])

    drop_named(parents, gone, named, article, chars)
    texts = [t for t in texts if not gone[t[0]]]
    count = len(tags)
    inner, inner_links, last = [0] * count, [0] * count, list(range(count))
    for k in range(count - 1, 0, -1):  # children come after their parents
        p = parents[k]
        last[p] = max(last[p], last[k])
        if not gone[k]:
            chars[p], links[p] = chars[p] + chars[k], links[p] + links[k]
            inner[p], inner_links[p] = inner[p] + inner[k] + 1, inner_links[p] + inner_links[k] + (tags[k] == "a")
    if not chars[0]:
        return ""
    density, sums = [0.0] * count, [0.0] * count
    share = links[0] / chars[0]
    for k in range(count):
        if chars[k] and not gone[k]:
            c, lc, t, lt = chars[k], links[k], max(1, inner[k]), max(1, inner_links[k])
            base = math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e)) or 1.0
            density[k] = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / base
            if k:
                sums[parents[k]] += density[k]
    for k in range(count):
        sums[k] = sums[k] or density[k]
    densest, least, root = max(range(count), key=density.__getitem__), math.inf, max(range(count), key=sums.__getitem__)
    while densest > 0:
        least, densest = min(least, density[densest]), parents[densest]
    least = min(least, density[0])
    up = root
    while parents[up] > 0 and density[parents[up]] >= least:
        up = root = parents[up]
    while up > 0:
        if tags[up] in ("article", "main"):
            root = up
        up = parents[up]
    blocks: dict[int, list[str]] = {}
    for node, b, raw in texts:
        if root <= node <= last[root]:
            blocks.setdefault(b, []).append(raw)
    return "\n".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of (page_id, url, html)."""
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=kinds)

    return pages.select("page_id", "url", "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLE: dict[str, str] = {}
