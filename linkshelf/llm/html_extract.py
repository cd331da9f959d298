"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line weighs as many characters as it has outside links; lines
of removed parts (menus, forms, adverts, scripts and so on, known by element, class, id or role) stay as empty lines.
The weights of ``WINDOW`` lines from each line on are summed. The text begins where this sum surges over the
threshold, with the lines of text that lead up to it, and ends where it falls to nothing; everything between a surge and the
next dive is kept, short lines too. Where a page marks its article, only lines in it weigh anything, and any weight is
a surge. Else the threshold is ``SURGE`` characters, or half of the page's largest sum if that is less, so a page with
one short paragraph has its text as well.

Defined cases: null and empty pages, and pages of markup alone, give an empty text; character references are decoded once;
unclosed elements end with what holds them, an unclosed comment or script runs to the end of the page, as in browsers; a "<"
that starts no tag is text; repeated rows each get their row.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from linkshelf.llm.buffers import string_array

WINDOW = 3
SURGE = 80
#: A line with a larger share of link text weighs nothing.
MAX_LINKED = 0.5

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)|[^>]*)>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW = ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "select", "title", "math", "canvas", "audio", "video")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROPPED = {"nav", "footer", "aside", "form", "button", "dialog", "head", "menu", "label", "fieldset"}
_ARTICLE = {"article", "main"}
#: Words of a class, id or role that mark a part as no main text.
_SIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related "
    "reply replies respond share sharing sidebar sidenav social sponsor sponsored subscribe toolbar topbar widget complementary contentinfo "
    "search alert disclaimer signup login outbrain taboola".split())
_OPTIONAL_END = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}


def _side(name: str, attributes: str, in_article: bool) -> bool:
    if name in _DROPPED or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes) and name not in ("a", "span"):
        return True
    for match in _NAMES.finditer(attributes):
        words = set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", match[1] or match[2] or match[3] or "").lower()))
        if words & _SIDE_WORDS or ("header" in words and not in_article):
            return True
    return False


def lines(html: str) -> list[tuple[str, int, int, bool]]:
    """``(text, characters, characters in links, inside the article)`` of each line; removed parts are empty lines."""
    found: list[tuple[str, int, int, bool]] = []
    parts: list[str] = []
    linked = link_depth = article_depth = 0
    skipping, depth = "", 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(unescape("".join(parts)).split())
        found.append((text, len(text), linked, article_depth > 0))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not skipping:
            parts.append(text)
            linked += len(text) if link_depth else 0

    at = 0
    while True:
        tag = _TAG.search(html, at)
        add(html[at: tag.start() if tag else len(html)])
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        closing, name, attributes = tag[1] == "/", tag[2].lower(), tag[3]
        if name in _RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(f"</{name}[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if skipping:
            over = name in _ARTICLE or (closing and name in ("body", "html")) or (skipping == "head" and name == "body")
            over = over or (skipping in _OPTIONAL_END and name in _BLOCK and (closing or name in _OPTIONAL_END))
            if name == skipping and not over and not attributes.rstrip().endswith("/"):
                depth += -1 if closing else 1
                if depth <= 0:
                    skipping = ""
                continue
            if not over:
                continue
            skipping = ""
        if name in _BLOCK:
            flush()
        if name == "a":
            link_depth = max(0, link_depth - 1) if closing else 1
        elif name in _ARTICLE:
            article_depth = max(0, article_depth - 1) if closing else article_depth + 1
        if not closing and name not in _VOID and _side(name, attributes, article_depth > 0):
            if parts and name in _BLOCK:
                flush()
            skipping, depth = name, 1
            found.extend([("", 0, 0, False)] * WINDOW)
    flush()
    return found


def main_text(html: str) -> str:
    rows = lines(html)
    marked = any(inside and n for _, n, _, inside in rows)
    weights = [
        0 if (marked and not inside) or (not inside and n and linked > MAX_LINKED * n) else max(n - (0 if inside else linked), 0)
        for _, n, linked, inside in rows]
    # Empty lines come between any two block elements: only lines with text and removed parts count as lines here.
    kept = [i for i, (text, _, _, inside) in enumerate(rows) if text or i and not rows[i - 1][0] and not inside]
    sums = [sum(weights[j] for j in kept[k: k + WINDOW]) for k in range(len(kept))]
    threshold = 0 if marked else min(SURGE, max(sums, default=0) / 2)
    out, begin, inside = [], 0, False  # begin: where the lines with text that lead up to a surge start
    for k, i in enumerate(kept):
        if not inside:
            if not weights[i]:
                begin = k + 1
            elif sums[k] > threshold:
                inside = True
                out += [rows[j][0] for j in kept[begin:k]]
        elif not sums[k]:
            inside, begin = False, k + 1
        if inside and weights[i]:
            out.append(rows[i][0])
    return " ".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row of ``pages``."""

    def extract(batches):
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in string_array(batch.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
