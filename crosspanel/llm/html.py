"""Operator 5: main text of web pages.

A page is read once from front to back, state by state, so its cost is linear whatever it holds.  Markup settles most
of it: the article is what lies in ``article`` elements if they have a good part of the text of the ``main`` around
them (or of a page without ``main``), else what lies in ``main``; menus, headers, footers, sidebars, adverts, forms,
scripts, styles and reader comments, by their elements or plain names, are not.  It leaves blocks in doubt: all of those
of a page that has neither element, teasers (small articles in a ``main``), and those whose names may mean either, such as
"related" or "share-price".  For those the pages of a host are taken together: each page's doubtful blocks are one stream,
stretches of ``LONG`` bytes or more that repeat are found with the suffix array of ``suffix.py``, those that at least
two pages of different content have are boilerplate, and so are doubtful blocks that they mostly cover; the rest stays.
Pages of a host with equal blocks are one page.

A block's character references are decoded and its white space becomes single spaces; blocks are joined by an
empty line.  A tag, comment or raw element without an end goes up to the end of the page.  Null and empty pages have an empty text; repeated rows give repeated results; pages without a host
share the empty one; an empty table gives an empty result; other columns are left out and may
have any name.  A very long page is read once by one task.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm import suffix
from crosspanel.llm._shared import U64, Rolling, cut, mix, signed, table
from crosspanel.llm.repeats import Kind, covered, keyed, repeated_windows, row_key

#: Bytes of a stretch that counts as repeated, and of its anchors.
LONG, ANCHOR = 60, 20
#: Share of a block that has to be covered for it to be boilerplate.
MOSTLY = 0.5

_SPACE, _GAP = re.compile(r"\s*+"), re.compile(r"[\s/]*+")
_TAG_NAME, _NAME, _VALUE = re.compile(r"[^\s/>]++"), re.compile(r"=?[^\s/>=]*+"), re.compile(r"[^\s>]*+")
#: Elements whose content is text up to their end tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "iframe", "textarea", "title")}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("p b i em strong span a u small font".split())
_DROP = set("nav footer aside form menu button select dialog noscript template svg object".split())
#: Names that mark what isn't the article wherever they stand, and names that may.
_CLEAR = re.compile(r"ads?|adverts?|advertisements?|advertising|sponsored|sidebar|cookies?|consent|newsletter|subscribe|promo|banner|nav|footer|(?:reader|user)[-_]comments?(?:[-_][a-z0-9]+)*|comments?(?:[-_][a-z0-9]+)*|disqus(?:[-_][a-z0-9]+)*|(?:share|social)[-_](?:bar|buttons?|links?)|breadcrumbs?|navbar|navigation|popup|modal|contentinfo|complementary|search", re.I)
_MAYBE = re.compile(
    r"(?:(?!no|has|with|without)[a-z0-9]+[-_])*(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|sidebar|cookies?|consent|notices?|newsletter|subscribe|comments?|disqus|share|sharing|social|related|breadcrumbs?|menu|nav|navbar|navigation|footer|popup|modal|widget|contentinfo|complementary|search)(?:[-_][a-z0-9]+)*",
    re.I,
)
#: Longer names mark nothing.
_LONGEST = 80
#: An article is the page's if it has this share of the text of the ``main`` around it, or of a page without one.
_OF_MAIN, _OF_PAGE = 1 / 2, 1 / 3


def _tag(s: str, at: int) -> tuple[str, list[str], bool, int]:
    """Name, class names with id and role, whether it closes itself, and the end of the tag whose name starts at ``at``; without an end it takes all."""
    m = _TAG_NAME.match(s, at)
    tag, p, marks, seen, slash = m[0].lower(), m.end(), [], set(), False
    if s[p : p + 1] == ">":
        return tag, marks, False, p + 1
    while True:
        q = _GAP.match(s, p).end()
        slash = q > p and s[q - 1] == "/"
        if q >= len(s):
            return tag, marks, False, len(s)
        if s[q] == ">":
            return tag, marks, slash, q + 1
        m = _NAME.match(s, q)
        name, p = m[0].lower(), m.end()
        q = _SPACE.match(s, p).end()
        if s[q : q + 1] != "=":
            continue
        q = _SPACE.match(s, q + 1).end()
        quote = s[q : q + 1]
        if quote in ("'", '"') and quote:
            p = s.find(quote, q + 1)
            if p < 0:
                return tag, marks, False, len(s)
            value, p = s[q + 1 : p], p + 1
        else:
            m = _VALUE.match(s, q)
            value, p = m[0], m.end()
        if name in ("class", "id", "role") and name not in seen:
            seen.add(name)
            marks += value.split()


def _tokens(s: str):
    """Pieces of text (str) and tags (name, marks, closes itself, is an end tag) of a page, read once from front to back."""
    at, n = 0, len(s)
    while at < n:
        lt = s.find("<", at)
        if lt < 0:
            yield s[at:]
            return
        if lt > at:
            yield s[at:lt]
        c = s[lt + 1 : lt + 2]
        if s.startswith("<!--", lt):
            end = s.find("-->", lt + 2)
            at = n if end < 0 else end + 3
        elif s.startswith("<![CDATA[", lt):
            end = s.find("]]>", lt)
            at = n if end < 0 else end + 3
        elif c in ("!", "?") or (c == "/" and not s[lt + 2 : lt + 3].isascii()) or (c == "/" and not s[lt + 2 : lt + 3].isalpha()):
            end = s.find(">", lt)
            at = n if end < 0 else end + 1
        elif c == "/":
            tag, _, _, at = _tag(s, lt + 2)
            yield tag, [], False, True
        elif c.isascii() and c.isalpha():
            tag, marks, closed, at = _tag(s, lt + 1)
            yield tag, marks, closed, False
            if tag in _RAW and not closed:
                m = _RAW[tag].search(s, at)
                at = n if m is None else m.start()
        else:
            yield "<"
            at = lt + 1


def _marked(marks: list[str], names: re.Pattern) -> bool:
    return any(len(x) <= _LONGEST and names.fullmatch(x) for x in marks)


def blocks_of(page: str | None) -> tuple[list[str], list[bool]]:
    """Texts of a page's blocks in order, and of each whether its markup leaves in doubt that it is the article's."""
    found: list[tuple[str, bool, bool, bool]] = []  # text, whether in an article, in main, in doubt
    none = (False, False, False, False)
    stack: list[tuple] = []  # tag, whether it is left out, in an article, in main, in doubt; whether a new paragraph ends one here
    open_: Counter[str] = Counter()
    text: list[str] = []
    head: list[str] | None = None  # what stands in a head so far: it is dropped once the body begins
    skip, article, main, doubt = none

    def close() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                found.append((" ".join(words), article, main, doubt))

    def pop(k: int) -> tuple[bool, bool, bool, bool]:
        for x in stack[k:]:
            open_[x[0]] -= 1
        del stack[k:]
        return stack[-1][1:5] if stack else none

    for token in _tokens(page or ""):
        if isinstance(token, str):
            if head is not None:
                head.append(token)
            elif not skip:
                text.append(token)
            continue
        tag, marks, closed, ends = token
        if tag == "head":
            head = None if ends else []
            continue
        if head is not None and not ends and tag in _BLOCK:
            head = None
        if tag == "br" or (tag in _VOID and tag != "hr"):
            if not skip and head is None:
                text.append(" ")
            continue
        if tag in _RAW:
            continue
        if tag in _BLOCK:
            close()
        if tag == "hr":
            continue
        if ends:
            if open_[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                skip, article, main, doubt = pop(k)
            continue
        if tag == "p" and stack and stack[-1][5]:
            k = len(stack) - 1
            while stack[k][0] != "p":
                k -= 1
            skip, article, main, doubt = pop(k)
        if closed:
            continue
        whole = tag in ("main", "body", "html")
        skip = skip or tag in _DROP or (tag == "header" and not (article or main)) or (not whole and _marked(marks, _CLEAR))
        doubt = doubt or (not whole and not skip and _marked(marks, _MAYBE))
        article, main = article or tag == "article", main or tag == "main"
        stack.append((tag, skip, article, main, doubt, tag == "p" or (tag in _INLINE and bool(stack) and stack[-1][5])))
        open_[tag] += 1
    if head and not skip:
        text += head
    close()
    size = lambda rows: sum(len(x[0]) for x in rows)
    own, around = [x for x in found if x[1]], [x for x in found if x[2]]
    inner = size(x for x in own if x[2])
    if around and not (inner >= _OF_MAIN * size(around) or size(own) - inner > size(around)):
        return [x[0] for x in around], [x[3] or x[1] for x in around]  # an article in it is a teaser, perhaps
    if own and (around or size(own) >= _OF_PAGE * size(found)):
        return [x[0] for x in own], [x[3] for x in own]
    return [x[0] for x in found], [True] * len(found)


def _stream(host: str, blocks: list[str], doubts: list[bool]) -> str:
    return host.replace("\0", "") + "\0" + "\n".join(dict.fromkeys(b for b, d in zip(blocks, doubts, strict=True) if d))


def _values(raw: bytes) -> np.ndarray:
    """Bytes as values that differ from host to host, so that only pages of one host have equal windows."""
    seed = np.zeros(1, U64)
    for c in raw[: raw.find(b"\0") + 1]:
        seed = mix(seed * U64(257) + U64(c))
    return mix(suffix._VALUES[np.frombuffer(raw, np.uint8)] ^ seed)


def kind() -> Kind:
    return Kind(LONG, ANCHOR, _values, lambda raw, v, a, b: raw[a:b], lambda c, at, k: suffix.equal_windows(c, at, LONG, k), suffix.CROWD)


def _shared_windows(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Of the repeated windows of ``pages(row_key, text)`` those that two pages have, not one page twice; as ``spans``."""

    def run(batches):
        for b in batches:
            for key, text, found in zip(b.column("row_key").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                at = np.unique(np.concatenate([lo + np.arange(x["n"]) for x in found for lo in x["lo"]]))
                h = Rolling(_values(text.encode("utf-8", "surrogatepass"))).every(LONG)[at]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array([key] * len(at), pa.binary()), pa.array(at.astype(np.int32))], ["hash", "row_key", "p"])

    rows = pages.join(spans.hint("shuffle_hash"), "row_key").select("row_key", "text", "spans").mapInArrow(run, "hash long, row_key binary, p int")
    shared = rows.groupBy("hash").agg(F.min("row_key").alias("a"), F.max("row_key").alias("b")).where("a < b").select("hash")
    return rows.join(shared, "hash", "left_semi").groupBy("row_key").agg(F.array(F.struct(F.collect_list("p").alias("lo"), F.lit(1).alias("n"))).alias("spans"))


def _kept(blocks: list[str], doubts: list[bool], host: str, spans: list | None) -> list[str]:
    """Blocks without the doubtful ones that repeated stretches of the page's stream mostly cover."""
    raw = _stream(host, blocks, doubts).encode("utf-8", "surrogatepass")
    gone = np.zeros(len(raw) + 1, np.int64)
    for a, b in zip(*covered(spans, LONG), strict=True):
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(np.cumsum(gone) > 0)
    at, drop = raw.find(b"\0") + 1, set()
    for block in dict.fromkeys(b for b, d in zip(blocks, doubts, strict=True) if d):
        n = len(block.encode("utf-8", "surrogatepass"))
        if n and gone[at + n - 1] - (gone[at - 1] if at else 0) >= MOSTLY * n:
            drop.add(block)
        at += n + 1
    return [b for b, d in zip(blocks, doubts, strict=True) if not (d and b in drop)]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text)`` for each row of ``pages``."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    base = keyed(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"), host.alias("host")), "id", "text")
    names = ["id", "url", "host", "row_key", "blocks", "doubts"]

    def parse(batches):
        for b in batches:
            made = [blocks_of(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:4]], pa.array([x for x, _ in made], pa.list_(pa.string())), pa.array([d for _, d in made], pa.list_(pa.bool_()))], names)

    types = {c: base.schema[c].dataType.simpleString() for c in ("id", "url")}
    parsed = cut(base.mapInArrow(parse, f"id {types['id']}, url {types['url']}, host string, row_key binary, blocks array<string>, doubts array<boolean>"), "parsed")
    clear = parsed.where("not array_contains(doubts, true)").select("id", "url", F.array_join("blocks", "\n\n").alias("text"))
    # pages of equal content are one: a page doesn't make its own text boilerplate
    doubtful = parsed.where("array_contains(doubts, true)").withColumn("row_key", row_key("host", F.array_join(F.array_distinct("blocks"), "\n")))

    def streams(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("host", "blocks", "doubts")), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("row_key"), pa.array([_stream(*r) for r in rows], pa.string())], ["row_key", "text"])

    pages_ = doubtful.select("host", "row_key", "blocks", "doubts").mapInArrow(streams, "row_key binary, text string").dropDuplicates(["row_key"])
    spans = _shared_windows(pages_, repeated_windows(pages_, kind()))

    def keep(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("blocks", "doubts", "host", "spans")), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(["\n\n".join(_kept(*r)) for r in rows], pa.string())], ["id", "url", "text"])

    rest = doubtful.join(spans.hint("shuffle_hash"), "row_key", "left").select("id", "url", "host", "blocks", "doubts", "spans").mapInArrow(keep, f"id {types['id']}, url {types['url']}, text string")
    return clear.union(rest).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def op5_html(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
