"""Operator 5: ordinary and broken markup, very long pages, and the repeats of a host's pages against a count of all windows."""

import os
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crosspanel.llm import html

SF = "/root/testdata/sf0.001"
STORY = "story " * 50


def texts(page):
    return html.blocks_of(page)[0]


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<p title=don't>Hello it's me</p>", ["Hello it's me"]),
        ("<p title=don't class=x>Hello</p><p>it's <b title='>'>bold</b> and \"quoted\"", ["Hello", 'it\'s bold and "quoted"']),
        ("<a href=x/y/>text</a> <img alt='a > b'>more", ["text more"]),
        ("a < b and c <3 d", ["a < b and c <3 d"]),
        ("one</>two</ three>four<!bogus>five<?php x ?>six", ["onetwofourfivesix"]),
        ("<!-- <p>no</p> -->yes<!-->also<!--->too<!-- open <p>gone", ["yesalsotoo"]),
        ("<p>one<p>two<br>three<div>four</div>five", ["one", "two three", "four", "five"]),
        ("<SCRIPT>if (a < b) '</div>'</ScRiPt >x<style>y</style><textarea><p>z</textarea>w", ["xw"]),
        ("<title>no</title><svg><title>x</title><text>no</text></svg>yes<template><p>no</p></template>", ["yes"]),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", ["one", "two", "a", "b"]),
        ("text<p title=\"never closed>gone", ["text"]),
        ("<head>loose", ["loose"]),
        ("&lt;p&gt; &amp;nbsp; &#233;&#x1F600; &nbsp;x", ["<p> &nbsp; é😀 x"]),
        ("", []),
    ],
)
def test_markup(page, blocks):
    assert texts(page) == blocks


def test_article_or_main():
    card = "<article class='card'><h3>Other news</h3></article>"
    assert html.blocks_of(f"<main><div>{STORY}</div>{card}</main>") == ([STORY.strip(), "Other news"], [False, True])
    assert html.blocks_of(f"<main><p>{STORY}</p></main>{card}") == ([STORY.strip()], [False])
    assert html.blocks_of(f"<main><h1>Lead</h1><article><p>{STORY}</p></article></main>") == ([STORY.strip()], [False])
    assert html.blocks_of(f"<div>{STORY}</div>{card}") == ([STORY.strip(), "Other news"], [True, True])
    assert html.blocks_of(f"<article><p>{STORY}</p></article><article><p>Second</p></article><div>Rest</div>") == ([STORY.strip(), "Second"], [False, False])
    assert html.blocks_of(f"<main>{card}</main><article><p>{STORY}</p></article>")[0] == ["Other news", STORY.strip()]


def test_names():
    assert html.blocks_of("<main><p>Intro</p><section class='related-work'><p>Related</p></section></main>") == (["Intro", "Related"], [False, True])
    assert html.blocks_of("<div class='share-price'>Price</div><p>x</p>") == (["Price", "x"], [True, True])
    parts = "".join(f"<div class={c}>{c}</div>" for c in ("comment-body", "comments-wrapper", "reader-comments", "comment", "promo", "nav", "footer", "banner", "ad", "cookie", "disqus_thread"))
    for around in ("article", "main", "div"):
        assert texts(f"<{around}><p>{STORY}</p>{parts}</{around}>") == [STORY.strip()]
    assert texts(f"<article><p class='{'ads-' * 300_000}'>{STORY}</p></article>") == [STORY.strip()]


def test_very_long_pages_of_any_kind():
    """A megabyte of each takes a small multiple of a second: nothing is read again and again."""
    bad = ["<script ", "<head>", '<a href="', "<", "<!--", "</a ", "&", "<title>", "<p><b>", '<p title="x" ', "<p =", "<div class='ads-", "]]><![CDATA[", "<b>", "</i>", "<svg>", "<?"]
    pages = [x * (1_000_000 // len(x)) for x in bad] + ["<b>" * 160_000 + "</i>" * 160_000, "<p><div>" + "<b>" * 150_000 + "<p></p>" * 80_000]
    for page in pages:
        began = time.process_time()
        html.blocks_of(page)
        assert time.process_time() - began < 12, page[:20]


def brute(pages):
    """The text of each page of ``(id, host, blocks)``, all of them in doubt, from a count of all windows of each host."""
    streams, of = defaultdict(set), {}
    for i, host, blocks in pages:
        of[i] = "\n".join(dict.fromkeys(blocks)).encode()
        streams[host].add(of[i])
    out = {}
    for host, those in streams.items():
        holders = defaultdict(set)
        for s in those:
            s = host.encode() + b"\0" + s
            for k in range(len(s) - html.LONG + 1):
                holders[s[k : k + html.LONG]].add(s)
        for i, own, blocks in pages:
            if own == host:
                s = host.encode() + b"\0" + of[i]
                gone = bytearray(len(s))
                for k in range(len(s) - html.LONG + 1):
                    if len(holders[s[k : k + html.LONG]]) > 1:
                        gone[k : k + html.LONG] = b"\1" * html.LONG
                at, drop = len(host.encode()) + 1, set()
                for block in dict.fromkeys(blocks):
                    n = len(block.encode())
                    if sum(gone[at : at + n]) >= html.MOSTLY * n:
                        drop.add(block)
                    at += n + 1
                out[i] = "\n\n".join(b for b in blocks if b not in drop)
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_repeats_decide_on_pages_without_markup(spark):
    """The given pages, with the elements that would settle them turned into plain ones."""
    plain = F.regexp_replace("html", "<(/?)(?:article|main|nav|header|footer|aside|form)\\b[^>]*>", "<$1div>")
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("html", F.regexp_replace(plain, "(class|id|role)=(\"[^\"]*\"|'[^']*')", ""))
    rows = [(r["page_id"], re.match(r"\w+://([^/?#:]+)", r["url"])[1].lower(), r["html"]) for r in pages.collect()]
    want = brute([(i, host, texts(page)) for i, host, page in rows])
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    assert got == want
    assert sum(len(texts(page)) for _, _, page in rows) > sum(len(t.split("\n\n")) for t in got.values())


def test_odd_rows(spark):
    clash = {c: F.lit("clash") for c in ("row_key", "blocks", "doubts", "host", "text", "id", "spans")}
    one = f"<article><p>{STORY}</p></article>"
    rows = [(1, "http://a.org/1", one), (1, "http://a.org/1", one), (2, None, one), (3, "not a url", None), (None, "http://a.org/2", ""), (4, "http://a.org/3", "<p>" + "word " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(clash)
    got = html.main_text(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, u, "" if not h else STORY.strip() if "article" in h else ("word " * 400_000).strip()) for i, u, h in rows], key=str)
    assert html.main_text(pages.where("false")).count() == 0
