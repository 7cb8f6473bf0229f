"""Operator 5: made-up pages, the kernel against a plain loop, odd input."""

import math
import random
import re
from html import unescape

import numpy as np

from inkwell.llm.html_extract import SIGMA, SPREAD, _Lines, extract, extract_pages, smooth


def page(r, paragraphs):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    text = [" ".join(word() for _ in range(r.randint(40, 90))) for _ in range(paragraphs)]
    menu = "".join(f"<li><a href='/{i}'>{word()}</a></li>" for i in range(12))
    foot = "".join(f"<span><a href='#'>{word()}</a></span>" for _ in range(8))
    return f"<html><head><title>T &amp; U</title><style>x{{}}</style></head><body><nav><ul>{menu}</ul></nav>" + "".join(f"<p>{t}</p>\n" for t in text) + f"<script>var a = 1;</script><footer><div>{foot}</div></footer></body></html>", text


def test_content_is_found_and_menus_are_not():
    r = random.Random(1)
    for _ in range(40):
        html, text = page(r, r.randint(1, 8))
        title, got, lines, content, regions = extract(html)
        kept = got.split("\n")
        assert title == "T & U" and set(text) <= set(kept) and len(kept) <= len(text) + 1 and regions >= 1 and content == len(kept) <= lines


def test_smoothing():
    r = np.random.default_rng(2)
    for n in (1, 2, 5, 40):
        x = r.random(n)
        k = [math.exp(-0.5 * d * d) for d in range(-3, 4)]
        want = [sum(x[i + d] * k[d + 3] for d in range(-3, 4) if 0 <= i + d < n) / sum(k[d + 3] for d in range(-3, 4) if 0 <= i + d < n) for i in range(n)]
        assert np.allclose(smooth(x), want)
    assert len(smooth(np.zeros(0))) == 0


def plain(html):
    """Another way to the same: tags and text by a regular expression, ratios and regions by loops."""
    block = set("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
    title = re.search(r"<title>(.*?)</title>", html, re.S)
    rest = re.sub(r"<(script|style|svg|noscript|template|iframe)\b[^>]*>.*?</\1>", lambda m: "<b></b>", html, flags=re.S)
    rest = re.sub(r"<head>.*?</head>", "<b></b>" * 3, rest, flags=re.S) if "<head>" in rest else rest
    lines, text, tags = [], "", 0
    for piece in re.split(r"(<[^>]*>|\n)", rest):
        name = re.match(r"</?\s*(\w+)", piece)
        if piece == "\n" or name and name[1].lower() in block:
            if text or tags:
                lines.append((" ".join(unescape(text).split()), tags))
            text, tags = "", 0
        elif not name:
            text += piece
        tags += bool(name) and not (name[1].lower() in block and piece.startswith("</"))
        if name and name[1].lower() in block and piece.startswith("</"):
            lines[-1:] = [(lines[-1][0], lines[-1][1] + 1)] if lines and not text and not tags else lines[-1:]
    if text or tags:
        lines.append((" ".join(unescape(text).split()), tags))
    return " ".join(unescape(title[1]).split()) if title else "", lines


def test_pages_against_a_plain_version(spark):
    """The content is what loops choose from the lines; the text of all lines is the page's."""
    r = random.Random(9)
    rows = []
    for i in range(30):
        html, _ = page(r, r.randint(0, 6))
        if i % 3 == 0:
            html = html.replace("<nav>", "<noscript>hidden <b>words</b></noscript><svg><text>none</text></svg><nav>")
        rows.append((i, f"u{i}", html))
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for g, (i, _, html) in zip(sorted(got, key=lambda g: g.page_id), rows, strict=True):
        p = _Lines(html)
        p.feed(html)
        p.close()
        p.flush()
        title, lines = plain(html)
        assert g.title == title and [x for x in p.lines if x] == [x for x, _ in lines if x]
        ratio = [len(x) / max(t, 1) for x, t in zip(p.lines, p.tags, strict=True)]
        n = len(ratio)
        soft = []
        for k in range(n):
            w = [(math.exp(-0.5 * (d / SIGMA) ** 2), ratio[k + d]) for d in range(-3, 4) if 0 <= k + d < n]
            soft.append(sum(a * b for a, b in w) / sum(a for a, _ in w))
        mean = sum(soft) / n
        limit = SPREAD * math.sqrt(sum((x - mean) ** 2 for x in soft) / n)
        want, regions, k = [], 0, 0
        while k < n:
            if soft[k] < limit:
                k += 1
                continue
            end = k
            while end < n and soft[end] >= limit:
                end += 1
            own = [j for j in range(k, end) if ratio[j] >= limit]
            if own:
                regions += 1
                want += [p.lines[j] for j in range(own[0], own[-1] + 1) if p.lines[j]]
            k = end
        assert g.text == "\n".join(want) and g.n_regions == regions and g.n_lines == n and g.n_content_lines == len(want)


def test_what_hides_text_has_an_end():
    body = "<p>first words of the page</p>{}<p>later words of the page</p>"
    for tag in ("noscript", "svg", "iframe", "template"):
        assert "later words" in extract(body.format(f"<{tag}>"))[1]
        assert "later words" in extract(body.format(f"<{tag}><{tag}>x</{tag}>"))[1]
        closed = extract(body.format(f"<{tag}>secret</{tag}>"))[1]
        assert "secret" not in closed and "later words" in closed


def test_odd_input(spark):
    long = "<p>" + "word " * 60_000 + "</p>"
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<p>only", "t"), (3, "u", "<p>only", "t"), (None, "u", "<div><b>x", None), (4, "u", "<<>><!-- a --><!DOCTYPE", "t"), (5, "u", long, "t"), (6, "u", "<p>é &copy; &#x41;</p>", "t")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, title string")
    got = extract_pages(d).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[3] == "only" and by[None] == "x" and len(by[5]) == 5 * 60_000 - 1 and by[6] == "é © A"
    assert extract_pages(d.filter("false")).count() == 0
