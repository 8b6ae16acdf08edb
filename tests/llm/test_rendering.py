"""Rendering: round trips of generated pages, and the rules one by one."""

import random
import time

import pytest

from terralake.llm.rendering import render_pages, visible_text


@pytest.mark.parametrize("source,text", [
    ("<p>One<p>Two <b>bold</b>text<br>next", "One\n\nTwo boldtext\nnext"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  4. d\n- e"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>after", "Name   N\nalpha  1\nb      22\n\nafter"),
    ("<table><tr><td colspan=2>wide cell here<tr><td>b<td>22</table>", "wide cell here\nb  22"),
    ("<table><td rowspan=2>R<td>1<tr><td>2</table>", "R  1\n   2"),
    ("<table><tr><td>x<p>y</td><td>z</table>", "x  z\n\ny"),
    ("a<div hidden>no<p>no</div>b<span style='color:red; display : none'>no</span>c<input type=hidden value=v>d", "abcd"),
    ("<title>t</title><body>x<script>if(a<b)'</p>'</script>y<style>p{}</style><!-- no -->z<template>no</template>", "xyz"),
    ("a &amp; b&nbsp;c &lt;p&gt; &copy;", "a & b c <p> ©"),
    ("<pre>  k\n x\n\n y</pre>z", "  k\n x\n\n y\n\nz"),
    ("<p>a</b></i></div>b</p></ul>c", "ab\n\nc"),
    ("<dl><dt>t<dd>def<dt>u<dd>more</dl>", "t\n  def\nu\n  more"),
    ("<h1>H</h1>x<hr>y<blockquote>q</blockquote>", "H\n\nx\n\ny\n\n  q"),
    ("a<br><br>b", "a\n\nb"), ("<select><option>x<option>y</select>", "x\ny"), ("<a href='x>y'>link</a><a title=\">\">two</a>", "linktwo"),
    ("a < b <3 <>", "a < b <3 <>"), ("<p", ""), ("x<!-- open", "x"), ("<script>open", ""), ("", ""), ("</p></td></table>x", "x"), ("<DIV>A</DIV><dIv>b</DiV>", "A\nb"),
    ("<textarea> a <b>b</textarea>", " a <b>b"), ("<table>stray<tr><td>c</table>", "stray\n\nc"), ("<ul><li><p>a</p></li><li>b</ul>", "- a\n\n- b"),
])
def test_rules(source, text):
    assert visible_text(source).strip("\n").rstrip() == text.strip("\n").rstrip() or visible_text(source) == text


@pytest.mark.parametrize("source,text", [
    ("<html><head><title>t</title><body><p>text", "text"), ("<head><title>t</title><meta charset=x><link rel=y>\n<p>a<p>b", "a\n\nb"),
    ("<head>\n<style>s</style> bare text<p>b", "bare text\n\nb"), ("<head><script>s()</script><div>a</div></head>b", "a\nb"),
    ("<head><title>t</title></body></html>late", "late"), ("<head><title>t</title><br>a", "a"), ("<head><head><title>t</title><html><body>a", "a"),
    ("<head><noscript>n<body>a", "a"), ("<head><noscript><img></noscript><meta><template><p>no</template><p>a", "a"), ("<title>t</title><p>a", "a"),
    ("<head hidden><body>a", "a"), ("<div hidden><head><title>t</title><p>no</div>a", "a"), ("<head><title>t</title>&nbsp;a", " a"),
    ("<html><head><title>t</title></head><p>a", "a"), ("<head><title>t</title>  \n", ""),
])
def test_heads_without_end_tag(source, text):
    assert visible_text(source) == text


@pytest.mark.parametrize("source,text", [
    ("<p>a <math><mi>x</mi> <mo>=</mo>\n<mn>1</mn></math> b", "a x=1 b"), ("a<math display=block><mi>x</mi></math>b", "a\nx\nb"),
    ("<math><semantics><mi>x</mi><annotation encoding=tex>no</annotation><annotation-xml><ci>no</ci></annotation-xml></semantics></math>y", "xy"),
    ("<svg width=3><title>no</title><desc>no</desc><metadata>no</metadata><defs><text>no</text></defs><text x=1>one <tspan>two</tspan></text>\n<g><text>three</text></g></svg>after", "one two\nthree\nafter"),
    ("<svg><title/><style/><path d='M0'/><rect style='display:none'/><text>a</text></svg><p>b", "a\n\nb"), ("<svg>stray<g/>no</svg>b", "b"),
    ("<svg><foreignObject><div>a<p/>b</div></foreignObject></svg>c", "a\n\nb\n\nc"), ("<svg><g><path d=M0/><p>a", "a"), ("<svg><text><![CDATA[a<b>&amp;]]></text></svg>", "a<b>&amp;"),
    ("<div hidden><svg><text>no</text></svg><math><mi>no</mi></math></div>a", "a"), ("<svg><text display=none>no</text><text>a</text></svg>", "a"),
    ("<svg><style>p>a{}</style><script>if(1)</script><text>a</text></svg>", "a"), ("<table><tr><td><math><mi>x</mi></math><td>y</table>", "x  y"),
])
def test_formulas_and_drawings(source, text):
    assert visible_text(source) == text


def page(rng, depth):
    """A random page: markup with end tags, markup without the ones that may be left out, and its text."""
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7)))
    full, short, text = [], [], []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["p", "ul", "table"] if depth else ["p"])
        if kind == "p":
            t = " ".join(word() for _ in range(rng.randrange(1, 6)))
            full.append(f"<p>{t}</p>")
            short.append(f"<p>\n {t}\n")
            text.append(t)
        elif kind == "ul":
            items = [word() for _ in range(rng.randrange(1, 4))]
            full.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            short.append("<ul>" + "".join(f"<li>{i}\n" for i in items) + "</ul>")
            text.append("\n".join(f"- {i}" for i in items))
        else:
            rows = [[word() for _ in range(3)] for _ in range(rng.randrange(1, 4))]
            full.append("<table><tbody>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</tbody></table>")
            short.append("<table>" + "".join("<tr>" + "".join(f"<td>{c} " for c in r) for r in rows) + "</table>")
            width = [max(len(r[i]) for r in rows) for i in range(3)]
            text.append("\n".join("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in rows))
    return "".join(full), "".join(short), "\n\n".join(text)


def test_round_trip_with_and_without_implied_tags():
    rng = random.Random(9)
    for _ in range(300):
        full, short, text = page(rng, 1)
        assert visible_text(f"<!DOCTYPE html><html><head><title>x</title></head><body>{full}</body></html>") == text
        assert visible_text(short) == text


def test_round_trip_without_tags_of_head_and_body():
    rng = random.Random(10)
    for _ in range(100):
        _, short, text = page(rng, 1)
        assert visible_text(f"<!DOCTYPE html><html><head><title>x</title>\n<meta name=m>{short}") == text
        assert visible_text(f"<!DOCTYPE html><title>x</title><body>{short}") == text


def test_deep_and_long_pages():
    assert visible_text("<div>" * 50000 + "x") == "x"
    assert visible_text("<b>" * 50000 + "x" + "<p>y" * 2).endswith("y")
    assert visible_text("<a \"" * 5000) == ""
    assert len(visible_text("<p>w " * 20000).split()) == 20000


def test_on_a_table(spark):
    rows = [(1, "<p>a", "x"), (2, None, "x"), (3, "", "x"), (None, "<br>b", "x"), (1, "<p>a", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["n_lines"]) for r in render_pages(pages).collect())
    assert [(k, t.strip()) for k, t, _, _ in got] == [(0, "b"), (1, "a"), (1, "a"), (2, ""), (3, "")]
    assert render_pages(pages.limit(0)).collect() == []


@pytest.mark.parametrize("page, want", [
    ("<dialog>a</dialog>b", "b"), ("<dialog open>a</dialog>b", "a\nb"),
    ("<details>x<summary>S<b>!</b></summary>y<p>z</details>w", "S!\nw"), ("<details open><summary>S</summary>y</details>w", "S\ny\nw"),
    ("<details><details><summary>in</summary></details><summary>out</summary>q</details>e", "out\ne"),
    ("<details><summary>first</summary><summary>second</summary>t</details>u", "first\nu"),
    ("<details><summary hidden>s</summary>t</details>u", "u"), ("<details>only", ""),
    ("<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>", "ab"), ("<progress>50%</progress>c<meter>m</meter>", "c"),
    ("<ol _next=7 start=3><li _indent=9>a</ol>", "3. a"),
])
def test_what_is_closed_is_not_shown(page, want):
    assert visible_text(page) == want


def slow_table(rows, wide):
    """A table row by row and column by column: cells are (text, columns)."""
    width = {}
    for row in rows:
        for c, (text, across) in row.items():
            if across == 1:
                width[c] = max(width.get(c, 0), len(text))
    columns, out = sorted({c for r in rows for c in r}), []
    for row in rows:
        line, reach = "", -1
        for c in (c for c in columns if c <= max(row)):
            if c >= reach:
                text, across = row.get(c, ("", 1))
                own = [width.get(x, 0) for x in columns if c <= x < c + across]
                room = sum(own) + 2 * (len(own) - 1)
                line += text + " " * (max(0, room - len(text)) if room <= wide else 0) + "  "
                reach = c + across
        out.append(line.rstrip(" "))
    return "\n".join(out)


@pytest.mark.parametrize("wide", [80, 12])
def test_tables_against_a_plain_layout(wide):
    rng = random.Random(wide)
    for _ in range(200):
        n, grid, rows, page = rng.randint(1, 6), set(), [], ""
        for r in range(rng.randint(1, 5)):
            row, at, page = {}, 0, page + "<tr>"
            for _ in range(n):
                while (r, at) in grid:
                    at += 1
                text, across, down = "abcdefghijklmnop"[:rng.randint(1, 14)], rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])
                page += f"<td colspan={across} rowspan={down}>{text}"
                row[at] = (text, across)
                grid |= {(r + i, at + j) for i in range(down if down > 1 else 0) for j in range(across)}
                at += across
            rows.append(row)
        assert visible_text(f"<table>{page}</table>", wide) == slow_table(rows, wide)


def test_wide_tall_and_deep_pages_take_linear_time():
    start = time.perf_counter()
    for page in ("<table>" + "<tr><td rowspan=1000>x" * 2000, "<table><tr>" + "<td>x" * 8000, "<b>" * 8000 + "<li>" * 8000):
        visible_text(page)
    assert time.perf_counter() - start < 3
