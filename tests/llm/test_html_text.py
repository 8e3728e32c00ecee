"""The style tree against a plain computation, and what markup may do to a page."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lineweave.llm import html_text as html

SCHEMA = "page_id long, url string, html string"


def read(text, importance=lambda style: 1.0):
    return html.Page(text).text(importance)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>Before.</p><svg class='i'/><p>After.</p></article>", "Before. After."),
        ("<article><p>Before.</p><svg><path/><svg></svg></svg><math/>After.</article>", "Before. After."),
        ("<article><p>a</p><object data=x><p>b</p><iframe src=y>c</article>", "a b c"),
        ("<article>a<script>x</article>", "a"),
        ("<article>a<canvas>no</canvas >b<select><option>1</select></article>", "ab"),
        ("<div>" * 3000 + "<footer>FOOT</footer><div class='ad'>AD</div><article>Story</article>", "Story"),
        ("<div>" * 3000 + "</div>" * 3000 + "<article>Story</article>", "Story"),
        ("<article><div class='social-science'>a</div><section id='form-and-function'>b</section></article>", "a b"),
        ("<article>a<div class='post-comments'>b</div><ul class='relatedPosts'><li>c</ul><p class='adSlot2'>d</article>", "a"),
        ("<article>a <span style='display: none'>b<span>c</span></span>d <em class='ad'>e</em>f</article>", "a d f"),
        ("<article><p>a <b hidden>b<p>c</article>", "a c"),
        ("<article class='card'>x</article><div><p>" + "the body " * 9 + "</p></div>", ("the body " * 9).strip()),
        ("", ""),
    ],
)
def test_markup(page, text):
    assert read(page) == text


def site(seed=0, hosts=2, pages=24):
    """Pages whose declared article holds a box without a telling name; some articles are copies of others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = []
    for host in range(hosts):
        articles = []
        for n in range(pages):
            if n % 4 == 3:
                body = articles[-1]
            else:
                body = "".join(f"<p>{' '.join(word() for _ in range(12))}.</p>" for _ in range(rng.randint(2, 5)))
                body += f"<blockquote><i>{word()}</i></blockquote>" if n == 2 else ""
            articles.append(body)
            box = f"<div class='x{host}'>Read our paper, all week.<ul><li>Subscribers only</ul></div>"
            out.append(
                (host * pages + n, f"http://h{host}.example.com/{n}",
                 f"<body><nav>{word()}</nav><article>{body}{box}</article><div>Ring {rng.randint(1, 2)}</div></body>")
            )
    return out


def plain_importance(pages):
    """Importance by the definitions, page by page and node by node."""
    shapes, units = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    above = {}
    for _, url, page in pages:
        host, parsed = html.host_of(url), html.Page(page)
        mark = tuple(t for t, _, role in parsed.units if role == html.MAIN)
        for chain, shape in parsed.shapes:
            shapes[host, chain[-1][0]][shape].add(mark)
            above[host, chain[-1][0]] = [(host, style) for style, _ in chain]
        for text, chain, _ in parsed.units:
            units[host, chain[-1][0]][text].add(mark)
    found = {}
    for node, seen in shapes.items():
        counts = [len(x) for x in seen.values()]
        total = sum(counts)
        entropy = -sum(c / total * math.log(c / total) for c in counts)
        presentation = entropy / math.log(max(total, 2))
        logs = [math.log(len(m)) for other in shapes if node in above[other] for m in units[other].values()]
        content = max(0.0, 1 - sum(logs) / len(logs) / math.log(max(total, 2))) if logs else presentation
        found[html._node(html._hash(node[0]), node[1])] = (
            total, 1.0 if total < html.MIN_PAGES else (presentation + content) / 2
        )
    return found


def test_importance_is_what_the_definitions_give(spark):
    pages = site()
    got = {r["node"]: (r["pages"], r["importance"]) for r in html.node_importance(spark.createDataFrame(pages, SCHEMA)).collect()}
    want = plain_importance(pages)
    assert got.keys() == want.keys()
    for node, (n, importance) in want.items():
        assert got[node][0] == n
        assert got[node][1] == pytest.approx(importance, abs=1e-9)


@pytest.mark.parametrize("limit", [html.BROADCAST_NODES, 0])
def test_the_tree_decides_inside_declared_articles(spark, limit):
    pages = site()
    got = {r["page_id"]: r["text"] for r in html.html_text(spark.createDataFrame(pages, SCHEMA), limit).collect()}
    for page_id, _, page in pages:
        paragraphs = [re.sub("<.*?>", "", x) for x in re.findall("<(?:p|blockquote)>(.*?)</(?:p|blockquote)>", page)]
        assert got[page_id] == " ".join(paragraphs)
        # with the entropies switched off, the box stays
        assert "Read our paper" in read(page)


def test_a_site_of_copies_keeps_its_article(spark):
    page = "<article><h1>One</h1><p>and the same story everywhere</p></article>"
    near = [page.replace("One", f"One {i}") for i in range(9)]
    rows = [(i, "http://a.example.com/", p) for i, p in enumerate([page] * 8)]
    rows += [(100 + i, "http://b.example.com/", p) for i, p in enumerate(near)]
    got = Counter(r["text"] for r in html.html_text(spark.createDataFrame(rows, SCHEMA)).collect())
    want = Counter(["One and the same story everywhere"] * 8 + [f"One {i} and the same story everywhere" for i in range(9)])
    assert got == want
