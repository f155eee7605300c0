"""Main text of small pages: rules, templates by host, odd input."""

import time
from collections import defaultdict

from relaywright.llm.maintext import Parsed, extract, host, tokens


def text(html):
    p = Parsed(html)
    return "\n".join(b[0] for b, kept in zip(p.blocks, p.kept_by_name(), strict=True) if kept)


def test_rules():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header>site</header><nav><ul><li>x<li>y</ul></nav><div class="top-ad">buy</div><aside>s</aside>
    <article class="post"><header><h1>Big  &amp; <i>small</i></h1></header><p>One<br>two&nbsp;&lt;3<p>Three <b>bold</b> end<!-- gone --></p>
    <div id="comments"><p>first!</p></div><form><p>mail</p></form>tail</article><footer>f</footer></body></html>"""
    assert text(page) == "Big & small\nOne two <3\nThree bold end\ntail"
    assert text("") == "" and text("just text & more") == "just text & more"
    assert text("<p>a<p>b</div></span><p>c") == "a\nb\nc"
    assert text("<article><p>open") == "open"
    assert text("<div>x<script>never closed") == "x"
    assert text("<article>a</article><article class='comment'>c</article><article>b</article>") == "a\nb"
    assert text("<ul><li>a<ul><li>b</ul><li>c</ul>") == "a\nb\nc"
    assert text("<article><p class='share-price'>12</p><div class='share'>t</div><div class='share-buttons'>t</div><div class='share-price'>13</div><section class='site-nav'>m</section></article>") == "12\n13"
    assert text("<p>&<b>amp;</b> &lt;b&gt; &am<!-- -->p;</p>") == "&amp; <b> &am p;".replace(" p;", "p;")
    assert text("a < b <3 <>c</p>d") == "a < b <3 <>c\nd"
    assert text("<p title='a > b'>x</p><a href=\">y</a><p>z") == "x\nyz".replace("yz", "y\nz")
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert host("HTTPS://u@Host.example:80/x?y") == "host.example" and host(None) == "" and host("nonsense") == ""


def test_templates_by_host(spark):
    page = lambda k, extra="": f"<body><div><p>Welcome to our site, friend</p></div><div><p>Body number {k} of many words</p>{extra}</div><div>Common end</div></body>"
    rows = [(k, f"http://a.example/{k}", page(k), "x") for k in range(6)] + [(100 + k, f"http://b.example/{k}", page(k), "x") for k in range(4)]
    # one article many times is no template
    rows += [(200 + k, "http://a.example/copy", "<body><div><p>The same long article</p></div></body>", "x") for k in range(20)]
    rows += [(300, None, None, "x"), (301, "http://a.example/e", "", "x"), (302, "http://a.example/n", "<nav>only</nav>", "x"), (1, "http://a.example/1", page(1), "x")]
    out = {}
    for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect():
        out.setdefault(r.page_id, []).append(r)
    assert sum(map(len, out.values())) == len(rows) and len(out[1]) == 2
    assert out[3][0].text == "Body number 3 of many words" and out[3][0].n_chars == 27
    assert out[102][0].text == "Welcome to our site, friend\nBody number 2 of many words\nCommon end"
    assert out[205][0].text == "The same long article"
    assert [out[k][0].text for k in (300, 301, 302)] == ["", "", ""]


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = extract(pages).collect()
    assert len(out) == pages.count() and all(r.text and r.n_chars == len(r.text) for r in out)


def test_templates_below_many_containers(spark):
    pages = [(k, "http://deep.example/x", "<div>" * 100 + f"<p>only here {k}</p><div><p>on every page</p></div>") for k in range(6)]
    out = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {k: f"only here {k}" for k in range(6)}


def plain_extract(pages, many):
    """All subtrees of all pages as nested lists, compared whole."""
    def tree(page):
        root, stack = ["", []], []
        stack.append(root)
        for kind, value, attributes in tokens(page):
            if kind == "text":
                stack[-1][1].append(value)
            elif kind == "open" and value not in ("meta", "br"):
                node = [value + attributes, []]
                stack[-1][1].append(node)
                stack.append(node)
            elif kind == "close":
                stack.pop()
        return root

    def boxes(node):
        if node[0].split(" ")[0] not in ("", "body", "b", "i"):
            yield repr(node), node
        for child in node[1]:
            if isinstance(child, list):
                yield from boxes(child)

    def blocks(node):
        out = [[]]
        for child in node[1]:
            if isinstance(child, str):
                out[-1].append(child)
            elif child[0].split(" ")[0] in ("b", "a", "i"):
                out[-1].append("".join(blocks(child)))
            else:
                out += [[b] for b in blocks(child)] + [[]]
        return [" ".join("".join(b).split()) for b in out if "".join(b).strip()]

    seen = defaultdict(set)
    trees = [tree(page) for _, page in pages]
    for (where, page), t in zip(pages, trees, strict=True):
        body = tuple(blocks(t))
        for key, _ in boxes(t):
            seen[where, key].add(body)
    out = []
    for (where, _), t in zip(pages, trees, strict=True):
        for key, node in list(boxes(t)):
            if len(seen[where, key]) >= many:
                node[1] = []
        out.append("\n".join(blocks(t)))
    return out


def test_templates_alone_against_a_plain_version(spark):
    """Parts without telling names: only what recurs goes. Switched off, nearly all pages change."""
    pages = []
    for k in range(60):
        a, b, c = k % 3, k % 7, k % 20  # recur on 10, 4 or 5, and 1 or 2 pages of a host
        pages.append((f"h{k % 2}.example", f"<body><div class='x{a}'><b>Part {a}</b> of <div>all</div></div><div>B {b}</div><article><p>Text {k} <i>of</i> <b>it</b></p><div>in {a}</div><p>B {b}</p></article><div>C {c}</div></body>"))
    rows = [(k, f"http://{h}/{k}", page) for k, (h, page) in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    # the plain version knows no main part
    named = [(i, u, p.replace("article>", "section>")) for i, u, p in rows]
    want = plain_extract([(pages[i][0], p) for i, _, p in named], 5)
    other = {r.page_id: r for r in extract(spark.createDataFrame(named, "page_id long, url string, html string"), 5).collect()}
    got = {r.page_id: r for r in extract(table, 5).collect()}
    off = {r.page_id: r for r in extract(table, 10**9).collect()}
    assert got == {r.page_id: r for r in extract(table, 5, broadcast=0).collect()}
    assert [other[k].text for k in range(60)] == want
    assert sum(got[k].text != off[k].text for k in range(60)) > 50 and all(got[k].n_template > off[k].n_template == 0 for k in range(60))


def test_long_and_broken_pages_take_linear_time():
    for page in ("<a \"" * 250_000, "<div>" + "<b>" * 20_000 + "</i>" * 200_000, "<b>" * 50_000 + "<p>x" * 50_000, "<a \">\" " * 100_000, "<!" * 500_000, "<" * 500_000, "<div>x" * 50_000, "<td><th>" * 50_000):
        began = time.perf_counter()
        Parsed(page)
        assert time.perf_counter() - began < 5, page[:20]
