"""Operator 10: planted pages, wrapper inference, and independent extraction with the standard library's parser."""

import random
import re
from html.parser import HTMLParser

from tarnstone.llm.html_text import align, extract, fold, main_text, rule, shape, stream, wrappers


class Article(HTMLParser):
    """Text of the article, for pages whose main text stands in one, with blocks at every tag but inline ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.out, self.part = False, 0, [], []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.skip |= tag == "footer"
        if tag not in ("b", "a", "i", "span"):
            self.flush()

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "i", "span"):
            self.flush()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.part.append(data)

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.part)).strip()
        if text:
            self.out.append(text)
        self.part = []


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        p = Article()
        p.feed(r.html or "")
        p.close()
        p.flush()
        assert got[r.page_id].text == " ".join(p.out), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


PAGE = """<!doctype html><html><head><title>T</title><script>if (a<b) "</p>"</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li><li>More</li></ul></nav>
<div id="cookie-notice">We use cookies</div><div class='content-main'><h1>Title &amp; more</h1><p>One <b>bo</b>ld&nbsp;word
  and   space.<p>Two<br>three</p><div class="ad-slot">Buy</div><form><input value=x>Send</form>{extra}</div>
<aside>Side</aside><section class="comments"><p>Nice post</p></section><footer>End</footer></body></html>"""


def test_roles():
    page = PAGE.format(extra="<ul><li>x<li>y</ul>")
    path, own = rule(stream(page))
    assert main_text(page, path, frozenset(own)) == "Title & more One bold word and space. Two three x y" and path == ["div.content-main"] and not own
    assert main_text("") == "" and main_text("<p>a<p") == "a" and main_text("5 < 6 &lt; 7") == "5 < 6 < 7"


def signs(items):
    return [x if x == "#" else [x[0] + x[1], signs(x[3])] for x in shape(items)[0]]


def test_wrapper_is_union_free():
    a, b = stream("<h1>T</h1><p>x</p>"), stream("<h1>U</h1><div class=note7><b>n</b></div><p>x</p><p>y</p>")
    assert signs(align(a, b)) == [["h1", ["#"]], ["div?", ["#"]], ["p+", ["#"]]]
    assert signs(align(align(a, b), a)) == signs(align(a, b))


def test_repetition_is_inferred_from_squares():
    got = stream("<section><h2>a</h2><span>t</span><div>1</div><h2>b</h2>u<div>2</div><div>3</div><h2>c</h2><div>4</div></section>" + "<dl>" + "<dt>k<dd>v" * 4 + "</dl>")
    assert signs(got)[0] == ["section", [["(h2 # div)+", [["h2", ["#"]], "#", ["div+", ["#"]]]], ["h2", ["#"]], ["div", ["#"]]]]
    assert signs(got)[1] == ["dl", [["(dt dd)+", [["dt", ["#"]], ["dd", ["#"]]]]]]
    x = lambda k: [k, "", False, []]
    assert signs(fold([x("h"), x("p"), x("h"), x("p"), x("p"), x("h"), x("p"), x("q")])) == [["(h p)+", [["h", []], ["p+", []]]], ["q", []]]


SITE = """<html><body><div class=top>{name}</div><div><a href=/>Home</a> <a href=/x>Other pages</a></div>{note}
<div class=col><h1>{title}</h1><div class=info>All rights with {name}, which you may read</div>{body}<div>Read more of this at {name}</div></div><div class=end>{name} {name} {name}</div></body></html>"""


def site(n, name="the house", seed=1):
    rnd = random.Random(seed)
    words = lambda k: " ".join(rnd.choice("red green blue old new small large house tree river stone".split()) + str(rnd.randint(0, 99)) for _ in range(k))
    out = []
    for i in range(n):
        title, paragraphs = words(4), [words(rnd.randint(10, 40)) for _ in range(rnd.randint(1, 6))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        note = "<section>A passing remark for all readers</section>" if i % 2 else ""
        out.append((i, f"http://{name.replace(' ', '.')}/{i}", SITE.format(name=name, title=title, body=body, note=note), " ".join([title, *paragraphs])))
    return out


def test_hosts_without_an_article(spark):
    """Nothing but the wrapper tells the host's texts: alone, a page keeps them."""
    rows = site(20)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert got == {r[0]: r[3] for r in rows}
    alone = extract(spark.createDataFrame([rows[0][:3]], "page_id long, url string, html string")).first().text
    assert alone != rows[0][3] and rows[0][3].split()[0] in alone and "All rights" in alone


def test_large_hosts_are_aligned_in_a_tree(spark):
    rnd = random.Random(3)
    rows = []
    for i, (k, url, page, text) in enumerate(site(60, seed=5)):
        extra = "".join(rnd.choice(["<table><tr><td>{}</table>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>"]).format(f"x{i}{j}") for j in range(rnd.randint(0, 4)))
        more = re.findall(r"x\d+", extra)
        at = page.index("<div>Read more")
        rows.append((k, url, page[:at] + extra + page[at:], " ".join([text, *more])))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert wrappers(df.selectExpr("'h' AS host", "html"), 3).count() == 1
    assert {r.page_id: r.text for r in extract(df).collect()} == {r[0]: r[3] for r in rows}


def test_copies_of_a_page_are_no_template(spark):
    page = site(1)[0][2]
    got = extract(spark.createDataFrame([(i, "http://h/", page) for i in range(9)], "page_id long, url string, html string")).collect()
    assert len({r.text for r in got}) == 1 and "All rights" in got[0].text


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://a.b/x", ""), (None, "http://a.b/y", "<p>t"), (3, "nonsense", "<" * 2000), (3, "nonsense", "<" * 2000), (4, "http://a.b", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "h", "r", "w") for r in rows], "page_id long, url string, html string, host string, rule string, wrapper string")
    got = extract(df).collect()
    assert len(got) == 6 and {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert [r.text for r in got if r.page_id is None] == ["t"] and [r.text for r in got if r.page_id == 4] == ["deep"]
    assert extract(df.limit(0)).count() == 0


def test_what_stands_in_the_article_stays():
    page = """<body><nav id="menu">Home</nav><article><header><h1>T</h1></header><h2 id="related-work">Related work</h2><p>One</p>
<section class="social-policy"><p>Two</p></section><figure><img src=a><figcaption>Three</figcaption></figure><div class="layout no-sidebar"><p>Four</p></div>
<p>If <math><mi>x</mi><mo>=</mo><mn>4</mn></math></p><div class="advert box">Buy</div><div class="share">Share</div><div id="comments">Kept</div></article>
<div class="post-comments">Nice</div><aside>Side</aside></body>"""
    path, _ = rule(stream(page))
    assert path == ["article"] and main_text(page, path) == "T Related work One Two Three Four If x = 4 Kept"
    assert main_text("<div id=cookie-notice>C</div><figure>F</figure><math><mi>x</mi></math><p>t") == "F x t"
    assert main_text('<div class="layout no-sidebar"><p>Main words here</div>') == "Main words here"


def test_the_wrapper_alone_finds_the_text_of_the_table(monkeypatch):
    """With no list of elements or classes, on the given pages: all texts by the hosts' wrappers, none without them."""
    import collections
    import re

    import pyarrow.parquet as pq

    from tarnstone.llm import html_text as H

    hosts = collections.defaultdict(list)
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        hosts[re.match("[a-z]+://([^/?#]*)", r["url"])[1]].append(r["html"])
    want = {p: H.main_text(p, *_ruled(H, [p])) for pages in hosts.values() for p in pages}
    monkeypatch.setattr(H, "is_dropped", lambda name, marks, inside=False: False)
    found = without = 0
    for pages in hosts.values():
        rule = _ruled(H, pages)
        found += sum(H.main_text(p, *rule) == want[p] for p in pages)
        without += sum(H.main_text(p) == want[p] for p in pages)
    assert found == len(want) >= 200 and without == 0


def _ruled(H, pages):
    wrapper = None
    for p in pages:
        wrapper = H.stream(p) if wrapper is None else H.align(wrapper, H.stream(p))
    path, own = H.rule(wrapper)
    return path, frozenset(own)


def test_varying_text_goes_before_the_tag():
    from tarnstone.llm import html_text as H

    page = lambda i: f"<html><body><article>teaser {i}</article><div class='story'><p>{'long text of the story ' * 20}{i}</p></div></body></html>"
    path, _ = _ruled(H, [page(i) for i in range(6)])
    assert path == ["div.story"]
    page = lambda i: f"<html><body><article><p>{'text of it ' * 12}{i}</p></article><div class='more'><p>{'other text ' * 11}{i}</p></div></body></html>"
    assert _ruled(H, [page(i) for i in range(6)])[0] == ["article"]
    page = lambda i: f"<html><body><main><div><article><p>{'text of it ' * 12}{i}</p></article></div></main></body></html>"
    assert _ruled(H, [page(i) for i in range(6)])[0] == ["main", "div", "article"]
