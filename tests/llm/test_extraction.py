from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from evidentia.llm import extraction


class Article(HTMLParser):
    """The blocks of the given pages' one article, read by the standard library."""

    def __init__(self):
        super().__init__()
        self.on, self.blocks, self.open = False, [], None

    def ended(self):
        if text := " ".join("".join(self.open or []).split()):
            self.blocks.append(text)
        self.open = None

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.on = True
        elif tag in ("p", "h1"):
            self.ended()
            self.open = []
        elif tag == "br" and self.open is not None:
            self.open.append(" ")

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1"):
            self.ended()
            self.on &= tag != "article"

    def handle_data(self, data):
        if self.on:
            self.open = (self.open or []) + [data]


def article(html):
    a = Article()
    a.feed(html)
    a.close()
    return "\n\n".join(a.blocks)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_pages(spark, sf, size):
    pages = spark.read.parquet(sf.rpartition("/")[0] + f"/{size}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    rows = extraction.extract(pages).collect()
    assert {r.page_id: r.text for r in rows} == want and len(rows) == len(want)
    assert all(r.n_chars == len(r.text) for r in rows)


@pytest.fixture(scope="module")
def model(spark, sf):
    return extraction.fit([r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()])


def test_held_out_forms(model):
    """Pages in forms and words that the model was not fitted on; share of characters."""
    maker = extraction.Made([a + b for a in ("gra", "ulm", "ost", "vek", "yd", "quo") for b in ("nd", "ar", "ita", "ol", "ews", "ing", "ette", "u", "men")], 1234)
    hit = missed = wrong = 0
    for _ in range(300):
        page = extraction.read(maker.page(), {})
        truth = extraction.marked_runs(page)
        keep = model.kept([page])[0]
        for (node, text, _), is_kept in zip(page.runs, truth, strict=True):
            hit += len(text) * (is_kept and node in keep)
            missed += len(text) * (is_kept and node not in keep)
            wrong += len(text) * (not is_kept and node in keep)
    assert hit / (hit + missed) > 0.97 and hit / (hit + wrong) > 0.97


def test_no_node_is_kept_under_a_rejected_one(model):
    maker = extraction.Made(["alpha", "beta", "gamma"] * 20, 77)
    for _ in range(100):
        page = extraction.read(maker.page(), {})
        extraction.marked_runs(page)
        keep = model.kept([page])[0]
        counts, live = extraction.described(page)
        for node in live:
            above, p = [], page.parent[node]
            while p >= 0:
                above.append(p in keep)
                p = page.parent[p]
            if node in keep:  # from the first kept ancestor down all are kept
                assert above == sorted(above, reverse=True)


def test_broken_markup():
    runs = lambda html: [(p.tag[n], t) for p in [extraction.read(html, {})] for n, t, _ in p.runs]
    assert runs("a<p>b<p>c<ul><li>d<li>e</ul>f") == [("html", "a"), ("p", "b"), ("p", "c"), ("li", "d"), ("li", "e"), ("html", "f")]
    assert runs("<div>x &amp;lt; 1 < 2<!-- no --> <b>y</b>&nbsp;&eacute;\n z<br>w</div></p></span>") == [("div", "x &lt; 1 < 2 y é z w")]
    assert runs("<p title='a>b' class=\"c>d\">k</p><script>var a='</p>'</script><style>s</style>l<script>open") == [("p", "k"), ("html", "l")]
    assert runs("<table><tr><td>1<td>2<tr><td>3</table><p>tail <foo") == [("td", "1"), ("td", "2"), ("td", "3"), ("p", "tail")]
    assert runs("") == [] and runs("<") == [("html", "<")] and runs("<div><p>") == []
    assert runs("<div>" * 5000 + "deep") == [("div", "deep")]


def test_odd_pages(spark, model):
    page = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title here</h1><p>{}</p></article><footer>&copy; x</footer></body></html>"
    long = "words of a long page, " * 50_000
    rows = [(1, "u", None), (2, "u", ""), (3, None, "   "), (None, "u", page.format("A body of some words, read whole.")), (4, "u", page.format(long)), (4, "u", page.format(long)), (5, "u", "<<<>>>&&; </div>"), (6, "u", "plain words")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "html_", "h")})
    got = [tuple(r) for r in extraction.extract(p.repartition(3), model=model).collect()]
    assert len(got) == len(rows)
    assert sum(r == (4, "u", "Title here\n\n" + long.strip(), len(long.strip()) + 12) for r in got) == 2
    assert (None, "u", "Title here\n\nA body of some words, read whole.", 46 - 1) in got
    assert all(r[2] == "" and r[3] == 0 for r in got if r[0] in (1, 2, 3))
    assert extraction.extract(p.limit(0)).collect() == []
    few = extraction.extract(p.filter("page_id in (1, 2, 6)")).collect()
    assert len(few) == 3
