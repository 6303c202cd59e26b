import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import column, pages_of
from pageloom.functions import text
from pageloom.functions.nodes import clean_text, sanitized_html
from pageloom.functions.selectors import select
from pageloom.operators.dom import with_dom
from pageloom.operators.extract import extract_list, extract_single, fields_of, page_links, rule_rows

DIRTY = """<main><style>h2 { margin: 0 }</style><h2>Harbour timetable</h2><p onmouseover="track(7)">Ferry leaves at noon</p>
<script async>load('tide')</script><iframe title="map"></iframe></main>"""


def one(spark, html, expression):
    return column(pages_of(spark, [(html, "https://e.com/")]), expression)[0]


CLEAN = [
    ("<section><em>Low tide</em><style>em { top: 1px }</style>\u200b<li>Pier four</li></section>", "Low tide Pier four"),
    ("<body><h3>Boat list</h3><noscript>turn it on</noscript></body>", "Boat list"),
    ("A<script>x</script>B", "AB"), ("A<b></b>B", "A B"), ("A</x>B", "AB"), ("A<!-- c -->B", "A B"),
    ("A <meta charset=x> B", "A B"), ("<form>all <b>gone</b></form>left", "left"), ("<title>T</title><nav>N</nav>", "T N"),
    ("<template>no</template><ruby>a<rt>no</rt></ruby>", "a"), ("x &lt;b&gt; &amp; &unknown; &#150; &#x41;", "x <b> & &unknown – A"),
    ("a  b", "a  b"), ("<p>a\t \tb\n\n\nc</p>", "a b\nc"), ("\x01:<b>\x01;</b>", ": ;"), ("", ""), (None, ""),
    ("<p>One<p>Two", "One Two"), ("cut <a href=\"x", "cut <a href=\"x"), ("A<script>x</script>\n\n<script>y</script>B", "A\nB"),
    ("<svg><title>t</title></svg><![CDATA[c]]>", "c"), ("a<br>b<br/>c", "a b c"), ("<p>&amp<b>&am", "& &am"),
]


def test_clean_text(spark):
    got = column(pages_of(spark, [(html, "u") for html, _ in CLEAN]), clean_text("dom"))
    assert dict(zip(CLEAN, got)) == {case: case[1] for case in CLEAN}


def test_clean_text_is_stable_on_its_own_output(spark):
    pages = pages_of(spark, [(DIRTY, "u"), ("<p>a  b<br>c</p>", "u")])
    once = column(pages, clean_text("dom"))
    again = column(pages_of(spark, [(t, "u") for t in once]), clean_text("dom"))
    assert once == again


def test_truncation(spark):
    got = one(spark, "x" * 250, clean_text("dom", 200))
    assert len(got) == 215 and got.endswith("... [TRUNCATED]")
    assert one(spark, "x" * 200, clean_text("dom", 200)) == "x" * 200


def test_sanitize(spark):
    got = one(spark, DIRTY, sanitized_html("dom"))
    for gone in ("<script", "<iframe", "<style", "onmouseover"):
        assert gone not in got
    assert "<h2>Harbour timetable</h2>" in got and "Ferry leaves at noon" in got


WRITTEN = [
    ('<a href="online.html" alt="One" title="x">t</a>', '<a title="x">t</a>'),
    ('<a class="online" rel="on x">t</a>', '<a class="online" rel="on x">t</a>'),
    ('<p id=b CLASS="z  y" a>t</p>', '<p a="" class="z y" id="b">t</p>'),
    ("<p title='say \"hi\"'>&lt;</p>", "<p title='say \"hi\"'>&lt;</p>"),
    ('<p title="a &amp; &quot;\'">x</p>', '<p title="a &amp; &quot;\'">x</p>'),
    ("<!DOCTYPE html><p>a<br>b<!--c--></p>", "<!DOCTYPE html>\n<p>a<br/>b<!--c--></p>"),
    ("<p>a<b>c", "<p>a<b>c</b></p>"), ("<pre>  </pre><p>  </p>", "<pre>  </pre><p> </p>"), ("<?x y?><p/>z", "<?x y?><p></p>z"),
    ("a<br>b<br/>c", "a<br/>b<br>c</br>"), ("<br></br>x</p>", "<br/>x"), ("<textarea> </textarea><!---->", "<textarea> </textarea><!-- -->"),
]


def test_written_html(spark):
    got = column(pages_of(spark, [(html, "u") for html, _ in WRITTEN]), sanitized_html("dom"))
    assert dict(zip(WRITTEN, got)) == {case: case[1] for case in WRITTEN}


def test_remove_images(spark):
    assert one(spark, "<p>a<img src=x></p>", sanitized_html("dom", True)) == "<p>a</p>"
    assert one(spark, "<p>a<img src=x></p>", sanitized_html("dom")) == '<p>a<img src="x"/></p>'


def test_refused_markup_is_null_and_harms_no_other_page(spark):
    pages = pages_of(spark, [("<p>a</p>", "u"), ("<![x y]]>", "u"), ("<p>b</p>", "u")])
    assert column(pages, clean_text("dom"))[::2] == ["a", "b"]


def test_mask_cards(spark):
    df = spark.createDataFrame([
        ("booked on 5500 0000 0000 0004, refunded to 3400-0000-0000-0090 today", "booked on [REDACTED_CREDIT_CARD], refunded to [REDACTED_CREDIT_CARD] today"),
        ("1" * 17, "1" * 17), ("1" * 13, "[REDACTED_CREDIT_CARD]"), ("é4111222233334444", "é4111222233334444"),
    ], "t string, e string")
    assert all(r.got == r.e for r in df.select("e", text.redact_cards("t").alias("got")).collect())


BOATS = """<ul id="fleet">
 <li class="boat"><b class="called">Tern</b><i class="fare">7 kr</i><a href="/boats/tern?day=1">seats</a></li>
 <li class="boat"><b class="called">Skua</b><i class="fare">9 kr</i><a href="/boats/skua?day=1">seats</a></li>
</ul>"""
BASE = "https://ferry.example/lines/north/today.html"


def test_extract_list(spark):
    fields = {"name": ".called", "price": ".fare", "link": "a::attr(href)", "none": ".x", "own": "::attr(class)"}
    rows = extract_list(pages_of(spark, [(BOATS, BASE)]), ".boat", fields, base=None).orderBy("item_no").collect()
    assert [tuple(r)[3:] for r in rows] == [
        ("Tern", "7 kr", "/boats/tern?day=1", None, "boat"), ("Skua", "9 kr", "/boats/skua?day=1", None, "boat")
    ]
    joined = extract_list(pages_of(spark, [(BOATS, BASE)]), ".boat", fields).orderBy("item_no").collect()
    assert [r["link"] for r in joined] == ["https://ferry.example/boats/tern?day=1", "https://ferry.example/boats/skua?day=1"]


def test_extract_single(spark):
    html = '<div class="product"><a href="../details.html">Details</a><img src="../../img.png"><p>Hello <b>World</b></p><i title=""></i></div>'
    fields = {"link": "a::attr(href)", "image": "img::attr(src)", "text": "p", "none": "h1", "empty": "i::attr(title)"}
    pages = pages_of(spark, [(html, "https://example.com/a/b/index.html"), ("", "u")])
    got = [tuple(r)[2:] for r in extract_single(pages, fields).orderBy("page_id").collect()]
    assert got[0] == ("https://example.com/a/details.html", "https://example.com/img.png", "HelloWorld", None, "")
    assert got[1] == (None,) * 5


TREE = """<div id="r" class="a b"><p>1</p><p class="x" data-k="v-1 w">2<b type="B">3</b></p><ul><li>4</li><li>5<ul><li>6</li></ul></li></ul><p>7</p></div>"""


@pytest.mark.parametrize("selector,texts", [
    ("p", ["1", "23", "7"]), ("#r > p.x b", ["3"]), ("div > b", []), (".a.b p:first-child", ["1"]), ("p:last-child", ["7"]),
    ("p:nth-child(2)", ["23"]), ("p + p", ["23"]), ("ul ~ p, b", ["3", "7"]), ("li li", ["6"]), ("ul > li > ul > li", ["6"]),
    ("[data-k^=v]", ["23"]), ("[data-k$='w']", ["23"]), ("[data-k*='-1 ']", ["23"]), ("[data-k~=w]", ["23"]), ("[data-k|=v]", ["23"]),
    ("[type=b]", ["3"]), ("p:not(.x)", ["1", "7"]), ("*:not([class]) > b", []), ("B", ["3"]), ("li:first-child", ["4", "6"]),
    ("[data-k='v-1 w']", ["23"]), ("body p", []),
])
def test_selectors(spark, selector, texts):
    from pageloom.functions.nodes import element_text

    found = F.transform(select(selector, F.col("dom")["els"]), lambda e: element_text(F.col("dom")["txt"], e))
    assert one(spark, TREE, found) == texts


@pytest.mark.parametrize("selector", ["p::before", "> p", "p >", "a:has(b)", ":nth-child(2n)", "", "p[", "a,,b"])
def test_other_selectors_are_refused(selector):
    from pageloom.functions.selectors import _read

    with pytest.raises(ValueError):
        _read(selector)


def test_links(spark):
    rows = page_links(pages_of(spark, [('<a href="x">A <b>b</b></a><a>no</a><a href="">e</a>', "https://e.com/d/")])).collect()
    assert [(r.link_no, r.href, r.text, r.target) for r in rows] == [
        (0, "x", "Ab", "https://e.com/d/x"), (1, "", "e", "https://e.com/d/")
    ]


def test_rules(spark):
    specs = spark.createDataFrame([("r", ".c", "title=.titleline > a, link=a::attr(href),junk,score=.score,title=h1")], "rule_id string, container string, fields string")
    assert fields_of(rule_rows(specs), "r") == (".c", {"title": "h1", "link": "a::attr(href)", "score": ".score"})


def test_worker_code_needs_no_package(spark):
    """The parse function is sent as code, not by module name."""
    from pyspark import cloudpickle
    from pageloom.operators import dom

    assert b"handle_starttag" in cloudpickle.dumps(dom._read_batch)
    assert with_dom(spark.createDataFrame([(1, "<p>")], "page_id int, html string")).count() == 1


def test_a_batch_is_handed_on_in_small_runs_of_pages(spark):
    """What a worker holds must not grow with the pages of a batch, or with their bytes."""
    import pyarrow as pa
    from pageloom.operators import dom

    small = [f"<p>{i}</p>" for i in range(1000)]
    large = ["<p>" + "x" * 700_000 + "</p>"] * 3
    html = pa.array([*small, None, *large, "<p>end"])
    runs = list(dom._read_batch(html))
    assert sum(map(len, runs)) == len(html) and max(map(len, runs)) == 128
    assert all(sum(len(x["s"]) for page in run.to_pylist() for x in page["txt"]) < 1 << 20 for run in runs)
    assert pa.concat_arrays(runs).to_pylist() == dom._read_pages(html.to_pylist()).to_pylist()
    assert list(dom._read_batch(html.slice(0, 0))) == []

    pages = spark.createDataFrame(list(enumerate(html.to_pylist())), "page_id int, html string").coalesce(1)
    both = with_dom(with_dom(pages), dom="again")
    rows = both.select("page_id", clean_text("dom").alias("x"), clean_text("again").alias("y")).collect()
    assert [(r.page_id, r.x) for r in rows[:1000]] == [(i, str(i)) for i in range(1000)] and rows[-1].x == "end"
    assert all(r.x == r.y for r in rows) and len(with_dom(pages).take(3)) == 3


# selectors by brute force over random trees

TAGS = ["div", "p", "b", "i"]


def random_html(rng, size):
    out, open_ = [], []
    for _ in range(size):
        if open_ and rng.random() < 0.45:
            out.append(f"</{open_.pop()}>")
        else:
            tag = rng.choice(TAGS)
            out.append(f'<{tag} class="{rng.choice("uvw")}">{rng.choice("xyz")}')
            if rng.random() < 0.9:
                open_.append(tag)
    return "".join(out)


def simple_match(e, part):
    tag, _, cls = part.partition(".")
    return (not tag or e.tag == tag) and (not cls or cls in e.classes)


def brute_match(els, e, steps):
    """Steps from the right: [(compound, combinator before it)]."""
    (part, combinator), rest = steps[0], steps[1:]
    if not simple_match(e, part):
        return False
    if not rest:
        return True
    others = {
        " ": lambda a: a.i < e.i <= a.last, ">": lambda a: a.i == e.parent,
        "~": lambda a: a.parent == e.parent and a.i < e.i, "+": lambda a: a.parent == e.parent and a.nth == e.nth - 1,
    }[combinator]
    return any(others(a) and brute_match(els, a, rest) for a in els)


def read_steps(selector):
    tokens = selector.replace(">", " > ").replace("~", " ~ ").replace("+", " + ").split()
    steps, combinator = [], ""
    for t in tokens:
        if t in (">", "~", "+"):
            combinator = t
        else:
            steps.append((t, combinator or " "))
            combinator = ""
    return steps[::-1]


SELECTORS = ["div b", "div p b", "p.u i", "b ~ i", "div ~ p b", "div b ~ .v", "div > p ~ b i", "p + b i", ".u .v .w", "div ~ div ~ div", "i b + p"]


def test_selectors_by_brute_force(spark):
    rng = random.Random(8)
    pages = pages_of(spark, [(random_html(rng, n), "http://e.com/") for n in [0, 1, 5, 40, 90, 150, 150, 200]])
    els = column(pages, F.col("dom")["els"])
    got = pages.orderBy("page_id").select(*[
        F.transform(select(s, F.col("dom")["els"]), lambda e: e["i"]).alias(f"s{k}") for k, s in enumerate(SELECTORS)
    ]).collect()
    assert any(len(x) > 3 for row in got for x in row)
    for row, page in zip(got, els):
        for s, found in zip(SELECTORS, row):
            assert found == [e.i for e in page if brute_match(page, e, read_steps(s))], s


def test_records_of_nested_items_by_brute_force(spark):
    rng = random.Random(9)
    pages = pages_of(spark, [(random_html(rng, n), "http://e.com/") for n in [3, 60, 120, 200]])
    fields = {"f0": "b", "f1": "div .u", "f2": "p ~ i::attr(class)"}
    got = {(r.page_id, r.item_no): (r.f0, r.f1, r.f2) for r in extract_list(pages, "div, p", fields).collect()}
    want = {}
    for page_id, (els, txt) in enumerate(pages.orderBy("page_id").select("dom.els", "dom.txt").collect()):
        text = lambda e: "".join(t.s.strip() for t in txt[e.t0:e.t0 + e.tn])
        for no, item in enumerate(e for e in els if e.tag in ("div", "p")):
            row = []
            for spec in fields.values():
                steps = read_steps(spec.split("::")[0])
                found = [e for e in els if item.i < e.i <= item.last and brute_match(els, e, steps)]
                row.append((found[0].attrs["class"] if "::" in spec else text(found[0])) if found else None)
            want[page_id, no] = tuple(row)
    assert got == want and len(got) > 50


@pytest.mark.parametrize("html", ["<ul>" + "<li><b>x</b></li>" * 50_000 + "</ul>", "<li><b>" * 50_000])
def test_large_pages_take_linear_time(spark, html):
    pages = pages_of(spark, [(html, "http://e.com/")]).cache()
    pages.count()
    begin = time.time()
    assert column(pages, F.size(select("li b, li ~ li, ul b", F.col("dom")["els"]))) >= [50_000]
    extract_list(pages, "li", {"x": "b::attr(href)", "y": "li ~ li b"}).agg(F.count("x"), F.count("y")).collect()
    assert time.time() - begin < 40  # each would take many minutes if items were tested pair by pair
    pages.unpersist()
