import html as h
import random
import re
from collections import Counter
from functools import reduce

from pyspark.sql import functions as F

from lodestead.llm import html_wrappers, registry
from lodestead.llm.html_wrappers import aligned, expression, merged, parsed, stream

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, parts=3):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {r.page_id: r.text for r in html_wrappers.main_text(pages).collect()}


def wrapper(*pages):
    return expression(reduce(merged, [html_wrappers.page(stream(parsed(x))) for x in pages]))


def test_query_on_the_table(spark, sf):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = registry.queries()["op6_html_wrappers"](spark, sf).collect()
    assert Counter(r.page_id for r in found) == Counter(source.keys())
    for r in found:
        inside = re.search(r"<article>(.*?)(</article>|<footer>|$)", source[r.page_id], re.DOTALL)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|div)[^>]*>", " ", inside))
        assert r.text == " ".join(h.unescape(plain).split()) and r.n_chars == len(r.text)


def generated(seed):
    """(pages of three hosts, texts): no element says what it is for; menus, notices and ends of a host are all the same."""
    r = random.Random(seed)
    sentence = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))
    rows, expected = [], {}
    for host in range(3):
        menu = "".join(f"<li><a href='/{k}'>{sentence(1)}</a></li>" for k in range(r.randint(3, 8)))
        name, end = sentence(2), f"<div><p>{sentence(9)}</p><p>{sentence(3)}</p></div>"
        for k in range(r.randint(40, 170)):
            blocks = [sentence(r.randint(1, 40)) for _ in range(r.randint(1, 9))]
            table_ = [[sentence(1) for _ in range(2)] for _ in range(r.randint(0, 3))]
            body = f"<h2>{blocks[0]}</h2>" + "".join(f"<p>{x}" for x in blocks[1:])
            if table_:
                body += "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in table_) + "</table>"
            notice = f"<div><p>{name} {name}</p></div>" if k % 5 else ""
            page_id = 1000 * host + k
            rows.append((page_id, f"https://h{host}.example/{k}", f"<html><body><div>{name}</div><div><ul>{menu}</ul></div>{notice}<div>{body}</div>{end}</body></html>"))
            expected[page_id] = " ".join([*blocks, *[x for row in table_ for x in row]])
    return rows, expected


def test_hosts_without_telling_names(spark):
    rows, expected = generated(5)
    assert texts(spark, rows) == expected
    # The layout of the input and repeated rows change nothing.
    assert texts(spark, rows, 1) == texts(spark, rows[::-1] + rows[:50] * 3, 40) == expected


def test_zones(spark):
    zone = lambda k: f"<div class=zone-a><ul><li>Home<li>News</ul></div><div class=zone-b>story {k}</div><div class=zone-c>Copyright Example Ltd. All rights reserved.</div>"
    same = lambda k: zone(k).replace("zone-b", "zone").replace("zone-a", "zone").replace("zone-c", "zone")
    for one in (zone, same):
        assert texts(spark, [(k, "http://h/x", one(k)) for k in range(4)]) == {k: f"story {k}" for k in range(4)}
    # Two pages, or copies of one, are no evidence.
    assert texts(spark, [(k, "http://h/x", zone(k % 2)) for k in range(8)])[1] == "Home News story 1 Copyright Example Ltd. All rights reserved."


def test_menus_that_vary(spark):
    page_ = lambda k: "<div class=q>" + "".join(f"<b><a href=/{j}>link {k} {j}</a></b> " for j in range(3 + k % 2)) + f"</div><div class=r><p>See <a href=/z>this {k}</a> and more</p></div>"
    assert texts(spark, [(k, "http://h/x", page_(k)) for k in range(5)]) == {k: f"See this {k} and more" for k in range(5)}


def test_headers(spark):
    rows = [(1, "http://a", "<header>My Site Name</header><div>one</div>"), (2, "http://b", "<article><header><h1>Title</h1></header><p>x</p></article>")]
    rows += [(3, "http://c", "<header><h1>Title</h1></header><div>three</div>"), (4, "http://d", "<header><h1>Site</h1></header><article><h2>Title</h2>four</article>")]
    assert texts(spark, rows) == {1: "one", 2: "Title x", 3: "Title three", 4: "Title four"}


def test_all_parts_of_an_article(spark):
    rows = [(k, "http://a/x", f"<nav>Menu</nav><article><p>first {k}</p></article><article><p>second {k}</p></article>") for k in range(4)]
    rows += [(10, "http://b", "<article>Area <math><mi>r</mi><mo>=</mo><mn>2</mn></math><p class='social-history'>Of cities</p><p id='ad-hoc'>Made at once</p></article>")]
    rows += [(11, "http://c", "<div>" * 150 + "<nav>Menu</nav>deep" + "</nav>" * 3 + "</div>" * 150 + "<p>end</p>")]
    assert texts(spark, rows) == {k: f"first {k} second {k}" for k in range(4)} | {10: "Area r=2 Of cities Made at once", 11: "deep end"}


def page(body, side="<aside class='sidebar'>Side</aside>"):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body><div id=top><ul class=menu><li>Home<li>News</ul></div><div class='cookie-banner'>Cookies!</div>{body}{side}<div class='footer'>Foot</div></body></html>"


def test_templates_without_article():
    bodies = [page(f"<div class='post-body'><h2>Title {k}</h2><p>Text &amp; more {k}<p>Second&nbsp;one {k}{'<p>third' * (k % 2)}<form><input></form><div class='comments'><p>Nice {k}</div></div>") for k in range(3)]
    assert wrapper(*bodies) == "<html><body><div.body.post><h2>#</h2>(<p>#</p>)+</div></body></html>"
    assert [html_wrappers.extract(b) for b in bodies] == [f"Title {k} Text & more {k} Second one {k}{' third' * (k % 2)}" for k in range(3)]


def test_optional_and_repeated_groups():
    text = wrapper("<div><h1>a</h1><p>x</p><dl><dt>k</dt><dd>v</dd><dt>l</dt><dd>v</dd></dl></div>", "<div><h1>b</h1><table><tr><td>1</td></tr></table><p>y</p><p>z</p><dl><dt>m</dt><dd>v</dd></dl></div>")
    assert text == "<div><h1>#</h1>(<table><tr><td>=</td></tr></table>)?(<p>#</p>)+<dl>(<dt>#</dt>)+(<dd>=</dd>)+</dl></div>"
    # Without a mismatch there is no repetition: neighbours keep their places, and texts their own votes.
    assert wrapper("<ul><li>Home<li>News</ul><p>a", "<ul><li>Home<li>News</ul><p>b") == "<ul><li>=</li><li>=</li></ul><p>#</p>"
    assert aligned([], [], True) == []


def test_wrappers_survive_the_shuffle():
    whole = reduce(merged, [html_wrappers.page(stream(parsed(x))) for _, _, x in generated(6)[0][:30]])
    assert html_wrappers.unpacked(html_wrappers.packed(whole)) == whole


def test_repeated_teasers_are_not_the_article():
    teasers = "".join(f"<article><h3>t{k}</h3></article>" for k in range(5))
    assert html_wrappers.extract(page(f"<div class=content><p>{'long text ' * 30}</p></div><div class=list>{teasers}</div>")) == ("long text " * 30).strip()


def test_page_edges(spark):
    rows = [(1, "http://a.b/x", None), (2, None, "<article>one<br>two <b>th</b>ree</article>"), (2, None, "<article>one<br>two <b>th</b>ree</article>"), (None, "junk", "<p>cut <b>off"), (3, "http://a.b/y", ""), (4, "http://a.b", "a < b &lt; c &unknown; &#233;"), (6, "http://a.b", "<script>var a='</p>'"), (7, "http://a.b", "<article><p>x</p><!-- never closed <p>y</p>")]
    deep = [(100 + k, "http://deep", "<div>" * 30000 + f"deep {k}" + "</div>" * 9 + "</p>" * 30000) for k in range(4)]
    long = [(200 + k, "http://long", "<div>" + "".join(f"<p>w{j} {k}</p>" + "<ul><li>x</ul>" * (j % 3) for j in range(20000 + k)) + "</div>") for k in range(3)]
    pages = spark.createDataFrame(rows + deep + long, SCHEMA)
    found = Counter((r.page_id, r.text) for r in html_wrappers.main_text(pages.select("*", *[F.lit("x").alias(c) for c in ("host", "bucket", "stream", "wrapper", "texts", "lists", "n_chars", "text")])).collect())
    expected = Counter({(1, ""): 1, (2, "one two three"): 2, (None, "cut off"): 1, (3, ""): 1, (4, "a < b < c &unknown; é"): 1, (6, ""): 1, (7, "x"): 1}) + Counter((i, t) for i, t in ((100 + k, f"deep {k}") for k in range(4)))
    assert found - expected == Counter({x: 1 for x in found if x[0] and x[0] >= 200}) and not expected - found
    for i, text in found:
        if i and i >= 200:
            assert [x for x in text.split() if x != "x"] == [x for j in range(20000 + i - 200) for x in (f"w{j}", str(i - 200))]
    assert html_wrappers.main_text(pages.limit(0)).collect() == []


def test_words_in_names_are_no_verdict(spark):
    wrap = lambda name, k: f"<html><body class='has-sidebar'><{name}><h2 id='related-work'>Related {k}</h2><section id='social-media'><p>Net {k}</p></section><p>At <span class='share-price'>{k} EUR</span></p><div id='search-results'>Found {k}</div><div class='share-this-page'>Tell others</div><div class='cookie-banner'>Cookies</div></{name.split()[0]}></body></html>"
    names = ["main class='with-sidebar'", "article class='comment-open'", "div id='x'"]
    rows = [(10 * j + k, f"http://h{j}/{k}", wrap(name, 10 * j + k)) for j, name in enumerate(names) for k in range(4)]
    rows += [(100, "http://once", wrap(names[1], 100))] * 4
    found = html_wrappers.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    # A doubtful element goes only where different pages of the host say the same in it; copies of one page say nothing.
    assert sorted((r.page_id, r.text) for r in found) == sorted((i, f"Related {i} Net {i} At {i} EUR Found {i}" + " Tell others" * (i == 100)) for i, _, _ in rows)


def test_the_article_holds_all_text(spark):
    def extracted(*bodies):
        found = texts(spark, [(k, "http://h/x", page(b)) for k, b in enumerate(bodies)])
        return [found[k] for k in range(len(bodies))]

    assert extracted("<div class=page><div class=intro>" + "in " * 60 + "</div><div class=text>" + "tx " * 40 + "</div></div>") == ["in " * 60 + ("tx " * 40).strip()]
    assert extracted("<div class=a><h1>Title</h1><p>Lead</p><div class=b><p>" + "b " * 99 + "</p></div></div>") == ["Title Lead " + ("b " * 99).strip()]
    sections = "".join(f"<div class=part><div class=text><p>part {k}</p></div></div>" for k in range(3))
    assert extracted(sections, sections) == ["part 0 part 1 part 2"] * 2
    assert extracted("<div class=x hidden>Not shown</div><p>one</p>", "<div class=x>Shown</div><p>two</p>") == ["one", "Shown two"]
    # A front page with teasers beside text, and a page whose only article is the text.
    front = "<div class=content>" + "front " * 30 + "</div><article><p>t1</p></article><article><p>t2</p></article>"
    assert extracted(front, "<div class=content>intro</div><article><p>one article</p></article>") == [("front " * 30).strip(), "intro one article"]
