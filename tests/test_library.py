"""Pages of cards and details, texts, validation and lookups by known values."""

import pytest
from pyspark.sql import functions as F

from plazaworks.functions import geo, text
from plazaworks.operators import chat, filters, library, mutations, validation

L = F.lit
ORIGIN = "https://library.example"
CARDS = """<nav><a href="/kat/biblioteka-innowacji-spolecznych/dla-seniorow">all</a></nav>
<div class="news-list__item"><a HREF="/kat/dla-seniorow,lampa?x=1" class="news-list__title">Lampa &amp; cień</a>
 <div class="news-list__desc"><p>Lampa, kt&#243;ra świeci.</p><p>Druga linia</p><p>Zobacz film</p><p>Zobacz też inne</p><p>nie to</p><table>
 <a href="https://cdn.example/a/Lampa.PDF?v=2">x</a><a href="//youtu.be/1"></a><a href="/z/lampa.zip#top"></a><a href="https://creativecommons.org/licenses/by-sa/4.0/">l</a>
 <a href="/kat/biblioteka-innowacji-spolecznych/dla-seniorow/">up</a><a href="#x"></a><a href="mailto:a@b.c"></a><a href="/z/lampa.zip#top"></a>
 <img src="/i/iKONY_na_www/play.png"><img src="/i/kod.png"></table></div></div>
<div class="news-list__item"><a href="/kat/dla-seniorow,lampa">again</a></div>
<div class="news-list__item"><a href="/kat/inne,x">other category</a></div>
<div class="news-list__item"><a href="dla-seniorow,bez-opisu/">&nbsp;</a> <div class="m-publications"><img src="/i/publications.png"></div></div>"""
DETAIL = """<h2 class="page-title"> Lampa <b>nocna</b></h2><div class="text-content"><p>Wstęp &lt;1&gt;</p><p>Pobierz materiały tutaj</p><p>Dowiedz się</p>
<ul><li>raz</li><li>dwa</li></ul><h4 class=x>1. Co to?</h4><p>Światło &#x2600;.</p><p>Drukuj</p><h4>2. Puste</h4><p> </p><h4>bez końca <p>x</p><h4>3. Dla kogo</h4><p>Dla   wszystkich.<br>I każdego.</p>
<a href="/l/a.zip">z</a><a href="https://creativecommons.org/licenses/by-nc/4.0/">l</a></div><h2>Inne</h2><h4>Nie</h4><p>to</p>"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cards(spark):
    df = spark.createDataFrame([("dla-seniorow", CARDS), ("dla-seniorow-2", "nothing"), ("x", None)], "category string, html string")
    cards = {r.slug: r for r in library.category_cards(df, ORIGIN).collect()}
    assert set(cards) == {"dla-seniorow,lampa", "dla-seniorow,bez-opisu"}
    card = cards["dla-seniorow,lampa"]
    assert (card.n, card.title, card.summary, card.page_url) == (0, "Lampa & cień", "Lampa, która świeci. Druga linia", f"{ORIGIN}/kat/dla-seniorow,lampa?x=1")
    links = [(x.kind, x.url, x.label) for x in card.links]
    assert links[:5] == [
        ("zip", f"{ORIGIN}/z/lampa.zip#top", "pobierz materiały"), ("video", "https://youtu.be/1", "film"), ("pdf", "https://cdn.example/a/Lampa.PDF?v=2", "Lampa.PDF"),
        ("licence", "https://creativecommons.org/licenses/by-sa/4.0/", "zasady wykorzystania"), ("qr", f"{ORIGIN}/i/kod.png", "otwórz w telefonie (kod QR)"),
    ]
    # The card's own address is its page, and one address is one link.
    assert links[5:] == [("page", f"{ORIGIN}/kat/dla-seniorow,lampa?x=1", "strona innowacji")]
    bare = cards["dla-seniorow,bez-opisu"]
    assert (bare.title, bare.summary, [x.kind for x in bare.links]) == ("dla-seniorow,bez-opisu", "", ["page"])


def test_details(spark):
    df = spark.createDataFrame([("/kat/lampa", DETAIL), ("u", "no parts"), ("n", None)], "url string, html string")
    rows = {r.url: r for r in library.detail_pages(df, ORIGIN).collect()}
    page = rows["/kat/lampa"]
    assert (page.title, page.intro, page.licence, page.zip_url) == ("Lampa nocna", "Wstęp <1>\n- raz\n- dwa", "CC BY-NC 4.0", f"{ORIGIN}/l/a.zip")
    assert [tuple(x) for x in page.sections] == [("1. Co to?", "Światło ☀."), ("3. Dla kogo", "Dla wszystkich.\nI każdego.\n\nzl")]
    assert [(x.kind, x.url) for x in page.links] == [("zip", f"{ORIGIN}/l/a.zip"), ("licence", "https://creativecommons.org/licenses/by-nc/4.0/"), ("page", f"{ORIGIN}/kat/lampa")]
    for url in ("u", "n"):
        assert (rows[url].title, rows[url].intro, rows[url].sections, rows[url].licence, [x.kind for x in rows[url].links]) == ("", "", [], None, ["page"])


@pytest.mark.parametrize("html,wanted", [
    ("a<br>b<br/>c</p>d</div>e", "a\nb\nc\nd\ne"), ("<ul><li>x</li><li> y </li></ul>", "- x\n\n- y"), ("  a \t b&nbsp;c ", "a b c"), ("a</p></p></p></p>b", "a\n\nb"), ("</p>a</p>", "a"),
    ("&amp;lt; &lt;p&gt; &quot;&apos;&#39; &#233;&#xE9;&#X1F600;", "&lt; <p> \"'' éé😀"), ("&bogus; &#xD800; &#0; &#1114112; &; & ;", "&bogus; &#xD800; &#0; &#1114112; &; & ;"), ("&averylongnameindeed; &amp", "&averylongnameindeed; &amp"),
    ("x</p>Powrót</p>»Drukuj«</p>Zobacz film!</p>Zobacz filmy", "x\nZobacz filmy"), ("", ""), ("<p", ""), ("a > b", "a  b".replace("  ", " ")),
])
def test_text_of_pages(spark, html, wanted):
    assert one(spark, text.page_text(L(html))) == wanted


def test_boxes_are_read(spark):
    box = lambda x: one(spark, geo.box_of(L(x).cast("string")))
    assert tuple(box("19, 49.5 ,21,50")) == (49.5, 19.0, 50.0, 21.0)
    assert [box(x) for x in ("19,49,21", "19,49,21,x", "19,49,21,50,1", "", "19,49,21,NaN", "19,49,21,Infinity", None)] == [None] * 7


def test_validation(spark):
    nan, inf, none = float("nan"), float("inf"), None
    error = lambda lat, lon, capacity, kind, emoji="☕": one(spark, validation.event_error(L(lat).cast("double"), L(lon).cast("double"), L(capacity).cast("int"), L(kind).cast("string"), L(emoji).cast("string")))
    assert [error(50, 20, none, "cafe"), error(50, 20, 1, "park"), error(nan, 20, 0, "x"), error(50, -inf, 1, "park"), error(none, 20, 1, "park")] == [none, none, "coordinates", "coordinates", "coordinates"]
    assert [error(50, 20, 0, "home"), error(50, 20, -3, "cafe"), error(50, 20, 3, "home"), error(50, 20, 3, none), error(50, 20, 3, "hall", "ab")] == ["capacity", "capacity", "kind", "kind", "emoji"]
    single = {"☕": True, " ☕ ": True, "👩‍👩‍👧": True, "🇵🇱": True, "é": True, "👍🏽": True, "a": True, "ab": False, "☕☕": False, "": False, " ": False, None: False}
    assert {x: one(spark, validation.single_grapheme(L(x).cast("string"))) for x in single} == single
    assert [one(spark, validation.history_limit(L(x).cast("long"))) for x in (None, 7, 0, -1)] == [3, 7, None, None]


def test_addresses_of_users(spark):
    known = {" Ann.B@Example.ORG\n": "ann.b@example.org", "a@b.c": "a@b.c", "a@b": None, "@b.c": None, ".a@b.c": None, "a.@b.c": None, "a@.b.c": None, "a@b.c.": None, "a@b@c.d": None, "a b@c.d": None, "é@b.c": None, "a" * 65 + "@b.c": None, "a" * 64 + "@b.c": "a" * 64 + "@b.c", "": None, None: None}
    assert {x: one(spark, filters.normalised_email(L(x).cast("string"))) for x in known} == known
    users = spark.createDataFrame([(1, "a@b.c"), (2, None)], "id int, email string")
    assert [r.id for r in filters.by_email(users, " A@B.C ").collect()] == [1] and filters.by_email(users, "none").count() == 0


def test_forgetting_a_topic(spark):
    memories = spark.createDataFrame([(3, "tea", "green", None), (1, "pet", "TEAcup pig", None), (2, "pet", "dog", "he said tea"), (4, "pet", None, None)], "id int, key string, value string, quote string")
    tags = spark.createDataFrame([("tea time",), ("walks",), (None,)], "tag string")
    gone, left, gone_tags, left_tags = mutations.forget_topic(memories, tags, " Tea ")
    assert [r.id for r in gone.collect()] == [1, 2, 3] and [r.id for r in left.collect()] == [4] and [r.tag for r in gone_tags.collect()] == ["tea time"] and left_tags.count() == 2
    gone, left, gone_tags, left_tags = mutations.forget_topic(memories, tags, "  ")
    assert gone.count() == gone_tags.count() == 0 and left.count() == 4 and left_tags.count() == 3
    assert mutations.forget_topic(memories, tags, "%")[0].count() == 0


def test_chat_search(spark):
    rows = [(1, 7, "a market", 5), (2, 7, "markets and more", 4), (3, 7, "Supermarket", 3), (4, 8, "the market", 1), (5, 7, "nothing", 2), (6, 7, None, 9), (7, 7, "MARKET", 6)]
    df = spark.createDataFrame(rows, "id long, user_id long, body string, created long")
    # Whole words are the most alike; of equal ones the older comes first.
    assert [r.id for r in chat.search(df, " market ", 7).collect()] == [1, 7, 2, 3]
    assert [r.id for r in chat.search(df, "Market").collect()] == [1, 7, 2, 3, 4] and chat.search(df, "  ").count() == 0 == chat.search(df, "m%t").count()


def test_appended_ids_ascend_after_the_largest(spark):
    old, new = spark.createDataFrame([(5, "x"), (9, "y")], "id long, body string"), spark.createDataFrame([(k, f"b{k:03}") for k in range(200)], "id long, body string").repartition(5)
    ids = [r.id for r in mutations.appended(old, new, ["body"]).orderBy("body").collect()]
    assert ids == sorted(set(ids)) and len(ids) == 200 and ids[0] == 10
    assert mutations.appended(old.limit(0), new.limit(1), ["body"]).first().id == 1 and mutations.appended(old, new.limit(0), ["body"]).count() == 0


def test_paths_are_resolved_from_both_ends(spark):
    files = {1: [f"pack{k}/readme.txt" for k in range(50)] + ["Docs/Raport kon cowy.pdf", "a/b.txt", "Docs/A  b.PDF", "deep/er/x.doc", "x.doc"], 2: ["only.txt"], 3: ["A.txt", "a.TXT", "c d.txt"], 4: []}
    asked = {
        1: ["readme.txt", "pack7/README.txt", "ocs/raportkoncowy.pdf", "raport koncowy.pdf", '"a/b.txt"', " zip/a/b.txt ", "a b.pdf", "ocs/a b.pdf", "x.doc", "er/x.doc", "none", "readme.txt", ".pdf", "", "my/x.doc", None],
        2: ["", "ly.t xt", '""', "the only.txt", "only.txt.bak"], 3: ["a.txt", "A.txt", "z/a.txt", "d.txt"], 4: ["x"], 5: ["x"],
    }
    wanted = {
        (1, "pack7/README.txt"): "pack7/readme.txt", (1, "ocs/raportkoncowy.pdf"): "Docs/Raport kon cowy.pdf", (1, "raport koncowy.pdf"): "Docs/Raport kon cowy.pdf", (1, '"a/b.txt"'): "a/b.txt", (1, " zip/a/b.txt "): "a/b.txt",
        (1, "a b.pdf"): "Docs/A  b.PDF", (1, "ocs/a b.pdf"): "Docs/A  b.PDF", (1, "x.doc"): "x.doc", (2, ""): "only.txt", (2, '""'): "only.txt", (2, "ly.t xt"): "only.txt", (2, "the only.txt"): "only.txt", (3, "A.txt"): "A.txt", (3, "d.txt"): "c d.txt",
        (1, "my/x.doc"): "x.doc",
    }
    entries = spark.createDataFrame([(k, p) for k, ps in files.items() for p in ps], "doc int, path string")
    found = library.resolved_paths(spark.createDataFrame([(k, p) for k, ps in asked.items() for p in ps], "doc int, asked string"), entries, ["doc"])
    rows = {(r.doc, r.asked): r.path for r in found.collect()}

    def plain(k, path):
        want = path.strip().strip('"')
        if want in files.get(k, []):
            return want
        fold = lambda x: "".join(x.split()).lower()
        fits = [p for p in files.get(k, []) if fold(p).endswith(fold(want)) or fold(want).endswith(fold(p))]
        return fits[0] if len(fits) == 1 else None

    assert rows == wanted == {(k, p): x for k, ps in asked.items() for p in ps if p is not None and (x := plain(k, p))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    known = spark.createDataFrame([(k, p, files[k]) for k in (1, 2, 3, 4) for p in asked[k] if p is not None], "doc int, asked string, known array<string>")
    assert {(r.doc, r.asked) for r in known.filter(library.names_one(F.col("asked"), F.col("known"))).collect()} == wanted.keys()
