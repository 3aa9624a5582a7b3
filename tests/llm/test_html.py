import html as entities
import re

from plazaworks.llm.html import lines_of, main_text, smoothed, with_main_text

PAGE = """<!DOCTYPE html><html><head><title>No &amp; title</title><style>p{x:"</p>"}</style><script>var t="</p><article>no</article>";</script></head>
<body class="has-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this page work well for everyone who reads it.</div>
<main><article class="post ad-free"><header><h1>The   title
&amp; more</h1></header><p>First <b>bold</b> and <a href=x>linked</a> text&nbsp;here,<br>after a break.
<p>Second paragraph <span hidden>unseen</span>goes on <button>Press</button>to its end &lt;tag&gt; caf&eacute;.
<div class="ad">Buy this now, it is the best thing that money can buy anywhere.</div>
<ul><li>One<li>Two <em>2</em></ul><table><tr><td>a<td>b</table>
<aside>Related stories from elsewhere that go on and on and on.</aside><form><label>Mail <input></label></form>
<p>End.</p><section id="comments"><h2>Comments</h2><p>A reader wrote a very long comment here, longer than the text itself, on and on.</p></section></article></main>
<footer>&copy; all of it</footer>"""


def test_the_article_without_what_surrounds_it():
    assert main_text(PAGE).split("\n") == ["The title & more", "First bold and linked text here, after a break.", "Second paragraph goes on to its end <tag> café.", "One", "Two 2", "a", "b", "End."]


def test_pages_without_an_article():
    text = "<p>" + "A long paragraph of running text that goes on for quite a while. " * 4
    page = f"<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div>{text}{text}<p>Short.</div><div><a href=4>four</a><a href=5>five</a></div></body>"
    lines = main_text(page).split("\n")
    assert len(lines) == 3 and lines[2] == "Short." and lines[0].startswith("A long")
    assert main_text("just words\nand more") == "just words and more"


def test_odd_pages():
    assert [main_text(x) for x in (None, "", " \n ", "<p>", "<nav>menu</nav>", "<!-- a -- comment -->", "<script>x", "<")] == [""] * 7 + [main_text("<")]
    assert main_text("<article><p>a</b></i></p></div>b<p>c") == "a\nb\nc"
    assert main_text("<article><p>a &#x41;&#66;&bogus; &amp;amp;</p>") == "a AB&bogus; &amp;"
    assert main_text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert len(main_text("<article><p>" + "word " * 400_000)) == 400_000 * 5 - 1


def test_smoothing_keeps_the_mean_of_level_lines():
    import numpy as np

    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0)
    assert smoothed(np.array([0, 0, 9.0, 0, 0])).argmax() == 2
    assert [x.hidden for x in lines_of("<nav>a</nav><p>b")] == [True, False]


def test_frames(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None), (1, "u", PAGE, "x")], "page_id long, url string, html string, main_text string")
    out = with_main_text(df)
    assert out.columns == ["page_id", "url", "html", "main_text", "main_text_"]
    assert sorted(r.main_text_ for r in out.collect()) == ["", main_text(PAGE), main_text(PAGE)]
    assert with_main_text(df.limit(0)).count() == 0


def test_query_gives_the_articles_of_the_small_table(spark):
    from plazaworks.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in QUERIES["op2_html_main_text"](spark, folder).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", article))
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_containers_that_only_mention_a_part_keep_their_text():
    text = "A long paragraph of running text that goes on for quite a while, and then some more of it."
    for attrs in ('class="content has-sidebar"', 'id="page-with-nav"', 'class="post comments-open"', 'class="hentry category-social"', 'class="no-comments tag-ads"', 'class="contentSidebarWrap"', 'class="ad-free"'):
        for tag in ("div", "section", "x-part"):
            assert main_text(f"<body><{tag} {attrs}><article><p>{text}</article></{tag}><p>else") == text, (tag, attrs)
        assert main_text(f"<article {attrs}><p>{text}</article>") == text, attrs
        assert main_text(f"<body><div {attrs}><p>{text}</div>") == text, attrs


def test_names_never_hide_what_holds_an_article_or_the_whole_page():
    for outer in ("div", "x-part"):
        assert main_text(f"<{outer} class=widget><{outer} id=sidebar>aside<main><p>The text.</main></{outer}></{outer}>") == "The text."
        assert main_text(f"<{outer} class=widget><article><p>The text.<div class=ad>Buy</div></article></{outer}>") == "The text."
    # Hidden within the holder is what holds nothing, and an article that names itself a comment holds nothing either.
    assert main_text("<p>Text<div class=comments><article class=comment><p>No</article></div>") == "Text"
    assert main_text("<div class=comments><p>All there is <span class=social>here</span>.</div><nav>menu</nav>") == "All there is here."
    assert main_text("<nav><p class=x>menu</nav>") == ""
    assert main_text("<p>Text<div class=cookie-notice>a</div><div id=commentList>b</div><div class=post-comments>c</div><div class=sidebar2>d</div>") == "Text"


def test_wrappers_that_hold_most_of_the_page_hide_nothing():
    long = "A long paragraph of running text that goes on for quite a while, and then some more of it."
    menu = "<div><a href=1>one</a> <a href=2>two</a></div>"
    for start, end in (("<form action=x>", "</form>"), ("<div role=form>", "</div>"), ('<div class="sidebar">', "</div>"), ('<div id="widget">', "</div>"), ("<form><div class=newsletter>", "</div></form>")):
        assert main_text(f"<body>{menu}{start}<p>{long}<p>{long}<p>Short.{end}{menu}") == f"{long}\n{long}\nShort.", start
        assert main_text(f"<body>{start}<main><p>{long}</main>{end}") == main_text(f"<body>{start}<article><p>{long}</article>{end}") == long, start
    # A form beside or within the article goes, and comments go however long they are.
    assert main_text(f"<body><p>{long}<p>{long}<form><p>Your name, please, and then your address.</form>") == f"{long}\n{long}"
    assert main_text(f"<article><p>{long}<form><p>Your name, please.</form></article>") == long
    assert main_text(f"<body><div><p>{long}</div><div id=comments><form><p>{long}</form><div class=widget><p>{long}{long}{long}</div></div>") == long


def test_unclosed_tags_take_linear_time():
    import time

    def seconds(page):
        began = time.perf_counter()
        lines_of(page)
        return time.perf_counter() - began

    for part in ("<b>x</i>", "<p><b><i>y</p>", "<b><li>z", "<b>x</p></b><u>"):
        seconds(part * 500)
        small, large = (min(seconds("<p><div>" + "<i>" * 3 + part * n) for _ in range(3)) for n in (3000, 24000))
        assert large < 24 * small + 0.05, part


def test_markup_that_never_ends_takes_linear_time():
    import time

    def seconds(page):
        began = time.perf_counter()
        assert main_text(page).startswith("Text")
        return time.perf_counter() - began

    for broken in ("<a x x x ", '<a href="', "<!-- ", "</p ", "<![CDATA[", "<?x "):
        pages = ["<article><p>Text</p>" + broken + "y z " * n for n in (10_000, 80_000)]
        small, large = (min(seconds(page) for _ in range(2)) for page in pages)
        assert large < 24 * small + 0.1, broken
