"""Building the document library: merging cards, links, chunks, validation of briefs, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plazaworks.functions.text import absolute_url, classify_href, decoded_references, licence_name, link_rank, page_text

#: Fields of a brief. Writers answer with these.
BRIEF_FIELDS = ("summary", "problem", "how_it_works", "audience", "who_can_use", "evidence", "authors")
BRIEF_SCHEMA = ", ".join(f"{f} string" for f in ("knowledge_text", *BRIEF_FIELDS)) + ", files_read array<string>"


def merged_cards(cards: DataFrame) -> DataFrame:
    """Cards (slug, seq, category, summary) by slug: categories in order of appearance, the longest summary, the first among equals."""
    # By category first, so that a slug's list has one entry for each, however many cards it has.
    parts = cards.groupBy("slug", "category").agg(F.min(F.struct("seq", "category")).alias("first"), F.max(F.struct(F.octet_length("summary").alias("size"), (-F.col("seq")).alias("order"), "summary")).alias("best"))
    named = F.transform(F.array_sort(F.collect_list("first")), lambda x: x["category"])
    return parts.groupBy("slug").agg(F.max("best")["summary"].alias("summary"), F.array_join(named, ",").alias("categories"))


#: Kinds of links in the order of their rank; all others are "other". Fixed values.
LINK_KINDS = ("zip", "video", "pdf", "licence", "qr", "page")


def _link_kind(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, LINK_KINDS)), rank), F.lit("other"))


def deduped_links(links: DataFrame, owner: str) -> DataFrame:
    """Links (owner, kind, url) once for each address, by kind and address, with their place in that order. Unknown kinds are "other"."""
    # The kind's rank, a number, keeps the aggregate hashed.
    once = links.groupBy(owner, "url").agg(F.min(link_rank(F.col("kind"))).alias("rank"))
    return once.select(owner, "url", _link_kind(F.col("rank")).alias("kind"), F.row_number().over(W.partitionBy(owner).orderBy("rank", "url")).alias("n"))


def merged_links(links: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """Links of all cards of an owner, the first one of each address, numbered in the order in which they come."""
    first = links.withColumn("_n", F.row_number().over(W.partitionBy(owner, "url").orderBy(*order))).filter("_n = 1")
    return first.withColumn("n", F.row_number().over(W.partitionBy(owner).orderBy(*order))).drop("_n")


def links_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('(?i)href="([^"]*)"'), F.lit(1))


def images_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('(?i)src="([^"]*)"'), F.lit(1))


def _file_name(url: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), -1), F.lit(""))


#: Categories of the library, their index pages' folder, and labels of links. The site's own.
CATEGORIES = (
    "dla-seniorow", "dla-dzieci-mlodziezy-i-rodziny", "dla-osob-o-ograniczonej-mobilnosci", "dla-osob-z-niepelnosprawnoscia-sensoryczna",
    "dla-zdrowia-i-medycyny", "dla-rynku-pracy", "dla-cudzoziemcow", "dla-osob-w-kryzysie-bezdomnosci", "dla-osob-z-niepelnosprawnoscia-intelektualna",
)
INDEX = "/biblioteka-innowacji-spolecznych/"
LABELS = {"video": "film", "zip": "pobierz materiały", "licence": "zasady wykorzystania", "page": "strona innowacji", "qr": "otwórz w telefonie (kod QR)"}


def page_links(html: Column, origin: str) -> Column:
    """Links of a part of a page, an array of (kind, url, label): addresses, then pictures, which are codes to scan unless they are icons.

    Addresses that lead nowhere and index pages of categories are left out.
    """
    index = "(" + "|".join(CATEGORIES) + ")/*$"

    def link(url: Column, kind: Column) -> Column:
        label = F.lit(None).cast("string")
        for name, text in LABELS.items():
            label = F.coalesce(label, F.when(kind == name, text))
        named = F.coalesce(label, decoded_references(_file_name(url)), F.when(kind == "pdf", "pdf").otherwise("odnośnik"))
        return F.struct(kind.alias("kind"), url.alias("url"), named.alias("label"))

    hrefs = F.filter(F.transform(links_of(html), lambda x: absolute_url(x, origin)), lambda x: x.isNotNull() & ~x.rlike(INDEX + index))
    images = F.filter(F.transform(F.filter(images_of(html), lambda x: ~x.contains("iKONY")), lambda x: absolute_url(x, origin)), lambda x: x.isNotNull())
    return F.concat(F.transform(hrefs, lambda x: link(x, classify_href(x))), F.transform(images, lambda x: link(x, F.lit("qr"))))


def ordered_links(links: Column) -> Column:
    """By kind and address, each address once."""
    ranked = F.array_sort(F.transform(links, lambda x: F.struct(link_rank(x["kind"]).alias("rank"), x["url"].alias("url"), x["kind"].alias("kind"), x["label"].alias("label"))))
    urls = F.transform(ranked, lambda x: x["url"])
    firsts = F.filter(ranked, lambda x, i: F.array_position(urls, x["url"]) == i + 1)
    return F.transform(firsts, lambda x: F.struct(x["kind"].alias("kind"), x["url"].alias("url"), x["label"].alias("label")))


def _page_link(url: Column) -> Column:
    return F.array(F.struct(F.lit("page").alias("kind"), url.alias("url"), F.lit(LABELS["page"]).alias("label")))


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark; null without it."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + len(mark)))


def _summary(html: Column) -> Column:
    """Lines of a card's description joined until one that leads elsewhere, or until more than 280 characters."""
    part = F.coalesce(_after(html, 'news-list__desc">'), F.lit(""))
    table = F.instr(part, "<table")
    lines = F.filter(F.transform(F.split(page_text(F.when(table > 0, F.substr(part, F.lit(1), table - 1)).otherwise(F.substring(part, 1, 1500))), "\n"), F.trim), lambda x: x != "")
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

    def add(state: Column, line: Column) -> Column:
        leads = F.lower(line).rlike("^(innowacja wybrana|dowiedz|zobacz|pobierz)")
        text = F.when(state["text"] == "", line).otherwise(F.concat(state["text"], F.lit(" "), line))
        ended = state["done"] | leads
        return F.struct(F.when(ended, state["text"]).otherwise(text).alias("text"), (ended | (F.length(text) > 280)).alias("done"))

    return F.aggregate(lines, start, add, lambda state: state["text"])


def category_cards(pages: DataFrame, origin: str, category: str = "category", html: str = "html") -> DataFrame:
    """(category, n, slug, title, summary, page_url, links) of each card on category pages, the first of each slug, in page order.

    A card runs to the next, the last one to the list of publications or the
    footer. Those without an address of the category are left out.
    """
    parts = pages.select(F.col(category).alias("category"), F.posexplode(F.slice(F.split(html, 'class="news-list__item"', -1), 2, 1 << 30)).alias("n", "part"))
    part = F.split_part(F.split_part("part", F.lit("m-publications"), F.lit(1)), F.lit("<footer"), F.lit(1))
    parts = parts.select("category", "n", part.alias("part"))
    own = F.get(F.filter(links_of(F.col("part")), lambda x: x.contains(F.concat(F.col("category"), F.lit(",")))), F.lit(0))
    cards = parts.withColumn("page_url", absolute_url(own, origin))
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace("page_url", "[?#].*$", ""), "/+$", ""), "/"), -1)
    cards = cards.withColumn("slug", F.when(last.contains(","), last)).filter("slug IS NOT NULL")
    once = cards.withColumn("_k", F.row_number().over(W.partitionBy("category", "slug").orderBy("n"))).filter("_k = 1")
    title = F.nullif(page_text(F.split_part(_after(F.col("part"), 'news-list__title">'), F.lit("<"), F.lit(1))), F.lit(""))
    links = F.concat(_page_link(F.col("page_url")), F.filter(page_links(F.col("part"), origin), lambda x: x["kind"] != "page"))
    return once.select("category", "n", "slug", F.coalesce(title, "slug").alias("title"), _summary(F.col("part")).alias("summary"), "page_url", ordered_links(links).alias("links"))


def detail_pages(pages: DataFrame, origin: str, url: str = "url", html: str = "html") -> DataFrame:
    """(url, title, intro, sections, links, licence, zip_url) of detail pages: sections are headings with the text below them, both not blank."""
    read = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    title = page_text(F.when(F.instr(_after(F.col("html"), '<h2 class="page-title">'), "</h2>") > 0, F.split_part(_after(F.col("html"), '<h2 class="page-title">'), F.lit("</h2>"), F.lit(1))))
    article = F.split_part(F.coalesce(_after(F.col("html"), '<div class="text-content">'), F.lit("")), F.lit("<h2"), F.lit(1))
    read = read.select("url", F.coalesce(title, F.lit("")).alias("title"), article.alias("article"))
    parts = F.split("article", "<h4", -1)
    intro = F.filter(F.transform(F.split(page_text(F.get(parts, F.lit(0))), "\n"), F.trim), lambda x: (x != "") & ~F.lower(x).rlike("^(dowiedz|zobacz film|pobierz materia|sprawdź zasady|otwórz)"))

    def section(part: Column) -> Column:
        close = F.instr(part, "</h4>")
        heading = F.regexp_extract(F.substr(part, F.lit(1), close - 1), r"(?s)>([^>]*)$", 1)
        return F.when((close > 0) & F.substr(part, F.lit(1), close - 1).contains(">"), F.struct(page_text(heading).alias("heading"), page_text(F.substr(part, close + 5)).alias("body")))

    sections = F.filter(F.transform(F.slice(parts, 2, 1 << 30), section), lambda x: x.isNotNull() & (x["heading"] != "") & (x["body"] != ""))
    found = page_links(F.col("article"), origin)
    links = ordered_links(F.concat(F.when(F.exists(found, lambda x: x["kind"] == "page"), F.slice(found, 1, 0)).otherwise(_page_link(F.coalesce(absolute_url(F.col("url"), origin), "url"))), found))
    read = read.select("url", "title", F.array_join(intro, "\n").alias("intro"), sections.alias("sections"), links.alias("links"))
    first = lambda kind: F.get(F.filter("links", lambda x: x["kind"] == kind), F.lit(0))["url"]
    return read.withColumns({"licence": licence_name(first("licence")), "zip_url": first("zip")})


def brief_text(title: Column, url: Column, categories: Column, licence: Column, text: Column, links: Column) -> Column:
    """A brief as it is stored: title, source, page, categories and licence if there are any, the text, and the links. Fixed words."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"\n{name}: "), value))
    named = F.when(F.size(categories) > 0, F.array_join(categories, ", "))
    listed = F.array_join(F.transform(links, lambda x: F.concat(F.lit("- "), F.coalesce(x["label"], x["kind"]), F.lit(": "), x["url"], F.lit("\n"))), "")
    return F.concat_ws("", title, F.lit("\n\nŹródło: Biblioteka Innowacji Społecznych, ROPS Kraków\nStrona: "), url, line("Kategorie", named), line("Licencja", licence), F.lit("\n\n"), F.trim(text), F.lit("\n\nOdnośniki:\n"), listed)


def outcome_counts(outcomes: DataFrame, outcome: str = "outcome") -> DataFrame:
    """One row: how many were digested, skipped and failed; a null outcome failed."""
    of = F.coalesce(F.col(outcome), F.lit("failed"))
    return outcomes.agg(*[F.count_if(of == name).alias(name) for name in ("digested", "skipped", "failed")])


def section_chunks(pages: DataFrame, key: str, title: str, sections: str) -> DataFrame:
    """(key, ordinal, body): the title, then each section (heading, body) that isn't blank."""
    body = lambda x: F.concat_ws("\n", F.nullif(F.trim(x["heading"]), F.lit("")), F.nullif(F.trim(x["body"]), F.lit("")))
    bodies = F.filter(F.concat(F.array(F.trim(F.col(title))), F.transform(F.from_json(F.col(sections), "array<struct<heading:string,body:string>>"), body)), lambda b: b != "")
    return pages.select(key, F.posexplode(bodies).alias("ordinal", "body"))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


_BLANK = r"(?U)\s"


def _asked_path(asked: Column) -> Column:
    """A path as someone names it, without blanks and then quotes around it."""
    return F.regexp_replace(F.regexp_replace(asked, rf"{_BLANK}+\z|\A{_BLANK}+", ""), r'\A"+|"+\z', "")


def _folded_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, _BLANK, ""))


def names_one(asked: Column, known: Column) -> Column:
    """Whether a path names one of an array of paths, as resolved_paths() resolves it."""
    want = _asked_path(asked)
    end = _folded_path(want)
    fits = F.filter(known, lambda path: F.endswith(_folded_path(path), end) | F.endswith(end, _folded_path(path)))
    return F.array_contains(known, want) | (F.size(fits) == 1)


def brief_error(brief: Column, had_text: Column, known: Column) -> Column:
    """The first thing wrong with a brief in JSON; null if nothing is. known: paths of the document's files, each once.

    A brief without a list of files has read none; paths it has read are
    resolved as resolved_paths() does.
    """
    b = F.from_json(brief, BRIEF_SCHEMA)
    text = F.trim(b["knowledge_text"])
    files = F.coalesce(b["files_read"], F.array().cast("array<string>"))
    least = F.when(had_text, 700).otherwise(250)
    missing = b.isNull()
    for f in ("knowledge_text", *BRIEF_FIELDS):
        missing = missing | b[f].isNull()
    found = (
        F.when(missing, "missing fields")
        .when(F.length(text) < least, "too short")
        .when(text.contains("http://") | text.contains("https://"), "urls")
        .when(had_text & (F.size(files) == 0), "files_read is empty")
        .when(F.exists(files, lambda x: ~F.coalesce(names_one(x, known), F.lit(False))), "unknown path")
    )
    for f in BRIEF_FIELDS:
        found = found.when(F.trim(b[f]) == "", F.lit(f"{f} is empty"))
    return found


def resolved_paths(asked: DataFrame, entries: DataFrame, of: list[str]) -> DataFrame:
    """(of, asked, path): the entry that each asked path names among those of the same owner (the columns of).

    It is the entry of just that path, else the only one that ends in the asked
    path, or that the asked path ends in, without regard to case and white
    space; an end may start within a name. Nothing is asked of where several
    entries fit.

    Of folded paths written backwards, those that begin with the asked one stand
    together in their order, so the first two from there tell whether there is
    one. Entries that the asked path ends in are looked up by each of its ends.
    Only an owner's entries meet in a task.
    """
    key = [F.col(f"`{c}`") for c in of]
    entry = entries.select(*key, "path", F.reverse(_folded_path(F.col("path"))).alias("back"))
    falling = W.partitionBy(*of).orderBy(F.desc("back"), F.desc("path"))
    entry = entry.withColumn("here", F.struct("back", "path")).withColumn("next", F.lag("here").over(falling))
    want = asked.select(*key, "asked").distinct().withColumn("want", _asked_path(F.col("asked"))).withColumn("back", F.reverse(_folded_path(F.col("want"))))
    none = F.lit(None)
    rows = want.select(*key, "asked", "back", F.lit(1).alias("late"), none.cast("string").alias("path"), none.alias("pair")).unionByName(
        entry.select(*key, none.cast("string").alias("asked"), "back", F.lit(0).alias("late"), "path", F.struct("here", "next").alias("pair")))
    before = W.partitionBy(*of).orderBy(F.desc("back"), "late", F.desc("path"), "asked").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = rows.withColumn("pair", F.last("pair", ignorenulls=True).over(before)).filter("late = 1")
    longer = met.select(*key, "asked", "back", F.explode(F.array("pair.here", "pair.next")).alias("x")).filter(F.startswith("x.back", F.col("back"))).select(*of, "asked", "x.path")
    ends = want.select(*key, "asked", F.explode(F.transform(F.sequence(F.lit(0), F.length("back")), lambda n: F.substring("back", F.lit(1), n))).alias("back"))
    shorter = ends.join(entry.select(*key, "back", "path"), [*of, "back"]).select(*of, "asked", "path")
    fits = longer.unionByName(shorter).groupBy(*of, "asked").agg(F.min("path").alias("one"), F.max("path").alias("other"))
    exact = want.join(entries.select(*key, F.col("path").alias("want")), [*of, "want"]).select(*of, "asked", F.col("want").alias("exact")).distinct()
    found = want.select(*key, "asked").join(exact, [*of, "asked"], "left").join(fits, [*of, "asked"], "left")
    return found.select(*key, "asked", F.coalesce("exact", F.when(F.col("one") == F.col("other"), F.col("one"))).alias("path")).filter("path IS NOT NULL")


#: Kinds of mapped things by category and type; the first that fits counts. The map's own names.
HOUSES = ("house", "residential", "apartments", "detached", "semidetached_house", "terrace", "bungalow", "cabin", "farm", "static_caravan", "yes")
KINDS = (
    ("private", "building", HOUSES),
    ("private", "place", ("house", "isolated_dwelling", "farm")),
    ("private", "highway", None),
    ("private", "boundary", None),
    ("cafe", "amenity", ("cafe", "restaurant", "bar", "pub", "fast_food", "ice_cream", "biergarten", "food_court")),
    ("park", "leisure", ("park", "garden", "nature_reserve")),
    ("park", "natural", ("wood", "grassland", "scrub")),
    ("park", "landuse", ("forest", "grass", "recreation_ground", "meadow")),
    ("hall", "amenity", ("community_centre", "theatre", "arts_centre", "library", "cinema", "conference_centre", "events_venue", "social_facility")),
    ("hall", "building", ("civic", "public")),
    ("hall", "leisure", ("stadium", "sports_centre", "sports_hall")),
    ("square", "place", ("square",)),
    ("square", "leisure", ("pitch",)),
)


def place_kind(category: Column, kind: Column) -> Column:
    found = F.when(F.lit(False), "")
    for name, of, kinds in KINDS:
        found = found.when((category == of) & (kind.isin(*kinds) if kinds else F.lit(True)), name)
    return found.otherwise("other_public")


def profile_text(bio: Column, likes: Column, dislikes: Column, notes: Column) -> Column:
    """What a profile says, a line each: bio, likes, dislikes, lasting notes; nothing for what is blank."""
    listed = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{name}: "), F.array_join(xs, ", ")))
    return F.concat_ws("\n", F.nullif(F.trim(bio), F.lit("")), listed("likes", likes), listed("dislikes", dislikes), notes)


def event_passage(title: Column, description: Column, tags: Column) -> Column:
    """What an event says of itself, a line each: title, description, tags; nothing for what is blank."""
    return F.concat_ws("\n", F.trim(title), F.nullif(F.trim(description), F.lit("")), F.when(F.size(tags) > 0, F.array_join(tags, ", ")))
