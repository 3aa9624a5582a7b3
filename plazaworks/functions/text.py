"""Text of titles, tags, links and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = "https://example.org"
_WORD = r"([\p{L}\p{N}]+)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(1))


def tokens(text: Column) -> Column:
    """Lower-case words of two characters at least; paddle is padel."""
    return F.transform(F.filter(words(text), lambda w: F.length(w) >= 2), lambda w: F.when(w == "paddle", F.lit("padel")).otherwise(w))


def words_of(text: str) -> set[str]:
    """The tokens of a known text, as tokens() has them."""
    found = {w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) >= 2}
    return {"padel" if w == "paddle" else w for w in found}


def has_word(texts: Column, words: set[str]) -> Column:
    """One of the texts has one of the known words as a token; one regular expression, which stays within generated code."""
    if not words:
        return F.lit(False)
    known = "|".join(sorted(re.escape(w) for w in words | ({"paddle"} if "padel" in words else set())))
    return F.coalesce(F.lower(F.array_join(texts, "\n")).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{known})(?![\p{{L}}\p{{N}}])"), F.lit(False))


def canonical_tag(tag: Column) -> Column:
    low = F.lower(F.trim(tag))
    return F.when(low == "paddle", F.lit("padel")).otherwise(low)


def ordered_trigrams(text: Column) -> Column:
    """The three-letter parts of words in their order, each word with two blanks before and one after."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))))


def trigrams(text: Column) -> Column:
    """The set of ordered_trigrams()."""
    return F.array_distinct(ordered_trigrams(text))


def trigrams_of(text: str) -> list[str]:
    """The ordered trigrams of a known text, as ordered_trigrams() has them."""
    return [f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)]


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams to all trigrams; 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def runs_of(text: str) -> list[tuple[str, bool, bool]]:
    """The words of a known text, each with whether something that is no letter or digit stands before and after it within the text."""
    return [(m[0], m.start() > 0, m.end() < len(text)) for m in re.finditer(r"[^\W_]+", text.lower())]


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def absolute_url(href: Column, origin: str = ORIGIN) -> Column:
    """The address that a link leads to; null for those that lead to none."""
    h = F.trim(href)
    none = (h == "") | h.startswith("#") | h.startswith("javascript:") | h.startswith("mailto:")
    full = F.when(h.startswith("https://") | h.startswith("http://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h))
    return F.when(~none, full.when(h.startswith("/"), F.concat(F.lit(origin), h)).otherwise(F.concat(F.lit(f"{origin}/"), h)))


def _any(text: Column, *parts: str) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def classify_href(url: Column) -> Column:
    u = F.lower(url)
    path = F.regexp_replace(u, r"[?#].*$", "")
    return (
        F.when(_any(u, "youtube.com", "youtu.be", "vimeo.com"), "video")
        .when(_any(u, "creativecommons.org", "zasady_wykorzystania", "zasady-wykorzystania"), "licence")
        .when(path.endswith(".zip"), "zip")
        .when(path.endswith(".pdf"), "pdf")
        .otherwise("other")
    )


def licence_name(url: Column) -> Column:
    u = F.lower(url)
    cc = lambda part: _any(u, f"creativecommons.org/licenses/{part}")
    named = F.when(cc("by-nc-sa"), "CC BY-NC-SA 4.0").when(cc("by-nc"), "CC BY-NC 4.0").when(cc("by-sa"), "CC BY-SA 4.0").when(cc("by"), "CC BY 4.0")
    return named.when(_any(u, "miis", "zasady"), "Zasady wykorzystania innowacji MIIS").otherwise(url)


def strip_tags(html: Column) -> Column:
    """Text without tags; an unclosed tag takes the rest with it, contents of scripts stay."""
    return F.regexp_replace(html, r"<[^>]*(>|$)|>", "")


def decoded_entities(text: Column) -> Column:
    """The common named character references; &amp; last, so that none is decoded twice."""
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_to_text(html: Column) -> Column:
    """Readable text: block tags end lines, other tags go, blanks and empty lines are collapsed."""
    text = F.regexp_replace(html, r"(?i)</?(p|div|li|ul|ol|br|h[1-6]|tr|table|section|article)\b[^>]*>", "\n")
    text = decoded_entities(strip_tags(text))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


#: Lines of a page that are its chrome, and beginnings of lines that end or are left out of an introduction. The site's own words.
CHROME = (
    "się więcej", "zobacz", "film", "pobierz", "materiały", "wykorzystania", "w telefonie", "powrót", "drukuj", "dowiedz się więcej",
    "zobacz film", "pobierz materiały", "otwórz w telefonie", "sprawdź zasady", "sprawdź zasady wykorzystania",
)


def _character(entity: Column) -> Column:
    """What a character reference, without & and ;, stands for; null if it is none that is known."""
    number = F.conv(F.regexp_extract(entity, "^#[xX]([0-9a-fA-F]{1,8})$", 1), 16, 10).try_cast("long")
    number = F.coalesce(F.when(entity.rlike("^#[xX]"), number), F.regexp_extract(entity, "^#([0-9]{1,9})$", 1).try_cast("long"))
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    coded = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number)), 8, "0")), "UTF-32")
    named = F.when(entity == "amp", "&").when(entity == "lt", "<").when(entity == "gt", ">").when(entity == "quot", '"').when(entity.isin("apos", "#39"), "'").when(entity == "nbsp", " ")
    return named.when(entity.startswith("#"), coded)


def decoded_references(text: Column) -> Column:
    """Named and numeric character references once; what is none stays as it is."""

    def piece(p: Column, i: Column) -> Column:
        entity = F.regexp_extract(p, "^([^;]{0,11});", 1)
        char = _character(entity)
        return F.when(i == 0, p).when(char.isNotNull(), F.concat(char, F.substr(p, F.length(entity) + 2))).otherwise(F.concat(F.lit("&"), p))

    return F.array_join(F.transform(F.split(text, "&", -1), piece), "")


def page_text(html: Column) -> Column:
    """Text of a part of a page: some ends of blocks end lines, list items start with a dash, tags go, blanks and empty lines are collapsed, chrome lines dropped."""
    text = F.regexp_replace(html, "<br>|<br/>|<br />|</p>|</div>|</li>|</h4>|</tr>", "\n")
    text = decoded_references(strip_tags(F.replace(text, F.lit("<li>"), F.lit("\n- "))))
    blank = r"[\s\u00A0]+"
    lines = F.transform(F.split(text, "\r?\n", -1), lambda x: F.trim(F.regexp_replace(x, blank, " ")))
    # Empty lines stand between others, one at a time.
    kept = F.filter(lines, lambda x, i: (x != "") | (i > 0) & (F.get(lines, i - 1) != ""))
    text = F.regexp_replace(F.array_join(kept, "\n"), r"\A\n+|\n+\z", "")
    bare = lambda x: F.lower(F.trim(F.regexp_replace(x, r"^[^\p{L}\p{N} ]+|[^\p{L}\p{N} ]+$", "")))
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~bare(x).isin(*CHROME)), "\n")


def language_of(locale: Column) -> Column:
    """The locale, Polish where none is given; see is_english()."""
    return F.coalesce(F.nullif(F.trim(locale), F.lit("")), F.lit("pl"))


def is_english(locale: Column) -> Column:
    return F.lower(F.trim(locale)).eqNullSafe(F.lit("en"))


def media_kind(path: Column) -> Column:
    ext = F.element_at(F.split(F.lower(path), r"\."), -1)
    return F.when(ext.isin("pdf", "docx", "odt", "rtf"), ext).when(ext.isin("txt", "md", "html", "htm"), "text").otherwise("other")


def path_rank(path: Column) -> Column:
    """How early a document of an archive is read; lower is earlier."""
    p = F.lower(path)
    return (
        F.when(_any(p, "font") | p.endswith(".ttf"), 9)
        .when(_any(p, "model") & ~_any(p, "wzorniczy"), 0)
        .when(_any(p, "instruk", "scenari"), 1)
        .when(_any(p, "test"), 2)
        .when(_any(p, "raport"), 3)
        .when(_any(p, "folder", "opis"), 4)
        .when(_any(p, "wzorniczy"), 8)
        .otherwise(5)
    )


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "pdf", 0).when(kind == "docx", 1).when(kind == "odt", 2).otherwise(3)


def link_rank(kind: Column) -> Column:
    ranks = F.when(kind == "zip", 0)
    for k, name in enumerate(("video", "pdf", "licence", "qr", "page"), 1):
        ranks = ranks.when(kind == name, k)
    return ranks.otherwise(6)


def capped(text: Column, limit: int = 180_000) -> Column:
    """A struct: the text's first limit characters and a note if more were cut off."""
    return F.struct(F.substring(text, 1, limit).alias("text"), F.when(F.length(text) > limit, F.lit(f"cut to {limit} characters")).alias("note"))


def text_window(text: Column, offset: Column, size: int = 7000) -> Column:
    """A struct: a stretch of the text and the offset after it, null at the end."""
    after = F.least(offset + size, F.length(text))
    return F.struct(F.substring(text, offset + 1, F.lit(size)).alias("part"), F.when(after < F.length(text), after).alias("next_offset"))


def redacted_url(url: Column) -> Column:
    return F.regexp_replace(url, "://([^:/? ]*):[^/? ]*@", "://$1:***@")


def attendance_label(signed: Column, capacity: Column) -> Column:
    return F.when(capacity.isNull(), signed.cast("string")).otherwise(F.concat(signed.cast("string"), F.lit("/"), capacity.cast("string")))


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in texts], F.lit(""))


def address_line(road: Column, number: Column, city: Column, shown: Column) -> Column:
    """Street with number and city as far as they are known, else the name shown."""
    street = F.trim(F.concat_ws(" ", F.nullif(F.trim(road), F.lit("")), F.when(F.trim(road) != "", F.nullif(F.trim(number), F.lit("")))))
    return first_filled(F.concat_ws(", ", F.nullif(street, F.lit("")), F.nullif(F.trim(city), F.lit(""))), shown)
