"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events of a page. Blocks of text are the
lines; each has the ratio of its text outside links to the tags in it. The
ratios are smoothed by a Gaussian, a threshold parts high lines from low ones,
and the sections with high lines are the content: of those within articles, if
there are any, otherwise of all. Elements that name themselves menus, adverts,
forms, comments and the like count as tags only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaworks.llm.shared import fresh

#: Of the Gaussian, in lines; and the part of the smoothed ratios' deviation that a line must reach.
SIGMA, THRESHOLD = 1.0, 0.5

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_SECTIONS = frozenset("article aside body details div footer header main nav section td".split())
_HIDDEN = frozenset("aside button canvas datalist dialog embed footer head iframe input menu nav noscript object script select style svg template textarea title".split())
_HIDDEN_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words in a class or an id that name what isn't content.
_HIDDEN_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related reply replies respond searchbox share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Those of them whose elements may well hold more text than the page's article; its share of high lines says nothing for them.
_NEVER_WRAPPERS = frozenset("ad ads adsense advert adverts advertisement advertising adbox comment comments consent cookie cookies disclaimer disqus gdpr notice notices popup promo promoted promotion recommended related reply replies respond share sharing sponsor sponsored".split())
#: Words that, anywhere in a class or an id, name a notice that asks for consent.
_CONSENT = frozenset("cookie cookies consent gdpr".split())
#: The same for an article, which may well be free of ads.
_OTHER_ARTICLES = frozenset("advert advertisement comment comments promo recommended related replies reply sponsored teaser".split())
#: Words that make a class or id tell of a state or a kind, before or at the end of it; and words for what only holds the word before it.
_STATES, _ENDS_OF_STATES = frozenset("has with without no non not is category tag format type status".split()), frozenset("open opened closed off none free less enabled disabled on".split())
_HOLDERS = frozenset("area bar block body box button buttons container content form group holder inner item items left link links list overlay panel right section slot text unit widget wrap wrapper".split())
#: Open elements that a start tag ends, besides a paragraph, and those it doesn't look beyond.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "body": {"html"}}
#: Ends of these don't reach beyond the section they stand in.
_LOCAL = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote".split())


@dataclass
class Line:
    """A block's text; tags since the last line, characters in links; its section, outermost article (0: none), and whether in a main element or hidden."""

    text: str
    tags: int
    linked: int
    section: int
    article: int
    main: bool
    hidden: bool
    #: The innermost element around it that hides by its name or as a form (0: none).
    named: int = 0


@dataclass
class _Open:
    tag: str
    section: int = 0
    article: int = 0
    main: bool = False
    hidden: bool = False
    #: Hidden within a line, which goes on after it; and the same by a name.
    skipped: bool = False
    unnamed: bool = False
    #: The innermost element, this or one around it, that hides by its name or as a form (0: none).
    named: int = 0


@lru_cache(1 << 14)
def head_of(name: str) -> str:
    """The word that says what an element with this class or id is; empty if it says only what it has, is about or is like.

    That is the name's last word (comments of post-comments), or the one before a word for what holds it (comment of comment-list).
    """
    words = [x for x in re.findall(r"[a-z]+|[0-9]+(?=[a-z])", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if x]
    if _CONSENT & set(words) and words[-1] in _CONSENT | _HOLDERS | {"banner", "notice", "popup", "modal", "dialog", "message"}:
        return "consent"
    if not words or _STATES & set(words[:-1]) or len(words) > 1 and words[-1] in _ENDS_OF_STATES:
        return ""
    return words[0] if len(words) == 2 and words[1] in _HOLDERS else words[-1]


class _Lines(HTMLParser):
    """Collects a page's lines from the parser's events; without names, class and id hide nothing."""

    def __init__(self, names: bool = True):
        super().__init__(convert_charrefs=True)
        self._names = names
        #: Of each element that hides by its name or as a form the next one around it; those that hold an article or main
        #: and so don't hide; and those that hide however much they hold.
        self._around: dict[int, int] = {}
        self._holds: set[int] = set()
        self._strict: set[int] = set()
        self.lines: list[Line] = []
        self._open = [_Open("")]
        #: Places of the open elements of each tag, and of all sections, in ascending order.
        self._at: defaultdict[str, list[int]] = defaultdict(list)
        self._sections: list[int] = []
        self._numbers = 0
        self._text: list[str] = []
        self._tags = self._linked = self._links = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            x = self._open[-1]
            self.lines.append(Line(text, self._tags, self._linked, x.section, x.article, x.main, x.hidden, x.named))
            self._tags = 0
        self._text, self._linked = [], 0

    def _hides(self, tag: str, attrs: dict[str, str | None], article: int) -> bool:
        if tag in ("html", "body", "main"):
            return False
        if tag in _HIDDEN or tag == "header" and not article or "hidden" in attrs or (attrs.get("role") or "").lower() in _HIDDEN_ROLES:
            return True
        return attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I))

    def _names_of(self, tag: str, attrs: dict[str, str | None], article: int) -> set[str]:
        """What it names itself that isn't content; a form is one whatever its name."""
        found = {"form"} if tag == "form" or (attrs.get("role") or "").lower() == "form" else set()
        if not self._names or tag in ("html", "body", "main") or not (attrs.get("class") or attrs.get("id")):
            return found
        names = {head_of(x) for x in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()}
        if "header" in names and not article and tag not in ("article", "h1", "h2", "h3"):
            found.add("header")
        return found | names & (_OTHER_ARTICLES if tag == "article" else _HIDDEN_WORDS)

    def _close(self, k: int) -> None:
        """Close open element k and all within it."""
        if any(x.tag in _BLOCKS for x in self._open[k:]):
            self._end_line()
        for x in self._open[k:]:
            self._at[x.tag].pop()
            self._links -= x.tag == "a"
        while self._sections and self._sections[-1] >= k:
            self._sections.pop()
        del self._open[k:]

    def _ended_by(self, tag: str) -> int:
        """The outermost open element that the start of a block ends (0: none), not beyond what it stands in."""
        within = _WITHIN.get(tag)
        edge = max((self._at[x][-1] for x in within if self._at[x]), default=0) if within else (self._sections or [0])[-1]
        places = [self._at[x][i] for x in {"p"} | _ENDS.get(tag, set()) if (i := bisect_right(self._at[x], edge)) < len(self._at[x])]
        return min(places, default=0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in _BLOCKS:
            self._end_line()
            if found := self._ended_by(tag):
                self._close(found)
        if tag in _VOID:
            self._text += " " * (tag == "br")
            return
        x = self._open[-1]
        given = dict(attrs)
        hides = not x.hidden and self._hides(tag, given, x.article)
        names = set() if x.hidden or hides else self._names_of(tag, given, x.article)
        self._numbers += 1
        holder = tag in ("article", "main") and not (x.hidden or hides or names)
        if holder:
            k = x.named
            while k and k not in self._holds:
                self._holds.add(k)
                k = self._around[k]
        if names:
            self._around[self._numbers] = x.named
            if names & _NEVER_WRAPPERS:
                self._strict.add(self._numbers)
        self._links += tag == "a"
        self._at[tag].append(len(self._open))
        if tag in _SECTIONS:
            self._sections.append(len(self._open))
        self._open.append(
            _Open(
                tag,
                self._numbers if tag in _SECTIONS else x.section,
                x.article or (self._numbers if tag == "article" else 0),
                x.main or tag == "main",
                x.hidden or hides,
                x.skipped or hides and tag not in _BLOCKS,
                not holder and (x.unnamed or bool(names) and tag not in _BLOCKS),
                self._numbers if names else x.named,
            )
        )

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in _BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if not self._at[tag]:
            return
        k = self._at[tag][-1]
        local = tag not in _BLOCKS or tag in _LOCAL
        if not (local and self._sections and self._sections[-1] > k):
            self._close(k)

    def handle_data(self, data: str) -> None:
        if not (self._open[-1].skipped or self._open[-1].unnamed):
            self._text.append(data)
            if self._links:
                self._linked += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()
        if not self._around:
            return
        # What a wrapper holds counts for those around it; they were opened before it.
        high = high_lines(self.lines)
        share = dict.fromkeys(self._around, 0)
        for x, is_high in zip(self.lines, high, strict=True):
            if is_high and x.named:
                share[x.named] += len(x.text)
        most = sum(len(x.text) for x, is_high in zip(self.lines, high, strict=True) if is_high) / 2
        for k in sorted(self._around, reverse=True):
            if self._around[k]:
                share[self._around[k]] += share[k]
        wrappers = {k for k, n in share.items() if n > most and k not in self._strict}
        for k in sorted(self._around):  # within a strict one nothing wraps
            if self._around[k] in self._strict - self._holds:
                self._strict.add(k)
                wrappers.discard(k)
        self._holds |= wrappers
        for x in self.lines:
            x.hidden |= x.named > 0 and x.named not in self._holds


def lines_of(html: str, names: bool = True) -> list[Line]:
    parser = _Lines(names)
    # At once: of a tag that doesn't end the parser keeps nothing, and would begin it anew with each part.
    parser.feed(html)
    parser.close()
    return parser.lines


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Values averaged by a Gaussian over neighbouring lines, as if the first and last went on."""
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), weights / weights.sum(), mode="valid")


def ratios_of(lines: list[Line]) -> np.ndarray:
    """The text-to-tag ratio of each line; 0 for hidden ones, so that they part regions."""
    return np.array([0.0 if x.hidden else max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])


def high_lines(lines: list[Line], sigma: float = SIGMA, threshold: float = THRESHOLD) -> list[bool]:
    """Which lines' smoothed ratios reach the threshold and aren't mostly links."""
    if not lines:
        return []
    level = smoothed(ratios_of(lines), sigma)
    reached = (level >= threshold * level.std()).tolist()
    return [y and not x.hidden and 2 * x.linked < len(x.text) for x, y in zip(lines, reached, strict=True)]


#: An article that begins with a link is another story's teaser if the largest article is so many times its size.
TEASER = 3


def _teasers(lines: list[Line], regions: dict[int, int], content: set[int]) -> set[int]:
    sizes, firsts = dict.fromkeys(content, 0), {}
    for i, region in regions.items():
        if region in content:
            sizes[region] += len(lines[i].text)
            firsts.setdefault(region, lines[i])
    largest = max(sizes.values())
    return {r for r, x in firsts.items() if 2 * x.linked >= len(x.text) and TEASER * sizes[r] < largest}


def main_text(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The main text of a page, its blocks joined by \\n; empty if there is none.

    Regions are the page's articles, without any its main element, without that its sections.
    Those with a high line that isn't mostly links are content and stay whole;
    if there is no such line, all. Of several articles a small one that begins
    with a link tells of another page's story, and isn't content.
    White space in a block is one blank. Where names of classes and ids hide
    every line, they hide none.
    """
    lines = lines_of(html or "")
    if lines and all(x.hidden for x in lines):
        lines = lines_of(html or "", names=False)
    shown = [i for i, x in enumerate(lines) if not x.hidden]
    if not shown:
        return ""
    regions = {i: lines[i].article for i in shown if lines[i].article} or {i: 0 for i in shown if lines[i].main} or {i: lines[i].section for i in shown}
    high = high_lines(lines, sigma, threshold)
    content = {regions[i] for i in regions if high[i]} or set(regions.values())
    if len(content) > 1 and any(x.article for x in lines):
        content -= _teasers(lines, regions, content)
    return "\n".join(lines[i].text for i in regions if regions[i] in content)


def with_main_text(df: DataFrame, html: str = "html", name: str = "main_text") -> DataFrame:
    """df with a column of main text from the whole html; null and empty html give the empty text.

    Rows and other columns stay as they are; name gets underscores until it is
    new; an empty table gives an empty table.
    """
    (name,) = fresh(df, name)
    at = df.columns.index(html)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 256):
                batch = whole.slice(k, 256)
                texts = pa.array([main_text(x) for x in batch.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, name])

    return df.mapInArrow(work, df.select("*", F.lit("").alias(name)).schema)
