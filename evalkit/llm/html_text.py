"""Main text of web pages by two-pass block rules.

Markup is cut into text blocks at block-level tags. The first pass classifies each
block on its own: link density, length and stop-word density; elements, roles and
class names that mark menus, headers, footers, side columns, notices, adverts, forms
or comments settle a block at once, unless an article inside them opens a zone of its
own. A name is a prior where it is not plain: an element whose names speak for and against
main text, or that is named like a list of readers' texts (discussion, reviews), is judged by
its weight: with more than half of the page's text it is the page's own. Names of main text decide where a block's own text does not: link density is
judged inside them too, stop words inside class names. A form that holds most of the
page's text is its wrapper and says nothing. The second pass
gives every undecided block (short, or middling in stop words) the label of the nearest
decided blocks, first of those in its own section of the page, then of the page.

Stop words decide nothing on a page whose text has almost none of them, which is in a
language the list does not hold: there length and link density alone decide.

Defined cases: a null or empty page has no text; markup that is cut off or not closed
is read as far as it goes; comments, scripts, styles and attributes never count as
text; character references are decoded; white space inside a block becomes one space
and kept blocks are joined by one; pages of any length are read whole; repeated rows
get equal texts; an empty table gives an empty table; input columns named like a
result column give way to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalkit.llm.common import per_worker, with_columns
from evalkit.llm.common_words import COMMON_WORDS

#: Block rules: share of linked characters of a bad block; characters of a short block and
#: of a long one; share of stop words of a bad block and of a good one.
MAX_LINKED = 0.35
SHORT, LONG = 70, 200
LOW_STOP, HIGH_STOP = 0.06, 0.15

#: Elements whose text ends the block before them (fixed values of the markup).
BLOCK_TAGS = frozenset("""address article aside blockquote body br button caption center col colgroup dd details
dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html
legend li link main menu meta nav ol optgroup option p pre search section select summary table tbody td tfoot th
thead title tr ul""".split())
#: Elements whose content is never text of the page.
SILENT_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video head title select"
                        " textarea button datalist".split())
#: Elements that open a section, and of these the ones that are never main text.
SECTION_TAGS = frozenset("article aside body dialog div footer form header main nav search section".split())
BAD_TAGS = frozenset("aside dialog footer menu nav search".split())
MAIN_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note"
                      " search toolbar".split())
#: Words of class names and ids that mark what is not main text.
BAD_WORDS = frozenset("""ad ads adbox advert advertisement advertising adverts author-box banner breadcrumb breadcrumbs
comment comments commentlist consent cookie cookies copyright disqus disclaimer feedback footer gdpr header masthead
menu modal nav navbar navigation newsletter notice overlay pagination pager popup print promo promoted promotion
recommended related reply respond share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe
syndication tags toolbar widget""".split())
MAIN_WORDS = frozenset("article articlebody content entry maincontent post posttext story storybody".split())
#: Parts of a name beside those words that leave their meaning; any other part changes it
#: (has-sidebar, no-header, with-navbar).
PLACE_WORDS = frozenset("""area articles bar block body bottom box btn button buttons col column container div el elem
element fixed form global group holder icon icons inner item items js left link links list main mobile module outer page
panel post posts primary right row secondary section site sticky text title top widgets wp wrap wrapper""".split())
#: Names of lists of others' texts, whose articles are not the page's.
OTHERS_WORDS = frozenset("""ad ads adbox advert advertisement advertising adverts comment comments commentlist disqus promo
promoted promotion recommended related reply respond shoutbox sponsor sponsored""".split())
#: Stems of names of readers' comments, and parts that make of such a name one of layout.
COMMENT_STEMS = ("comment", "kommentar", "commentaire", "comentario")
LAYOUT_PARTS = frozenset("closed count disabled enabled has no off on open with without".split())
#: Names of lists of readers' texts that an article may have as well.
SOFT_WORDS = frozenset("discussion discussions guestbook opinions reactions replies responses reviews".split())
#: Names that speak for main text beside a bad one.
PAGE_WORDS = MAIN_WORDS | frozenset("container main page primary site wrapper".split())
WORD_PARTS = re.compile(r"[a-z]+|[0-9]+")
SPACES = re.compile(r"\s+")
COPYRIGHT = re.compile(r"©|\(c\) ?(19|20)\d\d|\ball rights reserved\b", re.I)

#: Zones are labels too, and MAIN: an element of main text (GOOD: a class name of it), and
#: CLOSED: bad, and an article inside is not the page's either.
MAIN, GOOD, BAD, CLOSED, UNDECIDED = 2, 1, 0, -1, None


@dataclass
class Block:
    section: int
    zone: int | None  # MAIN, GOOD: inside an element of main text or one named so, BAD: inside one that never is
    form: int  # the number of the form around it, 0 without one
    weighed: int = 0  # the number of the element around it whose name is no verdict, 0 without one
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    code: bool = False


def named_words(attrs: dict[str, str | None]) -> set[str]:
    """The words of lists above that an element's class and id say as whole names: a name's
    other parts must be of these lists, of places, or numbers."""
    found = set()
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
        if name in BAD_WORDS or name in MAIN_WORDS:
            found.add(name)
            continue
        parts = set(WORD_PARTS.findall(name))
        if any(p.startswith(COMMENT_STEMS) for p in parts) and not parts & LAYOUT_PARTS:
            found.add("comments")
            continue
        bad, main = parts & BAD_WORDS, parts & MAIN_WORDS
        if all(p.isdigit() or p in PLACE_WORDS for p in parts - bad - main) and not (bad and "content" in main):
            found |= bad or main
    return found


def zone_of(tag: str, attrs: dict[str, str | None]) -> int | None:
    """What an element's name, role, class and id say of its text."""
    role = (attrs.get("role") or "").lower()
    if tag in BAD_TAGS or role in BAD_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return CLOSED
    words = named_words(attrs)
    if tag in MAIN_TAGS or role in ("main", "article") or (attrs.get("itemprop") or "").lower() == "articlebody":
        return CLOSED if words & {"comment", "comments"} else MAIN
    if tag in ("html", "body"):
        return UNDECIDED
    if words & BAD_WORDS:
        return CLOSED if words & OTHERS_WORDS else BAD
    return GOOD if words & MAIN_WORDS else UNDECIDED


def is_weighed(tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether an element's names are no verdict: some speak for main text and some against
    it, or they name a list of texts that may be the readers' or the page's."""
    if tag in ("html", "body") or tag in MAIN_TAGS or tag in BAD_TAGS or (attrs.get("role") or "").lower() in BAD_ROLES:
        return False
    words, names = named_words(attrs), f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()
    if "comments" in words:
        return False
    soft = any(set(WORD_PARTS.findall(n)) & SOFT_WORDS and set(WORD_PARTS.findall(n)) <= SOFT_WORDS | PLACE_WORDS for n in names)
    return soft or bool(words & BAD_WORDS and set(names) & PAGE_WORDS)


class Blocks(HTMLParser):
    """Cuts a page into text blocks."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int, int | None, int, int]] = []  # tag, section, zone, form, weighed
        self.sections = self.silent = self.links = self.pres = 0
        self.current: Block | None = None
        self.feed(html)
        self.close()
        self.cut()

    def cut(self) -> None:
        if self.current is not None and any(p.strip() for p in self.current.parts):
            self.blocks.append(self.current)
        self.current = None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.cut()
        if tag in VOID_TAGS:
            return
        if tag == "p" or tag == "li":  # their end tags are often left out
            if self.open and self.open[-1][0] == tag:
                self.handle_endtag(tag)
        _, section, zone, form, weighed = self.open[-1] if self.open else ("", 0, UNDECIDED, 0, 0)
        own = zone_of(tag, dict(attrs))
        weigh = is_weighed(tag, dict(attrs))
        if weigh:
            own = UNDECIDED
        if tag == "header" and zone not in (GOOD, MAIN):
            own = BAD
        opens = tag in MAIN_TAGS and own is MAIN and (zone is not CLOSED or tag == "main")
        if own is not UNDECIDED and zone not in (BAD, CLOSED) or opens or own is CLOSED:
            zone = MAIN if zone is MAIN and own is GOOD else own
        if tag in SECTION_TAGS or own is not UNDECIDED or weigh:
            self.sections += 1
            section = self.sections
        if opens or weigh:
            weighed = section if weigh else 0
        if tag == "form" or opens:
            form = 0 if opens else section
        self.open.append((tag, section, zone, form, weighed))
        self.silent += tag in SILENT_TAGS
        self.links += tag == "a"
        self.pres += tag == "pre"

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.cut()
        if not any(t == tag for t, *_ in self.open):
            return
        # a section's end closes what is open inside it; an inner end tag never closes a section
        for t, *_ in reversed(self.open):
            if t == tag:
                break
            if t in SECTION_TAGS and tag not in SECTION_TAGS and tag not in ("html",):
                return
        while self.open:
            t, *_ = self.open.pop()
            self.silent -= t in SILENT_TAGS
            self.links -= t == "a"
            self.pres -= t == "pre"
            if t == tag:
                return

    def handle_data(self, data):
        if self.silent:
            return
        if self.current is None:
            if not data.strip():
                return
            _, section, zone, form, weighed = self.open[-1] if self.open else ("", 0, UNDECIDED, 0, 0)
            self.current = Block(section, BAD if zone is CLOSED else zone, form, weighed)
            self.current.heading = any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t, *_ in self.open[-3:])
            self.current.code = self.pres > 0
        self.current.parts.append(data)
        if self.links:
            self.current.linked += len(data)


def stop_share(blocks: Sequence[Block], texts: Sequence[str], stop_words: frozenset[str]) -> tuple[list[float], float]:
    """The share of stop words of each block, and that of the page: of its blocks that are
    not short, not links, and not settled as bad by a name."""
    shares, found, n = [], 0, 0
    for b, t in zip(blocks, texts):
        words = t.split()
        hits = sum(w.strip(".,;:!?'\"()").lower() in stop_words for w in words)
        shares.append(hits / max(1, len(words)))
        if b.zone is not BAD and len(t) >= SHORT and b.linked <= MAX_LINKED * len(t):
            found, n = found + hits, n + len(words)
    return shares, found / max(1, n)


def label(block: Block, text: str, share: float, page_share: float) -> int | None:
    """The first pass: a block on its own, but for the language of the page."""
    if block.zone is BAD:
        return BAD
    named = block.zone in (GOOD, MAIN)
    if block.linked > MAX_LINKED * len(text) or not named and len(text) < LONG and COPYRIGHT.search(text):
        return BAD
    if len(text) < SHORT or named and block.code:
        return UNDECIDED
    if page_share < LOW_STOP:
        return GOOD
    if share >= HIGH_STOP and len(text) >= LONG:
        return GOOD
    # a short run of words may lack stop words by chance, which is no proof against a class
    # name; lists and tables of an article's own lack them as well
    if share < LOW_STOP and (not named or block.zone is GOOD and len(text) >= LONG):
        return BAD
    return UNDECIDED


def settle_forms(blocks: Sequence[Block], texts: Sequence[str]) -> None:
    """The blocks of a form are bad, unless it holds more than half of the text that no name
    settles as bad: then it wraps the page."""
    settle(blocks, texts, "form")


def settle(blocks: Sequence[Block], texts: Sequence[str], kind: str) -> None:
    """The blocks of an element of a kind are bad unless it holds more than half of the text
    that is not bad already."""
    chars: Counter[int] = Counter()
    for b, t in zip(blocks, texts):
        if b.zone is not BAD:
            chars[getattr(b, kind)] += len(t)
    for b in blocks:
        if getattr(b, kind) and 2 * chars[getattr(b, kind)] <= chars.total():
            b.zone = BAD


def spread(labels: Sequence[int | None], sections: Sequence[int], fallback: Sequence[int | None]) -> list[bool]:
    """The second pass: undecided blocks take the label of the nearest decided block of
    their section (the better one at equal distance), else what the section says of
    itself, else the nearest decided block of the page; without any, they are kept."""
    n = len(labels)

    def nearest(same_section: bool) -> list[int | None]:
        best: list[tuple[int, int] | None] = [None] * n
        for order in (range(n), range(n - 1, -1, -1)):
            last: dict[int, int] = {}
            for i in order:
                key = sections[i] if same_section else 0
                if labels[i] is not None:
                    last[key] = i
                elif key in last:
                    found = (abs(i - last[key]), -labels[last[key]])
                    best[i] = min(found, best[i]) if best[i] else found
        return [-b[1] if b else None for b in best]

    own, page = nearest(True), nearest(False)
    return [bool(next((x for x in (labels[i], own[i], fallback[i], page[i]) if x is not None), GOOD)) for i in range(n)]


def main_text(html: str | None, stop_words: frozenset[str]) -> str:
    if not html:
        return ""
    blocks = Blocks(html).blocks
    texts = [SPACES.sub(" ", "".join(b.parts)).strip() for b in blocks]
    settle_forms(blocks, texts)
    settle(blocks, texts, "weighed")
    shares, page_share = stop_share(blocks, texts, stop_words)
    labels = [label(b, t, s, page_share) for b, t, s in zip(blocks, texts, shares)]
    # what an element's name settles as bad says nothing of the text around it
    rest = [i for i, b in enumerate(blocks) if b.zone is not BAD]
    kept = spread([labels[i] for i in rest], [blocks[i].section for i in rest], [blocks[i].zone for i in rest])
    # inside an element named as main text only what a block's own text says drops it
    kept = [labels[i] is not BAD if blocks[i].zone in (GOOD, MAIN) else k for i, k in zip(rest, kept)]
    return " ".join(texts[i] for i, k in zip(rest, kept) if k and texts[i])


def extractor(stop_words: Sequence[str]):
    """A column function: the main text of a column of markup."""
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = per_worker(("stop-words", tuple(stop_words)), lambda: frozenset(stop_words))
        for pages in batches:
            yield pa.array([main_text(h, words) for h in pages.to_pylist()], pa.string())
    return run


def extract(pages: DataFrame, html: str = "html", stop_words: Sequence[str] | None = None) -> DataFrame:
    """``pages`` with text and n_chars."""
    words = sorted(stop_words or {w for ws in COMMON_WORDS.values() for w in ws})
    out = with_columns(pages, {"text": F.coalesce(extractor(words)(F.col(html)), F.lit(""))})
    return with_columns(out, {"n_chars": F.length("text").cast("long")})
