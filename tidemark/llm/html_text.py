"""Op7: main text of web pages by the distribution of line blocks.

Markup is stripped to lines, one a block-level element, each with the characters it holds
outside links. Sums over a sliding window of lines show where text surges and where it
dives; the bound between the two is the page's own, a share of the window that its median
character stands in. What stands between a surge and its dive is a region. The element that
holds most of what the regions hold is the article's; its text goes from the first surge to
the last dive in it, with the short paragraphs and headings that go on from there.

Tags only support this. Elements that by HTML's rules hold no article (scripts, menus,
headers, ...) or are hidden give no lines. An element whose class, id or role names
boilerplate is left out unless nearly all text of the page is in it; where a name says so only in
part, its text must be little or mostly links as well. Article and main elements that hold a
region only move the edges: inside them, loose lines in a dive between surges are left out too,
and short notices that stand between paragraphs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table

#: Lines a window sums; the share of the median character's window that a surge reaches; the share
#: of the regions' characters that the article's element holds; and how many times the characters
#: of all the rest, and how many at least, an element holds that is named like boilerplate and isn't.
WINDOW, SURGE, CORE, MOST, LEAST = 3, 0.125, 0.8, 4, 200

# HTML's element kinds.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
CONTROLS = {"select", "button", "datalist", "label", "legend", "option", "optgroup", "output", "progress", "meter"}
#: Controls whose words belong to a sentence that they stand in, outside forms.
SPOKEN = {"label", "button", "output", "meter", "progress"}
NEVER = RAW | CONTROLS | {"head", "nav", "aside", "footer", "header", "noscript", "template", "svg", "math", "object", "dialog", "menu", "canvas", "audio", "video", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption thead tbody tfoot tr td th ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks whose lines are text even where they are short.
KEPT = {"td", "th", "caption", "address"}
#: Blocks of running text, and those whose end tag may be left out: they end where one of the named starts.
RUNNING = HEADINGS | {"p", "blockquote", "pre", "li", "dd", "dt", "figcaption"}
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}

#: Words in a class, id or role that mark boilerplate: surely where a whole name is made of them and
#: of words that may stand beside them, and as weak evidence beside other words.
_HINT = (
    r"nav|navbar|navigation|menu|menubar|sidebar|sidenav|footer|header|masthead|breadcrumbs?|cookies?|consent|gdpr|banner|notices?|alert|"
    r"ad|ads|advert|adverts|advertisement|advertising|adbox|sponsor|sponsored|promo|promotion|newsletter|subscribe|subscription|share|sharing|social|"
    r"related|recommended|comments?|commentlist|replies|disqus|popup|modal|overlay|widget|pagination|pager|login|signup|search|toolbar|tags|"
    r"contentinfo|complementary|skip|disclaimer|copyright|responses?|discussions?|adsbygoogle|adsense|adsanity"
)
#: Words that tell readers' comments and adverts whatever stands beside them.
_STRONG = re.compile(r"comments?|commentlist|repl(?:y|ies)|responses?|discussions?|disqus|ads?|adverts?|advertis(?:ement|ing)|adbox|adsbygoogle|adsense|sponsor(?:ed)?|cookies?|consent|gdpr", re.I)
_STATES = {"has", "with", "without", "no", "not", "is", "open", "opened", "closed", "enabled", "disabled", "layout"}
_COMMENTS = re.compile(r"comments?|commentlist|repl(?:y|ies)|responses?|discussions?|disqus", re.I)
_BESIDE = r"site|main|page|global|top|bottom|left|right|primary|secondary|box|bar|block|list|links?|buttons?|form|area|slot|unit|container|wrap|wrapper|inner|items?|section|post|posts|articles?"
_HINTS, _NAMES = re.compile(_HINT, re.I), re.compile(rf"(?:{_HINT}|{_BESIDE})?", re.I)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?")


class Line(NamedTuple):
    text: str  # with single spaces
    weight: int  # characters outside links
    block: int  # number of the block it stands in
    tag: str  # that block's name
    held: int  # number of the article or main element it stands in; 0: none; negative: one in a skipped wrapper


class Page(NamedTuple):
    lines: list[Line]
    parents: list[int]  # of each block, by its number; block 0 is the page
    hinted: dict[int, int]  # blocks named like boilerplate, and how surely


class _Open(NamedTuple):
    name: str
    block: int
    skips: bool
    before: int | None  # how many skipped elements were open where an article reopened them


#: How surely a name tells that an element isn't the article.
NOT_NAMED, WEAKLY, SURELY, AS_COMMENTS = range(4)


def boilerplate(named: str) -> bool:
    """Whether an element's names say surely that it isn't the article."""
    return evidence(named) >= SURELY


def evidence(named: str) -> int:
    """The strongest evidence among an element's names that it isn't the article.

    Names are cut at dashes, underscores and changes of case. A name that is made of hints and of
    what may stand beside them is sure; among other words, a hint is weak evidence, but for
    words that name comments, adverts and consent alone. A name that tells what an element has
    or in which state it is (has-sidebar) says nothing of the element itself.
    """
    best = NOT_NAMED
    for name in named.split():
        parts = [x for x in (y.rstrip("0123456789") for y in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if not re.fullmatch(r"[0-9]+(?:x[0-9]+)?", y)) if x]
        hints = [] if any(x.lower() in _STATES for x in parts) else [x for x in parts if _HINTS.fullmatch(x)]
        if any(map(_COMMENTS.fullmatch, hints)):
            best = max(best, AS_COMMENTS)
        elif hints and (all(map(_NAMES.fullmatch, parts)) or any(map(_STRONG.fullmatch, hints))):
            best = max(best, SURELY)
        elif hints:
            best = max(best, WEAKLY)
    return best


class _Reader:
    """Reads a page's blocks in order."""

    def __init__(self):
        self.page = Page([], [0], {})
        self.open: list[_Open] = []
        self.names: dict[str, int] = {}
        self.text: list[str] = []
        self.weight = 0
        self.skipping = self.articles = self.depth = 0
        self.linked = self.wrapped = False

    def take(self, piece: str) -> None:
        if not self.skipping and piece:
            self.text.append(piece)
            if not self.linked:
                self.weight += len(piece.strip())

    def block(self) -> _Open | None:
        return next((x for x in reversed(self.open) if x.block), None)

    def end(self) -> None:
        """The line that ends here."""
        if self.text:
            joined = " ".join(html.unescape("".join(self.text)).split())
            if joined:
                at = self.block()
                held = (-self.articles if self.wrapped else self.articles) if self.depth else 0
                self.page.lines.append(Line(joined, min(self.weight, len(joined)), at.block if at else 0, at.name if at else "", held))
            self.text = []
        self.weight = 0

    def pop(self) -> None:
        x = self.open.pop()
        self.names[x.name] -= 1
        self.skipping -= x.skips
        if x.name in ("article", "main"):
            self.depth -= 1
            if x.before is not None:
                self.skipping, self.wrapped = x.before, False

    def close(self, name: str) -> None:
        if self.names.get(name):
            while self.open[-1].name != name:
                self.pop()
            self.pop()

    def push(self, name: str, attributes: str) -> None:
        is_block = name in BLOCKS
        before = None
        if name in ("article", "main"):
            if self.skipping:
                first = next(k for k, x in enumerate(self.open) if x.skips)
                if self.open[first].name in ("nav", "header", "footer", "head") and not self.depth:
                    while len(self.open) > first:  # a menu left open ends where the article starts
                        self.pop()
                elif not self.depth:
                    before, self.skipping, self.wrapped = self.skipping, 0, True
            if not self.depth:
                self.articles += 1
            self.depth += 1
        named = " ".join(next(x for x in (*m.groups(), "") if x is not None) for m in _NAMED.finditer(attributes)) if attributes else ""
        hint = evidence(named) if named and name not in ("html", "body", "article", "main") else NOT_NAMED
        never = name in NEVER and not (name == "header" and self.depth)
        if name in SPOKEN and not self.names.get("form"):
            at = self.block()
            never = not (at and at.name in RUNNING)  # in a sentence it is a word of that
        skips = before is None and (never or (hint >= SURELY and not is_block) or bool(attributes and _HIDDEN.search(attributes)))
        number = 0
        if is_block:
            number = len(self.page.parents)
            at = self.block()
            self.page.parents.append(at.block if at else 0)
            if (hint or name == "form") and not skips:
                self.page.hinted[number] = max(hint, SURELY if name == "form" else hint)
        if is_block or skips or before is not None:
            self.open.append(_Open(name, number, skips, before))
            self.names[name] = self.names.get(name, 0) + 1
            self.skipping += skips

    def read(self, page: str) -> Page:
        at = 0
        while at < len(page):
            token = _TOKEN.search(page, at)
            if not token:
                self.take(page[at:])
                break
            self.take(page[at : token.start()])
            at = token.end()
            closing, name, attributes = token.groups()
            if name is None:
                loose = None if page.startswith("<!--", token.start()) else _LOOSE.match(token.group())
                if not loose or not token.group().endswith(">"):
                    continue
                closing, name, attributes = loose.groups()
            name = name.lower()
            if name == "br":
                self.take(" ")
            elif closing:
                if name in BLOCKS:
                    self.end()
                    self.linked = False
                elif name == "a":
                    self.linked = False
                self.close(name)
            elif name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name == "hr":
                self.end()
            elif name in VOID or attributes.endswith("/"):
                continue
            else:
                if name in BLOCKS:
                    self.end()
                    self.close("p")
                    at_block = self.block()
                    while at_block and at_block.name in _IMPLIED.get(name, ()):
                        self.close(at_block.name)
                        at_block = self.block()
                elif name == "a":
                    self.linked = True
                self.push(name, attributes)
        self.end()
        return self.page


def read_page(page: str) -> Page:
    """The page's lines in order, without those of boilerplate elements, and its tree of blocks."""
    got, parents, hinted = found = _Reader().read(page)
    if not hinted:
        return found
    inside, shown = [0] * len(parents), [0] * len(parents)  # characters outside links, and all
    for x in got:
        inside[x.block] += x.weight
        shown[x.block] += len(x.text)
    for k in range(len(parents) - 1, 0, -1):  # children have greater numbers than their parents
        inside[parents[k]] += inside[k]
        shown[parents[k]] += shown[k]
    out = [False] * len(parents)
    for k in range(1, len(parents)):
        rest, sure = inside[0] - inside[k], hinted.get(k, NOT_NAMED)
        # Weak evidence needs more: little text, or most of it in links.
        little = sure == WEAKLY and (inside[k] < min(LEAST, rest) or 2 * inside[k] < shown[k])
        named = rest > 0 and (sure == AS_COMMENTS or (sure == SURELY and inside[k] < max(MOST * rest, LEAST)) or little)
        out[k] = out[parents[k]] or named
    return Page([x for x in got if not out[x.block]], parents, hinted)


def window_sums(weights: list[int], window: int = WINDOW) -> list[int]:
    """Characters in the ``window`` lines from each line on."""
    return [sum(weights[k : k + window]) for k in range(len(weights))]


def bound(sums: list[int], share: float = SURGE) -> float:
    """The sum from which a window belongs to a surge: a share of the window that the median character is in."""
    half, so_far = sum(sums) / 2, 0
    for total in sorted(sums):
        so_far += total
        if so_far >= half:
            return max(1.0, share * total)
    return 1.0


def regions(weights: list[int], window: int = WINDOW, share: float = SURGE) -> list[tuple[int, int]]:
    """Line ranges between a surge of the window sums and the dive that follows."""
    sums = window_sums(weights, window)
    least = bound(sums, share)
    found, begin = [], None
    for k, total in enumerate(sums):
        if begin is None and total >= least and weights[k]:
            begin = k
        elif begin is not None and total < least:
            found.append((begin, k))
            begin = None
    if begin is not None:
        found.append((begin, len(weights)))
    return found


def core(weights: dict[int, int], parents: list[int], running: set[int]) -> int:
    """The deepest block, none of running text, that holds ``CORE`` of the blocks' characters."""
    held = [0] * len(parents)
    for k, n in weights.items():
        held[k] += n
    best = 0
    for k in range(len(parents) - 1, 0, -1):
        held[parents[k]] += held[k]
    for k in range(1, len(parents)):
        if parents[k] == best and k not in running and held[k] >= CORE * held[0]:
            best = k
    return best


def main_text(page: str) -> str:
    """The page's main text; blocks are joined by a new line. A page without any has none.

    Article and main elements that hold a region are kept but for what dives. Those in a skipped wrapper
    count where they hold most of the page; on other pages the blocks alone tell.
    """
    got, parents, _ = read_page(page)
    held = [x for x in got if x.held > 0]
    if held:
        weights = [x.weight if x.held > 0 else 0 for x in got]
        found = regions(weights)
        marked = {got[k].held for a, b in found for k in range(a, b) if weights[k]}
        kept = [k for k, x in enumerate(got) if x.held > 0 and (x.held in marked or not marked)]
        return "\n".join(got[k].text for k in kept if not _dived(k, got, weights, found))
    wrapped = [x for x in got if x.held < 0]
    if wrapped and 2 * sum(x.weight for x in wrapped) >= sum(x.weight for x in got):
        return "\n".join(x.text for x in wrapped)
    return "\n".join(x.text for x in article([x for x in got if not x.held], parents))


#: Words of consent and of offers; a loose line beside running text that has some of them is a notice.
_NOTICE = re.compile(r"\b(?:cookies?|consent|gdpr|newsletter|subscribe|sign up|log in|accept all|privacy policy|advertisement|cookie-einstellungen|datenschutz|abonnieren|s'abonner|suscr[ií]bete)\b", re.I)


def _dived(k: int, got: list[Line], weights: list[int], found: list[tuple[int, int]]) -> bool:
    """Whether a line inside an article isn't of its text, by its line blocks.

    Lines of running text stay. A loose line (of no paragraph, heading, list item or cell) goes
    where the sums of its lines dive below the page's bound between two surges, as lists of links
    and bars do; and where it is short against the windows around it and words tell a notice.
    """
    x = got[k]
    if x.tag in RUNNING or x.tag in KEPT or not found:
        return False
    if found[0][0] < k < found[-1][1] and not any(a <= k < b for a, b in found):
        return True
    around = sum(weights[max(0, k - WINDOW) : k]) + sum(weights[k + 1 : k + 1 + WINDOW])
    return len(x.text) < LEAST and 4 * len(x.text) < around and bool(_NOTICE.search(x.text))


def article(got: list[Line], parents: list[int]) -> list[Line]:
    """The article's lines among a page's, from the first surge to the last dive in the block that holds it."""
    weights = [x.weight for x in got]
    if not any(weights):
        return got
    found = regions(weights)
    by_block: dict[int, int] = {}
    for a, b in found:
        for k in range(a, b):
            by_block[got[k].block] = by_block.get(got[k].block, 0) + weights[k]
    best = core(by_block, parents, {x.block for x in got if x.tag in RUNNING})
    inside = [False] * len(parents)
    inside[best] = True
    for k in range(best + 1, len(parents)):
        inside[k] = inside[parents[k]]
    held = [inside[x.block] for x in got]
    least = bound(window_sums(weights))
    first, last = found[0][0], found[-1][1]
    # A window reaches ahead, so a surge may begin at short lines before the text.
    while first < last - 1 and not (held[first] and (got[first].tag in RUNNING or weights[first] >= least)):
        first += 1
    while last > first + 1 and not (held[last - 1] and weights[last - 1]):
        last -= 1
    while last < len(got) and held[last] and got[last].tag in RUNNING and weights[last]:
        last += 1
    while first and weights[first - 1] and got[first - 1].tag != "li" and ((held[first - 1] and got[first - 1].tag in RUNNING) or got[first - 1].tag in HEADINGS):
        first -= 1
    out: list[Line] = []
    k = first
    while k < last:
        end = k + 1
        while not weights[k] and end < last and not weights[end]:
            end += 1
        if weights[k] or end - k < WINDOW:  # a window of links alone is a menu
            out += got[k:end]
        k = end
    return [x for x in out if inside[x.block] or x.tag in HEADINGS]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, in one pass without a shuffle.

    A null html is an empty page with an empty text; repeated rows give a row each; an
    empty table gives no rows. The whole html is read and the whole main text kept.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
