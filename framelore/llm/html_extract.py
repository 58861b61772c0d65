"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Pass one decides blocks by where they stand (menus, headers, footers,
sidebars, notices, adverts, forms, comments; wrappers of the page that are only named like them don't count), by length, link density and stop-word density.  Pass two gives each
ambiguous block the label of its nearest decided neighbour in the same part of the page.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words of English, French, German and Spanish.
STOP = frozenset(
    "a about after all an and are as at be been but by for from had has have he her his i if in into is it its more no not "
    "of on one or other she so that the their there they this to up was we were which who will with would you "
    "au aux avec ce cette dans de des du elle en est et il je la le les leur mais ne nous on ou par pas plus pour que qui "
    "sa se ses son sont sur un une vous "
    "als am an auch auf aus bei das dem den der die ein eine einem einen einer es für hat ich ihr im in ist mit nach nicht "
    "noch nur oder sich sie sind so über um und von war was wie wir wird zu zum zur "
    "al como con cuando del donde el ella entre era es esta este fue ha hay la las lo los más muy nos o para pero por que "
    "se ser si sin sobre su sus también un una y ya".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page, read to their end tag as they stand.
RAW = frozenset("script style noscript template textarea select svg math iframe object canvas audio video title head button".split())
#: Elements that are not part of an article.
OUTSIDE = frozenset("nav footer aside form dialog menu fieldset".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status note".split()
)
#: Parts of class and id names that mark boilerplate and content.
BAD_NAME = re.compile(
    r"(?:^|[-_])(?:ads?|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|comments?|commentlist|disqus|respond|replies|reply|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side|aside|widget\w*|related|recommend\w*|more-stories|"
    r"footer|foot|header|masthead|topbar|toolbar|cookie\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|social|share|sharing|follow|tags?|tagcloud|author-bio|byline-links|copyright|legal|"
    r"disclaimer|skip|search|form|toc|hidden|print-only|outbrain|taboola)(?:$|[-_])",
    re.I,
)
#: Names that say how an element looks, what state it is in or where its content is filed, not what it is.
NEUTRAL_NAME = re.compile(r"(?:has|no|with|without|is|not|tag|tags|category|cat|type|status|format|layout|js|u)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled|active|inactive|visible|loaded|ready)", re.I)
#: Parts of compound names that page layouts have too: such an element may hold the whole page.
LAYOUT_NAME = re.compile(r"sidebar|side|aside|header|footer|nav|navbar|menu|form|toolbar|topbar|banner|overlay|modal|search|widget\w*|share|social|notice", re.I)
#: A header of these is an article's own.
OWN_HEADER = re.compile(r"(?:entry|post|article|story|page|content|section)[-_]?header|header", re.I)
GOOD_NAME = re.compile(
    r"(?:^|[-_ ])(?:article|article-?body|post|post-?body|post-?content|entry|entry-?content|content|main|main-?content|"
    r"story|story-?body|maincontent|body-?text|text)(?:$|[-_ ])",
    re.I,
)
#: Where a tag, an end tag, a comment or a declaration begins.
OPENING = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
UNQUOTED = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: A paragraph tag is closed by these; so is a list item by the next one, and so on, up to the elements they are parts of.
CLOSES_P = BLOCK - frozenset("body html head option optgroup".split())
HOLDS_P = "article main section div td table blockquote aside body".split()
SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
HOLDS_SAME = "ul ol dl table select".split()
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

GOOD, BAD, UNSURE = 1, -1, 0
#: Boilerplate unless it holds the page's article or most of its long text.
WEAK = -2
#: That much of the long text makes a wrapper, half where there is marked content in it; blocks of so many characters are long text.
WRAPPER, LONG = 0.75, 70


def _attributes(raw: str) -> dict[str, str]:
    return {m[0].lower(): unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}


def _kind(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """What an element says of the blocks in it: BAD boilerplate, GOOD content, UNSURE nothing."""
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    role = attrs.get("role", "").lower()
    style = attrs.get("style", "").replace(" ", "").lower()
    if tag in OUTSIDE and tag != "form" or role in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style:
        return BAD
    if tag == "header" and not inside:
        return BAD
    tokens = [t for t in names.split() if not NEUTRAL_NAME.fullmatch(t)] if tag not in ("html", "body") else []
    bad = [t for t in tokens if BAD_NAME.search(t) and not (inside and OWN_HEADER.fullmatch(t))]
    if bad and not (tag in ("article", "main") and any(GOOD_NAME.search(t) for t in tokens)):
        compound = all(re.search(r"[-_]", t) and all(LAYOUT_NAME.fullmatch(x) for x in re.split(r"[-_]", t) if BAD_NAME.fullmatch(x)) for t in bad)
        return WEAK if tag in BLOCK and (compound or tag == "form") else BAD
    if tag == "form":
        return WEAK
    if tag in ("article", "main") or role in ("main", "article") or attrs.get("itemprop") == "articleBody":
        return GOOD
    if tag in ("div", "section", "td") and names.strip() and GOOD_NAME.search(names):
        return GOOD
    return UNSURE


class _Blocks:
    """Collects the blocks of one page: [text, characters in links, standing, heading].

    The stack of open elements is kept with counts and with the places of each tag, so that no step walks through it.
    """

    def __init__(self) -> None:
        self.done: list[list] = []
        self.open: list[tuple] = []  # tag, kind, then for inline elements where they begin
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.bad = self.good = self.heading = 0
        self.weak: list[int] = []  # open weak elements; the parent of each, what it holds (1: content, 3: the article)
        self.parent: list[int] = []
        self.holds: list[int] = []
        self.under: list[int] = []  # innermost weak element of each block, -1: none
        self.parts: list[str] = []
        self.linked = 0
        self.pending: list[tuple[int, int]] = []  # block and characters in the open link, counted once it is closed
        self.dropped: list[tuple[int, int]] = []  # ranges of blocks in inline boilerplate

    def cut(self) -> None:
        text = " ".join(unescape("".join(self.parts)).split())
        if text:
            self.done.append([text, self.linked, BAD if self.bad else GOOD if self.good else UNSURE, self.heading > 0])
            self.under.append(self.weak[-1] if self.weak else -1)
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        self.parts.append(raw)
        if self.places.get("a"):
            self.pending.append((len(self.done), len(raw.strip())))

    def push(self, tag: str, kind: int, article: bool = False) -> None:
        if kind == GOOD and self.weak and not self.bad:
            self.holds[self.weak[-1]] |= 3 if article else 1
        if kind == WEAK:
            self.parent.append(self.weak[-1] if self.weak else -1)
            self.weak.append(len(self.holds))
            self.holds.append(0)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.block_places.append(len(self.open))
            self.bad += kind == BAD
            self.good += kind == GOOD
            self.heading += tag in HEADING
            self.open.append((tag, kind))
        else:
            first = len(self.done) + any(p.strip() for p in self.parts) if kind == BAD else 0
            self.open.append((tag, kind, first, len(self.done), len(self.parts), self.linked, len(self.pending)))

    def pop_to(self, place: int) -> None:
        while len(self.open) > place:
            tag, kind, *_ = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.block_places.pop()
                self.bad -= kind == BAD
                self.good -= kind == GOOD
                self.heading -= tag in HEADING
                if kind == WEAK:
                    self.weak.pop()
            elif tag == "a" and not self.places["a"]:
                self.pending = []

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, tag: str, stops=()) -> None:
        place = self.last((tag,))
        if place >= 0 and place > self.last(stops):
            self.pop_to(place)

    def start(self, tag: str, raw: str) -> None:
        if tag in BLOCK:
            self.cut()
            if tag in CLOSES_P:
                self.close("p", HOLDS_P)
            if tag in SAME:
                for other in SAME[tag].split():
                    self.close(other, HOLDS_SAME)
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.close("a", ())
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            return
        attrs = _attributes(raw)
        kind = _kind(tag, attrs, self.good > 0)
        main = tag == "main" or attrs.get("role", "").lower() == "main" or attrs.get("itemprop") == "articleBody"
        form = bool(self.weak) and self.places.get("form")  # a form around the page holds its article under any of its names
        self.push(tag, kind, main or bool(form))

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
            self.close(tag, ("body",) if tag not in ("body", "html") else ())
        elif self.last((tag,)) > (self.block_places[-1] if self.block_places else -1):
            self.end_inline(self.last((tag,)))

    def end_inline(self, place: int) -> None:
        """An inline element is closed by its own end tag: only now its characters are a link's or boilerplate.

        One that is never closed says nothing, so that no paragraph is lost with it.
        """
        tag, kind, first, block, part, linked, pending = self.open[place]
        if tag == "a":
            for at, n in self.pending:
                if at < len(self.done):
                    self.done[at][1] += n
                else:
                    self.linked += n
            self.pending = []
        if kind == BAD:
            del self.pending[pending:]
            if block == len(self.done) and part <= len(self.parts):
                self.linked = linked
                del self.parts[part:]
            else:
                self.dropped.append((first, len(self.done)))
                self.parts, self.linked = [], 0
        self.pop_to(place)

    def result(self) -> list[tuple[str, int, int, bool]]:
        self.cut()
        depth = [0] * (len(self.done) + 1)
        for first, end in self.dropped:
            if first < end:
                depth[first] += 1
                depth[end] -= 1
        bad = self._boilerplate()
        out, inside = [], 0
        for (text, linked, standing, heading), change, weak in zip(self.done, depth, self.under):
            inside += change
            out.append((text, linked, BAD if inside or weak >= 0 and bad[weak] else standing, heading))
        return out

    def _boilerplate(self) -> list[bool]:
        """Of each weak element whether it, or one that holds it, is boilerplate after all.  Parents come before what they hold."""
        own = [0] * len(self.parent)
        every = 0
        for (text, _, standing, _), weak in zip(self.done, self.under):
            if standing != BAD and len(text) >= LONG:
                every += len(text)
                if weak >= 0:
                    own[weak] += len(text)
        for i in range(len(own) - 1, -1, -1):
            if self.parent[i] >= 0:
                own[self.parent[i]] += own[i]
                self.holds[self.parent[i]] |= self.holds[i]
        bad: list[bool] = []
        for i, parent in enumerate(self.parent):
            wrapper = self.holds[i] > 1 or every and own[i] >= (WRAPPER if not self.holds[i] else 0.5) * every
            bad.append(not wrapper or parent >= 0 and bad[parent])
        return bad


def _tag_end(html: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` ends: at the first > that no quoted value holds; -1: nowhere."""
    end = html.find(">", at)
    if end < 0 or '"' not in html[at:end] and "'" not in html[at:end]:
        return end
    i = at
    while True:
        i = UNQUOTED.match(html, i).end()
        if i >= len(html):
            return -1
        if html[i] == ">":
            return i
        before = i - 1
        while html[before].isspace():
            before -= 1
        if html[before] == "=":
            i = html.find(html[i], i + 1)
            if i < 0:
                return -1
        i += 1


def blocks(html: str) -> list[tuple[str, int, int, bool]]:
    """The blocks of a page in page order, in time that grows with its length whatever is broken in it.

    A quoted value that is never closed ends the search for quotes: from there on tags end at the first >.
    """
    out, at, read = _Blocks(), 0, 0
    lower, absent, quotes = None, set(), True
    while m := OPENING.search(html, at):
        comment, data, other, slash, name = m.groups()
        if comment or data or other:
            ending = "-->" if comment else "]]>" if data else ">"
            end = html.find(ending, m.end())
            end = len(html) if end < 0 else end + len(ending)
            tag = raw = ""
        else:
            close = _tag_end(html, m.end()) if quotes else html.find(">", m.end())
            if close < 0 and quotes:
                quotes, close = False, html.find(">", m.end())
            if close < 0:
                break
            tag, raw, end = name.lower(), html[m.end() : close], close + 1
        if m.start() > read:
            out.text(html[read : m.start()])
        at = read = end
        if not tag:
            continue
        if slash:
            out.end(tag)
        elif tag in RAW and not raw.endswith("/"):
            if tag == "head":
                out.cut()
                continue
            lower = lower if lower is not None else _ascii_lower(html)
            end = -1 if tag in absent else lower.find(f"</{tag}", at)
            if end < 0:
                absent.add(tag)
            if tag in ("title", "textarea", "script", "style") or end >= 0:
                close = html.find(">", end) if end >= 0 else -1
                at = read = close + 1 if close >= 0 else len(html)
        else:
            out.start(tag, raw)
    out.text(html[read:])
    return out.result()


def _ascii_lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'«»…#$%&*|") in STOP for w in words) / max(1, len(words))


def label(block: tuple[str, int, int, bool], long: int, links: float, stops: float) -> int:
    """Pass one.  ``stops`` of zero: the page's language is not known, and stop words decide nothing."""
    text, linked, standing, heading = block
    if standing == BAD:
        return BAD
    dense = linked / len(text) > links
    if standing == GOOD:
        return BAD if dense and len(text) < long and not heading else GOOD if len(text) >= long and stop_density(text) >= stops else UNSURE
    if dense or "©" in text and len(text) < long:
        return BAD
    if len(text) < long:
        return UNSURE
    density = stop_density(text)
    return GOOD if density >= stops else BAD if density < stops / 3 else UNSURE


def _nearest(found: list[tuple[str, int, int, bool]], labels: list[int], order) -> list[tuple[int, int] | None]:
    """For each block the place and label of the decided block of its standing that comes before it in this order."""
    out, seen = [None] * len(found), {}
    for i in order:
        out[i] = seen.get(found[i][2])
        if labels[i] != UNSURE:
            seen[found[i][2]] = (i, labels[i])
    return out


def main_text(html: str | None, long: int = 70, links: float = 0.33, stops: float = 0.12) -> str:
    """Main text of a page: its article's blocks in page order, white space in a block as one space, joined by blank lines.

    Where a page marks its article (article, main, or a content class), only blocks in it can be main text, and an
    ambiguous block is boilerplate only if its nearest decided neighbours there are.  Stop words are known of English,
    French, German and Spanish; on a page where fewer than one word in fifty outside boilerplate is one, they decide
    nothing.  Null and empty pages: empty.
    """
    found = blocks(html or "")
    if any(b[2] == GOOD for b in found):
        found = [b for b in found if b[2] != UNSURE]
    words = [(len(b[0].split()), stop_density(b[0])) for b in found if b[2] != BAD and len(b[0]) >= long]
    if sum(n * share for n, share in words) < 0.02 * sum(n for n, _ in words):
        stops = 0.0
    labels = [label(b, long, links, stops) for b in found]
    before, after = _nearest(found, labels, range(len(found))), _nearest(found, labels, range(len(found) - 1, -1, -1))
    kept = []
    for i, b in enumerate(found):
        if labels[i] == UNSURE:
            near = sorted((abs(i - x[0]), x[1]) for x in (before[i], after[i]) if x)
            if b[3] and after[i]:  # a heading goes with what it heads
                keep = after[i][1] == GOOD
            elif near:
                keep = any(x[1] == GOOD for x in near if x[0] == near[0][0])
            else:
                keep = b[2] == GOOD
            if keep or b[2] == GOOD and GOOD not in labels:
                kept.append(b[0])
        elif labels[i] == GOOD:
            kept.append(b[0])
    return "\n\n".join(kept)


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", **rules) -> DataFrame:
    """Every row of pages with its other columns, html_col replaced by out_col (main text) and n_chars (code points).

    Null html gives empty text; rows repeat as they stand; other columns keep values and names, but one that is called
    out_col or n_chars gives way.  An empty table gives an empty result.  Only the html goes through Python.
    """

    @F.pandas_udf("string")
    def extracted(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, **rules) for h in html], dtype=object)

    keep = [pages[f"`{c}`"] for c in pages.columns if c not in (html_col, out_col, "n_chars")]
    out = pages.select(*keep, extracted(pages[f"`{html_col}`"]).alias(out_col))
    return out.withColumn("n_chars", F.char_length(F.col(f"`{out_col}`")).cast("long"))
