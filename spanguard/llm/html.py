"""Main text of web pages by the line-block distribution.

Markup is stripped so that each block of the page is one line; a part that can hold no article text (menu, header, footer, form,
script, advert, comments and the like) leaves an empty line. A class, id, role or label names such a part only as a whole, and ids of headings
and paragraphs do not; a part named so stays if it holds long text of few links (see `_without`). Of a part whose end is missing only the first line is
left out. The lengths of `window` lines from each line on are
summed: text begins where the sum surges from nothing and ends where it dives back to nothing. The
article is every stretch whose sums reach `surge` characters, or half of the highest sum of a page of less text, and of which at most half
lies in links; if there is none, the stretch with most text. A page that marks its article has only the lines inside the mark summed, and keeps each
of their stretches. In `<article>` links count as text; in `<main>` alone, which often holds menus, they do not, so there links of `window` or more lines in a
row, without other text, are left out. An article that is named as a comment, or stands among comments, is no mark. A form is judged by its text.

Defined results: null or empty html gives the empty text; unclosed and stray tags are allowed; nothing is cut off.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanguard.llm.common import table
from spanguard.session import ship_package

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SPECIAL = re.compile("['\">]")
_NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math"}
_ASIDE = {"nav", "footer", "aside", "select", "button", "menu", "dialog", "head"}
_MAIN = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins",
           "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr"}
#: Elements that the start of another one ends, so that they need no end tag.
_OPEN = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "optgroup", "thead", "tbody", "tfoot", "colgroup", "caption"}
_SURE_WORDS = r"ads?|advert[^\W_]*|banner|sponsor[^\W_]*|promo[^\W_]*|cookies?|consent|popup|modal|newsletter|subscribe|subscription|signup|sharing|social|nav|navbar|navigation|" \
    r"menu|breadcrumbs?|sidebar|footer|header|masthead|login|pagination|pager|skip|toolbar|complementary|contentinfo"
_TALK_WORDS = r"comments?|commentlist|replies|respond|disqus"
#: Words that an article may be about, or put a part of it under.
_WEAK_WORDS = r"notice|alert|share|side|widget|related|recommended|reply|search|tags"
#: Words that only say what kind of box it is.
_BOX_WORDS = r"area|bar|block|body|bottom|box|buttons?|container|content|form|global|group|icons?|inner|items?|left|links?|list|main|outer|panel|posts|primary|right|secondary|section|site|text|top|wrap|wrapper"
#: A class, id, role or label is odd as a whole: each of its parts is one of these words, and not all are boxes.
_ODD = re.compile(rf"(?=.*(?:^|[_-])(?:{_SURE_WORDS}|{_TALK_WORDS}|{_WEAK_WORDS})(?:$|[_-]))(?:(?:{_SURE_WORDS}|{_TALK_WORDS}|{_WEAK_WORDS}|{_BOX_WORDS})(?:$|[_-]+(?=.)))+", re.I)
_IS_TALK, _IS_SURE = (re.compile(rf"(?:^|[_-])(?:{x})(?:$|[_-])", re.I) for x in (_TALK_WORDS, f"{_SURE_WORDS}|{_TALK_WORDS}"))
#: How a part is judged: left out whatever it holds, unless the rest of the page holds nothing, by its share of the page, or by its own length.
ASIDE, TALK, SURE, WEAK = range(4)
#: From so many characters outside links on, a part may hold text in spite of its name.
_LONG, _MUCH = 80, 200


def _kind(name: str, attributes: str, inside: bool) -> int | None:
    """What kind of left-out part an element may open, if any."""
    if name in _ASIDE or name == "header" and not inside or "hidden" in attributes.lower() and re.search(
            r"\bhidden\b(?!\s*=\s*[\"']?false)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        return ASIDE
    found = [SURE] if name == "form" else []
    for key, value in _NAMES.findall(attributes):
        tokens = value.strip("\"'").split()
        if key.lower() == "aria-label":
            tokens = ["-".join(tokens)]
        elif key.lower() == "id" and (name == "p" or name in _HEADINGS):
            continue
        found += [TALK if _IS_TALK.search(x) else SURE if _IS_SURE.search(x) else WEAK for x in tokens
                  if _ODD.fullmatch(x) and not (inside and x.lower() == "header")]
    return min(found, default=None)


class _Tags:
    """Tags of a page from left to right, in time that grows with the page, whatever it holds.

    A tag ends at the first `>` outside quotes, or, where its quotes do not end, at the first one at all. A search that comes to a quote at which an
    earlier one has gone wrong goes wrong, too, so no quote is followed twice.
    """

    def __init__(self, page: str):
        self.page = page
        self.bad: set[int] = set()
        self.special: tuple[int, int] = (0, -1)  # from where on, and where, a quote or `>` comes next

    def _next(self, at: int) -> int:
        if not self.special[0] <= at <= self.special[1]:
            found = _SPECIAL.search(self.page, at)
            self.special = (at, found.start() if found else len(self.page))
        return self.special[1]

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at `at`, or -1."""
        begun, first = [], at
        while True:
            at = self._next(at)
            if at == len(self.page) or at in self.bad:
                break
            if self.page[at] == ">":
                return at
            begun.append(at)
            at = self.page.find(self.page[at], at + 1) + 1
            if not at:
                break
        self.bad.update(begun)
        return self.page.find(">", first) if begun or at != len(self.page) else -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Where the next tag begins and ends, its name (empty for a comment or declaration), whether it closes, and its attributes."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                return at, stop + 3 if stop >= 0 else len(page), "", False, ""
            if page.startswith(("<!", "<?"), at):
                stop = page.find(">", at)
                if stop >= 0:
                    return at, stop + 1, "", False, ""
            elif match := _TAG.match(page, at):
                stop = self._end(match.end())
                if stop >= 0:
                    return at, stop + 1, match[2].lower(), bool(match[1]), page[match.end():stop]
            else:
                at += 1
                continue
            if page.find(">", at) < 0:
                return None  # no tag ends from here on
            at += 1
        return None


class _Part:
    """A part of the page that may be left out: where it lies, and its characters outside links and in all."""

    def __init__(self, kind: int, parent: _Part | None, line: int):
        self.kind, self.parent, self.line = kind, parent, line
        self.up = parent
        self.plain = self.all = 0
        self.ended = True
        self.first: int | None = None  # of a part that nothing ends, only the first line with text belongs to it
        self.out = False


def _lines(page: str) -> list[tuple[str, int, int]]:
    """Lines of a page: text, characters outside links (in a mark also those of linked headings), and whether it lies in a mark (1) or in an article (2);
    an empty text for a left-out part."""
    lines: list[tuple[str, int, int, _Part | None]] = []
    words: list[str] = []
    plain = links = inside = articles = heading = 0
    tags = _Tags(page)
    parts: list[_Part] = []
    stack: list[tuple[str, _Part | None, int]] = []  # open elements: name, the part one opens, links before (-1: a mark)
    names: Counter[str] = Counter()
    part: _Part | None = None
    at, end = 0, len(page)

    def close() -> None:
        nonlocal plain
        text = " ".join("".join(words).split())
        if text:
            lines.append((text, plain, (inside > 0) + (articles > 0), part))
        words.clear()
        plain = 0

    def add(piece: str) -> None:
        nonlocal plain
        if piece:
            piece = entities.unescape(piece)
            words.append(piece)
            if not links or heading and inside:
                plain += len("".join(piece.split()))

    def pop(ended: bool) -> None:
        """Leave the last open element; `ended` if its end is known."""
        nonlocal part, links
        name, mine, before = stack.pop()
        names[name] -= 1
        if mine is not None:
            close()
            if not ended:
                mine.ended = False
            part, links = mine.parent, before

    while at < end:
        tag = tags.next(at)
        if tag is None:
            add(page[at:])
            break
        add(page[at:tag[0]])
        _, at, name, closing, attributes = tag
        if not name:
            continue
        if name in _RAW and not closing:
            if attributes.rstrip().endswith("/"):
                continue
            stop = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            if name != "title":
                words.append(" ")
            continue
        opens = not closing and name not in _VOID and name != "html"
        kind = _kind(name, attributes, inside > 0) if opens and name != "body" else None
        if name in _MAIN and kind == WEAK:
            kind = None
        talk = False  # what is marked as an article among comments is one of them
        if name in _MAIN and opens:
            around = part
            while around is not None and not talk:
                talk, around = around.kind == TALK, around.parent
        if not closing and (name == "body" or name in _MAIN and kind is None and not talk):
            close()
            while part is not None:
                pop(True)  # an article ends whatever was left open
            links = 0
            if name != "body":
                inside += 1
                articles += name == "article"
                stack.append((name, None, -1))
                names[name] += 1
            continue
        if closing:
            mark = name in _MAIN
            if names[name]:
                while stack[-1][0] != name:
                    pop(stack[-1][0] in _OPEN)
                mark &= stack[-1][2] < 0
                pop(True)
            if mark:
                close()
                inside = max(0, inside - 1)
                articles = max(0, articles - (name == "article"))
                if not inside:
                    lines.append(("", 0, 0, part))
                continue
        if opens:
            if stack and stack[-1][0] in _OPEN and (stack[-1][0] == name or stack[-1][0] == "p" and name not in _INLINE):
                pop(True)
            opened = None
            if kind is not None:
                close()
                lines.append(("", 0, (inside > 0) + (articles > 0), part))
                opened = part = _Part(kind, part, len(lines))
                parts.append(part)
            if opened or names[name] or name not in _INLINE and name not in _OPEN:
                stack.append((name, opened, links))
                names[name] += 1
        if name == "a":
            links = 0 if closing else 1
        if name in _HEADINGS:
            heading = 0 if closing else 1
        if name in _INLINE:
            if name in ("br", "td", "th"):
                words.append(" ")
        else:
            close()
    close()
    while stack:
        pop(stack[-1][0] in _OPEN)
    return _without(lines, parts) if parts else [x[:3] for x in lines]


def _without(lines: list[tuple[str, int, int, _Part | None]], parts: list[_Part]) -> list[tuple[str, int, int]]:
    """Lines without those of the parts that hold no article text by their names, lengths and link shares."""
    texts_from, at = [0] * (len(lines) + 1), len(lines)  # the next line with text
    for i in range(len(lines), -1, -1):
        texts_from[i] = at = i if i < len(lines) and lines[i][0] else at
    for part in parts:
        part.first = None if part.ended else texts_from[part.line]
    owners = []
    for i, (text, plain, inside, part) in enumerate(lines):
        while part is not None and part.first is not None and i > part.first:
            if part.up is not None and part.up.first is not None and i > part.up.first:
                part.up = part.up.up  # it has ended for good
            else:
                part = part.up
        owners.append(part)
        if part is not None and text:
            part.plain += plain
            part.all += len("".join(text.split()))
    for part in parts:
        while part.parent is not None and part.parent.first is not None and part.line > part.parent.first:
            part.parent = part.parent.parent
    for part in reversed(parts):  # inner ones come after outer ones
        if part.parent is not None:
            part.parent.plain += part.plain if part.kind != ASIDE else 0
            part.parent.all += part.all if part.kind != ASIDE else 0
    marked = any(plain and inside and (owner is None or owner.kind != ASIDE) for (_, plain, inside, _), owner in zip(lines, owners))
    whole = sum(plain for (_, plain, inside, _), owner in zip(lines, owners) if (inside or not marked) and (owner is None or owner.kind != ASIDE))
    for part in parts:  # outer ones first
        texts = 2 * part.plain >= part.all
        if part.kind == WEAK:
            stays = part.plain >= _LONG and texts
        elif part.kind == SURE:
            stays = part.plain >= _MUCH and texts and 2 * part.plain >= whole
        else:
            stays = part.kind == TALK and part.plain >= _MUCH and texts and part.plain == whole
        part.out = not stays or part.parent is not None and part.parent.out
    return [x[:3] for x, owner in zip(lines, owners) if owner is None or not owner.out]


def main_text(page: str | None, window: int = 3, surge: int = 40) -> str:
    """Blocks of the article, joined by two line feeds; `surge` counts characters other than white space and links."""
    if not page:
        return ""
    lines = _lines(page)
    marked = any(size and within for _, size, within in lines)
    if marked:
        # In an article, links count as text: a list of them is a part of it.
        lines = [x if x[2] == 1 else (x[0], len("".join(x[0].split())), 2) if x[2] else ("", 0, 0) for x in lines]
    sizes = [size for _, size, _ in lines] + [0] * window
    sums = [sum(sizes[i:i + window]) for i in range(len(lines))]
    stretches, start = [], None
    for i in range(len(lines) + 1):
        busy = i < len(lines) and sums[i] > 0
        if busy and start is None and sizes[i]:
            start = i  # a surge, from its first line with text
        elif not busy and start is not None:  # a dive
            stretches.append((start, i))
            start = None
    if not marked and stretches:
        peaks = [max(sums[a:b]) for a, b in stretches]
        least = min(surge, max(peaks) / 2)
        stretches = [(a, b) for (a, b), peak in zip(stretches, peaks) if peak >= least and 2 * sum(sizes[a:b]) >= sum(
            len("".join(text.split())) for text, _, _ in lines[a:b])] or [max(stretches, key=lambda x: (sum(sizes[x[0]:x[1]]), -x[0]))]
    return "\n\n".join(text for a, b in stretches for text, _, _ in lines[a:b] if text)


def extract(pages: DataFrame, html: str = "html", output: str = "text") -> DataFrame:
    """Add the main text of each page; the html itself is dropped, all other columns stay."""
    ship_package(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, output)]
    source = pages.select(*keep, F.col(html).cast("string").alias(output))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], schema=batch.schema)

    return source.mapInArrow(run, source.schema)


def op6_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    texts = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))
