"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block element or line break; what HTML names as no content (scripts, styles,
forms, navigation, footers, sidebars and elements whose class, id or role says so) goes with the markup. Then the text
lengths of each window of ``WINDOW`` lines are summed, link texts left out. The text surges where a sum reaches ``SURGE`` and dives
where the lines of a whole window hold nothing but links; text between a surge and its dive is kept, what lies outside goes. At the
edges, headings and paragraphs right above a surge are part of it, and menu entries (links, a few words that are no paragraph)
are not. Articles (else main elements) that the page marks as such are summed apart: if their lines surge, they are the text, whole and
all of them, and what is around them goes; else the lines around them decide. A page whose text never surges keeps all its lines.

Edge cases: null or empty html gives the empty text; a page without markup is text; elements that are never closed end with their parent, or, at the end
of the page, are not dropped (footers, scripts and styles are); an element around all articles of the page is not dropped for its
class, nor is a form; a ``<`` that no ``>`` follows is text; from a tag on whose quotes never end, quotes no longer hide a ``>``; character references are decoded once, for each
piece of text; any white space in a line becomes one space; pages take time in proportion to their length, however broken or
long they are; rows are independent, so repeated rows, ties, null ids and any other columns do no harm (one named as the output is
replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, SURGE = 3, 80
#: Words up to which a line that is no paragraph, heading or sentence counts as a menu entry.
MENU_WORDS = 3
BATCH_ROWS = 500

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
STOP = re.compile(r"[>\"']")
#: Elements by their role in HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "fieldset", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "ruby", "rt", "rp", "input", "link", "meta"}
#: Elements whose end another start tag may imply, and the open elements that their start ends.
ENDED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"},
         **dict.fromkeys(("thead", "tbody", "tfoot"), {"thead", "tbody", "tfoot", "tr", "td", "th"})}
#: Dropped elements that may stand within a line.
PHRASES = {"button", "select", "svg", "canvas", "object", "audio", "video", "noscript", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "blockquote", "pre", "dd"}
#: Words of class, id and role that name what is no content.
NO_CONTENT = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "menu", "nav", "navbar", "navigation",
              "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "share", "sharing", "social",
              "related", "recommended", "comment", "comments", "disqus", "widget", "search", "login", "signup", "contentinfo", "complementary", "pagination", "skip"}
#: The words of these that name what is no content of an article or main element either.
CONTAINERS, NO_ARTICLE = {"article", "main"}, {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "related", "recommended", "comment", "comments"}
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""", re.I)
SPACES = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")


class Line(NamedTuple):
    text: str
    plain: int  # characters outside links
    owner: int  # the article or main element, or -1
    kind: str  # the block element it stands in


def _no_content(name: str, attributes: str, in_container: bool) -> bool:
    if name in DROPPED:
        return True
    if name == "header":
        return not in_container
    if attributes and name not in ("html", "body"):
        words = NO_ARTICLE if name in CONTAINERS else NO_CONTENT - {"header"} if in_container else NO_CONTENT
        for m in ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "hidden" or m[1].lower() == "aria-hidden" and value == "true":
                return True
            if any(w in words for w in re.split(r"[\s_\-]+", value)):
                return True
    return False


def tokens_of(page: str) -> list[tuple[str, str, str]]:
    """("t", text, ""), ("o", name, attributes) or ("c", name, "") in page order, by one pass from each ``<`` to its ``>``."""
    out: list[tuple[str, str, str]] = []
    last = {c: page.rfind(c) for c in "\"'>"}
    quoting, begin, at, n = True, 0, 0, len(page)

    def text(end: int) -> None:
        if end > begin:
            out.append(("t", page[begin:end], ""))

    while True:
        p = page.find("<", at)
        if p < 0 or p >= last[">"]:
            text(n)
            return out
        follows = page[p + 1 : p + 2]
        if follows in ("!", "?") or page.startswith("</", p) and not page[p + 2 : p + 3].isalpha():
            text(p)
            if page.startswith("<!--", p):
                end = page.find("-->", p + 2)
                begin = at = n if end < 0 else end + 3
            else:
                begin = at = page.find(">", p) + 1
            continue
        m = NAME.match(page, p + 1)
        if m is None:
            at = p + 1  # a bare < is text
            continue
        end = pos = m.end()
        while quoting:
            stop = STOP.search(page, pos)
            if stop is None:
                quoting = False
            elif stop[0] == ">":
                end = stop.start()
                break
            elif page[pos : stop.start()].rstrip().endswith("=") and last[stop[0]] > stop.start():
                pos = page.find(stop[0], stop.end()) + 1
            else:
                pos = stop.end()
        if not quoting:
            end = page.find(">", m.end())
        text(p)
        name, attributes = m[1].lower(), page[m.end() : end]
        begin = at = end + 1
        if follows == "/":
            out.append(("c", name, ""))
        elif name in RAW and not attributes.endswith("/"):
            close = re.compile(f"</{name}(?=[\\s/>])[^>]*+>?", re.I).search(page, at)
            begin = at = close.end() if close else n
            if name not in ("script", "style"):
                out += [("o", name, ""), ("c", name, "")]
        else:
            out.append(("o", name, attributes))


def ends_of(tokens: list[tuple[str, str, str]]) -> dict[int, int]:
    """The token at which the element of a start tag ends. Elements that nothing ends are left out."""
    ends: dict[int, int] = {}
    frames: list[tuple[str, int, list, dict]] = [("", -1, [], {})]  # element, its start, open elements with implied ends, open inline elements
    depth: dict[str, int] = {}

    def cut(loose: list, size: int, k: int) -> None:
        while len(loose) > size:
            ends[loose.pop()[1]] = k

    def lowest(loose: list, names: set[str]) -> int | None:
        """A frame has few of these open, as each ends its like."""
        return next((i for i, x in enumerate(loose) if x[0] in names), None)

    for k, (kind, name, attributes) in enumerate(tokens):
        if kind == "t" or name in ("html", "body"):
            continue
        _, _, loose, inline = frames[-1]
        if kind == "o":
            if name in INLINE:
                if name not in VOID:
                    inline.setdefault(name, []).append(k)
                continue
            if name not in PHRASES and (i := lowest(loose, ENDED.get(name, set()) | {"p"})) is not None:
                cut(loose, i, k)
            if name in VOID or attributes.endswith("/"):
                continue
            if name in ENDED:
                loose.append((name, k))
            else:
                frames.append((name, k, [], {}))
                depth[name] = depth.get(name, 0) + 1
        elif name in INLINE:
            if inline.get(name):
                ends[inline[name].pop()] = k
        elif name in ENDED:
            if (i := lowest(loose, {name})) is not None:
                cut(loose, i, k)
        elif depth.get(name):
            while True:
                other, start, inner, _ = frames.pop()
                cut(inner, 0, k)
                depth[other] -= 1
                ends[start] = k
                if other == name:
                    break
    return ends


def lines_of(page: str) -> list[Line]:
    """Every line of the stripped page; line breaks in a row leave empty lines."""
    tokens = tokens_of(page)
    ends, n = ends_of(tokens), len(tokens)
    opened = {c: [0] for c in CONTAINERS}  # start tags before each token
    for kind, name, _ in tokens:
        for c, counts in opened.items():
            counts.append(counts[-1] + (kind == "o" and name == c))
    held = lambda c, k: opened[c][ends.get(k, n)] - opened[c][k + 1]
    lines: list[Line] = []
    parts: list[str] = []
    owners: list[tuple[int, int, str]] = []  # (end, element, its name): the outermost article, else the outermost main element
    plain, link, block = 0, -1, ""

    def finish(line_break: bool = False) -> None:
        nonlocal plain
        text = SPACES.sub(" ", "".join(parts)).strip()
        if text or line_break and lines:
            lines.append(Line(text, min(plain, len(text)), owners[-1][1] if owners else -1, block))
        parts.clear()
        plain = 0

    k = 0
    while k < n:
        kind, name, attributes = tokens[k]
        while owners and owners[-1][0] < k:
            owners.pop()
        if kind == "t":
            piece = entities.unescape(name)
            parts.append(piece)
            if k > link:
                plain += len(piece.strip())
        elif name not in INLINE:
            if name not in PHRASES:
                finish(name == "br")
            if kind == "c":
                block = block if name in PHRASES else ""
            elif name not in VOID:
                block = block if name in PHRASES else name
                around = name not in CONTAINERS and (name == "form" or name not in DROPPED) and any(0 < opened[c][n] == held(c, k) for c in CONTAINERS)
                if not around and _no_content(name, attributes, bool(owners)):
                    end = ends.get(k, n if name == "footer" else None)
                    if end is not None:
                        # an implied end is the start of what follows
                        k = end + (end < n and tokens[end][0] == "c" and tokens[end][1] == name)
                        continue
                elif name in CONTAINERS and not (name == "main" and held("article", k)):
                    own = owners[-1] if owners else None
                    same = own and (own[2] == "article" or name == "main")
                    owners.append((ends.get(k, n), own[1] if same else k, own[2] if same else name))
        elif kind == "o" and k in ends:
            if attributes and name in ("span", "a", "ins") and _no_content(name, attributes, bool(owners)):
                k = ends[k] + 1
                continue
            if name == "a":
                link = max(link, ends[k])
        k += 1
    finish()
    return lines


def surges(plain: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first line, line after the last) of the text from each surge to its dive."""
    n = len(plain)
    sums = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        sums[i] = sums[i + 1] + plain[i] - (plain[i + window] if i + window < n else 0)
    out, i = [], 0
    while i < n:
        if sums[i] < surge:
            i += 1
            continue
        first = i
        while not plain[first]:
            first += 1
        while i < n and sums[i]:
            i += 1
        out.append((first, i))
    return out


def is_menu(line: Line) -> bool:
    """Most of it is links, or it has a few words that are no heading, paragraph or sentence."""
    if line.kind in HEADINGS:
        return False
    if 2 * line.plain < len(line.text):
        return True
    return line.kind not in PARAGRAPHS and len(line.text.split()) <= MENU_WORDS and not SENTENCE.search(line.text)


def between(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[Line]:
    """The lines between surges and dives, with headings and paragraphs above them and without menu entries at their edges."""
    out: list[Line] = []
    last = 0
    for first, stop in surges([x.plain for x in lines], window, surge):
        while first > last and lines[first - 1].text and lines[first - 1].kind in HEADINGS | PARAGRAPHS and not is_menu(lines[first - 1]):
            first -= 1
        last = stop
        while first < stop and (not lines[first].text or is_menu(lines[first])):
            first += 1
        while stop > first and (not lines[stop - 1].text or is_menu(lines[stop - 1])):
            stop -= 1
        out += lines[first:stop]
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Main text of a page, one line for each block."""
    lines = lines_of(page) if page else []
    inner, outer = [x for x in lines if x.owner >= 0], [x for x in lines if x.owner < 0]
    if surges([x.plain for x in inner], window, surge):
        kept = inner
    else:
        kept = between(outer, window, surge) or [x for x in inner if x.text] or lines
    return "\n".join(x.text for x in kept if x.text)


def extract(pages: DataFrame, html: str = "html", output: str = "text") -> DataFrame:
    """Replace the html column by the main text."""
    kept = [c for c in pages.columns if c not in (html, output)]
    fields = [pages.schema[c] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                texts = [main_text(x) for x in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*kept, output])

    return pages.select(*kept, html).mapInArrow(run, T.StructType([*fields, T.StructField(output, T.StringType())]))


def op10(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
