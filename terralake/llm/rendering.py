"""Visible text of web pages, laid out: blocks on lines of their own, list markers, aligned table cells."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MARKUP = re.compile(
    r"<!--(?:.*?(?:-->|\Z))|<[!?][^>]*+>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)[\"']?>?", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
SPACE = re.compile("[ \t\n\r\f]+")
INVISIBLE_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)

# Fixed values of HTML: what has no content, whose content is no markup, and what is never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist audio video canvas object rp progress meter".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())  # what leaves an open head open
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul xmp".split()
)
SPACED = frozenset("blockquote dl figure fieldset h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul listing xmp".split())
# SVG and MathML: what is never shown, where HTML begins again, and the tags that end them.
NEVER = {
    "svg": frozenset("title desc metadata defs style script symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
HTML_IN = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext".split())}
HTML_TAGS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
SVG_BLOCKS = frozenset("text foreignobject".split())
LISTS = frozenset("ul ol menu dir".split())
SECTIONS = frozenset("tbody thead tfoot".split())
CELLS = frozenset("td th caption".split())
#: Opening one of these ends an open one of those, looked for up to (not beyond) the limits.
ENDS = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), **{s: (SECTIONS | {"caption"}, {"table"}) for s in SECTIONS},
}
SPANS = {"colspan": 1000, "rowspan": 65534}  # the most columns and rows HTML lets a cell cover


class Flow:
    """Lines of one block context."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.blank, self.indent, self.marker = 0, True, "", None

    def write(self, text: str, keep: bool = False) -> None:
        if keep:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.end_line(True)
                self._put(line)
            return
        text = SPACE.sub(" ", text)
        if self.blank and text.startswith(" "):
            text = text[1:]
        self._put(text)

    def _put(self, text: str) -> None:
        if text:
            self.now.append(text)
            self.blank = text.endswith(" ")

    def end_line(self, even_empty: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        if line or even_empty or self.marker:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            mark, self.marker = self.marker, None
            self.lines.append((self.indent[:max(0, len(self.indent) - len(mark))] + mark + line if mark else self.indent + line).rstrip(" "))
            self.gap = 0
        self.now, self.blank = [], True

    def block(self, margin: int = 1) -> None:
        if self.now:
            self.end_line()
        self.gap = max(self.gap, margin)

    def add(self, lines: list[str]) -> None:
        self.block(2)
        for line in lines:
            self.now = [line]
            self.end_line(True)
        self.gap = 2

    def text(self) -> list[str]:
        if self.now or self.marker:
            self.end_line()
        return self.lines


class Table:
    """Cells by row and column. Columns that cells from above still cover are kept with the row they end before."""

    def __init__(self, wide: int) -> None:
        self.rows: list[dict[int, tuple[list[str], int]]] = []
        self.caption: list[str] = []
        self.until = np.zeros(0, np.int64)
        self.wide = wide

    def new_row(self) -> None:
        self.rows.append({})
        self.at = 0

    def put(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.new_row()
        row = len(self.rows) - 1
        if self.at < len(self.until) and self.until[self.at] > row:
            ended = self.until[self.at:] <= row
            free = int(ended.argmax())
            self.at = self.at + free if ended[free] else len(self.until)
        self.rows[-1][self.at] = (lines, across)
        if down > 1:
            end = self.at + across
            if end > len(self.until):
                self.until = np.concatenate([self.until, np.zeros(max(end, 2 * len(self.until)) - len(self.until), np.int64)])
            self.until[self.at:end] = row + down
        self.at += across

    def text(self) -> list[str]:
        """Lines of all rows, cells padded to their columns; widths of column ranges are differences of running sums."""
        width: dict[int, int] = {}
        for row in self.rows:
            for c, (lines, across) in row.items():
                if across == 1:
                    width[c] = max(width.get(c, 0), *map(len, lines), 0) if lines else width.get(c, 0)
        columns = sorted({c for row in self.rows for c in row})
        place = {c: i for i, c in enumerate(columns)}
        sums = [0, *accumulate(width.get(c, 0) for c in columns)]
        # what empty columns take up, their gaps included
        empty = [0, *accumulate((w if w <= self.wide else 0) + 2 for w in (width.get(c, 0) for c in columns))]
        out = list(self.caption)
        for row in self.rows:
            cells, upto = [], 0  # (blanks in front, lines, room)
            for c in sorted(row):
                lines, across = row[c]
                i, j = place[c], bisect_left(columns, c + across)
                if i < upto:  # overlapped by a wider cell
                    continue
                room = sums[j] - sums[i] + 2 * (j - i - 1)
                cells.append((empty[i] - empty[upto], lines, room if room <= self.wide else 0))
                upto = j
            for i in range(max((len(lines) for lines, _ in row.values()), default=0)):
                line = []
                for blanks, lines, room in cells:
                    cell = lines[i] if i < len(lines) else ""
                    line.append(" " * blanks + cell.ljust(room) + "  ")
                out.append("".join(line).rstrip(" "))
        return out


class Page:
    """Tree builder and renderer in one pass: an explicit stack of open elements, so depth is bounded by memory alone."""

    def __init__(self, wide: int = 80) -> None:
        self.wide = wide
        self.lists: list[tuple[str, dict]] = []  # open lists, the innermost last
        self.open: list[tuple[str, dict]] = []
        self.kinds: list[tuple[str, str]] = []  # per open element what it belongs to and what stands in it: "svg", "math" or "" (HTML)
        self.count: dict[str, int] = {}
        self.flows: list[Flow] = [Flow()]
        self.tables: list[Table] = []
        self.hidden = 0  # number of open elements up to and with the outermost invisible one

    # -- tree ---------------------------------------------------------------------------------

    def kind(self) -> str:
        return self.kinds[-1][1] if self.kinds else ""

    def start(self, name: str, attrs: str) -> None:
        while name in HTML_TAGS and self.kind():
            self.pop()
        if self.hidden and name not in HEAD:
            self.end_head(name == "body")
        if name in BLOCKS and self.count.get("p") and name not in CELLS and name not in SECTIONS and name != "tr":
            self.close({"p"}, {"table", "td", "th", "caption", "button"})
        if name in ENDS:
            self.close(*ENDS[name])
        if name in CELLS and name != "caption" and self.count.get("table") and not self.within("tr", "table"):
            self.start("tr", "")
        found, empty = {}, attrs.endswith("/")
        if attrs.strip(" \t\n\r\f/"):
            for m in ATTRIBUTE.finditer(attrs):
                if m[1][0] != "_":  # such names are the renderer's own
                    found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
                empty = empty and not (m[4] and m.end() == len(attrs))  # a slash in a value without quotes
        kind = name if name in NEVER else self.kind()
        unseen = (
            name in UNSEEN or name == "dialog" and "open" not in found or "hidden" in found and found["hidden"].lower() != "until-found" or bool(INVISIBLE_STYLE.search(found.get("style", "")))
            or kind and name in NEVER[kind] or kind == "svg" and (found.get("display") == "none" or found.get("visibility") in ("hidden", "collapse"))
        )
        if name in VOID and not kind:
            if not self.hidden and not unseen:
                self.leaf(name)
            return
        self.open.append((name, found))
        self.kinds.append((kind, "" if kind and name in HTML_IN[kind] else kind))
        self.count[name] = self.count.get(name, 0) + 1
        if name in LISTS:
            self.lists.append((name, found))
        if name == "summary" and len(self.open) > 1 and self.open[-2][1].get("_shut") == "all" and self.hidden == len(self.open) - 1:
            self.open[-2][1]["_shut"] = "rest"
            self.hidden = 0
        if not self.hidden:
            if unseen:
                self.hidden = len(self.open)
            else:
                self.opened(name, found)
                if name == "details" and "open" not in found and not kind:  # of closed details only the summary is seen
                    found["_shut"] = "all"
                    self.hidden = len(self.open)
        if kind and empty:
            self.pop()

    def kinds_of(self, name: str) -> str:
        """What the tag just read belongs to; one that is empty and closed again can only be foreign to HTML."""
        return self.kinds[-1][0] if self.open and self.open[-1][0] == name else "empty"

    def end_head(self, outright: bool = False) -> None:
        """End an open head at what can't stand directly inside it; outright also with what it holds, templates aside."""
        if self.open and self.open[-1][0] == "head" or outright and self.count.get("head") and not self.count.get("template"):
            self.close({"head"}, frozenset())

    def within(self, name: str, limit: str) -> bool:
        for own, _ in reversed(self.open):
            if own in (name, limit):
                return own == name
        return False

    def close(self, names: set[str] | frozenset[str], limits: set[str] | frozenset[str]) -> None:
        """End the innermost open element among ``names``, with all inside it, unless a limit comes first."""
        if not any(self.count.get(n) for n in names):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i][0] in limits:
                return

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif name in ("html", "body"):
            self.end_head()
        elif self.count.get(name):
            self.close({name}, frozenset() if name == "table" else {"table"} if name in CELLS | SECTIONS | {"tr"} else {"table", "td", "th", "caption"})

    def pop(self) -> None:
        name, attrs = self.open.pop()
        self.kinds.pop()
        self.count[name] -= 1
        if name in LISTS:
            self.lists.pop()
        if "_shut" in attrs and self.hidden == len(self.open) + 1:
            self.hidden = 0
        if not self.hidden:
            self.closed(name, attrs)
        elif self.hidden > len(self.open):
            self.hidden = 0
        if name == "summary" and self.open and self.open[-1][1].get("_shut") == "rest" and not self.hidden:
            self.hidden = len(self.open)

    # -- layout -------------------------------------------------------------------------------

    def leaf(self, name: str) -> None:
        if name == "br":
            self.flows[-1].end_line(True)
        elif name == "hr":
            self.flows[-1].block(2)

    def opened(self, name: str, attrs: dict) -> None:
        flow = self.flows[-1]
        if name == "table":
            self.tables.append(Table(self.wide))
        elif self.tables and name == "tr":
            self.tables[-1].new_row()
        elif self.tables and name in CELLS:
            self.flows.append(Flow())
        elif self.kinds[-1][0]:
            attrs["_block"] = self.kinds[-1][0] == "svg" and name in SVG_BLOCKS or name == "math" and attrs.get("display") == "block"
            if attrs["_block"]:
                flow.block()
        elif name in BLOCKS and name not in SECTIONS:
            flow.block(2 if name in SPACED and not (name in LISTS and self.count.get("li")) else 1)
            if name in LISTS:
                attrs["_next"] = int(attrs["start"]) if re.fullmatch(r"-?[0-9]{1,9}", attrs.get("start", "")) else 1
            elif name == "li":
                kind, owner = self.lists[-1] if self.lists else ("", {})
                flow.marker = f"{owner.get('_next', 1)}. " if kind == "ol" else "- "
                owner["_next"] = owner.get("_next", 1) + 1
                attrs["_indent"] = len(flow.marker)
                flow.indent += " " * len(flow.marker)
            elif name in ("dd", "blockquote"):
                attrs["_indent"] = 2
                flow.indent += "  "

    def closed(self, name: str, attrs: dict) -> None:
        flow = self.flows[-1]
        if "_block" in attrs:
            if attrs["_block"]:
                flow.block()
            elif name == "mtd":
                flow.write(" ")
        elif name == "table" and self.tables:
            flow.add(self.tables.pop().text())
        elif self.tables and name in CELLS:
            lines = self.flows.pop().text()
            if name == "caption":
                self.tables[-1].caption += lines
            else:
                across, down = (min(most, int(v)) if re.fullmatch("[1-9][0-9]{0,8}", v := attrs.get(a, "")) else 1 for a, most in SPANS.items())
                self.tables[-1].put(lines, across, down)
        elif name in BLOCKS and name not in SECTIONS and name != "tr":
            flow.block(2 if name in SPACED and not (name in LISTS and self.count.get("li")) else 1)
            if "_indent" in attrs:
                if name == "li" and flow.marker:
                    flow.end_line()
                flow.indent = flow.indent[:len(flow.indent) - attrs["_indent"]]

    def text(self, raw: str) -> None:
        if self.hidden and SPACE.sub("", raw):
            self.end_head()
        kind = self.kind()
        if kind and not SPACE.sub("", raw) and not self.count.get("text") or kind == "svg" and not self.count.get("text"):
            return  # blanks between elements, and what stands in a drawing outside its texts
        if self.hidden or not raw:
            return
        kept = bool(self.count.get("pre") or self.count.get("textarea") or self.count.get("listing") or self.count.get("xmp"))
        if kept or SPACE.sub("", raw) or not self.flows[-1].blank:
            self.flows[-1].write(html.unescape(raw) if "&" in raw and not self.count.get("xmp") else raw, kept)

    def finish(self) -> str:
        while self.open:
            self.pop()
        return "\n".join(self.flows[0].text()).replace("\xa0", " ").strip("\n")


def visible_text(source: str, wide: int = 80) -> str:
    """All visible text of a page.

    Unclosed heads, paragraphs, items, rows and cells end where HTML says; rows are implied around stray cells. Not visible: comments, scripts,
    styles, the head, templates, in SVG what isn't in a ``text`` or ``foreignObject`` or only serves as a definition or description, annotations of MathML, what stands in for missing features (``noscript``, ``rp``, the content of ``progress`` and ``meter``), a ``dialog`` without ``open``, all but the summary of ``details`` without ``open``, and elements with ``hidden``, ``display: none`` or
    ``visibility: hidden``. Pictures and form values have no text. Paragraphs, headings, lists and tables are set off by an empty
    line, other blocks by a line break; items carry ``- `` or their number and are indented by depth; cells are padded to the width of
    their column (cells over columns of more than ``wide`` characters aren't); preformatted text keeps its blanks.
    """
    page, at = Page(wide), 0
    for m in iter(lambda: MARKUP.search(source, at), None):
        page.text(source[at:m.start()])
        at = m.end()
        if not m["name"]:
            if page.kind() and m[0].startswith("<![CDATA["):
                close = source.find("]]>", m.start())
                at = close + 3 if close >= 0 else len(source)
                page.text(html.escape(source[m.start() + 9:close if close >= 0 else len(source)]))
            continue
        name = m["name"].lower()
        if m["end"]:
            page.end(name)
            continue
        page.start(name, m["attrs"])
        if name in RAW and not page.kinds_of(name):
            close = re.compile(f"</{name}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(source, at)
            page.text(source[at:close.start() if close else len(source)])
            page.end(name)
            at = close.end() if close else len(source)
    page.text(source[at:])
    return page.finish()


def render_pages(pages: DataFrame, key: str = "page_id", html: str = "html", wide: int = 80) -> DataFrame:
    """Visible text of every page: ``<key>, text, n_chars, n_lines``; see ``visible_text``.

    The studied project keeps no pages among its records; this operator is general. Null and empty pages have empty text; repeated
    rows and null keys get a row each, an empty table gives none; other columns don't matter. Rows are rendered on their own.
    """
    kind = dict(pages.dtypes)[key]

    def rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [visible_text(h, wide) if isinstance(h, str) else "" for h in batch["html"]]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pd.DataFrame({"key": batch["key"], "text": texts, "n_chars": [len(t) for t in texts], "n_lines": lines})

    named = pages.select(pages[key].alias("key"), pages[html].alias("html"))
    return named.mapInPandas(rendered, f"key {kind}, text string, n_chars long, n_lines long").withColumnRenamed("key", key)
