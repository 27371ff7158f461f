"""HTML extraction by layout-aware rendering.

A page is cut into tags and text by one pattern, built into a tree with HTML's implied tags (an
open paragraph ends before a block, a list item before the next, table parts nest as they must),
and rendered: text that is visible, blocks on lines of their own, paragraphs and headings with a
blank line around them, list items with bullet or number and indent, table cells aligned to the
widest of their column, over as many columns and rows as they span, preformatted text as it is. A cell of more than WIDE
characters widens its column to that only, and what follows it in its row comes two spaces later; a table whose alignment would
take PADDED times its text and tags has its cells two spaces apart; indents end at INDENT. Each step goes forward once, so that the time, and
the text that comes out, grow with the page's length, whatever is in it: at most 50 times as much comes out.

Hidden are: head matter, scripts, styles, templates and comments; lists to choose from and text areas;
what stands in for objects, frames, canvas, audio and video; what svg and math don't draw themselves
(titles, descriptions, definitions, annotations); inputs of type="hidden"; and elements with the
hidden attribute, an inline style of display:none or visibility:hidden, or a rule with one of these in a style
sheet of the page whose selector is a name, a class, an id, or a name with one of these. All other text comes out: what stands in a
table but in no cell follows the table.

Defined results: a null page gives null; an empty page, or one without visible text, gives an empty
text; broken mark-up never fails: unknown end tags are ignored, what is open at the end is closed, and a tag
that the page ends within shows nothing, as in browsers; pages of any length are taken whole; an empty table gives no
rows; repeated rows and ids give repeated results; extra columns of any name are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadproof.llm.common import small_batches, table

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object canvas audio video select datalist textarea title".split())
#: Drawn by reference or not at all, by the kind of drawing around them; and what in a drawing holds HTML again.
UNDRAWN = {"svg": frozenset("title desc defs metadata symbol clippath mask pattern marker".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
#: A start tag ends these open elements, looked for up to the nearest of the barriers.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
IMPLIED = {name: (ends, barriers | {"template"}) for name, (ends, barriers) in IMPLIED.items()}
#: A start tag in a table ends all that is open within these, as browsers do.
CONTEXT = dict.fromkeys(("td", "th"), {"tr", "tbody", "thead", "tfoot", "table"}) | {"tr": {"tbody", "thead", "tfoot", "table"}} | dict.fromkeys(("tbody", "thead", "tfoot", "caption", "colgroup", "col"), {"table"})
#: An end tag doesn't reach beyond these, unless it is for one of them.
BARRIER = frozenset({"table", "td", "th", "html"})

#: Nested tables that are laid out as such, each by a call of its own.
DEEP = 20
#: The widest that cells make a column, the deepest indent, and how often a table's cells and mark-up its padding may come to.
WIDE, INDENT, PADDED = 100, 40, 16

#: A tag's last group is empty if the page ends within it.
_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_STYLE, _STYLE_END = re.compile(r"<style\b", re.I), re.compile(r"</style\b", re.I)
_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|[{};]|[^{};/]++|/", re.S)
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?([.#][\w-]+)?", re.I)


def _sheets(page: str) -> Iterator[str]:
    """The texts of style elements; one that isn't closed goes to the page's end, and after a tag that isn't there are none."""
    at = 0
    while (tag := _STYLE.search(page, at)) and (start := page.find(">", tag.end()) + 1):
        end = _STYLE_END.search(page, start)
        yield page[start : end.start() if end else len(page)]
        if not end:
            return
        at = end.end()


def hiding_rules(page: str) -> set[str]:
    """Selectors `name`, `.class`, `#id`, `name.class`, `name#id` that style sheets hide whatever the medium; names in lower case."""
    out: set[str] = set()
    for sheet in _sheets(page):
        held, depth, selector, at_rule = [], 0, "", 0
        for m in _CSS.finditer(sheet):
            token = m[0]
            if token.startswith("/*"):
                continue
            if token == "{":
                depth += 1
                if depth == 1:
                    selector, at_rule = "".join(held), "".join(held).lstrip().startswith("@")
                held = []
            elif token == "}":
                if depth == 1 and not at_rule and _NONE.search("".join(held)):
                    out |= {(s[1] or "").lower() + (s[2] or "") for x in selector.split(",") if (s := _SELECTOR.fullmatch(x.strip())) and s[0]}
                depth, held = max(depth - 1, 0), []
            elif token == ";" and depth == 0:
                held = []
            else:
                held.append(token)
    return out


class Element:
    __slots__ = ("attrs", "children", "drawing", "has_table", "hidden", "in_p", "in_table", "name")

    def __init__(self, name: str, attrs: dict[str, str], hidden: bool, parent: Element | None = None):
        self.name, self.attrs, self.hidden, self.children, self.has_table = name, attrs, hidden, [], False
        self.in_table = name == "table" or parent is not None and parent.in_table
        self.in_p = name == "p" or parent is not None and parent.in_p
        self.drawing = name if name in UNDRAWN else parent.drawing if parent and name not in HTML_AGAIN else ""


class Open:
    """The elements that are open, with the places of each name, so that the nearest of a name is found at once."""

    def __init__(self, root: Element):
        self.stack, self.places = [root], {root.name: [0]}

    def push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.stack))
        self.stack.append(element)

    def cut(self, at: int) -> None:
        """Closes all from a place on."""
        for element in self.stack[at:]:
            self.places[element.name].pop()
        del self.stack[at:]

    def last(self, names) -> int:
        """The place of the innermost element with one of the names; 0, the root's, if there is none."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)


def build(page: str) -> Element:
    """The tree of a page: elements and strings."""
    root = Element("html", {}, False)
    open_, at, end = Open(root), 0, len(page)
    stack, rules = open_.stack, hiding_rules(page)

    def add(text: str) -> None:
        if text and not stack[-1].hidden:
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)

    def close(names, barriers) -> None:
        i = open_.last(names)
        if i and i > open_.last(barriers):
            # an element of the kind further out ends too, as a cell does with its row
            while i > 1 and stack[i - 1].name in names:
                i -= 1
            open_.cut(i)

    def hides(name: str, attrs: dict[str, str]) -> bool:
        if "hidden" in attrs or name == "input" and attrs.get("type") == "hidden" or _NONE.search(attrs.get("style", "")):
            return True
        if not rules:
            return False
        marks = [f".{c}" for c in attrs.get("class", "").split()] + ([f"#{attrs['id']}"] if attrs.get("id") else [])
        return name in rules or any(m in rules or name + m in rules for m in marks)

    while at < end:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not (name := m[3]) or not m[5]:
            continue
        name = name.lower()
        if m[2]:
            if name == "p" and not stack[-1].in_p:
                continue
            i = open_.last((name,))
            inner = ("template",) if name in BARRIER or name in ("tr", "tbody", "thead", "tfoot", "template") else ("template", *BARRIER - {"html"})
            if i and i >= open_.last(inner):
                open_.cut(i)
            continue
        if name == "html":
            continue
        if name in ENDS_P and stack[-1].in_p:
            close({"p"}, {"template", "td", "th", "table", "caption", "button"})
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in CONTEXT and stack[-1].in_table and (i := open_.last(CONTEXT[name])) > open_.last(("template",)):
            open_.cut(i + 1)
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            stack[-1].children.append(row := Element("tr", {}, stack[-1].hidden, stack[-1]))
            open_.push(row)
        attrs = {a[0].lower(): a[1] or a[2] or a[3] or "" for a in _ATTR.findall(m[4])} if m[4] and not m[4].isspace() else {}
        drawing = stack[-1].drawing
        hidden = stack[-1].hidden or name in HIDDEN or name in UNDRAWN.get(drawing, ()) or bool(attrs or rules) and hides(name, attrs)
        if drawing == "svg" and name == "text":
            stack[-1].children.append(" ")  # texts of a drawing stand apart
        stack[-1].children.append(element := Element(name, attrs, hidden, stack[-1]))
        if name == "table":
            for holder in reversed(stack):  # those further out know already
                if holder.has_table:
                    break
                holder.has_table = True
        if name in VOID or (drawing or name in UNDRAWN) and m[4].endswith("/"):
            continue
        if name == "form" and stack[-1].name in ("table", "tbody", "thead", "tfoot", "tr"):  # holds nothing there
            continue
        open_.push(element)
        if name in RAW:
            closing = _CLOSING[name].search(page, at)
            add(page[at : closing.start() if closing else end])
            at = closing.end() if closing else end
            open_.cut(len(stack) - 1)
    return root


_CLOSING = {name: re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I) for name in RAW}


class Lines:
    """Lines under way: text joins the open line; breaks and blank lines are asked for and made once."""

    def __init__(self):
        self.out: list[str] = []
        self.line: list[str] = []
        self.gap, self.blank, self.mark, self.indent, self.depth = False, False, "", 0, 0

    def text(self, text: str) -> None:
        flat = _SPACES.sub(" ", text)
        if flat == " " or not flat:
            self.gap = self.gap or bool(flat and self.line)
            return
        if self.line and (self.gap or flat[0] == " "):
            self.line.append(" ")
        self.line.append(flat.strip(" "))
        self.gap = flat[-1] == " "

    def end(self) -> None:
        if self.line:
            self.put("".join(self.line))
        self.line, self.gap = [], False

    def put(self, line: str) -> None:
        if self.blank and self.out:
            self.out.append("")
        self.blank = False
        indent = min(self.indent, INDENT)
        lead = " " * (indent - len(self.mark)) + self.mark if self.mark else " " * indent
        self.mark = ""
        self.out.append((lead + line).rstrip())

    def space(self) -> None:
        self.end()
        self.blank = True


def _rows(table_: Element, beside: list) -> Iterator[list[Element]]:
    """The cells of each row; all else that is in the table goes to beside, None between two places."""
    for child in table_.children:
        if isinstance(child, str):
            beside.append(child)
        elif child.hidden or child.name == "caption" and table_.name == "table":
            continue
        elif child.name == "tr":
            cells = []
            beside.append(None)
            for c in child.children:
                cell = not isinstance(c, str) and c.name in ("td", "th")
                (cells if cell else beside).append(c)
            yield [c for c in cells if not c.hidden]
        elif child.name in ("tbody", "thead", "tfoot"):
            beside.append(None)
            yield from _rows(child, beside)
        else:
            beside.append(child)


def _span(cell: Element, name: str, most: int) -> int:
    value = cell.attrs.get(name, "").strip()
    return min(max(int(value), 1), most) if value.isascii() and value.isdecimal() and len(value) < 9 else 1


def _placed(rows: list[list[tuple[Element, str]]]) -> list[list[tuple[int, int, str]]]:
    """The cells of each row as (first column, columns, text): each goes to the first columns that no cell from above fills."""
    out, above = [], []  # above: (first, end, rows to come), by first; neighbours that end together are one
    for row in rows:
        line, filled, col, k = [], [], 0, 0
        for cell, text in row:
            while k < len(above) and above[k][0] <= col:
                col = max(col, above[k][1])
                k += 1
            wide, high = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
            line.append((col, wide, text))
            if high > 1:
                filled.append((col, col + wide, high))
            col += wide
        out.append(line)
        left = []
        for first, end, n in sorted(filled + above):
            if n > 1:
                if left and left[-1][1] == first and left[-1][2] == n - 1:
                    left[-1] = (left[-1][0], end, n - 1)
                else:
                    left.append((first, end, n - 1))
        above = left
    # columns in which no cell begins are none
    starts = sorted({col for line in out for col, _, _ in line})
    return [[(a := bisect.bisect_left(starts, col), max(bisect.bisect_left(starts, col + wide) - a, 1), text) for col, wide, text in line] for line in out]


def _table(element: Element, lines: Lines) -> None:
    lines.depth += 1
    for child in element.children:
        if not isinstance(child, str) and child.name == "caption":
            _render(child, lines)
            lines.end()
    rows, beside = [], []
    for row in _rows(element, beside):
        if any(cell.has_table for cell in row):
            rows.append(row)
            continue
        cells = []
        for cell in row:
            part = Lines()
            part.depth = lines.depth
            _render(cell, part)
            part.end()
            cells.append((cell, " ".join(x.strip() for x in part.out if x)))
        rows.append(cells)
    flat = [row if row and isinstance(row[0], tuple) else [] for row in rows]
    placed = _placed(flat)
    widths = [0] * (1 + max((col for line in placed for col, _, _ in line), default=0))
    for line in placed:
        for col, wide, text in line:
            if wide == 1:
                widths[col] = max(widths[col], min(len(text), WIDE))
    for line in placed:  # a cell over several columns that is longer than they are widens the last of them
        for col, wide, text in line:
            room, most = -2, min(len(text), WIDE)
            for k in range(col, col + wide):
                room += widths[k] + 2
                if room >= most:
                    break
            else:
                widths[col + wide - 1] += most - room
    at = [0, *itertools.accumulate(w + 2 for w in widths)]
    # columns that few rows reach would pad the others without end: such a table's cells stand two spaces apart
    if sum(at[line[-1][0]] for line in placed if line) > PADDED * sum(len(text) + 4 for line in placed for _, _, text in line):
        at = [0] * len(at)
    for row, line in zip(rows, placed, strict=True):
        if row and not isinstance(row[0], tuple):  # a layout table: cells stand below each other
            for cell in row:
                _render(cell, lines)
                lines.end()
        elif any(text for _, _, text in line):
            shown = ""
            for col, _, text in line:
                shown += " " * max(at[col] - len(shown), 2 if shown else 0) + text
            lines.put(shown)
    for child in beside:  # text that stands in a table but in no cell
        if child is None:
            lines.end()
        elif isinstance(child, str):
            lines.text(child)
        else:
            _render(child, lines)
    lines.end()
    lines.depth -= 1


def _render(root: Element, lines: Lines) -> None:
    """Depth first, without recursion but for tables, whose cells are rendered apart."""
    stack: list = [(root, "in", 0)]
    while stack:
        node, what, number = stack.pop()
        if isinstance(node, str):
            if what == "pre":
                lines.end()
                for line in node.strip("\n").split("\n"):
                    lines.put(line)
            else:
                lines.text(node)
            continue
        name = node.name
        if what == "out":
            lines.space() if name in SPACED else lines.end()
            if name == "li":
                lines.mark = ""  # of an item that shows nothing
            if name in ("ul", "ol", "menu", "dir", "dd", "blockquote"):
                lines.indent = number
            continue
        if node.hidden:
            continue
        if name == "br":
            lines.end() if lines.line else lines.put("") if lines.out and lines.out[-1] else None
            continue
        if name == "img":
            lines.text(node.attrs.get("alt", ""))
            continue
        if name in BLOCK and node is not root:
            lines.space() if name in SPACED and not (name in ("ul", "ol") and lines.indent) else lines.end()
            stack.append((node, "out", lines.indent))
        if name == "table" and node is not root and lines.depth < DEEP:  # tables nested deeper are plain blocks
            _table(node, lines)
            continue
        if name in ("ul", "ol", "menu", "dir"):
            lines.indent += 4 if name == "ol" else 2
            count = int(node.attrs["start"]) if node.attrs.get("start", "").isdecimal() else 1
            kids = []
            for child in node.children:
                item = not isinstance(child, str) and child.name == "li" and not child.hidden
                kids.append((child, f"{count}. " if name == "ol" and item else "- " if item else "in", 0))
                count += item
            stack += reversed(kids)
            continue
        if name in ("dd", "blockquote"):
            lines.indent += 2
        if name == "li" and what not in ("in", "out"):
            lines.mark = what
        stack += [(child, "pre" if name == "pre" and isinstance(child, str) else "in", 0) for child in reversed(node.children)]


def render(page: str | None) -> str | None:
    """The page's visible text as laid out."""
    if page is None:
        return None
    lines = Lines()
    _render(build(page), lines)
    lines.end()
    return "\n".join(lines.out).strip("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: id and its rendered text."""
    small_batches(pages.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(p) for p in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    picked = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return picked.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
