"""Visible text of HTML pages, laid out.

A tokenizer and a tree builder with implied tags (a new block closes an open paragraph, an item closes an item, a
cell closes a cell) give a tree; visibility rules drop what a browser does not show: hidden elements, display and
inherited visibility in style attributes and in simple rules of style elements, closed details and dialogs.  The
renderer keeps the space between blocks, list markers with indentation and numbers, preformatted text, and table cells
aligned in columns and rows.  Everything is iterative, and open elements are counted by tag, so depth costs nothing.

Defined results: null or empty html gives empty text; a page without visible text gives ''; unclosed, stray and
misnested tags follow the rules above; bytes that are not UTF-8 are read as U+FFFD; a very long page is read whole, by
one task; equal pages give equal text, repeated rows or ids one row each, and a null page_id stays null; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import frugal, strings

_BLANK = r"[ \t\n\f\r]"
#: Name and value of one attribute; a quote opens a string only at the start of a value.
_PAIR = r"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*)(?:B*=B*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*)?)?".replace("B", _BLANK)
_ATTR = re.compile(_PAIR)
_PAIRS = re.sub(r"\((?!\?)", "(?:", _PAIR)
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^ \t\n\f\r/>]*)((?:[ \t\n\f\r/]|{_PAIRS})*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_HIDING_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist audio video canvas".split())
#: Input elements that show their value.
BUTTONS = frozenset("submit button reset".split())
#: Hidden inside svg or math only.
FOREIGN = frozenset("svg math".split())
HIDDEN_FOREIGN = frozenset("defs desc metadata symbol clippath annotation annotation-xml".split())
#: Tags that leave a head open.
METADATA = frozenset("head base basefont bgsound link meta title style script template noscript noframes".split())
PRE = frozenset("pre listing xmp plaintext".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table figure fieldset hr".split()) | PRE
BLOCK = SPACED | frozenset("html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li main menu nav option optgroup search section summary tr caption thead tbody tfoot".split())
CLOSES_P = BLOCK - frozenset("html body tr thead tbody tfoot caption option optgroup legend".split())
#: Opening the key closes an open element of the value, unless one of the third stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
_P_SCOPE = frozenset("button td th caption table".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: bool = False):
        self.tag, self.attrs, self.children, self.foreign = tag, attrs, [], foreign


def parse(source: str) -> Node:
    """The tree; text nodes are strings with entities resolved."""
    root = Node("#root", {})
    stack = [root]
    opened: Counter[str] = Counter()  # how many elements of a tag are open, so that depth costs nothing
    at, n = 0, len(source)

    def cut_to(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    def close(names, barrier) -> None:
        """Pop the outermost open element of ``names`` above the barrier, with all inside it."""
        if not any(opened[x] for x in names):
            return
        cut = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                cut = i
            if stack[i].tag in barrier:
                break
        if cut is not None:
            cut_to(cut)

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip(" \t\n\f\r"):
                cut_to(len(stack) - 1)
            stack[-1].children.append(entities.unescape(s) if "&" in s else s)

    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag not in VOID and opened[tag]:
                barrier = {"td", "th", "table", "caption"} - {tag} if tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html") else {"table"} - {tag}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut_to(i)
                        break
                    if stack[i].tag in barrier:
                        break
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    cut_to(i)
                    break
                if stack[i].tag in _P_SCOPE:
                    break
        if stack[-1].tag == "head" and tag not in METADATA and tag != "html":
            cut_to(len(stack) - 1)
        raw = m[3] or ""
        attrs = {}
        if raw.strip():
            for a in _ATTR.finditer(raw):
                value = a[2] or ""
                if value[:1] in ("'", '"'):
                    value = value[1:].removesuffix(value[0])
                attrs.setdefault(a[1].lower(), entities.unescape(value))
        foreign = tag in FOREIGN or stack[-1].foreign and stack[-1].tag != "foreignobject"
        if foreign and tag in HIDDEN_FOREIGN:
            attrs["hidden"] = ""
        node = Node(tag, attrs, foreign)
        stack[-1].children.append(node)
        if tag in VOID or (foreign and raw.endswith("/")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at) if tag != "plaintext" else None
            stop = end.start() if end else n
            if tag == "textarea":
                node.children.append(entities.unescape(source[at:stop]))
            elif tag in PRE:
                node.children.append(source[at:stop])
            elif tag == "style" and not foreign:
                root.attrs["style"] = root.attrs.get("style", "") + source[at:stop]
            at = (source.find(">", stop) + 1 or n) if end else n
            continue
        stack.append(node)
        opened[tag] += 1
    return root


class Sheet:
    """Rules of the page's style elements that hide: selectors of one tag, classes and an id, no combinators."""

    def __init__(self, css: str):
        self.rules: list[tuple[str, frozenset[str], str, bool]] = []
        css = re.sub(r"/\*.*?(\*/|\Z)", " ", css, flags=re.S)
        # blocks of at-rules may not apply, and text is rather kept
        css = re.sub(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})", " ", css)
        for selectors, body in re.findall(r"([^{}@;]+)\{([^{}]*)\}", css):
            if not _HIDING_STYLE.search(body):
                continue
            gone = bool(_NO_DISPLAY.search(body))
            for x in selectors.split(","):
                m = re.fullmatch(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)", x.strip())
                if m and x.strip():
                    parts = re.findall(r"[.#][\w-]+", m[2])
                    ids = [p[1:] for p in parts if p[0] == "#"]
                    self.rules.append(((m[1] or "").lower(), frozenset(p[1:] for p in parts if p[0] == "."), ids[0] if ids else "", gone))

    def hides(self, node: Node) -> bool | None:
        """True if a rule takes the element away, False if one only makes it invisible, None if none applies."""
        found = None
        if self.rules:
            own = set(node.attrs.get("class", "").split())
            for tag, classes, name, gone in self.rules:
                if tag in ("", node.tag) and classes <= own and name in ("", node.attrs.get("id")):
                    if gone:
                        return True
                    found = False
        return found


def shown(node: Node, sheet: Sheet, inherited: bool) -> bool | None:
    """None if nothing of the element is shown, else whether its own text is: visibility is inherited, and a child may
    be visible inside an invisible parent."""
    attrs = node.attrs
    if node.tag in HIDDEN or "hidden" in attrs or (node.tag == "dialog" and "open" not in attrs):
        return None
    if node.tag == "input" and attrs.get("type", "").lower() not in BUTTONS:
        return None
    ruled = sheet.hides(node)
    style = attrs.get("style", "") if node.tag != "#root" else ""
    own = _DISPLAY.search(style)
    if own and own[1].lower() == "none" or ruled is True and not own:
        return None
    said = _VISIBILITY.findall(style)
    if said:
        return said[-1].lower() == "visible"
    return False if ruled is False else inherited


def width(s: str) -> int:
    """Columns on a terminal: wide characters take two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class _Out:
    """Text being laid out: collapses blanks, and turns requested gaps into line ends only between texts."""

    def __init__(self):
        self.parts: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = ""
        self.marker = ""

    def block(self, gap: int) -> None:
        self.gap = max(self.gap, gap)
        self.space = False

    def line(self) -> None:
        if self.parts:
            self.parts.append("\n" * (self.gap + 1))
        self.gap = 0
        self.space = False

    def _open(self) -> bool:
        """Start a line if one is due; true at the start of a line."""
        fresh = not self.parts
        if self.gap:
            if self.parts:
                last = self.parts[-1]
                self.parts.append("\n" * (self.gap - min(self.gap, len(last) - len(last.rstrip("\n")))))
            fresh, self.gap = True, 0
        elif self.parts and self.parts[-1].endswith("\n"):
            fresh = True
        if fresh:
            self.parts.append(self.indent + self.marker)
            self.marker = ""
        return fresh

    def text(self, s: str) -> None:
        words = re.sub(r"[ \t\n\r\f]+", " ", s)
        if words in ("", " "):
            self.space = self.space or bool(words)
            return
        body = words.strip(" ")
        fresh = self._open()
        if not fresh and (self.space or words[0] == " "):
            self.parts.append(" ")
        self.parts.append(body)
        self.space = words[-1] == " "

    def raw(self, s: str) -> None:
        for k, line in enumerate(s.split("\n")):
            if k:
                self.parts.append("\n")
            if line:
                self._open()
                self.parts.append(line)
        self.space = False

    def done(self) -> str:
        lines = [x.rstrip() for x in "".join(self.parts).split("\n")]
        return "\n".join(lines).strip("\n")


def _placed(rows: list[list[tuple[str, int, int]] | None]) -> list[list[tuple[str, int]]]:
    """Rows of (text, columns spanned) with blanks where a cell from above reaches down; None ends all such cells."""
    out, down = [], {}
    for r in rows:
        if r is None:
            down = {}
            continue
        line, at, new = [], 0, {}
        for body, span, deep in r:
            while at in down:
                line.append(("", 1))
                at += 1
            line.append((body, span))
            if deep > 1:
                new |= dict.fromkeys(range(at, at + span), deep)
            at += span
        if r:
            out.append(line)
        down = {c: k - 1 for c, k in (down | new).items() if k > 1}
    return out


def _grid(rows: list[list[tuple[str, int]]]) -> str:
    """Cells (text, columns spanned) in aligned columns, two blanks apart; a cell may have several lines."""
    columns = max((sum(s for _, s in r) for r in rows), default=0)
    widths = [0] * columns
    for wide in (False, True):
        for r in rows:
            at = 0
            for body, span in r:
                need = max((width(x) for x in body.split("\n")), default=0)
                have = sum(widths[at : at + span]) + 2 * (span - 1)
                if (span > 1) == wide and need > have:
                    widths[at + span - 1] += need - have
                at += span
    out = []
    for r in rows:
        cells = [body.split("\n") for body, _ in r]
        for k in range(max(map(len, cells), default=0)):
            at, line = 0, []
            for lines, (_, span) in zip(cells, r):
                x = lines[k] if k < len(lines) else ""
                have = sum(widths[at : at + span]) + 2 * (span - 1)
                line.append(x + " " * (have - width(x)))
                at += span
            out.append("  ".join(line).rstrip())
    return "\n".join(out)


def _number(value: str | None, default: int, most: int) -> int:
    return max(1, min(most, int(value))) if value and value.isascii() and value.isdigit() and len(value) < 9 else default


def render(root: Node) -> str:
    out = _Out()
    outs: list[_Out] = []  # of tables around the current one
    tables: list[list[list[tuple[str, int, int]] | None]] = []
    lists: list[list] = []  # [ordered, next number, indent before]
    pre = 0
    sheet = Sheet(root.attrs.get("style", ""))
    todo: list = [(root, False, True)]
    while todo:
        node, leaving, seen = todo.pop()
        if isinstance(node, str):
            if seen:
                out.raw(node) if pre else out.text(node)
            continue
        tag = node.tag
        if not leaving:
            seen = shown(node, sheet, seen)
            if seen is None:
                continue
            if tag == "input":
                if seen:
                    out.text(node.attrs.get("value") or {"submit": "Submit", "reset": "Reset"}.get(node.attrs.get("type", "").lower(), ""))
                continue
            if tag == "br":
                out.line()
                continue
            if tag == "wbr":
                continue
            if tag in BLOCK or tag == "text":
                out.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", _number(node.attrs.get("start"), 1, 10**8), out.indent])
                out.indent += "  " if len(lists) > 1 else ""
            elif tag == "li":
                own = lists[-1] if lists else [False, 1, ""]
                value = node.attrs.get("value", "").strip()
                if own[0] and re.fullmatch(r"[+-]?[0-9]{1,8}", value):
                    own[1] = int(value)
                out.marker = f"{own[1]}. " if own[0] else "- "
                own[1] += 1
            elif tag in PRE:
                pre += 1
            elif tag == "table":
                outs.append(out)
                tables.append([])
                out = _Out()
            elif tag in ("thead", "tbody", "tfoot") and tables:
                tables[-1].append(None)
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1] or tables[-1][-1] is None:
                    tables[-1].append([])
                outs.append(out)
                out = _Out()
            todo.append((node, True, seen))
            inside = node.children
            if tag == "details" and "open" not in node.attrs:
                inside = [c for c in inside if isinstance(c, Node) and c.tag == "summary"][:1]
            todo += [(c, False, seen) for c in reversed(inside)]
            continue
        if tag in ("td", "th") and tables:
            deep = node.attrs.get("rowspan")
            tables[-1][-1].append((out.done(), _number(node.attrs.get("colspan"), 1, 1000), 65534 if deep == "0" else _number(deep, 1, 65534)))
            out = outs.pop()
        elif tag == "table":
            caption = out.done()
            out = outs.pop()
            grid = _grid(_placed(tables.pop()))
            for body in (caption, grid):
                if body.strip():
                    out.block(1)
                    out.raw(body)
        elif tag in PRE:
            pre -= 1
        elif tag in ("ul", "ol", "menu", "dir"):
            out.indent = lists.pop()[2]
        elif tag == "li":
            out.marker = ""
        if tag in BLOCK or tag == "text":
            out.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
    return out.done()


def page_text(source: str | None) -> str:
    return render(parse(source)) if source else ""


@frugal
def _run(batches):
    for batch in batches:
        texts = [page_text(x) for x in strings(batch.column("html"))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text of every row; rows are independent, nothing is shuffled."""
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_run, "page_id long, text string")
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
