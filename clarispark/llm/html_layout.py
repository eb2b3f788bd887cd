"""HTML to text by layout: a tree builder, visibility rules, and a renderer of blocks, lists and tables.

The builder implies the tags that authors may leave out (html, head and body; the ends of p, li,
dt, dd, option, row, cell and section of a table; tbody and tr).  Hidden are elements that a
browser doesn't render (head, script, style, template, noscript and the like), ``hidden``,
``display: none``, ``visibility: hidden`` (children may turn visible again), closed ``details``
but for their summary, ``dialog`` that isn't open, and what simple rules of the page's style sheets
(tag, .class, #id) hide.  Rules and ``style`` apply in cascade order (!important, specificity, place), and
rules inside @media only where it holds on a screen of 1280 x 800 pixels; an unknown query doesn't.
The renderer collapses white space, puts block elements on lines of their own with a blank line
where they have margins, keeps ``pre`` as it is, marks list items with bullets or numbers by
depth, and pads table cells so that columns align; nested tables are laid out inside their cell.

Edge cases: null and empty html give an empty text; broken markup is read as a browser would,
without errors: a tag that the page's end cuts off is dropped, elements nested deeper than MOST_DEPTH
become siblings, numbers that are none count as left out.  The whole page is read, in time that
grows with its length.  A column of a table aligns cells up to MOST_WIDTH columns of text; longer
cells are kept whole and push what follows; a table wider than MOST_LINE has two spaces between cells.  Rows are independent: repeated rows give repeated
results, null ids are kept, an empty table gives an empty result, and other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.llm.common import arrow_map, batch_of, slices

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
UNRENDERED = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes object audio video canvas map area param source track rp".split())
#: Parts of svg and math that are not drawn where they stand.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient annotation annotation-xml mphantom".split())
#: The screen that media queries are held against: pixels, and what else it is.
SCREEN, LOOKS = {"width": 1280, "height": 800}, {"orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "hover", "pointer": "fine"}
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul option optgroup caption dialog svg:text".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl pre blockquote table figure fieldset hr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
LISTS = frozenset("ul ol menu dir".split())
# What a start tag ends, and the elements beyond which it ends nothing.
ENDS = {
    "li": ({"li"}, LISTS | {"table", "td", "th", "body"}), "dt": ({"dt", "dd"}, {"dl", "table", "td", "th", "body"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th", "body"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "caption": ({"caption"}, {"table"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())

#: Browsers' bound on nesting, and on columns that a cell spans; the widest column of text, and line of a table, that is padded.
MOST_DEPTH, MOST_SPAN, MOST_WIDTH, MOST_LINE = 512, 1000, 160, 1000

# Quoted values may hold ">" and run to the page's end if they aren't closed.  All repeats are possessive, so reading is linear.
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+)|)"
_BARE = _VALUE.replace("([", "(?:[")
_TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|=?[^\s/>=]++(?:{_BARE})?+|=)*+)(?P<end>>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(rf"(=?[^\s/>=]++)(?:{_VALUE})?+|=", re.S)
_INTEGER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})(?![0-9])")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_PART = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[{};]", re.S)
_LENGTH = re.compile(r"\(\s*(min|max)-(width|height)\s*:\s*([\d.]+)(px|em|rem)\s*\)")
_LOOK = re.compile(r"\(\s*([\w-]+)\s*:\s*([\w-]+)\s*\)")
_SIMPLE = re.compile(r"[\w-]+|[.#][\w-]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []


def unescaped(raw: str) -> str:
    """Character references resolved; a number beyond all characters is the replacement character."""
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = _HUGE.sub(lambda m: f"&#{x};" if len(x := m[0].strip("&#;").lower().lstrip("x").lstrip("0") or "0") < 8 and m[0][2] not in "xX" else f"&#x{x};" if len(x) < 8 else "\ufffd", raw)
    return html.unescape(raw)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), unescaped(a or b or c))
    return out


def integer(raw: str, default: int) -> int:
    """As browsers read a number: white space, a sign and ASCII digits, whatever follows."""
    m = _INTEGER.match(raw)
    return int(m[1]) if m else default


def build(page: str) -> Node:
    """The tree of a page: nodes hold nodes and texts."""
    root = Node("html")
    body = Node("body")
    head = Node("head")
    root.kids = [head, body]
    stack = [root, head]
    seen: set[str] = set()  # tags opened so far
    at, n = 0, len(page)

    def text(raw: str) -> None:
        if not raw:
            return
        if stack[-1] is head or len(stack) == 1:
            if not raw.strip():
                return
            del stack[1:]
            stack.append(body)
        stack[-1].kids.append(unescaped(raw))

    def ended(tags: set[str], beyond: set[str]) -> None:
        """Closes the outermost element of tags that is open within the nearest of beyond."""
        found = 0
        for k in range(len(stack) - 1, 1, -1):
            if stack[k].tag in beyond:
                break
            if stack[k].tag in tags:
                found = k
        if found:
            del stack[found:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m["tag"]
        if name is None:
            continue
        if not m["end"]:
            break  # the page ends inside a tag
        tag = name.lower()
        if m["close"]:
            if tag in ("html", "body"):
                continue
            if tag == "br":
                stack[-1].kids.append(Node("br"))
                continue
            if tag not in seen and tag != "p":
                if len(stack) == 1:
                    stack.append(body)
                continue
            fence = {"td", "th", "table"} if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") else {"table"} - {tag}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if stack[k] is not body:
                        del stack[k:]
                    break
                if stack[k].tag in fence:
                    break
            else:
                if tag == "p":
                    stack[-1].kids.append(Node("p"))
            if len(stack) == 1:
                stack.append(body)
            continue
        if tag == "html":
            root.attrs += " " + m["attrs"]
            continue
        if tag == "head":
            continue
        if tag == "body":
            body.attrs += " " + m["attrs"]
            if stack[-1] is head or len(stack) == 1:
                del stack[1:]
                stack.append(body)
            continue
        if (stack[-1] is head or len(stack) == 1) and tag not in HEAD_ONLY:
            del stack[1:]
            stack.append(body)
        if tag in CLOSES_P and "p" in seen:
            ended({"p"}, {"td", "th", "table", "caption", "button", "body"})
        if tag in ENDS and not seen.isdisjoint(ENDS[tag][0]):
            ended(*ENDS[tag])
        if len(stack) >= MOST_DEPTH:
            stack.pop()
        top = stack[-1].tag
        if tag in ("td", "th") and top in ("table", "tbody", "thead", "tfoot"):
            if top == "table":
                stack[-1].kids.append(Node("tbody"))
                stack.append(stack[-1].kids[-1])
            stack[-1].kids.append(Node("tr"))
            stack.append(stack[-1].kids[-1])
        elif tag == "tr" and top == "table":
            stack[-1].kids.append(Node("tbody"))
            stack.append(stack[-1].kids[-1])
        node = Node(tag, m["attrs"])
        seen.add(tag)
        stack[-1].kids.append(node)
        if tag in VOID or (m["attrs"].endswith("/") and (tag in ("path", "rect", "circle", "line", "use", "g", "svg", "math") or any(x.tag in ("svg", "math") for x in stack))):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            raw, at = (page[at : end.start()], end.end()) if end else (page[at:], n)
            if raw:
                node.kids.append(unescaped(raw) if tag in ("textarea", "title") else raw)
            continue
        stack.append(node)
    return root


def applies(media: str) -> bool:
    """Whether a list of media queries surely holds on SCREEN."""
    def part(q: str) -> bool | None:
        if m := _LENGTH.fullmatch(q):
            least, most = (float(m[3]) * (1 if m[4] == "px" else 16), SCREEN[m[2]])
            return most >= least if m[1] == "min" else most <= least
        if m := _LOOK.fullmatch(q):
            return LOOKS[m[1]] == m[2] if m[1] in LOOKS else None
        return q in ("all", "screen", "") if re.fullmatch(r"[\w-]*", q) else None

    def query(q: str) -> bool:
        inverse = q.startswith("not ")
        held = [part(x.strip()) for x in re.split(r"\sand\s", re.sub(r"^(not|only)\s+", "", q))]
        held = False if False in held else None if None in held else True
        return held is not None and held != inverse

    return any(query(" ".join(q.split())) for q in media.lower().split(","))


def hiding_rules(sheets: list[tuple[str, str]]) -> dict[str, dict[str, tuple[bool, int, str]]]:
    """Of simple selectors: what (media, sheet) in their order set display and visibility to, as (important, place, value)."""
    out: dict[str, dict[str, tuple[bool, int, str]]] = {}
    place = 0
    for media, sheet in sheets:
        if not applies(media):
            continue
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", "", sheet, flags=re.S)
        at = skipped = 0  # skipped: depth inside a block that isn't read
        body_of = None  # selectors of the rule that is open
        start = 0
        for m in _PART.finditer(sheet):
            if m[0] == "{":
                prelude = sheet[at : m.start()].strip()
                at = m.end()
                if skipped or body_of is not None:
                    skipped += 1
                elif prelude.startswith("@"):
                    name, _, rest = prelude[1:].replace("(", " (", 1).partition(" ")
                    name, rest = name.lower(), rest.strip().lower()
                    held = applies(rest) if name == "media" else name == "layer" or (name == "supports" and not rest.startswith("not"))
                    skipped = 0 if held else 1
                else:
                    body_of, start = prelude, at
            elif m[0] == "}":
                if skipped:
                    skipped -= 1
                elif body_of is not None:
                    for name, (important, value) in weighed(sheet[start : m.start()]).items():
                        for x in body_of.split(",") if name in ("display", "visibility") else ():
                            if _SIMPLE.fullmatch(x := x.strip()):
                                own = out.setdefault(x if x[0] in ".#" else x.lower(), {})
                                own[name] = max(own.get(name, (False, -1, "")), (important, place, value))
                    place += 1
                    body_of = None
                at = m.end()
            elif m[0] == ";":
                at = m.end()
    return out


def weighed(style: str) -> dict[str, tuple[bool, str]]:
    """Declarations as (important, value); of equally important ones the last."""
    out: dict[str, tuple[bool, str]] = {}
    for part in style.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        important = value.endswith("important") and value[:-9].rstrip().endswith("!")
        if colon and (important or not out.get(name, (False, ""))[0]):
            out[name] = important, value[:-9].rstrip()[:-1].rstrip() if important else value
    return out


def looks(rules: dict, tag: str, a: dict[str, str]) -> dict[str, str]:
    """display and visibility of an element, where its page sets them."""
    won: dict[str, tuple] = {}
    for weight, x in ((0, tag.removeprefix("svg:")), *((1, "." + c) for c in a.get("class", "").split()), (2, "#" + a.get("id", ""))) if rules else ():
        for name, (important, place, value) in rules.get(x, {}).items():
            won[name] = max(won.get(name, (False, -1, 0, "")), (important, weight, place, value))
    for name, (important, value) in weighed(a["style"]).items() if "style" in a else ():
        won[name] = max(won.get(name, (False, -1, 0, "")), (important, 3, 0, value))
    return {name: x[-1] for name, x in won.items()}


def drawn(root: Node) -> None:
    """Takes out of an svg or math element what isn't drawn; texts of a drawing are blocks."""
    todo = [root]
    while todo:
        node = todo.pop()
        node.kids = [k for k in node.kids if isinstance(k, str) or k.tag not in UNDRAWN]
        for k in node.kids:
            if isinstance(k, Node):
                k.tag = "svg:text" if k.tag == "text" else k.tag
                todo.append(k)


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of a block container: pending margin, a line in progress, collapsed spaces."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a collapsed space is due before the next text
        self.margin = 0  # blank lines due before the next line
        self.indent: list[str] = []
        self.mark = ""  # a list item's mark that waits for its first line

    def add(self, text: str, visible: bool, keep: bool) -> None:
        if keep:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self._put(first, visible)
            for x in more:
                self.end(forced=True)
                self._put(x, visible)
            return
        packed = _SPACE.sub(" ", text)
        if packed[:1] == " ":
            self.space = self.space or bool(self.line)
        body = packed.strip(" ")
        if body:
            if self.space:
                self._put(" ", True)
                self.space = False
            self._put(body, visible)
            self.space = packed[-1] == " "

    def _put(self, text: str, visible: bool) -> None:
        if text and visible:
            self.line.append(text)

    def end(self, forced: bool = False) -> None:
        """Ends the line in progress; forced: also an empty one."""
        text = "".join(self.line).rstrip(" ")
        self.line, self.space = [], False
        if text or forced:
            self.emit(text)

    def emit(self, text: str) -> None:
        if self.margin and self.lines:
            self.lines += [""] * self.margin
        self.margin = 0
        lead = "".join(self.indent)
        if self.mark:
            lead = lead[: len(lead) - len(self.mark)] + self.mark
            self.mark = ""
        self.lines.append((lead + text).rstrip(" ") if not text.strip() else lead + text)

    def block(self, spaced: bool) -> None:
        self.end()
        if spaced:
            self.margin = 1

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines)


def aligned(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Lines of a table whose cells are (text, columns spanned); a cell's lines stay in its column."""
    # Columns between which no cell begins are one.
    edges = sorted({0, *(at for row in rows for at in accumulate(span for _, span in row))})
    place = {edge: k for k, edge in enumerate(edges)}
    laid = []  # per row: (lines of the cell, first column, column after it)
    for row in rows:
        ends = list(accumulate(span for _, span in row))
        laid.append([(text.split("\n"), place[end - span], place[end]) for (text, span), end in zip(row, ends, strict=True)])
    wide = [0] * max(1, len(edges) - 1)
    for row in laid:
        for lines, at, to in row:
            if to == at + 1:
                wide[at] = max(wide[at], *(min(width(x), MOST_WIDTH) for x in lines))
    for row in laid:  # a spanning cell widens the last of its columns
        for lines, at, to in row:
            if to > at + 1:
                need = max(min(width(x), MOST_WIDTH) for x in lines) - sum(wide[at:to]) - 2 * (to - at - 1)
                wide[to - 1] += max(0, need)
    if sum(wide) > MOST_LINE:
        wide = [0] * len(wide)
    out = []
    for row in laid:
        spaces = [sum(wide[at:to]) + 2 * (to - at - 1) for _, at, to in row]
        for k in range(max((len(x) for x, *_ in row), default=0)):
            line = []
            for (x, *_), space in zip(row, spaces, strict=True):
                cell = x[k] if k < len(x) else ""
                line.append(cell + " " * (space - width(cell)))
            out.append("  ".join(line).rstrip())
    return out


def render(root: Node) -> str:
    sheets = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            sheets += [(attributes(node.attrs).get("media", ""), k) for k in node.kids if isinstance(k, str)]
        else:
            if node.tag in ("svg", "math"):
                drawn(node)
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    rules = hiding_rules(sheets)
    flows = [Flow()]
    tables: list[list[list[tuple[str, int]]]] = []
    lists: list[list] = []  # [is numbered, next number]
    stack: list[tuple] = [("open", root, True, False)]
    while stack:
        step, node, visible, keep = stack.pop()
        flow = flows[-1]
        if step == "text":
            flow.add(node, visible, keep)
            continue
        tag = node.tag
        if step == "close":
            if tag in LISTS or tag == "dl":
                flow.block(tag == "dl" or len(lists) == 1)
                if tag != "dl":
                    lists.pop()
            elif tag in ("li", "dd", "blockquote"):
                flow.end()
                if flow.mark:
                    flow.emit("")
                flow.indent.pop()
                if tag == "blockquote":
                    flow.block(True)
            elif tag in ("td", "th"):
                cell = flows.pop().text()
                if not tables[-1]:
                    tables[-1].append([])
                span = integer(attributes(node.attrs).get("colspan", ""), 1) if "colspan" in node.attrs.lower() else 1
                tables[-1][-1].append((cell, min(max(span, 1), MOST_SPAN)))
            elif tag == "table":
                for line in aligned([r for r in tables.pop() if r]):
                    flow.emit(line)
                flow.block(True)
            elif tag in BLOCK:
                flow.block(tag in SPACED)
            continue
        if tag in UNRENDERED or (tag == "input"):
            continue
        if node.attrs or tag in rules or tag in ("dialog", "svg:text"):
            a = attributes(node.attrs)
            look = looks(rules, tag, a)
            if look.get("display", "none" if "hidden" in a or (tag == "dialog" and "open" not in a) else "") == "none":
                continue
            if look.get("visibility", "inherit") not in ("inherit", "unset"):
                visible = look["visibility"] not in ("hidden", "collapse")
        if tag == "br":
            flow.end(forced=True)
            continue
        if tag == "wbr" or tag == "img":
            continue
        if tag == "hr":
            flow.block(True)
            continue
        kids = node.kids
        if tag == "details" and "open" not in attributes(node.attrs):
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        if tag in LISTS:
            flow.block(not lists)
            lists.append([tag == "ol", integer(attributes(node.attrs).get("start", ""), 1) if tag == "ol" and node.attrs else 1])
        elif tag == "li":
            flow.end()
            mark = "- "
            if lists and lists[-1][0]:
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            flow.indent.append(" " * len(mark))
            flow.mark = mark if visible else ""
        elif tag in ("dd", "blockquote"):
            flow.block(tag == "blockquote")
            flow.indent.append("  ")
        elif tag == "table":
            flow.block(True)
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            flows.append(Flow())
        elif tag in ("td", "th"):
            stack += [("open" if isinstance(k, Node) else "text", k, visible, keep) for k in reversed(kids)]
            flow.space = bool(flow.line)
            continue
        elif tag in BLOCK:
            flow.block(tag in SPACED)
        keep = keep or tag in ("pre", "textarea", "xmp", "listing", "plaintext")
        if tag == "pre" and kids and isinstance(kids[0], str) and kids[0][:1] == "\n":
            kids = [kids[0][1:], *kids[1:]]
        if tag in BLOCK or tag in ("td", "th"):
            stack.append(("close", node, visible, keep))
        ignore = tag in ("table", "tbody", "thead", "tfoot", "tr", "select") and tag != "select"
        stack += [("open" if isinstance(k, Node) else "text", k, visible, keep) for k in reversed(kids) if isinstance(k, Node) or not (ignore and not k.strip())]
    return flows[0].text()


def extract(page: str | None) -> str:
    return render(build(page or ""))


TEXTS = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines for every row of pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield batch_of(TEXTS, [b.column("page_id"), texts, [len(t) for t in texts], [t.count("\n") + 1 if t else 0 for t in texts]])

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "html"), run, "page_id long, text string, n_chars long, n_lines long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
