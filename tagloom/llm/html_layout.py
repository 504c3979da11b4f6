"""Visible text of web pages, laid out: a tree builder with implied tags, visibility rules, and a renderer for blocks.

The tree builder closes elements as browsers do where an end tag may be left out (p, li, dt, dd, options, table parts),
ignores stray end tags and closes what is open at the end. What stands in a table but in no cell or caption goes before
the table, and a table directly in a table ends the outer one. Hidden are elements that are never shown (head, script,
style, template ...), hidden inputs, and, unless a style shows them, the ``hidden`` attribute and closed dialogs. Of the
page's own styles ``display`` and ``visibility`` count, by the cascade (important, inline, ids, classes, tags, order), for
selectors of tags, classes and ids joined as descendants or children. What is inside a box that is not displayed is hidden;
what is inside an invisible one may be made visible again. Rules that hold under a condition (media queries with features,
print, supports, containers) hide nothing.

Blocks are separated by a blank line where they have margins, else by a new line. List items get a dash or a number and
are indented with their list; table cells are padded to columns, over several of which a cell may go. Tables nested more
than ``_NESTED_TABLES`` deep are written as running text. White space collapses outside ``pre``.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Generator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.textlinear import mapped

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DECLARATION = re.compile(r"\s*(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?\s*", re.I)
#: Comments, strings and addresses of a style sheet, or a sign that ends something.
_CSS = re.compile(r"(/\*.*?(?:\*/|\Z))|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|\burl\([^)]*\)?|([{};])", re.S | re.I)
_AT_RULE = re.compile(r"@([\w-]+)(.*)", re.S)
_NOT_A_SCREEN = re.compile(r"not\s+(?!(?:all|screen)\Z)[\w-]+")
#: Selectors of tags, classes and ids, joined as descendants or children; others hide nothing.
_SIMPLE = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_PARTS_OF = re.compile(r"\s*(>)\s*|\s+")
_SPACE = re.compile(r"[ \t\n\r\f]+")


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


#: Fixed values of the HTML standard.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes")
NEVER_SHOWN = _set(
    "head script style template noscript title meta link iframe noembed noframes datalist audio video canvas object desc metadata defs annotation annotation-xml rp"
)
SPACED = _set("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table hr fieldset details dialog menu dir")
BLOCKS = SPACED | _set(
    "address article aside body center dd div dt fieldset figcaption footer form header hgroup html legend li main nav option "
    "optgroup plaintext search section summary tr td th thead tbody tfoot caption"
)
ENDS_P = BLOCKS - _set("body html option optgroup td th tr thead tbody tfoot caption")
#: An opening tag closes these, up to the elements that bound the search.
IMPLIED = {
    "li": (_set("li"), _set("ul ol menu dir")),
    "dt": (_set("dt dd"), _set("dl")),
    "dd": (_set("dt dd"), _set("dl")),
    "option": (_set("option"), _set("select datalist")),
    "optgroup": (_set("option optgroup"), _set("select")),
    "td": (_set("td th"), _set("table")),
    "th": (_set("td th"), _set("table")),
    "tr": (_set("tr td th"), _set("table")),
    "thead": (_set("thead tbody tfoot tr td th"), _set("table")),
    "tbody": (_set("thead tbody tfoot tr td th"), _set("table")),
    "tfoot": (_set("thead tbody tfoot tr td th"), _set("table")),
    "body": (_set("head"), _set("")),
}
_SCOPE = _set("table td th caption body html button object template")
#: Parts of a table, and the open elements that each goes into.
_PARTS = {
    **dict.fromkeys(("caption", "colgroup", "thead", "tbody", "tfoot"), _set("table")),
    "col": _set("table colgroup"),
    "tr": _set("table thead tbody tfoot"),
    "td": _set("table thead tbody tfoot tr"),
    "th": _set("table thead tbody tfoot tr"),
}
_PART_HOLDERS = _set("table thead tbody tfoot tr colgroup")
_OWN_CONTENT = _set("template noscript svg math")
#: If the innermost of these is a table, the place is in a table but in no cell.
_TABLE_MODE = _OWN_CONTENT | _set("table td th caption")
#: Columns of indentation by default; text at any depth is kept, but not pushed further to the right.
MOST_INDENT = 1024


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree and the bodies of the page's style elements for screens."""
    root = Node("#root")
    stack, styles, at = [root], [], 0
    places: dict[str, list[int]] = {}  # of the open elements in the stack, by tag

    def innermost(tags: frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(i: int) -> None:
        for n in stack[i:]:
            places[n.tag].pop()
        del stack[i:]

    def close(tags: frozenset[str], bounds: frozenset[str]) -> None:
        """Close the outermost open element of ``tags`` that no element of ``bounds`` shields."""
        bound = innermost(bounds)
        inside = [p[bisect_right(p, bound)] for t in tags if (p := places.get(t)) and p[-1] > bound]
        if inside:
            cut(min(inside))

    def in_table() -> int:
        """The place of the table that has what comes next in no cell, else 0."""
        i = innermost(_TABLE_MODE) if places.get("table") else 0
        return i if stack[i].tag == "table" else 0

    def put(child: Node | str) -> None:
        """Into the open element, or before the table; an open table is the last child of its parent."""
        i = in_table() if stack[-1].tag in _PART_HOLDERS else 0
        if not i or isinstance(child, Node) and child.tag in _PARTS or isinstance(child, str) and not child.strip(" \t\n\r\f"):
            stack[-1].children.append(child)
            return
        if stack[-1].tag == "colgroup":
            cut(len(stack) - 1)
        stack[i - 1].children.insert(-1, child)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            put(html.unescape(page[at : m.start() if m else len(page)]))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not places.get("p"):
                put(Node("p"))
            elif tag == "br":
                put(Node("br"))
            else:
                i = innermost(frozenset((tag,)))
                if i and (tag in BLOCKS or i >= innermost(_SCOPE)):
                    cut(i)
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ENDS_P:
            close(_set("p"), _SCOPE)
        if tag in _PARTS or tag == "table":
            if tag in _PARTS:
                close(_set("caption"), _OWN_CONTENT | {"table"})
            if i := in_table():
                cut(max(i, innermost(_PARTS[tag])) + 1 if tag in _PARTS else i)
        node = Node(tag, _attributes(m[3]) if m[3].strip() else {})
        put(node)
        if tag == "plaintext":
            node.children.append(page[at:])
            at = len(page)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            if tag == "style" and on_screen(node.attributes.get("media", "")):
                styles.append(body)
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path", "math")):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root, styles


def on_screen(media: str) -> bool:
    """Whether one of the media queries holds on every screen; one with features does not."""
    queries = [re.sub(r"^only\s+", "", q.strip()) for q in media.lower().split(",")]
    return queries == [""] or any(q in ("all", "screen") or _NOT_A_SCREEN.fullmatch(q) for q in queries)


@dataclass(frozen=True, slots=True)
class Rule:
    """A selector, last part first (tag, classes, ids, whether the next part is the parent), and what it declares."""

    parts: tuple[tuple[str, frozenset[str], frozenset[str], bool], ...]
    declared: tuple[tuple[str, str, bool], ...]
    order: tuple[int, int, int, int]


def declarations(text: str) -> tuple[tuple[str, str, bool], ...]:
    """``display`` and ``visibility`` as declared, in order: name, value, whether important."""
    found = (_DECLARATION.fullmatch(d) for d in text.split(";"))
    return tuple((m[1].lower(), m[2].lower(), bool(m[3])) for m in found if m)


def _selector(text: str) -> tuple[tuple[str, frozenset[str], frozenset[str], bool], ...] | None:
    pieces = _PARTS_OF.split(text.strip())
    out = []
    for i in range(0, len(pieces), 2):
        m = _SIMPLE.fullmatch(pieces[i])
        if not m or not pieces[i]:
            return None
        names = re.findall(r"[.#][\w-]+", m[2])
        own = (frozenset(x[1:] for x in names if x[0] == sign) for sign in ".#")
        out.append((m[1].lower() if m[1] and m[1] != "*" else "", *own, i > 0 and pieces[i - 1] == ">"))
    return tuple(reversed(out))


def visibility_rules(styles: list[str]) -> list[Rule]:
    """Rules on display and visibility, in the order of the cascade, but for rules in at-rules that hold under a condition."""
    out: list[Rule] = []
    for sheet in styles:
        blocks: list[str | None] = []  # open ones: a rule's selectors, "" where rules count, None where nothing counts
        parts, at, body = [], 0, []
        for m in _CSS.finditer(sheet):
            sign = m[2]
            parts.append(sheet[at : m.start() if m[1] or sign else m.end()])
            at = m.end()
            if not sign:
                continue
            text, parts = "".join(parts).strip(), []
            if sign == "{":
                rule = _AT_RULE.fullmatch(text)
                if blocks and blocks[-1] != "":
                    blocks.append(None)
                elif rule:
                    name = rule[1].lower()
                    blocks.append("" if name == "layer" or name == "media" and on_screen(rule[2]) else None)
                else:
                    blocks.append(text or None)
                body = []
                continue
            body.append(text)
            if sign == "}" and blocks:
                if blocks[-1] and (declared := declarations(";".join(body))):
                    for one in blocks[-1].split(","):
                        if found := _selector(one):
                            ids, classes, tags = (sum(f(p) for p in found) for f in (lambda p: len(p[2]), lambda p: len(p[1]), lambda p: bool(p[0])))
                            out.append(Rule(found, declared, (ids, classes, tags, len(out))))
                blocks.pop()
                body = []
    return sorted(out, key=lambda r: r.order)


class Rules:
    """The rules of a page, found by the rarest name that the last part of their selector asks for."""

    def __init__(self, rules: list[Rule]) -> None:
        self.by_name: dict[str, list[Rule]] = {}
        for r in rules:
            tag, classes, ids, _ = r.parts[0]
            name = f"#{min(ids)}" if ids else f".{min(classes)}" if classes else tag
            self.by_name.setdefault(name, []).append(r)

    def of(self, node: Node, path: list[Node]) -> list[Rule]:
        """Those that fit an element whose ancestors are ``path``, in the order of the cascade."""
        if not self.by_name:
            return []
        names = ["", node.tag, *("." + c for c in set(node.classes())), "#" + node.attributes.get("id", "")]
        found = [r for n in names for r in self.by_name.get(n, ()) if _fits(r, node, path)]
        return sorted(found, key=lambda r: r.order)


def _fits(rule: Rule, node: Node, path: list[Node]) -> bool:
    def one(part: tuple[str, frozenset[str], frozenset[str], bool], n: Node) -> bool:
        tag, classes, ids, _ = part
        return (not tag or tag == n.tag) and classes <= set(n.classes()) and ids <= {n.attributes.get("id", "")}

    if not one(rule.parts[0], node):
        return False
    places = {len(path)}  # where the part before may stand: above one of these
    last_child = max((i for i, part in enumerate(rule.parts) if part[3]), default=-1)
    for k, (before, part) in enumerate(zip(rule.parts, rule.parts[1:], strict=False)):
        if before[3]:
            places = {i - 1 for i in places if i > 0 and one(part, path[i - 1])}
        else:
            above = (i for i in range(max(places) - 1, -1, -1) if one(part, path[i]))
            if k + 1 > last_child:  # only ancestors at any distance follow, so the nearest leaves most of them
                nearest = next(above, None)
                places = set() if nearest is None else {nearest}
            else:
                places = set(above)
        if not places:
            return False
    return True


def seen(node: Node, path: list[Node], rules: Rules, visible: bool) -> tuple[bool, bool]:
    """Whether the element has a box, and whether its own text shows; ``visible`` is what it inherits."""
    a = node.attributes
    if node.tag in NEVER_SHOWN or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False, False
    display, visibility = "none" if "hidden" in a or node.tag == "dialog" and "open" not in a else "", ""
    listed = [d for r in rules.of(node, path) for d in r.declared] + list(declarations(a.get("style", "")))
    for name, value, _ in [d for d in listed if not d[2]] + [d for d in listed if d[2]]:
        if name == "display":
            display = value
        else:
            visibility = value
    if visibility in ("hidden", "collapse"):
        visible = False
    elif visibility in ("visible", "initial"):
        visible = True
    return display != "none", visible


class _Page:
    """Lines being written: text collects in the current line, breaks are remembered until more text comes."""

    def __init__(self, most_indent: int) -> None:
        self.most_indent = most_indent
        self.lines: list[str] = []
        self.text = ""
        self.gap = 0
        self.indent = 0
        self.marker = ""

    def add(self, text: str, keep: bool = False) -> None:
        if keep:
            parts = text.split("\n")
            for i, part in enumerate(parts):
                if i:
                    self.line()
                    self.lines.append(" " * min(self.indent, self.most_indent)) if not part and i < len(parts) - 1 else None
                self.text += part
            return
        text = _SPACE.sub(" ", text)
        self.text += text.lstrip(" ") if not self.text or self.text.endswith(" ") else text

    def line(self) -> None:
        body = self.text.rstrip(" ")
        self.text = ""
        if not body:
            return
        if self.lines and self.gap > 1:
            self.lines.append("")
        self.gap = 0
        head = " " * (min(self.indent, self.most_indent) - len(self.marker)) + self.marker
        self.marker = ""
        self.lines.append(head + body)

    def block(self, spaced: bool) -> None:
        self.line()
        self.gap = max(self.gap, 2 if spaced else 1)


def _span(cell: Node, name: str, most: int) -> int:
    text = cell.attributes.get(name, "").strip()
    return min(max(1, int(text)), most) if re.fullmatch(r"[0-9]{1,9}", text) else 1


def _cells(table: Node, path: list[Node], rules: Rules, visible: bool) -> tuple[list[tuple], list[list[tuple]]]:
    """Captions and rows of a table, not of tables inside it: each cell with its ancestors and whether its text shows."""
    captions: list[tuple] = []
    rows: list[list[tuple]] = []
    waiting = [(iter(table.children), [*path, table], visible)]
    while waiting:
        children, above, shows = waiting[-1]
        child = next(children, None)
        if child is None:
            waiting.pop()
            continue
        if isinstance(child, str):
            continue
        boxed, own = seen(child, above, rules, shows)
        if not boxed:
            continue
        if child.tag == "caption":
            captions.append((child, above, own))
        elif child.tag in ("td", "th"):
            (rows if rows else rows.append([]) or rows)[-1].append((child, above, own))
        else:
            if child.tag == "tr":
                rows.append([])
            waiting.append((iter(child.children), [*above, child], own))
    return captions, [r for r in rows if r]


def _table(table: Node, path: list[Node], page: _Page, rules: Rules, visible: bool) -> _Step:
    """Cells padded to columns; one over several columns or rows takes their places, and its text stands in the first."""
    captions, rows = _cells(table, path, rules, visible)
    for c, above, shows in captions:
        page.block(False)
        page.add((yield _rendered(c, above, rules, page.most_indent, shows)), keep=True)
    widths: list[int] = []
    placed: list[list[tuple[int, int, list[str]]]] = []  # of each row: first column, columns, lines
    taken: dict[int, int] = {}  # rows that a column is still held for
    wide = []
    for r in rows:
        line, at = [], 0
        held = {c: n - 1 for c, n in taken.items() if n > 1}
        for c, above, shows in r:
            while at in taken:
                at += 1
            columns, down = _span(c, "colspan", 1000), _span(c, "rowspan", len(rows))
            lines = (yield _rendered(c, above, rules, page.most_indent, shows)).split("\n")
            line.append((at, columns, lines))
            need = max(map(len, lines))
            if columns == 1:
                widths += [0] * (at + 1 - len(widths))
                widths[at] = max(widths[at], need)
            else:
                wide.append((at, columns, need))
            if down > 1:
                held.update((x, down - 1) for x in range(at, at + columns))
            at += columns
        taken = held
        placed.append(line)
    for at, columns, need in wide:  # what a wide cell needs beyond its columns goes to its first one
        last = min(at + columns, max(len(widths), at + 1))
        widths += [0] * (last - len(widths))
        widths[at] += max(0, need - sum(widths[at:last]) - 3 * (last - at - 1))
    start = [0]
    for w in widths:
        start.append(start[-1] + w + 3)
    for line in placed:
        for n in range(max(len(lines) for _, _, lines in line)):
            page.block(False)
            text = ""
            for at, _, lines in line:
                if at:
                    text = text.ljust(start[min(at, len(widths))] - 3) + " | "
                text += lines[n] if n < len(lines) else ""
            if any(n < len(lines) and lines[n] for *_, lines in line):
                while text.endswith(" | "):  # empty cells at the end
                    text = text[:-3].rstrip(" ")
                page.text = text


def _shown(node: Node) -> list[Node | str]:
    """The children of an element; of details that are not open only their first summary."""
    if node.tag == "details" and "open" not in node.attributes:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    return node.children


#: Rendering goes on where it was when the text that it has yielded is rendered, so tables nest to any depth.
_Step = Generator["_Step", str | None, str | None]


def _finished(step: _Step) -> str | None:
    steps, value = [step], None
    while steps:
        try:
            steps.append(steps[-1].send(value))
            value = None
        except StopIteration as done:
            steps.pop()
            value = done.value
    return value


def _rendered(root: Node, path: list[Node], rules: Rules, most_indent: int, visible: bool = True) -> _Step:
    page = _Page(most_indent)
    counters: list[int | None] = []
    plain = 0
    above = [*path, root]
    waiting: list[tuple[str, object, bool]] = [("open", c, visible) for c in reversed(root.children)]
    while waiting:
        step, item, shows = waiting.pop()
        if step == "left":
            above.pop()
            continue
        if step == "close":
            node, before = item
            above.pop()
            page.block(node.tag in SPACED and not (node.tag in ("ul", "ol") and counters and len(counters) > 1))
            if node.tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
            plain -= node.tag in ("pre", "plaintext")
            page.indent, page.marker = before, ""
            continue
        if isinstance(item, str):
            if shows:
                page.add(item, plain > 0)
            continue
        boxed, own = seen(item, above, rules, shows)
        if not boxed:
            continue
        tag = item.tag
        if tag == "br":
            if page.text.strip():
                page.line()
            else:
                page.gap = 2
            continue
        if tag == "table":
            page.block(True)
            yield _table(item, above, page, rules, own)
            page.block(True)
            continue
        if tag in ("td", "th") and not page.text.endswith(" "):
            page.text += " "
        if tag not in BLOCKS:
            if own and tag == "input" and item.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                page.add(item.attributes.get("value", ""))
            above.append(item)
            waiting.append(("left", None, own))
            waiting += [("open", c, own) for c in reversed(_shown(item))]
            continue
        page.block(tag in SPACED and not (tag in ("ul", "ol") and counters))
        before = page.indent
        if tag in ("ul", "ol", "menu", "dir"):
            start = item.attributes.get("start", "1")
            counters.append((int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if tag == "ol" else None)
        elif tag == "li":
            if counters and counters[-1] is not None:
                page.marker = f"{counters[-1]}. "
                counters[-1] += 1
            else:
                page.marker = "- "
            page.indent += len(page.marker)
        elif tag in ("dd", "blockquote"):
            page.indent += 2
        plain += tag in ("pre", "plaintext")
        above.append(item)
        waiting.append(("close", (item, before), own))
        waiting += [("open", c, own) for c in reversed(_shown(item))]
    page.line()
    return "\n".join(page.lines)


def visible_text(page: str | None, most_indent: int = MOST_INDENT) -> str:
    """All visible text of a page, laid out; empty for null."""
    if not page:
        return ""
    root, styles = parse(page)
    return _finished(_rendered(root, [], Rules(visibility_rules(styles)), most_indent))


def extract_pages(pages: DataFrame, *, page_id: str = "page_id", html_column: str = "html", most_indent: int = MOST_INDENT) -> DataFrame:
    """``page_id``, ``text`` and ``n_chars`` of every row.

    Null and empty pages give an empty text. Repeated rows give repeated rows. Extra columns are ignored. An empty table
    gives no rows.
    """

    def start():
        def row(key: int | None, page: str | None) -> tuple:
            text = visible_text(page, most_indent)
            return key, text, len(text)

        return row

    return mapped(pages.select(F.col(page_id).cast("long"), F.col(html_column).cast("string")), "page_id long, text string, n_chars long", start)
