"""Markup residue in text: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

Method: tree scoring. A text of any family becomes a tree of containers (HTML elements, runs of list items) and
blocks; paragraphs pass points for length and commas to their ancestors, which are discounted by their link
density. The best container is kept, with those of its siblings, and of its ancestors' siblings, that score enough or
hold structure, and without parts of it that are mostly links. On the way every construct that is taken out says
which family it belongs to; code is set aside first, so nothing in it counts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..common import spread

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"

# Names of HTML elements, by how a text reader treats them.
CONTAINERS = frozenset(
    "html body div section article main header footer nav aside form fieldset table thead tbody tfoot ul ol dl blockquote figure details center".split()
)
BLOCKS = frozenset("p li dt dd tr td th caption h1 h2 h3 h4 h5 h6 address figcaption summary pre hr br title option legend".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data datalist del dfn em embed font i iframe img input ins kbd label link map mark "
    "area audio base canvas col colgroup head meta meter noscript object output param picture progress q rp rt ruby s samp script select small "
    "source span strike strong style sub sup svg template textarea time track tt u var video wbr dialog menu optgroup hgroup search slot".split()
)
ELEMENTS = CONTAINERS | BLOCKS | INLINE
#: Containers that hold structure, which a low score alone does not drop; those of items and rows.
STRUCTURE = frozenset("ul ol dl table thead tbody tfoot blockquote figure details list".split())
LISTS = frozenset("ul ol dl".split())

#: Set-aside pieces are numbered between these private-use characters until the end.
_OPEN, _CLOSE = "\ue010", "\ue011"
_HELD = re.compile(f"{_OPEN}(\\d+){_CLOSE}")

_ATTR = r"""(?:\s+[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*"""
_TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9]*)({_ATTR})\s*(/?)>")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_DOCTYPE = re.compile(r"<!DOCTYPE[^<>]*>", re.I)
_RAW = re.compile(rf"<(script|style){_ATTR}\s*>.*?</\1\s*>", re.S | re.I)
_CHARREF = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

_FRONT = re.compile(r"\A---[ \t]*\n(.*?\n)?(?:---|\.\.\.)[ \t]*(?:\n|\Z)", re.S)
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^`\n]*)\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", re.S | re.M)
_SPAN = re.compile(r"(?<!`)(`+)(?!`)((?:[^\n]|\n(?!\s*\n))+?)(?<!`)\1(?!`)")
_LIST = re.compile(r"^ {0,3}(?:[-*+]|\d{1,9}[.)]) +\S")

_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted)\}(?:\[[^\]]*\])?(.*?)\\end\{\1\}", re.S)
_MATH_ENV = r"(?:equation|align|gather|multline|eqnarray|displaymath|math|alignat|flalign)\*?"
_MATH = [
    re.compile(rf"\\begin\{{({_MATH_ENV})\}}(?P<body>.*?)\\end\{{\1\}}", re.S),
    re.compile(r"\$\$(?P<body>(?:[^$\n]|\n(?!\s*\n))+?)\$\$"),
    re.compile(r"(?<!\\)\\\[(?P<body>(?:[^\n\\]|\\(?!\[)|\n(?!\s*\n))+?)\\\]"),
    re.compile(r"(?<!\\)\\\((?P<body>(?:[^\n\\]|\\(?!\())+?)\\\)"),
    re.compile(r"(?<![\\$\w])\$(?![\s$])(?P<body>[^$\n]*?[^\s$\\])\$(?![\w$])"),
]
_ENV = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_COMMAND_ARG = re.compile(r"(?<![\\:])\\([A-Za-z]{2,})\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_COMMAND = re.compile(r"(?<![\w\\:/.])\\([A-Za-z]{2,})\*?(?![\\\w{])")
_LATEX_HEADING = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5, "title": 1}
_LATEX_SILENT = frozenset("label ref eqref pageref cite citep citet bibliography bibliographystyle documentclass usepackage includegraphics input include vspace hspace".split())

_WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*\n(.*?)^[ \t]*\|\}", re.S | re.M)
_TEMPLATE = re.compile(r"\{\{(?![{\s])([^{}]*?)\}\}")
_WIKI_LINK = re.compile(r"!?\[\[(?=[^\[\]\n]*[^\s\[\]])([^\[\]\n]*)\]\]")
_WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^=\n]*[^=\s])?)[ \t]*\1[ \t]*$", re.M)
_APOSTROPHES = re.compile(r"(?<!')('{2,5})(?!')([^\n]*?[^'\n])\1(?!')")

_REF_DEF = re.compile(r"^ {0,3}\[(\^?)([^\[\]\n]+)\]:[ \t]*(\S[^\n]*)$", re.M)
_FOOT_REF = re.compile(r"(?<!\w)?\[\^[^\[\]\s]+\](?!:)")
_LINK = re.compile(r"(!?)\[((?:[^\[\]\n]|\[[^\[\]\n]*\])*)\]\(\s*(<[^<>\n]*>|[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\s*\)")
_REF_LINK = re.compile(r"!?\[([^\[\]\n]+)\][ ]?\[([^\[\]\n]*)\]")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*)$", re.M)
_SETEXT = re.compile(r"^(?! {0,3}(?:[-*+>#]|\d+[.)] ))( {0,3}\S[^\n]*)\n {0,3}(=+|-{2,})[ \t]*$", re.M)
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)
_QUOTE = re.compile(r"^ {0,3}((?:>[ \t]?)+)(?=\S)", re.M)
_TABLE_RULE = re.compile(r"^(?=[^\n]*\|)([^\n]*)\n[ \t]*(?=[^\n]*\|)\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$", re.M)
_TABLE_ROW = re.compile(r"[ \t]*\|(.*)\|[ \t]*")
_EMPHASIS = [
    re.compile(r"(?<![\w*\\])(\*{1,3})(?![\s*])([^*\n]*[^\s*\\])\1(?![\w*])"),
    re.compile(r"(?<![\w\\])(_{1,3})(?![\s_])((?:[^_\n]|(?<=\w)_+(?=\w))*?[^\s_\\])\1(?!\w)"),
]
_STRIKE = re.compile(r"(?<!~)(~~)(?![\s~])([^~\n]*[^\s~])~~(?!~)")


#: Code elements, outer ones first, whose contents are set aside.
_PRE = {n: re.compile(rf"<({n}){_ATTR}\s*>(.*?)</\1\s*>", re.S | re.I) for n in ("pre", "syntaxhighlight", "source", "nowiki", "code", "samp", "tt")}


def heading(text: str) -> str:
    """A heading's text without its closing marks."""
    bare = text.rstrip(" \t").rstrip("#")
    return bare.rstrip(" \t") if not bare or bare[-1] in " \t" else text.rstrip(" \t")


@dataclass
class Node:
    """A container of the tree, or a block: heading, item, code, formula, row or paragraph."""

    kind: str
    level: int = 0
    text: str = ""
    link_chars: int = 0
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None
    score: float = 0.0

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    #: Characters of the node and all below it, and those of them inside links.
    size: int = 0
    linked: int = 0


@dataclass
class Cleaned:
    text: str
    families: list[str]
    blocks: list[tuple[str, int, str]]


class _Cleaner:
    """One text on its way through the families; code and formulas wait in `held`."""

    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n").replace(_OPEN, "").replace(_CLOSE, "")
        self.families: set[str] = set()
        self.held: list[tuple[str, str]] = []

    def hold(self, kind: str, text: str) -> str:
        self.held.append((kind, text))
        return f"{_OPEN}{len(self.held) - 1}{_CLOSE}"

    def sub(self, pattern: re.Pattern, family: str | None, to: Callable[[re.Match], str | None], *ends: str) -> None:
        """Replace what matches; a replacement of None leaves the match alone and counts for no family.

        No match ends behind the last of `ends`, where these are given: openings there are not searched from, which
        keeps texts with very many unclosed openings from quadratic time.
        """

        def one(m: re.Match) -> str:
            new = to(m)
            if new is None:
                return m.group(0)
            if family:
                self.families.add(family)
            return new

        if not ends:
            self.text = pattern.sub(one, self.text)
            return
        lower = self.text.lower() if any("<" in e for e in ends) else self.text
        if len(lower) == len(self.text) and (at := max(map(lower.rfind, ends))) >= 0:
            stop = next((i for i in (self.text.find(c, at + 2) for c in ">}") if i >= 0), len(self.text) - 1)
            stop = max(stop, at + max(map(len, ends))) + 1
            self.text = pattern.sub(one, self.text[:stop]) + self.text[stop:]
        elif len(lower) != len(self.text):
            self.text = pattern.sub(one, self.text)

    def block(self, kind: str, text: str) -> str:
        return f"\n\n{self.hold(kind, text)}\n\n"

    def code(self) -> None:
        self.sub(_FRONT, MARKDOWN, lambda m: "")
        if "```" in self.text or "~~~" in self.text:
            self.sub(_FENCE, MARKDOWN, lambda m: self.block("code", m[3].rstrip("\n")))
        if "\\begin{" in self.text:
            self.sub(_VERBATIM, LATEX, lambda m: self.block("code", m[2].strip("\n")), "\\end{")
        if "\n    " in self.text or self.text.startswith("    "):
            self.indented()
        if "<" in self.text:
            for name, pattern in _PRE.items():
                self.sub(pattern, HTML, self.html_code, f"</{name}")
        if "`" in self.text:
            self.sub(_SPAN, MARKDOWN, lambda m: self.hold("span", m[2].strip()))

    def html_code(self, m: re.Match) -> str:
        name, body = m[1].lower(), m[2]
        inner = html.unescape(re.sub(r"</?(?:code|span|samp)\b[^<>]*>", "", body))
        if name == "pre" or "\n" in inner.strip("\n"):
            return self.block("code", inner.strip("\n"))
        return self.hold("span", inner)

    def indented(self) -> None:
        """Blocks indented by four blanks after a blank line, outside lists."""
        lines, out, i, blank, listed = self.text.split("\n"), [], 0, True, False
        while i < len(lines):
            line = lines[i]
            if line.startswith("    ") and line.strip() and blank and not listed:
                j = i
                while j < len(lines) and (lines[j].startswith("    ") or not lines[j].strip()):
                    j += 1
                out.append(self.block("code", "\n".join(x[4:] for x in lines[i:j]).rstrip("\n")))
                self.families.add(MARKDOWN)
                i, blank = j, True
                continue
            if _LIST.match(line):
                listed = True
            elif line.strip() and not line.startswith("    "):
                listed = line.startswith("  ") and listed
            blank = not line.strip()
            out.append(line)
            i += 1
        self.text = "\n".join(out)

    def formulas(self) -> None:
        if "$" in self.text or "\\" in self.text:
            for i, p in enumerate(_MATH):
                formula = lambda m: self.hold("formula", re.sub(r"\\label\{[^{}]*\}", "", m["body"]).strip()) if m["body"].strip() else None
                self.sub(p, LATEX, formula, *(["\\end{"] if i == 0 else []))

    def latex(self) -> None:
        if "\\" not in self.text:
            return
        self.sub(_ENV, LATEX, lambda m: "\n")

        def command(m: re.Match) -> str:
            name, arg = m[1], m[2]
            if name in _LATEX_HEADING:
                return f"\n\n{self.hold(f'h{_LATEX_HEADING[name]}', arg)}\n\n"
            if name in _LATEX_SILENT:
                return ""
            return f" ({arg})" if name == "footnote" else arg

        while True:  # innermost arguments first
            before = self.text
            self.sub(_COMMAND_ARG, LATEX, command)
            if self.text == before:
                break
        self.sub(_COMMAND, LATEX, lambda m: "- " if m[1] == "item" else "")

    def wiki(self) -> None:
        if "{|" in self.text:
            self.sub(_WIKI_TABLE, WIKI, lambda m: "\n\n" + re.sub(r"^[ \t]*(?:\|-[^\n]*|\|\+|[|!])[ \t]*", "", m[1], flags=re.M).replace("||", " ; ").replace("!!", " ; ") + "\n\n", "|}")
        while "{{" in self.text:
            before = self.text
            self.sub(_TEMPLATE, WIKI, lambda m: "")
            if self.text == before:
                break
        if "[[" in self.text:
            self.sub(_WIKI_LINK, WIKI, lambda m: self.link(m[1].split("|")[-1].strip() or m[1].strip("| ")))
        if "==" in self.text or self.text.startswith("="):
            self.sub(_WIKI_HEADING, WIKI, lambda m: f"\n\n{self.hold(f'h{len(m[1])}', m[2])}\n\n" if len(m[1]) > 1 else None)
        if "''" in self.text:
            self.sub(_APOSTROPHES, WIKI, lambda m: m[2])

    def link(self, label: str) -> str:
        return self.hold("link", label)

    def markdown(self) -> None:
        if "](" in self.text:
            self.sub(_LINK, MARKDOWN, lambda m: None if not m[3] else "" if m[1] and not m[2] else self.link(m[2]))
        if "[" in self.text:
            if "]:" in self.text:
                labels = {m[2].lower() for m in _REF_DEF.finditer(self.text)}
                self.sub(_REF_LINK, MARKDOWN, lambda m: self.link(m[1]) if (m[2] or m[1]).lower() in labels else None)
                self.sub(_REF_DEF, MARKDOWN, lambda m: f"{m[3]}" if m[1] else "")
            self.sub(_FOOT_REF, MARKDOWN, lambda m: "")
        self.sub(_AUTOLINK, MARKDOWN, lambda m: self.link(m[1]))
        if "|" in self.text:
            self.sub(_TABLE_RULE, MARKDOWN, lambda m: m[1])
        if "#" in self.text:
            self.sub(_ATX, MARKDOWN, lambda m: f"\n\n{self.hold(f'h{len(m[1])}', heading(m[2]))}\n\n")
        if "\n=" in self.text or "\n-" in self.text or "\n " in self.text:
            self.sub(_SETEXT, MARKDOWN, lambda m: f"\n\n{self.hold('h1' if m[2][0] == '=' else 'h2', m[1].strip())}\n\n" if len(m[2]) > 2 and "|" not in m[1] else None)
        self.sub(_RULE, MARKDOWN, lambda m: "")
        if ">" in self.text:
            self.sub(_QUOTE, MARKDOWN, lambda m: "")
        if "*" in self.text or "_" in self.text:
            for p in _EMPHASIS:
                for _ in range(2):  # strong in emphasis
                    self.sub(p, MARKDOWN, lambda m: m[2])
        if "~~" in self.text:
            self.sub(_STRIKE, MARKDOWN, lambda m: m[2])

    def restore(self, text: str) -> str:
        while _OPEN in text:
            text = _HELD.sub(lambda m: self.held[int(m[1])][1], text)
        return text

    def linked(self, text: str) -> int:
        return sum(len(self.held[int(i)][1]) for i in _HELD.findall(text) if self.held[int(i)][0] == "link")

    def tree(self) -> Node:
        """Containers by HTML elements, blocks by tags, set-aside pieces and blank lines."""
        root = Node("root")
        at, buffer, anchors, kind, level = root, [], [0, 0], "p", 0  # anchors: depth, characters

        def flush() -> None:
            nonlocal kind, level
            raw = "".join(buffer)
            buffer.clear()
            for part in re.split(r"\n[ \t]*\n", raw):
                held = _HELD.fullmatch(part.strip())
                if held and (k := self.held[int(held[1])])[0][0] in "hcf" and k[0] != "html":
                    name = "heading" if k[0][0] == "h" else k[0]
                    at.add(Node(name, int(k[0][1]) if name == "heading" else 0, self.restore(k[1])))
                    continue
                if kind in ("heading", "row", "item") or not part.strip():
                    lines = [" ".join(part.split())] if part.strip() else []
                else:
                    lines = part.split("\n")
                prose: list[str] = []
                run: Node | None = None  # list of the items that follow each other
                for line in [*lines, None]:
                    item = line is not None and re.match(r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(?=\S)", line)
                    row = line is not None and not item and _TABLE_ROW.fullmatch(line)
                    if (line is None or item or row) and prose:
                        x = " ".join(" ".join(prose).split())
                        at.add(Node(kind, level, self.restore(x), min(len(x), anchors[1] + self.linked(x))))
                        prose = []
                    if item:
                        x = line[item.end() :]
                        run = run or (at if at.kind in LISTS else at.children[-1] if at.children and at.children[-1].kind == "list" else at.add(Node("list")))
                        run.add(Node("item", len(item[0]) - len(item[0].lstrip()), self.restore(x), self.linked(x)))
                    elif row:
                        x = " ; ".join(c.strip() for c in row[1].split("|"))
                        at.add(Node("row", 0, self.restore(x), self.linked(x)))
                    elif line is not None and line.strip():
                        prose.append(line)
            kind, level, anchors[1] = "p", 0, 0

        last = 0
        for m in _TAG.finditer(self.text) if "<" in self.text else ():
            name = m[2].lower()
            if name not in ELEMENTS:
                continue
            self.families.add(HTML)
            piece = self.text[last : m.start()]
            buffer.append(piece)
            if anchors[0]:
                anchors[1] += len(piece.strip())
            last = m.end()
            if name == "a":
                anchors[0] = max(0, anchors[0] + (-1 if m[1] else 1))
            elif name in CONTAINERS:
                flush()
                if not m[1] and not m[4]:
                    at = at.add(Node(name))
                elif m[1]:
                    up = at
                    while up and up.kind != name:
                        up = up.parent
                    at = up.parent if up and up.parent else at
            elif name in ("td", "th") and kind == "row":
                if not m[1]:
                    buffer.append(" ; " if "".join(buffer).strip() else " ")
            elif name in BLOCKS:
                if name == "br":
                    buffer.append("\n")
                    continue
                flush()
                if not m[1]:
                    kind, level = {"li": ("item", 0), "dt": ("item", 0), "dd": ("item", 0), "tr": ("row", 0)}.get(name, ("p", 0))
                    if re.fullmatch(r"h[1-6]", name):
                        kind, level = "heading", int(name[1])
        buffer.append(self.text[last:])
        flush()
        return root


#: Share of the best score that a sibling container needs, and share of links from which a part is mostly links.
SIBLING_SHARE, MOSTLY_LINKS = 0.2, 0.5


def _score(root: Node) -> Node:
    """Give every container its points and return the best one; of equal ones the outermost."""
    order = [root]
    for node in order:  # grows: parents before children
        order.extend(node.children)
    for node in reversed(order):
        node.size += len(node.text)
        node.linked += node.link_chars
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
        if node.kind in ("p", "item", "row") and len(node.text) >= 25:
            points, up, share = 1 + node.text.count(",") + min(len(node.text) / 100, 3), node.parent, 1.0
            while up is not None and share >= 0.25:
                up.score += points * share
                up, share = up.parent, share / 2
    best = root
    for node in order:
        node.score *= 1 - node.linked / node.size if node.size else 0
        if node.score > best.score:
            best = node
    return best


def _kept(root: Node) -> list[Node]:
    """Blocks of the best container and of what is kept beside it, in the text's order.

    Beside the best container and its ancestors stay headings, code and formulas, paragraphs less than a quarter of
    which is links, containers with a fifth of the best score, and lists and tables that are not mostly links. Inside it
    containers go that are mostly links and score less than that fifth. A text whose best container has no points is kept whole.
    """
    best = _score(root)
    dropped: set[int] = set()
    least = SIBLING_SHARE * best.score

    def density(n: Node) -> float:
        return n.linked / n.size if n.size else 0.0

    def beside(n: Node) -> bool:
        if n.kind in ("p", "item", "row"):
            return density(n) < 0.25
        if n.kind in ("heading", "code", "formula") or n.score >= least:
            return True
        return n.kind in STRUCTURE and density(n) <= MOSTLY_LINKS

    if best.score > 0:
        node = best
        while node.parent is not None:
            dropped.update(id(s) for s in node.parent.children if s is not node and not beside(s))
            node = node.parent
        inside = list(best.children)
        for n in inside:
            if n.children and density(n) > MOSTLY_LINKS and n.score < least:
                dropped.add(id(n))
            else:
                inside.extend(n.children)
    out: list[Node] = []
    todo = [root]
    while todo:
        n = todo.pop()
        if id(n) in dropped:
            continue
        if n.text:
            out.append(n)
        todo.extend(reversed(n.children))
    return out


def clean(text: str | None) -> Cleaned | None:
    """Clean text, the families of the markup found outside code, and the blocks `(kind, level, text)`.

    Kinds: heading, item, code, formula, row, p. Null gives None; empty and blank texts give an empty text.
    """
    if text is None:
        return None
    c = _Cleaner(text)
    c.code()
    if "<" in c.text:
        c.sub(_DOCTYPE, HTML, lambda m: "")
        c.sub(_COMMENT, HTML, lambda m: "", "-->")
        c.sub(_RAW, HTML, lambda m: "", "</script", "</style")
    c.formulas()
    tags: list[str] = []
    if "<" in c.text:  # set tags aside, so that their attributes are no text to the other families

        def tag(m: re.Match) -> str | None:
            if m[2].lower() not in ELEMENTS:
                return None
            tags.append(m.group(0))
            return f"\ue012{len(tags) - 1}\ue013"

        c.sub(_TAG, HTML, tag)
    if "&" in c.text:
        c.sub(_CHARREF, HTML, lambda m: c.hold("char", x) if (x := html.unescape(m.group(0))) != m.group(0) else None)
    c.latex()
    c.wiki()
    c.markdown()
    if tags:
        back = re.compile("\ue012(\\d+)\ue013")
        c.text = back.sub(lambda m: tags[int(m[1])], c.text)
        c.held = [(k, back.sub("", v)) for k, v in c.held]
    blocks = [(n.kind, n.level, n.text) for n in _kept(c.tree())]
    lines, before = [], ""
    for kind, level, x in blocks:
        shown = {"heading": f"{'#' * level} {x}", "item": f"{' ' * level}- {x}"}.get(kind, x)
        lines.append(("\n" if kind == before and kind in ("item", "row") else "\n\n" if lines else "") + shown)
        before = kind
    return Cleaned("".join(lines), sorted(c.families), blocks)


# What no family's construct can do without, as a Java pattern: texts without any are not sent to Python for detection.
SUSPECT = r"[<&*_`~\[\]{}\\$|]|''|(?m:^ {0,3}[-=>#]|^ {4}|^={2})"

_CLEANED = "clean string, families array<string>, blocks array<struct<kind:string,level:int,text:string>>"
_FAMILIES = "tbl string, row_id long, families array<string>"

#: Short texts, such as terms, come again and again: so many results are kept for texts of at most so many characters.
REMEMBERED, SHORT = 50_000, 64
_remembered = lru_cache(REMEMBERED)(clean)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every column but `text`, then what `clean` makes of it; equal texts of a part are cleaned once."""
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts = part.column("text").dictionary_encode()
            made = [_remembered(t) if len(t) <= SHORT else clean(t) for t in texts.dictionary.to_pylist()]
            results = [
                pa.array([m.text for m in made], pa.string()),
                pa.array([m.families for m in made], pa.list_(pa.string())),
                pa.array([[{"kind": k, "level": n, "text": x} for k, n, x in m.blocks] for m in made], kinds),
            ]
            kept = [n for n in batch.schema.names if n != "text"]
            columns = [*(part.column(n) for n in kept), *(r.take(texts.indices) for r in results)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "clean", "families", "blocks"])


def _run_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for full in _run(batches):
        yield full.select(["tbl", "row_id", "families"])


def document_records(documents: DataFrame) -> DataFrame:
    return documents.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), "text")


def note_records(notes: DataFrame) -> DataFrame:
    """Headings and terms of notes, distinct within the note; nulls are left out."""
    none = F.array().cast("array<string>")
    parts = F.array_distinct(F.concat(F.coalesce("headings", none), F.coalesce(F.col("terms.term"), none)))
    rows = notes.select(F.lit("notes").alias("tbl"), F.col("note_id").alias("row_id"), F.explode(parts).alias("text"))
    return rows.where(F.col("text").isNotNull())


def field_records(notes: DataFrame) -> DataFrame:
    """`(tbl, row_id, field, pos, text)`: every heading and term of every note, nulls and repeats too; field is heading or term, pos counts from 0."""
    rows = spread(notes.select("note_id", "headings", F.col("terms.term").alias("terms")))
    one = lambda field, c: rows.select(
        F.lit("notes").alias("tbl"), F.col("note_id").alias("row_id"), F.lit(field).alias("field"), F.posexplode(c).alias("pos", "text")
    )
    return one("heading", "headings").unionByName(one("term", "terms"))


def clean_records(records: DataFrame) -> DataFrame:
    """Every column of `records` but `text`, and `(clean, families, blocks)` of the text; null texts give nulls."""
    kept = StructType([f for f in records.schema if f.name != "text"])
    return spread(records).mapInArrow(_run, StructType([*kept, *StructType.fromDDL(_CLEANED)]))


def clean_documents(documents: DataFrame) -> DataFrame:
    """`(tbl, row_id, clean, families, blocks)`: `clean_records` of documents.text, one row per row of documents."""
    return clean_records(document_records(documents))


def clean_texts(documents: DataFrame, notes: DataFrame) -> DataFrame:
    """`(tbl, row_id, field, pos, clean, families, blocks)`: one row per row of documents and per heading and term of notes.

    field is text, heading or term; pos is the place in the note's list, from 0, and 0 for documents. Null texts,
    headings and terms give null results at their place; null and empty lists have no places.
    """
    docs = spread(document_records(documents)).select("tbl", "row_id", F.lit("text").alias("field"), F.lit(0).alias("pos"), "text")
    return clean_records(docs.unionByName(field_records(notes)))


def markup_found(documents: DataFrame, notes: DataFrame) -> DataFrame:
    """`(tbl, row_id, markup)`, distinct: records with a construct of a family outside code.

    Texts without any character that a construct needs are decided in the JVM.
    """
    records = document_records(documents).unionByName(note_records(notes)).where(F.col("text").rlike(SUSPECT))
    found = spread(records).mapInArrow(_run_families, _FAMILIES)
    return found.select("tbl", "row_id", F.explode("families").alias("markup")).distinct()
