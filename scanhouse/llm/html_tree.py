"""HTML to a tree of elements and texts, with the features that the extraction model reads.

Lenient like a browser, in one pass over the source: raw text elements, implied end tags, unclosed
and stray tags. Texts inside elements that never show article text (scripts, styles, form
controls) make no node.
"""

from __future__ import annotations

import html
import re
import zlib
from math import log2

# Element names by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = frozenset("head script style textarea title iframe noembed noframes noscript template svg math select option button datalist object audio video canvas".split())
BLOCK = frozenset(
    "html body address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body caption dd dt li legend summary tbody td tfoot th thead tr".split())
#: What a start tag closes, and the elements that it doesn't look beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
FENCES = frozenset("td th caption table".split())
TABLE_ENDS = frozenset("td th caption table tr tbody thead tfoot".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+|[0-9]+")

#: Names of features are hashed to so many weights.
DIM = 1 << 16
ELEMENT, INLINE, TEXT = range(3)
MEMO = 20_000


def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % DIM


def name_features(kind: str, value: str) -> list[int]:
    """Features of a class, id or role: its parts and their groups of four letters."""
    out = set()
    for part in NAME_PART.findall(value):
        part = part.lower()
        if part.isdigit() or len(part) < 2:
            continue
        out.add(feature(f"name {part}"))
        padded = f"^{part}$"
        out.update(feature(f"gram {padded[i : i + 4]}") for i in range(len(padded) - 3))
    return sorted(out)


def bucket(n: float) -> int:
    return int(log2(n + 1))


class Page:
    """Nodes in page order: ``parent`` (-1: none), ``kind``, ``features`` and, of texts, ``text`` and
    the number of the ``block`` that they stand in. ``marks``: value of the label attribute, if any."""

    def __init__(self, source: str, memo: dict | None = None):
        self.parent: list[int] = []
        self.kind: list[int] = []
        self.tags: list[str] = []
        self.own: list[list[int]] = []
        self.text: list[str | None] = []
        self.block: list[int] = []
        self.marks: list[str | None] = []
        self.depth: list[int] = []
        self._memo = {} if memo is None else memo
        self._stack: list[int] = []
        self._open: dict[str, int] = {}
        self._silent = 0
        self._blocks = 0
        self._links = 0
        self._linked: list[bool] = []
        self._read(source)
        self.features = self._all_features()

    # --- reading

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self._words(s[at:lt])
            if lt == n:
                return
            m = TAG.match(s, lt)
            if m:
                at = m.end()
                name = m[2].lower()
                if m[1]:
                    self._end(name)
                    continue
                self._start(name, m[3])
                if name in RAW:
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(s, at)
                    at = end.end() if end else n
                    self._end(name)
            elif s.startswith("<!--", lt):
                end = s.find("-->", lt + 2)
                at = end + 3 if end >= 0 else n
            elif s[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = s.find(">", lt)
                at = end + 1 if end >= 0 else n
            elif s[lt + 1 : lt + 2].isalpha() and s[lt + 1 : lt + 2].isascii():
                return  # a tag that the source ends in
            else:
                self._words("<")
                at = lt + 1

    def _node(self, kind: int, tag: str, own: list[int], text: str | None, mark: str | None) -> None:
        up = self._stack[-1] if self._stack else -1
        self.parent.append(up)
        self.kind.append(kind)
        self.tags.append(tag)
        self.own.append(own)
        self.text.append(text)
        self.block.append(self._blocks)
        self.marks.append(mark)
        self.depth.append(self.depth[up] + 1 if up >= 0 else 0)
        self._linked.append(self._links > 0)

    def _words(self, raw: str) -> None:
        if self._silent:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self._node(TEXT, "#", [], text, None)

    def _start(self, name: str, rest: str) -> None:
        if name in CLOSES_P and self._open.get("p"):
            self._pop({"p"}, FENCES)
        if name in IMPLIED:
            closes, fences = IMPLIED[name]
            if any(self._open.get(c) for c in closes):
                self._pop(closes, fences)
        if name in ("html", "body") and self._open.get(name):
            return
        if name == "body" and self._open.get("head"):
            self._pop({"head"}, frozenset())
        if name in BLOCK:
            self._blocks += 1
        if name in VOID:
            if name == "br" and not self._silent:
                self._node(TEXT, "#", [], " ", None)
            return
        own, mark = self._attributes(name, rest)
        self._node(ELEMENT if name in BLOCK else INLINE, name, own, None, mark)
        self._stack.append(len(self.parent) - 1)
        self._open[name] = self._open.get(name, 0) + 1
        self._silent += name in SILENT
        self._links += name == "a"

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._blocks += 1
        if self._open.get(name):
            fences = frozenset() if name in TABLE_ENDS or name in ("html", "body") else FENCES if name in BLOCK else BLOCK
            self._pop({name}, fences)

    def _pop(self, names: set | frozenset, fences: set | frozenset) -> None:
        """Close the innermost open element of these names and all in it, unless a fence lies between."""
        for k in range(len(self._stack) - 1, -1, -1):
            tag = self.tags[self._stack[k]]
            if tag in names:
                break
            if tag in fences:
                return
        else:
            return
        for node in self._stack[k:]:
            tag = self.tags[node]
            self._open[tag] -= 1
            self._silent -= tag in SILENT
            self._links -= tag == "a"
        del self._stack[k:]

    def _attributes(self, name: str, rest: str) -> tuple[list[int], str | None]:
        key = (name, rest)
        if key in self._memo:
            return self._memo[key]
        own, mark = [feature(f"tag {name}")], None
        for a in ATTRIBUTE.finditer(rest):
            attr, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if attr == "data-main":
                mark = value
            elif attr in ("class", "id", "role", "itemprop", "aria-label"):
                own += name_features(attr, html.unescape(value))
            elif attr == "hidden" or attr == "aria-hidden" and value == "true" or attr == "style" and re.search(r"display\s*:\s*none", value):
                own.append(feature("hidden"))
        own = sorted(set(own))
        if len(self._memo) < MEMO and len(rest) < 512:
            self._memo[key] = own, mark
        return own, mark

    # --- features

    def _all_features(self) -> list[list[int]]:
        n = len(self.parent)
        size = [len(t.strip()) if t else 0 for t in self.text]
        linked = [z if lk else 0 for z, lk in zip(size, self._linked, strict=True)]
        paragraphs = [int(t == "p") for t in self.tags]
        for i in range(n - 1, -1, -1):
            up = self.parent[i]
            if up >= 0:
                size[up] += size[i]
                linked[up] += linked[i]
                paragraphs[up] += paragraphs[i]
        out = []
        for i in range(n):
            up = self.parent[i]
            kind = self.kind[i]
            if kind == TEXT:
                t = self.text[i].strip()
                ends = t[-1] if t else " "
                own = [
                    feature(f"text size {bucket(size[i])}"),
                    feature(f"text in {self.tags[up] if up >= 0 else ''}"),
                    feature(f"text link {self._linked[i]}"),
                    feature(f"text end {ends if ends in '.!?:,;' else 'other'}"),
                ]
            else:
                density = int(4 * linked[i] / size[i]) if size[i] else 5
                own = [
                    *self.own[i],
                    feature(f"size {kind} {bucket(size[i])}"),
                    feature(f"density {kind} {density}"),
                    feature(f"paragraphs {kind} {min(bucket(paragraphs[i]), 5)} {density}"),
                    feature(f"under {self.tags[up] if up >= 0 else ''}"),
                ]
            out.append(own)
        return out

    def labels(self) -> list[int]:
        """1 for nodes whose nearest marked ancestor, or they themselves, are marked "1"."""
        out: list[int] = []
        for i, mark in enumerate(self.marks):
            up = self.parent[i]
            out.append(int(mark == "1") if mark is not None else out[up] if up >= 0 else 0)
        return out

    def join(self, keep) -> str:
        """Kept texts: white space in a block becomes one space, blocks are joined by line feeds."""
        lines, now, parts = [], None, []
        for text, block, kept in zip(self.text, self.block, keep, strict=True):
            if text is None or not kept:
                continue
            if block != now:
                lines.append("".join(parts))
                now, parts = block, []
            parts.append(text)
        lines.append("".join(parts))
        return "\n".join(t for line in lines if (t := " ".join(line.split())))
