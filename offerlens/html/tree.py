"""HTML parsed into arrays in document order: a subtree is a range, an ancestor test two comparisons."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

# Fixed values of the HTML standard: void elements, raw text, what an opening tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style")
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.end = ["#root"], [{}], [-1], [0]
        self.texts: list[tuple[int, int, str]] = []  # (element, elements before, text)
        self.open = [0]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and any(self.tag[i] == "p" for i in self.open):
            self._close("p", set())
        if tag in CLOSES:
            own, stop = CLOSES[tag]
            for i in range(len(self.open) - 1, 0, -1):
                if self.tag[self.open[i]] in stop:
                    break
                if self.tag[self.open[i]] in own:
                    self._cut(i)
                    break
        self.tag.append(tag)
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        self.attrs.append(found)
        self.parent.append(self.open[-1])
        self.end.append(0)
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)
        else:
            self.end[-1] = len(self.tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a closing slash means nothing on an HTML element

    def handle_endtag(self, tag):
        self._close(tag, {"table"} if tag not in ("table", "body", "html", "div") else set())

    def _close(self, tag, stop):
        for i in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[i]] == tag:
                self._cut(i)
                return
            if self.tag[self.open[i]] in stop:
                return

    def _cut(self, i):
        for k in self.open[i:]:
            self.end[k] = len(self.tag)
        del self.open[i:]

    def handle_data(self, data):
        self.texts.append((self.open[-1], len(self.tag), data))


@dataclass
class Tree:
    tag: list[str]
    attrs: list[dict[str, str]]
    parent: list[int]
    end: list[int]  # one past the subtree
    texts: list[tuple[int, int, str]]

    def text(self, i: int) -> str:
        """All text below an element."""
        lo, hi = self._span[i]
        return "".join(t for _, _, t in self.texts[lo:hi])

    def own_text(self, i: int) -> str:
        return clean("".join(self.texts[k][2] for k in self._own.get(i, ())))

    def __post_init__(self):
        self._own: dict[int, list[int]] = {}
        first = [len(self.texts)] * (len(self.tag) + 1)
        last = [0] * len(self.tag)
        for k, (e, _, _) in enumerate(self.texts):
            self._own.setdefault(e, []).append(k)
            while e >= 0:
                first[e] = min(first[e], k)
                last[e] = max(last[e], k + 1)
                e = self.parent[e]
        self._span = [(f, x) if f < x else (0, 0) for f, x in zip(first, last, strict=False)]

    def ancestors(self, i: int):
        i = self.parent[i]
        while i > 0:
            yield i
            i = self.parent[i]

    def all(self, selector: str, within: int = 0):
        """Elements below `within` that match, in document order."""
        test = compiled(selector)
        return [i for i in range(within + 1, self.end[within]) if test(self, i)]

    def first(self, selector: str, within: int = 0) -> int | None:
        test = compiled(selector)
        return next((i for i in range(within + 1, self.end[within]) if test(self, i)), None)

    def matches(self, i: int, selector: str) -> bool:
        return compiled(selector)(self, i)

    def get(self, i: int | None, name: str) -> str | None:
        return None if i is None else self.attrs[i].get(name)


def parse(html: str) -> Tree:
    b = _Builder()
    b.feed(html or "")
    b.close()
    b._cut(1) if len(b.open) > 1 else None
    b.end[0] = len(b.tag)
    return Tree(b.tag, b.attrs, b.parent, b.end, b.texts)


def clean(s: str) -> str:
    return re.sub(r"[\s﻿]+", " ", s).strip()


_SIMPLE = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|:not\(\[(?P<no>[\w-]+)\]\)|\[(?P<attr>[\w:-]+)(?:(?P<op>\*?=)["']?(?P<val>[^"'\]]*)["']?(?P<ci>\s+i)?)?\]""")


def _compound(part: str):
    tests = []
    at = 0
    while at < len(part):
        m = _SIMPLE.match(part, at) if at else _SIMPLE.match(part)
        if not m or m.end() == at:
            raise ValueError(f"selector not understood: {part!r}")
        if m["tag"]:
            if m["tag"] != "*":
                tests.append(lambda t, i, v=m["tag"].lower(): t.tag[i] == v)
        elif m["cls"]:
            tests.append(lambda t, i, v=m["cls"]: v in t.attrs[i].get("class", "").split())
        elif m["id"]:
            tests.append(lambda t, i, v=m["id"]: t.attrs[i].get("id") == v)
        elif m["no"]:
            tests.append(lambda t, i, v=m["no"]: v not in t.attrs[i])
        elif m["op"] is None:
            tests.append(lambda t, i, v=m["attr"].lower(): v in t.attrs[i])
        else:
            name, value, fold, part_of = m["attr"].lower(), m["val"], bool(m["ci"]), m["op"] == "*="

            def test(t, i, name=name, value=value.lower() if fold else value, fold=fold, part_of=part_of):
                have = t.attrs[i].get(name)
                if have is None:
                    return False
                have = have.lower() if fold else have
                return (bool(value) and value in have) if part_of else have == value

            tests.append(test)
        at = m.end()
    return lambda t, i: t.tag[i] != "#root" and all(f(t, i) for f in tests)


def _split(s: str, on: str) -> list[str]:
    """Split outside brackets and quotes."""
    out, depth, now = [], 0, ""
    for c in s:
        depth += (c in "[(") - (c in "])")
        if c == on and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [x.strip() for x in [*out, now] if x.strip()]


@lru_cache(maxsize=512)
def compiled(selector: str):
    """A test (tree, element) for a comma list of descendant chains."""
    chains = [[_compound(p) for p in _split(chain, " ")] for chain in _split(selector, ",")]

    def match(t, i):
        for chain in chains:
            if chain[-1](t, i):
                rest = len(chain) - 2
                up = t.parent[i]
                while rest >= 0 and up > 0:
                    if chain[rest](t, up):
                        rest -= 1
                    up = t.parent[up]
                if rest < 0:
                    return True
        return False

    return match
