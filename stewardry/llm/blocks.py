"""A page as the sequence of its text blocks, each with its tag path: one linear pass over the markup."""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np

#: Cells of the hashed tag path, of the innermost element, and of the words.
PATH, OWN, WORDS = 128, 64, 64
NUMBERS = 7
WIDTH = PATH + OWN + WORDS + NUMBERS

#: Elements that begin and end a block; those without an end; those whose content is no text of the page.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style template noscript iframe noembed noframes textarea title xmp object svg".split())
#: What the start of an element (first) ends, if it stands on top.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
    "tbody": {"td", "th", "tr", "thead", "tbody"}, "thead": {"td", "th", "tr", "tbody"}, "tfoot": {"td", "th", "tr", "thead", "tbody"}, **{f"h{k}": {f"h{j}" for j in range(1, 7)} for k in range(1, 7)},
}

# possessive throughout: a tag without an end takes the rest of the page, as in browsers, and nothing is read twice
_tag = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+)(?:>|\Z)""")
_names = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)|'([^']*+)|([^\s>"']++))""", re.I)
_comment_end = re.compile(r"--!?>")
_silent_end = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in SILENT}
_ends, _digits = re.compile(r"[.,;:!?](?= |\Z)"), re.compile(r"(?<![^ ])[0-9]")
_part = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Page:
    """The blocks' texts, a row of cells for each, and their marks."""

    texts: list[str]
    cells: np.ndarray = field(repr=False)
    marks: list[str] = field(default_factory=list)


@lru_cache(1 << 14)
def _cells(token: str, size: int) -> tuple[int, int]:
    h = crc32(token.encode("utf-8", "replace"))
    return h % size, (h >> 16) % size


@lru_cache(1 << 14)
def _tokens(name: str, attributes: str) -> tuple[str, ...]:
    out = [name]
    for m in _names.finditer(attributes):
        out += ["." + p for p in _part.findall((m[1] or m[2] or m[3] or "").lower())]
    return tuple(dict.fromkeys(out))


class _Reader:
    def __init__(self, marks: str) -> None:
        self.marks = marks
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.counts: dict[str, int] = {}
        self.path = np.zeros(PATH, np.float32)
        self.parts: list[str] = []
        self.linked = self.chars = 0
        self.in_link = False
        self.texts: list[str] = []
        self.met_marks: list[str] = []
        self.paths: list[np.ndarray] = []
        self.own: list[tuple[int, int]] = []
        self.shares: list[tuple[float, int]] = []

    def push(self, name: str, tokens: tuple[str, ...]) -> None:
        self.open.append((name, tokens))
        self.counts[name] = self.counts.get(name, 0) + 1
        for t in tokens:
            for c in _cells(t, PATH):
                self.path[c] += 1

    def pop(self) -> None:
        name, tokens = self.open.pop()
        self.counts[name] -= 1
        for t in tokens:
            for c in _cells(t, PATH):
                self.path[c] -= 1

    def text(self, raw: str) -> None:
        if raw:
            said = markup.unescape(raw)
            self.parts.append(said)
            self.chars += len(said)
            self.linked += len(said) if self.in_link else 0

    def flush(self) -> None:
        """Ends the block, if it has any text."""
        if self.parts:
            said, mark = "".join(self.parts), ""
            if self.marks:
                mark = next((c for c in said if c in self.marks), "")
                said = said.translate({ord(c): None for c in self.marks})
            said = " ".join(said.split())
            if said:
                own = self.open[-1][1] if self.open else ()
                self.own += [(len(self.texts), c) for t in own for c in _cells(t, OWN)]
                self.paths.append(self.path.copy())
                self.shares.append((self.linked / max(1, self.chars), len(self.open)))
                self.texts.append(said)
                self.met_marks.append(mark)
            self.parts = []
        self.linked = self.chars = 0

    def page(self) -> Page:
        """All blocks, described at once."""
        n = len(self.texts)
        v = np.zeros((n, WIDTH), np.float32)
        if not n:
            return Page([], v)
        np.log1p(np.array(self.paths), out=v[:, :PATH])
        if self.own:
            row, cell = np.array(self.own).T
            v[row, PATH + cell] = 1
        words = [t.lower().encode("utf-8", "replace").split(b" ") for t in self.texts]
        counts = np.array([len(w) for w in words])
        hashes = np.fromiter(map(crc32, chain.from_iterable(words)), np.uint32, counts.sum()) % WORDS
        met = np.bincount(np.repeat(np.arange(n) * WORDS, counts) + hashes, minlength=n * WORDS).reshape(n, WORDS)
        v[:, PATH + OWN : PATH + OWN + WORDS] = met / np.sqrt((met * met).sum(1, keepdims=True))
        share, depth = np.array(self.shares).T
        sizes = np.array([len(t) for t in self.texts])
        ends, digits = (np.array([len(x.findall(t)) for t in self.texts]) for x in (_ends, _digits))
        told = np.log1p(sizes) / 5, np.log1p(counts) / 4, share, ends / counts, digits / counts, np.array([t[-1] in ".!?" for t in self.texts]), np.log1p(depth) / 3
        v[:, -NUMBERS:] = np.array(told).T
        return Page(self.texts, v, self.met_marks)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
        elif name == "a":
            self.in_link = True
        elif name in BLOCK:
            self.flush()
            while self.open and (self.open[-1][0] == "p" or self.open[-1][0] in ENDS.get(name, ())):
                self.pop()
            if name != "hr":
                self.push(name, _tokens(name, attributes))

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        elif name in BLOCK:
            self.flush()
            if self.counts.get(name):
                while self.open[-1][0] != name:
                    self.pop()
                self.pop()


def blocks(page: str, marks: str = "") -> Page:
    """Blocks of text in page order: what stands between two starts or ends of block elements, references decoded, white space one space.

    marks: characters that are taken out of the text; the first one of a block is its mark.
    """
    reader, at = _Reader(marks), 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            reader.text(page[at:])
            break
        nxt = page[lt + 1 : lt + 3]
        if nxt[:1].isascii() and nxt[:1].isalpha() or nxt[:1] == "/" and nxt[1:].isascii() and nxt[1:].isalpha():
            reader.text(page[at:lt])
            m = _tag.match(page, lt)
            name, at = m[2].lower(), m.end()
            if m[1]:
                reader.end(name)
            elif name in SILENT:
                ended = _silent_end[name].search(page, at)
                if not ended:
                    break
                close = page.find(">", ended.end())
                at = len(page) if close < 0 else close + 1
            else:
                reader.start(name, m[3])
        elif nxt[:1] in ("!", "?", "/") and nxt:
            reader.text(page[at:lt])
            ended = _comment_end.search(page, lt + 2) if page.startswith("<!--", lt) else None
            close = ended.end() if ended else -1 if page.startswith("<!--", lt) else page.find(">", lt) + 1 or -1
            if close < 0:
                break
            at = close
        else:
            reader.text(page[at : lt + 1])
            at = lt + 1
    reader.flush()
    return reader.page()
