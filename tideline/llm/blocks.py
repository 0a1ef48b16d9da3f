"""Pages as sequences of leaf blocks: a small tokenizer of HTML, and the vectors of a block.

A block is a stretch of text between the starts and ends of block-level
elements; inline elements and line breaks lie within it.  Scripts, styles,
graphics, comments and other markup are no text.  A block's path is its open
block-level elements, each with its class, id and role words; open elements are
nodes that know their parent, so a page's paths take memory in proportion to its
elements, however deep they nest.

As in the HTML standard a tag ends at the first ``>`` outside a quoted attribute
value, a quote counts only after ``=``, a tag that never ends takes the rest of
the page, and ``/>`` closes no script.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Element names of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside audio blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video".split()
)
#: Their content is no markup, up to their end tag; what of it is text lies in the second set.
RAW_TAGS = frozenset("script style iframe noembed noframes title textarea".split())
RAW_TEXT = frozenset("title textarea".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements, where one of them is innermost among its peers.
ENDS = {
    **{t: {"p", "head"} for t in BLOCK_TAGS - {"button", "option", "optgroup", "legend", "caption", "td", "th", "tr", "title", "noscript", "template", "object", "audio", "video", "canvas"}},
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head", "title"},
}
SCOPES = frozenset("ul ol dl table article section div main aside nav body html".split())

_MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![A-Za-z]|\Z)[^>]*+(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)|["'])*+)(>?)""",
    re.S,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"\w+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in (*RAW_TAGS, "svg")}

TAG_DIM = 160
WORD_DIM = 24
DIM = TAG_DIM + WORD_DIM + 8
#: What an outer element weighs in a path vector, against the one within it.
OUTER = 0.9


class Element:
    """An open block-level element: its tag, label and parent, and the sum of its path's hashed words."""

    __slots__ = ("depth", "label", "parent", "summed", "tag")

    def __init__(self, tag: str, label: str, parent: Element | None):
        self.tag, self.label, self.parent = tag, label, parent
        self.depth = parent.depth + 1 if parent else 1
        own = _label_vector(label)
        self.summed = (own + np.float32(OUTER) * parent.summed).astype(np.float16) if parent else own.astype(np.float16)


@dataclass
class Block:
    within: Element | None
    text: str
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        out, at = [], self.within
        while at is not None:
            out.append(at.label)
            at = at.parent
        return tuple(reversed(out))


def _label(tag: str, attributes: str) -> str:
    """An element's path entry: its name, then ``.word`` for each word of its class, id and role, in the singular."""
    if not attributes or attributes.isspace():
        return tag
    words = []
    for name, a, b, c in _NAMED.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name in ("hidden", "aria-hidden") and value != "false" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            words.append("!hidden")
        elif name in ("class", "role", "id"):
            words += ["." + (w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w) for w in re.split(r"[\s_-]+", value) if w]
    return tag + "".join(words)


_known_label = lru_cache(maxsize=20_000)(_label)


def parse(page: str | None) -> list[Block]:
    """The non-empty blocks of a page in order."""
    page = page or ""
    out: list[Block] = []
    stack: list[Element] = []
    open_tags: Counter[str] = Counter()
    held: list[str] = []
    linked, in_link, at, endless_svg = 0, 0, 0, False

    def close_block():
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(stack[-1] if stack else None, text, min(linked, len(text))))
        held.clear()
        linked = 0

    def add(text: str):
        held.append(html.unescape(text) if "&" in text else text)

    def pop_to(i: int):
        for e in stack[i:]:
            open_tags[e.tag] -= 1
        del stack[i:]

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:
            # A tag that never ends.
            break
        tag = m[2].lower()
        if tag == "svg" and not m[1]:
            if not m[3].endswith("/") and not endless_svg:
                end = _RAW_ENDS["svg"].search(page, at)
                endless_svg = end is None
                at = end.start() if end else at
            continue
        if tag == "a":
            in_link = 0 if m[1] else 1
        elif tag == "br":
            held.append(" ")
        elif tag in BLOCK_TAGS:
            close_block()
            if m[1]:
                if open_tags[tag]:
                    pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            else:
                ends = ENDS.get(tag, frozenset())
                if any(open_tags[t] for t in ends):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i].tag in ends:
                            pop_to(i)
                        elif stack[i].tag in SCOPES:
                            break
                if tag not in VOID_TAGS:
                    stack.append(Element(tag, (_known_label if len(m[3]) < 200 else _label)(tag, m[3]), stack[-1] if stack else None))
                    open_tags[tag] += 1
        if tag in RAW_TAGS and not m[1]:
            end = _RAW_ENDS[tag].search(page, at)
            stop = end.start() if end else len(page)
            if tag in RAW_TEXT:
                add(page[at:stop])
            at = stop
    close_block()
    return out


def _signed(word: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8"))
    return h % dim, 1.0 if h & 0x80000000 else -1.0


@lru_cache(maxsize=20_000)
def _label_vector(label: str) -> np.ndarray:
    """An element's name, class, id and role words, hashed."""
    v = np.zeros(TAG_DIM, np.float32)
    tag, *words = re.split(r"(?=[.!])", label)
    for k, w in enumerate([tag, *dict.fromkeys(words)]):
        i, s = _signed(w if k else f"<{tag}>", TAG_DIM)
        v[i] += s
    return v


def _path_vector(within: Element | None) -> np.ndarray:
    """The path's words, inner elements weighing more, of bounded length."""
    if within is None:
        return np.zeros(TAG_DIM, np.float32)
    v = within.summed.astype(np.float32)
    return v / max(1.0, math.sqrt(float(v @ v)) / 2)


_PLACES: dict[str, int] = {}


def _word_place(word: str) -> int:
    """A word's column, beyond ``WORD_DIM`` where it counts negatively."""
    if len(_PLACES) >= 200_000:
        _PLACES.clear()
    i, s = _signed("w:" + word, WORD_DIM)
    _PLACES[word] = i = i if s > 0 else i + WORD_DIM
    return i


def vector(block: Block) -> np.ndarray:
    """Path vector, hashed-word vector and a few counts."""
    words = _WORDS.findall(block.text.lower())
    known = _PLACES.get
    places = np.bincount([i if (i := known(w)) is not None else _word_place(w) for w in words], minlength=2 * WORD_DIM) if words else np.zeros(2 * WORD_DIM)
    hashed = ((places[:WORD_DIM] - places[WORD_DIM:]) / max(1, len(words))).astype(np.float32)
    n = len(block.text)
    ends = block.text[-1] in ".!?:…\"”'"
    counts = np.array([
        math.log1p(n) / 6, math.log1p(len(words)) / 5, block.linked / n, sum(block.text.count(c) for c in ".,;:") / n * 8, float(ends), float(n < 40), min(3.0, (block.within.depth if block.within else 0) / 8), 1.0,
    ], np.float32)
    return np.concatenate([_path_vector(block.within), hashed * 2, counts])
