"""Main text of web pages by a linear-chain conditional random field over leaf blocks (operator 9)."""

from __future__ import annotations

import functools
import html as html_lib
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframes.llm.labelled_pages import pages
from textframes.llm.shared import blocks

#: Elements that begin and end a block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN_TAGS = frozenset("script style title textarea noscript template iframe svg math object canvas audio video".split())
#: An opening element ends an open one of the same kind, up to the container.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: A comment, a declaration, or a tag with its quoted values. Where a quote is never closed, a tag ends at the next `>`;
#: what is cut off by the end of the page is markup, too.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
#: The same for the rest of a page in which a quote was left open: a value holds `<` or `>` but not both.
LOOSE_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"<]*+"|"[^">]*+"|'[^'<]*+'|'[^'>]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class Node:
    """An open element that counts for features: its names, the nodes above it, and the slots that it adds to theirs."""

    __slots__ = ("name", "up", "slots", "depth")

    def __init__(self, name: str, up: Node | None, slots: tuple[int, ...]) -> None:
        self.name, self.up, self.slots = name, up, slots
        self.depth = up.depth + 1 if up else 1

    def chain(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.up


@dataclass
class Block:
    """A leaf block: its text, the innermost element around it, and the characters in links."""

    node: Node | None
    text: str
    linked: int
    label: int = -1


class Stack:
    """Open elements with what lookups need, so that a tag costs the same at any depth."""

    def __init__(self) -> None:
        self.open: list[tuple[str, Node | None, tuple[int, ...]]] = []  # tag, innermost node, slots it added
        self.places: dict[str, list[int]] = {}  # of the open elements of each tag
        self.blocks: list[int] = []  # places of those that begin a block
        self.seen: set[int] = set()  # slots of all open elements

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def push(self, tag: str, name: str) -> None:
        node = self.open[-1][1] if self.open else None
        new: tuple[int, ...] = ()
        if tag in BLOCK_TAGS or name != tag:
            new = tuple(s for s in name_slots(name) if s not in self.seen)
            self.seen.update(new)
            node = Node(name, node, new)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.open))
        self.open.append((tag, node, new))

    def close(self, k: int) -> None:
        """Closes the element at place k and all inside it."""
        while len(self.open) > k:
            tag, _, new = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()
            self.seen.difference_update(new)

    def end(self, tag: str) -> bool:
        """Takes an end tag; whether a block ends. An inline element can't be closed from inside a block in it."""
        k = self.last(tag)
        if tag in BLOCK_TAGS or k >= 0 and not (self.blocks and self.blocks[-1] > k):
            if k >= 0:
                self.close(k)
        return tag in BLOCK_TAGS

    def begin_block(self, tag: str) -> None:
        """What a new block closes: an open paragraph, and its like up to their container."""
        if (k := self.last("p")) >= 0:
            self.close(k)
        if tag in SIBLINGS:
            ends, within = SIBLINGS[tag]
            k = max(map(self.last, ends))
            if k > max(map(self.last, within)):
                self.close(k)


def leaf_blocks(html: str, marked: bool = False) -> list[Block]:
    """Blocks in page order. Open elements needn't be closed; markup never fails to parse.

    marked: NUL and a digit in the text give the label of what follows.
    """
    out: list[Block] = []
    stack, pieces = Stack(), []
    linked, label, at = 0, -1, 0
    node: Node | None = None
    found, pattern = False, TAG

    def flush() -> None:
        nonlocal linked, node, found
        text = " ".join(html_lib.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            out.append(Block(node, text, min(linked, len(text)), label))
        pieces.clear()
        linked, node, found = 0, None, False

    def take(text: str) -> None:
        nonlocal linked, node, found, label
        while marked and (k := text.find("\x00")) >= 0:
            take(text[:k])
            flush()
            label, text = int(text[k + 1]), text[k + 2 :]
        if text:
            if not found and not text.isspace():
                node, found = (stack.open[-1][1] if stack.open else None), True
            pieces.append(text)
            if stack.places.get("a"):
                linked += len(text)

    while (m := pattern.search(html, at)) is not None:
        take(html[at : m.start()])
        at = m.end()
        if m[5] and ('"' in m[6] or "'" in m[6]):
            pattern = LOOSE_TAG
        tag, attributes = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK_TAGS:
                flush()
            stack.end(tag)
            continue
        if tag in HIDDEN_TAGS:
            if not attributes.rstrip().endswith("/"):
                end = closing(tag).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "br":
            take(" ")
        if tag in BLOCK_TAGS:
            flush()
            stack.begin_block(tag)
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        stack.push(tag, _named(tag, attributes))
    take(html[at:])
    flush()
    return out


@functools.lru_cache(maxsize=64)
def closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>?", re.I)


def _named(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    words = [w.lower() for m in NAMES.finditer(attributes) for w in NAME.findall(m[1] or m[2] or m[3] or "")]
    return " ".join([tag, *words])


SLOTS = 1 << 14


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SLOTS


@functools.lru_cache(maxsize=20_000)
def name_slots(name: str) -> tuple[int, ...]:
    """Slots of an element that stands anywhere above a block."""
    tag, *words = name.split(" ")
    names = {f"above {tag}", *(f"named {w}" for w in words), *(f"joined {a}{b}" for a, b in zip(words, words[1:], strict=False))}
    return tuple(sorted({_slot(n) for n in names}))


@functools.lru_cache(maxsize=20_000)
def near_slots(near: tuple[str, ...], depth: int) -> tuple[int, ...]:
    """Slots of the innermost elements (the innermost first) and of the depth."""
    names = {"bias", f"depth {min(depth, 3)}"}
    for name in near[:1]:
        names.add(f"own {name.split(' ')[0]}")
    for k, name in enumerate(near):
        names.update(f"near{k} {w}" for w in name.split(" "))
    return tuple(sorted({_slot(n) for n in names}))


@dataclass
class Features:
    """Slots of a block: of its text and the innermost elements, and those that the elements above it share."""

    own: tuple[int, ...]
    node: Node | None

    def __iter__(self) -> Iterator[int]:
        return iter(sorted({*self.own, *(s for n in self.node.chain() for s in n.slots)} if self.node else self.own))


def features(block: Block) -> Features:
    """A block's features: of the elements above it, and of its text."""
    text = block.text
    n = text.count(" ") + 1
    names = [f"words {min(n, 64).bit_length()}", f"links {4 * block.linked // max(1, len(text))}", f"end {text[-1] if text[-1] in '.?!:,' else ''}"]
    if "©" in text or "|" in text and n < 30:
        names.append("mark")
    if n > 12 and text.count(",") * 20 > n:
        names.append("commas")
    near = tuple(x.name for x in itertools.islice(block.node.chain(), 3)) if block.node else ()
    return Features((*near_slots(near, block.node.depth if block.node else 0), *map(_slot, names)), block.node)


@dataclass
class ChainField:
    """Labels 0 and 1 along a page: a weight for each feature of label 1, and for each transition."""

    weight: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def scores(self, rows: list[Features] | list[list[int]]) -> np.ndarray:
        """A weight counts once for each slot; what elements share is summed once for each element."""
        weight, above = self.weight.tolist() if len(rows) > 200 else self.weight, {None: 0.0}
        out = []
        for r in rows:
            if not isinstance(r, Features):
                out.append(sum([weight[s] for s in r]))
                continue
            chain, node = [], r.node
            while node not in above:
                chain.append(node)
                node = node.up
            for x in reversed(chain):
                above[x] = above[x.up] + sum([weight[s] for s in x.slots])
            out.append(above[r.node] + sum([weight[s] for s in {*r.own}]))
        return np.array(out)

    def decode(self, rows: list[Features]) -> list[int]:
        """The likeliest labels of all blocks together (Viterbi)."""
        if not rows:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        emit = self.scores(rows).tolist()
        a, b, back = self.start[0], self.start[1] + emit[0], []
        for e in emit[1:]:
            from0, from1 = (a + s00 < b + s10), (a + s01 < b + s11)
            back.append((from0, from1))
            a, b = (b + s10 if from0 else a + s00), (b + s11 if from1 else a + s01) + e
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1]

    def gradient(self, rows: list[list[int]], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log-likelihood: of each block's score, of the transitions and of the start (forward-backward)."""
        n = len(rows)
        emit = np.stack([np.zeros(n), self.scores(rows)], axis=1)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = self.start + emit[0]
        for k in range(1, n):
            forward[k] = np.logaddexp(forward[k - 1, 0] + self.step[0], forward[k - 1, 1] + self.step[1]) + emit[k]
        for k in range(n - 2, -1, -1):
            after = backward[k + 1] + emit[k + 1]
            backward[k] = np.logaddexp(self.step[:, 0] + after[0], self.step[:, 1] + after[1])
        total = np.logaddexp(*forward[-1])
        p = np.exp(forward + backward - total)
        both = np.exp(forward[:-1, :, None] + self.step + (backward + emit)[1:, None, :] - total)
        y = np.array(labels)
        step = -both.sum(axis=0)
        np.add.at(step, (y[:-1], y[1:]), 1)
        return y - p[:, 1], step, np.eye(2)[y[0]] - p[0]


@functools.lru_cache(maxsize=2)
def trained(n: int = 700, epochs: int = 4, seed: int = 11) -> ChainField:
    """Fits by AdaGrad on n labelled pages (a documented bound); the same in every session."""
    data = []
    for html in pages(n, seed):
        found = [b for b in leaf_blocks(html, marked=True) if b.label >= 0]
        if found:
            data.append(([sorted({*features(b)}) for b in found], [b.label for b in found]))
    model = ChainField()
    sums = [np.full_like(x, 1e-6) for x in (model.weight, model.step, model.start)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)).tolist():
            rows, labels = data[k]
            block, step, start = model.gradient(rows, labels)
            weight = np.zeros(SLOTS)
            for r, g in zip(rows, block.tolist(), strict=True):
                weight[r] += g
            for x, g, s in zip((model.weight, model.step, model.start), (weight - 1e-4 * model.weight, step, start), sums, strict=True):
                s += g * g
                x += 0.3 * g / np.sqrt(s)
    return model


def main_text(model: ChainField, html: str) -> str:
    found = leaf_blocks(html)
    labels = model.decode([features(b) for b in found])
    return " ".join([b.text for b, label in zip(found, labels, strict=True) if label])


def extract(pages_df: DataFrame, model: ChainField | None = None) -> DataFrame:
    """pages with text and n_chars: the article of each whole page, blocks joined by one space.

    Null or empty html, and pages without an article, give the empty text. Equal pages give equal
    texts; columns with the new names are replaced; other columns are carried. One pass without a
    shuffle; the model has a fixed size.
    """
    fields = [f for f in pages_df.schema.fields if f.name not in ("text", "n_chars")]
    shared = pages_df.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in blocks(batch, "html"):
                texts = [main_text(shared.value, h) for h in rows]
                n = [*map(len, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(n, pa.int64())], [*part.schema.names, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return pages_df.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, schema + ", text string, n_chars bigint")
