"""Main text of web pages by wrapper induction.

Each host has an example page.  The block trees of all its pages are aligned to the example's by simple tree
matching, and every text is counted with the aligned container it stands in, once for all pages that say the
same throughout.  A text that a container has on most of the host's different pages is template; the smallest
container that holds nearly all of the text that varies is the host's content slot.  A page's main text is what
stands in its own node for that slot, without template.

Element kinds and names ("nav", "comments") are a second, weaker sign: text under them weighs less when the
slot is looked for, and below the slot they are passed over unless they hold half of what varies there.  On
hosts of fewer than ``TEMPLATE_PAGES`` different pages only the slot and these signs decide.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.storage import cut, lean, scratch

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
    # attributes; a quote that nothing closes is a plain character
    r"((?:[^>\"']++|\"[^\"]*\"|'[^']*'|\"(?![^\"]*\")|'(?![^']*'))*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul".split()
)
CONTAINERS = frozenset("html body div section main article td tr tbody table center form".split())
LANDMARKS = frozenset("article main".split())
ASIDE_TAGS = frozenset("nav header footer aside form button dialog menu fieldset head".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent banner sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies respond share "
    "sharing social related newsletter subscribe popup modal notice notices widget disclaimer contentinfo "
    "complementary search login".split()
)
#: Words before such a name that say that it is not the thing itself.
NOT_NAMES = frozenset("with no has without".split())
#: A text is template if a container has it on so many different pages of the host, and on this share of them.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.8
#: A host's pages are versions of one page, without template, if less than this share of what its most varying container
#: says varies, and a page has less than so many characters that vary.
VARYING, VARYING_CHARS = 0.25, 120
#: Share of the varying text that the content slot holds, and weight of text under an aside there.
SHARE, ASIDE_WEIGHT = 0.85, 0.25
#: An element below the slot that holds this share of the varying text there is no aside, whatever its name.
MAIN_SHARE = 0.5
#: Rows of gains that are kept while the children of two nodes are matched.
KEPT = 256
BROADCAST_BYTES = 16 << 20
REMEMBERED = 20_000


def names_of(attributes: str) -> list[str]:
    """Class names, id and role."""
    found = (next(filter(None, m.groups()), "") for m in NAMES.finditer(attributes)) if attributes else ()
    return sorted({x for names in found for x in names.lower().split()})


def _named(names: list[str]) -> bool:
    """Whether one of the names, or a part of one, is an aside's."""
    for name in names:
        parts = re.split(r"[_-]+", name)
        if parts[0] not in NOT_NAMES and not ASIDE_NAMES.isdisjoint(parts):
            return True
    return False


@dataclass
class Page:
    """Block elements in page order, and the texts between block boundaries with their elements.  ``signs`` tells
    the elements that are asides by kind or name.
    """

    tags: list[str] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    signs: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)

    @property
    def skeleton(self) -> str:
        return " ".join(f"{d}{t}" for d, t in zip(self.depths, self.tags, strict=True))


def parse(html: str) -> Page:
    """A tolerant reading: implied end tags, unknown end tags passed over, an unfinished tag ends the page."""
    page, stack, words = Page(), [], []
    open_tags: list[str] = []  # with inline elements; stack has the block elements' numbers or -1

    def element() -> int:
        return next((n for n in reversed(stack) if n >= 0), -1)

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text and element() >= 0:
                page.blocks.append((element(), text))

    def push(tag: str, attributes: str) -> None:
        names, up = names_of(attributes), element()
        sign = tag in ASIDE_TAGS or _named(names)
        if tag == "header" and any(t in LANDMARKS for t in open_tags):  # a headline's
            sign = _named([n for n in names if n != "header"])
        if tag in LANDMARKS or tag in ("html", "body"):
            sign = False
        label = [n for n in names if not any(c in ".0123456789" for c in n)]  # no numbers of single pages
        page.tags.append(".".join([tag, *label]))
        page.parents.append(up)
        page.depths.append(page.depths[up] + 1 if up >= 0 else 0)
        page.signs.append(sign)
        open_tags.append(tag)
        stack.append(len(page.tags) - 1)

    def pop_to(n: int) -> None:
        flush()
        del open_tags[n:], stack[n:]

    push("html", "")
    at = 0
    hidden = None
    while True:
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text and hidden is None:
            words.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue
        if m[1]:
            if tag not in ("html", "body") and tag in open_tags:
                n = len(open_tags) - 1 - open_tags[::-1].index(tag)
                if tag in INLINE:
                    if not any(s >= 0 for s in stack[n:]):
                        del open_tags[n:], stack[n:]
                else:
                    pop_to(n)
            continue
        if tag in VOID:
            if tag == "br":
                words.append(" ")
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in INLINE:
            if m[3] and _named(names_of(m[3])):  # an inline notice is set apart as an element of its own
                flush()
                push(tag, m[3])
            else:
                open_tags.append(tag)
                stack.append(-1)
            continue
        flush()
        if tag == "html":
            continue
        if tag == "body" and "body" in open_tags:
            continue
        if tag in CLOSES_P and "p" in open_tags:
            n = len(open_tags) - 1 - open_tags[::-1].index("p")
            pop_to(n)
        for group in ({"li"}, {"dt", "dd"}, {"td", "th"}, {"tr"}, {"option"}):
            if tag in group:
                n = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i] in group), -1)
                fence = max((i for i, t in enumerate(open_tags) if t in ("ul", "ol", "dl", "table")), default=-1)
                if n > fence:
                    pop_to(n)
        if tag == "head" or "body" in open_tags or tag == "body":
            if tag == "body" and "head" in open_tags:
                pop_to(open_tags.index("head"))
            push(tag, m[3])
        else:
            if "head" in open_tags:
                pop_to(open_tags.index("head"))
            push("body", "")
            push(tag, m[3])
    flush()
    return page


class Matcher:
    """Simple tree matching of block trees; equal subtrees share a number, so scores and alignments are kept."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.kinds: list[tuple[str, tuple[int, ...]]] = []
        self.sizes: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}
        self.trees: dict[str, tuple[int, list]] = {}
        self.aligned: dict[tuple[str, str], list[int]] = {}

    def tree(self, skeleton: str) -> int:
        if skeleton not in self.trees:
            nodes = [(int(m[1]), m[2]) for m in re.finditer(r"(\d+)(\S+)", skeleton)]
            children: list[list[int]] = [[] for _ in nodes]
            last: dict[int, int] = {}
            for i, (d, _) in enumerate(nodes):
                if d:
                    children[last[d - 1]].append(i)
                last[d] = i
            number = [0] * len(nodes)
            for i in range(len(nodes) - 1, -1, -1):
                kind = (nodes[i][1], tuple(number[c] for c in children[i]))
                if kind not in self.numbers:
                    self.numbers[kind] = len(self.kinds)
                    self.kinds.append(kind)
                    self.sizes.append(1 + sum(self.sizes[c] for c in kind[1]))
                number[i] = self.numbers[kind]
            self.trees[skeleton] = number[0]
        return self.trees[skeleton]

    def _strips(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
        """The ranges of x and y that are matched with each other: all that is between their equal heads and tails."""
        head, tail, least = 0, 0, min(len(x), len(y))
        while head < least and x[head] == y[head]:
            head += 1
        while tail < least - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        between = (head, len(x) - tail, head, len(y) - tail)
        return [between] if len(x) > head + tail and len(y) > head + tail else []

    def _known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.sizes[a]
        return 0 if self.kinds[a][0] != self.kinds[b][0] else self.scores.get((a, b))

    def _rows(self, x: tuple[int, ...], y: tuple[int, ...], row: np.ndarray) -> Iterator[np.ndarray]:
        """The most nodes matched in each head of x and every head of y, from those of the rows of x before."""
        kinds, at = np.unique(y, return_inverse=True)
        gains: dict[int, np.ndarray] = {}
        for a in x:
            if a not in gains:
                if len(gains) >= KEPT:
                    gains.clear()
                gains[a] = np.array([self._known(a, b) for b in kinds.tolist()], np.int64)[at]
            row = np.r_[0, np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gains[a]))]
            yield row

    def _chosen(self, x: tuple[int, ...], y: tuple[int, ...]) -> Iterator[tuple[int, int]]:
        """The pairs that are matched, from the last on.  Only about a root of the rows are held, others computed again."""
        i, j, step = len(x), len(y), math.isqrt(len(x)) + 1
        starts = [np.zeros(len(y) + 1, np.int64)]
        for k, row in enumerate(self._rows(x, y, starts[0]), 1):
            if k % step == 0:
                starts.append(row)
        while i and j:
            first = (i - 1) // step
            at = first * step
            rows = [starts[first], *self._rows(x[at:i], y, starts[first])]
            while i > at and j:
                if rows[i - at][j] == rows[i - at - 1][j]:
                    i -= 1
                elif rows[i - at][j] == rows[i - at][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield i, j

    def score(self, a: int, b: int) -> int:
        """The most nodes that can be matched if the roots are (bottom up, without recursion)."""
        todo = [(a, b)]
        while todo:
            a_, b_ = todo[-1]
            if self._known(a_, b_) is not None:
                todo.pop()
                continue
            x, y = self.kinds[a_][1], self.kinds[b_][1]
            strips = self._strips(x, y)
            alike: dict[str, set[int]] = {}
            for d in {d for _, _, k, n in strips for d in y[k:n]}:
                alike.setdefault(self.kinds[d][0], set()).add(d)
            inner = {(c, d) for i, j, _, _ in strips for c in set(x[i:j]) for d in alike.get(self.kinds[c][0], ())}
            if open_ := [p for p in inner if self._known(*p) is None]:
                todo += open_
                continue
            both = 1
            for i, j, k, n in strips:
                row = np.zeros(n - k + 1, np.int64)
                for row in self._rows(x[i:j], y[k:n], row):
                    pass
                both += int(row[-1])
            head = strips[0][0] if strips else min(len(x), len(y))
            tail = len(x) - strips[-1][1] if strips else 0
            if not strips:  # one list is the head and tail of the other
                same = 0
                while same < head and x[same] == y[same]:
                    same += 1
                head, tail = same, head - same
            both += sum(self.sizes[c] for c in x[:head]) + sum(self.sizes[c] for c in x[len(x) - tail :])
            self.scores[a_, b_] = both
            todo.pop()
        return self._known(a, b) or 0

    def _pairs(self, a: int, b: int, out: list[int]) -> None:
        todo = [(a, b, 0, 0)]
        while todo:
            a, b, at, bt = todo.pop()
            if a == b:
                out[at : at + self.sizes[a]] = range(bt, bt + self.sizes[a])
                continue
            out[at] = bt
            x, y = self.kinds[a][1], self.kinds[b][1]
            strips = self._strips(x, y)
            if strips:
                head, tail = strips[0][0], len(x) - strips[-1][1]
            else:
                least, head = min(len(x), len(y)), 0
                while head < least and x[head] == y[head]:
                    head += 1
                tail = least - head
            chosen = [(k, k) for k in range(head)] + [(len(x) - k, len(y) - k) for k in range(1, tail + 1)]
            for first, i, other, j in strips:
                chosen += [(first + p, other + q) for p, q in self._chosen(x[first:i], y[other:j])]
            starts_x = np.cumsum([0, *(self.sizes[c] for c in x)]).tolist()
            starts_y = np.cumsum([0, *(self.sizes[c] for c in y)]).tolist()
            todo += [(x[i], y[j], at + 1 + starts_x[i], bt + 1 + starts_y[j]) for i, j in chosen]

    def align(self, page: str, example: str) -> list[int]:
        """Per node of ``page`` the node of ``example`` it is matched with, or -1."""
        if (page, example) not in self.aligned:
            if len(self.aligned) > REMEMBERED or len(self.scores) > 50 * REMEMBERED:
                self.__init__()
            a, b = self.tree(page), self.tree(example)
            out = [-1] * self.sizes[a]
            if self.score(a, b):
                self._pairs(a, b, out)
            self.aligned[page, example] = out
        return self.aligned[page, example]


def matched(page: Page, to: list[int], n: int) -> int:
    """The example's node that ``n``, or the next element above it, is matched with."""
    while to[n] < 0:  # the root is always matched
        n = page.parents[n]
    return to[n]


def place(page: Page, to: list[int], n: int) -> int:
    """The example's node of the container that ``n`` stands in."""
    return matched(page, to, max(0, page.parents[n]))


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


#: ``first``: whether the page says it there for the first time; ``mass``: its weighted length.
SAID = "host string, page_hash long, said array<struct<node: int, place: int, text_hash: long, first: int, mass: double>>"


def said(page: Page, to: list[int]) -> list[tuple[int, int, int, int, float]]:
    """What every block says and where, in page order."""
    aside = [False] * len(page.tags)
    for n, up in enumerate(page.parents):
        aside[n] = page.signs[n] or (up >= 0 and aside[up])
    seen: set[tuple[int, int]] = set()
    out = []
    for n, text in page.blocks:
        key = (place(page, to, n), text_hash(text))
        out.append((matched(page, to, n), *key, int(key not in seen), len(text) * (ASIDE_WEIGHT if aside[n] else 1.0)))
        seen.add(key)
    return out


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html, skeleton of the host's example): what each aligned node says, and a hash of it all."""
    matcher = Matcher()
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
    for batch in batches:
        hashes: list[int] = []
        bounds = [0]
        seen: list[tuple] = []
        for html, skeleton in zip(batch.column(1), batch.column(2), strict=True):
            page = parse(html.as_py() or "")
            seen += said(page, matcher.align(page.skeleton, skeleton.as_py()))
            hashes.append(text_hash(repr(seen[bounds[-1] :])))
            bounds.append(len(seen))
        columns = list(zip(*seen, strict=True)) or [()] * len(kinds)
        structs = pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "place", "text_hash", "first", "mass"]
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(hashes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs),
            ],
            names=["host", "page_hash", "said"],
        )


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        skeletons = [parse(h.as_py() or "").skeleton for h in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(skeletons, pa.string())], names=["host", "skeleton"]
        )


def content_slot(skeleton: str, mass: dict[int, float]) -> tuple[int, list[int]]:
    """(slot, nodes that hold the main text): the example's node to take content from, down from the root as long
    as one container holds nearly all of the mass, and not below an article; and the nodes below it that hold
    ``MAIN_SHARE`` of its mass.
    """
    nodes = [(int(m[1]), m[2].split(".")[0]) for m in re.finditer(r"(\d+)(\S+)", skeleton)]
    total = [mass.get(i, 0.0) for i in range(len(nodes))]
    children: list[list[int]] = [[] for _ in nodes]
    last: dict[int, int] = {}
    up = [0] * len(nodes)
    for i, (d, _) in enumerate(nodes):
        if d:
            up[i] = last[d - 1]
            children[up[i]].append(i)
        last[d] = i
    for i in range(len(nodes) - 1, 0, -1):
        total[up[i]] += total[i]
    at = 0
    while nodes[at][1] not in LANDMARKS:
        inner = [c for c in children[at] if nodes[c][1] in CONTAINERS and total[c] >= SHARE * total[at] > 0]
        if not inner:
            break
        at = inner[0]
    main, todo = [], [at]
    while todo:
        big = [c for c in children[todo.pop()] if total[c] >= MAIN_SHARE * total[at] > 0]
        main += big
        todo += big
    return at, main


WRAPPER = "host string, skeleton string, slot int, main array<int>, template array<struct<place: int, text_hash: long>>"


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, skeleton, [(node, mass)], template): the wrapper of each host."""
    for batch in batches:
        found = []
        for skeleton, masses in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found.append(content_slot(skeleton, {m["node"]: m["mass"] for m in masses or ()}))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([slot for slot, _ in found], pa.int32()),
                pa.array([main for _, main in found], pa.list_(pa.int32())),
                batch.column(3),
            ],
            names=["host", "skeleton", "slot", "main", "template"],
        )


def extract(page: Page, to: list[int], slot: int, main: set[int], template: set[tuple[int, int]]) -> str:
    """The blocks in the page's node for the slot, and below; the whole page if it has no such node.  Asides below
    that node are passed over, and texts that ``template`` has for their container.
    """
    found = slot in to
    inside, out = [False] * len(page.tags), [False] * len(page.tags)
    for n, up in enumerate(page.parents):
        below = up >= 0 and inside[up]
        inside[n] = below or to[n] == slot or not found
        out[n] = below and (out[up] or (page.signs[n] and to[n] not in main))
    return "\n".join(
        t
        for n, t in page.blocks
        if inside[n] and not out[n] and not (template and (place(page, to, n), text_hash(t)) in template)
    )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matcher = Matcher()
    for batch in batches:
        texts = []
        # page_id, url, html, skeleton, slot, main, template
        for html, skeleton, slot, main, template in zip(*batch.columns[2:], strict=True):
            page = parse(html.as_py() or "")
            known = {(x["place"], x["text_hash"]) for x in template.as_py() or ()}
            to = matcher.align(page.skeleton, skeleton.as_py())
            texts.append(extract(page, to, slot.as_py(), set(main.as_py()), known))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def induce(pages: DataFrame) -> DataFrame:
    """The wrapper of each ``host`` of ``pages`` (``host``, ``html``, ``page_id``): example, slot, main, template.

    All pages of a host are counted, those that say the same as one page, in sums per container and text.
    """
    typical = F.struct(F.abs(F.length("html") - 8192), "page_id", F.xxhash64("html"))
    with scratch(pages.sparkSession):
        examples = cut(
            pages.groupBy("host").agg(F.min_by("html", typical).alias("html")).mapInArrow(
                _examples, "host string, skeleton string"
            ),
            "examples",
        )
        different = cut(
            pages.select("host", "html")
            .join(side(examples), "host")
            .mapInArrow(_observe, SAID)
            .groupBy("host", "page_hash")
            .agg(F.first("said").alias("said")),
            "different",
        )
        counts = different.groupBy("host").agg(F.count(F.lit(1)).alias("distinct"))
        counts = cut(examples.select("host").join(counts, "host"), "counts")
        texts = (
            different.select("host", F.inline("said"))
            .groupBy("host", "place", "text_hash", "node")
            .agg(F.sum("first").alias("pages"), F.sum("mass").alias("mass"))
            .groupBy("host", "place", "text_hash")
            .agg(F.sum("pages").alias("pages"), F.sum("mass").alias("mass"), F.collect_list(F.struct("node", "mass")).alias("at"))
        )
        needed = F.greatest(F.lit(float(TEMPLATE_PAGES)), TEMPLATE_SHARE * F.col("distinct"))
        texts = cut(texts.join(side(counts), "host").withColumn("fixed", F.col("pages") >= needed), "texts")
        # share of the container that varies most, not of the page: a short article under a long menu is an article
        loose = F.sum(F.when(~F.col("fixed"), F.col("mass")).otherwise(0.0))
        places = texts.groupBy("host", "place").agg(loose.alias("loose"), F.sum("mass").alias("all"))
        most = places.groupBy("host").agg(F.max(F.struct("loose", "all")).alias("most"), F.sum("loose").alias("loose"))
        own = F.col("most.loose") >= VARYING * F.col("most.all")
        much = F.col("loose") >= VARYING_CHARS * F.col("distinct")
        varied = cut(most.join(side(counts), "host").select("host", (own | much).alias("varies")), "varied")
        hosts = texts.join(side(varied), "host").groupBy("host").agg(
            F.first("varies").alias("varies"),
            # as many as the texts of a page, about
            F.collect_list(F.when(F.col("fixed"), F.struct("place", "text_hash"))).alias("template"),
        )
        hosts = cut(hosts.withColumn("template", F.when(F.col("varies"), F.col("template")).otherwise(F.array())), "hosts")
        mass = (
            texts.join(side(hosts.select("host", "varies")), "host")
            .where(~F.col("fixed") | ~F.col("varies"))
            .select("host", F.inline("at"))
            .groupBy("host", "node")
            .agg(F.sum("mass").alias("mass"))
            .groupBy("host")
            .agg(F.collect_list(F.struct("node", "mass")).alias("mass"))  # nodes of one example
        )
        whole = examples.join(hosts.select("host", "template"), "host", "left").join(mass, "host", "left")
        return cut(
            whole.select("host", "skeleton", "mass", "template").mapInArrow(_wrappers, WRAPPER), "wrappers", keep=True
        )


def side(table: DataFrame) -> DataFrame:
    """A table of one row a host, broadcast if it is small enough."""
    size = sum((F.length("skeleton") if c == "skeleton" else F.lit(16) for c in table.columns), F.length("host"))
    if "template" in table.columns:
        size = size + 12 * F.coalesce(F.size("template"), F.lit(0))
    return F.broadcast(table) if (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else table


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every row; "" where nothing is left.

    Null html is an empty page; rows without a url share the host "".  Repeated rows are extracted each and
    counted once; very long and very deep pages are read whole.  A page of a host with a single different page
    keeps all its texts but asides.  Wrappers are broadcast below ``BROADCAST_BYTES`` and joined by host above it.
    Extra columns are not carried.  An empty table gives no rows.
    """
    lean(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn(
        "host", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))
    )
    found = rows.join(side(induce(rows)), "host")
    return found.select("page_id", "url", "html", "skeleton", "slot", "main", "template").mapInArrow(
        _extract, "page_id long, url string, text string"
    )
