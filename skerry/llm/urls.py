"""URL filters: all rules run at once over each URL as one bit-parallel wildcard automaton (Shift-And).

Every glob is a run of bits: a start bit, then one bit a character.  All globs lie one after the other in the bits of
a few 64-bit words.  A character moves every bit one place on, where the place takes that character, and lets a bit
stay where a wildcard stands behind it; carries go from word to word.  A batch of URLs is simulated in numpy, column
of characters by column of characters, so the work per URL is its bytes times the words, however many globs there are.

Globs: ``*`` is any run of characters inside a host name or a path segment (no ``/``, no ``?``), ``**`` is any run,
``?`` is one character inside a segment, and a backslash takes away a sign's meaning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.words import buffers

WORD = 64
ANY = np.ones(256, bool)
INSIDE = ANY & ~np.isin(np.arange(256), [ord("/"), ord("?")])
FOLLOWS = np.isin(np.arange(256), np.arange(0x80, 0xC0))  # bytes of a character after its first
#: URLs of a slice that are simulated together, in bytes.
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """``pattern``: a host (and its subdomains) and the beginning of a path, as in ``example.org/en/``."""

    verdict: str
    pattern: str

    def globs(self) -> tuple[str, str]:
        if "/" not in self.pattern:
            raise ValueError(f"a rule has a path: {self.pattern}")
        if "?" in self.pattern or "#" in self.pattern:
            raise ValueError(f"paths end before ? and #: {self.pattern}")
        plain = "".join("\\" + c if c in "*\\" else c for c in self.pattern)
        return f"{plain}**", f"*.{plain}**"


# The given rules.
RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)
#: Globs for URLs that no rule fits: the first that matches decides, and without one the URL is allowed.
GLOBS = (
    ("allow", "**/robots.txt"),
    ("block", r"**\?page=**"),
    ("block", r"**&page=**"),
    ("block", "**/login**"),
    ("block", "**/cart/**"),
    ("block", r"**sessionid=**"),
    ("block", "*.*/**/print.htm?"),
)


def parse(glob: str) -> tuple[np.ndarray, np.ndarray]:
    """(takes, stays): per place of the glob, the start first, which bytes lead to it and which leave a bit there."""
    takes, stays, i = [np.zeros(256, bool)], [np.zeros(256, bool)], 0
    data = glob.encode()
    while i < len(data):
        c = data[i : i + 1]
        if c == b"*":
            wide = data[i + 1 : i + 2] == b"*"
            stays[-1] = stays[-1] | (ANY if wide else INSIDE)
            i += 1 + wide
            continue
        if c == b"?":
            takes.append(INSIDE & ~FOLLOWS)
            stays.append(FOLLOWS.copy())
        else:
            if c == b"\\" and i + 1 < len(data):
                i += 1
                c = data[i : i + 1]
            takes.append(np.arange(256) == c[0])
            stays.append(np.zeros(256, bool))
        i += 1
    return np.array(takes), np.array(stays)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, the first bit lowest."""
    wide = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // WORD) * WORD), bool)
    wide[..., : bits.shape[-1]] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view("<u8")


class Automaton:
    """All globs in one set of masks: ``takes`` and ``stays`` by byte, the start bits, and each glob's last bit."""

    def __init__(self, globs: Sequence[str]):
        parsed = [parse(g) for g in globs]
        sizes = np.array([len(t) for t, _ in parsed], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        none = np.zeros((0, 256), bool)
        self.takes = _packed(np.concatenate([none, *(t for t, _ in parsed)]).T)
        self.stays = _packed(np.concatenate([none, *(s for _, s in parsed)]).T)
        begin = np.zeros(starts[-1], bool)
        begin[starts[:-1]] = True
        self.begin, self.last = _packed(begin), starts[1:] - 1

    def run(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bits after each text ``data[at[i]:at[i + 1]]``: one row of words a text."""
        lengths = np.diff(at)
        order = np.argsort(-lengths, kind="stable")
        bits = np.repeat(self.begin[None], len(order), 0)
        start, longest = at[:-1][order], lengths[order]
        live = len(order)
        for j in range(int(longest[0]) if live else 0):
            live = int(np.searchsorted(-longest[:live], -j, "left"))  # texts longer than j come first
            c, now = data[start[:live] + j], bits[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(WORD - 1)
            bits[:live] = (moved & self.takes[c]) | (now & self.stays[c])
        out = np.empty_like(bits)
        out[order] = bits
        return out

    def first_match(self, texts: pa.Array) -> np.ndarray:
        """Per text the number of the first glob that matches all of it, or -1."""
        data, at = buffers(texts)
        found = np.full(len(texts), -1, np.int64)
        i = 0
        while i < len(texts):
            end = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
            bits = self.run(data, at[i : end + 1])
            for k in range(len(self.last) - 1, -1, -1):
                word, place = divmod(int(self.last[k]), WORD)
                found[i:end][(bits[:, word] >> np.uint64(place)) & np.uint64(1) == 1] = k
            i = end
        return found


def _after(url: Column) -> Column:
    start = F.locate("://", url)
    return F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A to Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^?#]*(\?[^#]*)?", 1)


def judge(pages: DataFrame, url: str = "url", rules: Sequence[Rule] = RULES, globs: Sequence[tuple[str, str]] = GLOBS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` of each URL; columns of these names are replaced.

    A rule fits its host and all subdomains where the path begins with its path; the longest rule wins, of equal
    lengths one that blocks, then the least pattern.  Where none fits (``rule`` null) the first glob that matches decides,
    and without one the URL is allowed.  Rules and globs run over the canonical URL: host, path and query, without scheme
    and fragment.  A null URL or one without ``://`` has an empty host and path, which no rule fits.  Repeated rows are
    judged alike; an empty table stays empty.

    No shuffle.  Masks are 512 words of 8 bytes for every 64 characters of rules, built once in each task.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.pattern), r.verdict != "block", r.pattern))
    patterns = [g for r in ranked for g in r.globs()] + [g for _, g in globs]
    named = [r.pattern for r in ranked for _ in range(2)] + [None] * len(globs) + [None]
    verdicts = [r.verdict for r in ranked for _ in range(2)] + [v for v, _ in globs] + ["allow"]
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    row = pages.select(
        F.struct(*kept).alias("_row"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        query_of(F.col(url)).alias("_query"),
    )
    cols = ["host", "path"]
    ready = row.select("_row", *[F.coalesce(c, F.lit("")).alias(c) for c in cols], F.coalesce("_query", F.lit("")).alias("_query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(patterns)
        rules_of, verdict_of = pa.array(named, pa.string()), pa.array(verdicts, pa.string())
        for batch in batches:
            found = pa.array(automaton.first_match(batch.column("_url")) % len(verdicts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("host"), batch.column("path"), rules_of.take(found), verdict_of.take(found)],
                ["_row", "host", "path", "rule", "verdict"],
            )

    given = ready.select("_row", "host", "path", F.concat("host", "path", "_query").alias("_url"))
    schema = f"_row {given.schema['_row'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return given.mapInArrow(run, schema).select("_row.*", "host", "path", "rule", "verdict")
