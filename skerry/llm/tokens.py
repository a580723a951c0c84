"""Token ids of whole texts with a public tokenizer file, many times faster than one call per text.

The tokenizer drops white space and never joins text across it, so the ids of a text are the ids of its
white-space-delimited chunks in order; and it writes a chunk in lower case and cuts it into pieces (runs of
letters, single digits, runs of marks, a few English endings) before it looks for merges.  Arrow splits a slice
of texts and finds its different chunks; those are cut into pieces; the library is asked once for all pieces
that the worker has not met lately; numpy puts the ids of the chunks where the texts have them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from skerry.llm import words

DEFAULT_FILE = public_tokenizers.path("word_bpe_49k.json")
#: Entries of each of the two generations of a worker's memory of pieces (about 20 MB each).
REMEMBERED = 100_000
#: Bytes of the texts of a slice.
SLICE = 1 << 21
#: Chunks with other characters than ASCII and Latin letters, or with what may be a special token, go to the
#: library whole.
ODD = re.compile(r"[^\n!-~À-ÖØ-öø-ÿ]|<\|")
# Fixed value: the pieces of the tokenizer file, for the characters that are left; and the end of a chunk.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-zß-öø-ÿ0-9]+|\n")
#: Stands for the end of a chunk; no id.
STOP = 2**32 - 1
WORD_END = "</w>"


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory:
    """Ids of strings in two generations: what nothing asked for while ``size`` new ones came is forgotten."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def meet(self, asked: set[str], learn: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """A dict that has all that are asked for.  ``learn`` is not kept: an encoder in a cycle of references would
        stay in the worker after its task.
        """
        new = asked.difference(self.known)
        if len(self.known) + len(new) > self.size:
            self.older, self.known, new = self.known, {}, asked
        again = new & self.older.keys()
        self.known.update([(s, self.older[s]) for s in again])
        if fresh := list(new - again):
            self.known.update(zip(fresh, learn(fresh), strict=True))
        return self.known


@cache
def _cuts(path: str) -> str:
    """How a tokenizer file cuts and writes texts before it merges."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model = {k: v for k, v in found["model"].items() if k not in ("vocab", "merges")}
    return json.dumps([found["normalizer"], found["pre_tokenizer"], model], sort_keys=True)


class ChunkEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    The pieces are those of ``DEFAULT_FILE``; with a file that normalises, cuts or merges otherwise every text is one plain
    call of the library.
    """

    def __init__(self, path: str = DEFAULT_FILE, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.library = path, None
        self.plain = path != DEFAULT_FILE and _cuts(path) != _cuts(DEFAULT_FILE)
        # the same merges over pieces in lower case and byte letters
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = self.merges.post_processor = None
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        names = self.merges.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
        self.letters = _byte_letters() | {32: " "}
        self.pieces = Memory(remembered)
        self.odd = Memory(remembered // 10)

    def whole(self, text: str) -> bytes:
        """One plain call of the library."""
        if self.library is None:  # many workers meet no odd chunk and need no second tokenizer
            self.library = Tokenizer.from_file(self.path)
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: its last id, and no other, has the end mark."""
        written = " ".join(pieces).encode().decode("latin1").translate(self.letters)
        ids = np.array(self.merges.encode_batch_fast([written], add_special_tokens=False)[0].ids, "<u4")
        ends, data = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of different chunks one after the other, where those of each end)."""
        lines, odd = "\n".join(chunks), set()
        if ODD.search(lines):
            odd = {c for c in chunks if ODD.search(c)}
            lines = "\n".join(["" if c in odd else c for c in chunks])
        pieces = PIECE.findall(lines.lower() + "\n" if chunks else "")
        known = self.pieces.meet(set(pieces) - {"\n"}, self._merge)
        known["\n"] = stop = STOP.to_bytes(4, "little")
        data = list(map(known.__getitem__, pieces))
        del known["\n"]
        if odd:
            whole = self.odd.meet(odd, lambda chunks: [self.whole(c) for c in chunks])
            at = [i for i, p in enumerate(pieces) if p == "\n"]
            for line, chunk in zip(at, chunks, strict=True):
                if chunk in odd:
                    data[line] = whole[chunk] + stop
        ids = np.frombuffer(b"".join(data), "<u4")
        stops = np.flatnonzero(ids == STOP)
        return np.delete(ids, stops), stops - np.arange(len(stops))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts; null counts as empty."""
        if texts.null_count:
            texts = texts.fill_null("")
        if self.plain:
            return [self.whole(t) for t in texts.to_pylist()]
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        parts = split.flatten().dictionary_encode()
        ids, ends = self._ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        chunk = parts.indices.to_numpy()
        starts = np.r_[0, ends[:-1]][chunk] if len(ends) else ends
        sizes = ends[chunk] - starts
        at = np.r_[0, np.cumsum(sizes)]
        data = ids[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])].tobytes()
        bounds = (4 * at[first]).tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.large_string()))[0]


def encode_all(
    texts: pa.Array, path: str = DEFAULT_FILE, end_id: int | None = None, encoder: ChunkEncoder | None = None
) -> Iterator[bytes]:
    """Ids of each text, with ``end_id``, slice by slice; a text beyond the size of a slice is one of its own.

    A task makes one ``encoder`` and drops it at its end, so that no worker carries it into other stages.
    """
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")
    encoder = encoder or ChunkEncoder(path)
    for a, b in words.slices(texts, SLICE):
        for ids in encoder.encode_all(texts.slice(a, b - a)):
            yield ids + tail
    words.release()
