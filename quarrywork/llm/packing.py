"""Packing of tokenised documents into windows of a fixed length, by online sum of squares.

A document's ids, cut into full windows and a rest, come one after the other. The rest goes to the fill level
that minimises the sum of squared counts of partially filled windows (Csirik, Johnson, Kenyon, Orlin, Shor and
Weber), counts that a level array tracks; an empty window is level 0. A level of which there are many is so used
up and a level of which there are few is kept. At the end, the documents in the windows that stayed partial
are laid one after the other and cut into full windows, and what remains into windows of a power of two, which
need no padding: so there is none at all, and few documents are cut beyond what their length asks for.

Each task packs the documents that it reads, so there is no shuffle, and its memory is bounded by the open
windows: when more than ``OPEN`` are partial they are laid out as at the end. Sequence ids hold the task's number
in their upper bits. A task that is run again reads the same rows in the same order and gives the same result.

Tokenising goes through the tokenizers library. As this tokenizer's normaliser and pre-tokeniser never join what
ASCII white space separates, each distinct run of other characters is encoded once and remembered (at most
``REMEMBERED`` short ones). A text that may have an added token written out goes to the library whole.

Defined cases: null texts are empty, and a document's end id makes one token of them. Repeated rows are packed
each on its own. Other columns aren't read. Empty tables give no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Partially filled windows that a task keeps, at most.
OPEN = 4096
#: Words whose ids a worker remembers, at most, and the longest that it does.
REMEMBERED, LONGEST = 1_000_000, 40
#: New words that go to the tokenizer at once.
BATCH = 2000
#: Characters beyond the composed Latin letters, and the one of these whose small form is two characters.
BEYOND_LATIN = re.compile("[^\\x00-\u012f\u0131-\u024f]")
#: What every added token of the vocabulary begins with.
ADDED = "<|"
#: The letters that byte-level vocabularies write bytes as: printable ones as themselves, others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Words:
    """A text's ids as little-endian 32-bit numbers, by the words that it remembers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if any(not t.content.startswith(ADDED) for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"an added token doesn't begin with {ADDED}")
        self.model = self.tokenizer.model
        self.number = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.marks = {c: self._encode_new([c])[c] for c in ".,"}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ADDED in text:  # an added token may be written out, which is found before words are
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not BEYOND_LATIN.search(text):
            text = text.lower()  # letter by letter, and composed already: as the normaliser does
        for gap in "\t\n\x0b\x0c\r":
            text = text.replace(gap, " ")
        found = text.split(" ")
        own, distinct = self.known, set(found)
        new = [w for w in distinct if w not in own]
        if new:
            own = {w: own[w] for w in distinct if w in own}
            own.update(self._encode_plain(new))
            other = [w for w in new if w not in own]
            for at in range(0, len(other), BATCH):
                own.update(self._encode_new(other[at : at + BATCH]))
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
            self.known.update((w, own[w]) for w in new[:REMEMBERED] if len(w) <= LONGEST)
        return b"".join(map(own.__getitem__, found))

    def _encode_plain(self, new: list[str]) -> dict[str, bytes]:
        """The ids of words of small Latin letters, which may have a full stop or a comma behind them: neither
        normaliser nor pre-tokeniser changes or cuts the letters, so they go to the tokenizer's model directly."""
        out = {}
        for word in new:
            mark = self.marks.get(word[-1:], b"")
            letters = word[:-1] if mark else word
            if not letters.isalpha() or BEYOND_LATIN.search(letters) or letters != letters.lower():
                continue
            ids = self.known.get(letters) if mark else None
            if ids is None:
                stored = letters.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = b"".join([self.number[t.id] for t in self.model.tokenize(stored)])
            out[word] = ids + mark
        return out

    def _encode_new(self, new: list[str]) -> dict[str, bytes]:
        """The ids of words, from one call for all: each id belongs to the word that its offset lies in."""
        got = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        ids = np.array(got.ids, "<u4")
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
        starts = np.fromiter((o[0] for o in got.offsets), np.int64, len(ids))
        cuts = np.searchsorted(starts, ends).tolist()
        data, low, out = ids.tobytes(), 0, {}
        for word, high in zip(new, cuts):
            out[word] = data[4 * low : 4 * high]
            low = high
        return out


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


class SumOfSquares:
    """Open windows by fill level, and the choice among them."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # partially filled windows of each level; 0 and full stay 0
        self.at: list[list[int]] = [[] for _ in range(window)]  # their ids, the last one first
        self.next = 0

    def open(self) -> int:
        return int(self.count.sum())

    def level_for(self, size: int) -> int:
        """The level h whose choice changes the sum of squares least: 2 (N(h + size) - N(h)) + 2 in general,
        without the first part for a full window and without the second for a new one. Of equal ones the fullest."""
        if size == self.window:
            return 0
        levels = np.flatnonzero(self.count[1 : self.window - size + 1]) + 1
        change = 2 * (self.count[levels + size] - self.count[levels]) + 2
        if len(levels) and levels[-1] + size == self.window:
            change[-1] = 1 - 2 * self.count[levels[-1]]
        new = 2 * self.count[size] + 1
        if not len(levels) or change.min() > new:
            return 0
        return int(levels[len(levels) - 1 - change[::-1].argmin()])

    def place(self, size: int) -> tuple[int, int]:
        """(window's id, offset in it) for a rest of ``size`` tokens."""
        level = self.level_for(size)
        if level:
            self.count[level] -= 1
            window = self.at[level].pop()
        else:
            window, self.next = self.next, self.next + 1
        if level + size < self.window:
            self.count[level + size] += 1
            self.at[level + size].append(window)
        return window, level


def pack(documents: Iterable[tuple[object, bytes]], window: int = WINDOW, limit: int = OPEN) -> Iterator[tuple]:
    """Pieces (doc, start, length, crc32, doc_tokens, sequence, offset) of documents given as (doc, ids)."""
    levels = SumOfSquares(window)
    partial: dict[int, list[tuple]] = {}  # the documents' rests in the windows that aren't full yet

    def piece(doc: object, data: bytes, start: int, length: int, total: int, sequence: int, offset: int) -> tuple:
        return doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), total, sequence, offset

    def lay_out() -> Iterator[tuple]:
        """All partial windows' rests, cut into full windows and at last into powers of two."""
        rests = [r for key in sorted(partial) for r in partial[key]]
        left = sum(r[3] for r in rests)
        room, sequence = 0, 0
        for doc, rest, start, length, total in rests:
            base = start
            while length:
                if not room:
                    room = size = window if left >= window else 1 << (left.bit_length() - 1)
                    sequence, levels.next = levels.next, levels.next + 1
                    left -= size
                    filled = 0
                take = min(room, length)
                crc = zlib.crc32(rest[4 * (start - base) : 4 * (start - base + take)])
                yield doc, start, take, crc, total, sequence, filled
                start, length, room, filled = start + take, length - take, room - take, filled + take
        partial.clear()
        levels.count[:] = 0
        levels.at = [[] for _ in range(window)]

    for doc, data in documents:
        total = len(data) // 4
        full = total - total % window
        for start in range(0, full, window):
            yield piece(doc, data, start, window, total, levels.next, 0)
            levels.next += 1
        if total > full:
            sequence, level = levels.place(total - full)
            rests = partial.setdefault(sequence, [])
            rests.append((doc, data[4 * full :], full, total - full, total))
            if level + total - full == window:
                offset = 0
                for own, rest, start, length, tokens in partial.pop(sequence):
                    yield own, start, length, zlib.crc32(rest), tokens, sequence, offset
                    offset += length
            elif len(partial) > limit:
                yield from lay_out()
    yield from lay_out()


def packed(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END_ID
) -> DataFrame:
    """A row for each piece of each document. One pass, no shuffle."""
    columns = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = dict(docs.dtypes)[key]
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = words(tokenizer).encode
        first = TaskContext.get().partitionId() << 40
        given = ((doc, encode(value) + last) for b in batches for doc, value in zip(b.iloc[:, 0].tolist(), b.iloc[:, 1]))
        rows: list[tuple] = []
        for *row, sequence, offset in pack(given, window):
            rows.append((*row, first + sequence, offset))
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(key, text).mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
