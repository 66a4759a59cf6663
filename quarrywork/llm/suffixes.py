"""Byte strings that repeat anywhere in a corpus, by a distributed difference-cover suffix sort.

Letters. Texts are cut at anchors, the places whose hash of eight bytes is the least of some window of :func:`window` places. Equal
strings are cut alike, but for their ends, so a string of ``length`` bytes that occurs twice holds at least three equal
phrases, wherever it lies; a phrase is a letter, and about one byte in ``length`` / 12 starts one. Suffixes that start at
anchors are sorted by letters:

1. triples of letters are sorted, and one that differs from both neighbours' settles all suffixes that begin with letters
   around it: a suffix stays if every triple of those that it must share repeats, and so do the letters after it;
2. of the rest, those at places 1 and 2 modulo 3 are the sample: distinct triples are sorted and named by their place, and
   the string of names is sorted in the same way, three times as far each time, until names reach as far as is asked;
3. the remaining suffixes are merged with the sample, and its two classes with each other: any two classes compare by no
   letter, one or two and then by ranks of the sample, which is one sort for each pair of classes;
4. adjacent suffixes are compared: one stays if it shares with a neighbour the letters that every string of ``length`` bytes
   around it must share, of these at most :data:`TOLD`.

What stays is held against bytes. Around an anchor all such strings share a core; suffixes of equal core and equal
bytes beside it are one context, contexts that come twice repeat whole, and for contexts that share only the core each string is
counted. Contexts and strings are compared by 128-bit digests, so the result is exact.

Sorts are by ranges with ties broken by place, so no repeated string, however frequent, is one task. Nothing is capped.
Each step is a table in the shared folder, dropped once nothing reads it.

Defined cases: a null text is empty; a text shorter than ``length`` is kept whole; a text that another row repeats goes whole, whatever
their keys, if it is at least that long; null keys are keys. Empty tables give no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut as written
from .common import drop_table, table

LENGTH = 400
#: Letters by which suffixes are told apart, 290 bytes on average; what shares as many is left to the comparison of bytes.
TOLD = 9
#: Bytes whose hash places an anchor.
GRAM = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX_TOO = np.uint64(0xC2B2AE3D27D4EB4F)


#: Rows that a task gathers into one batch: one for each text would cost more than its rows.
GATHERED = 20_000

#: While a table is written. Lists are gathered from sorted rows: by hashes Spark gives up at 128 texts in a task, of which there are thousands, and then
#: sorts a list of its own for each row.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.useObjectHashAggregateExec": "false"}


def cut(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, as elsewhere; what was shuffled for it goes as soon as it is written, not when the driver next
    collects its garbage, as each step here shuffles a share of the corpus."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        conf.set(key, value)
    try:
        return written(df, name)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def window(length: int) -> int:
    """The widest window of anchors with which equal strings of ``length`` bytes share three phrases."""
    if length < GRAM + 9:
        raise ValueError(f"strings of at least {GRAM + 9} bytes")
    return (length - GRAM + 3) // 6


def _slide(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """The least or largest of each ``width`` values in a row."""
    step = 1
    while 2 * step <= width:
        values = of(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return of(values[:-rest], values[rest:]) if rest else values


def anchors(data: bytes, width: int) -> np.ndarray:
    """Places whose hash is the least of a window that they are in; all of equal ones."""
    n = len(data) - GRAM + 1
    if n < width:
        return np.zeros(0, np.int64)
    grams = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8), (n, GRAM), (1, 1))
    hashes = (np.ascontiguousarray(grams).view("<u8")[:, 0] * _MIX >> np.uint64(29)).astype(np.uint32)
    least = np.zeros(n + width - 1, np.uint32)
    least[width - 1 : n] = _slide(hashes, width, np.minimum)
    return np.flatnonzero(_slide(least, width, np.maximum) == hashes)


@cache
def _bytes_by_place(width: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, size=(width + 1, 256), dtype=np.uint64)


def letters(data: bytes, at: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit letter for the phrase from each anchor to the next: sums of random numbers for (place, byte)."""
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    starts = at[:-1] - at[0]
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(at))
    return np.add.reduceat(_bytes_by_place(width).take((place << 8) + raw), starts)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX_TOO


_PHRASES = ["_n", "_size", "_h", "_g", "_at", "_letters"]


def _cut_up(length: int):
    width = window(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, digests = [], [], []
            for text in batch.column("_text").to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                digests.append(struct.unpack("<qq", hashlib.blake2b(data, digest_size=16).digest()))
                at = anchors(data, width) if len(data) >= length else np.zeros(0, np.int64)
                found.append((at, letters(data, at, width).view(np.int64) if len(at) > 3 else np.zeros(0, np.int64)))
            columns = [pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("_n"), pa.array(sizes, pa.int64()), *(pa.array([d[i] for d in digests], pa.int64()) for i in range(2)), *columns], _PHRASES)

    return run


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, k, h): a hash of the three letters from each anchor."""
    for batch in batches:
        lists = batch.column("_letters")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy().view(np.uint64)
        sizes = np.diff(offsets)
        if not len(flat):
            continue
        doc = np.repeat(np.arange(len(sizes)), sizes)
        k = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)
        whole = np.flatnonzero(k + 2 < sizes[doc])
        here = whole + offsets[0]
        h = _mixed(flat[here]) + _mixed(_mixed(flat[here + 1])) * np.uint64(3) + _mixed(_mixed(_mixed(flat[here + 2]))) * np.uint64(5)
        ids = batch.column("_n").to_numpy()[doc[whole]]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(k[whole]), pa.array(h.view(np.int64))], ["n", "k", "h"])


def alike_neighbours(df: DataFrame, order: list[str], same: list[str]) -> DataFrame:
    """Rows that agree in ``same`` with the row before or after them in ``order``, and the first and last row of each range."""
    names = df.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stays = None, True
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            equal = np.ones(rows.num_rows - 1, bool)
            for name in same:
                values = rows.column(name).to_numpy()
                equal &= values[1:] == values[:-1]
            stay = np.zeros(rows.num_rows, bool)
            stay[0] = stays
            stay[1:] |= equal
            stay[:-1] |= equal
            held, stays = rows.slice(rows.num_rows - 1), bool(stay[-1])
            yield from rows.slice(0, rows.num_rows - 1).filter(pa.array(stay[:-1])).combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(keep, df.schema).select(*names)


def _positions(length: int):
    width = window(length)
    low, high = width - 1, 2 * width - 2
    certain = length - high - width + 1 - GRAM
    names = ["n", "k", "t0", "t1", "t2", "prefix", "p", "gap", "asked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, rows = [], 0
        for batch in batches:
            for n, size, at, letter, kept in zip(*(batch.column(c) for c in ("_n", "_size", "_at", "_letters", "ks"))):
                n, size = n.as_py(), size.as_py()
                at, letter = at.values.to_numpy().astype(np.int64), letter.values.to_numpy()
                kept = np.unique(kept.values.to_numpy())
                last = np.append(np.flatnonzero(np.diff(kept) != 1), len(kept) - 1)
                run = kept[last[np.searchsorted(last, np.arange(len(kept)))]] - kept + 1
                shared = np.searchsorted(at, at[kept] + certain, "right") - 1 - kept
                place = at[kept]
                asking = (shared >= 3) & (run >= shared - 2) & (place >= low) & (place + length - high <= size)
                asking = kept[asking]
                if not len(asking):
                    continue
                all_k = np.unique(np.concatenate([asking + i for i in range(TOLD)]))
                all_k = all_k[all_k < len(letter)]
                ends = _mixed(np.array([2 * n, 2 * n + 1], np.uint64)).view(np.int64)  # no other text's letters
                padded = np.concatenate([letter, ends])
                p = at[all_k]
                m = np.minimum(np.searchsorted(at, p + certain, "right") - 1 - all_k, TOLD)
                powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(letter), _MIX_TOO | np.uint64(1)))])
                sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(letter.view(np.uint64)) * powers[: len(letter)])])
                back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(letter), np.uint64(pow(int(_MIX_TOO | np.uint64(1)), -1, 2**64)))]))
                prefix = (sums[all_k + m] - sums[all_k]) * back[all_k] + _mixed(m.astype(np.uint64))
                gap = p - np.where(all_k > 0, at[np.maximum(all_k, 1) - 1], p - width)
                asked = np.isin(all_k, asking)
                gathered.append([np.full(len(all_k), n), all_k, padded[all_k], padded[all_k + 1], padded[all_k + 2], prefix.view(np.int64), p, gap, asked])
                rows += len(all_k)
                if rows >= GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*gathered)], names)
                    gathered, rows = [], 0
        if gathered:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*gathered)], names)

    return run


_POSITIONS = "n long, k long, t0 long, t1 long, t2 long, prefix long, p long, gap long, asked boolean"


def _named(triples: DataFrame) -> DataFrame:
    """(n, k, name) of (n, k, a, b, c): the place of its triple among the distinct ones, which are sorted by ranges."""
    distinct = triples.select("a", "b", "c").distinct()
    ordered = distinct.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c")
    names = cut(ordered.withColumn("name", F.monotonically_increasing_id()), "names")
    found = cut(triples.join(names, ["a", "b", "c"]).select("n", "k", "name"), "named")
    drop_table(names)
    return found


def _ahead(steps: list[int], rows_between: int, asked: str | None, make) -> object:
    """A function of batches that are sorted by (n, k), where some rows hold a name: ``make`` gets the batch's columns and, for
    each of ``steps``, the name that many anchors further on in the same text and whether there is one. Rows are held back until what may
    follow them, at most ``rows_between`` rows on, has come."""

    def found(rows: pa.Table, until: int) -> pa.RecordBatch:
        n, k = rows.column("n").to_numpy(), rows.column("k").to_numpy()
        named = ~rows.column("name").is_null().to_numpy()
        name = rows.column("name").fill_null(0).to_numpy()
        here = np.arange(until)
        if asked:
            here = here[rows.column(asked).fill_null(False).to_numpy()[:until]]
        values = {step: (np.zeros(len(here), np.int64), np.zeros(len(here), bool)) for step in steps}
        for on in range(rows_between + 1):
            there = np.minimum(here + on, len(n) - 1)
            for step, (value, known) in values.items():
                hit = (n[there] == n[here]) & (k[there] == k[here] + step) & named[there]
                value[hit] = name[there[hit]]
                known |= hit
        return make({c: rows.column(c).to_numpy()[here] for c in rows.column_names if not rows.column(c).null_count or c not in ("name", asked)}, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            until = rows.num_rows - rows_between
            if until > 0:
                yield found(rows, until)
            held = rows.slice(max(until, 0)).combine_chunks().to_batches()
            held = held[0] if held else None
        if held is not None:
            rows = pa.Table.from_batches([held])
            yield found(rows, rows.num_rows)

    return run


def _triples_of_names(reach: int):
    def make(columns: dict, names: dict) -> pa.RecordBatch:
        n, k = columns["n"], columns["k"]
        ahead = []
        for step, (value, known) in names.items():
            own = _mixed(n.astype(np.uint64) * _MIX + (k + step).astype(np.uint64)) | np.uint64(1 << 63)
            ahead.append(pa.array(np.where(known, value, own.view(np.int64))))  # what ends is like nothing else
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(k), pa.array(columns["name"]), *ahead], ["n", "k", "a", "b", "c"])

    return _ahead([reach, 2 * reach], 4 * reach // 3, None, make)


def ranks(positions: DataFrame) -> DataFrame:
    """(n, k, name) of the sample: names in the order of the suffixes, told apart by :data:`TOLD` letters."""
    sample = positions.filter("k % 3 <> 0").select("n", "k", F.col("t0").alias("a"), F.col("t1").alias("b"), F.col("t2").alias("c"))
    names, reach = _named(sample), 3
    while reach < TOLD:
        sorted_names = names.repartition("n").sortWithinPartitions("n", "k")
        longer = _named(sorted_names.mapInArrow(_triples_of_names(reach), "n long, k long, a long, b long, c long"))
        drop_table(names)
        names, reach = longer, 3 * reach
    return names


def _comparisons(columns: dict, names: dict) -> pa.RecordBatch:
    """A row for each pair of classes that an anchor's class is in, with the key that compares suffixes of the two."""
    of = columns["k"] % 3
    r0, r1, r2 = (names[i][0] for i in range(3))
    t0, t1, zero = columns["t0"], columns["t1"], np.zeros(len(of), np.int64)
    pairs = [(1, of != 2, t0, r1, zero), (2, of != 1, t0, t1, r2), (3, of != 0, r0, zero, zero)]
    rows = [[columns[c][on] for c in ("n", "p", "gap", "prefix")] + [np.full(on.sum(), i)] + [x[on] for x in key] for i, on, *key in pairs]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], ["n", "p", "gap", "prefix", "pair", "x0", "x1", "x2"])


def merged(positions: DataFrame, names: DataFrame) -> DataFrame:
    """(n, p, gap) of the anchors that share their first letters with a neighbour in the order of some two classes."""
    kept = positions.select("n", "k", "t0", "t1", "prefix", "p", "gap", "asked")
    zero = {c: F.lit(0).cast("long") for c in ("t0", "t1", "prefix", "p", "gap")} | {"asked": F.lit(False)}
    both = kept.withColumn("name", F.lit(None).cast("long")).unionByName(names.withColumns(zero))
    dealt = both.repartition("n").sortWithinPartitions("n", "k", F.asc_nulls_first("name"))
    schema = "n long, p long, gap long, prefix long, pair long, x0 long, x1 long, x2 long"
    listed = cut(dealt.mapInArrow(_ahead([0, 1, 2], 5, "asked", _comparisons), schema), "listed")  # a sort by ranges reads twice
    found = alike_neighbours(listed, ["pair", "x0", "x1", "x2", "n", "p"], ["pair", "prefix"]).select("n", "p", "gap")
    found = cut(found, "alike")
    drop_table(listed)
    return found


def dealt_apart(counted: DataFrame) -> DataFrame:
    """What was counted by key, before it is joined with the rows of each key. As it comes, Spark would gather all rows of a key in the task that
    counted it; dealt anew, both sides are dealt for the join alone, and then a key with many rows is split."""
    return counted.hint("rebalance")


_CONTEXTS = ["n", "p", "core", "core_too", "context", "context_too", "beside", "least", "most"]


def _contexts(length: int):
    width = window(length)
    low, high = width - 1, 2 * width - 2
    side = high - low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, cores, wholes, besides = [], [], [], []

        def out() -> pa.RecordBatch:
            n, p, least, most = (np.concatenate(c) for c in zip(*gathered))
            core, whole = (np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (cores, wholes))  # two longs each
            columns = [n, p, core[:, 0], core[:, 1], whole[:, 0], whole[:, 1], pa.array(besides, pa.binary()), least, most]
            for done in (gathered, cores, wholes, besides):
                done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _CONTEXTS)

        for batch in batches:
            ends, flat = batch.column("places").offsets.to_numpy(), batch.column("places").values
            place, gaps = (flat.field(c).to_numpy() for c in ("p", "gap"))
            for n, text, begin, end in zip(*(batch.column(c).to_pylist() for c in ("_n", "_text")), ends, ends[1:]):
                data = text.encode("utf-8", "surrogatepass")
                padded = bytes(side) + data + bytes(side)
                p, first = np.unique(place[begin:end], return_index=True)  # an anchor may come once for each pair of classes
                least = np.maximum(low, p + length - len(data))
                most = np.minimum(np.minimum(low + gaps[begin:end][first] - 1, high), p)
                on = least <= most
                p, least, most = p[on], least[on], most[on]
                bounds = np.column_stack([least, most]).tobytes()
                for i, at in enumerate(p.tolist()):
                    core = hashlib.blake2b(data[at - low : at + length - high], digest_size=16).digest()
                    left, right = at - high + side, at + length - high + side
                    beside = padded[left : left + side] + padded[right : right + side]
                    cores.append(core)
                    wholes.append(hashlib.blake2b(core + beside + bounds[16 * i : 16 * i + 16], digest_size=16).digest())
                    besides.append(beside)
                gathered.append((np.full(len(p), n), p, least, most))
                if len(cores) >= GATHERED:
                    yield out()
        if cores:
            yield out()

    return run


def _repeated(found: DataFrame, length: int) -> list[DataFrame]:
    """Tables (n, first, last): stretches of places in each text at which repeated strings begin. ``found`` is dropped, and so is each table
    between as soon as it is read, since all of them are wide."""
    side = window(length) - 1
    columns = ("core", "core_too", "beside", "least", "most", "n", "p")
    contexts = found.groupBy("context", "context_too").agg(*[F.first(c).alias(c) for c in columns], F.count("*").alias("rows"))
    contexts = cut(contexts, "contexts")
    several = contexts.filter("rows > 1").select("context", "context_too")
    whole = found.select("n", "p", "context", "context_too", "least", "most").join(several, ["context", "context_too"])
    whole = cut(whole.select("n", (F.col("p") - F.col("most")).alias("first"), (F.col("p") - F.col("least")).alias("last")), "whole")
    drop_table(found)

    shared = contexts.groupBy("core", "core_too").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    strings = contexts.join(dealt_apart(shared), ["core", "core_too"]).select(
        "rows", "core", "core_too", "beside", "n", "p", F.explode(F.sequence("least", "most")).alias("d")
    )
    part = F.expr(f"substring(beside, cast({side} - (d - {side}) as int) + 1, {side})")
    string = F.xxhash64("core", "d", part).alias("s"), F.xxhash64("core_too", part, "d").alias("s_too")
    strings = cut(strings.select("rows", "n", (F.col("p") - F.col("d")).alias("first"), *string), "strings")
    drop_table(contexts)
    twice = strings.groupBy("s", "s_too").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    some = cut(strings.filter("rows = 1").join(dealt_apart(twice), ["s", "s_too"]).select("n", "first", F.col("first").alias("last")), "some")
    drop_table(strings)
    return [whole, some]


def _spans(length: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, sizes = [], [], []
            ends, flat = batch.column("marks").offsets.to_numpy(), batch.column("marks").values
            first, last = (flat.field(c).to_numpy() for c in ("first", "last"))
            for text, rows, begin, end in zip(*(batch.column(c).to_pylist() for c in ("_text", "_rows")), ends, ends[1:]):
                data = text.encode("utf-8", "surrogatepass")
                order = np.argsort(first[begin:end], kind="stable")
                starts, stops = first[begin:end][order], np.maximum.accumulate(last[begin:end][order] + length)
                if rows > 1 and len(data) >= length:
                    starts, stops = np.zeros(1, np.int64), np.array([len(data)])
                apart = np.flatnonzero(starts[1:] > stops[:-1])
                edges = np.concatenate([starts[:1], starts[apart + 1]]).tolist(), np.concatenate([stops[apart], stops[-1:]]).tolist()
                spans.append([{"start": s, "end": e} for s, e in zip(*edges)])
                kept.append(b"".join(data[s:e] for s, e in zip([0, *edges[1]], [*edges[0], len(data)])))
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], [key, "n_bytes", "spans", "kept"]
            )

    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, spans, kept): where each text holds strings of ``length`` bytes that also start anywhere else, in order and
    joined where they meet, and the bytes that are left without them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = cut(docs.select(key, whole.alias("_text")).withColumn("_n", F.monotonically_increasing_id()), "texts")
    phrases = texts.select("_n", "_text").mapInArrow(_cut_up(length), "_n long, _size long, _h long, _g long, _at array<int>, _letters array<long>")
    phrases = cut(phrases.filter(F.size("_letters") > 2), "phrases")
    ids = phrases.select("_n", "_h", "_g")
    groups = ids.groupBy("_h", "_g").agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    rows = cut(ids.join(dealt_apart(groups), ["_h", "_g"]).select("_n", "_first", "_rows"), "rows")

    triples = phrases.select("_n", "_letters").mapInArrow(_triples, "n long, k long, h long")
    shared = cut(alike_neighbours(triples, ["h", "n", "k"], ["h"]), "shared")
    firsts = rows.filter("_n = _first").select(F.col("_n").alias("n"))
    kept = shared.join(firsts, "n").groupBy(F.col("n").alias("_n")).agg(F.collect_list("k").alias("ks"))
    columns = phrases.drop("_h", "_g").join(kept, "_n")
    positions = cut(columns.mapInArrow(_positions(length), _POSITIONS), "positions")
    drop_table(shared)
    drop_table(phrases)

    names = ranks(positions)
    alike = merged(positions, names)
    drop_table(names)
    drop_table(positions)
    places = alike.groupBy(F.col("n").alias("_n")).agg(F.collect_list(F.struct("p", "gap")).alias("places"))
    found = texts.select("_n", "_text").join(places, "_n").mapInArrow(
        _contexts(length), ", ".join(f"{c} {'binary' if c == 'beside' else 'long'}" for c in _CONTEXTS)
    )
    found = cut(found, "around")
    drop_table(alike)

    whole, some = _repeated(found, length)
    marks = whole.unionByName(some).groupBy(F.col("n").alias("_n")).agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    told = cut(rows.select("_n", "_rows").join(marks, "_n", "left"), "marks")
    for done in (whole, some, rows):
        drop_table(done)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    whole = texts.join(told, "_n", "left").select(key, "_text", F.coalesce("_rows", F.lit(1)).alias("_rows"), F.coalesce("marks", F.array()).alias("marks"))
    return whole.mapInArrow(_spans(length, key), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
