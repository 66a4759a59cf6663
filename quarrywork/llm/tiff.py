"""TIFF: building and decoding baseline images, a row for each page.

The decoder walks the image file directories, undoes the compression of strips or tiles (none, PackBits, LZW,
deflate) and the predictor (none, horizontal differencing) and gives each page's samples as they were before.
Both byte orders are read. 8-bit samples, any number of them for a pixel, in chunky order.

Bytes that aren't an image are stored as one: ``payload_image`` lays them out as rows of ``WIDTH`` grey samples, in
strips, or in tiles if they need more than one strip; with deflate and horizontal differencing, or with PackBits
where most bytes repeat the one before.

What a file claims is held against its size before anything is made of it: no compression gives more than
``EXPANDS`` times its bytes.

Defined cases: null or empty texts make a payload of one padded row. Data that is no TIFF, or is cut off, or names
a compression that isn't known raises ``ValueError``; in ``pages`` such a row gives one row with page -1 and
the message in ``error``, and a null gives none. Repeated rows give equal rows. A directory chain with a loop is
an error. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Samples in a row of a payload's image, and the byte that fills up the last row.
WIDTH, FILL = 192, b" "
#: Rows of a strip and of a page. A longer payload has several pages.
STRIP_ROWS, PAGE_ROWS = 256, 4096
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: The most bytes that one byte of each compression can become.
EXPANDS = {NONE: 1, PACKBITS: 64, LZW: 1400, DEFLATE: 1033, OLD_DEFLATE: 1033}
#: Side of a tile in a payload's image.
TILE = 64
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


# --- compressions -----------------------------------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    """One row's bytes; runs don't cross rows."""
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while at + run < n and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < n and end - at < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(data):
            raise ValueError("PackBits data ends early")
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, that grow one code early, as TIFF wants them."""
    bits, have, out = 0, 0, bytearray()
    codes: dict[bytes, int] = {}
    following, width = 258, 9

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = (bits << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in codes:
            word = longer
            continue
        put(codes[word] if len(word) > 1 else word[0])
        codes[longer] = following
        following += 1
        if following == 4095:
            put(256)
            codes, following, width = {}, 258, 9
        elif following + 1 > 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(codes[word] if len(word) > 1 else word[0])
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out: list[bytes] = []
    made = 0
    bits, have, at, width = 0, 0, 0, 9
    entries: list[bytes] = []
    last = b""
    while made < size:
        while have < width:
            if at >= len(data):
                raise ValueError("LZW data ends early")
            bits, have, at = (bits << 8 | data[at]) & 0xFFFFFF, have + 8, at + 1
        code = bits >> (have - width) & ((1 << width) - 1)
        have -= width
        if code == 257:
            break
        if code == 256:
            entries, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if code < len(entries):
            word = entries[code]
        elif last and code == len(entries):
            word = last + last[:1]
        else:
            raise ValueError("LZW data has a code that isn't known yet")
        if last and len(entries) < 4096:
            entries.append(last + word[:1])
            if len(entries) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(word)
        made += len(word)
        last = word
    return b"".join(out)[:size]


def compress(data: bytes, kind: int, row: int) -> bytes:
    """``row`` is the number of bytes in a row."""
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return b"".join(packbits_encode(data[at : at + row]) for at in range(0, len(data), row))
    if kind == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1)


def decompress(data: bytes, kind: int, size: int) -> bytes:
    if kind == NONE:
        out = data[:size]
    elif kind == PACKBITS:
        out = packbits_decode(data, size)
    elif kind == LZW:
        out = lzw_decode(data, size)
    elif kind in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as error:
            raise ValueError(f"bad deflate data: {error}") from None
    else:
        raise ValueError(f"compression {kind} isn't known")
    if len(out) != size:
        raise ValueError("a strip or tile has too few bytes")
    return out


# --- files ------------------------------------------------------------------------------------------------


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    chunks: int
    data: bytes


def _directory(file: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    if at + 2 > len(file):
        raise ValueError("a directory lies beyond the end")
    count = struct.unpack_from(order + "H", file, at)[0]
    if at + 6 + 12 * count > len(file):
        raise ValueError("a directory is cut off")
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", file, at + 2 + 12 * i)
        size = _SIZES.get(kind, 1) * n
        place = at + 10 + 12 * i
        if size > 4:
            place = struct.unpack_from(order + "I", file, place)[0]
        if place + size > len(file):
            raise ValueError(f"tag {tag} lies beyond the end")
        if kind in (1, 3, 4):
            tags[tag] = list(struct.unpack_from(f"{order}{n}{'BHI'[(1, 3, 4).index(kind)]}", file, place))
    return tags, struct.unpack_from(order + "I", file, at + 2 + 12 * count)[0]


def decode(file: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(file[:4]))
    if order is None or len(file) < 8:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", file, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        tags, at = _directory(file, at, order)
        yield _page(file, tags)


def _page(file: bytes, tags: dict[int, list[int]]) -> Page:
    one = lambda tag, other: tags.get(tag, [other])[0]
    width, height, samples = one(256, 0), one(257, 0), one(277, 1)
    kind, predictor = one(259, NONE), one(317, 1)
    if not width or not height or any(b != 8 for b in tags.get(258, [1])) or one(284, 1) != 1 or predictor not in (1, 2):
        raise ValueError("only chunky 8-bit samples, with or without horizontal differencing, are read")
    tiled = 322 in tags
    across, down = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    if not across or not down:
        raise ValueError("a page has no extent")
    offsets, sizes = (tags.get(324, []), tags.get(325, [])) if tiled else (tags.get(273, []), tags.get(279, []))
    columns, rows = -(-width // across), -(-height // down)
    if len(offsets) < columns * rows or len(sizes) < columns * rows:
        raise ValueError("a page has too few strips or tiles")
    if kind not in EXPANDS:
        raise ValueError(f"compression {kind} isn't known")
    held = sum(min(n, len(file)) for n in sizes[: columns * rows])
    if height * width * samples > EXPANDS[kind] * held or down * across * samples > EXPANDS[kind] * len(file):
        raise ValueError("a page is said to be larger than its bytes can be")
    out = np.empty((height, width, samples), np.uint8)
    for i in range(columns * rows):
        top, left = i // columns * down, i % columns * across
        high = down if tiled else min(down, height - top)
        if offsets[i] + sizes[i] > len(file):
            raise ValueError("a strip or tile lies beyond the end")
        raw = decompress(file[offsets[i] : offsets[i] + sizes[i]], kind, high * across * samples)
        block = np.frombuffer(raw, np.uint8).reshape(high, across, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        part = out[top : top + high, left : left + across]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return Page(width, height, samples, kind, predictor, columns * rows, out.tobytes())


def encode(
    pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, order: str = "<"
) -> bytes:
    """A file of pages given as height x width x samples; in strips, or in square tiles of a multiple of 16."""
    file = bytearray({"<": b"II*\0", ">": b"MM\0*"}[order] + b"\0\0\0\0")
    link = 4
    for pixels in pages:
        height, width, samples = pixels.shape
        across, down = (tile, tile) if tile else (width, STRIP_ROWS)
        offsets, sizes = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                block = pixels[top : top + down, left : left + across]
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)), "edge")
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                packed = compress(np.ascontiguousarray(block).tobytes(), compression, block.shape[1] * samples)
                offsets.append(len(file))
                sizes.append(len(packed))
                file += packed
        if len(file) % 2:
            file.append(0)
        place = (324, 325) if tile else (273, 279)
        tags = {256: [width], 257: [height], 258: [8] * samples, 259: [compression], 262: [1 if samples < 3 else 2]}
        tags |= {277: [samples], 317: [predictor], place[0]: offsets, place[1]: sizes}
        tags |= {322: [tile], 323: [tile]} if tile else {278: [down]}
        entries, outside = b"", bytearray()
        beyond = len(file) + 6 + 12 * len(tags)
        for tag in sorted(tags):
            short = tag in (258, 259, 262, 277, 317)
            values = struct.pack(f"{order}{len(tags[tag])}{'H' if short else 'I'}", *tags[tag])
            if len(values) > 4:
                values, at = struct.pack(order + "I", beyond + len(outside)), outside.extend(values)
            entries += struct.pack(order + "HHI", tag, 3 if short else 4, len(tags[tag])) + values.ljust(4, b"\0")
        struct.pack_into(order + "I", file, link, len(file))
        link = len(file) + 2 + 12 * len(tags)
        file += struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + outside
        if len(file) % 2:
            file.append(0)
    return bytes(file)


def payload_image(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the file that holds them, filled up, as grey samples)."""
    data = (text or "").encode("utf-8", "replace")
    size = max(1, -(-len(data) // WIDTH)) * WIDTH
    pixels = np.frombuffer(data.ljust(size, FILL), np.uint8).reshape(-1, WIDTH, 1)
    pages = [pixels[at : at + PAGE_ROWS] for at in range(0, len(pixels), PAGE_ROWS)]
    samples = pixels.reshape(-1)
    if 2 * np.count_nonzero(samples[1:] == samples[:-1]) > len(samples):
        return len(data), encode(pages, PACKBITS)
    return len(data), encode(pages, DEFLATE, 2, TILE if len(pixels) > STRIP_ROWS else 0)


def feature(data: bytes, pages: int) -> str:
    """A few statistics of the samples that are read back."""
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = count[count > 0] / len(data)
    mean = float(count @ np.arange(256)) / len(data)
    entropy = float(-(share * np.log2(share)).sum())
    return f"pages={pages};rows={len(data) // WIDTH};values={len(share)};mean={mean:.3f};entropy={entropy:.3f}"


# --- tables -----------------------------------------------------------------------------------------------


def images(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text stored as an image."""

    @F.pandas_udf("n_bytes long, media binary")
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([payload_image(t) for t in batch], columns=["n_bytes", "media"])

    return docs.select(key, build(F.col(text)).alias("built")).select(key, "built.*")


def pages(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each page of each file."""
    kind = dict(media.dtypes)[key]
    names = ["page", "width", "height", "samples", "compression", "predictor", "chunks", "data", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, file in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                rows = []
                try:
                    for i, p in enumerate(decode(file) if file is not None else ()):
                        rows.append((name, i, *p.__dict__.values(), None))
                except ValueError as error:
                    rows = [(name, -1, *[None] * 7, str(error))]
                yield pd.DataFrame(rows, columns=[key, *names], dtype=object)

    schema = f"`{key}` {kind}, page int, width int, height int, samples int, compression int, predictor int, chunks int, "
    return media.select(key, column).mapInPandas(run, schema + "data binary, error string")


def digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is read back from each file, by the decoder that :func:`pages` uses, summed up where it is read."""
    schema = (
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )

    @F.pandas_udf(schema)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file in batch:
                found = [p.data for p in decode(file)]
                data = b"".join(found)
                rows.append(
                    (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(file))
                    + (hashlib.sha256(file).hexdigest(), feature(data, len(found)))
                )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return media.select(key, "n_bytes", read(F.col("media")).alias("r")).select(key, "n_bytes", "r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(images(table(spark, sf_dir, "documents")))
