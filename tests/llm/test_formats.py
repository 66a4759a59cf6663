import gzip
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from quarrywork.llm import bpe, packing, tiff, warc

TEXTS = [
    None, "", " ", "plain words, and more.", "Café J\u030Cabc A\u030Aa \u212Abc Straße ÉÀ. ŉ ĳ ſ ẞ İx ΣΑΣ", "<|endoftext|> it's don't",
    "a" * 30_000, " \n\n " * 9000 + "z", "x " * 30_000, "日本語 テキスト 12 ٣٤ 🙂", "tab\tand\x1cgaps\xa0here\u2003too",
]


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path(bpe.RANKS)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    both = bpe.decoded(bpe.encoded(docs, path), path).collect()
    for r in both:
        assert list(r.tokens) == bpe.encoding(path).encode_ordinary(r.text or "")
        assert bytes(r.bytes) == (r.text or "").encode()
    digests = {r.doc_id: r for r in bpe.digests(docs, path).collect()}
    assert digests[0].n_tokens == digests[1].n_tokens == 0
    assert "".join(bpe.pieces(TEXTS[-3], 100)) == TEXTS[-3]


def test_bpe_of_long_runs_of_white_space():
    path = public_tokenizers.path(bpe.RANKS)
    for gap in (" " * 12_000, "\n" * 12_001, " \t\u3000" * 5000):
        for text in (gap, "a" + gap, gap + "b c", f"x!{gap}\x1c", f"a {gap}b{gap}'s\u00a0"):
            assert bpe.encode(text, path) == bpe.encoding(path).encode_ordinary(text)
    huge = "a" + " " * 1_000_000 + "b"
    assert bpe.decode(bpe.encode(huge, path), path) == huge.encode()


def test_bpe_of_a_run_of_letters_that_goes_to_the_library_whole():
    path = public_tokenizers.path(bpe.RANKS)
    text = "ab" * 50_000 + " " + "é" * 40_000
    assert bpe.encode(text, path) == bpe.encoding(path).encode_ordinary(text)


def test_bpe_defined_cases(spark):
    path = public_tokenizers.path(bpe.RANKS)
    docs = spark.createDataFrame([(1, "a b", 9, "t"), (1, "a b", 9, "t"), (None, None, None, None)], "doc_id long, text string, n_tokens int, t string")
    got = bpe.digests(docs, path)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect()) == [(0, 0), (1, 2), (1, 2)]
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_packing_words_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    words, library = packing.words(path), Tokenizer.from_file(path)
    more = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "a<|ENDOFTEXT|>", "<| endoftext|> <|endoftext|", "<|endoftext|> <|endoftext|>Word"]
    for text in [*TEXTS, *more, *TEXTS]:
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert words.encode(text) == np.array(expected, "<u4").tobytes(), text
    assert np.frombuffer(words.encode("a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]


def check_pieces(docs, rows, window):
    by_doc, by_sequence = {}, {}
    for doc, start, length, crc, total, sequence, offset in rows:
        assert zlib.crc32(docs[doc][4 * start : 4 * (start + length)]) == crc and total == len(docs[doc]) // 4
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for doc, data in docs.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at and length > 0
            at += length
        assert at == len(data) // 4
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("limit", [5, 4096])
def test_packing_leaves_no_padding(limit):
    rng = np.random.default_rng(4)
    docs = {i: rng.integers(0, 9, int(n)).astype("<u4").tobytes() for i, n in enumerate(rng.integers(1, 300, 700))}
    assert check_pieces(docs, list(packing.pack(docs.items(), 128, limit)), 128) == 0


def test_sum_of_squares_choice():
    rng = np.random.default_rng(5)
    levels = packing.SumOfSquares(32)
    for size in rng.integers(1, 33, 500):
        before = levels.count.copy()
        found = levels.level_for(int(size))

        def cost(level):
            after = before.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            return int((after**2).sum())

        possible = [h for h in range(0, 33 - size) if not h or before[h]]
        assert cost(found) == min(map(cost, possible))
        levels.place(int(size))


def test_packing_table(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int")
    path = public_tokenizers.path(packing.TOKENIZER)
    encode = packing.words(path).encode
    data = {i: encode(t) + b"\2\0\0\0" for i, t in enumerate(TEXTS)}
    rows = [tuple(r) for r in packing.packed(docs, path).collect()]
    assert check_pieces(data, rows, packing.WINDOW) == 0
    assert packing.packed(docs.filter("doc_id < 0"), path).count() == 0


def test_warc_round_trip(spark):
    long = "<p>" + "x" * 200
    pages = [(1, "http://a/", long), (2, "u\r\nv", long), (3, None, long), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short")]
    pages += [(None, "u", long), (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 40), (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 40)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    archives = warc.write_archives(warc.with_decisions(frame))
    normal = warc.normalise_archives(archives)
    got = warc.read_records(normal).collect()
    assert len(got) == len(pages)
    for r in got:
        if r.record_type == "response":
            assert bytes(r.payload).decode() in {p[2] or "" for p in pages if p[0] == r.page_id}
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds[:4] == [(0, "revisit", 1), (1, "response", None), (2, "revisit", 1), (3, "revisit", 1)]
    assert all(k[1] == "response" for k in kinds[4:])
    for r in normal.collect():  # every member is a whole gzip file, and all of them are the archive
        parts = [gzip.decompress(bytes(r.data[i.offset : i.offset + i.length])) for i in r["index"]]
        assert b"".join(parts) == gzip.decompress(bytes(r.data))
        assert all(p.startswith(b"WARC/1.1") for p in parts)
    assert warc.read_records(warc.normalise_archives(warc.write_archives(warc.with_decisions(frame.filter("page_id < 0"))))).count() == 0


def test_warc_refuses_damage():
    one = gzip.compress(warc.record(1, "u", b"abc", "d"))
    with pytest.raises(ValueError):
        warc.normalise(gzip.compress(warc.record(1, "u", b"abc", "d")[:-9]))
    with pytest.raises(ValueError):
        warc.normalise(gzip.compress(b"no record\r\n\r\n"))
    assert warc.normalise(one + one)[1][1][0] > 0


def test_tiff_round_trips():
    rng = np.random.default_rng(6)
    for _ in range(60):
        height, width, samples = (int(x) for x in (rng.integers(1, 400), rng.integers(1, 60), rng.integers(1, 4)))
        pages = [rng.integers(0, rng.choice([2, 256]), (height, width, samples)).astype(np.uint8) for _ in range(2)]
        kind = int(rng.choice([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]))
        file = tiff.encode(pages, kind, int(rng.integers(1, 3)), int(rng.choice([0, 16])), str(rng.choice(["<", ">"])))
        assert [p.data for p in tiff.decode(file)] == [p.tobytes() for p in pages]


def test_tiff_tables(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    media = tiff.images(docs)
    got = {r.doc_id: r for r in tiff.digests(media).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].tail_crc32) == (len(data), len(padded), zlib.crc32(padded[-16:]))
    rows = tiff.pages(media.union(spark.createDataFrame([(50, 0, b"junk"), (51, 0, None)], media.schema))).collect()
    assert [r.error for r in rows if r.doc_id == 50] == ["not a TIFF file"] and not [r for r in rows if r.doc_id == 51]
    assert b"".join(bytes(r.data) for r in rows if r.doc_id == 6).startswith(b"a" * 30_000)


def test_tiff_compressions_of_the_specifications():
    """The worked examples of the public descriptions of PackBits and of TIFF's LZW."""
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed, len(plain)) == plain and tiff.packbits_encode(plain) == packed
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    stored = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_decode(stored, len(data)) == data and tiff.lzw_encode(data) == stored


def test_packbits_runs_do_not_cross_rows():
    stored = tiff.compress(b"\0" * 40, tiff.PACKBITS, 10)
    assert stored == bytes([257 - 10, 0]) * 4


def test_tiff_lzw_widths():
    """Codes that grow to twelve bits and a table that is cleared, held against a decoder written here by the rule alone."""
    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, 30_000).astype(np.uint8).tobytes() + b"\1" * 40_000
    stored = tiff.lzw_encode(data)
    bits, at, width, table, last, out = int.from_bytes(stored, "big"), 8 * len(stored), 9, {}, b"", bytearray()
    while True:
        at -= width
        code = bits >> at & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = {i: bytes([i]) for i in range(256)}, 9, b""
            fresh = 258
            continue
        word = table.get(code, last + last[:1])
        out += word
        if last:
            table[fresh] = last + word[:1]
            fresh += 1
        width = next(w for w in (9, 10, 11, 12) if fresh + 1 < 1 << w or w == 12)
        last = word
        if len(out) > 3000 and len(out) % 7 == 0:
            bits &= (1 << at) - 1
    assert bytes(out) == data


def test_tiff_claims_beyond_the_file(spark):
    pixels = np.zeros((4, 4, 1), np.uint8)
    for kind in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        file = bytearray(tiff.encode([pixels], kind))
        at = int.from_bytes(file[4:8], "little") + 2
        for i in range(12):
            if int.from_bytes(file[at + 12 * i : at + 12 * i + 2], "little") in (256, 257):
                file[at + 12 * i + 8 : at + 12 * i + 12] = (1 << 21).to_bytes(4, "little")
        with pytest.raises(ValueError):
            list(tiff.decode(bytes(file)))
        rows = tiff.pages(spark.createDataFrame([(1, bytes(file))], "doc_id long, media binary")).collect()
        assert [r.page for r in rows] == [-1] and rows[0].error


def test_tiff_defined_cases(spark):
    long = "line of a long text %d\n"
    texts = ["", "abcdefgh " * 40, "same " * 3, "=" * 70_000, "".join(long % i for i in range(60_000)), "abcdefgh " * 40]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, media string")
    media = tiff.images(docs)
    rows = tiff.pages(media).collect()
    kinds = {r.doc_id: (r.compression, r.chunks) for r in rows}
    assert kinds[0][0] == kinds[3][0] == tiff.PACKBITS and kinds[1] == (tiff.DEFLATE, 1) and kinds[4][1] > 100
    assert max(r.page for r in rows if r.doc_id == 4) >= 1
    for i, t in enumerate(texts):
        data = b"".join(bytes(r.data) for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.page))
        assert data.startswith(t.encode()) and set(data[len(t.encode()) :]) <= {32}
    got = tiff.digests(media).collect()
    assert len(got) == 6 and len({r.media_sha256 for r in got}) == 5 and got[1].feature == got[5].feature
    assert tiff.digests(tiff.images(docs.limit(0))).count() == 0


def test_warc_of_a_long_payload_and_clashing_columns(spark):
    page = "<p>" + "".join(chr(97 + i % 26) for i in range(12_000_000))
    rows = [(1, "u", page, "d", 5), (2, "u", page, "d", 5), (3, "u", "é" * 200, "d", 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to int")
    got = warc.read_records(warc.normalise_archives(warc.write_archives(warc.with_decisions(frame)))).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in got) == [
        (1, "response", len(page)), (2, "revisit", len(page)), (3, "response", 400)]


def test_packing_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 3), (1, "a b c", 3), (2, None, 4), (2, None, 4)], "doc_id long, text string, length int").coalesce(1)
    rows = packing.packed(docs, public_tokenizers.path(packing.TOKENIZER)).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in rows) == [(1, 4), (1, 4), (2, 1), (2, 1)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_tiff_refuses_damage():
    file = tiff.payload_image("some text " * 50)[1]
    rng = random.Random(7)
    for _ in range(200):
        broken = bytearray(file)
        broken[rng.randrange(len(broken))] ^= 1 << rng.randrange(8)
        try:
            list(tiff.decode(bytes(broken[: rng.randrange(1, len(broken))])))
        except ValueError:
            pass
