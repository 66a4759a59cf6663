"""Byte-level BPE with the tiktoken library and a local file of ranks.

Texts are encoded whole. Before a long text reaches the library it is cut at safe boundaries: in front of
white space that follows something else. No alternative of the pattern matches across such a place and none
looks behind, so the pieces' tokens, one after the other, are the text's. Decoding joins the tokens' raw bytes,
so it is exact even where a token holds part of a character.

The pattern backtracks over a run of white space, which overflows the library's stack in runs of about a million.
Of a long run, all but a last character that something follows is one match of the pattern, so it is encoded as that.

Defined cases: null texts are empty texts, with no token. Strings that look like special tokens are ordinary
text. Lone surrogates can't occur in Spark strings. Repeated rows give equal rows; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RANKS = "byte_bpe_50k.tiktoken"
#: Characters after which a text is cut at the next safe boundary.
PIECE = 16_384
#: A run of one kind that is longer than this has no boundary inside and goes to the library whole. Python's white
#: space is more than the library's, so only characters that are white space to both are cut in front of.
BOUNDARY = re.compile(r"(?<=\S)(?=[ \t\n\r])")
#: A match of white space alone that is too long for the pattern, in the library's sense of white space.
LONG_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, length: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``length`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > length:
        cut = BOUNDARY.search(text, at + length)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, path: str) -> list[int]:
    tokens: list[int] = []
    for piece in pieces(text or ""):
        at = 0
        for gap in LONG_GAP.finditer(piece):
            end = gap.end() - (gap.end() < len(piece))
            tokens += encoding(path).encode_ordinary(piece[at : gap.start()])
            tokens += encoding(path)._encode_single_piece(piece[gap.start() : end])
            at = end
        tokens += encoding(path).encode_ordinary(piece[at:])
    return tokens


def decode(tokens: Iterable[int], path: str) -> bytes:
    return encoding(path).decode_bytes(list(tokens))


def encoded(docs: DataFrame, path: str, text: str = "text", into: str = "tokens") -> DataFrame:
    """``docs`` with the text's ids as an array. One pass, no shuffle."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([encode(t, path) for t in batch])

    return docs.withColumn(into, ids(F.col(text)))


def decoded(docs: DataFrame, path: str, tokens: str = "tokens", into: str = "bytes") -> DataFrame:
    """``docs`` with the raw bytes that the ids stand for."""

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([decode([] if t is None else t, path) for t in batch], dtype=object)

    return docs.withColumn(into, raw(F.col(tokens)))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): a text's round trip, without moving its ids between processes."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def trip(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [str(i) for i in range(encoding(path).max_token_value + 1)]
        for batch in batches:
            rows = []
            for value in batch:
                tokens = encode(value, path)
                listed = " ".join(map(names.__getitem__, tokens))
                back = decode(tokens, path)
                rows.append((len(tokens), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, trip(F.col(text)).alias("t")).select(key, "t.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
