"""Encoding of a corpus with a public byte-level BPE vocabulary, by a sentencepiece model.

The model is written directly from the vocabulary: every token is a piece in the usual
byte-to-letter mapping, its score the negative rank, normalisation the identity. Texts
are cut into pre-tokens by the tokenizer's pattern, mapped, encoded and numbered by rank.
Decoding is the inverse mapping.

Defined results: NULL and empty texts give an empty list; strings of special tokens are
ordinary text; texts are encoded whole, whatever their length. A column of the result's
name that is there already is replaced.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED = 200_000


def byte_letters() -> list[str]:
    """A printable letter for each byte: printable bytes stand for themselves, the rest follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def vocabulary(path: str = DEFAULT_VOCABULARY) -> list[bytes]:
    """The tokens by rank."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without a gap")
    return [token for _, token in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece 0 is unknown, piece r + 1 the token of rank r."""
    letters = dict(enumerate(byte_letters()))
    score = lambda x: _varint(2 << 3 | 5) + struct.pack("<f", x)
    pieces = [_bytes_field(1, b"<unk>") + score(0.0) + _int_field(3, 2)]
    for rank, token in enumerate(tokens):
        pieces.append(_bytes_field(1, token.decode("latin-1").translate(letters).encode()) + score(-float(rank)) + _int_field(3, 1))
    none = (1 << 64) - 1  # -1 as a varint: no such piece
    trainer = _int_field(3, 2) + _int_field(4, len(pieces)) + _int_field(40, 0) + b"".join(_int_field(k, none) for k in (41, 42, 43))
    normaliser = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return b"".join(_bytes_field(1, p) for p in pieces) + _bytes_field(2, trainer) + _bytes_field(3, normaliser)


class Encoder:
    """Texts to ids and back, over one serialised model."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(PATTERN)
        self.letters = dict(enumerate(byte_letters()))
        self.bytes = {ord(c): b for b, c in self.letters.items()}
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in self.known})
        mapped = [p.encode().decode("latin-1").translate(self.letters) for p in new]
        fresh = dict(zip(new, ([i - 1 for i in ids] for ids in self.processor.encode(mapped, num_threads=1)))) if new else {}
        known = self.known
        out = [[i for p in pieces for i in (known.get(p) or fresh[p])] for pieces in cut]
        if len(known) + len(fresh) > CACHED:
            known.clear()
        for p, ids in fresh.items():
            if len(p) <= 40 and len(known) < CACHED:
                known[p] = ids
        return out

    def decode(self, ids: list[int]) -> str:
        letters = "".join(self.processor.id_to_piece(int(i) + 1) for i in ids)
        return letters.translate(self.bytes).encode("latin-1").decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def _model(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(serialise(vocabulary(path)))


#: Texts handed to the encoder at once, counted in characters; a longer text goes alone.
BATCH_CHARS = 4_000_000


def _in_parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t) if t else 0
        if chars > BATCH_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` (all but the text by default) with ``ids``, an array of int."""
    keep = [c for c in df.columns if c not in (text, "ids")] if keep is None else keep
    model = _model(df, path)
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model.value)
        for frame in frames:
            texts = frame[text].tolist()
            for lo, hi in _in_parts(texts):
                out = frame[keep].iloc[lo:hi].copy()
                out["ids"] = encoder.encode(texts[lo:hi])
                yield out

    return df.select(*keep, text).mapInPandas(batches, f"{schema}ids array<int>")


def counted(df: DataFrame, text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """All columns but the text, with ``n_tokens``; the ids never leave the workers."""
    keep = [c for c in df.columns if c not in (text, "n_tokens")]
    model = _model(df, path)
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model.value)
        for frame in frames:
            texts = frame[text].tolist()
            for lo, hi in _in_parts(texts):
                out = frame[keep].iloc[lo:hi].copy()
                out["n_tokens"] = [len(ids) for ids in encoder.encode(texts[lo:hi])]
                yield out

    return df.select(*keep, text).mapInPandas(batches, f"{schema}n_tokens bigint")


def decoded(df: DataFrame, ids: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with ``text`` made from ``ids``; an empty list gives an empty text."""
    model = _model(df, path)

    @F.pandas_udf("string")
    def text(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(model.value)
        for part in lists:
            yield part.map(encoder.decode)

    return df.withColumn("text", text(F.col(ids)))
