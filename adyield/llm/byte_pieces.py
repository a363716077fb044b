"""Byte-level BPE through a sentencepiece model built from the rank file.

The vocabulary's byte strings become pieces by mapping every byte to one
printable code point; a piece's score is its negative rank, so the best
scoring merge is the lowest rank, and the normaliser is the identity. The
model is serialised here field by field (protocol buffer wire format), loaded
by sentencepiece, and encodes each pre-token of the split pattern by itself;
a pre-token that is itself a vocabulary entry is its own id. Decoding maps
ids back to bytes through the same vocabulary.

Null texts are empty: no ids, and the hash of no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import slices, worker_model

CACHE = 80_000               # distinct pre-tokens kept per worker


def byte_letters() -> list[str]:
    """One printable code point per byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    if isinstance(value, bool) or isinstance(value, int):
        return _varint(number << 3) + _varint(int(value))
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file in rank order (ranks run from 0 without gaps)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in ranks]


def model_bytes(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the unknown piece follows the last rank."""
    letters = byte_letters()
    pieces = b"".join(_field(1, _field(1, "".join(letters[b] for b in token)) + _field(2, float(-rank)))
                      for rank, token in enumerate(vocabulary))
    unknown = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    size = len(vocabulary) + 1
    off = (1 << 64) - 1                                # -1: no such control piece
    trainer = (_field(3, 2) + _field(4, size) + _field(40, size - 1) + _field(41, off) + _field(42, off)
               + _field(43, off))
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = read_ranks(path)
        self.letters = byte_letters()
        self.split = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.vocabulary))
        self.known = self._whole()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(self.letters)})

    def _whole(self) -> dict[str, bytes]:
        """Vocabulary entries that are texts: each is its own id."""
        out = {}
        for rank, token in enumerate(self.vocabulary):
            try:
                out[token.decode()] = struct.pack("<I", rank)
            except UnicodeDecodeError:
                pass
        return out

    def learn(self, tokens: list[str]) -> None:
        """Encode pre-tokens that are not yet known."""
        mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for t in tokens]
        for token, ids in zip(tokens, self.model.encode(mapped, num_threads=1)):
            self.known[token] = np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        tokens = self.split.findall(text)
        if missing := [t for t in set(tokens) if t not in self.known]:
            if len(self.known) + len(missing) > CACHE + len(self.vocabulary):
                self.known = self._whole()
                missing = [t for t in set(tokens) if t not in self.known]
            self.learn(missing)
        return b"".join(map(self.known.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    return worker_model(("codec", path, pattern), lambda: Codec(path, pattern))


def tokenise(documents: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (binary; optional), n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    ``path`` is read on the executors: the vocabulary file is installed with the tokenizer package there.
    """
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text"):
                c = codec(path, pattern)
                ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
                out = {"doc_id": part.column("doc_id")} | ({"ids": pa.array(ids, pa.binary())} if with_ids else {})
                yield pa.RecordBatch.from_pydict(out | {
                    "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(c.decode(i)).hexdigest() for i in ids]})

    ids = "ids binary, " if with_ids else ""
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, {ids}n_tokens bigint, ids_sha256 string, decoded_sha256 string")
