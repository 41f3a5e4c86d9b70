"""Byte-level BPE through a sentencepiece model that is serialised directly from a vocabulary.

A vocabulary of byte strings with ranks becomes a sentencepiece BPE model without any training: each
byte is mapped to one character, each token to the piece of its characters, scored by its negative
rank, with identity normalisation (no prefix, no white-space rules).  Sentencepiece merges the
neighbours whose piece has the highest score first, leftmost on ties, which is the merge order of the
ranks.  Each match of the splitting pattern is encoded by itself.  A match that is a token is that
token even where merges do not lead to it, as in rank-based encoders.  Decoding maps ids back to
their byte strings.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from hunkwise.llm import textvec as tv

SHIFT = 0x100  # byte b stands as the character U+0100 + b
MEMO = 200_000


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def characters(token: bytes) -> str:
    return "".join(chr(SHIFT + b) for b in token)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model of tokens in rank order; the piece of rank r has id r + 1, id 0 is unknown."""
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))
    pieces = [piece("<unk>", 0.0, 2)] + [piece(characters(t), -float(r), 1) for r, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank of a rank file: lines of a token in base64 and its rank, from 0 without gaps."""
    ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, data.splitlines()) if t}
    tokens = [ranks[r] for r in range(len(ranks))]
    missing = {bytes([b]) for b in range(256)} - set(tokens)
    if missing:
        raise ValueError(f"{len(missing)} single bytes have no rank")
    return tokens


class _Memo(dict):
    """Ids of pre-tokens as little-endian 32-bit bytes; emptied when it is full."""

    def __init__(self, codec: "Codec"):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = self.codec.encode_piece(piece.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = out
        return out


class Codec:
    """Encodes texts to ids by a vocabulary and a splitting pattern, and decodes ids to bytes."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.ranks = {t: r for r, t in enumerate(tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.split = regex.compile(pattern).findall
        self.memo = _Memo(self)

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        return [i - 1 for i in self.model.EncodeAsIds(piece.decode("latin-1").translate(_UP))]

    def encode_bytes(self, text: str) -> bytes:
        """All ids of a text, each as four bytes, least first."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_UP = {b: SHIFT + b for b in range(256)}
_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(data, pattern: str) -> Codec:
    """One codec a worker process, whatever number of tasks it runs."""
    key = (hash(data.value), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(data.value), pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit) to all columns of ``docs``.

    ranks: the content of a rank file (of the size of a vocabulary, not of the input).  Null text is
    encoded as empty: no ids, an empty binary.  A column of the name ``ids`` is replaced.
    """
    return _mapped(docs.drop("ids"), ranks, pattern, text, "ids", lambda codec, arr: [codec.encode_bytes(t or "") for t in arr.to_pylist()])


def decode_documents(docs: DataFrame, ranks: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for; null ids decode to no bytes."""
    return _mapped(docs.drop("decoded"), ranks, pattern, ids, "decoded", lambda codec, arr: [codec.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in arr.to_pylist()])


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``encode_documents`` and ``decode_documents`` in one pass over the rows.

    Null and empty texts have no id.  Texts may be of any length, each match of the pattern is encoded by
    itself.  Of merges of equal rank the leftmost goes first.  Repeated rows are kept; an empty table
    gives no row.  All columns pass through, but for columns named ids or decoded, which are replaced.
    """

    def both(codec: Codec, arr: pa.Array):
        ids = [codec.encode_bytes(t or "") for t in arr.to_pylist()]
        return ids, [codec.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]

    return _mapped(docs.drop("ids", "decoded"), ranks, pattern, text, ("ids", "decoded"), both)


def _mapped(docs: DataFrame, ranks: bytes, pattern: str, column: str, new, work) -> DataFrame:
    data = docs.sparkSession.sparkContext.broadcast(ranks)
    names = (new,) if isinstance(new, str) else new
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.BinaryType()) for n in names]])
    columns = docs.columns
    place = columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data, pattern)
        for b in batches:
            for i, j, _, _ in tv.chunks(b.column(place)):
                part = b.slice(i, j - i)
                out = work(codec, part.column(place))
                out = (out,) if isinstance(new, str) else out
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(o, pa.binary()) for o in out]], names=[*columns, *names])

    return docs.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from the columns ids and decoded."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
