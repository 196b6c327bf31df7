"""Byte-level BPE: texts to token ids by the ranks of a vocabulary file, and back to bytes.

Pieces come from :mod:`stocklens.llm.pretokens`; each distinct piece is merged once per task and then
taken from a bounded cache.  Ids travel as little-endian unsigned 32-bit integers.  The vocabulary is
one byte string with the offset of each token, which is what decoding slices from.

Missing and empty texts give no ids and decode to no bytes; very long texts are encoded whole; of merges of one
rank the leftmost comes first; repeated rows each give their row; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from stocklens.llm.merges import MergeTable
from stocklens.llm.pretokens import pieces_of, rank_file_symbols
from stocklens.llm.tasks import by_batches, of_a_stage, text_rows

#: Pieces whose ids one task remembers.
CACHED_PIECES = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of a vocabulary file, the symbols its pattern sees, and its bytes for decoding."""

    ranks: dict[bytes, int]
    merges: MergeTable
    symbols: np.ndarray
    data: np.ndarray
    offsets: np.ndarray  # of each id in ``data``; a free id has no bytes


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    return Vocabulary(ranks, _merge_table(ranks), rank_file_symbols(), np.frombuffer(b"".join(tokens), np.uint8), offsets)


def _merge_table(ranks: dict[bytes, int]) -> MergeTable:
    """Two tokens merge when their bytes together are a token, and its rank is the pair's."""
    pairs = [
        (ranks[token[:i]], ranks[token[i:]], rank, rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    return MergeTable(pairs, [ranks[bytes([b])] for b in range(256)])


class Encoder(dict):
    """Piece to the bytes of its ids; forgets everything when full."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def learn(self, pieces: list[str]) -> None:
        """Make sure that every piece is known."""
        if len(self) >= CACHED_PIECES:
            self.clear()
        unknown = [p for p in set(pieces) if p not in self]
        rest = []
        for piece in unknown:
            whole = self.vocabulary.ranks.get(piece.encode())
            if whole is None:
                rest.append(piece)
            else:
                self[piece] = whole.to_bytes(4, "little")
        self.update(zip(rest, self.vocabulary.merges.merge([p.encode() for p in rest]), strict=True))


def decoded(ids: bytes, vocabulary: Vocabulary) -> bytes:
    """The bytes of little-endian 32-bit ids, sliced from the vocabulary by its offsets."""
    tokens = np.frombuffer(ids, "<u4")
    if not len(tokens):
        return b""
    parts = []
    for begin in range(0, len(tokens), 1 << 18):
        some = tokens[begin : begin + (1 << 18)].astype(np.int64)
        starts = vocabulary.offsets[some]
        sizes = vocabulary.offsets[some + 1] - starts
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        parts.append(vocabulary.data[places].tobytes())
    return b"".join(parts)


_ENCODERS: dict[int, Encoder] = of_a_stage()


def _encoder(vocabulary: Broadcast) -> Encoder:
    """The encoder of this Python process, kept from one batch and task of a stage to the next."""
    key = id(vocabulary.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary.value)
    return _ENCODERS[key]


def _shared(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, some megabytes by its nature, sent to each executor once."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``token_ids`` (binary) of every text, by the file at ``path``."""
    vocabulary = _shared(docs.sparkSession, path)

    def run(rows: dict[str, list]) -> dict[str, list]:
        value, encoder = vocabulary.value, _encoder(vocabulary)
        ids: list[list[bytes]] = [[] for _ in rows["text"]]
        for pieces, stretches in pieces_of(rows["text"], value.symbols):
            encoder.learn(pieces)
            for number, first, last in stretches:
                ids[number].append(b"".join(map(encoder.__getitem__, pieces[first:last])))
        joined = [x[0] if len(x) == 1 else b"".join(x) for x in ids]
        return {"doc_id": rows["doc_id"], "n_tokens": [len(x) // 4 for x in joined], "token_ids": joined}

    kind = docs.schema[id_column].dataType.simpleString()
    return by_batches(
        text_rows(docs, id_column, text_column), run, f"doc_id {kind}, n_tokens bigint, token_ids binary"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes that its ``token_ids`` stand for."""
    vocabulary = _shared(encoded.sparkSession, path)
    columns = encoded.select("doc_id", "n_tokens", "token_ids")

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {**rows, "decoded": [decoded(ids, vocabulary.value) for ids in rows["token_ids"]]}

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return by_batches(columns, run, f"doc_id {kind}, n_tokens bigint, token_ids binary, decoded binary")
