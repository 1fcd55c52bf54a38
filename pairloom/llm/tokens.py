"""Problem 7: encoding a whole corpus with a public tokenizer, and decoding it.

Texts go to the tokenizers library in Arrow batches, a bounded number of characters at a time. Byte-level tokens stand
for bytes: the printable characters of the vocabulary map to bytes, so decoding reverses that table and joins the
bytes of a character that is split over tokens.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter of every operator here.
VOCABULARIES = "/opt/tokenizers"
#: Characters that are encoded at once, which bounds a task's memory. A longer text is encoded alone.
CHUNK = 1 << 20


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _tokenizer(path: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # what looks like a special token in a text is text
    return t


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for x in texts:
        if part and size + len(x) > CHUNK:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part


def _encoder(path: str, offsets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            texts, at = [x or "" for x in b.column(1).to_pylist()], 0
            for part in _chunks(texts):
                done = (t.encode_batch if offsets else t.encode_batch_fast)(part, add_special_tokens=False)
                cols = [b.column(0).slice(at, len(part)), pa.array([e.ids for e in done], pa.list_(pa.int32()))]
                if offsets:
                    cols += [pa.array([[o[i] for o in e.offsets] for e in done], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "starts", "ends"][: len(cols)])
                at += len(part)

    return encode


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", offsets: bool = False, folder: str = VOCABULARIES) -> DataFrame:
    """``key`` and ``ids`` of every document, without special tokens; an empty list for an empty and for a null text.
    With ``offsets`` also ``starts`` and ``ends``: the characters (code points) that each token covers; tokens of one
    split character cover the same one. No shuffle; other columns are not read."""
    kind = dict(docs.dtypes)[key]
    schema = f"id {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    out = docs.select(key, text).mapInArrow(_encoder(f"{folder}/{vocabulary}.json", offsets), schema)
    return out.withColumnRenamed("id", key)


def _pieces(path: str) -> dict[int, bytes]:
    """The bytes of each token of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    table = byte_of_char()
    return {i: bytes(table[c] for c in token) if all(c in table for c in token) else token.encode() for token, i in vocabulary.items()}


def _text(ids: list[int] | None, pieces: dict[int, bytes]) -> str | None:
    return None if ids is None else b"".join(pieces[i] for i in ids).decode("utf-8", "replace")


def _decoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_text(x, pieces) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return decode


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k", key: str = "doc_id", ids: str = "ids", folder: str = VOCABULARIES) -> DataFrame:
    """``key`` and ``text``: bytes of all tokens joined, then read as UTF-8; bytes that a cut list leaves of a split
    character become U+FFFD. A null list gives null."""
    out = encoded.select(key, ids).mapInArrow(_decoder(f"{folder}/{vocabulary}.json"), f"id {dict(encoded.dtypes)[key]}, text string")
    return out.withColumnRenamed("id", key)


def _there_and_back(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, pieces = _tokenizer(path), _pieces(path)
        for b in batches:
            texts, at = [x or "" for x in b.column(1).to_pylist()], 0
            for part in _chunks(texts):
                ids = [e.ids for e in t.encode_batch_fast(part, add_special_tokens=False)]
                same = [_text(x, pieces) == y for x, y in zip(ids, part, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(map(len, ids), pa.int32()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "same"])
                at += len(part)

    return both


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``same``: whether decoding gives back the text (null counts as empty). Texts are encoded
    and decoded where they are, once."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_there_and_back(f"{folder}/{vocabulary}.json"), f"doc_id {kind}, n_tokens int, same boolean")
