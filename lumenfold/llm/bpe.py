"""Byte-level BPE over Arrow batches by the tokenizers library: ids, byte-exact decoding, character offsets.

The model is built from a rank file: bytes become characters of the byte alphabet, ranks become merge
rules.  Decoding goes back through the alphabet to bytes, so characters split over tokens come out whole.
"""

from __future__ import annotations

import base64
import os
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from ._common import raw, small_batches, strings


# a task has a core: the library's own threads would only contend for it
os.environ["TOKENIZERS_PARALLELISM"] = "false"


def byte_alphabet() -> list[str]:
    """The character standing for each byte in byte-level vocabularies (the published rule: printable bytes stand for themselves, the others follow from 256 on)."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A tokenizers model that merges as the ranks say.

    Any two neighbours whose concatenation has a rank may merge, lowest rank first, so each way to split
    a token into two tokens becomes a merge rule, in the order of the result's rank.
    """
    to_char = byte_alphabet()
    spell = {token: "".join(map(to_char.__getitem__, token)) for token in ranks}
    rules = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                rules.append((rank, len(left), spell[left], spell[right]))
    rules.sort()
    model = models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=[(a, b) for _, _, a, b in rules], ignore_merges=True)
    out = Tokenizer(model)
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def whole_ids(tokenizer: Tokenizer, texts: list[str], at_once: int = 16) -> list[bytes]:
    """Ids of each whole text as little-endian unsigned 32-bit bytes; few texts at once, so that encodings don't pile up."""
    out = []
    for at in range(0, len(texts), at_once):
        out += [packed(x.ids) for x in tokenizer.encode_batch_fast(texts[at : at + at_once], add_special_tokens=False)]
    return out


@lru_cache(maxsize=4)
def json_tokenizer(path: str) -> Tokenizer:
    """Of a tokenizers file; strings that look like special tokens are ordinary text."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=4)
def rank_tokenizer(path: str, pattern: str) -> Tokenizer:
    return tokenizer_from_ranks(read_ranks(path), pattern)


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """Bytes of each id, by reversing the byte alphabet of the tokenizers model's vocabulary."""
    ranks = read_ranks(path)
    to_byte = {c: b for b, c in enumerate(byte_alphabet())}
    to_char = byte_alphabet()
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = bytes(to_byte[c] for c in map(to_char.__getitem__, token))
    return table


@lru_cache(maxsize=4)
def _flat_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and where each begins and how long it is."""
    table = byte_table(path)
    lengths = np.fromiter(map(len, table), dtype=np.int64, count=len(table))
    return np.frombuffer(b"".join(table), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def decoded(ids: bytes, path: str) -> bytes:
    """The bytes of all tokens, put together."""
    if not ids:
        return b""
    data, begins, lengths = _flat_table(path)
    at = np.frombuffer(ids, dtype="<u4")
    size = lengths[at]
    ends = np.cumsum(size)
    return data[np.arange(ends[-1]) + np.repeat(begins[at] - (ends - size), size)].tobytes()


def character_spans(ids: bytes, text: str, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token; tokens inside one character share it."""
    lengths = np.fromiter((len(table[i]) for i in np.frombuffer(ids, dtype="<u4").tolist()), dtype=np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    started = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters begun before each byte
    begins = ends - lengths
    first = started[begins] - ((begins < len(data)) & ((data[np.minimum(begins, len(data) - 1)] & 0xC0) == 0x80) if len(data) else 0)
    return first.astype(np.int32), started[ends].astype(np.int32)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``id_col, ids`` (binary: little-endian unsigned 32-bit) of each whole text, with character offsets if asked for.

    Null and empty texts have no ids; repeated rows and ids each give a row; other columns are not read.
    """
    small_batches(docs.sparkSession)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType())]
    if offsets:
        fields += [T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = rank_tokenizer(ranks_path, pattern)
        for batch in batches:
            texts = strings(batch.column(1))
            ids = whole_ids(tokenizer, texts)
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if offsets:
                spans = [character_spans(i, t, byte_table(ranks_path)) for i, t in zip(ids, texts, strict=True)]
                columns += [pa.array([list(s[k]) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, ranks_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for.  They are bytes, so a character split over tokens is whole again; null ids give none."""
    small_batches(encoded.sparkSession)
    encoded = encoded.drop(out_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())])
    place = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [decoded(x, ranks_path) for x in raw(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[f.name for f in schema.fields])

    return encoded.mapInArrow(run, schema)


def id_count(ids: str | Column = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")
