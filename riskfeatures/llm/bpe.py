"""Byte-level BPE through a table of distinct words.

Spark splits every text into pieces at white space (``split_pieces``, built-in
functions only): merges never cross such a border, so a piece encodes alike
wherever it stands.  Each Arrow batch is turned into a table of its distinct
pieces; each of them is encoded once and its ids are joined back to the texts by
position.  Decoding joins ids to the vocabulary's byte pieces.  Nothing is
shuffled: a corpus-wide table would move every occurrence of every word (about
six times the input) for ids that the batch can look up in place.

The vocabulary file is opened by path on each executor (installed there with the
tokenizer package); its size is fixed, so the piece table is bounded.

Defined results: a null text counts as empty (no ids, empty decoded text); null
ids are carried; repeated rows each get a row; an empty table gives an empty
result; texts of any length are encoded whole; other columns take no part.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# The special token's text, and the borders that no merge crosses.
SPECIAL = "<|endoftext|>"
PIECES = r"(?U) ?\S+|\s+(?!\S)|\s"
_PART = 1 << 20  # pieces handled at a time
_ENCODE = 1 << 14


def split_pieces(text: Column) -> Column:
    """Array of the pieces of ``text``; the special token is a piece of its own
    and ends the segment before it."""
    def pieces(x: Column) -> Column:
        return F.regexp_extract_all(x, F.lit(PIECES), F.lit(0))
    segments = F.split(text, r"<\|endoftext\|>")
    marked = F.flatten(F.transform(
        segments, lambda x, i: F.when(i == 0, pieces(x)).otherwise(F.concat(F.array(F.lit(SPECIAL)), pieces(x)))))
    return F.when(F.contains(text, F.lit(SPECIAL)), marked).otherwise(pieces(text))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def piece_table(path: str) -> pa.Array:
    """Bytes of every id.  Byte-level vocabularies write a byte as its own
    character where that is printable, else as the next character from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    t = _tokenizer(path)
    out = []
    for i in range(t.get_vocab_size(with_added_tokens=True)):
        token = t.id_to_token(i) or ""
        out.append(bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode())
    return pa.array(out, pa.binary())


def _encoder(path: str):
    def run(batches):
        tok = _tokenizer(path)
        for b in batches:
            words, rows = b.column(1), b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            table = words.flatten().dictionary_encode()
            lens, flat = [], []
            for at in range(0, len(table.dictionary), _ENCODE):
                for e in tok.encode_batch(table.dictionary.slice(at, _ENCODE).to_pylist(), add_special_tokens=False):
                    ids = e.ids
                    lens.append(len(ids))
                    flat.extend(ids)
            by_word = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(flat, pa.int32()))
            lens = np.array(lens, np.int64)
            ends, at = np.cumsum(rows), 0
            start = 0
            while start < len(rows):  # whole rows, about _PART pieces at a time
                stop = max(start + 1, int(np.searchsorted(ends, at + _PART, "right")))
                idx = table.indices.slice(at, int(ends[stop - 1]) - at)
                taken = by_word.take(idx)
                per_piece = np.concatenate([[0], np.cumsum(lens[idx.to_numpy(zero_copy_only=False)])])
                borders = per_piece[np.concatenate([[0], ends[start:stop] - at])]
                ids = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), taken.flatten())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), ids], names=[b.schema.names[0], "ids"])
                at, start = int(ends[stop - 1]), stop
    return run


def _decoder(path: str):
    def run(batches):
        pieces = piece_table(path)
        for b in batches:
            ids = b.column(b.schema.names.index("ids"))
            got = pieces.take(ids.flatten())
            at = np.frombuffer(got.buffers()[1], np.int32, len(got) + 1, got.offset * 4) if len(got) else np.zeros(1, np.int32)
            lens = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            borders = at[np.concatenate([[0], np.cumsum(lens)])]
            data = got.buffers()[2].to_pybytes() if len(got) and got.buffers()[2] else b""
            text = [data[s:e].decode("utf-8", "replace") for s, e in zip(borders[:-1], borders[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, "decoded"])
    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int), one row per document."""
    src = docs.select(F.col(id_col), split_pieces(F.coalesce(F.col(text_col), F.lit(""))).alias("pieces"))
    return map_arrow(src, _encoder(path), f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``decoded``: the text of ``ids``."""
    src = encoded.select(F.col(id_col), F.col("ids"))
    return map_arrow(src, _decoder(path), f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text; with ``with_ids`` the ids too."""
    d = decode(encode(docs, path, id_col, text_col), path, id_col)
    return d.select(F.col(id_col), *(["ids"] if with_ids else []), F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))
