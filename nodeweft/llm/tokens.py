"""Problem 7: ids of a public tokenizer for a whole corpus, by forced-boundary splitting.

Two neighbouring bytes that never stand next to each other inside any token of the vocabulary mark a cut that no merge
can cross. A text is cut there, each fragment is encoded on its own, and the ids are joined again. Fragments recur (most
are a word with its leading space), so each worker encodes a distinct fragment once and remembers it.

Merges are not all: the tokenizer first splits a text by a pattern that looks at its surroundings. A cut is therefore
taken only where the pattern can't tell the difference:

* the right byte begins a character, so both sides are valid text;
* the left character isn't white space: a run of white space gives its last character to the word that follows, which a
  fragment ending in the run could not know;
* the right character isn't an apostrophe: at the start of a fragment it could be read as a contraction.

Defined results: null and empty texts have an empty list of ids; strings that look like special tokens are ordinary
text; a text of any length is encoded whole. Every other column is passed through by `with_token_ids`.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the pattern by which the byte-level vocabularies split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct fragments that a worker remembers before it starts anew; bounds its memory, not its results.
REMEMBERED = 200_000

_encoders: dict[tuple[str, str], "FragmentEncoder"] = {}


def forced_cuts(tokens: list[bytes]) -> np.ndarray:
    """A table over (left byte, right byte): True where a text may be cut between the two."""
    cut = np.ones((256, 256), dtype=bool)
    for token in tokens:
        if len(token) > 1:
            b = np.frombuffer(token, dtype=np.uint8)
            cut[b[:-1], b[1:]] = False
    cut[:, 0x80:0xC0] = False  # inside a character
    cut[:, ord("'")] = False
    cut[:0x21, :] = False  # ASCII white space and controls on the left
    # Last bytes of the white space characters outside ASCII (U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029,
    # U+202F, U+205F, U+3000); other characters that end alike are merely not cut behind.
    for last in (0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F):
        cut[last, :] = False
    return cut.reshape(-1)


class _Known(dict):
    """Fragment -> its ids as int32 bytes; an unknown fragment is encoded when it is asked for."""

    def __init__(self, whole) -> None:
        super().__init__()
        self.whole = whole

    def __missing__(self, fragment: bytes) -> bytes:
        ids = np.array(self.whole.encode_ordinary(fragment.decode("utf-8")), dtype=np.int32).tobytes()
        if len(fragment) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[fragment] = ids
        return ids


class FragmentEncoder:
    """Encodes texts by a rank file (`{name}.tiktoken`) of the folder `path`."""

    def __init__(self, name: str, path: str) -> None:
        import tiktoken

        with open(os.path.join(path, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cut = forced_cuts(list(ranks))
        self.known = _Known(tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))

    def fragments(self, data: bytes) -> list[bytes]:
        b = np.frombuffer(data, dtype=np.uint8)
        ends = (np.flatnonzero(self.cut[b[:-1].astype(np.int32) * 256 + b[1:]]) + 1).tolist()
        return [data[i:j] for i, j in zip([0, *ends], [*ends, len(data)], strict=True)]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of `text`."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.fragments(text.encode("utf-8")))), dtype=np.int32)


def encoder(name: str, path: str) -> FragmentEncoder:
    """This worker's encoder, made at first use."""
    if (name, path) not in _encoders:
        _encoders[name, path] = FragmentEncoder(name, path)
    return _encoders[name, path]


def token_ids(text: Column, name: str = "byte_bpe_50k", path: str = TOKENIZERS) -> Column:
    """The ids of a string column as array<int>; null and empty texts have an empty array."""

    @arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(name, path)
        for texts in batches:
            parts = [e.encode(text) for text in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            values = np.concatenate([*parts, np.zeros(0, dtype=np.int32)])
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=pa.int32()))

    return ids(text)


def token_count(text: Column, name: str = "byte_bpe_50k", path: str = TOKENIZERS) -> Column:
    """The number of ids of a string column; 0 for null and empty texts."""

    @arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(name, path)
        for texts in batches:
            yield pa.array([len(e.encode(t)) for t in texts.to_pylist()], type=pa.int64())

    return count(text)


def with_token_ids(df: DataFrame, text: str = "text", out: str = "ids", **tokenizer: str) -> DataFrame:
    """`df` with the ids of its column `text` added as `out`; an existing column of that name is replaced."""
    return df.withColumn(out, token_ids(F.col(f"`{text}`"), **tokenizer))
