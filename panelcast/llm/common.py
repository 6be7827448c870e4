"""What the operators share: the shape of document tables, byte-level word splitting, Arrow helpers.

Conventions of all operators: a null text is an empty text, a null id sorts before every other id, rows that repeat an
id are the same document, and columns other than the named ones are neither read nor able to clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null id inside the operators, so that joins and orders treat it like any other id.
NULL_ID = -(2**63)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) and nothing else; null ids become ``NULL_ID``, null texts empty."""
    return docs.select(id_key(docs[id_col]).alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def id_key(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


def public_id(c: Column) -> Column:
    return F.nullif(c, F.lit(NULL_ID))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    for text in column.cast(pa.large_binary()):
        yield text.as_py() or b""


def replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return batch.set_column(batch.schema.get_field_index(name), name, values)


class WordHashes(dict):
    """64-bit hashes of words, each computed once per worker while the memory bound holds."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shift-xor-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers


def window_hashes(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive word hashes, equal for equal runs wherever they stand.

    A polynomial over 2**64 from prefix sums: the odd base has an inverse, so a window is a difference, moved to the
    origin. Two salts give independent hashes.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power_tables(max(1024, 1 << len(hashes).bit_length()))
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes ^ np.uint64(salt)) * up[: len(hashes)], out=prefix[1:])
    return mixed((prefix[width:] - prefix[:n]) * down[:n])
