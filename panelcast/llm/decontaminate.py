"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the word windows of a benchmark; items shorter than a window are patterns of their own length. Patterns
of one length share a searcher: a shift table over blocks of two words says how far the search may jump, a bucket per
last block holds the patterns that may end here, and a direct comparison confirms an occurrence. Documents are scanned in
one pass without a shuffle. A benchmark of more than one block of bounded size is searched block after block: the hits of
each block are stored, so that a task never holds the tables of two, and then put together by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.sources.staging import stage

#: Bytes of benchmark text that one pass keeps in memory.
BLOCK_BYTES = 8 << 20
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits, lower-cased, and of all characters beyond ASCII."""
    return text.lower().translate(_WORD_BYTES).split()


class Searcher:
    """Wu-Manber tables for patterns of one number of words."""

    def __init__(self, size: int, patterns: dict[tuple[bytes, ...], set]):
        self.size, self.block = size, min(2, size)
        self.far = size - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set]] = {}
        for pattern, items in patterns.items():
            for at in range(size - self.block + 1):
                key = pattern[at : at + self.block]
                self.shift[key] = min(self.shift.get(key, self.far), size - self.block - at)
            self.buckets.setdefault(pattern[size - self.block :], {})[pattern] = items

    def occurrences(self, text: list[bytes]) -> Iterator[tuple[int, set]]:
        """(first word, items) of each place where a pattern occurs."""
        size, far, shift = self.size, self.far, self.shift.get
        end, n = size, len(text)
        if self.block == 1:
            for at, word in enumerate(text):
                if shift((word,)) == 0:
                    yield at, self.buckets[(word,)][(word,)]
            return
        while end <= n:
            step = shift((text[end - 2], text[end - 1]), far)
            if step:
                end += step
                continue
            found = self.buckets[(text[end - 2], text[end - 1])].get(tuple(text[end - size : end]))
            if found is not None:
                yield end - size, found
            end += 1


def searchers(items: list[tuple[int, str]], window: int) -> list[Searcher]:
    by_size: dict[int, dict[tuple[bytes, ...], set]] = {}
    for item, text in items:
        w = words((text or "").encode())
        size = min(window, len(w))
        for at in range(len(w) - size + 1 if size else 0):
            by_size.setdefault(size, {}).setdefault(tuple(w[at : at + size]), set()).add(item)
    return [Searcher(size, patterns) for size, patterns in sorted(by_size.items())]


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks of about ``block_bytes``, and their items; only one block at a time is on the driver. An item
    alone may be larger."""
    size = F.length(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")) + 16
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[text_col].alias("text"))
    total = items.agg(F.sum(size)).first()[0] or 0
    count = 1 + total // block_bytes
    if count == 1:
        return 1, iter([[tuple(r) for r in items.collect()]])  # at most block_bytes
    stored = stage(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count))), "benchmark")
    return count, ([tuple(r) for r in stored.filter(F.col("block") == block).select("item", "text").collect()] for block in range(count))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with a column ``hits``: struct(n_words, n_hit, items array, spans array of (first word, end)).

    A word inside any occurrence of a window is hit; ``items`` are the items with an occurring window. A null text has no
    words, a null item text no windows. All columns of the documents stay; a column named ``hits`` is replaced.
    """
    spark = docs.sparkSession
    kinds = "struct<n_words: bigint, n_hit: bigint, items: array<bigint>, spans: array<struct<first: bigint, end: bigint>>>"
    out = docs.withColumn("hits", F.lit(None).cast(kinds))
    count, blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    if count == 1:
        return out.mapInArrow(_matcher(spark.sparkContext.broadcast(next(blocks)), window, text_col), out.schema)
    mark = common.fresh(out, "scanned_row")
    numbered = stage(out.withColumn(mark, F.monotonically_increasing_id()), "numbered")  # stored, so a row keeps its number
    narrow = numbered.select(mark, text_col, "hits")
    found = []
    for block in blocks:
        known = spark.sparkContext.broadcast(block)
        hit = narrow.mapInArrow(_matcher(known, window, text_col), narrow.schema).filter("size(hits.spans) > 0")
        found.append(stage(hit.select(mark, "hits.items", "hits.spans"), "benchmark-hits"))
        known.unpersist()
    every = reduce(DataFrame.unionAll, found).groupBy(mark).agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    gathered = F.when(F.col("items").isNotNull(), F.struct(F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), "items", "spans"))
    every = every.select(F.col(mark).alias("found_row"), gathered.alias("found_hits"))
    whole = numbered.join(every, numbered[mark] == every["found_row"], "left")
    whole = whole.select(*(every["found_hits"].alias("hits") if c == "hits" else numbered[f"`{c}`"] for c in out.columns))
    return whole.mapInArrow(_matcher(spark.sparkContext.broadcast([]), window, text_col), out.schema)


def _matcher(known, window: int, text_col: str):
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = searchers(known.value, window)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                for text, before in zip(common.raw_texts(batch[text_col]), batch["hits"].to_pylist(), strict=True):
                    w = words(text)
                    items = set(before["items"]) if before else set()
                    spans = [(s["first"], s["end"]) for s in before["spans"]] if before else []
                    for table in tables:
                        for first, found in table.occurrences(w):
                            items |= found
                            spans.append((first, first + table.size))
                    merged: list[list[int]] = []
                    for first, end in sorted(spans):
                        if merged and first <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([first, end])
                    rows.append({
                        "n_words": len(w), "n_hit": sum(b - a for a, b in merged),
                        "items": sorted(items, key=lambda x: (x is not None, x or 0)),
                        "spans": [{"first": a, "end": b} for a, b in merged],
                    })
                yield common.replaced(batch, "hits", pa.array(rows, kind))

    return match


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document row."""
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    hits = F.col("hits")
    names = F.array_sort(F.transform(hits["items"], lambda x: F.coalesce(x.cast("string"), F.lit(""))))
    return scan(narrow, benchmark, window).select(
        "doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (hits["n_hit"] > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_share: float = 0.0, text_col: str = "text") -> DataFrame:
    """Documents of which no more than ``max_share`` of the words lie inside benchmark windows, columns as they were."""
    name = common.fresh(docs, "decontamination")
    marked = scan(docs.withColumnRenamed("hits", name) if "hits" in docs.columns else docs, benchmark, window, text_col)
    kept = marked.filter(F.col("hits.n_hit") <= max_share * F.col("hits.n_words")).drop("hits")
    return kept.withColumnRenamed(name, "hits") if "hits" in docs.columns else kept
