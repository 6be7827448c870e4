"""Token-id files: ORC with run-length encoded integers, stripes, row indexes and Bloom filters on document ids.

Documents are written in ascending id order. Each row holds the file's part number, the document id, the number of ids
before it in its part, and its ids. A reader therefore finds any document by stripe statistics and Bloom filters, any
range of the token stream by part totals, and splits files at stripes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.llm.tokens import encode_texts

SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "2000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
#: UTF-8 bytes of text in a part: the smaller number up to so many parts, then more, up to the larger one.
PART_BYTES, PARTS, MOST_BYTES = 16 << 20, 20_000, 512 << 20


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``SCHEMA``: documents by ascending id over range partitions, equal ids by text."""
    rows = common.documents(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, min(1 + size // PART_BYTES, max(PARTS, 1 + size // MOST_BYTES)))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids = list(encode_texts(common.raw_texts(batch["text"]), tokenizer, end_id))
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, np.int32)), batch["doc_id"], pa.array(start + ends[:-1]),
                        pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values),
                    ],
                    ["part", "doc_id", "start_in_part", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    return ordered.mapInArrow(encode, SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the files. An empty table gives a folder without rows; a null text is just the end id."""
    tokenized(docs, tokenizer, end_id, id_col, text_col).write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; stripes and row groups without them are skipped by statistics and Bloom filters."""
    return read_token_files(spark, path).filter(F.col("doc_id").isin(*doc_ids))


def part_starts(rows: DataFrame) -> DataFrame:
    """(part, part_start): ids in all parts before this one; a row per file, from the narrow columns alone."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))


def stream_positions(rows: DataFrame) -> DataFrame:
    """Rows with ``start``: the number of ids before the document in the whole stream.

    The part totals go to the rows, as there are few parts (``PARTS`` up to 10 TB of text): else all ids would be shuffled.
    """
    return rows.join(F.broadcast(part_starts(rows)), "part").withColumn("start", F.col("part_start") + F.col("start_in_part"))


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Documents that hold a position of [first, last) of the token stream."""
    rows = stream_positions(read_token_files(spark, path))
    return rows.filter((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows read back: CRC-32 over ids as little-endian 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            ends = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], pa.array(counts), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    narrow = rows.select("doc_id", "start", "ids")
    out = narrow.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", common.public_id(F.col("doc_id")))
