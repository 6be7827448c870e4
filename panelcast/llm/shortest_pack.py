"""Shortest-pack-first packing over the histogram of lengths, without padding.

A document of n ids gives n // capacity full pieces and a tail. Full pieces and tails are counted by length, and the plan is
made from that histogram alone (at most ``capacity`` rows, whatever the corpus holds): there are exactly as many packs as the
ids need, all empty at first, and lengths are placed longest first, each into the pack that is shortest so far. A length
that fits into no pack fills the shortest one, and what is left of it goes back into the histogram as a shorter length; so
every pack gets full, and at most one document is cut for each pack. The ids beyond the last full pack go into packs of
distinct powers of two, which need no padding either. The plan keeps counts of equal packing patterns, never single packs.

A tail finds its places by its rank among the tails of its length. Tails are counted where they are encoded, in chunks, so a
rank is a number inside the chunk plus the total of the chunks before; no length, however common, meets in one task.

Null texts are empty (one id, the end id), rows that repeat an id are packed one by one, ties of length are broken by chunk
and place, an empty table stays empty, a null id stays null, and other columns are never read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.llm.tokens import encode_texts
from panelcast.sources.staging import stage

BLOCKS = "doc_id long, doc_tokens long, start long, length long, crc long, ids binary, chunk long, place long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Documents whose pieces are numbered together.
CHUNK = 4000


def blocks(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per full piece and per tail; ``place`` counts the earlier ones of its length in its chunk."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch, seen, rows = whole.slice(at, CHUNK), np.zeros(capacity + 1, np.int64).tolist(), []
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode_texts(common.raw_texts(batch["text"]), tokenizer, end_id), strict=True):
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        raw = ids[4 * start : 4 * (start + capacity)]
                        size = len(raw) // 4
                        rows.append((doc_id, n, start, size, zlib.crc32(raw), raw, chunk, seen[size]))
                        seen[size] += 1
                chunk += 1
                kinds = [pa.int64()] * 5 + [pa.large_binary()] + [pa.int64()] * 2
                names = ["doc_id", "doc_tokens", "start", "length", "crc", "ids", "chunk", "place"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return common.documents(docs, id_col, text_col).mapInArrow(encode, BLOCKS)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Runs (layer, length, first rank, ranks, from, size, first pack, pieces a pack, offset), and the number of packs.

    Rank r of a run puts the ids [from, from + size) of a block of that length into pack ``first + (r - first rank) // k`` at
    ``offset + (r - first rank) % k * size``. A block that is cut has a run in each of several layers.
    """
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("a length is 0 or longer than a pack")
    packs, rest = divmod(sum(n * c for n, c in histogram.items()), capacity)
    rooms: dict[int, list[tuple[int, int, int]]] = {}  # room left -> patterns (first pack, packs, size of a pack)
    open_rooms: list[int] = []
    runs: list[tuple[int, ...]] = []

    def leave(room: int, first: int, count: int, size: int) -> None:
        if room and count:
            if room not in rooms:
                rooms[room] = []
                heapq.heappush(open_rooms, -room)
            rooms[room].append((first, count, size))

    leave(capacity, 0, packs, capacity)
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            leave(1 << bit, packs, 1, 1 << bit)
            packs += 1
    left = {n: [(0, n, 0, 0, c)] for n, c in histogram.items() if c}  # length -> (layer, block length, from, first rank, ranks)
    lengths = [-n for n in left]
    heapq.heapify(lengths)
    while lengths:
        n = -heapq.heappop(lengths)
        for layer, block, start, rank, count in left.pop(n):
            while count:
                room = -open_rooms[0]
                first, bins, size = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    heapq.heappop(open_rooms)
                second = -open_rooms[0] if open_rooms else 0
                put = min(n, room)
                k = min(count, 1 + (room - max(second, put)) // put)  # this often it stays the shortest
                take = min(bins, count // k)
                runs.append((layer, block, rank, take * k, start, put, first, k, size - room))
                leave(room - k * put, first, take, size)
                leave(room, first + take, bins - take, size)
                if put < n:
                    if n - put not in left:
                        left[n - put] = []
                        heapq.heappush(lengths, put - n)
                    left[n - put].append((layer + 1, block, start + put, rank, take))
                rank += take * k
                count -= take * k
    return runs, packs


def pack(rows: DataFrame, capacity: int, with_ids: bool = False) -> DataFrame:
    """Places of stored ``blocks``. Only blocks of lengths that the plan cuts carry their ids through the shuffle."""
    counts = {int(n): int(c) for n, c in rows.groupBy("length").agg(F.count("*")).collect()}  # at most capacity rows
    runs, _ = plan(counts, capacity)
    cut = sorted({r[1] for r in runs if r[0]})
    layers = [np.array(sorted(r[1:] for r in runs if r[0] == k), np.int64) for k in range(1 + max((r[0] for r in runs), default=-1))]
    sizes = rows.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ids = F.col("ids") if with_ids else F.when(F.col("length").isin(cut), F.col("ids"))
    narrow = rows.withColumn("ids", ids).join(starts, ["length", "chunk"])
    narrow = narrow.select("doc_id", "doc_tokens", "start", "length", "crc", "ids", (F.col("place") + F.col("before")).alias("rank"))
    span = np.int64(max(counts.values(), default=0) + 1)  # a run's key: length, then first rank

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for runs_of_layer in layers:
                block, first_rank, ranks, start, size, first, k, offset = runs_of_layer.T
                run = np.searchsorted(block * span + first_rank, length * span + rank, "right") - 1
                at = rank - first_rank[run]
                some = np.flatnonzero((run >= 0) & (block[run] == length) & (at < ranks[run]))
                run, at, held = run[some], at[some], batch.take(pa.array(some))
                whole = size[run] == held["length"].to_numpy()
                crc = held["crc"].to_numpy().copy()
                parts = []
                for i in range(len(some)) if with_ids else np.flatnonzero(~whole).tolist():
                    raw = held["ids"][i].as_py()[4 * start[run[i]] : 4 * (start[run[i]] + size[run[i]])]
                    crc[i] = zlib.crc32(raw)
                    parts.append(np.frombuffer(raw, "<i4"))
                columns = [
                    held["doc_id"], pa.array(held["start"].to_numpy() + start[run]), pa.array(size[run]), pa.array(crc), held["doc_tokens"],
                    pa.array(first[run] + at // k[run]), pa.array(offset[run] + at % k[run] * size[run]),
                ]
                names = [f.split()[0] for f in PIECES.split(", ")]
                if with_ids:
                    columns.append(pa.array(parts, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids"][: len(columns)])

    placed = narrow.mapInArrow(find, PIECES + (", ids array<int>" if with_ids else ""))
    return placed.withColumn("doc_id", common.public_id(F.col("doc_id")))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Columns of ``PIECES`` for all documents, and with ``with_ids`` the ids of each piece."""
    return pack(stage(blocks(docs, tokenizer, end_id, capacity), "blocks"), capacity, with_ids)


def sequences(packed: DataFrame, capacity: int, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_ids) of pieces with ids: padded to the capacity unless the number of ids is a power of two."""
    entry = F.struct("offset", "ids")
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["ids"]))
    filled = packed.groupBy("sequence_id").agg(ids.alias("ids")).withColumn("n_ids", F.size("ids"))
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.col("n_ids")))
    return filled.withColumn("ids", F.when(F.bit_count("n_ids") == 1, F.col("ids")).otherwise(padded))
