"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only documents longer than a sequence are cut. How many pieces there are of each length fully determines a good packing,
and there are at most ``capacity`` lengths, so the plan is made once from that short histogram: pieces above a third of
the capacity are matched in pairs, the largest with the largest that still fits; smaller pieces then go, by descending
length, where the least room is left. The plan holds runs of equal sequences, never single ones. Each piece then needs
only its rank among the pieces of its length to find its place, and ranks come from small, evenly dealt groups.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.llm.tokens import encode_texts
from panelcast.sources.staging import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces ranked together in one group.
RANK_GROUP = 20_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full sequences, with what is left over in front."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece. A null or empty text is one piece that holds the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                doc, number, start, length, crc, parts = [], [], [], [], [], []
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode_texts(common.raw_texts(batch["text"]), tokenizer, end_id), strict=True):
                    for k, (a, n) in enumerate(cut(len(ids) // 4, capacity)):
                        raw = ids[4 * a : 4 * (a + n)]
                        doc.append(doc_id), number.append(k), start.append(a), length.append(n), crc.append(zlib.crc32(raw))
                        if with_ids:
                            parts.append(np.frombuffer(raw, "<i4"))
                columns = [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(parts, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return common.documents(docs, id_col, text_col).mapInArrow(encode, PIECES + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first sequence, pieces a sequence, offset) that place every piece.

    The r-th piece of a run lies in sequence ``first + r // k`` at ``offset + (r % k) * length``. Its size depends on the
    number of lengths, not on the number of pieces.
    """
    left = {n: c for n, c in histogram.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is empty or longer than a sequence")
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, number)
    made = 0

    def place(n: int, first: int, bins: int, k: int, room: int) -> None:
        runs.append((n, used[n], bins * k, first, k, capacity - room))
        used[n] += bins * k
        left[n] -= bins * k
        rooms.setdefault(room - n * k, []).append((first, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        while left[n]:
            i = bisect.bisect_right(large, capacity - n) - 1
            mate = large[i] if i >= 0 else None
            if mate == n and left[n] == 1:
                mate = large[i - 1] if i else None
            bins = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            first, made = made, made + bins
            runs.append((n, used[n], bins, first, 1, 0))
            used[n] += bins
            left[n] -= bins
            if mate is None:
                rooms.setdefault(capacity - n, []).append((first, bins))
            else:
                place(mate, first, bins, 1, capacity - n)
                if not left[mate] and mate != n:
                    large.remove(mate)
        large.pop()

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        open_rooms = sorted(r for r in rooms if r >= n)
        while left[n]:
            if not open_rooms:
                k = capacity // n
                bins = max(1, left[n] // k)
                first, made = made, made + bins
                place(n, first, bins, min(k, left[n]), capacity)
                continue
            room = open_rooms[0]
            first, bins = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                open_rooms.pop(0)
            k = min(room // n, left[n])
            take = min(bins, left[n] // k)
            place(n, first, take, k, room)
            if take < bins:
                rooms.setdefault(room, []).append((first + take, bins - take))
                if not open_rooms or open_rooms[0] != room:
                    open_rooms.insert(0, room)
    return runs


def pack(rows: DataFrame, capacity: int) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. The rows must be a stored table, as they are read twice.

    Equal pieces of one document are interchangeable. An empty table stays empty.
    """
    counts = {int(n): int(c) for n, c in rows.groupBy("length").agg(F.count("*")).collect()}  # at most capacity rows
    runs = sorted(plan(counts, capacity))
    group = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1 + sum(counts.values()) // RANK_GROUP))
    dealt = rows.withColumn("rank_group", group)
    inside = Window.partitionBy("length", "rank_group").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1)
    sizes = dealt.groupBy("length", "rank_group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("rank_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "rank_group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = ranked.join(starts, ["length", "rank_group"]).withColumn("rank", F.col("rank") + F.col("before"))
    table = np.array(runs, np.int64).reshape(-1, 6)
    span = np.int64(max(counts.values(), default=0) + 1)  # a run's key: length, then first rank

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            n, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            run = table[np.searchsorted(keys, n * span + rank, "right") - 1]
            at = rank - run[:, 1]
            batch = replaced_rank(batch, run[:, 3] + at // run[:, 4], run[:, 5] + at % run[:, 4] * n)
            yield batch

    def replaced_rank(batch: pa.RecordBatch, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
        keep = [c for c in batch.schema.names if c != "rank"]
        return pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    ranked = ranked.select(*rows.columns, F.col("rank").cast("long").alias("rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.mapInArrow(find, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; ``with_ids`` carries the ids along for ``fill_sequences``.

    Null and empty texts are the end id alone, a null id stays null, rows that repeat an id are packed one by one, equal
    pieces are interchangeable, other columns are never read, and an empty table stays empty.
    """
    packed = pack(stage(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces"), capacity)
    return packed.withColumn("doc_id", common.public_id(F.col("doc_id")))


def fill_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the sequences, each no longer than its capacity."""
    entry = F.struct("offset", "doc_id", "length", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return grouped.select("sequence_id", F.flatten("entries.ids").alias("ids"), F.col("entries.doc_id").alias("doc_ids"), F.col("entries.length").alias("lengths"))
