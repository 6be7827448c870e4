"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line without outer white space, ASCII letters lower-cased. The state of an index is three tables:

* postings: one row per key and document that holds it. They make every change reversible.
* references: per key the exact number of documents and the largest document id.

  Both are stored in parts. An insertion appends its postings; a deletion notes the documents that have gone; either appends
  the counts of the keys that it touches, and of a key the newest counts are valid. So a change writes what it changes.
  After ``COMPACT`` changes the parts become one.
* filters: per shard of keys a cuckoo filter of the repeated keys (those in at least ``min_docs`` documents). Cuckoo
  filters take deletions, so documents can leave again. An index with twice the keys that its shards are made for, or a
  fourth of them, gets other shards, whose filters are made from the counts: once per doubling.

Lines are screened by the filter of their shard and only hits are confirmed against the exact counts. A shard's lines are
dealt over slices by document, so a line that a third of all documents hold never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.sources.staging import stage

KEY = ["key_hi", "key_lo"]
POSTINGS = "key_hi long, key_lo long, doc_id long"
FILTERS = "shard int, slots binary, full boolean"
#: Lines screened in one slice of a shard.
SLICE_LINES = 20_000
#: Distinct keys that one shard is made for.
SHARD_KEYS = 100_000
#: Changes after which the parts of an index are stored as one.
COMPACT = 16


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets, either of which follows from the other."""

    WAYS, KICKS = 4, 500

    def __init__(self, slots: np.ndarray):
        self.slots = slots  # (buckets, WAYS), a power of two of buckets; 0 is a free slot

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(2, int(np.ceil(keys / cls.WAYS / 0.85)) - 1).bit_length(), cls.WAYS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.WAYS).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        marks = (lo.astype(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = common.mixed(hi.astype(np.uint64)) & mask
        return marks, first, first ^ (common.mixed(marks.astype(np.uint64)) & mask)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        marks, a, b = self._places(hi, lo)
        return (self.slots[a] == marks[:, None]).any(1) | (self.slots[b] == marks[:, None]).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """Adds keys; False if one found no place, after which the filter has to be built anew."""
        mask = np.uint64(len(self.slots) - 1)
        for mark, a, b in zip(*self._places(hi, lo), strict=True):
            at = a
            for place in (a, b):
                free = np.flatnonzero(self.slots[place] == 0)
                if len(free):
                    self.slots[place, free[0]] = mark
                    break
            else:
                for kick in range(self.KICKS):
                    way = kick % self.WAYS
                    mark, self.slots[at, way] = self.slots[at, way], mark
                    at = at ^ (common.mixed(np.array([mark], np.uint64))[0] & mask)
                    free = np.flatnonzero(self.slots[at] == 0)
                    if len(free):
                        self.slots[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for mark, a, b in zip(*self._places(hi, lo), strict=True):
            for place in (a, b):
                held = np.flatnonzero(self.slots[place] == mark)
                if len(held):
                    self.slots[place, held[0]] = 0
                    break


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a lower-cased line, if it is long enough to count."""
    key = line.strip()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key


def postings(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key_hi, key_lo, doc_id), each once: 128-bit hashes of the keys of at least ``min_chars`` code points."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, owners = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), common.raw_texts(batch["text"]), strict=True):
                own = {xxhash.xxh3_128_digest(k) for x in text.lower().split(b"\n") if (k := line_key(x, min_chars)) is not None}
                digests += own
                owners += [doc_id] * len(own)
            pair = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(owners, pa.int64())], [*KEY, "doc_id"])

    return common.documents(docs, id_col, text_col).mapInArrow(keys, POSTINGS).distinct()


def references(rows: DataFrame) -> DataFrame:
    """Exact counts per key; equal keys are combined before the shuffle."""
    return rows.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


@dataclass(frozen=True)
class LineIndex:
    """The stored state. Changes return a new index and leave the old one readable."""

    posting_parts: DataFrame  # with the version that added them
    reference_parts: DataFrame
    gone: DataFrame  # (doc_id, until): postings of a document up to this version are dead
    filters: DataFrame
    keys: int
    shards: int
    min_docs: int = 5
    min_chars: int = 40
    version: int = 0

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index of a table; an empty one gives an index that knows no line."""
        return cls._of(stage(postings(docs, min_chars, id_col, text_col), "line-postings"), min_docs, min_chars)

    @classmethod
    def _of(cls, rows: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
        refs = stage(references(rows), "line-references")
        first = F.lit(0).alias("version")
        gone = rows.select("doc_id", F.lit(0).alias("until")).limit(0)
        keys = refs.count()
        index = cls(rows.select("*", first), refs.select("*", first), gone, None, keys, 1 + keys // SHARD_KEYS, min_docs, min_chars)
        return replace(index, filters=stage(index._built(index.repeated()), "line-filters"))

    @property
    def postings(self) -> DataFrame:
        return self._live(self.posting_parts)

    @property
    def references(self) -> DataFrame:
        return self._newest(self.reference_parts)

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self.version:
            return rows.drop("version")
        until = self.gone.groupBy("doc_id").agg(F.max("until").alias("until"))
        return rows.join(until, "doc_id", "left").filter(F.col("until").isNull() | (F.col("version") > F.col("until"))).select(*KEY, "doc_id")

    def _newest(self, rows: DataFrame) -> DataFrame:
        if not self.version:
            return rows.drop("version")
        newest = rows.groupBy(*KEY).agg(F.max_by(F.struct("n_docs", "last_doc"), "version").alias("newest"))
        return newest.select(*KEY, "newest.n_docs", "newest.last_doc").filter("n_docs > 0")

    def shard(self):
        return F.pmod(F.xxhash64(*KEY), F.lit(self.shards)).cast("int")

    def repeated(self) -> DataFrame:
        return self.references.filter(F.col("n_docs") >= self.min_docs)

    def _built(self, repeated: DataFrame) -> DataFrame:
        def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            hi, lo, size = rows.key_hi.to_numpy(), rows.key_lo.to_numpy(), len(rows)
            while not (made := CuckooFilter.sized(size)).insert(hi, lo):
                size *= 2
            return pd.DataFrame({"shard": [key[0]], "slots": [made.dump()], "full": [False]})

        return repeated.select(self.shard().alias("shard"), *KEY).groupBy("shard").applyInPandas(build, FILTERS)

    def _changed(self, came: DataFrame, left: DataFrame) -> LineIndex:
        """The index with the filters that follow from keys that have become repeated (``came``) or ceased to be (``left``)."""
        if self.version >= COMPACT:
            return self.compacted()
        wanted = 1 + self.keys // SHARD_KEYS
        if wanted >= 2 * self.shards or 4 * wanted <= self.shards:
            index = replace(self, shards=wanted)
            return replace(index, filters=stage(index._built(index.repeated()), "line-filters"))

        def change(key: tuple, held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            gone, new = keys[~keys.came], keys[keys.came]
            made = CuckooFilter.load(held.slots.iloc[0]) if len(held) else CuckooFilter.sized(len(new))
            made.delete(gone.key_hi.to_numpy(), gone.key_lo.to_numpy())
            full = not made.insert(new.key_hi.to_numpy(), new.key_lo.to_numpy())
            return pd.DataFrame({"shard": [key[0]], "slots": [made.dump()], "full": [full]})

        keys = came.select(self.shard().alias("shard"), *KEY, F.lit(True).alias("came")).unionAll(left.select(self.shard().alias("shard"), *KEY, F.lit(False).alias("came")))
        changed = stage(self.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(change, FILTERS), "line-filters")
        full = changed.filter("full").select("shard")
        if full.isEmpty():
            return replace(self, filters=changed)
        again = self._built(self.repeated().withColumn("shard", self.shard()).join(full, "shard", "left_semi").drop("shard"))
        return replace(self, filters=stage(changed.filter("not full").unionAll(again), "line-filters"))

    def _with(self, refs: DataFrame, keys: int, **parts: DataFrame) -> LineIndex:
        version = self.version + 1
        refs = self.reference_parts.unionAll(refs.select(*KEY, "n_docs", "last_doc", F.lit(version).alias("version")))
        return replace(self, reference_parts=refs, keys=keys, version=version, **parts)

    def compacted(self) -> LineIndex:
        """The same index in one part, without what has gone."""
        return self._of(stage(self.postings, "line-postings"), self.min_docs, self.min_chars)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Adds documents. Lines of a document that are known already are not counted twice."""
        given = stage(postings(docs, self.min_chars, id_col, text_col), "line-postings")
        held = self._live(self.posting_parts.join(given.select("doc_id").distinct(), "doc_id", "left_semi").select(*KEY, "doc_id", "version"))
        new = stage(given.join(held, [*KEY, "doc_id"], "left_anti"), "line-postings")
        more = stage(references(new).withColumnsRenamed({"n_docs": "more", "last_doc": "last"}), "line-keys")
        old = self._newest(self.reference_parts.join(more.select(*KEY), KEY, "left_semi"))
        before = F.coalesce("n_docs", F.lit(0))
        merged = more.join(old, KEY, "left").select(*KEY, before.alias("before"), (before + F.col("more")).alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))
        merged = stage(merged, "line-references")
        came = merged.filter((F.col("before") < self.min_docs) & (F.col("n_docs") >= self.min_docs))
        added = new.select(*KEY, "doc_id", F.lit(self.version + 1).alias("version"))
        keys = self.keys + merged.filter("before = 0").count()
        return self._with(merged, keys, posting_parts=self.posting_parts.unionAll(added))._changed(came, came.limit(0))

    def delete(self, doc_ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Removes documents by id, as if they had never been added."""
        ids = stage(doc_ids.select(common.id_key(doc_ids[id_col]).alias("doc_id")).distinct(), "line-gone")
        lost = self._live(self.posting_parts.join(ids, "doc_id", "left_semi").select(*KEY, "doc_id", "version"))
        touched = stage(lost.select(*KEY).distinct(), "line-keys")
        index = replace(self, gone=self.gone.unionAll(ids.select("doc_id", F.lit(self.version).alias("until"))), version=self.version + 1)
        kept = references(index._live(self.posting_parts.join(touched, KEY, "left_semi").select(*KEY, "doc_id", "version")))
        anew = stage(touched.join(kept, KEY, "left").select(*KEY, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "last_doc"), "line-references")
        before = self._newest(self.reference_parts.join(touched, KEY, "left_semi"))
        left = before.filter(F.col("n_docs") >= self.min_docs).join(anew.filter(F.col("n_docs") >= self.min_docs), KEY, "left_anti")
        keys = self.keys - anew.filter("n_docs = 0").count()
        return self._with(anew, keys, gone=index.gone)._changed(left.limit(0), left)

    def screened(self, rows: DataFrame) -> DataFrame:
        """Postings whose key the filter of its shard may hold."""
        dealt = rows.withColumn("shard", self.shard())
        slices = dealt.groupBy("shard").agg((1 + F.floor(F.count("*") / SLICE_LINES)).cast("int").alias("slices"))
        slices = slices.join(self.filters, "shard")
        lines = dealt.join(slices.select("shard", "slices"), "shard").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
        copies = slices.select(F.col("shard").alias("of_shard"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("of_slice"), "slots")

        def probe(lines: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            columns = lines[[*KEY, "doc_id"]]
            if not len(lines) or not len(held):
                return columns.iloc[:0]
            return columns[CuckooFilter.load(held.slots.iloc[0]).contains(lines.key_hi.to_numpy(), lines.key_lo.to_numpy())]

        return lines.groupBy("shard", "slice").cogroup(copies.groupBy("of_shard", "of_slice")).applyInPandas(probe, POSTINGS)

    def drops(self, rows: DataFrame | None = None) -> DataFrame:
        """(doc_id, keys): per document the repeated keys that a document with a larger id keeps."""
        exact = self.repeated().select(*KEY, "last_doc")
        lost = self.screened(self.postings if rows is None else rows).join(exact, KEY).filter(F.col("doc_id") != F.col("last_doc"))
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("keys"))


def drop_lines(docs: DataFrame, drops: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """The documents without the lines of their keys in ``drops``; ``counts`` names columns for lines and dropped lines."""
    mark, keys = common.fresh(docs, "line_doc"), common.fresh(docs, "line_keys")
    joined = docs.withColumn(mark, common.id_key(docs[id_col])).join(drops.select(F.col("doc_id").alias(mark), F.col("keys").alias(keys)), mark, "left")
    joined = joined.select(*(joined[f"`{c}`"] for c in docs.columns), keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if counts:
        kinds += f", `{counts[0]}` long, `{counts[1]}` long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[keys]
            pairs = np.stack([lists.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1).astype(">i8") if len(lists.values) else np.empty((0, 2), ">i8")
            ends, raw = lists.offsets.to_pylist(), pairs.tobytes()
            texts, lines, dropped = [], [], []
            for row, text in enumerate(common.raw_texts(batch[text_col])):
                parts = text.split(b"\n")
                kept = parts
                if ends[row] != ends[row + 1]:
                    gone = {raw[16 * i : 16 * i + 16] for i in range(ends[row], ends[row + 1])}
                    kept = [x for x in parts if (k := line_key(x.lower(), min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                texts.append(b"\n".join(kept))
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            batch = batch.drop_columns([keys])
            # a text that loses nothing stays as it is, null included
            old = batch[text_col]
            new = pa.array([None if not d and not o.is_valid else t for t, d, o in zip(texts, dropped, old, strict=True)], pa.binary()).cast(old.type)
            batch = common.replaced(batch, text_col, new)
            if counts:
                batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*batch.schema.names, *counts])
            yield batch

    return joined.mapInArrow(cut, kinds)


def deduplicate(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """Documents without repeated lines: one stays in the largest document id that holds it.

    Repeats inside that document stay. Documents that lose all lines stay with an empty text. A null text is one empty
    line. Rows that repeat an id are one document when documents are counted.
    """
    index = LineIndex.build(docs, min_docs, min_chars, id_col, text_col)
    return drop_lines(docs, index.drops(), min_chars, id_col, text_col, counts)


def line_report(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each document row."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    kept = deduplicate(narrow, min_docs, min_chars, counts=("n_lines", "n_dropped"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest)
