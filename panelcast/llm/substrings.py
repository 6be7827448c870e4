"""Substring dedup with prefix-partitioned suffix trees over words.

A suffix starts at a word; a repeat is an internal node of the suffix tree at least ``size`` words deep. Three steps keep
the trees small. Copies of whole documents are settled by a hash. Suffixes that cannot lie in a repeat are left out: every
window of ``size`` words has a smallest hashed phrase inside it, equal windows have the same one, so windows whose phrase
stands in one document alone are unique. The rest is dealt by variable-length prefixes: a prefix of ``PREFIX`` words, the
whole depth where that prefix is frequent, and where even that many words are equal in too many places, their first
document is found by an aggregate instead. Each part is sorted into suffix order, so a subtree is a run of rows and
its deep nodes are found in one pass that holds a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.sources.staging import stage

#: Words of the phrase that prunes, and of the shortest prefix that deals suffixes out.
PREFIX = 16
#: Suffixes that may share a prefix before a longer one is taken.
GROUP = 200_000
DOC = ["doc_id", "row"]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with a hash of the text, which tells apart rows that repeat an id."""
    return common.documents(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))


def least_phrases(hashes: np.ndarray, size: int) -> np.ndarray:
    """Per window of ``size`` words the smallest hash of a phrase inside it."""
    width = min(PREFIX, size)
    least, reach, need = common.window_hashes(hashes, width, 1), 1, size - width + 1
    while reach < need:
        step = min(reach, need - reach)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        reach += step
    return least


def phrases(docs: DataFrame, size: int) -> DataFrame:
    """Per document a hash of all its words, the number of windows and the distinct least phrases."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                copies, windows, anchors = [], [], []
                for text in common.raw_texts(batch["text"]):
                    words = text.split()
                    least = least_phrases(common.word_hashes(words), size)
                    copies.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    windows.append(len(least))
                    anchors.append(np.unique(least).view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in anchors])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(anchors)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(copies, pa.binary()), pa.array(windows, pa.int64()), lists], [*DOC, "words", "windows", "phrases"])

    return docs.mapInArrow(make, "doc_id long, row long, words binary, windows long, phrases array<long>")


def marks(found: DataFrame) -> DataFrame:
    """(doc_id, row, copy, phrases): later copies of a document, and documents with phrases that others have too."""
    long = found.filter("windows > 0")
    first = long.groupBy("words").agg(F.min("doc_id").alias("first_doc"))
    judged = long.join(first, "words").withColumn("copy", F.col("doc_id") > F.col("first_doc"))
    judged = stage(judged.select(*DOC, "copy", F.when(~F.col("copy"), F.col("phrases")).alias("phrases")), "phrases")
    single = judged.filter("not copy").select(*DOC, F.explode("phrases").alias("phrase"))
    shared = single.groupBy("phrase").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("phrase")
    hits = single.join(shared, "phrase").groupBy(*DOC).agg(F.collect_set("phrase").alias("phrases"))
    copies = judged.filter("copy").select(*DOC).distinct()
    return hits.select(*DOC, F.lit(False).alias("copy"), "phrases").unionAll(copies.select(*DOC, F.lit(True), F.array().cast("array<long>")))


def suffixes(docs: DataFrame, marked: DataFrame, size: int) -> DataFrame:
    """Documents with their suffixes to examine; those without any carry their result instead of their text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out = {"n_words": [], "n_removed": [], "kept_sha256": [], "rest": [], "prefix": [], "window": [], "place": []}
                shared_lists, copies = batch["phrases"], batch["copy"].to_pylist()
                for row, text in enumerate(common.raw_texts(batch["text"])):
                    words, places, shared = text.split(), np.empty(0, np.int64), shared_lists[row]
                    if shared.is_valid and len(shared):
                        hashes = common.word_hashes(words)
                        least = least_phrases(hashes, size)
                        places = np.flatnonzero(np.isin(least, np.asarray(shared.values).view(np.uint64)))
                    gone = bool(copies[row])
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) if gone else 0)
                    out["kept_sha256"].append(None if len(places) else hashlib.sha256(b"" if gone else b" ".join(words)).hexdigest())
                    out["rest"].append(text if len(places) else None)
                    out["place"].append(places)
                    for name, width, salt in (("prefix", min(PREFIX, size), 2), ("window", size, 3)):
                        out[name].append(common.window_hashes(hashes, width, salt)[places] if len(places) else np.empty(0, np.uint64))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out["place"]])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"], batch["row"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                        pa.array(out["kept_sha256"], pa.string()), pa.array(out["rest"], pa.binary()),
                        *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out[c]).astype(np.int64, copy=False) if c == "place" else np.concatenate(out[c]).view(np.int64))) for c in ("prefix", "window", "place")),
                    ],
                    [*DOC, *out],
                )

    kinds = "doc_id long, row long, n_words long, n_removed long, kept_sha256 string, rest binary, prefix array<long>, window array<long>, place array<long>"
    return docs.join(marked, DOC, "left").select(*DOC, "text", "copy", "phrases").mapInArrow(make, kinds)


def repeated_suffixes(examined: DataFrame) -> DataFrame:
    """(doc_id, row, place): suffixes at whose deep node a smaller document id hangs too."""
    rows = examined.select(*DOC, F.explode(F.arrays_zip("prefix", "window", "place")).alias("s")).select(*DOC, "s.prefix", "s.window", "s.place")
    frequent = stage(rows.groupBy("prefix").count().filter(F.col("count") > GROUP).select("prefix", F.lit(True).alias("frequent")), "frequent-prefixes")
    dealt = rows.join(frequent, "prefix", "left")
    inside = dealt.filter("frequent").groupBy("prefix", "window").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    settled = stage(inside.filter(F.col("n") > GROUP).drop("n"), "frequent-windows")
    dealt = dealt.join(settled, ["prefix", "window"], "left")
    trees = dealt.filter(F.col("first_doc").isNull())
    trees = trees.withColumn("part", F.when(F.col("frequent"), F.xxhash64("prefix", "window")).otherwise(F.xxhash64("prefix")))
    ordered = trees.select("part", "prefix", "window", *DOC, "place").repartition("part").drop("part").sortWithinPartitions("prefix", "window", "doc_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first = None, 0  # the open node of depth size, and the first document at it
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, window, doc = (batch[c].to_numpy() for c in ("prefix", "window", "doc_id"))
            opens = np.ones(len(doc), bool)
            opens[1:] = (prefix[1:] != prefix[:-1]) | (window[1:] != window[:-1])
            opens[0] = node != (prefix[0], window[0])
            starts = np.maximum.accumulate(np.where(opens, np.arange(len(doc)), -1))
            firsts = np.where(starts >= 0, doc[np.maximum(starts, 0)], first)
            node, first = (prefix[-1], window[-1]), firsts[-1]
            yield pa.RecordBatch.from_arrays([batch[c] for c in (*DOC, "place")], [*DOC, "place"]).filter(pa.array(doc > firsts))

    deep = ordered.mapInArrow(walk, "doc_id long, row long, place long")
    return deep.unionAll(dealt.filter(F.col("first_doc").isNotNull() & (F.col("doc_id") > F.col("first_doc"))).select(*DOC, "place"))


def remove_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of each document row.

    Words covered by a window of ``size`` words that also starts in a smaller document id go; windows are judged on the
    input. ``spans`` are the maximal repeats, (first word, end), null for copies that go as a whole. A null text has no
    words; texts shorter than a window stay.
    """
    base = _documents(docs, id_col, text_col)
    marked = marks(stage(phrases(base, size), "phrases"))
    examined = stage(suffixes(base, marked, size), "suffixes")
    lost = repeated_suffixes(examined).groupBy(*DOC).agg(F.collect_set("place").alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, spans = [], [], []
            lists = batch["places"]
            for row, text in enumerate(batch["rest"].to_pylist()):
                words = text.split()
                edges = np.zeros(len(words) + 1, np.int64)
                if lists[row].is_valid:
                    places = np.asarray(lists[row].values)
                    np.add.at(edges, places, 1)
                    np.add.at(edges, places + size, -1)
                gone = np.cumsum(edges[:-1]) > 0
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"first": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_words"], pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
            )

    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first: bigint, end: bigint>>"
    open_docs = examined.filter(F.col("kept_sha256").isNull()).select(*DOC, "n_words", "rest")
    done = examined.filter(F.col("kept_sha256").isNotNull())
    nothing = F.when(F.col("n_removed") == 0, F.array()).cast("array<struct<first: bigint, end: bigint>>")
    out = open_docs.join(lost, DOC, "left").select("doc_id", "n_words", "rest", "places").mapInArrow(cut, kinds)
    out = out.unionAll(done.select("doc_id", "n_words", "n_removed", "kept_sha256", nothing.alias("spans")))
    return out.withColumn("doc_id", common.public_id(F.col("doc_id")))
