"""MinHash near-duplicates with an LSH forest.

A document is the set of its word shingles; equal sets are one class. A tree of the forest is the order of all classes by
one signature, so that classes with a long common prefix are neighbours. Links are confirmed on full sets and only few
pairs need confirming:

1. In each tree a class meets the neighbour with the longest common prefix, and the most central class (the hub) of its
   region (the classes that share ``BASE`` values). Regions of more than ``CROWD`` classes are read one value deeper, and
   deeper again where they stay crowded; a class of such a region also meets the hub of the deepest part that it reaches.
   Confirmed links make components, and large groups of near copies fall into one component at a few pairs a class.
2. A region whose classes are in one component is finished, whatever its size. In a region that still holds several, each
   class is compared with the region's hub. Classes outside the largest component then meet all others that their sizes,
   their unshared shingles and what both have in common with the hub allow, at ``BASE`` values and not at the depth of
   step 1, so that a deeper region loses no link.

A pair of similarity 0.8 shares no region with probability (1 - 0.8**2)**16, below 1e-7. Unshared shingles, those that no
other candidate has, bound the overlap of any pair exactly, so bounds lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.llm.graph import components
from panelcast.sources.staging import stage

TREES, DEPTH, BASE = 16, 8, 2
#: Parts of a hub's set, by hash, in which overlaps with it are counted.
PARTS = 128
#: Hubs of more than so many times the shingles of a class are no bound for it.
LARGE_HUB = 4
#: Classes beyond which a region is read one value deeper.
CROWD = 64
#: Classes with one prefix that are sorted together; more of them are dealt over slices.
REGION_SLICE = 50_000
_rng = np.random.default_rng(20_240_601)
_FACTORS = (_rng.integers(0, 2**32, (TREES * DEPTH, 1), dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFTS = _rng.integers(0, 2**32, (TREES * DEPTH, 1), dtype=np.uint64).astype(np.uint32)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, a text without words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(common.window_hashes(common.word_hashes(words), min(size, len(words)), salt=4))


def signature(found: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` minimum values."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):  # keeps the table of a very long text small
        np.minimum(least, (_FACTORS * low[at : at + 2048] + _SHIFTS).min(1), out=least)
    return least


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, n_shingles, set_key, signature): the values of all trees as big-endian bytes, null without words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, keys, values = [], [], []
                for text in common.raw_texts(batch["text"]):
                    found = shingles(text, size)
                    sizes.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    values.append(signature(found).astype(">u4").tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "row", "n_shingles", "set_key", "signature"])

    return docs.mapInArrow(make, "doc_id long, row long, n_shingles long, set_key binary, signature binary")


def forest(classes: DataFrame) -> DataFrame:
    """(id, tree, order, region): one row per class and tree."""
    trees = classes.select("id", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    order = F.substring("signature", F.col("tree") * 4 * DEPTH + 1, F.lit(4 * DEPTH))
    trees = trees.select("id", "tree", order.alias("order"))
    return trees.withColumn("region", F.xxhash64("tree", F.substring("order", 1, 4 * BASE)))


def neighbours(rows: DataFrame) -> DataFrame:
    """(a, b, depth): classes next to each other in an order and the number of values they share."""
    deep = rows.withColumn("part", F.xxhash64("tree", F.substring("order", 1, 8 * BASE)))
    crowded = stage(deep.groupBy("part").count().filter(F.col("count") > REGION_SLICE).select("part", F.ceil(F.col("count") / REGION_SLICE).alias("slices")), "crowded")
    deep = deep.join(crowded, "part", "left").withColumn("slice", F.pmod(F.xxhash64("id"), F.coalesce("slices", F.lit(1))))
    ordered = deep.repartition("part", "slice").select("tree", "slice", "order", "id").sortWithinPartitions("tree", "slice", "order", "id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch["order"].to_pylist()), ">u4").reshape(-1, DEPTH)
            place = np.stack([batch["tree"].to_numpy(), batch["slice"].to_numpy()], 1)
            ids = batch["id"].to_numpy()
            if last is not None:
                values, place, ids = np.concatenate([last[0], values]), np.concatenate([last[1], place]), np.concatenate([last[2], ids])
            last = values[-1:], place[-1:], ids[-1:]
            depth = np.cumprod(values[1:] == values[:-1], 1).sum(1)
            near = (depth >= BASE) & (place[1:] == place[:-1]).all(1) & (ids[1:] != ids[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[:-1][near]), pa.array(ids[1:][near]), pa.array(depth[near])], ["a", "b", "depth"])

    return ordered.mapInArrow(walk, "a long, b long, depth long")


def unshared(texts: DataFrame, size: int) -> DataFrame:
    """(id, own): shingles of each candidate that no other candidate has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [shingles(t, size) for t in common.raw_texts(batch["text"])]
                ids = np.repeat(batch["id"].to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(ids)], ["shingle", "id"])

    single = texts.mapInArrow(each, "shingle long, id long").groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    return single.filter("id = other").groupBy("id").agg(F.count("*").alias("own"))


def possible(a: str, b: str, percent: int):
    """Whether sizes and unshared shingles leave room for a link."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    most = F.least(n - F.col(f"{a}.own"), m - F.col(f"{b}.own"))
    return most * (100 + percent) >= (n + m) * percent


def within_hub(a: str, b: str, percent: int):
    """Whether two classes compared with the hub of their region can be linked: what they share lies in the hub or is held
    by others.

    In each part of the hub they share at most what the one with less there has; the parts tell apart classes that lack
    different shingles of the hub, which sizes alone cannot. Without counts, or with several sets of one id, they may.
    """
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    rest = [F.greatest(F.col(f"{x}.n_shingles") - F.col(f"{x}.shared") - F.col(f"{x}.own"), F.lit(0)) for x in (a, b)]
    in_hub = F.aggregate(F.zip_with(F.col(f"{a}.parts"), F.col(f"{b}.parts"), lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    most = in_hub + F.least(*rest)
    return F.coalesce(most * (100 + percent) >= (n + m) * percent, F.lit(True))


def deeper_hubs(placed: DataFrame) -> DataFrame:
    """(a, b): classes of crowded regions and the most central class of the deepest part of them that each class reaches.

    ``placed`` has (id, tree, order, region, lone). A part that holds more than ``CROWD`` classes is read one value deeper,
    up to ``DEPTH``; each step reads only the rows that are still crowded.
    """
    parts = placed.select("id", "tree", "order", "lone", F.col("region").alias("part"))
    reached = []
    for depth in range(BASE + 1, DEPTH + 1):
        crowded = stage(parts.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("part"), "crowded")
        if crowded.isEmpty():
            break
        deeper = F.xxhash64("tree", F.substring("order", 1, 4 * depth))
        parts = stage(parts.join(crowded, "part", "left_semi").withColumn("part", deeper).select("id", "tree", "order", "lone", "part"), "deeper")
        hubs = parts.groupBy("part").agg(F.min_by("id", F.struct("lone", "id")).alias("hub"), F.min("lone").alias("hub_lone"), F.max("id").alias("last"), F.min("id").alias("first"))
        reached.append(parts.join(hubs.filter("first < last"), "part").select("id", "hub", "hub_lone", F.lit(-depth).alias("level")))
    if not reached:
        return placed.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    every = reduce(DataFrame.unionAll, reached)
    return every.groupBy("id").agg(F.min_by("hub", F.struct("level", "hub_lone", "hub")).alias("b")).select(F.col("id").alias("a"), "b")


def first_meeting(a: str, b: str):
    """Whether this region is the first that both classes lie in, so that a pair comes once, not once per tree."""
    same = F.filter(F.zip_with(F.col(f"{a}.regions"), F.col(f"{b}.regions"), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    return F.coalesce(F.get(same, F.lit(0)) == F.col(f"{a}.region"), F.lit(True))


def compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, both, parts, n_a, n_b): the pairs with the sizes of their full sets and of what both hold, as a whole and in
    ``PARTS`` parts by hash."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, known = None, None  # a hub's pairs come one after the other
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            both, parts, n_a, n_b = [], [], [], []
            for text_a, text_b in zip(common.raw_texts(batch["text_a"]), common.raw_texts(batch["text_b"]), strict=True):
                if text_b != before:
                    before, known = text_b, shingles(text_b, size)
                other = shingles(text_a, size)
                common_to_both = np.intersect1d(other, known, assume_unique=True)
                both.append(len(common_to_both))
                parts.append(np.bincount((common_to_both % np.uint64(PARTS)).astype(np.int64), minlength=PARTS))
                n_a.append(len(other)), n_b.append(len(known))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(both, pa.int64()), pa.array(parts, pa.list_(pa.int32())), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64())], ["a", "b", "both", "parts", "n_a", "n_b"])

    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(count, "a long, b long, both long, parts array<int>, n_a long, n_b long")


def confirmed(found: DataFrame, percent: int) -> DataFrame:
    """The compared pairs that are links."""
    return found.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b").distinct()


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): confirmed links that connect everything that is linked at all."""
    trees = forest(classes)
    shared = trees.groupBy("region").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("region")
    members = stage(trees.join(shared, "region").select("id", "tree", "order", "region"), "forest")
    ids = members.select("id").distinct()
    wanted = classes.select("id", "row", "n_shingles").join(ids, "id")
    texts = docs.join(wanted.select(F.col("id").alias("doc_id"), "row"), ["doc_id", "row"]).select(F.col("doc_id").alias("id"), "text")
    texts = stage(texts, "texts")
    # an id that stands for several sets has no bound of its own
    several = wanted.groupBy("id").agg(F.count("*").alias("sets"))
    own = F.when(F.col("sets") == 1, F.coalesce("own", F.lit(0))).otherwise(0)
    facts = stage(wanted.join(several, "id").join(unshared(texts, size), "id", "left").select("id", "n_shingles", own.alias("own")), "facts")

    def allowed(pairs: DataFrame) -> DataFrame:
        a, b = facts.alias("fa"), facts.alias("fb")
        joined = pairs.join(a, F.col("a") == F.col("fa.id")).join(b, F.col("b") == F.col("fb.id"))
        return joined.filter(possible("fa", "fb", percent)).select("a", "b", *[c for c in pairs.columns if c not in ("a", "b")])

    near = allowed(neighbours(members)).groupBy("a", "b").agg(F.sum("depth").alias("depth"))
    near = stage(near, "neighbours")
    both = near.unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "depth"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("depth", "b")).alias("b"))
    placed = members.join(facts, "id").withColumn("lone", F.col("own") / F.col("n_shingles"))
    placed = stage(placed, "members")
    hubs = stage(placed.groupBy("region").agg(F.min_by("id", F.struct("lone", "id")).alias("hub"), F.min("lone").alias("hub_lone"), F.min_by("n_shingles", F.struct("lone", "id")).alias("hub_n")), "hubs")
    central = placed.join(hubs, "region").groupBy("id").agg(F.min_by("hub", F.struct("hub_lone", "hub")).alias("b")).select(F.col("id").alias("a"), "b")
    meets = best.unionAll(central).unionAll(deeper_hubs(placed)).filter("a <> b")
    pairs = allowed(meets.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = stage(compared(pairs, texts, size), "compared")
    first = confirmed(found, percent)

    grouped = components(first)
    placed = placed.join(grouped, placed["id"] == grouped["node"], "left").select("id", "region", "n_shingles", "own", F.coalesce("component", "id").alias("component"))
    placed = stage(placed, "members")
    mixed = placed.groupBy("region").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter("c < d").select("region")
    counts = placed.join(mixed, "region", "left_semi").groupBy("region", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("region").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    open_rows = stage(placed.join(largest, "region").join(hubs.select("region", "hub", "hub_n"), "region"), "mixed")
    # what each class has in common with the hub of a region bounds what two classes of the region can have in common
    least, greatest = F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")
    # a hub many times as large tells little, and its text would go to every pair; too large for a link, it need not be met
    near_hub = (F.col("hub_n") <= LARGE_HUB * F.col("n_shingles")) | (100 * F.col("n_shingles") >= percent * F.col("hub_n"))
    wanting = open_rows.filter((F.col("id") != F.col("hub")) & near_hub).select(least, greatest).distinct().join(found.select("a", "b").distinct(), ["a", "b"], "left_anti")
    also = stage(compared(wanting, texts, size), "compared")
    known = found.unionAll(also).groupBy("a", "b").agg(F.max("both").alias("shared"), F.first("parts").alias("parts"))
    single = several.filter("sets = 1").select("id")
    orders = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring("signature", t * 4 * DEPTH + 1, F.lit(4 * BASE))))
    regions = classes.select("id", orders.alias("regions")).join(single, "id")
    shared_with = open_rows.select("id", "region", "hub", least, greatest).join(known, ["a", "b"]).join(single, "id").join(single.select(F.col("id").alias("hub")), "hub")
    open_rows = open_rows.join(shared_with.select("id", "region", "shared", "parts"), ["id", "region"], "left").join(regions, "id", "left")
    open_rows = stage(open_rows.filter("id <> hub"), "mixed")  # the hub has met them all
    minor = open_rows.filter("component <> largest").alias("m")
    rest = open_rows.alias("r")
    once = (F.col("r.component") == F.col("r.largest")) | (F.col("m.id") < F.col("r.id"))
    other = (F.col("m.region") == F.col("r.region")) & (F.col("m.component") != F.col("r.component"))
    met = minor.join(rest, other & once & possible("m", "r", percent) & first_meeting("m", "r") & within_hub("m", "r", percent))
    second = met.select(F.least("m.id", "r.id").alias("a"), F.greatest("m.id", "r.id").alias("b")).distinct()
    return first.unionAll(confirmed(also, percent)).unionAll(confirmed(compared(second, texts, size), percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document row.

    Documents with 100 * intersection >= ``percent`` * union are linked; a component's id is its smallest document id, and
    that document is kept. Documents without words are linked with nothing. Rows that repeat an id are one document: they
    are connected, and stay or go together.
    """
    base = common.documents(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    found = stage(signatures(base, size), "signatures")
    first = F.min(F.struct("doc_id", "row")).alias("first")
    classes = found.filter("n_shingles > 0").groupBy("set_key", "n_shingles").agg(first, F.first("signature").alias("signature"))
    classes = stage(classes.select("set_key", "n_shingles", "signature", F.col("first.doc_id").alias("id"), F.col("first.row").alias("row")), "classes")
    member = stage(found.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "id"), "set_key", "left"), "class-members")
    linked = links(base, classes, size, percent)
    # the classes of an id that occurs with several texts belong together
    several = member.filter("id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
    tied = member.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("id").alias("b"))
    grouped = components(linked.unionAll(tied))
    out = member.join(grouped, member["id"] == grouped["node"], "left")
    component = F.coalesce("component", "id", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    return out.withColumns({"doc_id": common.public_id(F.col("doc_id")), "component_id": common.public_id(F.col("component_id"))})


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, columns as they were."""
    report = near_duplicates(docs, size, percent, id_col, text_col)
    kept = report.filter("kept").select(common.id_key(F.col("doc_id")).alias("kept_doc")).distinct()
    mark = common.fresh(docs, "kept_doc")
    kept = kept.withColumnRenamed("kept_doc", mark)
    return docs.withColumn(mark, common.id_key(docs[id_col])).join(kept, mark, "left_semi").drop(mark)
