"""The prefix trie of conversations: which turns conversations share, and what sharing saves.

Every turn becomes a digest of role and text. Distinct turn sequences are range-partitioned in their order, so that the ones
below any node of the trie are neighbours. In a partition, the neighbours' longest common prefixes (LCP) are edges; taken by
descending depth, they are united: two components that meet at a depth are the children of a branching node there. What
holds neither the first nor the last sequence of the partition is finished. The rest, the two outer paths, is contracted to
one item per node, and the items of ``FAN`` partitions are united again over the LCP at their boundaries, until one forest
remains. All turns on the way to a node have the node's members, so finished nodes are kept as chains (conversation, first
and last depth) and unrolled at the end.

What grows: a task holds the LCP numbers of ``FOREST_ROWS`` sequences and one sequence at a time, which ends where no other
sequence goes on alike (at the next power of two); a conversation of any length is numbered, hashed and unrolled in pieces.
Copies of one conversation, were it a third of all, are one sequence; only the digest over their ids is taken in order, from
chunks of text.

Defined results: null roles and texts are empty, turns are ordered by number (null first) and equal numbers by digest, so
repeated rows stay. A null conversation id is one conversation, smaller than all others, has no base and is written "null"
in ``ends_sha256``. The base of c is c - c % 20 with the sign of SQL's remainder. Other columns are never read. An empty
table gives no rows, as even the root has no member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.sources.staging import stage

#: Turns of one conversation that meet in one task of a join.
SLICE = 100_000
#: Turns in a task that numbers them, ids in a text chunk, sequences in a task's forest, forests united by one task.
TURNS, CHUNK, FOREST_ROWS, FAN = 500_000, 5_000, 20_000, 64
#: Characters of a turn's digest in a sequence.
DIGEST = 32
WORD = r"[^\x20\x09-\x0D]+"


def digests(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, sym, words); the texts are not needed any more."""
    role, text = (F.coalesce(rows[c], F.lit("")) for c in (role_col, text_col))
    sym = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    return rows.select(common.id_key(rows[conv_col]).alias("conv"), rows[turn_col].alias("turn"), sym.alias("sym"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, pos, sym, words, upto): place from 0, and words of the conversation up to and with the turn.

    Turns are dealt by ranges of (conv, turn), so a long conversation spreads over tasks; what a task must add for the
    conversation that began before it is one row per task.
    """
    turns = stage(turns, "turns")
    parts = max(turns.sparkSession.sparkContext.defaultParallelism, 1 + turns.count() // TURNS)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("sym")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, w = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, words = batch["conv"].to_numpy(), batch["words"].to_numpy()
            begins = np.concatenate(([conv[0] != last], conv[1:] != conv[:-1]))
            starts, run, total = np.flatnonzero(begins), np.cumsum(begins), np.cumsum(words)
            k = np.arange(len(conv)) - np.concatenate(([-n], starts))[run]
            upto = total - np.concatenate(([-w], total[starts] - words[starts]))[run]
            last, n, w = conv[-1], int(k[-1]) + 1, int(upto[-1])
            columns = [batch["conv"], pa.array(np.full(len(conv), part)), pa.array(k), batch["sym"], batch["words"], pa.array(upto)]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "part", "pos", "sym", "words", "upto"])

    dealt = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "sym", "words")
    local = stage(dealt.mapInArrow(count, "conv long, part long, pos long, sym string, words long, upto long"), "numbered-in-part")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = local.groupBy("conv", "part").agg((F.max("pos") + 1).alias("n"), F.max("upto").alias("w"))
    carried = ends.select("conv", "part", F.sum("n").over(before).alias("n"), F.sum("w").over(before).alias("w")).filter("n IS NOT NULL")
    joined = local.join(F.broadcast(carried), ["conv", "part"], "left")  # at most a row per task
    add = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return stage(joined.select("conv", add("pos", "n"), "sym", "words", add("upto", "w")), "numbered")


def slice_of(pos: str) -> Column:
    return F.floor(F.col(pos) / SLICE).alias("slice")


def slices(n: Column) -> Column:
    """A row for each slice of a conversation of n turns, one at least."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((n - 1) / SLICE), F.lit(0)))).alias("slice")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of the conversations whose first h turns are those of their base: crc32(id) % heads of them.

    Returns (conv, pos, sym, words, upto) and (conv, length); a conversation may be left without turns.
    """
    head = F.when(F.col("pos") < heads - 1, F.struct("pos", "sym", "words", "upto"))
    per = turns.groupBy("conv").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(head)).alias("head"))
    known = F.col("conv") != common.NULL_ID
    h = F.when(known, F.crc32(F.col("conv").cast("string").cast("binary")) % heads).otherwise(F.lit(0).cast("long"))
    per = stage(per.withColumn("h", h).withColumn("base", F.when(known, F.col("conv") - F.col("conv") % group)), "conversations")
    bases = per.filter(F.col("conv") == F.col("base")).select("base", F.col("head").alias("base_head"))
    per = per.join(bases, "base", "left")
    per = per.withColumn("taken", F.least("h", F.coalesce(F.array_size("base_head"), F.lit(0)))).withColumn("skipped", F.least("h", "n"))
    words = lambda heads, k: F.when(F.col(k) > 0, F.get(F.col(heads), (F.col(k) - 1).cast("int"))["upto"]).otherwise(F.lit(0).cast("long"))
    per = per.withColumn("shift", F.col("taken") - F.col("h")).withColumn("more", words("base_head", "taken") - words("head", "skipped"))
    per = stage(per.withColumn("length", F.col("taken") + F.col("n") - F.col("skipped")), "rebuilt-conversations")
    first = per.filter("taken > 0").select("conv", F.explode(F.slice("base_head", F.lit(1), F.col("taken").cast("int"))).alias("t"))
    own = turns.withColumn("slice", slice_of("pos")).join(per.select("conv", "h", "shift", "more", slices(F.col("n"))), ["conv", "slice"])
    own = own.filter("pos >= h").select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "sym", "words", (F.col("upto") + F.col("more")).alias("upto"))
    return stage(first.select("conv", "t.*").unionByName(own), "rebuilt"), per.select("conv", "length")


def fingerprints() -> list[Column]:
    """128 bits of a sequence that do not depend on the order in which its turns are read."""
    return [F.bit_xor(F.xxhash64("pos", "sym")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "pos", "sym")).alias("b")]


def distinct_sequences(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, length, total, copies, ends): a row per distinct sequence with its smallest conversation, words, members and their digest."""
    none = F.lit(0).cast("long")
    keyed = turns.groupBy("conv").agg(F.count("*").alias("length"), F.max("upto").alias("total"), *fingerprints())
    empty = lengths.filter("length = 0").select("conv", "length", none.alias("total"), none.alias("a"), none.alias("b"))
    key = ["length", "total", "a", "b"]
    keyed = stage(keyed.unionByName(empty), "fingerprints")
    parts = max(turns.sparkSession.sparkContext.defaultParallelism, 1 + keyed.count() // TURNS)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of up to CHUNK ids of one sequence as text."""
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, conv = np.column_stack([batch[c].to_numpy() for c in key]), batch["conv"].to_pylist()
            new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))
            cuts = sorted({*np.flatnonzero(new).tolist(), *range(0, len(conv), CHUNK)})
            rows = [(*keys[a].tolist(), conv[a], b - a, ",".join("null" if c == common.NULL_ID else str(c) for c in conv[a:b])) for a, b in zip(cuts, [*cuts[1:], len(conv)], strict=True)]
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*key, "conv", "copies", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, n, sha, out = None, 0, 0, None, []
        for batch in batches:
            for *own, conv, copies, ids in zip(*(batch[c].to_pylist() for c in [*key, "conv", "copies", "ids"]), strict=True):
                if own != last:
                    if sha:
                        out.append((first, *last[:2], n, sha.hexdigest()))
                    last, first, n, sha = own, conv, copies, hashlib.sha256(ids.encode())
                else:
                    n += copies
                    sha.update(f",{ids}".encode())
            if len(out) > 10_000:
                yield table(out)
                out = []
        yield table(out + ([(first, *last[:2], n, sha.hexdigest())] if sha else []))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", "length", "total", "copies", "ends"])

    dealt = keyed.repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv").select(*key, "conv")
    chunks = dealt.mapInArrow(written, "length long, total long, a long, b long, conv long, copies long, ids string")
    ordered = chunks.repartition(parts, *key).sortWithinPartitions(*key, "conv")
    return stage(ordered.mapInArrow(digested, "conv long, length long, total long, copies long, ends string"), "distinct-sequences")


def lone_depths(paths: DataFrame, least: int = 32) -> DataFrame:
    """(conv, depth): the first power of two at which no other sequence has the same beginning, for sequences that have one."""
    bits = (least - 1).bit_length()
    band = F.greatest(F.lit(bits), F.char_length(F.bin("pos"))).alias("band")  # turns below 2 ** band
    parts = paths.groupBy("conv", band).agg(F.max("pos").alias("last"), *fingerprints())
    upto = Window.partitionBy("conv").orderBy("band")
    begun = parts.select("conv", "band", "last", F.bit_xor("a").over(upto).alias("a"), F.bit_xor("b").over(upto).alias("b"))
    depth = F.expr("shiftleft(1L, band)")
    full = begun.withColumn("depth", depth).filter("last + 1 = depth")
    alone = full.groupBy("depth", "a", "b").agg(F.count("*").alias("n"), F.min("conv").alias("conv")).filter("n = 1")
    return alone.groupBy("conv").agg(F.min("depth").alias("depth"))


@dataclass
class Node:
    """A node of a forest: its smallest member, depth, members, finished children and the leaves below them, words saved below
    it, words up to it, the digest of conversations that end here, and the names under which children refer to it."""

    conv: int
    depth: int
    n: int
    children: int
    leaves: int
    below: int
    upto: int
    ends: str | None = None
    refs: list[str] = field(default_factory=list)

    def absorb(self, other: Node) -> None:
        """The same node, seen from two components."""
        self.conv, self.n = min(self.conv, other.conv), self.n + other.n
        self.children, self.leaves, self.below = self.children + other.children, self.leaves + other.leaves, self.below + other.below
        self.ends = self.ends or other.ends
        self.refs += other.refs

    def hang(self, child: Node) -> None:
        self.conv, self.n, self.children = min(self.conv, child.conv), self.n + child.n, self.children + 1
        self.leaves += child.leaves or 1
        self.below += child.below + (child.n - 1) * (child.upto - self.upto)


def unite(nodes: list[Node], edges: list[tuple[int, int]], label: str, last: bool) -> tuple[list[tuple], list[tuple[str, int]], list[tuple[Node, int, int]]]:
    """Unites neighbours over their edges (LCP, words up to it) by descending LCP.

    Returns chains (conv, top, bottom, n, children, leaves, below, upto, ends, parent conversation, name of the parent), what
    names turned out to be, and the open nodes with the edge to the next one. With ``last`` nothing stays open.
    """
    count = len(nodes)
    if not count:
        return [], [], []
    nodes = list(nodes)
    group, low, high, top = list(range(count)), list(range(count)), list(range(count)), list(range(count))
    same: dict[int, int] = {}
    done: list[tuple[int, int]] = []  # (child, parent)
    left: list[int] = []
    right: list[int] = []

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for e in sorted(range(count - 1), key=lambda e: -edges[e][0]):
        depth, upto = edges[e]
        a, b = find(e), find(e + 1)
        x, y = top[a], top[b]
        node = next((k for k in (x, y) if nodes[k].depth == depth), None)
        if node is None:
            node = len(nodes)
            nodes.append(Node(2**63 - 1, depth, 0, 0, 0, 0, upto))
        for child, is_open, path in ((x, low[a] == 0, left), (y, high[b] == count - 1, right)):
            if child == node:
                continue
            if nodes[child].depth == depth:
                nodes[node].absorb(nodes[child])
                same[child] = node
            elif is_open and not last:
                path.append(child)
            else:
                nodes[node].hang(nodes[child])
                done.append((child, node))
        group[b], high[a], top[a] = a, high[b], node
    head = top[find(0)]
    if last and nodes[head].depth:
        nodes.append(Node(2**63 - 1, 0, 0, 0, 0, 0, 0))
        nodes[-1].hang(nodes[head])
        done.append((head, len(nodes) - 1))
        head = len(nodes) - 1
    open_nodes = [] if last else [*left, head, *reversed(right)]
    names = {k: f"{label}-{i}" for i, k in enumerate(open_nodes)}
    chains, known = [], []
    for child, node in [*done, *([(head, None)] if last else [])]:
        while node in same:
            node = same[node]
        c, above = nodes[child], None if node is None else nodes[node]
        parent = (None, None) if above is None else (None, names[node]) if node in names else (above.conv, None)
        chains.append((c.conv, above.depth + 1 if above else 0, c.depth, c.n, c.children, c.leaves or 1, c.below, c.upto, c.ends, *parent))
        known += [(ref, c.conv) for ref in c.refs]
    for k in open_nodes:
        nodes[k].refs = [*nodes[k].refs, names[k]]
    after = [min((nodes[k], nodes[j]), key=lambda x: x.depth) for k, j in zip(open_nodes, open_nodes[1:], strict=False)]
    return chains, known, [(nodes[k], x.depth, x.upto) for k, x in zip(open_nodes, [*after, *([nodes[open_nodes[-1]]] if open_nodes else [])], strict=True)]


FOREST = (
    "kind int, part long, at int, conv long, top long, depth long, n long, children long, leaves long, below long, upto long, ends string, "
    "parent long, parent_ref string, refs array<string>, edge long, edge_upto long, first string, last string, last_upto array<long>"
)
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
_FIELDS = [(name, _ARROW[kind]) for name, kind in (f.split(" ") for f in FOREST.split(", "))]
CHAIN, KNOWN, OPEN = 0, 1, 2


def common_depth(a: str, b: str, upto: list[int]) -> tuple[int, int]:
    """Turns that two sequences share at their beginning, and the words of these."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n : n + DIGEST] == b[n : n + DIGEST]:
        n += DIGEST
    n //= DIGEST
    return n, upto[n - 1] if n else 0


def forest_rows(found, part: int, first: str, last: str, last_upto: list[int]) -> pa.RecordBatch:
    chains, known, open_nodes = found
    rows = [dict(zip(("conv", "top", "depth", "n", "children", "leaves", "below", "upto", "ends", "parent", "parent_ref"), c, strict=True), kind=CHAIN) for c in chains]
    rows += [{"kind": KNOWN, "parent_ref": ref, "conv": conv} for ref, conv in known]
    for at, (x, edge, upto) in enumerate(open_nodes):
        rows.append({"kind": OPEN, "part": part, "at": at, "edge": edge, "edge_upto": upto, **{k: getattr(x, k) for k in ("conv", "depth", "n", "children", "leaves", "below", "upto", "ends", "refs")}})
        rows[-1] |= {"first": first} if at == 0 else {}
        rows[-1] |= {"last": last, "last_upto": last_upto} if at == len(open_nodes) - 1 else {}
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in _FIELDS], [name for name, _ in _FIELDS])


def first_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a partition of sorted sequences (conv, length, total, copies, ends, seq, upto)."""
    part, nodes, edges, first, seq, upto = TaskContext.get().partitionId(), [], [], None, "", []
    for batch in batches:
        for conv, length, total, copies, ends, own, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if nodes:
                edges.append(common_depth(seq, own, upto))
            else:
                first = own
            nodes.append(Node(conv, length, copies, 0, 0, 0, total, ends))
            seq, upto = own, words
    yield forest_rows(unite(nodes, edges, f"0-{part}", False), part, first, seq, upto)


def united_forests(rows: Iterable, label: str, part: int, last: bool) -> pa.RecordBatch:
    """Forests of neighbouring partitions, given by their open nodes in order."""
    nodes, edges, first, seq, upto = [], [], None, "", []
    for r in rows:
        if r.first is not None and nodes:
            edges[-1] = common_depth(seq, r.first, upto)
        first = r.first if first is None else first
        nodes.append(Node(r.conv, r.depth, r.n, r.children, r.leaves, r.below, r.upto, r.ends, list(r.refs)))
        edges.append((r.edge, r.edge_upto))
        if r.last is not None:
            seq, upto = r.last, list(r.last_upto)
    return forest_rows(unite(nodes, edges[:-1], label, last), part, first, seq, upto)


def merging(round_: int, last: bool):
    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "at"]).astype(object).where(lambda x: x.notna(), None)
        return united_forests(pdf.itertuples(index=False), f"{round_}-{key[0]}", key[0], last).to_pandas()

    return merge


def forest(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of all nodes, and what the names of their parents stand for."""
    parts = 1 + sequences.count() // FOREST_ROWS
    ordered = sequences.repartitionByRange(parts, "seq").sortWithinPartitions("seq").select("conv", "length", "total", "copies", "ends", "seq", "upto")
    tables, round_ = [stage(ordered.mapInArrow(first_forest, FOREST), "forest")], 0
    while True:
        parts, round_ = -(-parts // FAN), round_ + 1
        items = tables[-1].filter(F.col("kind") == OPEN)
        tables.append(stage(items.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInPandas(merging(round_, parts == 1), FOREST), "forest"))
        if parts == 1:
            break
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionAll(t)
    return whole.filter(F.col("kind") == CHAIN), whole.filter(F.col("kind") == KNOWN).select("parent_ref", F.col("conv").alias("found"))


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the trie over (conv, pos, sym, words, upto) and (conv, length): a row per distinct beginning, the root first.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)
    """
    distinct = distinct_sequences(turns, lengths)
    of = distinct.select("conv", slices(F.col("length")))
    paths = stage(turns.withColumn("slice", slice_of("pos")).join(of, ["conv", "slice"]).drop("slice"), "paths")
    cut = stage(distinct.join(lone_depths(paths), "conv", "left").withColumn("held", F.least("length", "depth")), "held")
    held = paths.withColumn("slice", slice_of("pos")).join(cut.select("conv", "held", slices(F.col("held"))), ["conv", "slice"]).filter("pos < held")
    turns_of = held.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "sym", "upto"))).alias("t"))
    turns_of = turns_of.select("conv", F.array_join("t.sym", "").alias("seq"), F.col("t.upto").alias("upto"))
    sequences = stage(cut.join(turns_of, "conv", "left").withColumn("seq", F.coalesce("seq", F.lit(""))).withColumn("upto", F.coalesce("upto", F.array().cast("array<long>"))), "sequences")
    chains, known = forest(sequences)
    chains = stage(chains.join(known, "parent_ref", "left").withColumn("parent", F.coalesce("parent", "found")), "chains")
    chunk = F.explode(F.sequence(F.col("top"), F.col("depth"), F.lit(SLICE))).alias("from")
    depths = chains.withColumn("from", chunk).withColumn("d", F.explode(F.sequence("from", F.least(F.col("from") + (SLICE - 1), F.col("depth")))))
    shared = depths.filter("n > 1").withColumn("pos", F.col("d") - 1)
    shared = shared.join(paths.select("conv", "pos", F.col("words").alias("w"), F.col("upto").alias("u")), ["conv", "pos"], "left")
    words = F.when(F.col("d") > 0, F.col("upto") - F.col("u") + F.col("w")).otherwise(F.lit(0).cast("long"))
    shared = shared.withColumn("saved", F.col("below") + (F.col("n") - 1) * words)
    single = depths.filter("n = 1").withColumn("saved", F.lit(0).cast("long"))
    columns = ["conv", "d", "top", "depth", "parent", "n", "children", "leaves", "saved", "ends"]
    nodes = single.select(columns).unionAll(shared.select(columns))
    bottom = F.col("d") == F.col("depth")
    return nodes.select(
        common.public_id(F.col("conv")).alias("conv_id"), F.col("d").alias("depth"),
        common.public_id(F.when(F.col("d") == F.col("top"), F.col("parent")).otherwise(F.col("conv"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.when(bottom & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def rebuilt_trie(rows: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """The trie of conversations that share the first turns of their base; see ``rebuilt``."""
    return prefix_trie(*rebuilt(numbered(digests(rows)), group, heads))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = numbered(digests(rows))
    return prefix_trie(turns, turns.groupBy("conv").agg(F.count("*").alias("length")))
