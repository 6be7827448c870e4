"""Line dedup against brute force; insertions and deletions against building anew."""

import random

import brute
import numpy as np
import pytest

from panelcast.llm import line_dedup
from panelcast.llm.line_dedup import CuckooFilter, LineIndex

DOCS = "doc_id long, text string"


def table(seed, n=60):
    rng = random.Random(seed)
    common = [f"Common line number {i} with Été and more than forty characters" for i in range(12)]
    docs = {}
    for i in range(n):
        lines = [rng.choice(common) for _ in range(rng.randint(0, 8))] + [f"own line {i} {rng.random()} of some length, long enough"] * rng.randint(0, 2)
        lines = [rng.choice([x, x.upper(), f" \t{x}\x0b ", x[:39], "é" * 39, "é" * 40, ""]) for x in lines]
        docs[i] = "\n".join(lines)
    return docs | {n: None, n + 1: "", n + 2: "\n\n"}


@pytest.mark.parametrize("seed", [1, 2])
def test_report_matches_brute_force(spark, seed):
    docs = table(seed)
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.line_report(spark.createDataFrame(list(docs.items()), DOCS)).collect()}
    assert got == brute.deduplicated_lines(docs)


def test_insert_and_delete_are_reversible(spark):
    docs = list(table(4, 50).items())
    frame = lambda rows: spark.createDataFrame(rows, DOCS)
    state = lambda index: (sorted(map(tuple, index.references.collect())), sorted((r.doc_id, sorted(map(tuple, r["keys"]))) for r in index.drops().collect()))
    half = LineIndex.build(frame(docs[:25]))
    whole = half.insert(frame(docs[25:]))
    assert state(whole) == state(LineIndex.build(frame(docs)))
    assert state(whole.insert(frame(docs[:30]))) == state(whole)
    assert state(whole.delete(frame(docs[25:]))) == state(half)
    assert state(whole.delete(frame(docs[:25]))) == state(LineIndex.build(frame(docs[25:])))
    assert state(whole.delete(frame(docs))) == ([], [])


def test_growth_deals_shards_anew_and_parts_become_one(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 40)
    monkeypatch.setattr(line_dedup, "COMPACT", 4)
    docs = [(i, "\n".join(f"line {(i * 7 + j) % 400} of forty characters or more, certainly" for j in range(20))) for i in range(120)]
    frame = lambda rows: spark.createDataFrame(rows, DOCS)
    state = lambda index: (sorted(map(tuple, index.references.collect())), sorted((r.doc_id, sorted(map(tuple, r["keys"]))) for r in index.drops().collect()))
    index = LineIndex.build(frame(docs[:3]))
    few = index.shards
    for at in range(3, 120, 39):
        index = index.insert(frame(docs[at : at + 39]))
    whole = LineIndex.build(frame(docs))
    assert few < 3 and whole.shards / 2 <= index.shards <= 2 * whole.shards and index.keys == whole.keys and state(index) == state(whole)
    index = index.delete(frame(docs[60:]))  # the fourth change
    assert index.version == 0 and state(index) == state(LineIndex.build(frame(docs[:60])))
    again = index.delete(frame(docs[10:60])).insert(frame(docs[10:60]))
    assert again.version == 2 and again.keys == index.keys and state(again) == state(index)


def test_a_very_long_line_and_text(spark):
    long = "x y " * 500_000
    docs = {i: long + f"\nown {i}" for i in range(5)} | {9: "short\n" * 300_000}
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.line_report(spark.createDataFrame(list(docs.items()), DOCS)).collect()}
    assert got == brute.deduplicated_lines(docs)


def test_hot_line_in_many_slices(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE_LINES", 50)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 100)
    hot = "the same very long line that nearly every document has"
    docs = {i: (hot + "\n" if i % 3 else "") + f"its own line, number {i}, which is long enough" for i in range(900)}
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.line_report(spark.createDataFrame(list(docs.items()), DOCS)).collect()}
    assert got == brute.deduplicated_lines(docs)


def test_null_ids_repeated_rows_and_extra_columns(spark):
    line = "a line that is certainly longer than forty characters"
    rows = [(i, line, "k", 1) for i in range(4)] + [(3, line, None, 2), (None, line + "\nx", "k", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keys string, line_keys int")
    out = line_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(0, "", "k", 1), (1, "", "k", 1), (2, "", "k", 1), (3, line, "k", 1), (3, line, None, 2), (None, "x", "k", 3)], df.schema).collect()))
    assert line_dedup.line_report(df.limit(0)).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(7)
    hi, lo = rng.integers(-(2**62), 2**62, (2, 5000))
    made = CuckooFilter.sized(5000)
    assert made.insert(hi, lo) and made.contains(hi, lo).all()
    other = rng.integers(-(2**62), 2**62, (2, 20000))
    assert made.contains(*other).mean() < 0.001
    made.delete(hi[:2500], lo[:2500])
    assert made.contains(hi[2500:], lo[2500:]).all() and made.contains(hi[:2500], lo[:2500]).mean() < 0.01
    assert CuckooFilter.load(made.dump()).contains(hi[2500:], lo[2500:]).all()
    small = CuckooFilter.sized(4)
    assert not small.insert(hi, lo)
