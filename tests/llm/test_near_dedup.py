"""LSH forest against all pairs, on groups of copies whose similarities lie around the threshold."""

import random

import brute
import pytest

from panelcast.llm import near_dedup
from panelcast.llm.graph import components

DOCS = "doc_id long, text string"


def table(seed, groups=8, copies=25):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    docs, doc = {}, 0
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 4, 5, 12, 60, 200]))]
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 12)):
                words[rng.randrange(len(words))] = word()
            docs[doc] = rng.choice([" ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words) + rng.choice(["", " tail of it"])
            doc += 1
    order = list(docs)
    rng.shuffle(order)
    docs = dict(zip(order, docs.values(), strict=True))
    return docs | {doc: None, doc + 1: "", doc + 2: " \n", doc + 3: "one two", doc + 4: "ONE  two", doc + 5: "two one"}


def report(df, size=4):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, size, 80).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(near_dedup, "REGION_SLICE", 3)
    docs = table(seed)
    assert report(spark.createDataFrame(list(docs.items()), DOCS)) == brute.near_duplicates(docs)


@pytest.mark.parametrize("seed", [3, 4])
def test_crowded_regions_are_read_deeper_and_lose_no_link(spark, seed, monkeypatch):
    """One large group whose copies lie on both sides of the threshold, so that regions keep several components."""
    monkeypatch.setattr(near_dedup, "CROWD", 4)
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    docs = {}
    for doc in range(160):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        docs[doc] = " ".join(words)
    docs[900] = docs[3] + " w" * 200_000
    want = brute.near_duplicates(docs)
    assert len({c for _, c, _ in want.values()}) > 2
    assert report(spark.createDataFrame(list(docs.items()), DOCS)) == want


def test_null_ids_repeated_rows_extra_columns_and_empty_tables(spark):
    text, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(None, text), (4, text), (4, other), (9, other + " b30"), (7, "unlike all of it, truly"), (7, "unlike all of it, truly"), (3, None), (5, None)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, id int, component string")
    got = sorted(((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(df, 4, 80).collect()))
    assert got == [(-1, -1, True), (3, 3, True), (4, -1, False), (4, -1, False), (5, 5, True), (7, 7, True), (7, 7, True), (9, -1, False)]
    kept = near_dedup.drop_near_duplicates(df, 4)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "5", "7", "7", "None"]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:]), (500, 501), (501, 500), (600, 600)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == dict.fromkeys(range(300), 0) | {500: 500, 501: 500}
