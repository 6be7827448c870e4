"""Substring dedup against a dictionary of all windows."""

import random

import brute
import pytest

from panelcast.llm import substrings

DOCS = "doc_id long, text string"


def table(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "ça", "x,", "the", *(f"w{i}" for i in range(40))])
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.choice([49, 50, 51, 80, 300])) for _ in range(8)]
    docs = {}
    for i in range(n):
        parts = [rng.choice([rng.choice(shared), text(rng.randint(0, 70)), "loop " * 60]) for _ in range(rng.randint(1, 4))]
        docs[i] = rng.choice([" ", "\n", "\t "]).join(parts)
    for i in range(n, n + 12):
        docs[i] = docs[rng.randrange(n)] + rng.choice(["", " ", " end"])
    return docs | {n + 20: None, n + 21: "", n + 22: "one", n + 23: "same " * 4000, n + 24: "same " * 3000}


def report(df, **options):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(df, **options).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    docs = table(seed)
    assert report(spark.createDataFrame(list(docs.items()), DOCS)) == brute.repeats_removed(docs)


def test_small_groups_and_short_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 5)
    docs = table(3, 40)
    assert report(spark.createDataFrame(list(docs.items()), DOCS)) == brute.repeats_removed(docs)
    assert report(spark.createDataFrame(list(docs.items()), DOCS), size=7) == brute.repeats_removed(docs, 7)


def test_spans_null_ids_repeated_rows_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(None, "x " + passage), (1, "y y " + passage), (2, passage), (2, passage), (3, "z"), (3, passage + " q")]
    df = spark.createDataFrame([(*r, "row", 0) for r in rows], "doc_id long, text string, prefix string, place int")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, [tuple(s) for s in r.spans or []]) for r in substrings.remove_repeats(df).collect())
    assert got == [(-1, 56, 0, []), (1, 57, 55, [(2, 57)]), (2, 55, 55, [(0, 55)]), (2, 55, 55, [(0, 55)]), (3, 1, 0, []), (3, 56, 55, [(0, 55)])]
    assert substrings.remove_repeats(df.limit(0)).count() == 0
