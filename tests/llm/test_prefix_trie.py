"""The prefix trie against a plain dictionary of beginnings."""

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import pytest

from panelcast.llm import prefix_trie
from panelcast.llm.queries import QUERIES, table

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """conv -> list of (role, text)"""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        if c is None:
            out[c] = turns
            continue
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def trie(paths):
    order = lambda c: (c is not None, c or 0)
    members = defaultdict(list)
    for c in sorted(paths, key=order):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        own = (len(m) - 1) * len(brute.words(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += own
    out = set()
    for p, m in members.items():
        ends = ",".join("null" if c is None else str(c) for c in m if len(paths[c]) == len(p))
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children.get(p, 0), leaves[p], saved[p], brute.sha(ends)))
    return out


def found(df):
    rows = [tuple(r) for r in df.select(COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def plain_rows(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def test_query_against_brute_force(spark, sf_dir):
    assert found(QUERIES["op13_prefix_trie"](spark, sf_dir)) == trie(rebuilt(plain_rows(table(spark, sf_dir, "conversations"))))


SCHEMA = "conv_id long, turn long, role string, text string, pos string, depth int"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_many_partitions_and_rounds(spark, monkeypatch, seed):
    """Small bounds, so that forests, rounds, slices and tasks all break inside conversations and copies."""
    for name, value in {"FOREST_ROWS": 5, "FAN": 3, "SLICE": 4, "TURNS": 60, "CHUNK": 3}.items():
        monkeypatch.setattr(prefix_trie, name, value)
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(400), 90):
        n = rng.choice([1, 2, 3, 5, 9])
        words = ["a", "b c"] if c % 3 else ["a"]
        rows += [(c, t, "user", rng.choice(words)) for t in range(n)]
    for c in (500, 501, 502):  # long ones that part late, and copies
        rows += [(c, t, "user", f"t {t}" if t < 70 else f"t {t} {c // 502}") for t in range(75)]
    rng.shuffle(rows)
    df = make(spark, rows)
    assert found(prefix_trie.rebuilt_trie(df)) == trie(rebuilt(rows))
    assert found(prefix_trie.conversation_trie(df)) == trie(plain_paths(rows))


def plain_paths(rows):
    out = defaultdict(list)
    for c, _, r, t in sorted(rows):
        out[c].append((r, t))
    return out


def test_one_long_conversation_and_lone_depths(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURNS", 300)
    monkeypatch.setattr(prefix_trie, "SLICE", 100)
    rows = [(7, t, "user", f"w {t % 5}") for t in range(1500)] + [(8, t, "user", f"w {t % 5}") for t in range(40)] + [(9, 0, "user", "other")]
    df = make(spark, rows)
    assert found(prefix_trie.rebuilt_trie(df)) == trie(rebuilt(rows))
    turns = prefix_trie.numbered(prefix_trie.digests(df))
    assert {r.conv: r.depth for r in prefix_trie.lone_depths(turns).collect()} == {7: 64}


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [
        (None, 0, None, None), (None, None, "user", "first"), (1, 0, "user", "x y"), (1, 0, "user", "x y"), (1, 0, "a", "b"),
        (20, None, None, "null turn"), (20, 1, "user", ""), (21, 5, "user", "z"), (22, 0, "user", ""), (23, 0, "user", "q"),
        (39, 0, "user", "no base turns"), (45, 0, "user", "absent base"),
    ]
    assert found(prefix_trie.rebuilt_trie(make(spark, rows))) == trie(rebuilt(rows))
    assert any(not t for t in rebuilt(rows).values())  # one of them has no turns left
    assert found(prefix_trie.rebuilt_trie(make(spark, []))) == set()
    assert found(prefix_trie.rebuilt_trie(make(spark, [(5, 0, "user", "only")]))) == trie(rebuilt([(5, 0, "user", "only")]))


def test_very_long_text(spark):
    rows = [(c, 0, "user", "word " * 200_000) for c in (1, 2)]
    assert found(prefix_trie.conversation_trie(make(spark, rows))) == trie(plain_paths(rows))
