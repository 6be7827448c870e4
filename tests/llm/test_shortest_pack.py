"""Shortest-pack-first packing: gapless, without padding, and equal to whole-text encoding."""

import random
import zlib

import brute
import numpy as np
import public_tokenizers as P
import pytest

from panelcast.llm import shortest_pack
from panelcast.llm.queries import QUERIES, table

PATH = P.path("byte_bpe_50k.json")


def check(rows, capacity):
    """Sequences are gapless from 0; returns the padding."""
    by, padding = {}, 0
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("seed", range(12))
def test_plan_fills_every_pack(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 1024])
    lengths = [rng.choice([rng.randint(1, capacity), min(capacity, rng.randint(1, 40)), (capacity + 2) // 3]) for _ in range(rng.choice([1, 50, 4000]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, packs = shortest_pack.plan(counts, capacity)
    held, rows = {}, []
    for _, block, first_rank, ranks, start, size, first, k, offset in runs:
        for r in range(ranks):
            held.setdefault((block, first_rank + r), []).append((start, size))
            rows.append({"sequence_id": first + r // k, "offset": offset + r % k * size, "length": size})
    assert sorted(held) == sorted((n, r) for n, c in counts.items() for r in range(c))
    for (block, _), parts in held.items():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == block
    assert check(rows, capacity) == 0 and {r["sequence_id"] for r in rows} == set(range(packs))
    assert len(rows) - len(lengths) <= packs


def test_plan_places_the_longest_into_the_shortest_pack():
    runs, packs = shortest_pack.plan({6: 2, 3: 1, 2: 1, 1: 3}, 10)  # 20 ids: two packs
    assert packs == 2
    # the sixes go into both packs, 3 into one of them, 2 into the other, which is shorter; the ones into whichever is shortest
    assert [r[1] for r in runs] == [6, 3, 2, 1, 1]
    first = {r[1]: r[6] for r in runs[:3]}
    assert runs[0][3] == 2 and first[3] != first[2] and runs[3][6] == first[2]
    assert all(r[0] == 0 for r in runs)


def plain(docs):
    return dict(zip(docs, brute.token_ids(docs.values(), PATH, 0), strict=True))


def assert_holds(rows, docs, capacity):
    assert check(rows, capacity) == 0
    for doc, ids in plain(docs).items():
        own, at = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]), 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_pieces_and_sequences_hold_the_documents(spark):
    docs = dict(enumerate([None, "", "a", "two words", "long text here " * 900, "word " * 61, "x " * 63, "é ñ 日本語"]))
    df = spark.createDataFrame([(k, t, 5, "c") for k, t in docs.items()], "doc_id long, text string, length int, chunk string")
    packed = shortest_pack.pack_documents(df, PATH, 0, 64, with_ids=True)
    rows = [r.asDict() for r in packed.collect()]
    assert_holds(rows, docs, 64)
    whole = plain(docs)
    assert all(r["ids"] == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]].tolist() for r in rows)
    filled = shortest_pack.sequences(packed, 64).collect()
    assert sum(len(r.ids) for r in filled) == sum(map(len, whole.values())) == sum(r.n_ids for r in filled)


def test_empty_repeated_and_null_rows(spark):
    assert shortest_pack.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)] * 30, "doc_id long, text string")
    rows = [r.asDict() for r in shortest_pack.pack_documents(df, PATH).collect()]
    assert check(rows, 1024) == 0 and {r["doc_id"] for r in rows} == {1, None}
    assert sum(r["length"] for r in rows) == 60 * 3 + 30


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = [r.asDict() for r in QUERIES["op11_shortest_pack_first"](spark, sf_dir).collect()]
    assert_holds(rows, docs, 1024)
    assert np.sum([r["length"] for r in rows]) == sum(map(len, plain(docs).values()))
