"""Packing and token files against whole-text encoding."""

import random
import zlib

import brute
import numpy as np
import public_tokenizers as P
import pytest

from panelcast.llm import packing, token_files, tokens
from panelcast.llm.tokens import Encoder

ODD = [
    None, "", " ", "\n", "a", "  two  blanks ", "tab\tand\r\nline\n\n\nfeeds ", "nbsp x   y z　q", "\x00\x01 zero \x01 one \x1c\x1d x",
    "don't we'll 'tis x'S", "É é ñ ́x İstanbul ΣΑΣ", "<|endoftext|> <|startoftext|>x", "﻿BOM", "日本語 テキスト 12 345", "a" * 5000, "x. , | .,|a b|c",
    " o p q r s\x85t", "👍🏽 emoji‍👩", "word " * 3000,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_matches_whole_texts(name):
    tool = Encoder(P.path(name))
    rng = random.Random(3)
    texts = [t or "" for t in ODD]
    texts += ["".join(rng.choice([*"abé .,\n\t' \x01\x00S1<|", "  ", "the"]) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    for got, want in zip(tool.encode([t.encode() for t in texts]), brute.token_ids(texts, P.path(name)), strict=True):
        assert got == want[:-1].tobytes()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_known_pieces_are_bounded_and_common_ones_stay(name, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 60)
    monkeypatch.setattr(tokens, "LOOKUP_PIECES", 90)
    tool, rng, learnt = Encoder(P.path(name)), random.Random(5), []
    learn = tool._learn
    monkeypatch.setattr(tool, "_learn", lambda pieces: learnt.extend(pieces) or learn(pieces))
    for _ in range(30):
        rare = ["".join(rng.choice("abcdé") for _ in range(12)) for _ in range(40)]
        texts = [f"every batch has the same {r} words, 12 x's" for r in rare]
        got = tool.encode([t.encode() for t in texts])
        assert got == [w[:-1].tobytes() for w in brute.token_ids(texts, P.path(name))]
        assert len(tool.memo.pieces) <= 60 + 90
    assert learnt.count(b" batch" if name.startswith("byte") else b"batch") == 1


def test_token_files_round_trip(spark, tmp_path):
    docs = dict(enumerate(ODD))
    path = P.path("word_bpe_49k.json")
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs.items()], "doc_id long, text string, part string, ids int")
    token_files.write_token_files(df, f"{tmp_path}/t", path, 2)
    rows = token_files.stream_positions(token_files.read_token_files(spark, f"{tmp_path}/t"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.checksums(rows).collect()}
    assert got == brute.token_rows(docs, path)
    assert token_files.read_documents(spark, f"{tmp_path}/t", [3, 7]).count() == 2
    held = token_files.read_range(spark, f"{tmp_path}/t", 3, 5).collect()
    assert all(r.start < 5 and r.start + r.n_tokens > 3 for r in held) and held


def test_ids_are_not_shuffled_when_read_back(spark, tmp_path):
    df = spark.createDataFrame([(k, "some words " * k) for k in range(50)], "doc_id long, text string")
    token_files.write_token_files(df, f"{tmp_path}/s", P.path("word_bpe_49k.json"), 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = token_files.checksums(token_files.stream_positions(token_files.read_token_files(spark, f"{tmp_path}/s")))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert [(r.start, r.n_tokens) for r in rows.orderBy("doc_id").limit(3).collect()] == [(0, 1), (1, 3), (4, 5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_token_files_empty_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(df, f"{tmp_path}/e", P.path("word_bpe_49k.json"), 2)
    assert token_files.stream_positions(token_files.read_token_files(spark, f"{tmp_path}/e")).count() == 0
    df = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c"), (1, None)], "doc_id long, text string")
    token_files.write_token_files(df, f"{tmp_path}/n", P.path("word_bpe_49k.json"), 2)
    rows = token_files.checksums(token_files.stream_positions(token_files.read_token_files(spark, f"{tmp_path}/n"))).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 3), (1, 3, 1), (1, 4, 2), (1, 6, 2)]


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_gapless_and_close_to_the_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 1024])
    lengths = [rng.choice([rng.randint(1, capacity), min(capacity, rng.randint(1, 40)), (capacity + 2) // 3]) for _ in range(rng.choice([1, 50, 4000]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    seen, rows = dict.fromkeys(counts, 0), []
    for n, first, ranks, sequence, k, offset in sorted(packing.plan(counts, capacity)):
        assert first == seen[n]
        seen[n] += ranks
        rows += [{"sequence_id": sequence + r // k, "offset": offset + r % k * n, "length": n} for r in range(ranks)]
    assert seen == counts
    used = check_packing(rows, capacity)
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    assert used <= max(-(-sum(lengths) // capacity), large) * 11 / 9 + 1


def test_packed_pieces_hold_the_documents(spark):
    docs = dict(enumerate([*ODD, "long text here " * 900]))
    path = P.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(k, t, 5) for k, t in docs.items()], "doc_id long, text string, piece int")
    packed = packing.pack_documents(df, path, 2, 64, with_ids=True)
    rows = [r.asDict() for r in packed.collect()]
    check_packing(rows, 64)
    whole = dict(zip(docs, brute.token_ids(docs.values(), path), strict=True))
    for doc, ids in whole.items():
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert len(own) == -(-len(ids) // 64) and all(r["length"] == 64 for r in own[1:])
        assert np.concatenate([r["ids"] for r in own]).tolist() == ids.tolist()
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    filled = packing.fill_sequences(packed).collect()
    assert sum(len(r.ids) for r in filled) == sum(map(len, whole.values()))
    assert all(len(r.ids) == sum(r.lengths) <= 64 for r in filled)


def test_packing_empty_repeated_and_null_rows(spark):
    path = P.path("byte_bpe_50k.json")
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)] * 30, "doc_id long, text string")
    rows = [r.asDict() for r in packing.pack_documents(df, path).collect()]
    assert len(rows) == 90 and check_packing(rows, 1024) == 1 and {r["doc_id"] for r in rows} == {1, None}
