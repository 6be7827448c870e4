"""The registered queries on the smallest tables against brute force."""

import zlib

import brute
import public_tokenizers as P
import pytest

from panelcast.llm.queries import QUERIES, table


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def rows(spark, sf_dir, name, *columns):
    return {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, sf_dir).select(*columns).collect()}


def test_op2(spark, sf_dir, docs):
    assert rows(spark, sf_dir, "op2_line_dedup", "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute.deduplicated_lines(docs)


def test_op3(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    turns = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = rows(spark, sf_dir, "op3_chat_formatting", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == brute.chats(turns + [(-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_op4(spark, sf_dir, docs):
    assert rows(spark, sf_dir, "op4_minhash_forest", "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(docs)


def test_op5(spark, sf_dir, docs):
    items = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    got = rows(spark, sf_dir, "op5_benchmark_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.contaminated(docs, items) and any(x[4] for x in got.values())


def test_op8(spark, sf_dir, docs):
    assert rows(spark, sf_dir, "op8_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == brute.token_rows(docs, P.path("word_bpe_49k.json"))


def test_op10(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op10_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.repeats_removed(docs)


def test_op1(spark, sf_dir, docs):
    """Pieces hold the documents' ids, sequences are gapless, and only longer documents are cut."""
    from test_tokens import check_packing

    rows_ = [r.asDict() for r in QUERIES["op1_best_fit_packing"](spark, sf_dir).collect()]
    used = check_packing(rows_, 1024)
    whole = dict(zip(docs, brute.token_ids(docs.values(), P.path("byte_bpe_50k.json")), strict=True))
    for doc, ids in whole.items():
        own = sorted((r for r in rows_ if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 1024)
        assert all(r["length"] == 1024 for r in own[1:]) and [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    assert used <= 1.05 * -(-sum(map(len, whole.values())) // 1024) + 1


def test_op9(spark, sf_dir, docs):
    from test_bm25 import brute as scored

    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in QUERIES["op9_topk_search"](spark, sf_dir).collect()}
    want = scored(docs, {d: t for d, t in docs.items() if d % 20 == 0}, 10)
    assert set(got) == set(want)
    for key, (_, score) in want.items():
        assert got[key][1] == pytest.approx(score, abs=2e-6)
    by_query = {}
    for (q, _), (d, s) in want.items():
        by_query.setdefault(q, []).append((round(s, 6), d))
    assert all(got[key][0] == doc or sum(abs(got[key][1] - s) < 1e-5 for s, _ in by_query[key[0]]) > 1 for key, (doc, _) in want.items())
