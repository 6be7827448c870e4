"""The pipeline stage by stage against plain versions of its decisions."""

import brute
import public_tokenizers as P

import corpus_pipeline
from panelcast.llm.queries import table
from panelcast.sources.staging import stage


def test_stages_decide_as_the_plain_versions(spark, sf_dir):
    docs = stage(table(spark, sf_dir, "documents"), "documents")
    columns, schema = docs.columns, docs.schema
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "step")
        assert docs.columns == columns and docs.schema.simpleString() == schema.simpleString()
        got = {r.doc_id: r.text for r in docs.collect()}
        assert len(got) == docs.count()
        if name == "language ID":
            assert {d for d in texts if d not in got} <= {d for d, t in texts.items() if not any(c.isalpha() for c in t or "")}
            want = {d: texts[d] for d in got}
        elif name == "line dedup":
            shas = {d: x[2] for d, x in brute.deduplicated_lines(texts).items()}
            assert shas == {d: brute.sha(t or "") for d, t in got.items()}
            want = got
        elif name == "near-dedup":
            want = {d: texts[d] for d, x in brute.near_duplicates(texts, 5).items() if x[2]}
        else:
            items = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
            want = {d: texts[d] for d, x in brute.contaminated(texts, items).items() if not x[4]}
        assert got == want, name
        texts = got
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    order = list(texts)
    assert lengths == {d: len(x) for d, x in zip(order, brute.token_ids([texts[d] for d in order], P.path("byte_bpe_50k.json")), strict=True)}
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)
