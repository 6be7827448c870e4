"""Evidence fusion: held-out accuracy, what declarations and hosts can and cannot do, rejections."""

import random

import pytest
from pyspark.sql import functions as F

from panelcast.llm import language_id

WORDS = {
    "en": "the of and to in that it is was for with this are from have not they which there their would about".split(),
    "de": "der die und das nicht ist ein mit auch sich werden einer für über wurde durch können große straße".split(),
    "fr": "le la les des une est que pour dans avec être où été très aussi leur même nous vous cette après".split(),
}
ROWS = "id long, text string, declared string, suffix string, host string"


def text(rng, lang, n=25):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    return language_id.fit(spark.createDataFrame([(text(rng, x), x) for x in WORDS for _ in range(40)], "text string, label string"))


def test_held_out_accuracy(spark, model):
    rng = random.Random(2)
    truth = {i: rng.choice(list(WORDS)) for i in range(200)}
    rows = spark.createDataFrame([(i, text(rng, x, 12), None, None, None) for i, x in truth.items()], ROWS)
    got = {r.id: r for r in language_id.identify(rows, *model).collect()}
    assert sum(got[i].lang == x for i, x in truth.items()) >= 198 and all(r.accepted for r in got.values())


def test_declarations_and_hosts_decide_only_unclear_texts(spark, model):
    rng = random.Random(3)
    rows = [(i, text(rng, "de"), "de", "de", "a.site.de") for i in range(60)] + [(100 + i, text(rng, "fr"), "fr", "fr", "b.site.fr") for i in range(60)]
    rows += [(500, "on", "de", "de", "a.site.de"), (501, "on", "fr", "fr", "b.site.fr"), (502, text(rng, "fr"), "de", "de", "a.site.de"), (503, "on", " DE ", None, "new.site.de")]
    got = {r.id: r.lang for r in language_id.identify(spark.createDataFrame(rows, ROWS), *model).collect()}
    assert [got[i] for i in (500, 501, 502, 503)] == ["de", "fr", "fr", "de"]


def test_rejections_nulls_and_empty_tables(spark, model):
    junk = bytes(range(1, 32)).decode() + "12 345 !?"
    rows = [(1, None, "en", "com", "h"), (2, "", None, None, None), (3, junk, "en", None, None), (None, "the of and to in", None, "", ""), (4, "the of and " * 30000, "en", "com", "h")]
    got = {r.id: (r.lang, r.accepted) for r in language_id.identify(spark.createDataFrame(rows, ROWS), *model).collect()}
    assert got == {1: ("und", False), 2: ("und", False), 3: ("und", False), None: ("en", True), 4: ("en", True)}
    assert language_id.identify(spark.createDataFrame([], ROWS), *model).count() == 0
    languages, table = language_id.fit(spark.createDataFrame([], "text string, label string"))
    assert languages == []
    none = language_id.identify(spark.createDataFrame(rows, ROWS), languages, table).collect()
    assert len(none) == 5 and not any(r.accepted for r in none)


def test_documents_keep_columns_and_pages_are_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("host", F.lit(1)).withColumn("evidence", F.lit("x"))
    kept = language_id.accepted_documents(docs)
    assert kept.columns == docs.columns
    dropped = docs.join(kept, "doc_id", "left_anti").select("text").collect()
    assert all(not any(c.isalpha() for c in r.text or "") for r in dropped)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    languages, table = language_id.fit(docs.select("text", F.col("lang").alias("label")))
    got = language_id.identify(language_id.page_evidence(pages), languages, table)
    truth = pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", '<html lang="(\\w+)"', 1).alias("truth"))
    assert got.join(truth, "id").filter("lang <> truth").count() <= 0.02 * pages.count()


def test_a_thousand_labels(spark):
    """Junk in the declared column makes many labels; each stays one, and a hot host is joined like any other key."""
    rng = random.Random(5)
    labels = [f"l{i}" for i in range(1000)]
    labelled = [(text(rng, "de"), "de")] * 3 + [(text(rng, "fr", 60), "fr") for _ in range(200)] + [(f"junk{x} of {x}" * 3, x) for x in labels]
    languages, table = language_id.fit(spark.createDataFrame(labelled, "text string, label string"))
    assert len(languages) == 1002
    rows = [(i, text(rng, "fr", 60), "fr" if i % 2 else labels[i], "fr", "hot.site.fr") for i in range(300)] + [(1000, None, "l1", None, None)]
    got = language_id.identify(spark.createDataFrame(rows, ROWS), languages, table).collect()
    assert len(got) == 301 and sum(r.lang == "fr" for r in got) >= 298
