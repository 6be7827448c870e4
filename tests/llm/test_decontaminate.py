"""Wu-Manber decontamination against a window-by-window search."""

import random

import brute

from panelcast.llm import decontaminate

DOCS = "doc_id long, text string"


def compare(spark, docs, items):
    d = spark.createDataFrame(list(docs.items()), DOCS)
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(d, b).collect()}
    assert got == brute.contaminated(docs, items)
    return got


def test_random_words(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "ça", "d-e", "1", "f"]) for _ in range(n))
    items = {i: text(rng.choice([0, 1, 2, 3, 9, 10, 11, 30])) for i in range(30)}
    docs = {i: text(rng.randint(0, 80)) for i in range(40)}
    for i in range(40, 80):
        docs[i] = text(20) + " X " + (items[rng.randrange(30)]).upper() + "; " + text(20)
    compare(spark, docs, items | {77: None, 78: "...", 10: "zz " * 40, 9: "q r s t u v w x y z a1"})


def test_edges(spark):
    item = "one two three four five six seven eight nine ten"
    docs = {1: None, 2: "", 3: "!!", 4: item, 5: (item + " ") * 3000, 6: item[:-4], 7: "x " + item.replace(" ", "\n--"), 8: "ONE" + item[3:]}
    got = compare(spark, docs, {1: item, 2: item, 30: "Été à"})
    assert got[5][1] == 30000 and got[4][2] == 2 and not got[6][4]
    compare(spark, {}, {1: item})
    compare(spark, docs, {})


def test_blocks_add_up_and_columns_stay(spark):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(i, item + f" {i}") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item + " 7", "h", 2.0), (2, "clean", None, None), (1, item + " 7", "h", 2.0), (None, item, "h", 1.0)], "doc_id long, text string, hits string, n_words double")
    one = decontaminate.scan(docs.drop("hits"), items).select("doc_id", "hits").collect()
    many = decontaminate.scan(docs.drop("hits"), items, block_bytes=500).select("doc_id", "hits").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    blocks = decontaminate.scan(docs, items, block_bytes=500)  # one worker a task, however many blocks there are
    assert blocks._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and blocks.columns == docs.columns
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", None, None)]
