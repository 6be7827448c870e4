"""The rows that the trigram model is fitted on: rare labels, copied texts, growing tables."""

import random

import numpy as np

from panelcast.llm import language_id
from test_language_id import text


def labelled(n_en):
    rng = random.Random(5)
    rare = [(text(rng, "de"), f"de{i}") for i in range(6) for _ in range(2)]
    return rare + [(text(rng, "en"), "en") for _ in range(n_en)]


def fitted(spark, rows, quota=20):
    return language_id.fit(spark.createDataFrame(rows, "text string, label string"), quota)


def test_rare_labels_are_known_whatever_the_table(spark):
    small, large = fitted(spark, labelled(100)), fitted(spark, labelled(4000))
    assert small[0] == large[0] == [*(f"de{i}" for i in range(6)), "en"]
    assert np.array_equal(small[1][:6], large[1][:6])


def test_copies_count_once_and_draws_stay_near_the_quota(spark):
    rows = labelled(400)
    once, copied = fitted(spark, rows), fitted(spark, rows + [rows[0]] * 2000 + [rows[20]] * 2000)
    assert once[0] == copied[0] and np.array_equal(once[1], copied[1])
    total = sum(len(language_id.trigrams(t.encode())) for t, x in rows if x == "en") / 400  # trigrams a text
    drawn = (np.exp(once[1][-1] - once[1][-1].min()) * 0.5 - 0.5).sum() / total
    assert 5 < drawn < 50
