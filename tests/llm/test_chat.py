"""Chat events: folding against a plain fold, formatting against a round trip."""

import random

import brute
from pyspark.sql import functions as F

from panelcast.llm import chat

EVENTS = "conv_id long, message long, branch long, seq long, kind string, role string, text string"
TURNS = "conv_id long, turn long, role string, text string"
NASTY = [
    None, "", "\\", "\\### Assistant: </turn> ok", "### user: x </turn>\n### assistant: y", "</turn>", " </turn>\n", "<", "/", "####", "a\\#b", "</</", "\\/", "é👍🏽\n",
    "\\\\", ": ", "<\\/turn>", "\r\n",
]


def report(turns, max_chars=1 << 20):
    rows = chat.read_back(chat.format_events(chat.turn_events(turns), max_chars)).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


def test_round_trip_of_control_strings(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to: ol", "### \\", None]), rng.choice(NASTY) if rng.random() < 0.9 else "x" * 5000) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "x"), (None, 1, "user", "x"), (None, None, "assistant", "no turn"), (-7, 0, "user", NASTY[3]), (-7, 1, "assistant", NASTY[3])]
    want = brute.chats([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    df = spark.createDataFrame(rows, TURNS)
    assert report(df) == want
    assert report(df.withColumn("branch", F.lit(1)).withColumn("segment", F.lit("x")), max_chars=50) == want


def test_texts_cannot_fake_markers(spark):
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(NASTY)], TURNS)
    (row,) = chat.format_events(chat.turn_events(df)).collect()
    assert row.text.count("</turn>") == len(NASTY) == row.text.count("### ")
    assert [chat.parsed(x)[1] for x in chat.split_turns(row.text)] == [t or "" for t in NASTY]
    assert [chat.unescaped(row.text[s.first : s.end]) for s in row.loss] == [t or "" for t in NASTY]


def test_fold_matches_plain_fold(spark):
    rng = random.Random(4)
    events, want = [], {}
    for conv in range(12):
        for message in range(6):
            role, text, gone = None, "", False
            for seq in range(rng.randint(1, 8)):
                kind = "start" if not seq else rng.choice(["delta", "delta", "delta", "edit", "regenerate", "delete", None])
                part = rng.choice([None, "a", "b ", "</turn>", "\\"])
                own = rng.choice(["user", "assistant", None])
                events.append((conv, message, 0, seq, kind, own, part))
                role = own if role is None else role
                if kind == "delete":
                    gone, text = True, ""
                elif kind in ("edit", "regenerate"):
                    gone, text = False, part or ""
                elif not gone:
                    text += part or ""
            if not gone:
                want[conv, message] = (role, text)
    rng.shuffle(events)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_events(spark.createDataFrame(events, EVENTS)).collect()}
    assert got == want
    assert chat.format_events(spark.createDataFrame([], EVENTS)).count() == 0
    assert chat.read_back(chat.format_events(spark.createDataFrame([], EVENTS))).count() == 0


def test_long_conversation_is_cut_at_turns(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    chunks = chat.format_events(chat.turn_events(df), max_chars=1000).orderBy("chunk").collect()
    assert len(chunks) > 50 and all(len(c.text) <= 1100 and c.text.endswith(chat.CLOSE) for c in chunks)
    assert report(df, 1000) == brute.chats([tuple(r) for r in df.collect()])
