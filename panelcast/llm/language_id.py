"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a text are added as log-probabilities: its letter trigrams (naive Bayes), the language that
its markup or metadata declares, the suffix of its address, and what its host is known for. How far declarations and
suffixes can be trusted, and the host priors, are grouped counts over all rows; a host's prior is smoothed towards its
site's, which is smoothed towards the corpus's, and never counts the row itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.sources.staging import stage

#: Buckets that letter trigrams are hashed into.
BUCKETS = 1 << 15
#: Distinct labelled texts of each language that the trigram model is fitted on, about; all other counts cover every row.
LABEL_ROWS = 5_000
#: Parts of the range of hashes by which texts are drawn.
PARTS = 1 << 40
#: Trigrams beyond which more text adds little: neighbouring trigrams are not independent.
ENOUGH = 300
#: Strength of smoothing: pseudo-counts a level inherits from the level above, and of a declaration's confusion counts.
HOST_PSEUDO, SITE_PSEUDO, EVIDENCE_PSEUDO = 20.0, 50.0, 5.0
#: Declarations, suffixes, sites and hosts with more than one in so many rows are joined by broadcast.
HOT_KEYS = 200
#: Below this posterior a text is rejected.
MIN_CONFIDENCE = 0.5
UNKNOWN = "und"
_LETTERS = bytes(b | 0x20 if chr(b).isalpha() and b < 0x80 else b if b >= 0x80 else 0x20 for b in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of lower-cased letters; everything else is one blank, and blanks alone do not count."""
    raw = np.frombuffer(b" " + b" ".join(text.decode().lower().encode().translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    code = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def fit(labelled: DataFrame, label_rows: int = LABEL_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities per language and bucket) from (text, label) rows.

    Of each label's distinct texts about ``label_rows`` are drawn by a hash of the text, all of them where there are
    fewer, so a label is known however rare it is and a copied text counts once. Whole texts are counted. The result's
    size follows from the number of labels, not of rows. Without labelled rows there is no language.
    """
    rows = labelled.filter("label is not null and text is not null").select("label", "text", F.xxhash64("text").alias("hash"))
    sizes = rows.select("label", "hash").distinct().groupBy("label").agg(F.count("*").alias("size"))
    # labels with no more texts than are drawn keep all of them, so only the others need a share
    frequent = sizes.filter(F.col("size") > label_rows).select("label", (label_rows / F.col("size")).alias("share"))
    drawn = rows.join(stage(frequent, "label-shares"), "label", "left").filter(F.pmod("hash", F.lit(PARTS)) < F.coalesce("share", F.lit(1.0)) * PARTS).groupBy("label", "hash").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), common.raw_texts(batch["text"]), strict=True):
                sums.setdefault(label, np.zeros(BUCKETS, np.int64))
                sums[label] += np.bincount(trigrams(text), minlength=BUCKETS)
        for label, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at), pa.array(counts[at])], ["label", "bucket", "n"])

    sums = drawn.select("label", "text").mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # at most languages x buckets rows
    at, languages = pd.factorize(found["label"], sort=True)
    languages = list(languages)
    table = np.full((len(languages), BUCKETS), 0.5)
    np.add.at(table, (at, found["bucket"].to_numpy()), found["n"].to_numpy())
    return languages, np.log(table / table.sum(1, keepdims=True)) if len(languages) else table


def text_evidence(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """Adds ``evidence`` (log-likelihood per language, the last one of no language), ``letters`` and ``by_text``."""
    known = rows.sparkSession.sparkContext.broadcast(np.concatenate([table, np.full((1, BUCKETS), -np.log(BUCKETS))]).T.astype(np.float32).copy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                evidence, letters = np.zeros((batch.num_rows, weights.shape[1])), []
                for i, text in enumerate(common.raw_texts(batch["text"])):
                    grams = trigrams(text)
                    letters.append(len(grams))
                    if len(grams):
                        for piece in range(0, len(grams), 1 << 16):
                            evidence[i] += weights[grams[piece : piece + (1 << 16)]].sum(0, dtype=np.float64)
                        evidence[i] *= ENOUGH / (ENOUGH + len(grams))
                kept = [c for c in batch.schema.names if c != "text"]
                flat = pa.array(evidence.ravel())
                ends = pa.array(np.arange(0, flat.__len__() + 1, weights.shape[1], dtype=np.int32))
                best = pa.array(np.where(np.array(letters) > 0, evidence.argmax(1), -1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.ListArray.from_arrays(ends, flat), pa.array(letters, pa.int64()), best], [*kept, "evidence", "letters", "by_text"])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.drop("text").dtypes)
    return rows.mapInArrow(score, f"{kinds}, evidence array<double>, letters long, by_text int")


def site_of(host):
    """The last two labels of a host name."""
    return F.regexp_extract(host, r"([^.]+\.)?[^.]+$", 0)


def counts_by(rows: DataFrame, key: str, classes: int) -> DataFrame:
    """(key, counts array, n): how often the text of a row with this key points to each class, and the key's rows.

    Rows are combined by key and class before they meet by key, so a key gathers at most one row a class.
    """
    votes = rows.filter(F.col(key).isNotNull()).groupBy(key, "by_text").agg(F.count("*").cast("double").alias("votes"))
    voted = F.map_from_entries(F.collect_list(F.struct("by_text", "votes")))
    by_key = votes.groupBy(key).agg(voted.alias("voted"), F.sum("votes").alias("n"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce(F.try_element_at("voted", i), F.lit(0.0)))
    return by_key.select(key, counts.alias("counts"), "n")


def with_counts(out: DataFrame, held: DataFrame, key: str, rows: int) -> DataFrame:
    """``out`` with the counts of its key. Keys with more than a ``HOT_KEYS``-th of all rows, of which there are fewer than
    ``HOT_KEYS``, are broadcast; rows with these keys or none are dealt over all tasks in the join of the others."""
    hot = held.filter(F.col("n") * HOT_KEYS > rows).select(key, F.col("counts").alias("hot_counts"))
    rest = held.filter(F.col("n") * HOT_KEYS <= rows).select(F.col(key).alias("rest_key"), F.lit(0).alias("rest_salt"), F.col("counts").alias("rest_counts"))
    out = out.join(F.broadcast(hot), key, "left")
    done = F.col(key).isNull() | F.col("hot_counts").isNotNull()
    out = out.withColumns({"own_key": F.when(~done, F.col(key)), "own_salt": F.when(done, F.pmod(F.xxhash64("id", "letters"), F.lit(4096)).cast("int")).otherwise(0)})
    out = out.join(rest, (F.col("own_key") == F.col("rest_key")) & (F.col("own_salt") == F.col("rest_salt")), "left")
    counts = F.coalesce("hot_counts", "rest_counts").alias(f"{key}_counts")
    return out.select(*(c for c in out.columns if not c.startswith(("own_", "rest_", "hot_"))), counts)


def identify(rows: DataFrame, languages: list[str], table: np.ndarray, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(id, lang, confidence, accepted, by_text) from rows (id, text, declared, suffix, host), one row out for each row in.

    ``declared``, ``suffix`` and ``host`` may be null and then say nothing. A text without letters, or one that no
    language explains, is ``und`` and rejected; so is a posterior below ``min_confidence``.
    """
    classes = len(languages) + 1
    base = rows.select("id", "text", *(F.nullif(F.lower(F.trim(c)), F.lit("")).alias(c) for c in ("declared", "suffix", "host")))
    scored = stage(text_evidence(base, languages, table).withColumn("site", site_of(F.col("host"))), "evidence")
    names = [*languages, UNKNOWN]

    votes = dict(map(tuple, scored.groupBy("by_text").agg(F.count("*")).collect()))  # a row a class
    size = np.array([votes.get(i, 0) for i in range(classes)]) + 1.0
    prior = size / size.sum()

    out = scored
    for key in ("declared", "suffix", "site", "host"):
        held = stage(counts_by(scored, key, classes), "key-counts")
        out = with_counts(out, held, key, sum(votes.values()))
        # without the row's own vote, which must not confirm itself
        other = F.transform(f"{key}_counts", lambda n, i: F.greatest(n - F.when(F.col("by_text") == i, 1.0).otherwise(0.0), F.lit(0.0)))
        out = out.withColumn(f"{key}_counts", F.coalesce(other, F.array_repeat(F.lit(0.0), classes)))
        out = out.withColumn(f"{key}_total", F.aggregate(f"{key}_counts", F.lit(0.0), lambda a, x: a + x))

    def of_class(values, i):
        return F.get(F.lit([float(x) for x in values]), i)

    def host_prior(i):
        site = (F.get("site_counts", i) + SITE_PSEUDO * of_class(prior, i)) / (F.col("site_total") + SITE_PSEUDO)
        return (F.get("host_counts", i) + HOST_PSEUDO * site) / (F.col("host_total") + HOST_PSEUDO)

    def says(key, i):  # log P(key's value | class i), up to what is the same for all classes
        return F.when(F.col(key).isNotNull(), F.log((F.get(f"{key}_counts", i) + EVIDENCE_PSEUDO * of_class(prior, i)) / of_class(size + EVIDENCE_PSEUDO, i))).otherwise(0.0)

    out = out.withColumn("scores", F.transform("evidence", lambda e, i: e + says("declared", i) + says("suffix", i) + F.log(host_prior(i))))
    out = out.withColumn("top", F.array_max("scores"))
    out = out.withColumn("share", F.lit(1.0) / F.aggregate(F.transform("scores", lambda s: F.exp(s - F.col("top"))), F.lit(0.0), lambda a, x: a + x))
    picked = F.element_at(F.array(*map(F.lit, names)), F.array_position("scores", F.col("top")).cast("int"))
    sure = (F.col("letters") > 0) & (picked != UNKNOWN) & (F.col("share") >= min_confidence)
    text_says = F.when(F.col("by_text") >= 0, F.element_at(F.array(*map(F.lit, names)), F.col("by_text") + 1)).otherwise(UNKNOWN)
    return out.select("id", F.when(F.col("letters") > 0, picked).otherwise(UNKNOWN).alias("lang"), F.round("share", 6).alias("confidence"), sure.alias("accepted"), text_says.alias("by_text"))


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, declared, suffix, host) of web pages: the text without tags, scripts and styles, the language of the html tag."""
    html, url = pages[html_col], pages[url_col]
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&#?\w+;", " ")
    host = F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    declared = F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    return pages.select(pages[id_col].cast("long").alias("id"), text.alias("text"), declared.alias("declared"), F.regexp_extract(host, r"[^.]+$", 0).alias("suffix"), host.alias("host"))


def document_evidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The same of documents: their language column is a declaration, their source stands for a host."""
    return docs.select(common.id_key(docs[id_col]).alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("declared"), F.lit(None).cast("string").alias("suffix"), docs[host_col].alias("host"))


def identify_documents(docs: DataFrame, label_rows: int = LABEL_ROWS) -> DataFrame:
    """(doc_id, lang, confidence, accepted, by_text) of documents, the model fitted on a sample of their declarations."""
    languages, table = fit(docs.select(docs["text"], F.lower(F.trim(docs["lang"])).alias("label")), label_rows)
    found = identify(document_evidence(docs), languages, table)
    return found.select(common.public_id(F.col("id")).alias("doc_id"), "lang", "confidence", "accepted", "by_text")


def accepted_documents(docs: DataFrame, label_rows: int = LABEL_ROWS) -> DataFrame:
    """Documents whose language is known, columns as they were. Rows that repeat an id stay if one of them is accepted."""
    good = identify_documents(docs, label_rows).filter("accepted").select(common.id_key(F.col("doc_id")).alias("k")).distinct()
    mark = common.fresh(docs, "accepted_doc")
    return docs.withColumn(mark, common.id_key(docs["doc_id"])).join(good.withColumnRenamed("k", mark), mark, "left_semi").drop(mark)
