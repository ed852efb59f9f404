"""Corpus pipeline: language ID, SimHash near-dedup, secret scans, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``docs``, whatever they are.  ``run`` writes every stage's rows as Parquet in
the shared folder and reads them again.  Texts, ids and sources may be null and rows may repeat;
an empty table passes through every stage; extra columns are carried along, and working columns
have names of their own, so none can clash.

* language: a text without letters, or whose best language has a calibrated probability under
  ``MIN_LANGUAGE_SCORE``, is rejected; a null text has no letters.
* near_dedup: of each component of linked fingerprints the row with the smallest id stays (ids
  before nulls, then by a hash of the row); identical rows are one.
* secrets: every found span is replaced by ``MASK``; the document stays.
* mixing: a document appears once per whole repetition, and the one at a source's edge with the
  words that are left; ``n_chars`` follows the text.
* packing: the pieces of every document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from catalytics.llm import frames, langid, mixing, packing, secrets, simhash
from catalytics.llm.text import WORD

MIN_LANGUAGE_SCORE = 0.5
MASK = "[SECRET]"


def _hidden(docs: DataFrame) -> DataFrame:
    """The same rows under numbered names, so that working columns cannot clash."""
    return docs.toDF(*(f"__c{i}" for i in range(len(docs.columns))))


def _name(docs: DataFrame, column: str) -> str:
    return f"__c{docs.columns.index(column)}"


def _shown(hidden: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    return hidden.select(*(changed.get(c, F.col(f"__c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    if not model.languages:                               # nothing to learn from: only texts without letters go
        return docs.where(docs["text"].cast("string").rlike(r"\p{L}"))
    rows, body = _hidden(docs), _name(docs, "text")
    judged = langid.predict(rows, model, {c: rows[c] for c in rows.columns}, body)
    return _shown(judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    k1, k2 = frames.row_key(docs, "doc_id", "text")
    prints = frames.cut(simhash.fingerprints(docs, docs["text"], {"__k1": k1, "__k2": k2, "__id": docs["doc_id"]}), "fingerprints")
    labels = frames.cut(simhash.classes(prints.select("fp").distinct()), "labels")
    first = F.min(F.struct(F.col("__id").isNull(), "__id", "__k2", "__k1"))
    stay = prints.join(labels, "fp").groupBy("label").agg(first.alias("first")).select(
        F.col("first.__k1").alias("s1"), F.col("first.__k2").alias("s2"))
    rows = _hidden(docs)
    k1, k2 = frames.row_key(rows, _name(docs, "doc_id"), _name(docs, "text"))
    rows = rows.withColumns({"__k1": k1, "__k2": k2})
    kept = rows.join(stay, (F.col("__k1") == F.col("s1")) & (F.col("__k2") == F.col("s2")), "left_semi")
    return _shown(kept.dropDuplicates(["__k1", "__k2"]), docs)


@F.pandas_udf(StringType())          # a type, not its name: parsing a name needs a session
def _masked(bodies: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    """Texts with one mask for each run of overlapping spans, cut once; a text without spans stays."""
    def mask(body, start, stop):
        if body is None or start is None or not len(start):
            return body
        out, at = [], 0
        for s, e in sorted(zip(start, stop)):
            if s >= at:
                out += [body[at:s], MASK]
            at = max(at, e)
        return "".join([*out, body[at:]])
    return pd.Series([mask(*x) for x in zip(bodies, starts, stops)], dtype=object)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs, secrets.new_ledger(spark)).where(F.size("spans") > 0)
    rows = _hidden(docs)
    body = F.col(_name(docs, "text"))
    rows = rows.withColumn("__blob", secrets.blob_id(body)).join(found.select(F.col("blob").alias("__blob"), "spans"), "__blob", "left")
    rows = rows.withColumn("__text", F.when(F.col("spans").isNull(), body).otherwise(_masked(body, F.col("spans.start"), F.col("spans.stop"))))
    changed = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        n = F.col(_name(docs, "n_chars"))
        changed["n_chars"] = F.when(F.col("spans").isNull(), n).otherwise(F.length("__text").cast(docs.schema["n_chars"].dataType))
    return _shown(rows, docs, **changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mix = mixing.Mix()
    size, h = mixing.words(docs["text"]), mixing.order_hash(docs["doc_id"], mix.seed)
    plan = mixing.plan(frames.cut(docs.select(docs["source"], size.alias("size"), h.alias("h")), "sizes"), mix)
    rows = _hidden(docs)
    body = F.col(_name(docs, "text"))
    rows = rows.withColumn("__size", mixing.words(body)).withColumn("__h", mixing.order_hash(F.col(_name(docs, "doc_id")), mix.seed))
    rows = rows.join(plan, F.col(_name(docs, "source")).eqNullSafe(F.col("p_source")))
    rows = rows.withColumn("__part", mixing.partial_words(F.col("__h"), F.col("__size")))
    rows = rows.withColumn("__whole", F.col("whole") + ((F.col("__part") == F.col("__size")) & (F.col("__size") > 0)).cast("long"))
    rows = rows.withColumn("__n", F.col("__whole") + ((F.col("__part") > 0) & (F.col("__part") < F.col("__size"))).cast("long")).where("__n > 0")
    rows = rows.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    cut = F.col("__i") > F.col("__whole")
    short = F.concat_ws(" ", F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), F.lit(1), F.col("__part").cast("int")))
    rows = rows.withColumn("__text", F.when(cut, short).otherwise(body))
    changed = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(_name(docs, "n_chars")))
    return _shown(rows, docs, **changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mixing", mix_sources), ("packing", pack)]

#: Trained models, bit operations over shingles and tokenization are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = frames.cut(stage(spark, docs, sf_dir), name)
    return docs
