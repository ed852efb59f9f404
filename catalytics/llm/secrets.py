"""Secret scans over an incremental blob ledger.

Every version of a text is a blob named by its SHA-256.  The ledger is a Parquet table (blob,
rules scanned, spans found) to which each run appends; a run scans only blobs for which some rule
version is not on record, once per blob however many paths hold it, with just those rules.  The
findings are then joined back to all paths.  A ledger folder outlives the run: given the same
folder, a second run over unchanged rows scans nothing, and a new rule version rescans every blob
with that rule alone.

Texts are shuffled once, by blob, after each task has kept one row of every blob: copies, whatever
their ids, are one.  A pair of blob and rule that is on record twice (two runs at once, a repeated
append) counts once.  The join back to paths is an equi-join whose skewed partitions Spark splits.

Special cases: a null text is the empty blob; repeated rows and null ids are paths of their own;
an empty table gives an empty result and leaves an empty ledger; other columns are ignored.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalytics.llm import frames

Spans = list[tuple[int, int]]


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    find: Callable[[str], Spans]

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed values of the base kinds.
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")           # a maximal run, as [0-9a-f]+ of 24 or more
# Kinds beyond the base.
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PROVIDER = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})")


def _assign(body: str) -> Spans:
    low = body.lower()
    if not any(w in low for w in _ASSIGN_WORDS):
        return []
    return [m.span() for m in _ASSIGN.finditer(body) if m.end(2) - m.start(2) >= 6]


def _access(body: str) -> Spans:
    return [m.span() for m in _ACCESS.finditer(body) if m.end() - m.start() >= 20] if "AKIA" in body else []


def _hex(body: str) -> Spans:
    return [m.span() for m in _HEX.finditer(body)]


def _plain(pattern: re.Pattern, *needs: str) -> Callable[[str], Spans]:
    return lambda body: [m.span() for m in pattern.finditer(body)] if any(n in body for n in needs) else []


BASE = (Rule("assign", 1, _assign), Rule("access", 1, _access), Rule("hex", 1, _hex))
RULES = (*BASE, Rule("pem", 1, _plain(_PEM, "PRIVATE KEY-----")), Rule("jwt", 2, _plain(_JWT, "eyJ")),
         Rule("provider", 1, _plain(_PROVIDER, "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "AIza")))

_SPANS = "array<struct<kind:string,start:long,stop:long>>"
_LEDGER = f"blob string, rules array<string>, spans {_SPANS}"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def blob_id(body: Column) -> Column:
    return F.sha2(F.coalesce(body.cast("string"), F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_LEDGER).parquet(folder)
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        return spark.createDataFrame([], _LEDGER)


def _scan_batches(rules: tuple[Rule, ...]):
    by_name = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for body, todo in zip(batch.column("text"), batch.column("todo")):
                body = body.as_py() or ""
                found.append([{"kind": by_name[t].kind, "start": s, "stop": e} for t in todo.as_py() for s, e in by_name[t].find(body)])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("todo"), pa.array(found, _SPANS_ARROW)], ["blob", "rules", "spans"])
    return run


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """Bring the ledger up to date and return (blob, spans) of every blob in ``docs``, by the given rule versions."""
    spark, names = docs.sparkSession, [r.name for r in rules]
    blob = blob_id(docs[text_column]).alias("blob")
    # one row per blob, whatever its copies are called: each task keeps one before the shuffle
    texts = docs.select(blob, docs[text_column].cast("string").alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    todo = F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>")))
    unseen = texts.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)
    unseen.mapInArrow(_scan_batches(rules), _LEDGER).write.mode("append").parquet(ledger)

    # of a kind scanned by several versions only the findings of the given one count, and a pair of blob and rule on record twice counts once
    kind_of = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.kind)))
    rows = read_ledger(spark, ledger).select("blob", F.explode(F.array_distinct("rules")).alias("rule"), "spans").where(F.col("rule").isin(names))
    rows = rows.select("blob", "rule", F.filter("spans", lambda s: s["kind"] == kind_of[F.col("rule")]).alias("spans"))
    here = docs.select(blob).distinct()
    return rows.groupBy("blob", "rule").agg(F.first("spans").alias("spans")).join(here, "blob", "left_semi").groupBy("blob").agg(
        F.flatten(F.collect_list("spans")).alias("spans"))


def ordered_text(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    order = F.create_map(*(F.lit(x) for k, kind in enumerate(kinds) for x in (kind, k)))
    sortable = F.transform(F.filter(spans, lambda s: F.array_contains(F.array(*map(F.lit, kinds)), s["kind"])),
                           lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("o"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return F.concat_ws(",", F.transform(F.array_sort(sortable), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def findings(docs: DataFrame, ledger: str, keep: dict[str, Column], rules: tuple[Rule, ...] = RULES,
             text_column: str = "text") -> DataFrame:
    """The kept columns, blob and spans of every path."""
    found = scan(docs, ledger, rules, text_column)
    paths = docs.select(*(c.alias(n) for n, c in keep.items()), blob_id(docs[text_column]).alias("blob"))
    return paths.join(found, "blob")


def new_ledger(spark: SparkSession) -> str:
    return f"{frames.shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    out = findings(docs, new_ledger(spark), {"doc_id": docs["doc_id"]})
    base, kinds = [r.kind for r in BASE], [r.kind for r in RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, base), F.sha2(ordered_text(F.col("spans"), base).cast("binary"), 256).alias("base_sha256"),
                      ordered_text(F.col("spans"), kinds).alias("spans"))
