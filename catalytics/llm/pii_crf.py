"""Personal data: base patterns, and a semi-Markov conditional random field over whole spans.

Base spans come from the four fixed patterns.  The field adds spans the patterns do not reach: it
reads the text around every digit and ``@`` as a sequence of atoms (letter runs, digit runs,
single other characters), scores every candidate segment of at most ``MAX_ATOMS`` atoms and every
type with features of the whole segment (digit counts, separators, octets, check digit, edges),
and a dynamic program bounded by that length chooses boundaries and types jointly.  A candidate
must hold a digit or ``@``, so an atom from which none lies within ``MAX_ATOMS`` atoms is outside and
skipped.  Triggers closer together than two segments can reach share a zone, and a zone holds every
segment around its triggers and the atom beside it, so the zones are independent and the cut
changes neither the candidates nor the optimum.

The weights are trained here by maximum likelihood (forward-backward over segments, AdaGrad) on a
bounded sample of zones labelled by the base patterns (zones of more than 400 characters in parts):
at most ``ZONES_PER_LABEL`` of each label, the ones with the smallest hash of their text.  Added spans never overlap base spans.

Special cases: a null or empty text has no spans; repeated rows are separate rows; a corpus
without any zone trains no field and keeps the base spans; an empty table gives an empty result;
other columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalytics.llm import frames

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 16
ZONES_PER_LABEL = 60
EPOCHS = 12
RATE = 0.5
PENALTY = 1e-4

Span = tuple[str, int, int]

# Fixed values of the base kinds; possessive where a shorter match could not succeed either.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TRIGGER = re.compile(r"[0-9@]")
_HELD = re.compile(r"[0-9]+|@")
_PART = re.compile(r"(?<!\S)\S(?:.{0,398}\S)?(?!\S)", re.DOTALL)      # at most 400 characters, cut at white space
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
_FREE = r"(?:[A-Za-z]++|[^A-Za-z0-9@]){0,%d}+"                       # atoms without a trigger
_REACH = re.compile(_FREE % MAX_ATOMS)                              # a segment's other atoms and the one beside it
_JOINED = re.compile(_FREE % (2 * (MAX_ATOMS - 1) - 1))            # fewer than two segments reach across


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(body: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, body.find("@")
    while at >= 0:
        left = at
        while left > free and body[left - 1] in _LOCAL:
            left -= 1
        domain = _DOMAIN.match(body, at + 1) if left < at else None
        if domain:
            out.append((left, domain.end()))
            free = domain.end()
        at = body.find("@", max(at + 1, free))
    return out


def base_spans(body: str) -> list[Span]:
    """Spans of the base patterns, by kind as listed, then start."""
    if not _TRIGGER.search(body):
        return []
    out = [("email", s, e) for s, e in _emails(body)]
    for m in _IP.finditer(body):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(body):
        if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in body:
        out += [("phone", *m.span()) for m in _PHONE.finditer(body) if 8 <= len(_digits(m.group())) <= 15]
    return out


# ---- zones, candidate segments, whole-span features ----

def zones(body: str) -> Iterator[tuple[int, str]]:
    """Start and text of each maximal stretch whose segments may meet, with one atom more on both sides."""
    begin, stop = -1, 0
    for m in _HELD.finditer(body):
        if begin < 0 or _JOINED.match(body, stop, m.start()).end() < m.start():
            if begin >= 0:
                yield begin, body[begin:_REACH.match(body, stop).end()]
            begin = m.start() - _REACH.match(body[stop:m.start()][::-1]).end()
        stop = m.end()
    if begin >= 0:
        yield begin, body[begin:_REACH.match(body, stop).end()]


_GROUPS = ((0, 1, 4, 8, 12, 16, 20), (0, 1, 2), (0, 1, 2, 3, 4), (1, 2, 4, 7, 8, 11))


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges) - 1


def _widths() -> list[int]:
    return [len(_GROUPS[0]), len(_GROUPS[1]), len(_GROUPS[2]), len(_GROUPS[3])]


_OFFSETS = np.cumsum([0, *_widths()]).tolist()
_FLAGS = ("bias", "plus", "paren", "letters", "space", "hyphen", "only_dotted_digits", "octets", "check_digit", "edge_left",
          "edge_right", "glued_left", "glued_right", "dot_after_at", "text_before_at", "other_mark", "digit_groups_of_four")
N_FEATURES = _OFFSETS[-1] + len(_FLAGS)
_GLUE = frozenset("@.-_+%")


def _segment_features(atoms: list[str], i: int, j: int) -> tuple[int, ...]:
    seg = atoms[i:j]
    whole = "".join(seg)
    digits = [a for a in seg if "0" <= a[0] <= "9"]
    n_digits, ats, dots = sum(map(len, digits)), seg.count("@"), seg.count(".")
    before = atoms[i - 1] if i else " "
    after = atoms[j] if j < len(atoms) else " "
    letters = any(a[0].isalpha() for a in seg)
    plain = all(a == "." or "0" <= a[0] <= "9" for a in seg)
    where = whole.find("@")
    flags = (True, seg[0] == "+", "(" in seg, letters, " " in seg, "-" in seg, plain and dots > 0,
             plain and len(digits) == 4 and dots == 3 and all(len(d) <= 3 and int(d) <= 255 for d in digits),
             16 <= n_digits <= 19 and not letters and luhn("".join(digits)), seg[0][0].isalnum() or seg[0] == "+", seg[-1][-1].isalnum(),
             before[0].isalnum() or before in _GLUE, after[0].isalnum() or after in _GLUE and after != ".",
             0 <= where and "." in whole[where:], where > 0, any(not (a[0].isalnum() or a in " .-+@()_%") for a in seg),
             len(digits) >= 4 and all(len(d) == 4 for d in digits))
    groups = (n_digits, ats, dots, len(seg))
    return (*(_OFFSETS[k] + _bucket(n, _GROUPS[k]) for k, n in enumerate(groups)),
            *(_OFFSETS[-1] + k for k, on in enumerate(flags) if on))


def candidates(atoms: list[str]) -> list[tuple[int, int]]:
    """Segments of at most MAX_ATOMS atoms that hold a digit or ``@`` and neither start nor end with white space."""
    held = np.cumsum([0, *("0" <= a[0] <= "9" or a == "@" for a in atoms)])
    return [(i, j) for i in range(len(atoms)) if not atoms[i].isspace()
            for j in range(i + 1, min(len(atoms), i + MAX_ATOMS) + 1) if held[j] > held[i] and not atoms[j - 1].isspace()]


class Field:
    """Semi-Markov field: weights (features, kinds); an outside atom scores 0."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: dict[tuple[int, ...], np.ndarray] = {}

    def score(self, key: tuple[int, ...]) -> np.ndarray:
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = self.weights[list(key)].sum(axis=0)
        return self.known[key]

    def decode(self, zone: str) -> list[Span]:
        """Best segmentation of a zone: spans relative to its start."""
        atoms = _ATOM.findall(zone)
        best, back, last = [0.0] * (len(atoms) + 1), [None] * (len(atoms) + 1), -1
        for j in range(1, len(atoms) + 1):
            best[j] = best[j - 1]
            if "0" <= atoms[j - 1][0] <= "9" or atoms[j - 1] == "@":
                last = j - 1
            if atoms[j - 1].isspace():
                continue
            for i in range(max(0, j - MAX_ATOMS), last + 1):      # the same segments as candidates(), without a list of them
                if not atoms[i].isspace():
                    s = self.score(_segment_features(atoms, i, j))
                    k = int(s.argmax())
                    if best[i] + float(s[k]) > best[j]:    # an outside reading of an atom scores 0
                        best[j], back[j] = best[i] + float(s[k]), (i, k)
        at = np.cumsum([0, *map(len, atoms)])
        out, j = [], len(atoms)
        while j:
            if back[j]:
                i, k = back[j]
                out.append((KINDS[k], int(at[i]), int(at[j])))
                j = i
            else:
                j -= 1
        return out[::-1]


def fit(labelled: list[str], epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY) -> np.ndarray:
    """Maximum-likelihood weights from zones whose reference segmentation is their base spans."""
    prepared = []
    for zone in labelled:
        atoms = _ATOM.findall(zone)
        at = {p: n for n, p in enumerate(np.cumsum([0, *map(len, atoms)]).tolist())}
        segments = candidates(atoms)
        keys = [_segment_features(atoms, i, j) for i, j in segments]
        x = np.zeros((len(keys), N_FEATURES))
        for r, key in enumerate(keys):
            x[r, list(key)] = 1
        gold = np.zeros((len(keys), len(KINDS)))
        where, taken = {s: r for r, s in enumerate(segments)}, 0
        for kind, s, e in sorted(base_spans(zone), key=lambda t: (t[1], -t[2])):
            r = where.get((at.get(s), at.get(e)))
            if r is not None and segments[r][0] >= taken:
                gold[r, KINDS.index(kind)], taken = 1, segments[r][1]
        prepared.append((len(atoms), np.array(segments).reshape(-1, 2), x, gold))
    weights, squares = np.zeros((N_FEATURES, len(KINDS))), np.full((N_FEATURES, len(KINDS)), 1e-8)
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for z in order.permutation(len(prepared)):
            n, segments, x, gold = prepared[z]
            if not len(segments):
                continue
            score = x @ weights
            total = np.logaddexp.reduce(score, axis=1)
            ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            ahead[0] = behind[n] = 0
            by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for r, (i, j) in enumerate(segments.tolist()):
                by_end[j].append((i, total[r]))
                by_start[i].append((j, total[r]))
            for j in range(1, n + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + s for i, s in by_end[j])])
            for i in range(n - 1, -1, -1):
                behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[j] + s for j, s in by_start[i])])
            chance = np.exp(ahead[segments[:, 0]][:, None] + score + behind[segments[:, 1]][:, None] - ahead[n])
            gradient = x.T @ (gold - chance) - penalty * weights
            squares += gradient * gradient
            weights += rate * gradient / np.sqrt(squares)
    return weights


# ---- jobs ----

def _zone_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for body in batch.column("text"):
            for _, zone in zones(body.as_py()):
                for part in [zone] if len(zone) <= 400 else _PART.findall(zone):      # for training only; every zone is decoded whole
                    found.append((part, "+".join(sorted({k for k, _, _ in base_spans(part)}))))
        yield pa.RecordBatch.from_arrays([pa.array([z for z, _ in found], pa.string()), pa.array([k for _, k in found], pa.string())], ["zone", "label"])


def train(docs: DataFrame, text_column: str = "text", zones_per_label: int = ZONES_PER_LABEL) -> np.ndarray | None:
    """Weights fitted on the bounded zone sample; None where the corpus has no zone."""
    texts = docs.select(docs[text_column].cast("string").alias("text")).where("text rlike '[0-9@]'")
    rank = Window.partitionBy("label").orderBy("h", "zone")
    sample = texts.mapInArrow(_zone_batches, "zone string, label string").distinct().withColumn("h", F.xxhash64("zone")).withColumn(
        "r", F.row_number().over(rank)).where(F.col("r") <= zones_per_label).orderBy("label", "h", "zone").collect()
    return fit([r.zone for r in sample]) if sample else None


def find(body: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and those the field adds outside them (by kind as listed, then start)."""
    base = base_spans(body)
    if field is None or not _TRIGGER.search(body):
        return base, base
    taken = sorted((s, e) for _, s, e in base)
    added, t = [], 0
    for begin, zone in zones(body):
        for kind, s, e in field.decode(zone):
            s, e = s + begin, e + begin
            while t < len(taken) and taken[t][1] <= s:
                t += 1
            # base kinds may overlap one another, so look on from t to the first span that starts later
            k, free = t, True
            while k < len(taken) and taken[k][0] < e:
                free &= taken[k][1] <= s
                k += 1
            if free:
                added.append((kind, s, e))
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))


def _find_batches(broadcast, id_names: list[str]):
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = broadcast.value
        field = Field(weights) if weights is not None else None
        for batch in batches:
            found = [find(x.as_py() or "", field) for x in batch.column("__text")]
            cast = lambda k: pa.array([[dict(zip(("kind", "start", "stop"), s)) for s in f[k]] for f in found], span_type)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in id_names), cast(0), cast(1)], [*id_names, "base", "spans"])
    return run


def personal_data(docs: DataFrame, keep: dict[str, Column], text_column: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """The kept columns, base and spans (arrays of kind, start, stop) of every row; trains the field unless weights are given."""
    weights = train(docs, text_column) if weights is None else weights
    chosen = docs.select(*(c.alias(n) for n, c in keep.items()), docs[text_column].cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text")
    span = "array<struct<kind:string,start:long,stop:long>>"
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return chosen.mapInArrow(_find_batches(shared, list(keep)), f"{schema}, base {span}, spans {span}")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    out = personal_data(docs, {"doc_id": docs["doc_id"]})
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
