"""Personal data: generators propose overlapping spans, boosted trees judge them, calibrated thresholds select.

Fixed rules give base spans (e-mail addresses, IP addresses, card and phone numbers), which always stay.  High-recall generators
propose many more, overlapping: every run of up to six digit groups of 7 to 19 digits, dotted numbers, colon-separated hex, things around
an ``@`` or a written "at", with brackets or spaces put in.  Gradient-boosted trees (Spark ML) score a proposal by its format (digits, groups, separators, Luhn's sum,
octets) and its context (neighbouring characters, digits around, cue words).

There are no labels of personal data, so they are made from the base spans of a bounded sample of documents: a base span and
the ways of writing it that the rules miss (``disguised``) are positive; its spoilt forms (``spoilt``: a wrong check digit,
a part beyond 255, too few digits, no domain) and the proposals that touch no base span are negative.  All of a span's forms are on one side of the
split by hash into a training and a calibration part.  On the latter isotonic regression turns scores into probabilities, for each kind that has enough rows, and a
proposal is selected from CONFIDENCE on.  Selected proposals that touch a base span or a better proposal go.

The fit sees at most TRAIN_DOCS documents in expectation (by hash) and TRAIN_ROWS proposals; all else covers whole texts of all documents in one narrow pass.

Defined results: a null text is empty; offsets are code points, ends exclusive; where the sample has fewer than LEAST_POSITIVE positive rows
nothing is added; rows that repeat an id are judged alike; extra columns are kept by ``redacted`` and ignored by ``found``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, per_batch, stored, table

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_ROWS = 20_000, 20_000
LEAST_POSITIVE, LEAST_CALIBRATED = 40, 60
CONFIDENCE = 0.9
TREES, DEPTH, STEP = 20, 4, 0.3
CONTEXT = 32
#: Groups of digits that a number is written in, at most.
GROUPS = 6
#: Words that announce personal data.
CUES = re.compile(r"(?i)\b(e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|account|ip|host|server|address)\b")

Span = tuple[str, int, int]


# --- the base rules -------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> list[Span]:
    """As a search for local part, @ and domain from the left finds them, in time proportional to the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCALS:
            lo -= 1
        domain = _DOMAIN.match(text, at + 1) if lo < at else None
        if domain:
            done = domain.end()
            out.append(("email", lo, done))
        at = text.find("@", max(at + 1, done))
    return out


def _ips(text: str) -> list[Span]:
    """Each four parts of a chain of dotted numbers, from the left."""
    out = []
    for chain in _CHAIN.finditer(text):
        parts = list(re.finditer(r"[0-9]+", chain.group())) if chain.group().count(".") >= 3 else []
        for k in range(0, len(parts) - 3, 4):
            if all(_octet(p.group()) for p in parts[k : k + 4]):
                out.append(("ip", chain.start() + parts[k].start(), chain.start() + parts[k + 3].end()))
    return out


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    out = _emails(text) if "@" in text else []
    out += _ips(text) if "." in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = only_digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return out


# --- proposals ------------------------------------------------------------

_RUN = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/]{0,2}[0-9]){6,}")
_DEFANGED = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}")
_COLONS = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}")
_BRACKETED = re.compile(r"(?:at|AT) ?[\])}]")
_AT = re.compile(r" ?[\[({] ?(?:at|AT) ?[\])}] ?| (?:at|AT) |@")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) )[A-Za-z0-9-]{1,63}){0,4}")


def proposals(text: str) -> list[Span]:
    """Whatever could be personal data, overlapping.  A text of n characters has O(n) of them."""
    out: set[Span] = set()
    for m in _RUN.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer(r"[0-9]+", m.group())]
        for k, (lo, _) in enumerate(groups):
            first = lo
            while first > m.start() and text[first - 1] in "+(":
                first -= 1
            digits = 0
            for a, hi in groups[k : k + GROUPS]:
                digits += hi - a
                if digits > 19:
                    break
                if digits >= 7:
                    out.add(("phone", first, hi))
                if digits >= 13:
                    out.add(("card", lo, hi))
    for m in _CHAIN.finditer(text):
        if m.group().count(".") >= 2:
            parts = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[0-9]+", m.group())]
            out |= {("ip", parts[k][0], parts[min(k + 3, len(parts) - 1)][1]) for k in range(max(1, len(parts) - 3))}
    for pattern, marks in ((_DEFANGED, ("[.]", "(.)", " . ")), (_COLONS, (":",))):
        if any(mark in text for mark in marks):
            out |= {("ip", m.start(), m.end()) for m in pattern.finditer(text)}
    if any(mark in text for mark in ("@", " at ", " AT ")) or _BRACKETED.search(text):
        for m in _AT.finditer(text):
            lo = m.start()
            while lo > 0 and m.start() - lo < 64 and text[lo - 1] in _LOCALS:
                lo -= 1
            host = _HOST.match(text, m.end()) if lo < m.start() else None
            if host and (m.group() == "@" or not host.group().isalnum()):
                out.add(("email", lo, host.end()))
    return sorted(out)


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(kind: str, before: str, span: str, after: str) -> list[float]:
    """Format, then context.  ``before`` and ``after`` have CONTEXT characters at most."""
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    parts = re.split(r"\.|\[\.\]|\(\.\)| \. ", span)
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in parts)
    digits, tail = only_digits(span), re.search(r"[A-Za-z]*$", span).group()
    own = [
        *(float(kind == k) for k in KINDS), len(span), len(digits), sum(map(str.isalpha, span)), len(groups), max(groups, default=0), min(groups, default=0),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(octets), len(parts), span.count(" "), span.count("-"), span.count("/"), span.count("("), float(span.startswith("+")),
        len(_AT.findall(span)), len(tail), len(re.findall(r"(?i)[\[({ ](?:dot|\.)[\])} ]|[\w]\.[A-Za-z]", span)), span.count(":"),
    ]
    around = [_side(before[-1:]), _side(after[:1]), sum(map(str.isdigit, before)), sum(map(str.isdigit, after)), float(bool(CUES.search(before))), before.count('"') + before.count("="), float(after[:2].lstrip(".-/")[:1].isdigit())]
    return [float(v) for v in own + around]


def _context(text: str, span: Span) -> tuple[str, str, str, str]:
    kind, lo, hi = span
    return kind, text[max(0, lo - CONTEXT) : lo], text[lo:hi], text[hi : hi + CONTEXT]


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


class Taken:
    """Stretches of a text that are taken, disjoint and in order."""

    def __init__(self, spans: list[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, lo, hi in sorted(spans, key=lambda s: s[1]):
            if self.ends and lo < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], hi)
            else:
                self.starts.append(lo)
                self.ends.append(hi)

    def touches(self, span: Span) -> bool:
        at = bisect_left(self.starts, span[2])
        return at > 0 and self.ends[at - 1] > span[1]

    def take(self, span: Span) -> None:
        """``span`` touches nothing that is taken."""
        at = bisect_left(self.starts, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


# --- made labels ----------------------------------------------------------


def disguised(kind: str, span: str) -> list[str]:
    """Ways of writing the same that the rules miss."""
    if kind == "email":
        name, host = span.split("@", 1)
        return [f"{name}{at}{host.replace('.', dot)}" for at, dot in ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."))]
    if kind == "ip":
        return [span.replace(".", dot) for dot in ("[.]", "(.)", " . ")]
    digits = only_digits(span)
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [sep.join(fours) for sep in (".", "/", "  ")]
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    head = digits[:-10]
    return [f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a}-{b}-{c}", *([f"{head} ({a}) {b}-{c}"] if head else [])]


def spoilt(kind: str, span: str) -> list[str]:
    """Forms that look alike and are not valid."""
    if kind == "email":
        name, host = span.split("@", 1)
        return [f"{name}@{host.split('.')[0]}", f"{name} at {host.split('.')[0]}", f"{name[:3]} at {host.split('.')[-1]}"]
    if kind == "ip":
        parts = span.split(".")
        return [".".join(parts[:3]), ".".join([*parts[:3], str(300 + int(parts[3]))]), "[.]".join([str(256 + int(parts[0])), *parts[1:]])]
    digits = only_digits(span)
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + len(digits) % 3) % 10)
        return [wrong, *(sep.join(wrong[i : i + 4] for i in range(0, len(wrong), 4)) for sep in (" ", ".", "/"))]
    return [digits[-7:], f"{digits[-7:-4]}-{digits[-4:]}", f"{digits[-8:-4]}-{digits[-4:-2]}-{digits[-2:]}", f"+{digits[-8:]}"]


EXAMPLE = "kind string, features array<double>, label double, held boolean, place long"


def examples(docs: DataFrame) -> DataFrame:
    """Labelled rows of the documents (text): what is proposed in them, and the made forms of their base spans."""

    def make(batch: pa.RecordBatch):
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            taken = Taken(base)
            for span in base:
                kind, before, own, after = _context(text, span)
                held = xxhash.xxh3_64_intdigest(own.encode()) % 4 == 0
                rows += [(kind, features(kind, before, form, after), label, held) for label, forms in ((1.0, [own, *disguised(kind, own)]), (0.0, spoilt(kind, own))) for form in forms]
            for span in proposals(text):
                if not taken.touches(span):
                    kind, before, own, after = _context(text, span)
                    rows.append((kind, features(kind, before, own, after), 0.0, xxhash.xxh3_64_intdigest(own.encode()) % 4 == 0))
        if not rows:
            return None
        place = [xxhash.xxh3_64_intdigest(repr(r).encode()) >> 1 for r in rows]
        return dict(zip(("kind", "features", "label", "held"), zip(*rows))) | {"place": place}

    return per_batch(docs, make, EXAMPLE)


# --- the model ------------------------------------------------------------


def tree_arrays(shown: str) -> list[tuple]:
    """The nodes of a Spark ML tree from its ``toDebugString``: (feature, threshold, left, right, value); leaves have feature -1."""
    lines = [line.strip() for line in shown.splitlines() if re.match(r"\s*(If|Else|Predict)", line)]
    nodes: list[tuple] = []

    def read(at: int) -> tuple[int, int]:
        own = len(nodes)
        nodes.append(())
        found = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at])
        if not found:
            nodes[own] = (-1, 0.0, 0, 0, float(lines[at].split(":")[1]))
            return own, at + 1
        left, at = read(at + 1)
        right, at = read(at + 1)  # behind the line of the other branch
        nodes[own] = (int(found[1]), float(found[2]), left, right, 0.0)
        return own, at

    read(0)
    return nodes


@dataclass
class Model:
    trees: list[tuple[float, list[tuple]]]
    least: dict[str, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Margins of the rows."""
        total = np.zeros(len(x))
        for weight, nodes in self.trees:
            feature, cut, left, right, value = (np.array(v) for v in zip(*nodes))
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += weight * value[at]
        return total

    def select(self, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        """For each text the proposals that are selected, in order of kind and start; none touches a base span or another one."""
        taken = [Taken(base) for base in bases]
        found = [(i, s) for i, text in enumerate(texts) for s in proposals(text) if not taken[i].touches(s)]
        if not found:
            return [[] for _ in texts]
        scores = self.scores(np.array([features(*_context(texts[i], s)) for i, s in found]))
        kept: list[list[Span]] = [[] for _ in texts]
        for score, (i, span) in sorted(zip(scores.tolist(), found), key=lambda r: (-r[0], r[1][1][2] - r[1][1][1], r[1])):
            if score >= self.least[span[0]] and not taken[i].touches(span):
                taken[i].take(span)
                kept[i].append(span)
        return [in_order(k) for k in kept]


def fit(docs: DataFrame) -> Model | None:
    """Trees and thresholds from a sample of ``docs`` (text); None where the sample has too few base spans."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    share = min(1.0, TRAIN_DOCS / max(docs.count(), 1))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    rows = stored(examples(sample).orderBy("place", "kind", "label").limit(TRAIN_ROWS), "examples")  # TRAIN_ROWS small rows
    held = {(r["kind"], r["label"], r["held"]): r["n"] for r in rows.groupBy("kind", "label", "held").agg(F.count("*").alias("n")).collect()}
    count = lambda label, part: sum(n for (_, y, h), n in held.items() if y == label and h == part)
    if min(count(1.0, False), count(1.0, True) * 3, count(0.0, False), count(0.0, True) * 3) < LEAST_POSITIVE:
        return None
    data = rows.select("kind", "label", "held", array_to_vector("features").alias("features")).coalesce(2)
    boosted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=5, seed=11).fit(data.where("not held"))
    judged = stored(boosted.transform(data.where("held")).select("kind", "label", vector_to_array("rawPrediction")[1].alias("margin")), "judged")

    def threshold(part: DataFrame) -> float:
        curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(part)
        return next((x for x, p in zip(curve.boundaries, curve.predictions) if p >= CONFIDENCE), float("inf"))

    shared = threshold(judged)
    enough = [k for k in KINDS if min(held.get((k, 0.0, True), 0), held.get((k, 1.0, True), 0)) >= LEAST_CALIBRATED]
    least = {k: threshold(judged.where(F.col("kind") == k)) if k in enough else shared for k in KINDS}
    return Model([(float(w), tree_arrays(t.toDebugString)) for w, t in zip(boosted.treeWeights, boosted.trees)], {k: float(v) for k, v in least.items()})


# --- use ------------------------------------------------------------------


def spans_of(texts: list[str], model: Model | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and added ones of each text."""
    bases = [base_spans(t) for t in texts]
    return bases, model.select(texts, bases) if model else [[] for _ in texts]


FOUND = "doc_id long, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>"


def found(df: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, base, added: the spans of each row of ``df``."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # TREES trees
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def make(batch: pa.RecordBatch):
        base, added = spans_of(batch.column("text").to_pylist(), sent.value)
        shaped = lambda column: [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in column]
        return {"doc_id": batch.column("doc_id"), "base": shaped(base), "added": shaped(added)}

    return per_batch(rows, make, FOUND)


def redact(text: str, spans: list[Span]) -> str:
    """Each stretch that spans cover becomes the kind of its first span in brackets."""
    out, done = [], 0
    for kind, lo, hi in sorted(spans, key=lambda s: (s[1], -s[2])):
        if lo >= done:
            out += [text[done:lo], f"[{kind.upper()}]"]
        done = max(done, hi)
    return "".join(out) + text[done:]


def redacted(df: DataFrame, model: Model | None) -> DataFrame:
    """``df`` with its texts redacted, and ``n_chars``, if there, counted anew."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    at, counted = df.columns.index("text"), df.columns.index("n_chars") if "n_chars" in df.columns else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            counts = columns[counted].to_pylist() if counted is not None else []
            texts = columns[at].to_pylist()
            for i, (base, added) in enumerate(zip(*spans_of([t or "" for t in texts], sent.value))):
                if base or added:
                    texts[i] = redact(texts[i], base + added)
                    if counts:
                        counts[i] = len(texts[i])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counts:
                columns[counted] = pa.array(counts, batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(df, run, df.schema)


DIGESTS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts and digests of what ``found`` gives."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = lambda spans, k: F.filter(spans, lambda s: s["kind"] == k)
    of = {k: own(F.concat("base", "added"), k) for k in KINDS}
    every = F.concat(*[F.array_sort(of[k], lambda a, b: F.coalesce(F.nullif(a["start"] - b["start"], F.lit(0)), a["end"] - b["end"])) for k in KINDS])
    counts = [F.size(own(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return span_digests(found(docs, fit(docs)))
