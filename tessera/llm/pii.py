"""Personal data detection with aggregated weak supervision.

Fixed base patterns are reported always. Beyond them, wide candidate patterns
are judged: labelers (strict format, gazetteer, context, counter-evidence) vote
or abstain, expectation-maximisation over the counts of vote patterns estimates
each labeler's reliability, and a span classifier is trained on the resulting
soft labels and decides which candidates are reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

# The base patterns and their kinds in report order.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match never begins inside a run of digits
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")

# Wide candidates, by the kind they would be.
CANDIDATES = (
    ("mail_text", re.compile(r"[A-Za-z0-9._%+-]{2,40}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,40}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,10}")),
    ("local_phone", re.compile(r"(?<![0-9+)(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])")),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])")),
    ("person", re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?")),
)
# Inside the runs that fail a base test (two values side by side are one run).
NUMBER = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9])")
DIALLED = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9]|[.][0-9])")
KINDS = (*BASE_KINDS, *(k for k, _ in CANDIDATES), "card_number", "dialled")
CUES = {
    "mail_text": ("mail", "contact", "reach", "write"),
    "local_phone": ("tel", "phone", "call", "fax", "mobile", "cell"),
    "national_id": ("ssn", "social", "security", "id"),
    "iban": ("iban", "bank", "account", "konto", "compte"),
    "person": ("name", "dear", "from", "by", "with", "contact"),
    "card_number": ("card", "visa", "credit", "debit", "amex", "master"),
    "dialled": ("tel", "phone", "call", "fax", "mobile", "cell"),
}
# First digits of payment cards by length, and country calling codes.
ISSUERS = {13: ("4",), 14: ("36", "38", "39"), 15: ("34", "37"), 16: ("4", "51", "52", "53", "54", "55", "6011", "65", "35"), 19: ("4",)}
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420")
GAZETTEER = {
    "mail_text": ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk"),
    "iban": ("DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH", "PT"),
    "person": ("Smith", "Jones", "Miller", "Brown", "Garcia", "Martin", "Schmidt", "Mueller", "Dubois", "Lopez"),
}
BEFORE = re.compile(r"(?:[0-9]\.[0-9]{1,3}|[0-9]{3}[\x20.-][0-9]{4}|@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[0-9]{13,19})\x20$")
AFTER = re.compile(r"\x20(?:\+[0-9]{1,3}\x20|[0-9]{1,3}\.[0-9]{1,3}\.|[0-9]{9,})")
LABELERS = ("format", "gazetteer", "context", "counter")
ABSTAIN = 2
# How likely each labeler says yes, no or nothing: of what is not personal, of what is.
BELIEF = np.array([[[0.10, 0.75, 0.15], [0.30, 0.40, 0.30], [0.15, 0.05, 0.80], [0.05, 0.35, 0.60]], [[0.80, 0.05, 0.15], [0.60, 0.10, 0.30], [0.40, 0.02, 0.58], [0.02, 0.05, 0.93]]])

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The same matches as EMAIL.finditer, found from the at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def scan_base(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each base pattern that pass its test,
    and the card and phone matches that fail theirs."""
    out: list[Span] = [("email", s, e) for s, e in emails(text)]
    failed = []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
            else:
                failed.append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", *m.span()))
            else:
                failed.append(m.span())
    return out, failed


def base_spans(text: str) -> list[Span]:
    return scan_base(text)[0]


def candidates(text: str, taken: list[Span], failed: list[tuple[int, int]]) -> list[Span]:
    """Wide matches, and numbers inside failed runs, that touch no base span and
    no earlier candidate."""
    found = [(m.start(), m.end(), kind) for kind, pattern in CANDIDATES for m in pattern.finditer(text)]
    for lo, hi in failed:
        found += [(m.start(), m.end(), "card_number") for m in NUMBER.finditer(text, lo, hi)]
        if text[lo] == "+":
            m = DIALLED.match(text, lo, hi)
            found += [(*m.span(), "dialled")] if m else []
    if not found:
        return []
    found = sorted(set(found))
    busy, out, i, last = sorted((s, e) for _, s, e in taken), [], 0, -1
    edge = 0
    for s, e, kind in found:
        while i < len(busy) and busy[i][0] < e:
            edge = max(edge, busy[i][1])
            i += 1
        if s >= last and s >= edge:
            out.append((kind, s, e))
            last = e
    return out


def votes(text: str, span: Span) -> tuple[int, ...]:
    """Each labeler's 1 (personal), 0 (not) or ABSTAIN."""
    kind, s, e = span
    value, before, after = text[s:e], text[max(0, s - 40) : s], text[e : e + 12]
    digits = "".join(c for c in value if c.isdigit())
    fmt, gaz = ABSTAIN, ABSTAIN
    if kind == "local_phone":
        fmt = int(digits[0] not in "01" and digits[3] not in "01")
    elif kind == "national_id":
        fmt = int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
    elif kind == "iban":
        packed = value.replace(" ", "")
        number = int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4]))
        fmt = int(number % 97 == 1)
        gaz = int(value[:2] in GAZETTEER[kind])
    elif kind == "mail_text":
        fmt = int("(" in value or "[" in value)
        gaz = int(re.split(r"[^A-Za-z]+", value)[-1].lower() in GAZETTEER[kind])
    elif kind == "card_number":
        fmt = int(luhn(digits))
        gaz = int(digits.startswith(ISSUERS.get(len(digits), ("none",))))
    elif kind == "dialled":
        fmt = int(10 <= len(digits) <= 15 and not re.search(r"[(\x20.-][01]", value[2:5]))
        gaz = int(re.match(r"\+([0-9]+)", value).group(1).startswith(COUNTRIES))
    elif kind == "person":
        gaz = int(value.split()[-1] in GAZETTEER[kind]) or ABSTAIN
        fmt = 1 if value.count(" ") == 2 else ABSTAIN
    low = before.lower()
    context = 1 if any(c in low for c in CUES[kind]) else ABSTAIN
    if kind in ("card_number", "dialled"):
        # Beside another value of the kind people leave together; or part of a word.
        beside = BEFORE.search(before) or AFTER.match(after)
        context = 1 if beside else context
        counter = 0 if before[-1:].isalnum() or after[:1].isalnum() else ABSTAIN
    else:
        numbers = sum(c.isdigit() for c in before[-15:] + after)
        counter = 0 if numbers >= 8 or re.search(r"[$€%=/#]\x20?$", before) else ABSTAIN
    return fmt, gaz, context, counter


def features(text: str, span: Span) -> tuple[int, ...]:
    """Small discrete description of a span for the final classifier."""
    kind, s, e = span
    before, after = text[max(0, s - 40) : s], text[e : e + 1]
    size = min(3, (e - s) // 8)
    cue = int(any(c in before.lower() for c in CUES[kind]))
    colon = int(before.rstrip()[-1:] in (":", "="))
    open_ended = int(bool(after) and after.isalnum())
    crowded = min(3, sum(c.isdigit() for c in before[-15:]) // 3)
    return KINDS.index(kind), size, cue, colon, open_ended, crowded, *votes(text, span)[:2]


def fit_reliability(patterns: np.ndarray, counts: np.ndarray, groups: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
    """Posterior of "personal" for each vote pattern, by EM over labeler reliabilities.

    patterns: (n, labelers) votes, counts: rows each stands for, groups: the kind of
    each pattern. For every kind each labeler has its own probability of saying yes,
    no or nothing, given the class; BELIEF is where they start, and weighs as much
    as ten rows and a quarter of the kind's rows, so that the classes keep their
    meaning where labelers seldom disagree.
    """
    groups = np.zeros(len(patterns), dtype=int) if groups is None else groups
    said = np.stack([patterns == v for v in (1, 0, ABSTAIN)], 2).astype(float)  # pattern, labeler, vote
    out = np.zeros(len(patterns))
    for g in np.unique(groups):
        at = groups == g
        v, n = said[at], counts[at]
        weight = 10 + n.sum() / 4
        prior, chance = 0.5, BELIEF
        for _ in range(rounds):
            odds = np.log(prior / (1 - prior)) + (v * np.log(chance[1] / chance[0])).sum((1, 2))
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            prior = float(np.clip(((n * p).sum() + 5) / (n.sum() + 10), 0.02, 0.98))
            seen = np.stack([((n * w)[:, None, None] * v).sum(0) for w in (1 - p, p)])
            chance = (seen + weight * BELIEF) / (seen.sum(2, keepdims=True) + weight)
        out[at] = p
    return out


def _expand(f: np.ndarray) -> np.ndarray:
    """Discrete features as indicator columns, kind crossed with each of them."""
    sizes = (len(KINDS), 4, 2, 2, 2, 4, 3, 3)
    cols = [np.ones((len(f), 1))]
    cols.append(np.eye(sizes[0])[f[:, 0]])
    for i in range(1, len(sizes)):
        cross = f[:, 0] * sizes[i] + f[:, i]
        cols.append(np.eye(sizes[i])[f[:, i]])
        cols.append(np.eye(sizes[0] * sizes[i])[cross])
    return np.concatenate(cols, 1)


def fit_classifier(f: np.ndarray, target: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic regression on soft labels, weighted by counts."""
    x = _expand(f)
    w = np.zeros(x.shape[1])
    share = np.sqrt(counts)
    share = share / share.sum()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (share * (q - target)) + 1e-4 * w)
    return w


class SpanModel:
    """Classifier weights; ``keeps`` decides a candidate."""

    def __init__(self, weights: np.ndarray, cut: float = 0.5):
        self.weights, self.cut = weights, cut

    def probability(self, f: tuple[int, ...]) -> float:
        z = float((_expand(np.array([f])) @ self.weights)[0])
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame) -> SpanModel | None:
    """Count (features, votes) over every candidate of every text, then fit.

    What reaches the driver is one row per distinct combination of these small
    discrete values, a number that the table's size does not change.
    """

    def scan(batches):
        for batch in batches:
            seen: dict[tuple[int, ...], int] = {}
            for value in batch.column(0):
                text = value.as_py() or ""
                for span in candidates(text, *scan_base(text)):
                    key = (*features(text, span), *votes(text, span))
                    seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], names=["key", "n"])

    rows = docs.select("text").mapInArrow(tidy(scan), "key array<int>, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect()
    if not rows:
        return None
    keys, counts = np.array([r["key"] for r in rows]), np.array([r["n"] for r in rows], dtype=float)
    f, v = keys[:, : -len(LABELERS)], keys[:, -len(LABELERS) :]
    return SpanModel(fit_classifier(f, fit_reliability(v, counts, f[:, 0]), counts))


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def find_personal_data(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans; one row per row.

    Without ``model`` one is trained on the table first (two scans). Null and
    empty texts have no spans. Offsets are code points, ends exclusive. Repeated
    and null doc_ids are kept; other columns are ignored; an empty table gives an
    empty result. A table without any candidate reports the base spans alone. Each
    text is scanned whole, in time linear in its length but for sorting.
    """
    model = model or train(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, ...], bool] = {}

        def keeps(text: str, span: Span) -> bool:
            f = features(text, span)
            if f not in known:
                known[f] = model is not None and model.probability(f) >= model.cut
            return known[f]

        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base, failed = scan_base(text)
                more = [x for x in candidates(text, base, failed) if keeps(text, x)]
                n = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                rows.append((*n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(scan), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")
