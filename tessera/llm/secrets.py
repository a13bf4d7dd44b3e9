"""Secret scanning with multipart credential linking.

Strong patterns are reported always. Weak parts (an identifier, a bare
high-entropy string, an endpoint) mean little alone; they are reported only when
an interval join finds a complementary part in the same scope.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .pii import emails

# The base patterns, their kinds in report order and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 or more
BASE_KINDS = ("assign", "access", "hex")

# Weak parts by role.
WEAK = (
    ("identifier", re.compile(r"""(?:user_?name|user|login|client_?id|account_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""", re.I | re.A)),
    ("identifier", re.compile(r"(?<![A-Z0-9])A[KS]IA[A-Z0-9]{8,16}(?![A-Z0-9])")),
    ("material", re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{28,}={0,2}(?![A-Za-z0-9+/=_-])")),
    ("material", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Z])(?=[A-Za-z0-9_-]*[a-z])[A-Za-z0-9_-]{28,}={0,2}(?![A-Za-z0-9+/=_-])")),
    ("material", re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,23}(?![0-9A-Za-z])")),
    ("material", re.compile(r"(?<![0-9A-Za-z])(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{24,}(?![0-9A-Za-z])")),
    ("endpoint", re.compile(r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?::[0-9]{1,5})?(?![0-9A-Za-z]|\.[0-9])")),
    ("endpoint", re.compile(r"""(?:https?|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}""")),
    ("endpoint", re.compile(r"""(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+""", re.I | re.A)),
)
KINDS = (*BASE_KINDS, "identifier", "material", "endpoint")
ROLE = {"assign": "material", "hex": "material", "access": "identifier"}
NEEDS = {"material": ("identifier", "endpoint"), "identifier": ("material",), "endpoint": ("material",)}
HINTS = ("pass", "secret", "token", "api")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern that pass its test."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def weak_parts(text: str) -> list[Span]:
    """All matches of the weak patterns, overlapping or not; a mail address is an
    identifier as well."""
    return [("identifier", s, e) for s, e in emails(text)] + [(role, *m.span()) for role, pattern in WEAK for m in pattern.finditer(text)]


def apart(parts: list[Span], taken: list[Span]) -> list[Span]:
    """Of ``parts`` those that don't touch a taken span or one another, the first and longest."""
    found = sorted((s, -e, role) for role, s, e in parts)
    busy = sorted((s, e) for _, s, e in taken)
    begins, free, last = [s for s, _ in busy], [], -1
    reach, most = [], -1  # furthest end of the base spans so far
    for _, e in busy:
        most = max(most, e)
        reach.append(most)
    for start, negative, role in found:
        end = -negative
        at = bisect_left(begins, end)
        if start < last or at and reach[at - 1] > start:
            continue
        free.append((role, start, end))
        last = end
    return free


def weak_spans(text: str, taken: list[Span]) -> list[Span]:
    """Weak parts that don't touch a base span or one another."""
    return apart(weak_parts(text), taken)


def link(base: list[Span], weak: list[Span], reach: int) -> list[Span]:
    """Interval join of parts widened by ``reach``: the weak parts that meet a complement."""
    by_role: dict[str, list[tuple[int, int]]] = {}
    for kind, s, e in (*base, *weak):
        by_role.setdefault(ROLE.get(kind, kind), []).append((s, e))
    index = {}
    for role, spans in by_role.items():
        spans.sort()
        far, ends = -1, []
        for _, e in spans:
            far = max(far, e)
            ends.append(far)
        index[role] = ([s for s, _ in spans], ends)

    def meets(start: int, end: int, role: str) -> bool:
        begins, ends = index.get(role, ((), ()))
        at = bisect_left(begins, end + reach + 1)  # those that begin early enough
        return at > 0 and ends[at - 1] >= start - reach

    return [x for x in weak if any(meets(x[1], x[2], role) for role in NEEDS[x[0]])]


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def scan_text(text: str, reach: int) -> tuple[list[Span], list[Span]]:
    """Base spans, and linked weak parts that touch neither them nor one another.

    Identifiers and material are linked before endpoints take their place, so
    those inside a URL complement each other; a URL is no complement of what it
    holds itself.
    """
    base = base_spans(text)
    parts = weak_parts(text)
    linked = link(base, apart(parts, base), reach)
    inside = link(base, apart([x for x in parts if x[0] != "endpoint"], base), reach)
    known = set(linked)
    more = apart([x for x in inside if x not in known], base + linked)
    return base, sorted(linked + more, key=lambda x: x[1:])


def find_secrets(docs: DataFrame, reach: int = 300) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans; one row per row.

    Scopes are ``reach`` code points on either side of a part, within one text.
    Null and empty texts have no spans. Offsets are code points, ends exclusive.
    Repeated and null doc_ids are kept; other columns are ignored; an empty table
    gives an empty result. Each text is
    scanned whole and alone, in time linear in its length but for sorting.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1):
                base, linked = scan_text(text.as_py() or "", reach)
                n = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                rows.append((*n, len(linked), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + linked)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(scan), f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string")
