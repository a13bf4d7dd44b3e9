"""Added personal data spans on planted values, and brute force for their candidates."""

import random
import re
import time

import pytest

from tessera.llm import pii


def check_digit(body):
    return next(d for d in "0123456789" if pii.luhn(body + d))


def card(rng, good=True):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    right = check_digit(body)
    return body + (right if good else rng.choice([d for d in "0123456789" if d != right]))


def phone(rng):
    return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(2000, 9999)}"


def address(rng):
    return ".".join(str(rng.randint(1, 254)) for _ in range(4))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """(text, values that are personal, values that are not) rows."""
    rng, rows = random.Random(21), []
    for i in range(400):
        before, after = prose(rng, 8), prose(rng, 8)
        kind = i % 5
        if kind == 0:
            a, b = phone(rng), card(rng)
            rows.append((f"{before} {a} {b} {after}", [a, b], []))
        elif kind == 1:
            a, b = card(rng), address(rng)
            rows.append((f"{before} {a} {b} {after}", [a], []))
        elif kind == 2:
            a, b = phone(rng), address(rng)
            rows.append((f"{before} {a} {b} {after}", [a], []))
        elif kind == 3:
            a = card(rng, good=False)
            rows.append((f"{before} {a} {after}", [], [a]))
        else:
            a = "".join(rng.choice("0123456789") for _ in range(15))
            rows.append((f"{before} x{a}b {after}", [], [a]))
    return rows


def test_added_spans_find_values_side_by_side(spark, planted):
    frame = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(planted)], "doc_id long, text string")
    hit = missed = false = 0
    for r in pii.find_personal_data(frame).collect():
        text, real, fake = planted[r["doc_id"]]
        got = [text[int(s) : int(e)] for _, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        hit += sum(v in got for v in real)
        missed += sum(v not in got for v in real)
        false += sum(v in got for v in fake)
    assert hit / (hit + missed) >= 0.95
    assert false <= 0.02 * hit
    assert hit > 300


def brute_candidates(text):
    """Numbers of the given shapes, bounded by other characters, first and longest first."""
    base, failed = pii.scan_base(text)
    shapes = [r"[0-9]{13,19}", r"[0-9]{4}([ -][0-9]{4}){3}", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"]
    out = []
    for lo, hi in failed:
        at = lo
        while at < hi:
            ends = [e for e in range(hi, at, -1) if any(re.fullmatch(x, text[at:e]) for x in shapes) and (at == 0 or not text[at - 1].isdigit()) and not text[e : e + 1].isdigit()]
            if ends:
                whole = [e for e in ends if text[at:e].isdigit()]
                out.append((at, (whole or ends)[0]))
                at = out[-1][1]
            else:
                at += 1
    return sorted({x for x in out if not any(s < x[1] and x[0] < e for _, s, e in base)})


def test_number_candidates_match_brute_force():
    rng = random.Random(22)
    for _ in range(300):
        parts = [rng.choice([card(rng), card(rng, False), address(rng), phone(rng), str(rng.randint(1, 9999)), "4111 1111 1111 1111", "3782 822463 10005", "w"]) for _ in range(rng.randint(1, 4))]
        text = rng.choice(" -").join(parts)
        base, failed = pii.scan_base(text)
        got = sorted((s, e) for k, s, e in pii.candidates(text, base, failed) if k == "card_number")
        want = brute_candidates(text)
        assert set(got) <= set(want), text
        # Where brute force gives spans that don't overlap one another or a phone, all are found.
        phones = [(s, e) for k, s, e in pii.candidates(text, base, failed) if k != "card_number"]
        apart = [x for i, x in enumerate(want) if not any(a < x[1] and x[0] < b for j, (a, b) in enumerate(want) if j != i) and not any(a < x[1] and x[0] < b for a, b in phones)]
        assert set(apart) <= set(got), text


@pytest.mark.parametrize("text", ["7" * 300_000, "1." * 150_000, "+1" + "." * 300_000, "1 " * 150_000, "4111 1111 " * 30_000, "a@" * 150_000])
def test_long_runs_take_linear_time(text):
    began = time.time()
    pii.candidates(text, *pii.scan_base(text))
    assert time.time() - began < 20
