"""The toxicity classifier against a version with plain sets of n-grams."""

import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import bytescan, toxicity


def grams(text: bytes) -> set[int]:
    """Hashed n-grams of a text, one at a time."""
    low = bytes(x + 32 if 65 <= x <= 90 else 32 if 9 <= x <= 13 else x for x in text)
    hasher = bytescan.RangeHash(7, max(toxicity.SIZES))
    out = set()
    for k in toxicity.SIZES:
        for i in range(len(low) - k + 1):
            pre = hasher.prefix(np.frombuffer(low[i : i + k], np.uint8))
            out.add(int(hasher.grams(pre, k)[0] >> np.uint64(64 - toxicity.BITS)))
    return out


def texts(n, seed=4):
    rng = random.Random(seed)
    rude = ["awful", "Stupid", "HATEFUL"]
    out = []
    for i in range(n):
        ws = ["".join(rng.choice("abcdeé \t") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 12))]
        out.append(" ".join(ws + ([rng.choice(rude)] if i % 2 else [])))
    return out


@pytest.mark.parametrize("piece", [1 << 18, 16])
def test_scanner_equals_plain_sets(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    some = [*texts(30), "", "abc", "x" * 200, "abcd" * 40]
    raw = "".join(some).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in some])])
    got = [set() for _ in some]
    for row, feature in toxicity.Scanner().hits(np.frombuffer(raw, np.uint8), off):
        for r, f in zip(row.tolist(), feature.tolist(), strict=True):
            assert f not in got[r]
            got[r].add(f)
    assert got == [grams(t.encode()) for t in some]


def test_query_equals_brute_force(spark):
    some = texts(240)
    docs = spark.createDataFrame([*enumerate(some), (3, "zzzz zzzz zzzz"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, features=40)

    training = {}
    for i, t in [*enumerate(some), (3, "zzzz zzzz zzzz")]:
        if i < 200 and zlib.crc32(str(i).encode()) % 5:
            training[i] = min(training.get(i, t.encode()), t.encode())
    sets = {i: grams(t) for i, t in training.items()}
    n = [sum(i % 2 == c for i in sets) for c in (0, 1)]
    seen = {}
    for i, fs in sets.items():
        for f in fs:
            seen.setdefault(f, [0, 0])[i % 2] += 1
    ratio = {f: math.log((c[1] + 1) / (n[1] + 2)) - math.log((c[0] + 1) / (n[0] + 2)) for f, c in seen.items() if sum(c) >= 5}
    best = sorted(ratio, key=lambda f: (-round(abs(ratio[f]) * math.sqrt(sum(seen[f])), 9), f))[:40]
    assert set(model.chosen.tolist()) == set(best)

    # The weights solve the same regression; scores follow from the sets alone.
    order = sorted(sets)
    chosen = sorted(best)
    pairs = [(i, j) for i, d in enumerate(order) for j, f in enumerate(chosen) if f in sets[d]]
    weights, bias = toxicity.regression(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), np.array([d % 2 for d in order], dtype=float), np.array([ratio[f] for f in chosen]), sum(i % 2 for i in range(200) if zlib.crc32(str(i).encode()) % 5) / sum(1 for i in range(200) if zlib.crc32(str(i).encode()) % 5))
    for r in toxicity.score(docs, model, keep=("doc_id", "text")).collect():
        held = grams((r["text"] or "").encode())
        z = bias + sum(w for f, w in zip(chosen, weights, strict=True) if f in held)
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
        assert r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_text_of_sixteen_megabytes(spark):
    some = texts(200)
    long = "a long text that goes on and on " * (16 * 32768) + "awful Stupid HATEFUL awful Stupid"
    docs = spark.createDataFrame([*enumerate(some), (1000, long), (1001, "awful Stupid HATEFUL awful Stupid")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert got[1000] == got[1001] == 1
