"""Periodic runs against comparing every word with every earlier one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from journeyloom.llm import periodic_runs

DOC = "doc_id bigint, text string, runs string, _n int, collapsed string"


def brute(words, min_length=6, min_exponent=4):
    n, out = len(words), {}
    for p in range(1, n // min_exponent + 1):
        at = p
        while at < n:
            if words[at] != words[at - p]:
                at += 1
                continue
            start = at - p
            while at < n and words[at] == words[at - p]:
                at += 1
            if at - start >= max(min_length, min_exponent * p):
                out.setdefault((start, at), p)
    return sorted((a, b - a, p) for (a, b), p in out.items())


def damaged(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    return words


def digest(doc_id, text):
    words = damaged(doc_id, text)
    runs = brute(words)
    kept = [True] * len(words)
    for s, n, q in runs:
        kept[s + q : s + n] = [False] * (n - q)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), s, n, q, 1000 * n // q if runs else None,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for w, k in zip(words, kept) if k)),
    )


def with_tail(rng, n, alphabet):
    words = [rng.randrange(alphabet) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_runs_however_the_words_are_appended():
    rng = random.Random(3)
    for _ in range(1500):
        words = with_tail(rng, rng.randint(0, 120), rng.choice([1, 2, 2, 3, 5]))
        catchers, at = periodic_runs.SquareCatchers(), 0
        while at < len(words):
            step = rng.choice([1, 1, 2, 3, 7, 40])
            catchers.append(np.array(words[at : at + step]))
            at += step
        assert catchers.runs() == brute(words) == periodic_runs.runs_of(np.array(words, np.int64))


def test_runs_are_known_after_every_word():
    words = [3, 1, 2, 1, 2, 1, 2, 1, 2, 2, 2, 2, 2, 2]
    catchers = periodic_runs.SquareCatchers()
    for k, word in enumerate(words, 1):
        catchers.append(np.array([word]))
        assert catchers.runs() == brute(words[:k])


def test_other_limits_and_long_texts():
    rng = random.Random(5)
    for _ in range(300):
        words = with_tail(rng, rng.randint(0, 80), 2)
        assert periodic_runs.runs_of(np.array(words, np.int64), 3, 3) == brute(words, 3, 3)
    assert periodic_runs.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    period = np.random.default_rng(1).integers(0, 50, 9_000)
    assert periodic_runs.runs_of(np.tile(period, 5)) == [(0, 45_000, 9_000)]
    with pytest.raises(ValueError):
        periodic_runs.SquareCatchers(min_exponent=2)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    texts = [
        (None, "a a a a a a a"), (1, None), (2, ""), (3, " \n\t "), (4, "no break no break"), (4, "x " * 7), (4, "x " * 7),
        (5, "word " * 30_000), (6, "a b\n" * 9 + "c"), (7, "\u0001 \u001c " * 5), (8, "a b a b a b b b b b b b"),
    ]
    for k in range(100, 400):
        texts.append((k, " ".join(f"w{c}" for c in with_tail(rng, rng.randint(1, 150), rng.choice([2, 4, 40])))))
    rows = [(i, t, "clash", 1, "clash") for i, t in texts]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = sorted(map(tuple, periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((digest(*t) for t in texts), key=str)
    assert sum(r[1] > 0 for r in got) > 100 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts) > 20
    assert periodic_runs.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0
