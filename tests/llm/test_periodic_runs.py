import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from millwatch.llm import entry
from millwatch.llm import periodic_runs as p
from millwatch.llm.storage import table

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every stretch of each period, and those among them that have no smaller period."""
    n, out = len(words), []
    ids = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 3 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids[:-q] == ids[q:], [0])).astype(int)))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = j - i + q
            if length >= max(24, 3 * q) and not any((ids[i : i + length - r] == ids[i + r : i + length]).all() for r in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + i % q] for i in range(n - a)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_is_brute_force(spark):
    got = {tuple(r) for r in entry.op13_periodic_runs(spark, SF).collect()}
    want = {plain_row(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    assert got == want
    assert sum(r[1] > 0 for r in want) > 5


@pytest.mark.parametrize("most", [1 << 15, 8])
def test_runs_are_those_of_brute_force(monkeypatch, most):
    monkeypatch.setattr(p, "MOST_BLOCK", most)
    rng = random.Random(1)
    for k in range(400):
        n, kind = rng.randint(0, 200), k % 4
        if kind == 0:
            ids = [rng.randint(0, 1) for _ in range(n)]
        elif kind == 1:
            a, q = rng.randint(0, n), rng.randint(1, 30)
            ids = [rng.randint(0, 50) for _ in range(n)]
            ids = [ids[i if i < a else min(n - 1, a + (i - a) % q)] for i in range(n)]
        elif kind == 2:
            f, g = [0], [1]
            while len(f) <= n:
                f, g = g, g + f
            ids = f[:n]
        else:
            ids = []
            while len(ids) < n:
                ids += [rng.randint(0, 2) for _ in range(rng.randint(1, 20))] * rng.randint(1, 6)
        assert p.runs_of(np.array(ids, np.int64)) == plain_runs(ids)


def test_transform_is_the_sum_of_squares():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 10**6, (5, 16)), rng.integers(0, 10**6, (5, 31))
    want = [[int(((x - y[o : o + 16]) ** 2).sum()) % p.PRIME for o in range(16)] for x, y in zip(a, b, strict=True)]
    assert p.squared_differences(a.astype(np.uint64), b.astype(np.uint64)).tolist() == want


def test_long_text_with_a_long_period():
    part = np.random.default_rng(1).integers(0, 10**5, 70_001)
    assert p.runs_of(np.concatenate(([10**6], np.tile(part, 3), [10**6]))) == [(1, 210_003, 70_001)]


def test_odd_rows(spark):
    rows = [(None, "a b " * 20, 1), (1, None, 2), (2, "", 3), (3, " \n\t ", 4), (4, "x\u00a0y\x1f " * 30, 5), (4, "x\u00a0y\x1f " * 30, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = p.find(df).collect()
    assert [([tuple(x) for x in r.runs], r.collapsed) for r in got] == [([(0, 40, 2)], "a b"), ([], ""), ([], ""), ([], ""), ([(0, 30, 1)], "x\u00a0y\x1f"), ([(0, 30, 1)], "x\u00a0y\x1f")]
    told = p.digest(p.find(df.withColumn("text", p.rewritten(df.doc_id, df.text))), ["doc_id"]).collect()
    assert len(told) == 6
    assert [tuple(r) for r in told][1:4] == [plain_row(i, None) for i in (1, 2, 3)]
    assert told[0].n_runs == 1
    assert p.find(df.limit(0)).count() == 0
