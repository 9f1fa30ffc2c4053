import hashlib
import random
import re
from collections import defaultdict

import pytest

from millwatch.llm import exact_dedup as e
from millwatch.llm.storage import new_path


def plain(rows):
    """Groups of rows by their text without white space: id, keep_id, group_size, kept, digest."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i))
    out = []
    for narrow, members in groups.items():
        keep = min(members, key=lambda m: m[:2] + ((m[2],) if m[2] is not None else ()))[2]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(narrow.encode()).hexdigest()) for _, _, i in members]
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 4))) for _ in range(n // 3)] + ["hot text of many copies"] * (n // 3)
    return [(i * 3, "".join(c + rng.choice(["", "", " ", "\n\t"]) for c in rng.choice(base))) for i in range(n)]


def given(spark, rows, parts, path=None, mode="errorifexists"):
    path = path or new_path(spark, "texts")
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "'x' AS copies").repartition(parts).write.mode(mode).parquet(path)
    return path


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("bits,batch,window", [(256, 1 << 40, 32 << 20), (256, 1, 50), (4, 1, 200), (0, 1 << 40, 30)])
def test_groups_are_exact_whatever_the_digest(spark, monkeypatch, bits, batch, window):
    """One byte a batch gives each file a batch of its own; digests of 4 bits, or none, put different texts under one key."""
    monkeypatch.setattr(e, "WINDOW_BYTES", window)
    rows = texts(bits, 240) + [(7, None), (8, ""), (9, " \r\f\v")]
    assert found(e.deduplicate(spark, given(spark, rows, 3), batch, bits=bits)) == plain(rows)


def test_state_goes_on_where_it_stopped(spark):
    first, second = texts(1, 90), [(i + 1000, t) for i, t in texts(1, 60)] + [(5000, "hot  text  of  many  copies  at  last")]
    path, folder = given(spark, first, 2), new_path(spark, "state")
    e.absorb(e.stream_of(spark, path), folder)
    assert sorted((r.id, r.keep_id, r.group_size) for r in e.judge(spark.read.parquet(path), folder).collect()) == sorted(r[:3] for r in plain(first))
    given(spark, second, 2, path, "append")
    e.absorb(e.stream_of(spark, path), folder)
    assert sorted((r.id, r.keep_id, r.group_size) for r in e.judge(spark.read.parquet(path), folder).collect()) == sorted(r[:3] for r in plain(first + second))


def test_odd_rows(spark):
    rows = [(None, "a  b"), (None, "a b"), (4, "a  b"), (3, "ab"), (None, "only"), (2, "x"), (2, "x"), (2**62, "long" * 100_000), (1, "long " * 100_000)]
    got = found(e.deduplicate(spark, given(spark, rows, 2)))
    want = [(i, k, n, i == k, d) for i, k, n, _, d in plain(rows)]
    assert got == sorted(want, key=str)
    assert found(e.deduplicate(spark, given(spark, [], 1))) == []
