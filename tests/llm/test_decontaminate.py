import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millwatch.llm import decontaminate as d
from millwatch.llm import entry
from millwatch.llm.fm_index import FMIndex, suffix_array
from millwatch.llm.storage import table

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for name, t in items:
        b = words(t)
        for i in range(max(1, len(b) - window + 1) if b else 0):
            p = b[i : i + window]
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    found.add(str(name))
    return len(w), sorted(hit), sorted(found)


@pytest.mark.parametrize("seed", range(30))
def test_index_finds_every_place(seed):
    rng = np.random.default_rng(seed)
    n, s = int(rng.integers(0, 80)), int(rng.integers(1, 6))
    x = rng.integers(1, s + 1, n)
    text = np.append(x, 0)
    assert suffix_array(text, s.bit_length()).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
    index = FMIndex(x, s, 4)
    length = rng.integers(1, 4, 20)
    phrases = np.zeros((20, 3), np.int64)
    for i in range(20):
        phrases[i, : length[i]] = rng.integers(1, s + 1, length[i])
    low, high = index.search(phrases, length)
    for i in range(20):
        want = [k for k in range(n - length[i] + 1) if (x[k : k + length[i]] == phrases[i, : length[i]]).all()]
        assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == want


@pytest.mark.parametrize("shard", [1, 5, 1000])
def test_matches_are_those_of_brute_force(shard):
    rng = random.Random(shard)
    for _ in range(60):
        voc = [rng.choice("abAé") * rng.randint(1, 2) for _ in range(4)]
        text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(voc) for _ in range(n))
        items = [(i, text(rng.randint(0, 6))) for i in range(4)]
        texts = [rng.choice([text(rng.randint(0, 25)), None, "", "zz " + text(9)]) for _ in range(6)]
        found, covered, names = d.matches(pa.array(texts, pa.string()), d.block_of(items, 3), shard)
        for r, t in enumerate(texts):
            own = covered[found.first[r] : found.first[r + 1]]
            assert (len(own), np.flatnonzero(own).tolist(), sorted(names[r])) == brute(t, items, 3)


def test_op2(spark):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").limit(40).collect()}
    got = {r.doc_id: r for r in entry.op2_decontamination(spark, SF).collect()}
    for name, t in texts.items():
        n, hit, found = brute(t, items, 10)
        r = got[name]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_blocks_of_the_benchmark_add_up(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    one = d.digest(d.find(docs, bench)).orderBy("doc_id").collect()
    assert one == d.digest(d.find(docs, bench, block_words=50, shard_words=300)).orderBy("doc_id").collect()


def test_edges(spark):
    bench = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "A, B"), (5, "x " * 12)], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "c a b c", "q"), (3, "c a b c", "q"), (None, "x " * 30_000, "q")], "doc_id long, text string, N_WORDS string")
    found = d.digest(d.find(docs, bench)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in found] == [(None, 30_000, 30_000, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 4, 2, 2), (3, 4, 2, 2)]
    assert d.find(docs, bench.limit(0)).where("size(item_ids) > 0").count() == 0
    assert d.find(docs.limit(0), bench).count() == 0


def test_removal_leaves_no_window(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    clean = d.remove(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert d.digest(d.find(clean, bench)).where("contaminated").count() == 0
    before = {r.doc_id for r in d.digest(d.find(docs, bench)).where("contaminated").collect()}
    same = {r.doc_id: r.text for r in docs.collect()}
    assert before and all(same[r.doc_id] == r.text for r in clean.collect() if r.doc_id not in before)
    assert d.without("Say: one two, three!", [(1, 3)]) == "Say: …, three!"
