import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millwatch.llm import entry
from millwatch.llm import ngram_join as g
from millwatch.llm.storage import table


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets, up = [(i, shingles(t)) for i, t in docs], {i: i for i, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(a), top(i)) for i, a in sets}


def grouped(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in g.classes(df, **options).collect()}


@pytest.mark.parametrize("seed,block", [(0, 512), (1, 3), (2, 8)])
def test_groups_are_those_of_brute_force(spark, seed, block):
    rng, docs = random.Random(seed), []
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(rng.choice([3, 12, 40, 90]))] for _ in range(6)]
    for i in range(140):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice("xyz") + str(rng.randint(0, 3))
        if rng.random() < 0.2:
            words += base[0][: rng.randint(1, 30)]
        docs.append((i * 7 + 3, rng.choice([" ", " \n"]).join(words)))
    docs += [(5001, None), (5002, ""), (5003, "one"), (5004, "One")]
    assert grouped(spark, docs, block_texts=block) == brute(docs)


def test_frequent_shingles_go_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(g.Order, "of", classmethod(lambda cls, counts: cls(counts, 1.0, 2.0, 3)))
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(30))
    docs = [(i, common + " " + " ".join(rng.choice("abcdef") + str(i // 3) for _ in range(rng.choice([2, 3, 60])))) for i in range(60)]
    assert grouped(spark, docs) == brute(docs)


def test_op7(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in entry.op7_ngram_join(spark, "/root/testdata/sf0.001").collect()} == brute(docs)


def test_edges(spark):
    assert grouped(spark, []) == {}
    rows = spark.createDataFrame([(2, "a b c d e f", "x"), (2, "a b c d e f", "x"), (None, "a b c d e f", "x"), (1, "A b c d e f", "x"), (9, "word " * 40_000, "x")], "doc_id long, text string, component_id string")
    assert sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in g.classes(rows).collect())) == [(-1, 2, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (9, 1, 9)]


SETS = st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=1, max_size=12)


def similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


@settings(max_examples=300, deadline=None)
@given(SETS, st.sets(st.integers(0, 25), min_size=1, max_size=20))
def test_trie_finds_all_similar_sets(sets, asked):
    trie = g.Trie()
    for k, s in enumerate(sets):
        trie.add(np.asarray(sorted(s)), k)
    assert sorted(trie.similar(np.asarray(sorted(asked)))) == [k for k, s in enumerate(sets) if similar(s, asked)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 400), min_size=1, max_size=150), min_size=2, max_size=6))
def test_bitmaps_lose_no_similar_set(sets):
    sets += [sets[0] | {999}]
    own = [g.w.mix(np.asarray(sorted(s), np.uint64)) for s in sets]
    ok = g.hopeful([len(s) for s in sets], [g.bitmap(x) for x in own])
    for i, a in enumerate(sets):
        assert ok[i] or not any(similar(a, b) for j, b in enumerate(sets) if j != i)


def test_components(spark):
    links = [(1, 2), (3, 2), (4, 3), (10, 11), (12, 10), (5, 4)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in g.components(df).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 11: 10, 12: 10} | {101 + i: 100 for i in range(40)}
    assert g.components(df.limit(0)).count() == 0
