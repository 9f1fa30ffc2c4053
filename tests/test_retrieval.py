"""Searches over indices hold against scoring every row."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from millwatch.operators import retrieval, vectors
from millwatch.plans import linking

SF = "/root/testdata/sf0.01"


def plain_bm25(chunks, queries, k):
    out = {}
    for part in {c[2] for c in chunks}:
        own = [(c[0], (c[3] or "").lower().split()) for c in chunks if c[2] == part]
        mean, df = sum(len(w) for _, w in own) / len(own), Counter(t for _, w in own for t in set(w))
        for q in {q for q, _ in queries}:
            scores = defaultdict(float)
            for term in {t for x, t in queries if x == q}:
                for chunk, words in own:
                    if tf := words.count(term):
                        scores[chunk] += math.log(1 + (len(own) - df[term] + 0.5) / (df[term] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
            best = sorted(((-round(s, 9), c) for c, s in scores.items()))[:k]
            out |= {(q, part, n + 1): (c, -s) for n, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("block,seeds", [(1, 1), (4, 2), (1000, 4)])
def test_blocks_left_out_hold_none_of_the_best(spark, block, seeds):
    rng = random.Random(block)
    words = [f"w{i}" for i in range(30)]
    chunks = [(f"c{i:03d}", f"d{i // 3}", rng.choice("ab"), " ".join(rng.choices(words, weights=[30 - i for i in range(30)], k=rng.randint(0, 40)))) for i in range(150)]
    chunks += [("n1", None, "a", "w1 w1"), ("n2", "d0", "a", None), ("n3", "d1", "a", "")]
    queries = [("q1", "w1"), ("q1", "w29"), ("q1", "w29"), ("q2", "w0"), ("q3", "none"), ("q4", "w28"), ("q4", "w27"), ("q4", "w2")]
    index = retrieval.inverted(spark.createDataFrame(chunks, "chunk_id string, doc_id string, doc_type string, text string"), block_chunks=block)
    got = {(r.query, r.part, r.nth): (r.chunk_id, r.score) for r in retrieval.bm25(index, spark.createDataFrame(queries, "query string, term string"), 5, seeds).collect()}
    want = plain_bm25(chunks, queries, 5)
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=1e-8) for x in want)


def test_bounds_spare_blocks(spark, monkeypatch):
    read = []
    plain = retrieval.scores
    monkeypatch.setattr(retrieval, "scores", lambda index, asked, blocks: read.append(blocks.count()) or plain(index, asked, blocks))
    rng = random.Random(2)
    chunks = [(f"c{i}", f"d{i}", "a", " ".join(["rare"] * (i < 3) * 20 + [f"w{rng.randint(0, 9)}" for _ in range(30)] + ["rare"] * (i % 4 == 0))) for i in range(400)]
    index = retrieval.inverted(spark.createDataFrame(chunks, "chunk_id string, doc_id string, doc_type string, text string"), block_chunks=4)
    retrieval.bm25(index, spark.createDataFrame([("q", "rare")], "query string, term string"), 3).collect()
    assert sum(read) < index.bounds.where("term = 'rare'").count() / 2


def test_chunks_are_cut_once_and_listed_by_term(spark, monkeypatch):
    cut, kept = spark.sparkContext.accumulator(0), []

    def count(batches):
        for b in batches:
            cut.add(b.num_rows)
            yield b

    plain = retrieval.inverted
    monkeypatch.setattr(retrieval, "inverted", lambda *a, **b: kept.append(plain(*a, **b)) or kept[0])
    rows = [(f"c{i:03d}", "ab"[i % 2], "worn dull mist" if i % 5 else "mist", 3 + i) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_type string, text string, n_tokens long").coalesce(1)
    families = spark.createDataFrame([("tear",), ("none",)], "failure_family string")
    got = retrieval.retrieved_by_words(families, chunks.mapInArrow(count, chunks.schema), {"tear": ["tool_wear"], "none": []}, {"tool_wear": ["worn"]}, 2)
    assert {(r.failure_family, r.doc_type): r.chunk_ids for r in got.collect()} == {("tear", "a"): ["c002", "c004"], ("tear", "b"): ["c001", "c003"], ("none", "a"): ["c198"], ("none", "b"): ["c199"]}
    assert cut.value == 200
    assert kept[0].postings.count() == 2 * 3 and kept[0].dictionary.where("term = 'worn'").agg({"df": "sum"}).first()[0] == 160


def test_equal_scores_of_many_blocks_go_by_chunk_id(spark):
    rows = [(f"c{99 - i:02d}", "a", "w v") for i in range(100)] + [(f"b{i}", "a", "v") for i in range(30)] + [("c50", "a", "w v")]
    index = retrieval.inverted(spark.createDataFrame(rows, "chunk_id string, doc_type string, text string"), block_chunks=3)
    got = retrieval.bm25(index, spark.createDataFrame([("q", "w")], "query string, term string"), 60, 2)
    assert [r.chunk_id for r in sorted(got.collect(), key=lambda r: r.nth)] == [f"c{i:02d}" for i in range(60)]


def true_neighbours(rows, asked, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asked:
        close = np.round(x @ x[ids == q][0], 6)
        out[q] = [i for _, i in sorted((-c, i) for c, i in zip(close.tolist(), ids.tolist(), strict=True) if i != q)][:k]
    return out


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = true_neighbours(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = defaultdict(list)
    for r in sorted(linking.embedding_retrieval(spark, SF).collect(), key=lambda r: r.nth):
        got[r.vec_id].append(r.neighbour)
    found = sum(len(set(got[q]) & set(near)) for q, near in want.items()) / sum(map(len, want.values()))
    assert got.keys() == want.keys() and found >= 0.9


def test_exact_search_over_parted_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 40)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.standard_normal(8)).tolist()) for i in range(300)] + [(i, centres[0].tolist()) for i in range(300, 500)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0] * 7), (904, [None] + [1.0] * 7)]
    df = spark.createDataFrame(rows + odd, "vec_id long, v array<double>")
    index = vectors.indexed(df, "vec_id", "v", dims=8, k=5, recall=0.5)
    assert index.vectors.count() == 500
    got = defaultdict(list)
    for r in sorted(vectors.nearest(index, df.where("vec_id % 20 = 0"), "vec_id", "v", 5, exact=True).collect(), key=lambda r: r.nth):
        got[r.id].append(r.neighbour)
    assert got == true_neighbours(rows, [i for i, _ in rows if i % 20 == 0], 5)
    assert vectors.nearest(vectors.indexed(df.limit(0), "vec_id", "v", dims=8), df, "vec_id", "v").count() == 0
