"""Token counts, packing and quality rules against the libraries and plain code."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millwatch.llm import entry, packing, quality_rules, token_count
from millwatch.llm.storage import table

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = st.lists(st.sampled_from([*"aAbéÉ'st 'd \n\t  12²½ⅣΣσςİß語😀_-#!<|>", "<|endoftext|>", "<|startoftext|>", "ﬁ", "가", "\x85", "\x1c"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def word_counts():
    return token_count.WordCounts(*token_count.read_vocabulary(WORD)), Tokenizer.from_file(WORD)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_counts_are_the_librarys(word_counts, text):
    counts, library = word_counts
    assert sum(map(counts.__getitem__, text.replace("\n", " ").split(" "))) == len(library.encode(text, add_special_tokens=False).ids)


def test_a_full_table_keeps_counting(word_counts, monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_WORDS", 3)
    counts = token_count.WordCounts(*token_count.read_vocabulary(WORD))
    for word in ["hello", "there", "general", "kenobi", "hello", "there"] * 2:
        assert counts[word] == word_counts[0][word]
        assert len(counts) <= 3


def test_op3(spark):
    library = Tokenizer.from_file(WORD)
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in entry.op3_token_counts(spark, SF).collect():
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)


EDGES = [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (3, "one", "x"), (4, "long words here " * 20_000, "x"), (None, "null id", "x")]


def edge_rows(spark, clash):
    return spark.createDataFrame(EDGES, f"doc_id long, text string, {clash} string")


def test_count_edges(spark):
    out = token_count.count_tokens(edge_rows(spark, "N_Tokens"), WORD)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert [(r.doc_id, r.n_tokens) for r in out.orderBy("doc_id").collect()][1:5] == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert token_count.count_tokens(edge_rows(spark, "x").limit(0), WORD).count() == 0


@pytest.fixture(scope="module")
def encoder():
    ids = packing.TextIds(open(BYTE, encoding="utf-8").read())
    assert ids.fast is not None
    return ids, Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_ids_are_the_librarys(encoder, text):
    assert np.frombuffer(encoder[0](text), "<u4").tolist() == encoder[1].encode(text, add_special_tokens=False).ids


def checked_packing(pieces, texts, capacity=2048):
    """Every id lies in one piece, sequences are full without gaps; returns the share of padding."""
    library = Tokenizer.from_file(BYTE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == texts.keys()
    total = 0
    for name, own in by_doc.items():
        ids = np.asarray(library.encode(texts[name] or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids) for p in own)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) <= capacity
    return 1 - total / (len(by_sequence) * capacity)


def test_op10(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert checked_packing(entry.op10_packing(spark, SF).collect(), texts) < 0.02


def test_packing_edges(spark):
    rows = edge_rows(spark, "start").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    out = packing.pack(rows, BYTE)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    pieces = out.collect()
    checked_packing(pieces, {d: t for d, t, _ in EDGES if d is not None})
    assert all(len(p.ids) == 4 * p.length for p in pieces)
    assert packing.pack(edge_rows(spark, "x").limit(0), BYTE).count() == 0
    twice = packing.pack(spark.createDataFrame([(3, "one"), (3, "one")], "doc_id long, text string"), BYTE).collect()
    assert sum(p.length for p in twice) == 4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_harmonic_bins(lengths):
    packer, want = packing.Packer(0), Counter()
    for k, n in enumerate(lengths):
        start = 0
        for x in packing.cuts(n):
            packer.add(k, start, x)
            start += x
        want[k] = n
        assert start == n
    packer.finish()
    got, used = Counter(), Counter()
    for row, _, length, sequence, offset in packer.done:
        got[row] += length
        assert used[sequence] == offset
        used[sequence] += length
    assert got == want and max(used.values(), default=0) <= 2048


SPACE = r"[^\x20\x09-\x0D]+"


def base_counts(text):
    words = re.findall(SPACE, text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#|\n\t语", max_size=60)), max_size=5))
def test_base_counts(texts):
    m = quality_rules.measures(pa.array(texts, pa.string()))
    assert list(zip(*[m[c].tolist() for c in quality_rules.BASE], strict=True)) == [base_counts(t) for t in texts]


def test_op8(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in entry.op8_quality_rules(spark, SF).collect():
        want = base_counts(texts[r.doc_id])
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert tuple(r[c] for c in quality_rules.BASE) == want and r.base_failed == failed
        assert r.kept == (not failed and r.quality_posterior >= 0.5)


def test_verdicts_do_not_rest_on_where_learning_starts(spark):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    votes, counts = np.unique(quality_rules._votes(quality_rules.measures(pa.array(texts))), axis=0, return_counts=True)
    want, rng = quality_rules.fit(votes, counts.astype(float)).posterior(votes), np.random.default_rng(1)
    starts = [np.where((votes == -1).sum(axis=1) < n, 0.95, 0.05) for n in (1, 2, 3)] + [rng.uniform(0.05, 0.95, len(votes)) for _ in range(6)]
    found = [quality_rules.rested(votes, counts.astype(float), s) for s in starts]
    best = max(likelihood for _, likelihood in found)
    likeliest = [m for m, likelihood in found if likelihood > best - 1e-3]
    assert len(likeliest) >= 5 and all(np.abs(m.posterior(votes) - want).max() < 1e-4 for m in likeliest)


def test_rules_part_good_from_bad(spark):
    rows = quality_rules.judge(table(spark, "/root/testdata/sf0.01", "documents")).join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("NOT base_failed")
    got = Counter((r.quality, r.kept) for r in rows.collect())
    assert got[1, True] > 0.99 * (got[1, True] + got[1, False])
    assert got[0, False] > 0.9 * (got[0, True] + got[0, False])


def test_rule_edges(spark):
    out = quality_rules.judge(edge_rows(spark, "KEPT"))
    assert "KEPT" not in out.columns
    assert {r.doc_id for r in out.where("base_failed").collect()} == {None, 1, 2, 3, 4}
    assert quality_rules.judge(edge_rows(spark, "x").limit(0)).count() == 0


def test_em_recovers_accuracies():
    """Rules that err a lot, that hardly tell, and that abstain: how often each is right comes out."""
    rng = np.random.default_rng(0)
    n, rules = 60_000, len(quality_rules.RULES)
    errs, right = rng.uniform(0.01, 0.25, rules), rng.uniform(0.3, 0.9, rules)
    errs[0], right[0] = 0.3, 0.35
    good = rng.random(n) < 0.7
    votes = np.where(rng.random((n, rules)) < np.where(good[:, None], errs, right), -1, 1)
    votes = np.where(rng.random((n, rules)) < 0.2, 0, votes).astype(np.int8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(patterns, counts.astype(float))
    assert abs(model.good - 0.7) < 0.02
    assert np.abs(np.asarray(model.against_good) - errs).max() < 0.02
    assert np.abs(np.asarray(model.against_bad) - right).max() < 0.03
    by_model, all_pass = model.posterior(votes) >= 0.5, (votes >= 0).all(axis=1)
    assert (by_model == good).mean() > 0.95 and (all_pass == good).mean() < 0.7


def plain_verdicts(votes):
    """The posterior of each row of votes, by expectation-maximisation over rows, one at a time."""
    start = [0.95 if v.count(-1) < 2 else 0.05 for v in votes]
    for _ in range(1000):
        share = (sum(start) + 10) / (len(votes) + 20)
        chance = []
        for weight, prior in ((start, 0.1), ([1 - g for g in start], 0.5)):
            chance.append([(sum(g for g, v in zip(weight, votes, strict=True) if v[k] == -1) + 20 * prior) / (sum(g for g, v in zip(weight, votes, strict=True) if v[k]) + 20) for k in range(len(votes[0]))])
        now = []
        for v in votes:
            good, bad = share, 1 - share
            for k, x in enumerate(v):
                if x:
                    good *= chance[0][k] if x < 0 else 1 - chance[0][k]
                    bad *= chance[1][k] if x < 0 else 1 - chance[1][k]
            now.append(good / (good + bad))
        moved, start = max(abs(a - b) for a, b in zip(start, now, strict=True)), now
        if moved < 1e-9:
            break
    return start


def plain_votes(text):
    words = re.findall(SPACE, text or "")
    n, lines = len(words), [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    chars, symbols, dup, repeated = base_counts(text)[1:]
    letters, upper = len(re.findall("[A-Za-z]", text or "")), len(re.findall("[A-Z]", text or ""))
    many, rows = max(n, 1), max(len(lines), 1)
    shares = [n, chars / many, symbols / many, sum(bool(re.search(r"[#*$%&|<>]", x)) for x in words) / many, repeated / many, dup / rows, upper / max(letters, 1), len(re.findall("[0-9]", text or "")) / max(chars, 1)]
    shares += [sum(x.rstrip(" \t\v\f\r")[-1] in '.!?:;"”»)…' for x in lines) / rows, len(set(words)) / many * max(1, np.log10(many / 100)), n / rows]
    return [int(r.good[0] <= x <= r.good[1]) - int(not r.bad[0] <= x <= r.bad[1]) for r, x in zip(quality_rules.RULES, shares, strict=True)]


def test_op8_is_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    names = sorted(texts)
    want = dict(zip(names, plain_verdicts([plain_votes(texts[k]) for k in names]), strict=True))
    for r in entry.op8_quality_rules(spark, SF).collect():
        assert r.quality_posterior == pytest.approx(want[r.doc_id], abs=1e-6)
        assert r.kept == (not r.base_failed and want[r.doc_id] >= 0.5)


def test_verdicts_part_from_all_must_pass(spark):
    """Where rules disagree the posterior decides, and labels say that it is right."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality_rules.judge(docs, keep=["doc_id"]).join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("NOT base_failed").collect()
    apart = [r for r in rows if r.kept != (min(plain_votes(texts[r.doc_id])) >= 0)]
    assert len(apart) > 5 and sum(r.kept == bool(r.quality) for r in apart) > 0.9 * len(apart)
