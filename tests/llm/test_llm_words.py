import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millwatch.llm import words as w

CLASSES = [(r"[^\x20\x09-\x0D]+", w.NOT_SPACE), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", w.ALNUM)]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("piece", [7, 64, 2 << 20])
@pytest.mark.parametrize("pattern,table", CLASSES)
def test_words_are_those_of_the_pattern(monkeypatch, piece, pattern, table):
    monkeypatch.setattr(w, "PIECE_BYTES", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choice("ab Aé\n,.9语 ") for _ in range(rng.choice([0, 1, 3, 30, 100]))) for _ in range(200)] + [None, "x" * 500]
    want = [re.findall(pattern, lower(t)) for t in texts]
    got = w.split(pa.array(texts), table, lower=True)
    assert list(got.first[1:] - got.first[:-1]) == [len(x) for x in want]
    seen = {}
    for word, h in zip([x for own in want for x in own], got.hash.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=6))
def test_any_text(texts):
    for pattern, table in CLASSES:
        got = w.split(pa.array(texts, pa.string()), table, lower=True)
        assert list(got.first[1:] - got.first[:-1]) == [len(re.findall(pattern, lower(t))) for t in texts]


def test_sliced_arrays():
    column = pa.array(["a b", None, "c", "d e f"])
    assert list(w.split(column.slice(2), w.ALNUM, True).first) == [0, 1, 4]
