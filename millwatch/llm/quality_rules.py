"""Weak supervision of quality rules.

Every rule votes for keeping a text (+1), against it (-1), or abstains (0).  Rules are narrow, so that many good
texts have a vote against them.  Expectation-maximisation over the counts of all vote patterns of the corpus (at
most 3 to the number of rules, whatever its size) estimates how often each rule's votes are right among good and
among bad texts, and a text's posterior probability of being good replaces the demand that all rules pass: votes of
rules that often err weigh little.  Two passes over the texts, no shuffle but that of the pattern counts.

Defined results: a null or empty text has no words, fails the base rules and isn't kept; texts of any length
are read whole; repeated rows give repeated rows; input columns named like an output column of ``judge`` are
replaced, those of ``keep`` stay; ties at the threshold are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as w
from .rows import append, chosen

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_letters", "n_digits", "n_lines", "n_closed_lines", "n_distinct_words", "n_marked_words")
_SPACE = " \t\n\v\f\r"


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text: BASE as words of `[^\\x20\\x09-\\x0D]+` define them, and MORE."""
    data, at = w.utf8(texts)
    n = len(at) - 1
    found = w.split(texts, w.NOT_SPACE, lower=False)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))  # an Arrow text has under 2^31 bytes
        return (total[at[1:]] - total[at[:-1]]).astype(np.int64)

    symbol = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
    letter_low = np.zeros(256, bool)
    letter_low[97:123] = True
    letter_up = np.zeros(256, bool)
    letter_up[65:91] = True
    out = {"n_words": np.diff(found.first).astype(np.int64), "word_chars": per_row(w.NOT_SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": per_row(symbol[data])}
    # words with a symbol: symbols of one row without white space between them are in one word
    place = np.flatnonzero(symbol[data])
    row, word = np.searchsorted(at, place, "right") - 1, np.searchsorted(np.flatnonzero(~w.NOT_SPACE[data]), place)
    new = np.ones(len(place), bool)
    new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
    out["n_marked_words"] = np.bincount(row[new], minlength=n).astype(np.int64)
    # words inside a three-word window that its text has twice or more
    window, first = w.windows(found, 3)
    row = found.row[first]
    order = np.lexsort((window, row))
    a, r = window[order], row[order]
    same = np.zeros(len(a), bool)
    same[1:] = (a[1:] == a[:-1]) & (r[1:] == r[:-1])
    again = same.copy()
    again[:-1] |= same[1:]
    hit = np.zeros(len(found.hash), bool)
    for j in range(3):
        hit[first[order[again]] + j] = True
    out["n_repeat_words"] = np.bincount(found.row[hit], minlength=n).astype(np.int64)
    # different words of a text
    order = np.lexsort((found.hash, found.row))
    h, r = found.hash[order], found.row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    out["n_distinct_words"] = np.bincount(r[new], minlength=n).astype(np.int64)
    upper, lower = per_row(letter_up[data]), per_row(letter_low[data])
    out |= {"n_upper": upper, "n_letters": upper + lower, "n_digits": per_row((data >= 48) & (data <= 57))}
    dup, lines, closed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if text:
            full = [x for x in text.split("\n") if x.strip(_SPACE)]
            dup[i], lines[i] = len(full) - len(set(full)), len(full)
            closed[i] = sum(x.rstrip(_SPACE)[-1] in '.!?:;"”»)…' for x in full)
    return out | {"n_dup_lines": dup, "n_lines": lines, "n_closed_lines": closed}


class Rule(NamedTuple):
    """Votes +1 where ``good``, -1 where ``bad`` of a share, else abstains."""

    name: str
    share: Callable[[dict[str, np.ndarray]], np.ndarray]
    good: tuple[float, float]
    bad: tuple[float, float]

    def vote(self, m: dict[str, np.ndarray]) -> np.ndarray:
        x = self.share(m)
        inside = lambda low, high: (x >= low) & (x <= high)
        return inside(*self.good).astype(np.int8) - (~inside(*self.bad)).astype(np.int8)


def _ratio(a: str, b: str) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    return lambda m: m[a] / np.maximum(m[b], 1)


#: Each votes for a text inside the first range, and against it outside the second.
RULES = (
    Rule("length", lambda m: m["n_words"].astype(float), (150, 1e12), (60, 1e12)),
    Rule("word_length", _ratio("word_chars", "n_words"), (4.3, 6.2), (3.8, 7)),
    Rule("symbols", _ratio("n_symbols", "n_words"), (0, 0.02), (0, 0.1)),
    Rule("marked_words", _ratio("n_marked_words", "n_words"), (0, 0.01), (0, 0.05)),
    Rule("repeated_words", _ratio("n_repeat_words", "n_words"), (0, 0.05), (0, 0.35)),
    Rule("repeated_lines", _ratio("n_dup_lines", "n_lines"), (0, 0), (0, 0.4)),
    Rule("capitals", _ratio("n_upper", "n_letters"), (0.004, 0.04), (0.001, 0.08)),
    Rule("digits", _ratio("n_digits", "word_chars"), (0, 0.01), (0, 0.04)),
    Rule("closed_lines", _ratio("n_closed_lines", "n_lines"), (0.97, 1), (0.9, 1)),
    Rule("distinct_words", lambda m: m["n_distinct_words"] / np.maximum(m["n_words"], 1) * np.maximum(1, np.log10(np.maximum(m["n_words"], 1) / 100)), (0.7, 9), (0.6, 9)),
    Rule("line_length", _ratio("n_words", "n_lines"), (15, 100), (8, 250)),
)

#: Imagined votes of each rule among good and among bad texts, a tenth and half of them against: they keep chances off
#: 0 and 1, and weigh nothing beside a corpus.
PRIOR_VOTES, PRIOR_GOOD, PRIOR_BAD = 20, 0.1, 0.5


class Model(NamedTuple):
    """Share of good texts, and for each rule the chance that its vote, if it has one, is against a good text, and
    against a bad one. The first is how often it errs on good texts, the second how often it is right on bad ones."""

    good: float
    against_good: tuple[float, ...]
    against_bad: tuple[float, ...]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes (one row each) is good. Abstaining says nothing."""
        good, bad = np.asarray(self.against_good), np.asarray(self.against_bad)
        odds = np.log(self.good / (1 - self.good)) + (votes == -1) @ np.log(good / bad) + (votes == 1) @ np.log((1 - good) / (1 - bad))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def rested(votes: np.ndarray, counts: np.ndarray, good: np.ndarray, rounds: int = 1000) -> tuple[Model, float]:
    """Expectation-maximisation from a first view of how likely each vote pattern is a good text's, until it rests, and the
    logarithm of the votes' likelihood, imagined ones included. Nothing bounds what it believes of a rule. Should it end
    with more rules voting against good texts than against bad ones, the classes have changed places, and are put back."""
    against, favour = (votes == -1).astype(float), (votes == 1).astype(float)
    for _ in range(rounds):
        chance = lambda weight, prior: (weight @ against + PRIOR_VOTES * prior) / (weight @ (against + favour) + PRIOR_VOTES)
        share = (counts @ good + PRIOR_VOTES / 2) / (counts.sum() + PRIOR_VOTES)
        model = Model(float(share), tuple(chance(counts * good, PRIOR_GOOD).tolist()), tuple(chance(counts * (1 - good), PRIOR_BAD).tolist()))
        new = model.posterior(votes)
        moved, good = np.abs(new - good).max(), new
        if moved < 1e-9:
            break
    a, b = np.asarray(model.against_good), np.asarray(model.against_bad)
    each = [np.log(share) + against @ np.log(x) + favour @ np.log(1 - x) for share, x in ((model.good, a), (1 - model.good, b))]
    imagined = sum((p * np.log(x) + (1 - p) * np.log(1 - x)).sum() for p, x in ((PRIOR_GOOD, a), (PRIOR_BAD, b)))
    if (a > b).sum() > len(RULES) / 2:
        model = Model(1 - model.good, model.against_bad, model.against_good)
    return model, float(counts @ np.logaddexp(*each) + PRIOR_VOTES * imagined)


def fit(votes: np.ndarray, counts: np.ndarray) -> Model:
    """The likeliest model of vote patterns (one row each) that ``counts`` texts share, of those that
    expectation-maximisation reaches from each rule's own view: that texts it votes against are bad, all others good."""
    if not len(votes):
        return Model(0.5, (PRIOR_GOOD,) * len(RULES), (PRIOR_BAD,) * len(RULES))
    found = [rested(votes, counts, np.where(votes[:, k] == -1, 0.05, 0.95)) for k in range(len(RULES))]
    return max(found, key=lambda x: x[1])[0]


def _votes(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([r.vote(m) for r in RULES], axis=1) if len(m["n_words"]) else np.zeros((0, len(RULES)), np.int8)


def _packed(votes: np.ndarray) -> np.ndarray:
    """A pattern as one number, three states to a rule."""
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(len(RULES), dtype=np.int64))


def learn(df: DataFrame, text: str = "text") -> Model:
    """The model of all texts of ``df``; only counts of vote patterns reach the driver."""
    field = [T.StructField("pattern", T.LongType())]
    patterns = append(df, text, field, lambda x: [_packed(_votes(measures(x)))], keep=[])
    found = patterns.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    votes = np.asarray([[r.pattern // 3**i % 3 - 1 for i in range(len(RULES))] for r in found], dtype=np.int8).reshape(-1, len(RULES))
    return fit(votes, np.asarray([r.n for r in found], dtype=float))


def _verdict(m: dict[str, np.ndarray], model: Model, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed (under 50 words, or over half of them in repeated three-word windows), posterior, kept."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    good = model.posterior(_votes(m))
    return failed, good, ~failed & (good >= threshold)


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None, model: Model | None = None, threshold: float = 0.5, counts: bool = True) -> DataFrame:
    """``df`` with the counts (if asked), base_failed, quality_posterior and kept (not base_failed, and a posterior of
    ``threshold`` or more) of each row."""
    model = model or learn(df, text)
    names = [*BASE, *MORE] if counts else []
    fields = [T.StructField(c, T.LongType()) for c in names] + [T.StructField("base_failed", T.BooleanType()), T.StructField("quality_posterior", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def run(texts: pa.Array) -> list:
        m = measures(texts)
        return [*[pa.array(m[c], pa.int64()) for c in names], *map(pa.array, _verdict(m, model, threshold))]

    return append(df, text, fields, run, keep)


def keep(df: DataFrame, text: str = "text", model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, as they are."""
    model, at = model or learn(df, text), df.columns.index(text)
    return chosen(df, text, lambda batch: _verdict(measures(batch.column(at)), model, threshold)[2])
