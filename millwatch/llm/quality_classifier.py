"""Quality and toxicity of documents by co-training two views.

The text view sees words and the byte n-grams inside them.  The page view sees metadata: source, language, length,
and the layout of the page (lines, symbols, capitals, digits, how varied its words are), but no word.  For each target
both start from labelled rows.  Over some rounds every view labels all unlabelled documents that it is sure of, and
the other view learns from them: what a feature says is worked out from class counts over labelled rows and the
other view's labels.  Held-out labelled rows then calibrate the two views and weigh them against each other in one
logistic model, tell for each target after which round it fits them best, and end the rounds when one betters no
target.  A round is one pass over the documents that shuffles only sums of a fixed size, and all documents are
scored where they lie.

What is bounded: ``MOST_LABELLED`` labelled rows, those with the least hashes of doc_id.  The driver gets sums of a
fixed size, and of each labelled row those of its features that tell classes apart, of which there are at most
``MOST_TELLING`` a target.  Unlabelled documents all take part, whatever their number.

Defined results: a null or empty text has no text features and is judged by its metadata and the base rate; a
null source, language or length is a value of its own; a target with fewer than ``LEAST_LABELS`` rows of one of
its classes isn't learned and its probability is that of the other class (1 good, 0 toxic without labels);
several labels of one doc_id: the worse counts; of several rows of a labelled doc_id the one whose columns have the
least hash is learned from; repeated rows
give repeated rows; input columns named like an output column of ``classify`` are replaced, those of ``keep`` stay; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as w
from .rows import chosen, freed
from .storage import saved

MOST_LABELLED, MOST_TELLING, LEAST_LABELS = 6000, 4096, 20
#: Bits of a text feature's number, bytes of a gram, and buckets of page features, of which LAYOUT are of layout.
BITS, GRAM, PAGE, LAYOUT = 18, 5, 1024, 256
ROUNDS, SURE = 2, 0.99
#: How many standard deviations, and by which factor, a feature's share of a class must be off to count.
TELLING, FACTOR = 4.5, 2.0
#: Text worked on at once: a byte takes some 20 bytes of memory.
BATCH_BYTES = 2 << 20
#: Text features whose sums travel together.
SLICE = 1 << 13
TARGETS = ("quality", "toxic")
_GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)


class Rows(NamedTuple):
    """Feature numbers of row r: ``features[first[r]:first[r + 1]]``."""

    features: np.ndarray
    first: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.first)[rows]
        first = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.first[rows] - first[:-1], size) + np.arange(first[-1])
        return Rows(self.features[at], first)

    def score(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(weights[self.features], dtype=np.float64)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def counts(self, of_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.features, weights=np.repeat(of_row, np.diff(self.first)), minlength=size)


class Vocabulary(NamedTuple):
    """Texts as the words of a batch: features of each different word, and which rows have which words (each once)."""

    features: Rows
    row: np.ndarray
    word: np.ndarray
    n: int

    def score(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.features.score(weights)[self.word], minlength=self.n)

    def counts(self, of_row: np.ndarray, size: int) -> np.ndarray:
        of_word = np.bincount(self.word, weights=of_row[self.row], minlength=len(self.features.first) - 1)
        return self.features.counts(of_word, size)

    def only(self, telling: np.ndarray) -> Rows:
        """The telling features of each row, each as often as different words of the row have it."""
        keep = telling[self.features.features]
        first = np.concatenate(([0], np.cumsum(keep)))[self.features.first]
        few = Rows(self.features.features[keep], first).take(self.word)
        size = np.bincount(self.row, weights=np.diff(few.first), minlength=self.n).astype(np.int64)
        return Rows(few.features, np.concatenate(([0], np.cumsum(size))))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def text_view(texts: pa.Array) -> tuple[Vocabulary, w.Words]:
    data, _ = w.utf8(texts)
    found = w.split(texts, w.NOT_SPACE, lower=True)
    mask, n = np.uint64((1 << BITS) - 1), len(texts)
    hashes, at, word = np.unique(found.hash, return_index=True, return_inverse=True)
    size = found.size[at].astype(np.int64)
    ends = np.cumsum(size)
    own = np.repeat(np.arange(len(hashes)), size)
    low = w.LOWER[data[np.arange(len(own)) + np.repeat(found.start[at] - (ends - size), size)]]
    keys = [np.arange(len(hashes), dtype=np.int64) << BITS | (hashes & mask).astype(np.int64)]
    if len(low) >= GRAM:
        value = np.zeros(len(low) - GRAM + 1, np.uint64)
        for j in range(GRAM):
            value = (value + low[j : len(low) - GRAM + 1 + j]) * _GRAM_BASE
        place = np.flatnonzero(own[: len(value)] == own[GRAM - 1 :])
        keys.append(own[place] << BITS | (w.mix(value[place]) & mask).astype(np.int64))
    key = _distinct(np.concatenate(keys))
    features = Rows((key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(hashes) + 1)))
    many = max(1, len(hashes))
    pair = _distinct(found.row.astype(np.int64) * many + word)
    return Vocabulary(features, pair // many, pair % many, n), found


def _bucket(*parts: object) -> int:
    name = "\x1f".join("\x00" if p is None else str(p) for p in parts)
    return LAYOUT + zlib.crc32(name.encode(errors="surrogatepass")) % (PAGE - LAYOUT)


def page_view(texts: pa.Array, vocabulary: Vocabulary, found: w.Words, source: list, lang: list, n_chars: list) -> Rows:
    """Buckets of source, language, length, source with language, and layout."""
    data, at = w.utf8(texts)
    n = vocabulary.n

    def per_row(of: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(of, dtype=np.int32)))
        return (total[at[1:]] - total[at[:-1]]).astype(np.float64)

    def among(chars: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[np.frombuffer(chars, np.uint8)] = True
        return table[data]

    words = np.diff(found.first).astype(np.float64)
    many = np.maximum(1, words)
    upper, lower = per_row((data >= 65) & (data <= 90)), per_row((data >= 97) & (data <= 122))
    # where lines end: before a line feed, or at the text's end
    feed = data == 10
    last = np.append(feed[1:], True)
    last[at[1:-1][at[1:-1] > 0] - 1] = True
    lines = np.maximum(1, per_row(last & ~feed))
    log = lambda x: np.log2(x + 1)
    shares = [
        4 * log(100 * per_row(among(b"#*$%&|<>")) / many), 20 * upper / np.maximum(1, upper + lower), 4 * log(100 * per_row((data >= 48) & (data <= 57)) / many), 2 * np.bincount(found.row, weights=found.size, minlength=n) / many, log(words),
        10 * per_row(last & among(b".!?:;\"")) / lines, 10 * np.bincount(vocabulary.row, minlength=n) / many, 2 * log(words / lines), 20 * per_row(among(b" \n\t")) / np.maximum(1, np.diff(at)),
    ]
    layout = np.stack([28 * k + np.clip(x, 0, 27).astype(np.int64) for k, x in enumerate(shares)], axis=1)
    seen: dict[tuple, list[int]] = {}
    out = []
    for r, (s, g, c) in enumerate(zip(source, lang, n_chars, strict=True)):
        key = (s, g, None if c is None else int(max(0, c)).bit_length())
        if key not in seen:
            seen[key] = [_bucket("s", s), _bucket("g", g), _bucket("c", key[2]), _bucket("sg", s, g)]
        out.append(seen[key] + layout[r].tolist())
    return Rows(np.asarray(out, np.int32).reshape(-1), np.arange(n + 1) * (4 + len(shares)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear(NamedTuple):
    """A view's weights, and slope and constant that make its score a probability by itself."""

    weights: np.ndarray
    alone: np.ndarray

    def probability(self, score: np.ndarray) -> np.ndarray:
        return _sigmoid(score * self.alone[0] + self.alone[1])


def ratios(one: np.ndarray, two: np.ndarray, most: int = MOST_TELLING) -> np.ndarray:
    """What each feature says for class one against two, by its counts in both; 0 for those that tell nothing, and
    for all but the ``most`` that tell classes apart beyond chance by the widest margin."""
    total, seen = one.sum() + two.sum(), np.maximum(one + two, 1e-9)
    share = float(np.clip(one.sum() / max(1.0, total), 1e-6, 1 - 1e-6))
    ratio = np.log((one + 0.5) / (one.sum() + 1)) - np.log((two + 0.5) / (two.sum() + 1))
    chance = np.abs(one - seen * share) / np.sqrt(seen * share * (1 - share))
    chance[(chance < TELLING) | (np.abs(ratio) < np.log(FACTOR))] = 0
    if np.count_nonzero(chance) > most:
        chance[np.argsort(-chance, kind="stable")[most:]] = 0
    return np.where(chance > 0, ratio * np.minimum(1, seen / 10), 0.0)


def calibrate(scores: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Weights of scores (one column each), and a constant, of a logistic model; Newton steps."""
    x = np.column_stack([scores, np.ones(len(y))])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ b)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(b)), x.T @ (y - p) - decay * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    b[:-1] = np.maximum(0, b[:-1])  # a view never speaks against itself
    return b


def fit_linear(rows: Rows, y: np.ndarray, held: np.ndarray, ratio: np.ndarray, steps: int = 80, decay: float = 0.02) -> Linear:
    """Logistic regression over features scaled by ``ratio``: one scale for all, which also serves features that no
    labelled row has, and corrections to it by Adam; the rows of ``held`` make scores probabilities."""
    train = rows.take(np.flatnonzero(~held))
    told = y[~held]
    scale, bias = calibrate(train.score(ratio)[:, None], told)
    v, n, size = np.zeros(len(ratio)), max(1, len(told)), len(ratio)
    m, s, mb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        error = (_sigmoid(train.score((scale + v) * ratio) + bias) - told) / n
        g, gb = train.counts(error, size) * ratio + decay * v / n, float(error.sum())
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.05 / (1 - 0.9**t)
        v, bias = v - rate * m / (np.sqrt(s / (1 - 0.99**t)) + 1e-9), bias - rate * mb / (np.sqrt(sb / (1 - 0.99**t)) + 1e-9)
    weights = ((scale + v) * ratio).astype(np.float32)
    return Linear(weights, calibrate(rows.take(np.flatnonzero(held)).score(weights)[:, None], y[held]))


class Target(NamedTuple):
    """Both views of a target and how they are weighed; without views, a constant probability."""

    text: Linear | None
    page: Linear | None
    weigh: np.ndarray
    constant: float

    def probability(self, text: Vocabulary | Rows, page: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By both views, by text alone, by page alone."""
        if self.text is None:
            return (np.full(len(page.first) - 1, self.constant),) * 3
        a, b = text.score(self.text.weights), page.score(self.page.weights)
        return _sigmoid(self.weigh[0] * a + self.weigh[1] * b + self.weigh[2]), self.text.probability(a), self.page.probability(b)


class Model(NamedTuple):
    quality: Target
    toxic: Target


class Labelled(NamedTuple):
    """Features of labelled rows that count, their labels (NaN: none) by target, and which are held out."""

    text: Rows
    page: Rows
    labels: dict[str, np.ndarray]
    held: np.ndarray


def fitted(rows: Labelled, name: str, text: np.ndarray, page: np.ndarray) -> Target:
    """A target's views by what features say (``text`` and ``page``: ratios)."""
    y = rows.labels[name]
    known = np.flatnonzero(~np.isnan(y))
    y, held = y[known], rows.held[known]
    if min(y.sum(), (1 - y).sum()) < LEAST_LABELS or not (0 < y[held].sum() < held.sum()):
        usual = {"quality": 1.0, "toxic": 0.0}[name]
        return Target(None, None, np.zeros(3), float(y.mean() >= 0.5) if len(y) else usual)
    a, b = rows.text.take(known), rows.page.take(known)
    by_text, by_page = fit_linear(a, y, held, text), fit_linear(b, y, held, page)
    scores = np.column_stack([a.score(by_text.weights), b.score(by_page.weights)])
    return Target(by_text, by_page, calibrate(scores[held], y[held]), np.nan)


COLUMNS = ("doc_id", "text", "source", "lang", "n_chars")


def _views(batch: pa.RecordBatch, at: dict[str, int]) -> tuple[Vocabulary, Rows]:
    texts = batch.column(at["text"])
    text, found = text_view(texts)
    return text, page_view(texts, text, found, *[batch.column(at[c]).to_pylist() for c in ("source", "lang", "n_chars")])


def class_counts(rows: DataFrame, model: Model | None = None, known: np.ndarray | None = None, sure: float = SURE) -> tuple[dict, dict]:
    """Class counts of text and of page features over ``rows``: {target: counts of (class one, class zero)}.

    Without a model, by the labels in ``rows``. With one, by the labels of the other view, where it is sure; the
    doc_ids of ``known`` are left out. Tasks sum their rows, Spark sums the tasks' slices, the driver gets the sums.
    """
    context, used = rows.sparkSession.sparkContext, [*COLUMNS, *([] if model else TARGETS)]
    at = {c: i for i, c in enumerate(used)}
    shared = context.broadcast((model, known))  # a fixed number of weights; ids of labelled rows
    names, types = ["view", "slice", "counts"], [pa.string(), pa.int32(), pa.binary()]
    sizes = {"text": 1 << BITS, "page": PAGE}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {v: np.zeros((2 * len(TARGETS), size), np.int64) for v, size in sizes.items()}
        model, known = shared.value
        for big in batches:
            for batch in w.small_batches(big, at["text"], BATCH_BYTES):
                views = dict(zip(("text", "page"), _views(batch, at), strict=True))
                if model is None:
                    told = {v: [np.asarray(batch.column(at[t]).to_pylist(), float) for t in TARGETS] for v in views}
                else:
                    there = np.isin(np.asarray([-1 if x is None else x for x in batch.column(0).to_pylist()], np.int64), known)
                    told = {"text": [], "page": []}
                    for target in model:
                        _, by_text, by_page = target.probability(views["text"], views["page"])
                        for v, p in (("text", by_page), ("page", by_text)):
                            told[v].append(np.where((target.text is None) | there | ((p < sure) & (p > 1 - sure)), np.nan, p > 0.5))
                for v, view in views.items():
                    for k, y in enumerate(told[v]):
                        for c in (1, 0):
                            if (y == c).any():
                                total[v][2 * k + 1 - c] += view.counts((y == c).astype(float), sizes[v]).astype(np.int64)
        for v, sums in total.items():
            for k in range(0, sizes[v], SLICE):
                part = np.ascontiguousarray(sums[:, k : k + SLICE])
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((v, k // SLICE, part.tobytes()), types, strict=True)], names=names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for v, k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                total[v, k] = total.get((v, k), 0) + np.frombuffer(part.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([x[0] for x in total], [x[1] for x in total], [x.tobytes() for x in total.values()]), types, strict=True)], names=names)

    schema = "view string, slice int, counts binary"
    sums = {v: np.zeros((2 * len(TARGETS), size)) for v, size in sizes.items()}
    parts = rows.select(*used).mapInArrow(freed(summed), schema).repartition("view", "slice").mapInArrow(freed(added), schema)
    for r in parts.collect():
        own = np.frombuffer(r.counts, np.int64).reshape(2 * len(TARGETS), -1)
        sums[r.view][:, r.slice * SLICE : r.slice * SLICE + own.shape[1]] = own
    return tuple({t: sums[v][2 * k : 2 * k + 2] for k, t in enumerate(TARGETS)} for v in ("text", "page"))


def labelled_rows(sample: DataFrame, telling: np.ndarray) -> Labelled:
    """Of each row of the sample, all page features and the text features that are ``telling``."""
    used = [*COLUMNS, *TARGETS, "held"]
    at = {c: i for i, c in enumerate(used)}
    shared = sample.sparkSession.sparkContext.broadcast(telling)  # a mark for each feature
    schema = "doc_id long, quality int, toxic int, held boolean, text binary, page binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in w.small_batches(big, at["text"], BATCH_BYTES):
                text, page = _views(batch, at)
                found = [[x.features[a:b].astype(np.int32).tobytes() for a, b in zip(x.first, x.first[1:], strict=False)] for x in (text.only(shared.value), page)]
                yield pa.RecordBatch.from_arrays([batch.column(at[c]) for c in ("doc_id", *TARGETS, "held")] + [pa.array(x, pa.binary()) for x in found], names=["doc_id", *TARGETS, "held", "text", "page"])

    rows = sorted(sample.select(*used).mapInArrow(freed(run), schema).collect(), key=lambda r: (r.doc_id, r.page, r.text))

    def view(name: str) -> Rows:
        parts = [np.frombuffer(r[name], np.int32) for r in rows]
        return Rows(np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64))

    return Labelled(view("text"), view("page"), {t: np.asarray([np.nan if r[t] is None else float(r[t] > 0) for r in rows]) for t in TARGETS}, np.asarray([r.held for r in rows], bool))


def _least(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows with the least hashes of doc_id. Of many rows only those under a hash that four times as
    many are expected to stay under are sorted at all."""
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    share = min(1.0, 4 * most / max(1, rows.count()))
    return rows.where(F.shiftright(order, 32) < int((2 * share - 1) * (1 << 31))).orderBy(order, "doc_id").limit(most)


def sampled(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> tuple[DataFrame, np.ndarray]:
    """The labelled sample (COLUMNS, quality, toxic, held; a fifth is held out by doc_id), and its doc_ids."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    told = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = _least(told.join(ids, "doc_id", "left_semi"), most_labelled).collect()
    rows = docs.sparkSession.createDataFrame([(r.doc_id, r.quality, r.toxic) for r in known], "doc_id long, quality int, toxic int")
    # at most ``most_labelled`` rows, small enough to be sent to every worker; a doc_id that many rows share counts once
    met = docs.select(*COLUMNS).join(F.broadcast(rows), "doc_id")
    every = [c for c in met.columns if c != "doc_id"]
    one = F.min_by(F.struct(*every), F.struct(F.xxhash64(*COLUMNS), *COLUMNS[2:], "text"))
    sample = met.groupBy("doc_id").agg(one.alias("row")).select("doc_id", "row.*").select(*met.columns)
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(5)) == 0
    return saved(sample.withColumn("held", held), "classifier-sample"), np.asarray([r.doc_id for r in known], np.int64)


def held_loss(rows: Labelled, name: str, target: Target) -> float:
    """How far a target's probabilities are from the held-out labels: the mean of minus their logarithm."""
    at = np.flatnonzero(rows.held & ~np.isnan(rows.labels[name]))
    p = np.clip(target.probability(rows.text.take(at), rows.page.take(at))[0], 1e-12, 1 - 1e-12)
    y = rows.labels[name][at]
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))) if len(at) else 0.0


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """Both targets' views after up to ``rounds`` of exchange over all of ``docs``: of each target those of the round that
    fits the held-out rows best."""
    sample, known = sampled(docs, labels, most_labelled)
    text, page = own_text, own_page = class_counts(sample.where("NOT held"))
    best, least = {}, dict.fromkeys(TARGETS, np.inf)
    for turn in range(rounds + 1):
        says = {t: (ratios(*text[t]), ratios(*page[t])) for t in TARGETS}
        rows = labelled_rows(sample, np.any([a != 0 for a, _ in says.values()], axis=0))
        model = Model(*[fitted(rows, t, *says[t]) for t in TARGETS])
        losses = {t: held_loss(rows, t, target) for t, target in zip(TARGETS, model, strict=True)}
        better = [t for t in TARGETS if losses[t] < least[t]]
        for t in better:
            best[t], least[t] = getattr(model, t), losses[t]
        if turn == rounds or not better or all(target.text is None for target in model):
            break
        more_text, more_page = class_counts(docs, model, known, sure)
        text, page = ({t: own[t] + more[t] for t in TARGETS} for own, more in ((own_text, more_text), (own_page, more_page)))
    return Model(*[best[t] for t in TARGETS])


FIELDS = [T.StructField(c, T.DoubleType()) for c in ("text_quality", "page_quality", "quality_prob", "toxic_prob")] + [T.StructField("kept", T.BooleanType())]


def judged(batch: pa.RecordBatch, at: dict[str, int], model: Model, threshold: float, toxic_from: float) -> list[np.ndarray]:
    """The columns FIELDS."""
    text, page = _views(batch, at)
    good, by_text, by_page = model.quality.probability(text, page)
    toxic = model.toxic.probability(text, page)[0]
    return [by_text, by_page, good, toxic, (good >= threshold) & (toxic < toxic_from)]


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, model: Model | None = None, threshold: float = 0.5, toxic_from: float = 0.3) -> DataFrame:
    """``docs`` with text_quality, page_quality, quality_prob, toxic_prob and kept (quality_prob of ``threshold``
    or more and toxic_prob under ``toxic_from``: a toxic text kept costs more than a clean one lost)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs, labels))  # a fixed number of weights
    new = {f.name for f in FIELDS}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    used = list(dict.fromkeys([*names, *COLUMNS[1:]]))
    source = docs.select(*[docs[f"`{c}`"] for c in used])
    at = {c: used.index(c) for c in used}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in w.small_batches(big, at["text"], BATCH_BYTES):
                added = judged(batch, at, shared.value, threshold, toxic_from)
                yield pa.RecordBatch.from_arrays([batch.column(at[c]) for c in names] + [pa.array(x) for x in added], names=[*names, *[f.name for f in FIELDS]])

    return source.mapInArrow(freed(run), T.StructType([source.schema[c] for c in names] + FIELDS))


def keep(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = 0.5, toxic_from: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs, labels))
    at = {c: docs.columns.index(c) for c in COLUMNS[1:]}
    return chosen(docs, "text", lambda batch: judged(batch, at, shared.value, threshold, toxic_from)[4], BATCH_BYTES)
