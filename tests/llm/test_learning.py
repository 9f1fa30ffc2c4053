"""The quality classifier, quotations and the pipeline."""

import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from millwatch.llm import chat_quotes, decontaminate, entry, ngram_join, quality_classifier, words
from millwatch.llm.storage import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels").where("doc_id % 3 > 0")
    model = quality_classifier.learn(docs, labels)
    rest = table(spark, "/root/testdata/sf0.1", "labels").where("doc_id % 3 = 0")
    rows = quality_classifier.classify(docs.join(rest, "doc_id", "left_semi"), labels, model=model).join(rest, "doc_id").toPandas()
    toxic, clean = rows[rows.toxic == 1], rows[(rows.toxic == 0) & (rows.quality == 1)]
    # few labels: some hundred toxic texts in four languages; what counts is that they aren't kept
    assert (~toxic.kept).mean() > 0.9
    assert (toxic.toxic_prob >= 0.5).mean() > 0.8
    assert clean.kept.mean() > 0.985
    assert (rows[rows.quality == 0].quality_prob < 0.5).mean() > 0.85


def test_classifier_edges(spark):
    rows = spark.createDataFrame([(1, None, None, None, None, True), (2, "", "s", "en", 0, True), (3, "w " * 50_000, "s", "en", 9, True), (3, "x", "s", "en", 1, True)], "doc_id long, text string, source string, lang string, n_chars long, Kept boolean")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(rows, none)
    assert "Kept" not in out.columns and out.count() == 4 and out.where("NOT kept").count() == 0
    few = spark.createDataFrame([(1, 0, None), (1, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(rows, few).count() == 4
    assert quality_classifier.classify(rows.limit(0), few).count() == 0


def test_op6_scores_every_document(spark):
    got = entry.op6_quality_classifier(spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in table(spark, SF, "documents").collect())
    assert (got.kept == ((got.quality_prob >= 0.5) & (got.toxic_prob < 0.3))).all()


def test_exchange_gains(spark):
    """From few labels, all unlabelled documents and the other view teach either view, and both together get better."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rest = labels.where("doc_id % 3 = 0").cache()

    def right(rounds):
        model = quality_classifier.learn(docs, labels.where("doc_id % 3 > 0"), most_labelled=200, rounds=rounds)
        rows = quality_classifier.classify(docs.join(rest, "doc_id", "left_semi"), labels, model=model, keep=["doc_id"]).join(rest, "doc_id").toPandas()
        good = rows.quality == 1
        return [((rows[c] >= 0.5) == good).mean() for c in ("text_quality", "page_quality", "quality_prob")]

    before, after = right(0), right(2)
    assert all(a > b for a, b in zip(after, before, strict=True)), (before, after)


def test_both_views_are_sure_of_something(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    sample, known = quality_classifier.sampled(docs, labels)
    own = quality_classifier.class_counts(sample.where("NOT held"))
    says = [quality_classifier.ratios(*x["quality"]) for x in own]
    rows = quality_classifier.labelled_rows(sample, says[0] != 0)
    target = quality_classifier.fitted(rows, "quality", *says)
    none = quality_classifier.Target(None, None, np.zeros(3), 0.0)
    more = quality_classifier.class_counts(docs, quality_classifier.Model(target, none), known, sure=0.95)
    assert all(x["quality"][c].sum() > 0 for x in more for c in (0, 1)) and all(x["toxic"].sum() == 0 for x in more)


def plain_score(weights, text):
    """A text's score by the text view's weights, by plain loops over its different words and their grams."""
    mask, base, total = (1 << 64) - 1, int(quality_classifier._GRAM_BASE), 0.0
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for word in set(re.findall(r"[^\x20\x09-\x0D]+", low)):
        data, found = word.encode(), {int(words.split(pa.array([word]), words.NOT_SPACE, lower=True).hash[0])}
        for i in range(len(data) - quality_classifier.GRAM + 1):
            value = 0
            for b in data[i : i + quality_classifier.GRAM]:
                value = (value + b) * base & mask
            found.add(int(words.mix(np.asarray([value], np.uint64))[0]))
        total += sum(float(weights[x]) for x in {x & ((1 << quality_classifier.BITS) - 1) for x in found})
    return total


def test_scores_are_those_of_brute_force():
    weights = np.random.default_rng(1).normal(size=1 << quality_classifier.BITS).astype(np.float32)
    texts = ["The quick&&& brown fox, the QUICK fox", None, "", "é" * 9 + " word word", "a\tb\nc", "idiotic idiots | idiot"]
    with np.errstate(over="ignore"):
        view, _ = quality_classifier.text_view(pa.array(texts))
        assert view.score(weights).tolist() == pytest.approx([plain_score(weights, t) for t in texts], abs=1e-4)
        told = view.only(weights > 1)
        few = np.where(weights > 1, weights, 0)
    assert told.score(few).tolist() == pytest.approx([plain_score(few, t) for t in texts], abs=1e-4)
    counts = view.counts(np.asarray([1.0, 0, 0, 1, 0, 0]), len(weights))
    assert counts @ weights == pytest.approx(plain_score(weights, texts[0]) + plain_score(weights, texts[3]), abs=1e-3)


CHAT = [
    (1, 0, "a", "Hello there, how is everyone today?\nI wanted to ask about the schedule."),
    (1, 1, "b", "On Monday a wrote:\n> Hello there, how is  EVERYONE today?\nFine, thank you very much."),
    (1, 2, "c", ">> Hello there, how is everyone today?\n> Fine, thank you very much.\nGlad to hear that from you."),
    (1, 3, "d", "> I wanted to ask about the schedule.\nIt is on the wall."),
    (1, 4, "e", "> this was never said by anyone\nok"),
    (1, 5, "f", None),
    (2, 0, "a", "Glad to hear that from you."),
    (2, 1, "b", "> Glad to hear that from you.\n\nSame."),
]


def ordered(spark, rows, more="role string"):
    df = spark.createDataFrame(rows, f"conv_id long, turn long, {more}, text string")
    return chat_quotes.reply_ordered(df)


def test_quotes_lead_to_their_messages(spark):
    got = {(r.conv_id, r.turn): r for r in ordered(spark, CHAT).collect()}
    assert {k: (r.reply_to, r.thread, r.depth) for k, r in got.items()} == {(1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (1, 0, 2), (1, 3): (0, 0, 1), (1, 4): (None, 4, 0), (1, 5): (None, 5, 0), (2, 0): (None, 0, 0), (2, 1): (0, 0, 1)}
    assert got[1, 1].text == "Fine, thank you very much." and got[1, 2].max_level == 2 and got[1, 2].n_quoted_lines == 2
    assert got[1, 3].text == "It is on the wall." and got[1, 5].text == ""


def test_short_quotes_lead_to_their_messages(spark):
    rows = [(1, 0, "a", "Thanks!\nShall we meet on the third floor?"), (1, 1, "b", "Same."), (1, 2, "c", "> Same.\nWhy?"), (1, 3, "d", ">\n> Why?\nSo."), (1, 4, "e", "> Thanks!\n\nYou too."), (1, 5, "f", "> Same.\n> > Shall we meet on the third floor?\nYes."), (1, 6, "g", "> Never.\n>\nNo."), (1, 7, "h", "> Later.\n"), (1, 8, "i", "Later.")]
    assert {r.turn: (r.reply_to, r.thread, r.depth) for r in ordered(spark, rows).collect()} == {0: (None, 0, 0), 1: (None, 1, 0), 2: (1, 1, 1), 3: (2, 1, 2), 4: (0, 0, 1), 5: (1, 1, 1), 6: (None, 6, 0), 7: (None, 7, 0), 8: (None, 8, 0)}


@pytest.mark.parametrize("answer", ["fine", "I am fine thanks"])
def test_nested_quotes_answer_the_lowest_level(spark, answer):
    rows = [(1, 1, "a", "hello my friend how are you"), (1, 2, "b", f"> hello my friend how are you\n{answer}"), (1, 3, "c", f"> > hello my friend how are you\n> {answer}\nok then")]
    assert {r.turn: (r.reply_to, r.depth) for r in ordered(spark, rows).collect()} == {1: (None, 0), 2: (1, 1), 3: (2, 2)}


def test_replies_that_quote_all_of_their_message(spark):
    """Threads are grown, as mail programs do it: a reply has all lines of its message with one more mark, so who is answered is known."""
    rng, rows, want = np.random.default_rng(8), [], {}
    for conv in range(8):
        shown = []
        for turn in range(30):
            own = [" ".join(f"w{rng.integers(0, 10**6)}"[: rng.integers(2, 8)] + f"c{turn}x{k}" for k in range(rng.integers(1, 6))) for _ in range(rng.integers(1, 4))]
            parent = int(rng.integers(0, turn)) if turn and rng.random() < 0.8 else None
            want[conv, turn] = (parent, 0 if parent is None else want[conv, parent][1] + 1)
            shown.append(([] if parent is None else [("> " if rng.random() < 0.5 else ">") + x for x in shown[parent]]) + own)
            rows.append((conv, turn, "r", "\n".join(shown[-1])))
    assert {(r.conv_id, r.turn): (r.reply_to, r.depth) for r in ordered(spark, rows).collect()} == want


def plain_order(rows):
    """Messages of each conversation in order of reply, by plain loops; every quoted text is a whole line of its source."""
    said, out = {}, {}
    for conv, turn, _, text in sorted(rows, key=lambda r: r[:2]):
        quoted = [x for x in (text or "").split("\n") if x.startswith(">")]
        own = "\n".join(x for x in (text or "").split("\n") if not x.startswith(">")).strip()
        parent = next((t for x in quoted for t in range(turn) if x[2:] in said.get((conv, t), ())), None)
        thread, depth = (turn, 0) if parent is None else (out[conv, parent][0], out[conv, parent][1] + 1)
        said[conv, turn], out[conv, turn] = own.split("\n"), (thread, depth, turn, own)
    return [(conv, [own for (c, _), (*_, own) in sorted(out.items(), key=lambda x: (x[0][0], x[1])) if c == conv]) for conv in sorted({c for c, _ in out})]


def test_conversations_in_order_of_reply(spark):
    rng, rows = np.random.default_rng(3), []
    for conv in range(6):
        for turn in range(int(rng.integers(1, 40))):
            source = int(rng.integers(0, turn)) if turn and rng.random() < 0.6 else None
            rows.append((conv, turn, "r", (f"> what {conv} said as number {source}\n" if source is not None else "") + f"what {conv} said as number {turn}"))
    got = ordered(spark, rows).repartition(5).collect()
    told = [(conv, [r.text for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)]) for conv in range(6)]
    assert told == plain_order(rows)
    assert all(sorted(r.position for r in got if r.conv_id == conv) == list(range(len(texts))) for conv, texts in told)


def test_long_chains_of_replies(spark):
    rows = [(1, 0, "r", "message number 0 says this")] + [(1, k, "r", f"> message number {k - 1} says this\nmessage number {k} says this") for k in range(1, 40)]
    assert sorted((r.turn, r.thread, r.depth) for r in ordered(spark, rows).collect()) == [(k, 0, k) for k in range(40)]


def test_chat_edges(spark):
    assert ordered(spark, []).count() == 0
    out = ordered(spark, CHAT[-2:] * 2, more="depth string")
    assert out.count() == 4 and dict(out.dtypes)["depth"] == "bigint"


def test_op9_keeps_plain_messages(spark):
    before = {(r.conv_id, r.turn): r.text for r in table(spark, SF, "conversations").collect()}
    got = entry.op9_chat_quotes(spark, SF).collect()
    assert len(got) == len(before)
    assert all(r.text == before[r.conv_id, r.turn].strip() and r.thread == r.turn for r in got if ">" not in before[r.conv_id, r.turn])


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    ids, seen = {r.doc_id for r in docs.collect()}, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        assert now <= ids
        seen.append((name, len(now)))
        ids = now
    assert [n for _, n in seen] == sorted((n for _, n in seen), reverse=True) and seen[2][1] == seen[3][1] > 500
    assert ngram_join.classes(docs).where("doc_id <> component_id").count() <= 2  # removed passages may leave texts alike
    assert decontaminate.digest(decontaminate.find(docs, table(spark, SF, "benchmark"))).where("contaminated").count() == 0
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"] and out.count() > 0


def test_stages_bear_odd_rows(spark):
    """Nulls, repeated rows, long texts and columns called like those that operators add: rows stay as they are."""
    good = [r.text for r in table(spark, SF, "documents").join(table(spark, SF, "labels").where("quality = 1 AND toxic = 0"), "doc_id").where("length(text) BETWEEN 800 AND 3000").orderBy("doc_id").limit(8).collect()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, item_ids string, n_words string, component_id string, __x string"
    row = lambda name, text, mark: (name, text, None, None, None, mark, "i", "w", "c", mark)
    rows = [row(1, good[0], "a"), row(1, good[0], "b"), row(1, good[0], "b"), row(2, good[1], "c"), row(None, good[2], "d"), row(None, good[2], "e"), row(None, good[1], "f"), row(3, None, "g"), row(4, "", "h"), row(5, good[3] + " " + good[3], "i"), row(6, " ".join(good[4:6] * 40), "j")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r.kept == r["__x"] and (r.item_ids, r.n_words, r.component_id) == ("i", "w", "c") for r in got), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    near = sorted((r.doc_id or -1, r.kept) for r in corpus_pipeline.near_duplicates_stage(spark, docs, SF).collect())
    assert near == [(-1, "d"), (1, "a"), (2, "c"), (3, "g"), (4, "h"), (5, "i"), (6, "j")]
    assert corpus_pipeline.decontamination_stage(spark, docs, SF).count() == len(rows)
    packed = corpus_pipeline.packing_stage(spark, docs, SF)
    assert packed.where("length > 0").count() >= len(rows) and packed.columns[0] == "doc_id"
