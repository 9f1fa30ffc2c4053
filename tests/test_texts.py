from pyspark.sql import functions as F

from millwatch.functions.scalars import TOPIC_KEYWORDS
from millwatch.operators import chunks as ch


def chunks(spark, text, **options):
    rows = spark.createDataFrame([("d", text)], "doc_id string, text string")
    return [r.text for r in ch.chunked(rows, **options).orderBy("ordinal").collect()]


WORDS = " ".join(f"w{i}" for i in range(100))


def test_windows_overlap(spark):
    out = chunks(spark, f"# T\n{WORDS}", target=30, most=60, overlap=5)
    assert all(len(c.split()) <= 60 for c in out)
    assert out[0].split()[-5:] == out[1].split()[:5]
    assert out[-1].split()[-1] == "w99"


def test_no_chunk_spans_headings(spark):
    out = chunks(spark, "# A\n" + "a " * 40 + "\n# B\n" + "b " * 40, target=30, most=60, overlap=5)
    assert not any("a" in c.split() and "b" in c.split() for c in out)
    whole = chunks(spark, "# A\n" + "a " * 4 + "\n# B\n" + "b " * 4, target=30, most=60, overlap=5, respect_headings=False)
    assert len(whole) == 1


def test_empty_and_null(spark):
    assert chunks(spark, "") == chunks(spark, None) == chunks(spark, " \n\t") == []


def test_ids_run_over_sections(spark):
    rows = spark.createDataFrame([("d", "# A\na\n# B\nb")], "doc_id string, text string")
    assert [r.chunk_id for r in ch.chunked(rows).orderBy("ordinal").collect()] == ["d__c0000", "d__c0001"]


def test_topics_and_types(spark):
    rows = spark.createDataFrame([("Chatter and COOLANT flood",), ("maintenance: grease and repair",), ("startup procedure",), ("nothing",)], "t string")
    got = [(list(r.topics), r.kind) for r in rows.select(ch.topics(F.col("t"), TOPIC_KEYWORDS).alias("topics"), ch.doc_type(F.col("t"), F.lit("sop")).alias("kind")).collect()]
    assert got == [(["vibration", "coolant"], "sop"), ([], "maintenance"), ([], "sop"), ([], "sop")]


def test_default_types(spark):
    rows = spark.createDataFrame([("x.md", "a: b\ndoc_type: Maintenance \n"), ("service_sop.md", ""), ("operator.md", "repair"), ("x.md", "repair repair"), ("x.md", "")], "n string, t string")
    assert [r[0] for r in rows.select(ch.default_type(F.col("n"), F.col("t"))).collect()] == ["maintenance", "maintenance", "sop", "maintenance", "sop"]
