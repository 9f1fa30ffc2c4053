"""Queries over ``documents`` and ``pages`` taken for manuals. Keyword lists are of the words these tables have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as ch
from .detection import rounded

KEYWORDS = {"legal": ["license", "apache"], "german": ["nicht", " und "], "token": ["token"], "spanish": ["ción"]}
MAINT, SOP = ("license", "thing", "nicht"), ("token", "tion", "des ")
TARGET, MOST, OVERLAP = 175, 220, 20


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ch.chunked(spark.read.parquet(f"{sf_dir}/documents.parquet"), target=TARGET, most=MOST, overlap=OVERLAP, respect_headings=False)
    return cut.withColumn("topic_tags", ch.topics(F.col("text"), KEYWORDS)).withColumn("doc_type", ch.doc_type(F.col("text"), F.lit("sop"), MAINT, SOP))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", "chunk_id", F.md5("text").alias("text_md5"), "n_tokens")


def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plain = F.regexp_replace(F.regexp_replace("html", "<h1>", "\n# "), "<[^>]*>", " ")
    cut = ch.chunked(pages.select("page_id", plain.alias("text")), key="page_id", target=60, most=120, overlap=5)
    return cut.select("doc_id", "chunk_id", F.md5("text").alias("text_md5"), "n_tokens")


def chunk_short_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 80 tokens at least, but for documents of fewer."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = ch.chunked(rows, target=TARGET, most=MOST, overlap=OVERLAP, respect_headings=False, least=80)
    return cut.select("doc_id", "chunk_id", F.md5("text").alias("text_md5"), "n_tokens")


def topic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.array_join(ch.topics(F.col("text"), KEYWORDS), ",").alias("topics"))


def doc_type_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", ch.votes(F.col("text"), MAINT).cast("long").alias("maintenance"), ch.votes(F.col("text"), SOP).cast("long").alias("sop"), ch.doc_type(F.col("text"), F.lit("sop"), MAINT, SOP).alias("doc_type"))


def doc_default_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat(F.when(F.col("doc_id") % 7 == 0, "title: x\ndoc_type: Maintenance\n").otherwise(""), F.col("text"))
    name = F.concat("source", F.when(F.col("doc_id") % 5 == 0, "_service_manual.md").when(F.col("doc_id") % 5 == 1, "_operator.md").otherwise(".md"))
    return rows.select("doc_id", ch.default_type(name, text, maintenance=MAINT, sop=SOP).alias("doc_type"))


def page_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ch.page_equivalents(chunks(spark, sf_dir)))


def _votes(words: tuple[str, ...]) -> str:
    return " + ".join(f"((length(low) - length(replace(low, '{k}', ''))) // {len(k)})" for k in words)


def _topics(low: str) -> str:
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'''contains({low}, '{k}')''' for k in words)} THEN '{t}' END" for t, words in KEYWORDS.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _type(default: str) -> str:
    return f"CASE WHEN {_votes(MAINT)} > {_votes(SOP)} THEN 'maintenance' WHEN {_votes(SOP)} > {_votes(MAINT)} THEN 'sop' ELSE {default} END"


def _cut(source: str, target: int, most: int, overlap: int) -> str:
    """``source``: a relation (doc_id, s, section) of sections in order."""
    size = min(target, most)
    step = max(1, size - overlap)
    return f"""toks AS (SELECT doc_id, s, list_filter(regexp_split_to_array(section, '[\\s\\x{{0B}}\\x{{85}}\\pZ]+'), lambda x: x <> '') AS w FROM {source}),
pieces AS (SELECT doc_id, s, i, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS text FROM (SELECT doc_id, s, w, unnest(range(0, greatest(0, ceil((len(w) - {size}) / {step}::DOUBLE))::BIGINT + 1)) AS i FROM toks WHERE len(w) > 0)),
chunks AS (SELECT doc_id, doc_id || '__c' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY s, i) - 1)::VARCHAR, 4, '0') AS chunk_id, text, len(string_split(text, ' ')) AS n_tokens FROM pieces)"""


_SHORT_TAILS = f"""toks AS (SELECT doc_id::VARCHAR AS doc_id, list_filter(regexp_split_to_array(text, '[\\s\\x{{0B}}\\x{{85}}\\pZ]+'), lambda x: x <> '') AS w FROM documents),
sized AS (SELECT doc_id, w, len(w) AS n, greatest(0, ceil((len(w) - 175) / 155::DOUBLE))::BIGINT AS l FROM toks WHERE len(w) > 0),
kinds AS (SELECT *, l > 0 AND n - l * 155 < 80 AS short, n - (l - 1) * 155 <= 220 AS joined FROM sized),
pieces AS (SELECT doc_id, i, CASE WHEN short AND joined AND i = l - 1 THEN w[i * 155 + 1 :] WHEN short AND NOT joined AND i = l THEN w[n - 79 :] ELSE w[i * 155 + 1 : i * 155 + 175] END AS p FROM (SELECT *, unnest(range(0, CASE WHEN short AND joined THEN l ELSE l + 1 END)) AS i FROM kinds))"""

DOC_CHUNKS = f"whole AS (SELECT doc_id::VARCHAR AS doc_id, 0 AS s, text AS section FROM documents), {_cut('whole', TARGET, MOST, OVERLAP)}, typed AS (SELECT chunk_id, n_tokens, {_topics('lower(text)')} AS topic_tags, {_type(chr(39) + 'sop' + chr(39))} AS doc_type FROM (SELECT *, lower(text) AS low FROM chunks))"
_SECTIONS = "plain AS (SELECT page_id::VARCHAR AS doc_id, regexp_replace(replace(html, '<h1>', chr(10) || '# '), '<[^>]*>', ' ', 'g') AS t FROM pages), cutting AS (SELECT doc_id, string_split(regexp_replace(t, '(?m)^([ \\t]*#)', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM plain), sections AS (SELECT doc_id, s, regexp_replace(parts[s], '^#+', '') AS section FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS s FROM cutting))"

SQL = {
    "chunk_documents": f"WITH {DOC_CHUNKS} SELECT doc_id, chunk_id, md5(text) AS text_md5, n_tokens FROM chunks",
    "chunk_sections": f"WITH {_SECTIONS}, {_cut('sections', 60, 120, 5)} SELECT doc_id, chunk_id, md5(text) AS text_md5, n_tokens FROM chunks",
    "chunk_short_tails": f"WITH {_SHORT_TAILS} SELECT doc_id, doc_id || '__c' || lpad(i::VARCHAR, 4, '0') AS chunk_id, md5(array_to_string(p, ' ')) AS text_md5, len(p) AS n_tokens FROM pieces",
    "topic_tags": f"SELECT doc_id, array_to_string({_topics('lower(text)')}, ',') AS topics FROM documents",
    "doc_type_vote": f"SELECT doc_id, {_votes(MAINT)} AS maintenance, {_votes(SOP)} AS sop, {_type(chr(39) + 'sop' + chr(39))} AS doc_type FROM (SELECT *, lower(text) AS low FROM documents)",
    "doc_default_type": f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'maintenance' WHEN doc_id % 5 = 0 THEN 'maintenance' WHEN doc_id % 5 = 1 THEN 'sop' ELSE {_type(chr(39) + 'sop' + chr(39))} END AS doc_type FROM (SELECT *, lower(text) AS low FROM documents)",
    "page_equivalents": f"WITH {DOC_CHUNKS} SELECT round(sum(n_tokens) / 500::DOUBLE, 6) AS text_pages_equiv FROM chunks",
}

QUERIES = {name: globals()[name] for name in SQL}
