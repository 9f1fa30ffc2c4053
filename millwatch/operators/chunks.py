"""Texts to heading-aware chunks with topics and document types. All of it stays in the row: nothing shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MAINTENANCE_WORDS, SOP_WORDS, TOPIC_KEYWORDS, chunk_id


def sections(text: Column, respect_headings: bool = True) -> Column:
    """Parts of a text that begin at lines starting with `#`, those marks taken off."""
    if not respect_headings:
        return F.array(text)
    return F.transform(F.split(text, r"(?m)^(?=[ \t]*#)"), lambda s: F.regexp_replace(s, "^#+", ""))


def tokens(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def token_windows(text: Column, target: int = 175, most: int = 220, overlap: int = 20, respect_headings: bool = True, least: int = 0) -> Column:
    """Chunks of a text as (text, n_tokens): windows of tokens that overlap, none across a heading.

    A last window of a section with fewer than ``least`` tokens goes with the one before where both have ``most`` at
    most; else it begins earlier, so that it has ``least``. A section of fewer tokens altogether stays as it is.
    """
    size = min(target, most)
    if least > size:
        raise ValueError(f"at least {least} tokens don't fit windows of {size}")
    step = max(1, size - overlap)

    def cut(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - size) / F.lit(step))).cast("int")
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, size))
        if least > 0:
            n, tail = F.size(words), F.size(words) - last * step
            short, joined = (last > 0) & (tail < least), n - (last - 1) * step <= most
            ending = F.when(joined, F.slice(words, (last - 1) * step + 1, F.lit(most))).otherwise(F.slice(words, n - least + 1, F.lit(least)))
            windows = F.when(short, F.concat(F.slice(windows, F.lit(1), F.when(joined, last - 1).otherwise(last)), F.array(ending))).otherwise(windows)
        chunks = F.transform(windows, lambda x: F.struct(F.array_join(x, " ").alias("text"), F.size(x).cast("long").alias("n_tokens")))
        return F.filter(chunks, lambda x: x["n_tokens"] > 0)

    # a section is split once: its words are the element that the inner functions take their windows from
    words = F.transform(sections(text, respect_headings), tokens)
    return F.flatten(F.transform(words, cut))


def chunked(documents: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """doc_id, chunk_id, ordinal, text, n_tokens, in order over all sections of a document."""
    cut = documents.select(F.col(key).cast("string").alias("doc_id"), F.posexplode(token_windows(F.col(text), **options)).alias("ordinal", "chunk"))
    return cut.select("doc_id", chunk_id(F.col("doc_id"), F.col("ordinal")).alias("chunk_id"), "ordinal", "chunk.text", "chunk.n_tokens")


def topics(text: Column, keywords: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS) -> Column:
    """Topics, in their order, of which the text contains a keyword."""
    low = F.lower(text)

    def any_of(words: Sequence[str]) -> Column:
        found = F.lit(False)
        for k in words:
            found = found | F.contains(low, F.lit(k.lower()))
        return found

    return F.array_compact(F.array(*[F.when(any_of(words), F.lit(topic)) for topic, words in keywords.items()]))


def votes(text: Column, words: Sequence[str]) -> Column:
    """How often the words occur in the text, each counted without overlaps."""
    low = F.lower(text)
    return sum((((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).cast("int") for k in words), F.lit(0))


def doc_type(text: Column, default: Column, maintenance: Sequence[str] = MAINTENANCE_WORDS, sop: Sequence[str] = SOP_WORDS) -> Column:
    """The kind whose words are more; the default between equals."""
    m, s = votes(text, maintenance), votes(text, sop)
    return F.when(m > s, "maintenance").when(s > m, "sop").otherwise(default)


# How front matter names a type, and what file names say of it.
FRONT_MATTER = r"(?im)^doc_type:\s*(sop|maintenance)\s*$"
MAINTENANCE_NAMES = ("mainten", "service", "repair", "_mm", "mm_")
SOP_NAMES = ("sop", "operat", "procedure", "_om", "om_")
# End of fixed values.


def default_type(name: Column, text: Column, **words: Sequence[str]) -> Column:
    """A document's type: its front matter, else its file's name, else its words, else sop."""
    front = F.lower(F.regexp_extract(F.substring(text, 1, 500), FRONT_MATTER, 1))
    low = F.lower(name)

    def any_of(*parts: str) -> Column:
        found = F.lit(False)
        for p in parts:
            found = found | F.contains(low, F.lit(p))
        return found

    return F.when(front != "", front).when(any_of(*MAINTENANCE_NAMES), "maintenance").when(any_of(*SOP_NAMES), "sop").otherwise(doc_type(text, F.lit("sop"), **words))


def page_equivalents(chunks: DataFrame) -> DataFrame:
    return chunks.agg((F.sum("n_tokens") / 500).alias("text_pages_equiv"))
