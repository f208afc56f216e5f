"""Column functions on chunk ids, names, headings and texts. All stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How ids and keys are put together.
SEP = "||"


def page_of(chunk_id: Column) -> Column:
    """The page part of a chunk id: digits, else a lower-cased sheet name; null if there is none."""
    found = F.lower(F.regexp_extract(chunk_id, r"(?i)_page_(.+?)_(?:text_|table_|image_)?chunk_\d+", 1))
    return F.when(found != "", found)


def chunk_of(chunk_id: Column) -> Column:
    found = F.regexp_extract(chunk_id, r"(?i)_chunk_(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def is_number(page: Column) -> Column:
    return page.rlike(r"^\d+$")


def section_hint(text: Column) -> Column:
    """The first line if it is at most 140 characters and a numbered heading, or all upper case and at most 100."""
    line = F.trim(F.get(F.split(F.trim(text), "\n"), F.lit(0)))
    numbered = (F.length(line) <= 140) & line.rlike(r"^\d+(\.\d+)*[.)]?\s+\S")
    upper = (F.length(line) <= 100) & (F.upper(line) == line) & (F.lower(line) != line)
    return F.when((line != "") & (numbered | upper), line)


def norm_name(name: Column) -> Column:
    """Lower case; each run of other characters than a-z, 0-9 and space is one space; runs of spaces stay."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " "))


def loose_name(name: Column) -> Column:
    """As norm_name, and runs of spaces are one."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def entity_key(name: Column) -> Column:
    return F.sha1(F.concat(F.lit("entity" + SEP), norm_name(name)))


def relation_id(subject_key: Column, label: Column, object_key: Column, description: Column) -> Column:
    return F.sha1(F.concat_ws(SEP, F.lit("relation"), subject_key, label, object_key, F.lower(description)))


def assertion_key(chunk_id: Column, relation: Column) -> Column:
    return F.sha1(F.concat_ws(SEP, F.lit("assertion"), chunk_id, relation))


def snake(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def norm_keywords(words: Column, label: Column, most: int = 6) -> Column:
    """Snake-case words, distinct in order, at most `most`; [label] if none is left."""
    kept = F.slice(F.array_distinct(F.filter(F.transform(words, snake), lambda x: x != "")), 1, most)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(label))


def clean_whitespace(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, " ?\n ?", "\n"), "\n{3,}", "\n\n"))


def clip(text: Column, most: int) -> Column:
    """White space collapsed; texts over `most` characters end in an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def is_boilerplate(text: Column, phrase: str, most: int = 200) -> Column:
    return (F.length(F.trim(text)) < most) & F.contains(F.lower(text), F.lit(phrase.lower()))


def confidence(raw: Column) -> Column:
    """Clamped to 0..1; 0.75 where it is missing or no number; NaN counts as 0."""
    value = raw.try_cast("double")
    return F.when(value.isNull(), F.lit(0.75)).when(F.isnan(value), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def strength(raw: Column) -> Column:
    """Clamped to 1..10; 5 where it is missing or no whole number."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(F.trim(raw).try_cast("int"), F.lit(5))))


def evidence_or_text(evidence: Column, text: Column, most: int = 1000) -> Column:
    return F.coalesce(F.nullif(F.trim(evidence), F.lit("")), F.substring(text, 1, most))


def fallback_description(category: Column, llm_category: Column) -> Column:
    kind = F.regexp_replace(F.coalesce(F.nullif(category, F.lit("")), F.lit("other")), "_", " ")
    named = F.regexp_replace(F.coalesce(llm_category, F.lit("")), "_", " ")
    return F.when((named != "") & (named != kind), F.concat(F.lit("A "), named, F.lit(" ("), kind, F.lit(") named in the documents."))).otherwise(F.concat(F.lit("A "), kind, F.lit(" named in the documents.")))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
