"""Column functions for cleaning and reading text. All are built from Spark's own expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that mean "no value", by flavour.
PLACEHOLDERS = ("", "n/a", "na", "unknown", "?", "none", "null", "-")
FORMAT_PLACEHOLDERS = ("n/a", "na", "null", "none", "nan", "-", "?", "--")
# Words that question and triple matching passes over.
STOPWORDS = tuple(
    "the a an of to in on for and or is are was were be been being with as at by from this that these those it its we our you your they their "
    "what which who how why when where do does did will would should can could about into over under than then them he she his her".split()
)
# Short forms of given names.
NICKNAMES = {"bill": "william", "bob": "robert", "dick": "richard", "jim": "james", "jack": "john", "charlie": "charles", "ed": "edward", "mike": "michael", "tom": "thomas", "joe": "joseph"}
SEVERITIES = {"low": 0, "normal": 1, "high": 2, "critical": 3}
SENSITIVITIES = ("public", "internal", "confidential", "restricted")


def is_placeholder(c: Column, words: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """Null counts as a placeholder."""
    return c.isNull() | F.lower(F.trim(c)).isin(*words)


def blank_placeholder(c: Column, words: tuple[str, ...] = PLACEHOLDERS) -> Column:
    return F.when(is_placeholder(c, words), F.lit(None)).otherwise(c)


def year_of(date: Column) -> Column:
    """The first four characters, if they are digits."""
    return F.when(F.substring(date, 1, 4).rlike("^[0-9]{4}$"), F.substring(date, 1, 4).cast("int"))


def label_year(name: Column) -> Column:
    """A four-digit year at the end of a label."""
    return F.nullif(F.regexp_extract(name, r"([0-9]{4})\s*$", 1), F.lit("")).cast("int")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def person_name(name: Column, nicknames: dict[str, str] | None = None) -> Column:
    """`Last, First` turned round, lower case, a nickname in front written out."""
    trimmed = F.trim(name)
    at = F.instr(trimmed, ",")
    turned = F.when(at > 0, F.concat(F.substr(trimmed, at + 1), F.lit(" "), F.substring_index(trimmed, ",", 1))).otherwise(trimmed)
    words = F.filter(F.split(F.lower(turned), r"\s+"), lambda w: w != "")
    known = F.create_map(*(F.lit(x) for pair in (NICKNAMES if nicknames is None else nicknames).items() for x in pair))
    first = F.when(F.size(words) > 0, words[0])
    return F.array_join(F.concat(F.array(F.coalesce(F.try_element_at(known, first), first, F.lit(""))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))), " ")


def shape(c: Column) -> Column:
    """Digits as 9, lower-case letters as a, capitals as A, runs as one."""
    out = c
    for pattern, mark in (("[0-9]+", "9"), ("[a-z]+", "\x01"), ("[A-Z]+", "A")):
        out = F.regexp_replace(out, pattern, mark)
    return F.replace(out, F.lit("\x01"), F.lit("a"))


def shape_regex(value_shape: str) -> str:
    """The pattern of a shape, for one shape on the driver."""
    import re

    return "".join({"9": r"\d+", "a": "[a-z]+", "A": "[A-Z]+"}.get(c, re.escape(c)) for c in value_shape)


def plain_number(c: Column) -> Column:
    """No zeros, and no point, behind the last digit of a decimal."""
    return F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.?0+$", "")).otherwise(c)


def tidy_cell(c: Column) -> Column:
    """The first that fits: doubled apostrophes, thousands separators, a useless `.0`."""
    return (
        F.when(F.contains(c, F.lit("''")), F.replace(c, F.lit("''"), F.lit("'")))
        .when(c.rlike(r"^\d{1,3}(,\d{3})+$"), F.replace(c, F.lit(","), F.lit("")))
        .when(c.rlike(r"^-?\d+\.0$"), F.regexp_replace(c, r"\.0$", ""))
        .otherwise(c)
    )


def canonical_value(c: Column) -> Column:
    """Lower case, blanks squeezed, dollars as `$`; a string that is all number and unit loses commas and the unit, others stay."""
    low = F.regexp_replace(squeezed(F.lower(c)), r"\b(usd|dollars?)\b", "\\$")
    number = r"^[\$€£]?\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:%|\$|[a-z]+)?$"
    digits = F.replace(F.regexp_extract(low, number, 1), F.lit(","), F.lit(""))
    mark = F.when(F.contains(low, F.lit("$")), "$").when(F.contains(low, F.lit("%")), "%").otherwise("")
    return F.when(low.rlike(number), F.concat(mark, plain_number(digits))).otherwise(low)


def words(c: Column, pattern: str = "[a-zA-Z0-9_]+") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def content_words(c: Column) -> Column:
    return F.filter(words(c, "[a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def question_entities(c: Column) -> Column:
    """Quoted phrases, runs of capitalised words (the first of three letters or more), and numbers, without repeats."""
    quoted = F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1))
    proper = F.regexp_extract_all(c, F.lit(r"\b[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]*)*"), F.lit(0))
    numbers = F.regexp_extract_all(c, F.lit(r"\b[0-9][0-9,.]*[0-9%]|\b[0-9]"), F.lit(0))
    every = F.array_distinct(F.concat(quoted, proper, numbers))
    return F.filter(every, lambda e: (F.length(e) > 1) & ~F.lower(e).isin(*STOPWORDS))


def injection(c: Column) -> Column:
    """Text that gives orders to whoever reads it."""
    return c.rlike(r"(?i)(ignore (all |any )?(previous|prior|above) (instructions|rules)|disregard (the )?(above|previous)|you are now|system prompt)")


def provenance_weight(extraction: Column, confidence: Column, text: Column) -> Column:
    """Scanned text counts 0.7 to 1 by confidence (0.5 if missing or 0), text with orders 0.4 of that."""
    sure = F.when(confidence.isNull() | (confidence == 0), 0.5).otherwise(confidence)
    return F.when(extraction == "ocr", 0.7 + 0.3 * sure).otherwise(1.0) * F.when(injection(text), 0.4).otherwise(1.0)


def garbage_ratio(c: Column) -> Column:
    """Share of words of two letters or more that have no vowel or a capital inside; 1 without words."""
    tokens = F.regexp_extract_all(c, F.lit("[a-zA-Z]{2,}"), F.lit(0))
    bad = F.filter(tokens, lambda t: ~F.lower(t).isin(*STOPWORDS) & (~t.rlike("(?i)[aeiouy]") | t.rlike("[a-z][A-Z]")))
    return F.when(F.size(tokens) > 0, F.size(bad) / F.size(tokens)).otherwise(1.0)


def failure_signature(error: Column) -> Column:
    """The leading exception name, else the text without digits and paths, 60 characters."""
    named = F.nullif(F.regexp_extract(error, r"^\s*([A-Za-z_.]*(?:Error|Exception|Timeout))", 1), F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(error, r"(/[^\s]+)+", ""), "[0-9]+", ""))
    return F.coalesce(named, F.substring(bare, 1, 60))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.9, "applied").when(c >= 0.6, "needs_review").otherwise("flagged_only")


def answer_confidence(similarity: Column, verdict: Column, conflict: Column, low_scan_share: Column) -> Column:
    base = F.least(F.lit(1.0), similarity + 0.25) * F.when(verdict == "SUFFICIENT", 1.0).when(verdict == "PARTIAL", 0.7).otherwise(0.4)
    return base * F.when(conflict, 0.5).otherwise(1.0) * (1 - 0.3 * low_scan_share)


def rank_of(label: Column, order: tuple[str, ...] = SENSITIVITIES) -> Column:
    """Missing labels are the lowest, unknown ones the highest: closed if in doubt."""
    out = F.when(label.isNull() | (F.trim(label) == ""), 0)
    for i, name in enumerate(order):
        out = out.when(F.lower(F.trim(label)) == name, i)
    return out.otherwise(len(order) - 1)


def severity_rank(label: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(label)), F.lit(1))


def code_language(text: Column) -> Column:
    return (
        F.when(text.rlike(r"(?m)^\s*(def |import |from \w+ import |class \w+.*:)"), "python")
        .when(text.rlike(r"(?m)(function\s*\w*\(|=>|\b(const|let|var)\s+\w+\s*=)"), "javascript")
        .when(text.rlike(r"(?m)\b(public|private|protected)\s+(static\s+)?\w+"), "java")
        .otherwise("unknown")
    )


def intent(question: Column) -> Column:
    low = F.lower(question)
    return (
        F.when(low.rlike(r"\b(when|date|year|before|after|since|until)\b"), "temporal")
        .when(low.rlike(r"\b(who|whom|whose)\b"), "entity")
        .when(low.rlike(r"\b(what happened|event|occurred|incident)\b"), "event")
        .otherwise("general")
    )


def html_text(html: Column) -> Column:
    """The text of a page: without scripts, navigation and tags, entities of markup read, blank lines dropped."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|header|footer|nav|aside|form|svg)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?is)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"))
