"""Typed parts of extraction markdown, and estimates of text sizes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bullets, normalise

_CONFIDENCE = r"(?i)\s*\(confidence:\s*(HIGH|MEDIUM|LOW)\)"


def _first_section(text: Column, *headings: str) -> Column:
    """Items of the first of these headings that has any."""
    found = [bullets(text, h) for h in headings]
    out = found[-1]
    for items in reversed(found[:-1]):
        out = F.when(F.size(items) > 0, items).otherwise(out)
    return out


def decisions(text: Column) -> Column:
    """array of (decision, confidence): the confidence in brackets, medium without one; a bar becomes a slash."""
    named = lambda x: F.lower(F.regexp_extract(x, _CONFIDENCE, 1))
    clean = lambda x: F.translate(F.regexp_replace(x, _CONFIDENCE, ""), "|", "/")
    return F.transform(_first_section(text, "DECISIONS MADE", "DECISIONS"), lambda x: F.struct(clean(x).alias("decision"), F.when(named(x) == "", "medium").otherwise(named(x)).alias("confidence")))


def lessons(text: Column) -> Column:
    """array of (problem, solution, key) from `problem: solution` items; key is the problem's normal form."""
    colon = lambda x: F.instr(x, ":")
    items = F.filter(_first_section(text, "ERRORS FIXED", "ERROR FIXED", "ERRORS_FIXED"), lambda x: colon(x) > 1)
    problem = lambda x: F.trim(F.substring_index(x, ":", 1))
    return F.transform(items, lambda x: F.struct(problem(x).alias("problem"), F.trim(x.substr(colon(x) + 1, F.length(x))).alias("solution"), normalise(problem(x)).alias("key")))


def ideas(text: Column) -> Column:
    return _first_section(text, "MAIN IDEAS", "MAIN_IDEAS")


def topics(text: Column, each: int = 3, most: int = 5, longest: int = 50) -> Column:
    """What stands before the colon in the first items of the decisions, ideas and insights."""
    parts = [F.slice(x, 1, each) for x in (_first_section(text, "DECISIONS MADE", "DECISIONS"), ideas(text), bullets(text, "INSIGHTS"))]
    names = F.transform(F.concat(*parts), lambda x: F.trim(F.substring_index(x, ":", 1)))
    return F.slice(F.array_distinct(F.filter(names, lambda x: (x != "") & (F.length(x) < longest))), 1, most)


def summary_line(text: Column, label: str) -> Column:
    found = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"##\s*ONE\s*SENTENCE\s*SUMMARY\s*\n+(.+)", 1))
    return F.when(found == "", f"{label} session").otherwise(found)


def token_estimate(text: Column) -> Column:
    """A token for every four characters."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)


def embedding_text(head: Column, detail: Column, label: str | None = None) -> Column:
    """Head and detail apart by a blank line; with a label the detail is named, and N/A if there is none."""
    if label is None:
        return F.concat_ws("\n\n", head, detail)
    return F.concat(head, F.lit(f"\n\n{label}: "), F.coalesce(F.nullif(detail, F.lit("")), F.lit("N/A")))


def _section(text: Column, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is)##\s*{pattern}\s*(.*?)(?=\n##\s|\z)", 1)


def import_topics(text: Column, most: int = 8, longest: int = 80) -> Column:
    """Of imported extracts: what stands before the colon in every line of the topics, then of the ideas."""
    bare = lambda x: F.trim(F.substring_index(F.replace(F.regexp_replace(x, r"^[-*]\s*", ""), F.lit("**"), F.lit("")), ":", 1))
    lines = F.concat(*(F.split(_section(text, p), "\n") for p in (r"TOPICS", r"MAIN\s+IDEAS")))
    return F.slice(F.array_distinct(F.filter(F.transform(lines, bare), lambda x: (x != "") & (F.length(x) <= longest))), 1, most)


def import_summary(text: Column) -> Column:
    """The summary section's first line that is not empty, without its dash."""
    lines = F.filter(F.split(F.trim(F.regexp_replace(_section(text, r"ONE\s+SENTENCE\s+SUMMARY"), r"\A\s+|\s+\z", "")), "\n"), lambda x: x != "")
    first = F.trim(F.regexp_replace(F.coalesce(F.get(lines, 0), F.lit("")), r"^[-*]\s*", ""))
    return F.when(first == "", "Imported conversation").otherwise(first)
