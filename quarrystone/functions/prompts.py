"""Strings for outer services: searches, prompts, and what models answer.

Wording of prompts is a parameter; only their shape is given here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an error says when a service's limits are reached.
RATE_LIMIT = ("rate limit", "too many requests", "resourceexhausted", "resource exhausted", "quota", "429", "daily request cap reached")
TEMPLATE = "{system}\n\nCONTEXT:\n{context}\n\nSOURCES:\n{sources}\n\nQUESTION: {query}\n"
SYSTEM = {
    "explanatory": "Explain the mechanism from the passages alone and cite each claim.",
    "comparative": "Compare what the passages say, side by side, and cite each claim.",
    "evidence": "Weigh the evidence in the passages and tell findings from interpretation.",
    "general": "Answer from the passages alone, cite each claim, and say what they leave open.",
}
SEVERAL = "\n\nNOTE: the passages come from several papers; keep their views apart."


def any_keyword(keywords: Column) -> Column:
    """A search for any of the phrases."""
    return F.array_join(F.transform(keywords, lambda k: F.concat(F.lit('all:"'), k, F.lit('"'))), " OR ")


def submitted_between(query: Column, first: Column, last: Column) -> Column:
    return F.concat(F.lit("("), query, F.lit(") AND submittedDate:["), F.date_format(first, "yyyyMMdd"), F.lit("0000 TO "), F.date_format(last, "yyyyMMdd"), F.lit("2359]"))


def numbered_lines(answer: Column, query: Column, most: int = 3) -> Column:
    """Questions that a model lists by number, but for the one asked."""
    lines = F.slice(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(?m)^\s*\d+\.\s*(.+)$"), F.lit(1)), 1, most)
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != F.lower(query)))


def nearby_phrases(texts: Column, query: Column, most: int = 4, pool: int = 12, chars: int = 1200) -> Column:
    """Variants of a question with capitalised phrases of nearby chunks, in order of the alphabet."""
    found = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.substring(t, 1, chars), F.lit(r"(?U)(\b[A-Z][a-z]+(?:\s+[a-z]{2,}){0,3}\b)"), F.lit(1))))
    new = F.filter(found, lambda p: (F.length(p) > 5) & ~F.contains(F.lower(query), F.lower(p)))
    phrases = F.slice(F.array_sort(F.slice(F.array_distinct(new), 1, pool)), 1, most)
    return F.transform(phrases, lambda p: F.concat(query, F.lit(" "), p))


def source_list(titles: Column) -> Column:
    return F.array_join(F.transform(titles, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit('] "'), F.coalesce(t, F.lit("Untitled")), F.lit('"'))), "\n")


def prompt(query: Column, intent: Column, context: Column, sources: Column, papers: Column, template: str = TEMPLATE, system: dict[str, str] = SYSTEM) -> Column:
    """The template filled in; several papers are told to be kept apart."""
    first = F.lit(system["general"])
    for name, words in system.items():
        first = F.when(intent == name, words).otherwise(first)
    filled = {"system": first, "query": query, "sources": sources, "context": F.concat(context, F.when(papers > 1, SEVERAL).otherwise(""))}
    parts: list[Column] = []
    for piece in template.replace("}", "{").split("{"):
        parts.append(filled[piece] if piece in filled else F.lit(piece))
    return F.concat(*parts)


def is_rate_limit(error: Column) -> Column:
    return F.lower(F.coalesce(error, F.lit(""))).rlike("|".join(RATE_LIMIT))
