"""Understanding of questions: intent, gates, variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone import config

any_of = lambda phrases: r"(?i)\b(" + "|".join(phrases) + r")\b"


def intent_of(query: Column) -> Column:
    q = F.trim(F.coalesce(query, F.lit("")))
    short = q.endswith("?") & (F.size(F.filter(F.split(q, r"\s+"), lambda x: x != "")) <= 8)
    out = F.when(short, config.EXPLANATORY).otherwise(config.DISCOVERY)
    for intent, phrases in reversed(config.INTENT_PHRASES):
        out = F.when(q.rlike(any_of(phrases)), intent).otherwise(out)
    return out


def is_summary(query: Column) -> Column:
    return F.coalesce(query, F.lit("")).rlike(any_of(config.SUMMARY_PHRASES))


def gate_of(query: Column, intent: Column) -> dict[str, Column]:
    """Which kinds of expansion a question is kept from."""
    q = F.trim(F.coalesce(query, F.lit("")))
    exact = F.lower(q).rlike(r"\b(?:arxiv:)?\d{4}\.\d{4,5}\b")
    formal = intent.isin(config.TECHNICAL, config.COMPARATIVE, config.EVIDENCE)
    tex = (F.regexp_count(q, F.lit(r"\$[^$]{2,}\$")) >= 2) | F.contains(q, F.lit("\\begin{")) | F.contains(q, F.lit("_{}"))
    numbered = F.lower(q).rlike(r"\b(?:eq\.?|equation)\s*\d+")
    return {
        "restrict_decompose": exact,
        "restrict_embedding_expansion": formal | exact | tex | numbered,
        "restrict_llm_expansion": formal | exact | tex | (F.regexp_count(q, F.lit('"')) >= 2),
    }


def unlike(texts: Column, most: int) -> Column:
    """The first ``most`` texts, no two alike but for case."""
    first = F.filter(texts, lambda x, k: F.array_position(F.transform(texts, F.lower), F.lower(x)) == k + 1)
    return F.slice(first, 1, most)


def variants_of(query: Column, intent: Column, scoped: bool = False, most: int = 5) -> Column:
    """The question and what its intent makes of it, no two alike but for case."""
    q = F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " "))
    none = F.array().cast("array<string>")
    ext = lambda words: F.array(*[F.concat(q, F.lit(" " + w)) for w in words])
    by_intent = none
    for name, words in config.VARIANT_SUFFIXES.items():
        by_intent = F.when(intent == name, ext(words)).otherwise(by_intent)
    summary = F.when(is_summary(q), F.concat(ext(config.SUMMARY_SUFFIXES), F.array(F.lit("main contributions")))).otherwise(none)
    sides = F.filter(F.transform(F.split(q, r"(?i)\bvs\.?\b|\bversus\b", 2), lambda x: F.trim(x)), lambda x: x != "")
    versus = F.when((intent == config.COMPARATIVE) & F.contains(F.lower(q), F.lit(" vs ")), sides).otherwise(none)
    own = F.array(F.concat(q, F.lit(" in this paper"))) if scoped else none
    every = F.concat(F.array(q), by_intent, summary, versus, own)
    return F.when(q == "", none).otherwise(unlike(every, most))
