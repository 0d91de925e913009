"""Column expressions over texts, dates, ids and section labels."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone import config

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def lexical_words(col: Column) -> Column:
    """Lower case, punctuation deleted (not replaced)."""
    return F.regexp_replace(F.lower(text(col)), r"[^\p{L}\p{N}_\s]", "")


def lexical_tokens(col: Column) -> Column:
    """The words, split at white space."""
    return F.filter(F.split(lexical_words(col), r"\s+"), lambda x: x != "")


def clean(col: Column) -> Column:
    return F.trim(F.regexp_replace(text(col), r"\s+", " "))


def strip_html(col: Column) -> Column:
    return clean(F.regexp_replace(text(col), r"<[^>]*>", " "))


def normalize_published(col: Column) -> Column:
    """YYYY-MM-DD from a date of day, month or year precision; null otherwise."""
    s = F.trim(text(col.cast("string")))
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10))
        .when(s.rlike(r"^\d{4}-\d{2}\b"), F.concat(F.substring(s, 1, 7), F.lit("-01")))
        .when(s.rlike(r"^\d{4}\b"), F.concat(F.substring(s, 1, 4), F.lit("-01-01")))
    )


def normalize_paper_id(col: Column) -> Column:
    s = F.trim(F.replace(F.lower(F.trim(text(col))), F.lit("arxiv:"), F.lit("")))
    s = F.trim(F.regexp_replace(s, r"\.pdf$", ""))
    s = F.trim(F.regexp_replace(s, r"^https?://arxiv\.org/(pdf|abs)/", ""))
    bare = F.regexp_extract(s, r"^(\d{4}\.\d{4,5})(v\d+)?$", 1)
    return F.when(bare != "", bare).otherwise(s)


def is_paper_id(col: Column, digits: str = "4,5") -> Column:
    """``digits``: how many may follow the point (a range as in regular expressions)."""
    return text(col).rlike(rf"^\d{{4}}\.\d{{{digits}}}$")


def layer_of(year: Column, is_reference: Column | None = None) -> Column:
    reference = F.lit(False) if is_reference is None else is_reference
    return (
        F.when(year.isNull(), "core").when(year <= 2019, "prerequisite").when((year <= 2022) & reference, "prerequisite")
        .when(year <= 2022, "foundation").when(year <= 2024, "core").otherwise("latest")
    )


def era_of(year: Column) -> Column:
    out = F.lit(config.ERAS[-1][0])
    for name, last in reversed(config.ERAS[:-1]):
        out = F.when(year <= last, name).otherwise(out)
    return F.when(year.isNotNull(), out)


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def cache_key(query: Column, paper: Column, epoch: Column) -> Column:
    return F.concat(F.lit("qcache:"), F.substring(F.sha2(F.concat_ws("|", F.lower(F.trim(query)), text(paper), epoch.cast("string")).cast("binary"), 256), 1, 16))


# Which word of a heading gives which label, the first that is there.
HEADINGS = (
    (r"\babstract\b", "abstract"), (r"\bintroduction\b", "introduction"), (r"\brelated\s+work\b", "related_work"), (r"\bbackground\b", "background"), (r"\bpreliminar(y|ies)\b", "background"),
    (r"\bmethod(s|ology)?\b", "method"), (r"\bexperiments?\b", "experiments"), (r"\bevaluation\b", "experiments"), (r"\bresults?\b", "results"), (r"\bablation\b", "results"),
    (r"\banalysis\b", "results"), (r"\bdiscussion\b", "discussion"), (r"\bconclusions?\b", "conclusion"), (r"\bappendix\b", "appendix"), (r"\bachnowledg", "other"),
    (r"\breference|bibliography|works\s+cited\b", "other"), (r"\bpreface\b", "preface"),
)
# What a heading's words give where none of the above is there, and what comes before all.
FALLBACKS = (("method|approach|architecture", "method"), ("experiment|setup", "experiments"), ("result|finding", "results"), ("related.*work|work.*related", "related_work"), ("conclusion", "conclusion"), ("introduction", "introduction"), ("discussion", "discussion"))
FIRST = (("abstract", "abstract"), ("appendix|supplementary", "appendix"), ("preface", "preface"))


def label_rules() -> list[tuple[str, str]]:
    return [*FIRST, *HEADINGS, *FALLBACKS]


def normalize_section(col: Column, strict_compat: bool = False) -> Column:
    """A canonical label.  ``strict_compat`` also takes off leading letters that could be
    a roman number though they belong to a word; else they must stand alone."""
    s = F.lower(F.trim(text(col)))
    s = F.regexp_replace(s, r"^\d+(\.\d+)*\s*\.?\s*", "")
    s = F.regexp_replace(s, r"^[ivxlcdm]+\s*\.?\s*" if strict_compat else r"^[ivxlcdm]+(\.\s*|\s+)", "")
    s = F.trim(F.replace(s, F.lit("_"), F.lit(" ")))
    out = F.lit("other")
    for pattern, label in reversed(label_rules()):
        out = F.when(s.rlike(pattern), label).otherwise(out)
    return out


def section_profile(col: Column) -> Column:
    s = F.lower(text(col))
    out = F.lit("default")
    for size, words in reversed(config.PROFILES):
        out = F.when(s.rlike("|".join(words)), size).otherwise(out)
    return out


def heuristic_label(col: Column) -> Column:
    s = F.lower(text(col))
    return (
        F.when(s.rlike("result|experiment|evaluation|benchmark|ablation|finding|performance"), "empirical evidence").when(s.rlike("introduction|related work|background|motivation|problem"), "theoretical background")
        .when(s.rlike("method|approach|architecture|framework|algorithm"), "methodology").when(s.rlike("discussion|limitation|future work|conclusion|interpretation"), "theoretical interpretation").otherwise("general context")
    )


def is_relevant(title: Column, abstract: Column) -> Column:
    """The words are plain ones: looking for each costs far less than one pattern of all of them."""
    held = lambda x: reduce(or_, (F.contains(x, F.lit(w)) for w in config.RELEVANT))
    return F.exists(F.array(F.lower(F.concat_ws(" ", text(title), text(abstract)))), held)  # an array, so that it is lowered once


def local_summary(col: Column, most: int = 220) -> Column:
    """The first two sentences, cut with an ellipsis."""
    s = F.trim(F.array_join(F.slice(F.split(clean(col), r"(?<=[.!?])\s+"), 1, 2), " "))
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 3)), F.lit("..."))).otherwise(s)


def contextual_text(title: Column, authors: Column, categories: Column, section: Column, body: Column, index: Column, total: Column) -> Column:
    label = F.initcap(F.replace(F.coalesce(section, F.lit("other")), F.lit("_"), F.lit(" ")))
    head = F.concat(F.lit("Paper: "), title, F.lit(" | Authors: "), authors, F.lit(" | Categories: "), categories, F.lit(" | Section: "), label, F.lit(" | Chunk "), (index + 1).cast("string"), F.lit("/"), total.cast("string"))
    summary = local_summary(body)
    return F.trim(F.concat(head, F.when(summary != "", F.concat(F.lit("\nLocal summary: "), summary)).otherwise(""), F.lit("\n\n"), body))


def lexical_document(title: Column, authors: Column, categories: Column, section: Column, body: Column) -> Column:
    """Fields with their names before them; the title twice."""
    tagged = lambda name, c: F.when(F.trim(text(c)) != "", F.concat(F.lit(name + " "), F.trim(c)))
    return F.concat_ws("\n", tagged("title", title), tagged("title", title), tagged("authors", authors), tagged("categories", categories), F.concat(F.lit("section "), normalize_section(section)), tagged("body", body))


def paper_text(title: Column, abstract: Column) -> Column:
    """What stands for a whole paper where papers are searched."""
    t, a = clean(title), F.substring(clean(abstract), 1, 10_000)
    both = F.concat(F.lit("Title: "), t, F.lit("\n\nAbstract: "), a)
    return F.substring(F.when((t != "") & (a != ""), both).otherwise(F.concat(t, a)), 1, 12_000)


def source_text(title: Column, abstract: Column, full_text: Column, mode: str = "auto") -> Column:
    """What is chunked: the full text, else the abstract, without what follows the
    references, the acknowledgements, an appendix or supplements; the title before it."""
    a, f = F.trim(text(abstract)), F.trim(text(full_text))
    base = {"abstract": a, "full_text": f}.get(mode, F.when(f != "", f).otherwise(a))
    number = r"(?:^|\n)\s*(?:\d+(?:\.\d+)*\s*\.?\s*)?"
    cut = rf"(?is){number}(?:References|Bibliography|Works Cited|Acknowledge?ments?|Appendix\s*[A-Z]?|Supplementary\s+Materials?)\s*\n.*$"
    base = F.when(F.length(base) > 500, F.rtrim(F.regexp_replace(base, cut, ""))).otherwise(base)
    t = F.trim(text(title))
    return F.when(base == "", "").when(t != "", F.concat(t, F.lit(". "), base)).otherwise(base)


def grounding_share(answer: Column, context: Column) -> Column:
    """Share of the answer's words of six letters or more that the context holds."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text(answer)), F.lit(r"([a-z]{6,})"), F.lit(1)))
    held = F.filter(words, lambda w: F.contains(F.lower(text(context)), w))
    return F.when(F.size(words) > 0, F.size(held) / F.size(words)).otherwise(F.lit(1.0))
