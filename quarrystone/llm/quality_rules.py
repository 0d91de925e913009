"""Quality rules: text statistics and a learned decision list.

Statistics are native expressions over each whole text, so no text is
shuffled.  ``learn_rules`` grows and prunes threshold conjunctions by
sequential covering from the statistics of labelled documents;
``DecisionList.rule`` turns them into one ordered conditional expression.

Defined results: a null or empty text has no words and fails the base check;
null labels are ignored; with no label of either class the list is empty and
the base check alone decides; repeated rows are judged each for itself;
texts of any length count whole; a figure equal to a threshold passes an upward test and fails a
downward one; an empty table gives no rows; further columns of the input are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import ROW, words_of

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test: ratios, so that a rule means the same for any length.
FEATURES = ["mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio", "digit_ratio", "distinct_ratio", "short_ratio", "log_words"]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input row as ``ROW`` with BASE and FEATURES beside it."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), t.alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(ROW, words_of(F.col("t")).alias("w"), lines.alias("lines"))
    d = d.select(
        ROW, F.array_join("w", "").alias("solid"), F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.length(x) <= 3)).alias("n_short"),
    )
    three = F.transform(F.sequence(F.lit(1), F.col("n") - 2), lambda i: F.xxhash64(F.get("h", i - 1), F.get("h", i), F.get("h", i + 1)))
    d = d.withColumn("three", F.when(F.col("n") >= 3, three))
    found = F.sort_array(F.transform("three", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("found", F.when(F.size(F.array_distinct("three")) < F.size("three"), found))
    same = lambda x, k: F.coalesce(F.get("found", k)["x"] == x["x"], F.lit(False))
    twice = F.filter("found", lambda x, k: same(x, k - 1) | same(x, k + 1))
    d = d.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    without = lambda what: F.length("rare") - F.length(F.regexp_replace("rare", f"[{what}]+", ""))
    d = d.select(
        ROW, F.regexp_replace("solid", r"[a-z\x{DF}-\x{FF},.]+", "").alias("rare"), "n_lines", "n_short", F.col("n").cast("long").alias("n_words"), F.length("solid").cast("long").alias("word_chars"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size(F.array_distinct("h")).alias("n_distinct"),
    )
    d = d.withColumns({
        "n_symbols": without(SYMBOLS).cast("long"), "n_marks": without("!?"), "n_digits": without("0-9"),
        "n_upper": without(r"\p{Lu}"),
    })
    # A generator between: else a filter on the figures is pushed below them, and what
    # is computed once per text there is computed anew for each word.
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_digits", "n_upper", "n_distinct", "n_lines", "n_short"]
    d = d.select(ROW, F.explode(F.array(F.struct(*figures))).alias("of")).select(ROW, "of.*")
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return d.select(
        ROW, *BASE,
        per("word_chars", "n_words").alias("mean_word"), per("n_symbols", "word_chars").alias("symbol_ratio"), per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"), per("n_upper", "word_chars").alias("upper_ratio"), per("n_marks", "n_words").alias("mark_ratio"),
        per("n_digits", "word_chars").alias("digit_ratio"), per("n_distinct", "n_words").alias("distinct_ratio"), per("n_short", "n_words").alias("short_ratio"),
        F.log10(F.col("n_words") + F.lit(1.0)).alias("log_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, at_least, threshold): at_least tells ``>=`` from ``<``."""

    tests: tuple[tuple[str, bool, float], ...]
    hits: int
    misses: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_least, x in self.tests:
            out = out & ((F.col(name) >= F.lit(x)) if at_least else (F.col(name) < F.lit(x)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<'} {x:.4g}" for n, up, x in self.tests)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def rule(self) -> Column:
        """Number of the first rule that rejects a row, from 0; null where none does."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules) - 1, -1, -1):
            out = F.when(self.rules[k].column(), F.lit(k)).otherwise(out)
        return out


def _covers(tests, x, names) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, up, at in tests:
        v = x[:, names.index(name)]
        out &= (v >= at) if up else (v < at)
    return out


def _grow(x, bad, names, most_tests, cuts) -> list:
    """Adds the test of largest information gain until no good row is covered."""
    tests, on = [], np.ones(len(x), bool)
    while len(tests) < most_tests and (on & ~bad).any():
        p0, n0 = (on & bad).sum(), (on & ~bad).sum()
        best = (1e-9, None)
        for j, name in enumerate(names):
            for at in np.unique(np.quantile(x[on, j], cuts)):
                above = x[:, j] >= at
                for up, side in ((True, above), (False, ~above)):
                    p, n = (on & side & bad).sum(), (on & side & ~bad).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, (name, up, float(at)))
        if best[1] is None:
            break
        tests.append(best[1])
        on &= _covers(tests[-1:], x, names)
    return tests


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str] = FEATURES, *, most_rules: int = 16, most_tests: int = 4, precision: float = 0.9, least: int = 3) -> DecisionList:
    """Sequential covering: each rule is grown on two thirds of the rows left, loses
    the last tests that don't help on the other third, and stays if it is precise on
    all rows left.  Rows must come in a fixed order: the learner draws nothing."""
    x, bad = np.asarray(x, float), np.asarray(bad, bool)
    left, rules = np.ones(len(x), bool), []
    cuts = np.linspace(0.01, 0.99, 50)
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and (left & bad).sum() >= least and (~bad).any():
        g, p = left & ~third, left & third
        if not (g & bad).any():
            break
        tests = _grow(x[g], bad[g], names, most_tests, cuts)
        worth = []
        for k in range(1, len(tests) + 1):
            on = _covers(tests[:k], x[p], names)
            hit, miss = (on & bad[p]).sum(), (on & ~bad[p]).sum()
            worth.append(((hit - 3 * miss) / (hit + miss + 1.0), -k))
        tests = tests[: -max(worth)[1]] if worth else []
        on = left & _covers(tests, x, names) if tests else np.zeros(len(x), bool)
        hit, miss = int((on & bad).sum()), int((on & ~bad).sum())
        if hit < least or hit < precision * (hit + miss):
            break
        rules.append(Rule(tuple(tests), hit, miss))
        left &= ~on
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", quality: str = "quality", max_rows: int = 20_000, **options) -> DecisionList:
    """Learns from at most ``max_rows`` labelled documents, those of smallest id hash; of an
    id with several rows from the smallest figures.

    Only ids and numbers of this bounded sample come to the driver."""
    y = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(quality).alias("__y"))
    y = y.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    of = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = statistics(of.join(F.broadcast(y), "__id")).where(~base_failed()).select(f"{ROW}.__id", f"{ROW}.__y", F.struct(*FEATURES).alias("f"))
    rows = each.groupBy("__id", "__y").agg(F.min("f").alias("f")).select("__id", "__y", "f.*").collect()
    rows = sorted(rows, key=lambda r: tuple(r[2:]) + tuple(r[:2]))
    rng = np.random.default_rng(0).permutation(len(rows))
    rows = [rows[k] for k in rng]
    return learn_rules(np.array([r[2:] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] == 0 for r in rows], bool), **options)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``ROW`` with statistics, base_failed, rule and kept."""
    s = statistics(docs).withColumn("base_failed", base_failed())
    s = s.withColumn("rule", rules.rule())
    return s.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
