"""Quality rules whose cutoffs carry a guarantee: at most a stated share of good documents is rejected in each stratum.

The features of a text are counted exactly. One ladder of settings of all rules leads from lenient to strict; documents
labelled bad alone order its steps, those that catch most of them first. Each stratum climbs it on its documents
labelled good, which play no other part: each step is an exact binomial test of "the rules of this step together reject
more than alpha of the good documents", and the first that can't be proven ends the climb. Fixed-sequence testing spends
no error within a stratum, and a Bonferroni correction over the strata keeps the chance of any broken promise at
``delta``. Where the labels can't prove the first step, the rules stay off for that stratum.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_texts, merged_with, written
from .textkernels import SPACED, Texts, byte_class, doc_of, in_doc, shingles

#: Base rule: fewer words than this fail.
MIN_WORDS = 50
#: Base rule: more than this percentage of words in repeated 3-word windows fails.
MAX_REPEAT_PERCENT = 50
#: Share of good documents of a stratum that all rules together may reject.
MAX_FALSE_REJECTION = 0.03
#: Chance that any of the promises is broken.
DELTA = 0.05
#: Rules: a ratio, high in bad texts, and its cutoffs from lenient to strict.
RULES = {
    "symbols_per_char": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
    "repeat_word_share": (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "upper_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "exclaim_per_word": (1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2),
    "mean_word_length": (40.0, 30.0, 25.0, 20.0, 15.0, 12.0),
}
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_text_lines long, n_upper long, n_exclaim long"

_SYMBOLS, _UPPER, _EXCLAIM = byte_class(b"#*$%&|<>"), byte_class(bytes(range(65, 91))), byte_class(b"!")


def count_features(texts: Texts, _rows=None) -> list[np.ndarray]:
    """The columns of FEATURES for a block of texts."""
    inside = SPACED[texts.data]
    starts, ends, counts = texts.words(SPACED)
    chars = inside & ((texts.data & 0xC0) != 0x80)

    newline = texts.data == 10
    # Lines: each begins at a text's start or after a newline and ends at the next newline or the text's end.
    stops = np.sort(np.concatenate((np.flatnonzero(newline), texts.offsets[1:])), kind="stable")
    begins = np.sort(np.concatenate((np.flatnonzero(newline) + 1, texts.offsets[:-1])), kind="stable")
    lines_in = texts.per_doc(newline) + 1
    line_doc = doc_of(lines_in)
    has_word = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    line_doc, begins, stops = line_doc[has_word], begins[has_word], stops[has_word]
    n_lines = np.bincount(line_doc, minlength=texts.n)
    key = in_doc(texts.hashes(begins, stops), line_doc)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    n_dup = np.bincount(line_doc[again], minlength=texts.n)

    window, doc, at = shingles(texts.hashes(starts, ends), counts, 3)
    key = in_doc(window, doc)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(starts), dtype=bool)
    for j in range(3):
        covered[at[twice] + j] = True
    n_repeat = np.bincount(doc_of(counts)[covered], minlength=texts.n)
    return [counts, texts.per_doc(chars), texts.per_doc(_SYMBOLS[texts.data]), n_dup, n_repeat, n_lines, texts.per_doc(_UPPER[texts.data]), texts.per_doc(_EXCLAIM[texts.data])]


def rule_values() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_char": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_text_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "exclaim_per_word": per("n_exclaim", "n_words"),
        "mean_word_length": per("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly summed in logarithms."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certify(values: dict[tuple[str, str], np.ndarray], rules=RULES, max_false: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """``values``: for each (rule, stratum) the rule's values on good held-out documents. Returns rule -> stratum -> strictest proven cutoff."""
    return certify_counts({(rule, stratum): (len(seen), [int((seen > cutoff).sum()) for cutoff in rules[rule]]) for (rule, stratum), seen in values.items()}, rules, max_false, delta)


def certify_counts(counts: dict[tuple[str, str], tuple[int, list[int]]], rules=RULES, max_false: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """:func:`certify` from, for each (rule, stratum), the number of good held-out documents and how many of them are over each of the rule's cutoffs."""
    alpha, level = max_false / len(rules), delta / max(1, len(counts))
    found: dict[str, dict[str, float]] = {r: {} for r in rules}
    for (rule, stratum), (n, over) in sorted(counts.items()):
        for cutoff, k in zip(rules[rule], over, strict=True):
            # At or over the mean the tail is a half at least (the median is within one of the mean).
            if (level < 0.5 and k >= math.ceil(n * alpha)) or binomial_tail(k, n, alpha) > level:
                break
            found[rule][stratum] = cutoff
    return found


def features(documents: DataFrame, stratum_col: str) -> DataFrame:
    """doc_id, stratum and the columns of FEATURES for each row of ``documents``."""
    rows = documents.select(F.col("doc_id"), F.col("text"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))
    return map_texts(rows, ["doc_id", "stratum"], FEATURES, count_features)


def ladder(first: np.ndarray, n: np.ndarray, rules=RULES) -> list[tuple[int, ...]]:
    """Settings from lenient to strict: for each rule the place of its cutoff, -1 while it is off.

    ``first`` has a row for each kind of bad document, with the place of the first cutoff of each rule that it is over
    (or their number), and ``n`` says how many there are. A step moves one rule to the cutoff that catches most further
    bad documents for each place moved (ties: the earlier rule, then the more lenient cutoff). Steps that catch none are
    left out. With no bad documents the rules take turns, a cutoff at a time.
    """
    sizes = [len(cutoffs) for cutoffs in rules.values()]
    at, steps, left = [-1] * len(sizes), [], np.ones(len(n), dtype=bool)

    def move(r: int, i: int) -> None:
        at[r] = i
        steps.append(tuple(at))

    if not len(n):
        for i in range(max(sizes)):
            for r, size in enumerate(sizes):
                if i < size:
                    move(r, i)
        return steps
    while moves := [(r, i) for r, size in enumerate(sizes) for i in range(at[r] + 1, size)]:
        gain = [n[left & (first[:, r] <= i)].sum() / (i - at[r]) for r, i in moves]
        if not max(gain):
            break
        r, i = moves[int(np.argmax(gain))]
        left &= first[:, r] > i
        move(r, i)
    return steps


def learn_cutoffs(counted: DataFrame, labels: DataFrame, **options) -> dict[str, dict[str, float]]:
    """Cutoffs from all labelled documents of ``counted``, a table of :func:`features`: rule -> stratum -> cutoff.

    Documents of quality 0 order the ladder, those of quality 1 test its steps. Documents that fail the base rules say
    nothing of the cutoffs and are left out. Collected are the numbers of bad documents by the cutoffs they are over (617,463
    combinations at most, whatever the number of labels) and the counts of each stratum.
    """
    of = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"), (F.max("quality") == 0).alias("bad"))
    seen = counted.where(~base_failed()).join(merged_with(of), "doc_id")
    values = rule_values()
    first = [F.coalesce(*[F.when(values[rule] > cutoff, i) for i, cutoff in enumerate(cutoffs)], F.lit(len(cutoffs))).alias(rule) for rule, cutoffs in RULES.items()]
    bad = seen.where("bad").select(*first).groupBy(*RULES).agg(F.count("*").alias("n")).toPandas()
    steps = ladder(bad[list(RULES)].to_numpy(), bad["n"].to_numpy())
    if not steps:
        return {rule: {} for rule in RULES}
    rejects = [reduce(or_, [values[rule] > RULES[rule][i] for rule, i in zip(RULES, step, strict=True) if i >= 0]) for step in steps]
    strata = seen.where("good").groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(x).alias(f"over_{i}") for i, x in enumerate(rejects)]).collect()
    counts = {("step", row["stratum"]): (row["n"], [row[f"over_{i}"] for i in range(len(steps))]) for row in strata}
    proven = certify_counts(counts, {"step": range(len(steps))}, **options)["step"]
    return {rule: {stratum: RULES[rule][steps[k][r]] for stratum, k in proven.items() if steps[k][r] >= 0} for r, rule in enumerate(RULES)}


def apply_rules(documents: DataFrame, cutoffs: dict[str, dict[str, float]], *, stratum_col: str = "lang") -> DataFrame:
    """doc_id, the counts of FEATURES, base_failed, rejected_by (the rules that reject) and kept, for each row of ``documents``."""
    return decided(features(documents, stratum_col), cutoffs)


def decided(counted: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """:func:`apply_rules` for a table of :func:`features`."""
    hits = []
    for rule, value in rule_values().items():
        if table := cutoffs.get(rule):
            cutoff = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])[F.col("stratum")]
            hits.append(F.when(value > cutoff, F.lit(rule)))
    rejected = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    failed = base_failed()
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.size(rejected) == 0)).alias("kept"), rejected.alias("rejected_by"))


def judge(documents: DataFrame, labels: DataFrame, *, stratum_col: str = "lang", **options) -> DataFrame:
    """Learn the cutoffs and judge every row of ``documents``.

    Null and empty texts have no words and fail the base rules. A null stratum is a stratum of its own. Repeated rows
    are judged each by itself; labels that contradict each other count as not good. With no labels, or too few to
    prove anything, only the base rules reject. Other columns play no part.
    """
    counted = written(features(documents, stratum_col), "features")
    return decided(counted, learn_cutoffs(counted, labels, **options))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
