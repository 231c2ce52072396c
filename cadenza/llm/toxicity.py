"""Toxic passages as maximum-scoring segments of token log-odds.

A word is known by itself and by its first letters, which also reach inflected and compound forms. Each such form's
score is its log-odds of toxic against other texts under an informative Dirichlet prior, counted once for each distinct
text so that copies and repetition inside a text prove nothing. A word has the score of its strongest significant
form; words without one cost a small constant. What is significant is told by the exponential bound of the binomial
tail, so that evidence grows with the labels. One linear scan finds all maximal segments; each segment's score is set
against the extreme-value law of the largest segment that a harmless text of that length would have, and the excesses
are summed and turned into a probability by a logistic curve. The curve is fitted on scores of texts that took no part
in learning the words that score them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_ids, fold_of, free_name, map_texts, written
from .textkernels import ALNUM, Texts, U, doc_of, in_doc, mix

#: Documents whose fold is 0 of so many are held out.
FOLDS = 5
#: Labelled documents used for learning at most, chosen by the hash of their id.
MAX_LABELLED = 20_000
#: The Dirichlet prior is worth the square root of so many times the number of learning texts.
PRIOR_FACTOR = 2.0
#: A form counts as significant if so few forms are expected to reach its share of toxic texts by chance, and from so high a score.
FALSE_FORMS, MIN_SCORE = 0.1, 2.0
#: Parts of the sample for the logistic curve: each is scored by the words of the others.
PARTS = 2
#: Bytes of the beginnings that count as forms, besides the whole word.
PREFIXES = (3, 4, 5)
#: What any other word costs.
DRIFT = 0.05
#: Bound of a word's score either way.
MAX_SCORE = 8.0


@dataclass
class Model:
    """Scores of significant words by hash, and the calibration."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=U))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    bias: float = -20.0

    def level(self, n_words: int) -> float:
        """The scaled score that a harmless text of so many words is expected to reach; at least that of no segment."""
        return max(0.0, self.log_k + math.log(max(n_words, 1)))


def forms(texts: Texts) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The words' forms by kind (hashes, and the numbers of the words that have them), and the number of words in each text."""
    low = texts.lowered()
    starts, ends, counts = low.words(ALNUM)
    out = [(low.hashes(starts, ends), np.arange(len(starts)))]
    for k in PREFIXES:
        at = np.flatnonzero(ends - starts >= k)
        out.append((mix(low.hashes(starts[at], starts[at] + k) + U(k)), at))
    return out, counts


def maximal_segments(position: list[int], score: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, last word) of a text by one linear scan with a stack.

    ``position`` and ``score`` list the significant words; every word between them costs ``drift``. Segments begin and
    end at positive words, so only those are visited.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # total before, total after, first, last, place of the nearest earlier one that starts lower
    total, seen = 0.0, -1
    for p, s in zip(position, score, strict=True):
        before = total - drift * (p - seen - 1)
        total, seen = before + s, p
        if s <= 0:
            continue
        lo, hi, first = before, total, p
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= lo:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= hi:
                stack.append((lo, hi, first, p, j))
                break
            lo, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(hi - lo, first, last) for lo, hi, first, last, _ in stack]


def segments_of(texts: Texts, model: Model) -> tuple[np.ndarray, list[list[tuple[float, int, int]]], list[np.ndarray]]:
    """The number of words of each text, its maximal segments, and the scores of its significant words."""
    kinds, counts = forms(texts)
    found: list[list] = [[] for _ in range(texts.n)]
    marked = [np.zeros(0)] * texts.n
    best = np.zeros(int(counts.sum()))
    for keys, word in kinds if len(model.hashes) else []:
        place = np.minimum(np.searchsorted(model.hashes, keys), len(model.hashes) - 1)
        hit = np.flatnonzero(model.hashes[place] == keys)
        at, value = word[hit], model.scores[place[hit]]
        best[at] = np.where(np.abs(value) > np.abs(best[at]), value, best[at])
    at = np.flatnonzero(best)
    if len(at):
        doc, begin, score = doc_of(counts)[at], np.cumsum(counts) - counts, best[at]
        cuts = np.searchsorted(doc, np.arange(texts.n + 1))
        for d in np.unique(doc).tolist():
            a, b = cuts[d], cuts[d + 1]
            marked[d] = score[a:b]
            found[d] = maximal_segments((at[a:b] - begin[d]).tolist(), score[a:b].tolist(), DRIFT)
    return counts, found, marked


def evidence(n_words: int, scores: list[float], model: Model) -> float:
    """Summed excess of the significant segments over what a harmless text of that length reaches; without any, the largest one's shortfall."""
    level = model.level(n_words)
    over = [model.rate * s - level for s in scores]
    above = [x for x in over if x > 0]
    return sum(above) if above else max([*over, -level])


def probability(x: float, model: Model) -> float:
    z = model.slope * x + model.bias
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _learn_words(sample: DataFrame) -> Model:
    """Scores from the sample's word counts by label."""

    def count(batches):
        import pyarrow as pa

        from .textkernels import blocks

        for batch in batches:
            for first, last, texts in blocks(batch):
                toxic = batch.column(0).slice(first, last - first).to_numpy(zero_copy_only=False).astype(bool)
                kinds, counts = forms(texts)
                doc = doc_of(counts)
                for keys, word in kinds:
                    _, once = np.unique(in_doc(keys, doc[word]), return_index=True)
                    form, inverse = np.unique(keys[once], return_inverse=True)
                    n = np.bincount(inverse, minlength=len(form))
                    t = np.bincount(inverse[toxic[doc[word[once]]]], minlength=len(form))
                    yield pa.RecordBatch.from_arrays([pa.array(form.view(np.int64)), pa.array(t.astype(np.int64)), pa.array((n - t).astype(np.int64))], names=["h", "t", "o"])

    sizes = {bool(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_t, n_o = sizes.get(True, 0), sizes.get(False, 0)
    if not n_t or not n_o:
        return Model()
    counted = sample.select("toxic", "text").mapInArrow(count, "h long, t long, o long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    # Forms seen in a few texts can't be significant. What is left has at most one row for each form of the bounded sample.
    table = counted.where("t + o >= 5").toPandas()
    t, o = table["t"].to_numpy(dtype=float), table["o"].to_numpy(dtype=float)
    worth = math.sqrt(PRIOR_FACTOR * (n_t + n_o))
    prior = worth * (t + o) / (n_t + n_o)
    odds = lambda y, n: np.log((y + prior) / (n + worth - y - prior + 0.5))
    delta = odds(t, n_t) - odds(o, n_o)
    # The chance of a share as far from that of all texts is at most exp(-divergence).
    share = n_t / (n_t + n_o)
    part = lambda y, p: y * np.log(np.maximum(y, 1) / ((t + o) * p))
    divergence = part(t, share) + part(o, 1 - share)
    use = (divergence >= math.log(max(len(t), 1) / FALSE_FORMS)) & (np.abs(delta) >= MIN_SCORE)
    hashes = table["h"].to_numpy(dtype=np.int64).view(U)[use]
    order = np.argsort(hashes)
    return Model(hashes[order], np.clip(delta[use][order], -MAX_SCORE, MAX_SCORE))


def _fit_rate(model: Model, harmless: list[list[float]], words: int) -> float:
    """Rate of the extreme-value law: the positive root of sum p exp(rate * score) = 1 over the words of harmless texts."""
    scores, n = np.unique(np.concatenate([np.array(x) for x in harmless] or [np.zeros(0)]), return_counts=True)
    share = n / max(words, 1)
    if not (scores > 0).any():
        return 1.0
    moment = lambda r: float((share * np.exp(r * scores)).sum() + (1 - share.sum()) * math.exp(-r * DRIFT) - 1)
    lo, hi = 1e-6, 1.0
    while moment(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if moment(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton steps with a light ridge."""
    scale = max(float(np.std(x)), 1e-9)
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w, p0 = np.zeros(2), min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    w[1] = math.log(p0 / (1 - p0))
    loss = lambda v: float(np.logaddexp(0, a @ v).sum() - y @ (a @ v) + 0.5 * v @ v * 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (p - y) + 1e-3 * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
    return max(float(w[0] / scale), 0.0), float(w[1])


def learn(documents: DataFrame, labels: DataFrame, *, folds: int = FOLDS, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from at most ``max_labelled`` labelled documents whose fold isn't 0.

    Rows without a label, and labels or rows with a null id, teach nothing. Equal texts are one; one that is labelled both
    ways is toxic. Without toxic texts, without others, or without a significant word the model scores about 0.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold_of("doc_id", folds) != 0)
    sample = documents.select("doc_id", "text").join(bounded_ids(marked, max_labelled), "doc_id").groupBy("text").agg((F.max("toxic") == 1).alias("toxic"))
    sample = written(sample, "sample")  # read several times
    model = _learn_passages(sample, sample.limit(0))[0]
    if not len(model.hashes):
        return model
    part = F.pmod(F.xxhash64("text"), F.lit(PARTS))
    fitted = [_learn_passages(sample.where(part != i), sample.where(part == i)) for i in range(PARTS)]
    model.slope, model.bias = _logistic(np.concatenate([x for _, x, _ in fitted]), np.concatenate([y for _, _, y in fitted]))
    return model


def _learn_passages(sample: DataFrame, others: DataFrame) -> tuple[Model, np.ndarray, np.ndarray]:
    """Words and extreme-value law of ``sample``, and the evidence and label of each of ``others``."""
    model = _learn_words(sample)

    def peaks(texts: Texts, _rows) -> list:
        counts, found, marked = segments_of(texts, model)
        return [counts, [[s for s, _, _ in x] for x in found], marked]

    made = "n long, scores array<double>, marked array<double>"
    if len(model.hashes):
        harmless = map_texts(sample.where("not toxic"), [], made, peaks).toPandas()
        model.rate = _fit_rate(model, list(harmless["marked"]), int(harmless["n"].sum()))
        excess = [model.rate * max([*s, 0.0]) - math.log(max(n, 1)) for n, s in zip(harmless["n"], harmless["scores"], strict=True)]
        model.log_k = float(np.mean(excess)) - 0.5772156649
    seen = map_texts(others, ["toxic"], made, peaks).toPandas()
    x = np.array([evidence(n, list(s), model) for n, s in zip(seen["n"], seen["scores"], strict=True)])
    return model, x, seen["toxic"].to_numpy(dtype=float)


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, then score (0 to 1), predicted and passages (score, first and last word of each significant one) of every row.

    Null and empty texts have no words and get the score of no evidence. Ties between passages keep both. Repeated rows
    are scored each by itself. An untrained model (no labels, or of one kind) scores about 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most the distinct words of the learning sample

    def run(texts: Texts, _rows) -> list:
        own = shared.value
        counts, found, _ = segments_of(texts, own)
        scores = [probability(evidence(n, [s for s, _, _ in f], own), own) for n, f in zip(counts.tolist(), found, strict=True)]
        passages = [[{"score": s, "first": a, "last": b} for s, a, b in f if own.rate * s > own.level(n)] for n, f in zip(counts.tolist(), found, strict=True)]
        import pyarrow as pa

        kind = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))
        return [scores, [int(s >= 0.5) for s in scores], pa.array(passages, type=kind)]

    return map_texts(documents, keep or ["doc_id"], "score double, predicted int, passages array<struct<score:double,first:long,last:long>>", run)


def drop_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``documents`` without the rows predicted toxic; all columns as they are."""
    model = learn(documents, labels, **options)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(texts: Texts, _rows) -> list:
        counts, found, _ = segments_of(texts, shared.value)
        return [[probability(evidence(n, [s for s, _, _ in f], shared.value), shared.value) < 0.5 for n, f in zip(counts.tolist(), found, strict=True)]]

    name = free_name("kept", documents.columns)
    return map_texts(documents, documents.columns, f"`{name}` boolean", run).where(F.col(name)).drop(name)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select("doc_id", (fold_of("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted", "passages")
