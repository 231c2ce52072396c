"""Language identification by mixture inference: which languages a document holds, and in what proportions.

Each language has a model of byte trigrams inside words. A document's words are draws from a mixture of languages;
expectation-maximisation estimates the proportions, and the set of languages is the one whose likelihood, less a
penalty for each language in it, is highest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_ids, fold_of, map_texts
from .textkernels import LOWER, Texts, byte_class, doc_of

#: Documents whose fold is 2 of so many are held out.
FOLDS, HELD_OUT = 4, 2
#: Documents used for learning at most, chosen by the hash of their id.
MAX_SAMPLE = 12_000
#: Trigrams are hashed to so many bits.
BITS = 15
#: Added to each trigram count.
SMOOTH = 0.5
#: Iterations of expectation-maximisation over all languages, and over each nested set.
ROUNDS, SET_ROUNDS = 6, 3
#: Cost of one more language, in units of half the logarithm of the number of words.
PENALTY = 2.0
#: Texts of one kernel call; a word takes one row of likelihoods by language.
LIMIT = 1 << 20
UNDETERMINED = "und"

#: Bytes of words: ASCII letters and everything outside ASCII.
_LETTERS = byte_class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_ASCII_LETTERS = byte_class(bytes([*range(65, 91), *range(97, 123)]))
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Language values in order, and the log-probability of each hashed trigram in each (trigrams x languages)."""

    langs: list[str]
    logp: np.ndarray


def trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed trigram around each byte of a word (0 stands outside words), where each word's begin, and words in each text."""
    data = LOWER[texts.data]
    starts, ends, counts = texts.words(_LETTERS)
    size = ends - starts
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(starts - begin, size)
    here = data[at].astype(np.uint32)
    before, after = np.zeros_like(here), np.zeros_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    if len(begin):
        before[begin] = 0
        after[begin + size - 1] = 0
    code = (before << 16) | (here << 8) | after
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), begin, counts


def learn(documents: DataFrame, *, folds: int = FOLDS, held_out: int = HELD_OUT, max_sample: int = MAX_SAMPLE) -> Model:
    """Models from the whole texts of at most ``max_sample`` documents that have a lang and aren't held out."""
    marked = documents.where("lang is not null and text is not null and doc_id is not null").where(fold_of("doc_id", folds) != held_out).select("doc_id", "lang")
    sample = documents.select("doc_id", "text").join(bounded_ids(marked, max_sample).select("doc_id", "lang").distinct(), "doc_id").select("lang", "text")

    def count(batches):
        import pyarrow as pa

        from .textkernels import blocks

        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for first, last, texts in blocks(batch, limit=LIMIT):
                grams, begin, counts = trigrams(texts)
                size = np.diff(np.append(begin, len(grams)))
                lang = np.array(batch.column(0).slice(first, last - first).to_pylist(), dtype=object)
                of_gram = np.repeat(np.repeat(np.arange(len(counts)), counts), size)
                for name in set(lang.tolist()):
                    mine = grams[(lang == name)[of_gram]] if len(grams) else grams
                    totals[name] = totals.get(name, 0) + np.bincount(mine, minlength=1 << BITS)
        for name, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), type=pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))], names=["lang", "gram", "n"])

    table = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.full((1 << BITS, len(langs)), SMOOTH)
    counts[table["gram"].to_numpy(dtype=int), np.searchsorted(np.array(langs, dtype=object), table["lang"].to_numpy(dtype=object)) if langs else np.zeros(0, dtype=int)] += table["n"].to_numpy(dtype=float)
    return Model(langs, np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32))


def _mixture(like: np.ndarray, share: np.ndarray, edges: np.ndarray, doc: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``rounds`` of expectation-maximisation from ``share``, and the log-likelihood (without ``like``'s scale) at the last but one."""
    logs = np.zeros(len(counts))
    for r in range(rounds):
        post = like * share[doc]
        total = post.sum(axis=1)
        if r == rounds - 1:
            logs = np.bincount(doc, weights=np.log(total), minlength=len(counts))
        post /= total[:, None]
        share = segment_sums(post, edges, counts) / np.maximum(counts, 1)[:, None]
    return share, logs


def segment_sums(values: np.ndarray, edges: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Row sums by text; texts without words sum to 0."""
    out = np.zeros((len(counts), values.shape[1]))
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, edges[some], axis=0)
    return out


def infer(texts: Texts, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the most likely set's largest language (-1: no words), its proportion, and the proportions of all languages in the set."""
    k = len(model.langs)
    grams, begin, counts = trigrams(texts)
    if not k or not len(begin):
        return np.full(texts.n, -1), np.zeros(texts.n), np.zeros((texts.n, k))
    word = np.add.reduceat(model.logp[grams], begin, axis=0).astype(np.float64)
    edges, doc = np.cumsum(counts) - counts, doc_of(counts)
    top = word.max(axis=1)
    like = np.maximum(np.exp(word - top[:, None]), 1e-30)
    share, _ = _mixture(like, np.full((texts.n, k), 1 / k), edges, doc, counts, ROUNDS)
    rank = np.argsort(-share, axis=1, kind="stable")
    alone = segment_sums(np.log(like), edges, counts)
    best = alone.argmax(axis=1)
    rows = np.arange(texts.n)
    chosen = np.zeros((texts.n, k))
    chosen[rows, best] = 1.0
    cost = PENALTY * 0.5 * np.log(np.maximum(counts, 2))
    value = alone[rows, best] - cost
    # All texts try two and three languages; those whose value still rose at the last size go on, up to all languages.
    on = rows
    for size in range(2, k + 1):
        words = slice(None) if len(on) == texts.n else np.isin(doc, on)
        n = counts[on]
        mask = np.zeros((len(on), k))
        np.put_along_axis(mask, rank[on, :size], 1.0, axis=1)
        start = np.maximum(share[on], 1e-3) * mask
        mixed, logs = _mixture(like[words], start / start.sum(axis=1, keepdims=True), np.cumsum(n) - n, doc_of(n), n, SET_ROUNDS)
        worth = logs - size * cost[on]
        better = worth > value[on]
        chosen[on[better]], value[on[better]] = mixed[better], worth[better]
        if size >= 3:
            on = on[better]
            if not len(on):
                break
    lang = np.where(counts > 0, chosen.argmax(axis=1), -1)
    return lang, np.where(counts > 0, chosen.max(axis=1), 0.0), chosen * (counts > 0)[:, None]


def identify(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, then lang_pred, score (its proportion) and languages (the chosen set with proportions) of every row.

    Null, empty and letterless texts are ``und`` with score 0 and no languages. A tie goes to the language that sorts
    first. With nothing to learn from, every text with letters is ``und`` too. Repeated rows are judged each by itself.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a bounded number of trigrams for each language

    def run(texts: Texts, rows) -> list:
        own = shared.value
        lang, share, all_shares = infer(texts, own)
        unsure = texts.per_doc(_ASCII_LETTERS[texts.data]) == 0
        for d in np.flatnonzero(unsure & (lang >= 0)).tolist():
            if not _LETTER.search(texts.data[texts.offsets[d] : texts.offsets[d + 1]].tobytes().decode()):
                lang[d], share[d], all_shares[d] = -1, 0.0, 0.0
        names = [*own.langs, UNDETERMINED]
        import pyarrow as pa

        sets = [[{"lang": own.langs[j], "share": float(x[j])} for j in np.flatnonzero(x > 0).tolist()] for x in all_shares]
        return [pa.array([names[j] for j in lang.tolist()], type=pa.string()), share, pa.array(sets, type=pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]

    return map_texts(documents, keep or ["doc_id"], "lang_pred string, score double, languages array<struct<lang:string,share:double>>", run, limit=max(LIMIT // max(1, len(model.langs) // 8), 1 << 16))


def op2_language(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(documents, learn(documents)).select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "languages")
