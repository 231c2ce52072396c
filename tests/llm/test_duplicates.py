"""Decontamination, near-duplicates, repeated strings, components."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cadenza.llm import components, decontamination, near_duplicates, repeats

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def contaminated(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(str(item))
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if here := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= here
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_contamination(spark, odd, docs, block):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()] + [(900, None), (901, ""), (902, "Two words"), (903, "word WORD"), (904, "x" * 5000), (904, "five one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for table in (docs, odd):
        want = sorted(map(repr, contaminated([(r.doc_id, r.text) for r in table.collect()], items)))
        assert sorted(repr(tuple(r)) for r in decontamination.contamination(table, benchmark, block_bytes=block).collect()) == want
        bad = {t for (_, t), x in zip([(r.doc_id, r.text) for r in table.collect()], contaminated([(r.doc_id, r.text) for r in table.collect()], items), strict=True) if x[-1]}
        left = decontamination.drop_contaminated(table.withColumn("clean", F.lit(1)).withColumn("__bad_id", F.lit(2)), benchmark, block_bytes=block)
        assert left.columns == [*table.columns, "clean", "__bad_id"]
        assert sorted(map(repr, left.drop("clean", "__bad_id").collect())) == sorted(repr(r) for r in table.collect() if r.text not in bad)


def test_contamination_empty(spark, odd, nothing):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert decontamination.contamination(nothing, benchmark).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(odd, benchmark.limit(0)).collect())


def test_longest_matches(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "before " + " ".join(f"w{i}" for i in range(5, 30)) + " after")], "doc_id long, text string")
    (frame,) = decontamination.find_matches(docs, spark.createDataFrame([("q", text)], "item_id string, text string"))
    hits = frame.first().hits
    assert max(h.length for h in hits) == 25 and [h.start for h in hits] == list(range(1, 17)) and {h.item for h in hits} == {"q"}


def shingle_set(text, k):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def by_brute_force(rows, k):
    sets = {d: shingle_set(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed, groups=4, size=60, words=90):
    """Groups of near copies around the threshold, with chains: too many for one small node."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        first = [f"g{g}w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            copy = list(first)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed, monkeypatch):
    if seed == 2:  # every group is too large for a task
        monkeypatch.setattr(near_duplicates, "GROUP_VERTICES", 10)
        monkeypatch.setattr(near_duplicates, "SMALL", 8)
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == by_brute_force(rows, 4)


def test_near_duplicates_odd(spark, odd, nothing):
    rows = near_duplicates.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    want = by_brute_force([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None], 5)
    assert all((r.n_shingles, r.component_id, r.kept) == (*want[d], want[d][1] == d) for d, x in by_id.items() if d is not None for r in x)
    assert by_id[None][0].component_id is None and by_id[None][0].kept and len(by_id[5]) == 2
    assert near_duplicates.near_duplicates(nothing).count() == 0
    assert near_duplicates.drop_near_duplicates(odd).columns == odd.columns


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(5, 5)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {v: r for v, r in root.items() if v != r}


def cut(rows, width):
    seen = Counter(t[i : i + width] for _, t in rows for i in range(len(t) - width + 1))
    for d, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        yield d, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("largest", [20_000, 2, 0])
def test_repeats(spark, odd, largest):
    rng = random.Random(7)
    line = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    common, texts = line(130), []
    for _ in range(12):
        texts.append(line(rng.randrange(80)) + common[rng.randrange(20) : 130 - rng.randrange(20)] + line(rng.randrange(80)))
    texts += [texts[0], "z" * 300, "ab" * 150, common + common, "z" * 81]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(cut([(d, t.encode()) for d, t in rows], 80))
    assert sorted(tuple(r)[:5] for r in repeats.repeats(df, width=80, max_class=largest).collect()) == want
    if largest == 20_000:
        rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
        assert sorted(map(repr, cut(rows, 400))) == sorted(repr(tuple(r)[:5]) for r in repeats.repeats(odd).collect())
        assert repeats.repeats(odd.limit(0)).count() == 0


@pytest.mark.parametrize("largest", [20_000, 0])
def test_passages(spark, largest):
    """Words in passages of 12 words that stand elsewhere too, whatever the white space between them."""
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    common, texts = some(30), []
    for _ in range(25):
        a, n = rng.randrange(12), rng.randrange(8, 18)
        texts.append((" " if rng.random() < 0.5 else "\n ").join(some(rng.randrange(40)) + common[a : a + n] + some(rng.randrange(40))))
    texts += [texts[3], "z " * 60, "", None, "one two"]
    got = {r.doc_id: (r.n_passage_words, r.n_passages) for r in repeats.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), passage=12, max_class=largest).collect()}
    split = [tuple(SPACED.findall(t or "")) for t in texts]
    seen = Counter(w[i : i + 12] for w in split for i in range(len(w) - 11))
    want = {}
    for d, w in enumerate(split):
        hit = [False] * len(w)
        for i in range(len(w) - 11):
            if seen[w[i : i + 12]] > 1:
                hit[i : i + 12] = [True] * 12
        want[d] = sum(hit), sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
    assert got == want and sum(n > 0 for n, _ in want.values()) > 5


def test_pipeline_keeps_the_text_of_copies(spark):
    """Exact and near copies that are a third of a source keep one whole text; a line of the other documents is still cut."""
    import corpus_pipeline

    words = lambda seed: "\n".join(" ".join(f"w{seed}x{line}y{i}" for i in range(12)) for line in range(10))
    rows = [(i, words("own" + str(i)) + "\nAll rights reserved", "s") for i in range(60)]
    rows += [(100 + i, words("same"), "s") for i in range(15)]
    rows += [(200 + i, words("near").replace(f"wnearx{i % 10}y{i % 12}", f"edit{i}"), "s") for i in range(15)]
    rows += [(300 + i, words("few"), "t") for i in range(4)] + [(310 + i, words("t" + str(i)), "t") for i in range(20)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    cut = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert cut == {i: t.removesuffix("\nAll rights reserved") for i, t, _ in rows}
    left = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, corpus_pipeline.line_dedup(spark, docs, ""), "").collect()}
    assert set(left) == {*range(60), 100, 200, 300, *range(310, 330)} and left[100] == words("same") and left[200] and left[300] == words("few")


def test_clashing_names(spark, odd):
    """Columns named like the operators' own, and rows that share an id or have none."""
    from cadenza.llm import boilerplate, toxicity

    clash = odd.withColumns({c: F.lit(7) for c in ("__lines", "__host", "__drop", "__left", "__text", "__text__", "__gone", "row", "name", "kept", "text_", "t")})
    rows = sorted(map(repr, clash.collect()))
    assert sorted(map(repr, boilerplate.drop_boilerplate(clash, host=F.col("source"), text_col="text").collect())) == rows
    left = near_duplicates.drop_near_duplicates(clash)
    assert left.columns == clash.columns and left.count() == clash.count()
    twice = spark.createDataFrame([(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words under that same id"), (None, "a b c d e f g")], "doc_id long, text string")
    assert sorted(map(repr, near_duplicates.drop_near_duplicates(twice).collect())) == sorted(repr(r) for r in twice.collect() if (r.doc_id, r.text[0]) != (5, "a"))
    assert sorted(map(repr, toxicity.drop_toxic(clash, spark.createDataFrame([], "doc_id long, toxic int")).collect())) == rows
    assert boilerplate.drop_boilerplate(clash, host=F.col("source"), text_col="text", count_col="n_words").columns == [*(c for c in clash.columns if c != "n_words"), "n_words"]


def test_trees_recall():
    """Pairs at the threshold share a child of some tree's root: the trees alone, without what follows."""
    import numpy as np

    rng = np.random.default_rng(5)
    n, shared, own = 2000, 160, 20
    both = rng.integers(0, 2**63, (n, shared), dtype=np.uint64)
    sides = [np.concatenate((both, rng.integers(0, 2**63, (n, own), dtype=np.uint64)), axis=1) for _ in range(2)]
    keys = [near_duplicates.root_keys(near_duplicates.minwise(s.ravel(), np.full(n, shared + own))) for s in sides]
    mins = [near_duplicates.minwise(s.ravel(), np.full(n, shared + own)) & np.uint32(255) for s in sides]
    together = (keys[0] == keys[1]).sum(axis=1)
    assert (together > 0).mean() >= 0.999 and 0.75 < together.mean() / keys[0].shape[1] < 0.85
    assert ((mins[0] == mins[1]).sum(axis=1) >= near_duplicates.AGREE).mean() >= 0.999


def test_merged_transforms():
    """Repeated strings and common prefixes from merged shards, against brute force."""
    from cadenza.llm import bwt

    rng, width = random.Random(4), 9
    common = bytes(rng.choice(b"ab") for _ in range(40))
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(25))) + common[rng.randrange(15) : 40 - rng.randrange(15)] for _ in range(24)] + [b"", b"aaaaaaaaaaaaaaaa", common]
    whole = b"".join(t + b"\0" for t in texts)
    shards, base = [], 0
    for k in range(0, 27, 9):
        shards.append(bwt.build(texts[k : k + 9], base))
        base += sum(len(t) + 1 for t in texts[k : k + 9])
    first, _ = bwt.merge(shards[0], shards[1], width)
    merged, lcp = bwt.merge(first, shards[2], width)
    seen = Counter(whole[i : i + width] for i in range(len(whole)))
    want = [i for i in range(len(whole)) if b"\0" not in whole[i : i + width] and len(whole[i : i + width]) == width and seen[whole[i : i + width]] > 1]
    assert bwt.repeated(merged).tolist() == want and len(want) > 50
    at = merged.place.tolist()
    assert sorted(at) == list(range(len(whole)))
    for i in range(len(texts) + 1, len(at)):
        x, y = whole[at[i - 1] : at[i - 1] + width].split(b"\0")[0], whole[at[i] : at[i] + width].split(b"\0")[0]
        assert x[: lcp[i]] == y[: lcp[i]] and (lcp[i] == width or x[: lcp[i] + 1] != y[: lcp[i] + 1] or len(x) == lcp[i] or len(y) == lcp[i])
