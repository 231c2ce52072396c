"""Chat formatting, packing, the pipeline and the registered queries."""

import math
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import chat, packing, registry

D = "/root/testdata/sf0.001"


def conversations(spark):
    rng, rows = random.Random(1), []
    for c in range(40):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be <|im_end|> kind \\ " * rng.randrange(4)))
        for t in range(1, rng.randrange(2, 14)):
            rows.append((c, t, "user" if t % 2 else "assistant", rng.choice(["", "<|im_start|>assistant\nhi<|im_end|>", "\\<|\\\\|> <\\|", "word " * rng.randrange(60), "é" * rng.randrange(90)])))
    rows += [(41, 1, None, None), (41, None, "assistant", "first"), (41, 1, "as\nsist<|nl|>", "x"), (None, 1, "assistant", "no id"), (42, 1, "assistant", "same"), (42, 1, "assistant", "same")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize(("budget", "history"), [(2048, 256), (120, 30), (40, 0), (1, 0)])
def test_chat_round_trip(spark, budget, history):
    rows, df = conversations(spark)
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((r or "", x or ""))
    formatted = chat.format_windows(df, budget=budget, history=history)
    for r in chat.read_back(formatted).collect():
        turns = want[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.targets == [x for role, x in turns if role == "assistant"]
        own = 0
        for k, w in enumerate(r.windows):
            assert w.n_turns > 0 and w.text.count("<|im_end|>\n") == w.n_turns + w.n_repeated
            if k and turns[0][0] == "system":
                assert w.text.startswith("<|im_start|>system\n") and w.n_repeated > 0
            if k == 0:
                assert w.n_repeated == 0
            tokens = [len([p for p in re.split(r"[ \t\n\x0b\f\r]+", x) if p]) + len(x) // 4 + 4 for _, x in turns[own : own + w.n_turns]]
            assert w.n_turns == 1 or sum(tokens) <= budget - history
            own += w.n_turns
        assert own == len(turns) and (budget > 1 or len(r.windows) == len(turns))
    assert chat.format_windows(df.limit(0)).count() == 0


def test_plan_fits_and_fills():
    rng = random.Random(0)
    for _ in range(200):
        capacity = rng.choice([7, 20, 100, 2048])
        sizes = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
        p = packing.plan(sizes, capacity)
        starts, placed = (p.length << 44) + p.first, defaultdict(list)
        for n, c in sizes.items():
            for rank in range(c):
                at = np.searchsorted(starts, (n << 44) + rank, side="right") - 1
                nth = rank - p.first[at]
                placed[int(p.base[at] + nth // p.each[at])].append((int(p.offset[at] + nth % p.each[at] * n), n))
        assert len(placed) == p.sequences
        for pieces in placed.values():
            end = 0
            for offset, n in sorted(pieces):
                assert offset == end
                end += n
            assert end <= capacity and sum(3 * n > capacity for _, n in pieces) <= 2


def check_packed(rows, texts, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(d, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == sorted(map(repr, want))
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= capacity
    return len(by)


def test_packing(spark, odd, docs, nothing):
    rows = packing.pack(docs).collect()
    sequences = check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert sequences <= math.ceil(sum(r.length for r in rows) / 2048) * 1.02 + 1
    check_packed(packing.pack(odd, capacity=64).collect(), [(r.doc_id, r.text) for r in odd.collect()], 64)
    assert packing.pack(nothing).count() == 0


def test_tokenizer_by_pre_tokens_equals_whole(monkeypatch):
    import public_tokenizers

    words = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    signs = [chr(c) for c in [*range(0x250), 0x1680, 0x2003, 0x2028, 0x3000, 0x200B, 0x301, 0x3A3, 0x4E00, 0x1F600]]
    texts = ["".join(rng.choice(signs) for _ in range(80)) for _ in range(300)] + [f"ab{c}Cd don't{c}'s 12{c}3" for c in signs]
    assert words.encode(texts) == [words._whole(t) for t in texts]
    monkeypatch.setattr(packing, "SLICE_CHARS", 7)
    assert words.encode([*texts, "", " \n"]) == [*(words._whole(t) for t in texts), b"", b""]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    df = registry.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, D)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
    assert corpus_pipeline.run(spark, D).count() > 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_odd_tables(spark, odd, nothing, empty):
    """Every stage takes nulls, odd texts, repeated rows, no rows, and further columns of names that are used inside."""
    import corpus_pipeline

    clashing = ("kept", "name", "t", "least", "n", "keys", "m", "s", "toxic", "host", "lines", "score", "item_id", "__lines", "__gone", "__bad_id", "__text__")
    docs = (nothing if empty else odd).withColumns({c: F.lit(7) for c in clashing})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        rows = out.collect()
        if name == "packing":
            # Each row gives one piece at least.
            assert len(rows) >= docs.count()
        else:
            assert out.columns == docs.columns and len(rows) == docs.count() and all(r.t == 7 for r in rows)
        if empty:
            assert not rows


def test_pipeline_bounds_the_bytes_of_batches(spark, docs):
    import corpus_pipeline
    import pyarrow as pa

    from cadenza.llm.shared import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    long = docs.limit(1).selectExpr("explode(sequence(1, 300)) AS i", "repeat('word ', 20000) AS text").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        stage(spark, docs, D)
        found = long.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in found) == 300 and max(r["bytes"] for r in found) < BATCH_BYTES + 200_000
    spark.conf.set(key, "1000000")
    corpus_pipeline.line_dedup(spark, docs, D)
    assert spark.conf.get(key) == "1000000"
    spark.conf.unset(key)
