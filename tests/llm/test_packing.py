"""Best-fit packing and hard negatives against brute force."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldframe.llm import negatives, packing
from foldframe.llm.common import table
from foldframe.llm.queries import op11_packing, op12_negatives

DATA = "/root/testdata/sf0.001"


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), public_tokenizers.path("word_bpe_49k.json")


def brute_best_fit(sizes, capacity):
    """Item by item, every open bin looked at."""
    bins = []
    for size in sorted(sizes, reverse=True):
        room = [(capacity - sum(b) - size, i) for i, b in enumerate(bins) if capacity - sum(b) >= size]
        bins[min(room)[1]].append(size) if room else bins.append([size])
    return bins


def check_layout(rows, capacity):
    """(sequence, offset, size): every sequence is filled from 0 without gaps, within the capacity."""
    rows = rows.sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id")["length"].cumsum()
    assert ((ends - rows["length"]) == rows["offset"]).all() and (ends <= capacity).all()


def test_word_encoder_equals_the_library():
    tokenizer, path = library()
    encode = packing.WordEncoder(path)
    random.seed(5)
    signs = [*"abZÉßİıſéñ.,;:!?'<|>()-_*#12²½ \t\n\r\x0b\x0c\x1c\x85\xa0　́̀÷中🙂‍﻿Σς", "<|endoftext|>", "'s", "'re", "end<|startoftext|>", " ", "the", "Der", "word,"]
    for _ in range(3000):
        texts = ["".join(random.choices(signs, k=random.randint(0, 15))) for _ in range(3)]
        assert [*map(encode.encode, texts)] == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_word_encoder_keeps_nothing_of_long_words_and_starts_anew(monkeypatch):
    tokenizer, path = library()
    monkeypatch.setattr(packing, "CACHED", 4)
    encode = packing.WordEncoder(path)
    for text in ("a b c d e f " + "x" * 500, "a b g h, i; a b c", "x" * 500 + " a b z", "c d"):
        assert encode.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert max(map(len, [*encode, *encode.old])) < 100 and len(encode) < 20


def test_tree_finds_the_tightest_room():
    random.seed(2)
    for capacity in (1, 2, 7, 8, 100):
        tree, there = packing.RoomTree(capacity), set()
        for _ in range(400):
            room = random.randint(1, capacity)
            there ^= {room}
            tree.set(room, room in there)
            size = random.randint(1, capacity)
            assert tree.tightest(size) == min((r for r in there if r >= size), default=None)


def test_plan_is_best_fit_decreasing():
    random.seed(3)
    for _ in range(200):
        capacity = random.choice([1, 5, 10, 64])
        sizes = [random.choice([random.randint(1, capacity), max(1, capacity // 3)]) for _ in range(random.randint(0, 60))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        plan, bins, rank = packing.best_fit_plan(counts, capacity), {}, 0
        ends = [*plan["rank"].tolist()[1:], len(sizes)]
        for row, end in zip(plan.itertuples(), ends, strict=True):
            for i in range(end - row.rank):
                bins.setdefault(row.first + i // row.per, []).append((row.offset + i % row.per * row.size, row.size))
                rank += 1
        assert rank == len(sizes)
        contents = []
        for b in bins.values():
            at = 0
            for offset, size in sorted(b):
                assert offset == at
                at += size
            assert at <= capacity
            contents.append(at)
        assert sorted(contents) == sorted(map(sum, brute_best_fit(sizes, capacity)))  # bins of one room are as good as each other


def test_best_fit_over_partitions(spark, partitions):
    random.seed(4)
    sizes = [random.choice([8, 8, 8, 3, 5, 1, 2, 7]) for _ in range(900)] + [None, 0, -3, 9]
    items = spark.createDataFrame([(i, s, 5) for i, s in enumerate(sizes)], "item int, length int, offset_of int").repartition(5)
    for found in partitions(lambda: packing.best_fit(items, "length", 8).toPandas()):
        assert len(found) == len(sizes) and found["sequence_id"].isna().sum() == 4 and set(found.columns) == {"item", "length", "offset_of", "sequence_id", "offset"}
        packed = found.dropna(subset=["sequence_id"])
        check_layout(packed, 8)
        assert packed["sequence_id"].nunique() == len(brute_best_fit([s for s in sizes if s and 0 < s <= 8], 8))


def test_pieces_of_odd_rows(spark):
    tokenizer, path = library()
    long = " ".join(f"word{i}, l'eau {i % 7}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "Hello there"), (3, "Hello there"), (None, "x"), (4, long), (5, " \n\t "), (6, "<|endoftext|> a")]
    docs = spark.createDataFrame([(i, t, 9, 9) for i, t in rows], "doc_id long, text string, sequence_id int, length int")
    got = packing.token_pieces(docs, path, 100).toPandas()
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, at, np.array(ids[at : at + 100], "<u4").tobytes()) for k, at in enumerate(range(0, len(ids), 100))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    have = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, bytes(r.ids)) for r in got.itertuples()]
    assert sorted(have, key=key) == sorted(want, key=key) and (got["ids"].map(len) == 4 * got["length"]).all()
    packed = packing.best_fit(packing.token_pieces(docs, path, 100), "length", 100)
    sequences = packing.packed_sequences(packed).toPandas()
    assert b"".join(sorted(map(bytes, sequences["ids"]))) and sequences["length"].sum() == got["length"].sum() and (sequences["length"] <= 100).all()
    assert sum(map(len, sequences["ids"])) == sum(len(w[3]) for w in want)
    empty = packing.packing_digests(docs.limit(0), path)
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_registered_packing_equals_brute_force(spark):
    tokenizer, _ = library()
    got = op11_packing(spark, DATA).toPandas()
    want = {}
    for r in table(spark, DATA, "documents").select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want |= {(r.doc_id, k): (at, len(p := ids[at : at + 2048]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    check_layout(got, 2048)
    assert got["sequence_id"].nunique() == len(brute_best_fit([v[1] for v in want.values()], 2048))


def brute_negatives(rows, anchor_every=100, positives=5, k=5):
    """rows: (vec_id, label, components), whole numbers and labels as the operator's first step leaves them."""
    out = []
    for a, (ai, al, av) in enumerate(rows):
        if ai % anchor_every:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v, strict=False)), i, label) for b, (i, label, v) in enumerate(rows) if b != a]
        for s, p, _ in sorted(x for x in scored if x[2] == al)[:positives]:
            hits = sorted((n, i) for n, i, label in scored if label != al and 80 * -s <= 100 * -n <= 100 * -s)[:k]
            out += [(ai, p, r, i, -s, -n) for r, (n, i) in enumerate(hits, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, negatives.hard_negatives(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def whole(df):
    return [(r.vec_id, r.label, r.v) for r in negatives.whole_vectors(df).collect()]


def test_registered_negatives_equal_brute_force(spark):
    got = sorted(map(tuple, op12_negatives(spark, DATA).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == brute_negatives(whole(table(spark, DATA, "embeddings"))) and len(got) > 20


@pytest.mark.parametrize("few", [5, 64])
def test_negatives_with_ties_copies_and_odd_rows(spark, partitions, monkeypatch, few):
    """Vectors of few values: most scores tie, so the digits of the ids decide."""
    monkeypatch.setattr(negatives, "FEW", few)
    monkeypatch.setattr(negatives, "BITS", 3)
    monkeypatch.setattr(negatives, "ROWS", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    random.seed(6)
    rows = [(i, random.randint(0, 2), [random.choice([0.5, 1.0, -0.25]) for _ in range(3)], 7) for i in range(-20, 380)]
    rows += [(100, 1, [1.0, 1.0, 1.0], 7), (100, 1, [1.0, 1.0, 1.0], 7), (200, 0, [1.0], 7), (300, 0, [], 7)]
    odd = [(400, None, [1.0, 1.0, 1.0], 7), (500, 1, None, 7), (600, 1, [1.0, None, 1.0], 7), (700, 1, [1.0, float("nan"), 1.0], 7), (800, 1, [float("inf"), 1.0, 1.0], 7), (None, 1, [1.0, 1.0, 1.0], 7)]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>, ps int").repartition(3)
    good = whole(df)
    assert len(good) == len(rows)
    want = brute_negatives(good)
    for got in partitions(lambda: mined(df)):
        assert got == want and len(got) > 50


def test_negatives_of_empty_tables_and_large_components(spark):
    schema = "vec_id long, label int, embedding array<double>"
    assert mined(spark.createDataFrame([], schema)) == []
    assert mined(spark.createDataFrame([(1, 1, [1.0])], schema)) == []
    assert mined(spark.createDataFrame([(100, 1, [1.0]), (101, 1, [1.0])], schema)) == []
    large = [(i, i % 2, [float(2**20 + i), float(2**20 - i)]) for i in range(0, 40)]  # products beyond what a double holds
    assert mined(df := spark.createDataFrame(large, schema)) == brute_negatives(whole(df))


def test_negatives_of_one_vector_held_by_most_rows(spark):
    rows = [(i, i % 3, [0.5, 0.5]) for i in range(3000)] + [(i, i % 3, [0.5, 0.4]) for i in range(3000, 3100)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(df.where(F.col("vec_id") % 2 == 0), anchor_every=500) == brute_negatives(whole(df.where(F.col("vec_id") % 2 == 0)), 500)
