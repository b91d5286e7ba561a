"""Operators over single texts: pieces, token counts, quality, toxicity, licenses, decontamination."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from foldframe.llm import decontam, licenses, pieces, quality, shingles, token_counts, toxicity
from foldframe.llm.queries import piece_model_path

EDGE = [None, "", " ", "  x", "a  b ", "x▁y", "\n\n a", "é\x00q 😀", "ﬁ Ａ　z", "a" * 700, " " * 60 + "b", "<s> </s> <0x0A>", "word " * 5_000]


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, score string, g int")


def test_pieces_equal_the_library(spark):
    texts = EDGE + ["".join(random.Random(i).choice("abc ▁\né.") for _ in range(90)) for i in range(60)] * 2
    got = {r.doc_id: r for r in pieces.encode_pieces(frame(spark, texts), piece_model_path(), with_text=True).collect()}
    lib = pieces.piece_model(piece_model_path()).library
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert list(got[i].ids) == ids and got[i].decoded == lib.decode(ids), t
    assert pieces.encode_pieces(frame(spark, ["a"]).where("false"), piece_model_path()).count() == 0
    digest = pieces.piece_digests(frame(spark, ["Ab c"]), piece_model_path()).first()
    ids = lib.encode("Ab c", add_bos=True, add_eos=True)
    assert digest.n_tokens == len(ids) and digest.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and digest.decoded_sha256 == hashlib.sha256(b"Ab c").hexdigest()


def test_agenda_forms_agree():
    m = pieces.piece_model(piece_model_path())
    r = random.Random(2)
    words = ["▁" + "".join(r.choice("etaoinshré#") for _ in range(r.randint(1, 39))) for _ in range(500)] + ["▁" * 9 + "x"]
    for w, got in zip(words, m.encode_segments(words), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == m.agenda_encode(w), w
    odd = [1, 300, m.byte_ids[0xC3], m.byte_ids[0x28], m.unk, 2]
    assert m.decode_ids(odd) == m.library.decode(odd)


def test_library_decides_when_forms_differ(monkeypatch):
    m = pieces.PieceModel(piece_model_path())
    monkeypatch.setattr(m, "encode_segments", lambda s, longest=40: [b"\0\0\0\0"] * len(s))
    assert np.frombuffer(m.encode_texts(["the cat"])[0], "<u4").tolist() == m.library.encode("the cat", add_bos=True, add_eos=True)


def test_token_attribution(spark):
    import public_tokenizers as P

    texts = [None, "", "one line", "a\n\n\nb  \n é\n", "\n", "x" * 9_000 + "\ny"]
    rows = token_counts.section_token_counts(frame(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    encoder, lengths = token_counts.byte_vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.section)
        t = t or ""
        lines = t.splitlines(keepends=True) or [""]
        assert [t[r.start : r.end] for r in own] == lines
        want, at = [0] * len(lines), 0
        ends = np.cumsum([len(x.encode()) for x in lines])
        for token in encoder.encode_ordinary(t):  # brute force: bytes of the token in each section
            share = [max(0, min(at + lengths[token], e) - max(at, e - len(x.encode()))) for e, x in zip(ends, lines, strict=True)]
            want[int(np.argmax(share))] += 1
            at += lengths[token]
        assert [r.n_tokens for r in own] == want and {r.doc_tokens for r in own} == {sum(want)}


def labelled(n=700):
    r = random.Random(5)
    plain = lambda: " ".join(r.choice(["stone", "river", "lamp", "paper", "the", "and", "green"]) for _ in range(r.randint(5, 60)))
    rows = []
    for i in range(n):
        t, bad = plain(), i % 4 == 0
        toxic = i % 5 == 0
        if bad:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if toxic:
            words = t.split()
            words[r.randrange(len(words))] = r.choice(["idiot", "zarkol", "zarkolit", "zarkoma"])
            t = " ".join(words + ["you"])
        rows.append((i, t, int(not bad), int(toxic)))
    return rows


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    p = y.sum()
    return (rank[y == 1].sum() - p * (p - 1) / 2) / (p * (len(y) - p))


@pytest.mark.parametrize(("kind", "folds", "held"), [("quality", 5, 0), ("toxic", 3, 1)])
def test_classifiers_on_held_out_rows(spark, kind, folds, held):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(10_000, None), (10_001, ""), (10_002, "Ab cd " * 30_000), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = (quality.quality_scores(docs, quality.train_quality(docs, labels)) if kind == "quality" else toxicity.toxicity_scores(docs, toxicity.train_toxicity(docs, labels))).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and r.predicted == int(r.score >= (0.3 if kind == "quality" else 0.7)) for r in got)
    assert len({r.score for r in got if r.doc_id in (10_000, 10_001)}) == 1 and len({r.score for r in got if r.doc_id == 0}) == 1
    y = {i: (q if kind == "quality" else x) for i, _, q, x in rows}
    test = [r for r in got if r.held_out and r.doc_id in y]
    assert auc(np.array([r.score for r in test]), np.array([y[r.doc_id] for r in test])) > 0.97
    none = quality.train_quality(docs, labels.where("quality = 1")) if kind == "quality" else toxicity.train_toxicity(docs, labels.where("toxic = 1"))
    assert none.constant == 1.0


def test_labels_of_the_held_out_fold_are_never_learned(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    flip = lambda i, q: 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q
    scores = []
    for f in (lambda i, q: q, flip):
        labels = spark.createDataFrame([(i, f(i, q)) for i, _, q, _ in rows], "doc_id long, quality int")
        scores.append(sorted((r.doc_id, r.score) for r in quality.quality_scores(docs, quality.train_quality(docs, labels)).collect()))
    assert scores[0] == scores[1]


def test_network_gradients():
    net = quality.ByteNet(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y, w = [b"Hello there, this is a text of some length. " * 9, b"!!", b""], np.array([1.0, 0.0, 1.0]), np.ones(3)
    raw, offsets = quality._pack(texts)
    g = net.gradients(raw, offsets, y, w)

    def loss():
        z = net.logits(net.pooled(raw, offsets)).astype(float)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for name, at in (("out", (3,)), ("hid", (5, 2)), ("conv", (10, 4)), ("embed", (ord("e"), 1))):
        keep, eps = net.p[name][at], 1e-3
        net.p[name][at] = keep + eps
        up = loss()
        net.p[name][at] = keep - eps
        assert (up - loss()) / (2 * eps) == pytest.approx(g[name][at], abs=3e-4)
        net.p[name][at] = keep


def test_isotonic_and_trees():
    iso = toxicity.Isotonic().fit(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert iso(np.array([0, 2.5, 9])).tolist() == pytest.approx([0.0, 0.5, 1.0])
    assert (np.diff(iso(np.linspace(0, 5, 50))) >= 0).all()
    r = np.random.default_rng(1)
    x = r.normal(size=(800, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = toxicity.BoostedTrees(trees=40).fit(x[:600], y[:600], np.ones(600))
    assert ((t.raw(x[600:]) > 0) == y[600:]).mean() > 0.95


def test_keep_quality_keeps_columns(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _, _ in rows] + [(900, None, None)], "doc_id long, text string, source string")
    kept = quality.keep_quality(docs, quality.train_quality(docs, spark.createDataFrame([(i, q) for i, _, q, _ in rows], "doc_id long, quality int")))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i in ids for i, _, q, _ in rows if q) > 0.97 * sum(q for _, _, q, _ in rows) and sum(i in ids for i, _, q, _ in rows if not q) < 8


def test_licenses_equal_brute_force(spark):
    r = random.Random(4)
    filler = lambda n: " ".join(r.choice(["alpha", "beta", "gamma,", "délta", "the", "license"]) for _ in range(n))
    names = list(licenses.TEMPLATES)
    texts = [None, "", "two words", filler(4_000)] + [f"{filler(i % 23)} {licenses.TEMPLATES[names[i % len(names)]]} {filler(i % 7)}" for i in range(44)]
    cut = licenses.TEMPLATES["MIT-grant"].split()
    texts += [" ".join(cut[8:]), " ".join(cut[:30]), filler(9) + "\n" + " ".join(cut[:-9]).upper(), texts[5]]
    got = {(x.doc_id, x.template): x.containment for x in licenses.license_matches(frame(spark, texts)).collect()}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [licenses._plain_words(t)] for i in range(len(w) - 4)}
    want = {}
    for i, t in enumerate(texts):
        for n, template in licenses.TEMPLATES.items():
            share = len(grams(template) & grams(t or "")) / len(grams(template))
            if share >= 0.75:
                want[i, n] = share
    assert set(got) == set(want) and all(got[k] <= want[k] + 1e-9 for k in got)
    plan = licenses.license_matches(frame(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert licenses.license_matches(frame(spark, ["a"]).where("false")).count() == 0


def edit(text, k, r):
    t = list(text)
    for _ in range(k):
        i, what = r.randrange(len(t)), r.randrange(3)
        t[i : i + (what != 1)] = [] if what == 0 else [r.choice("abcxyz")]
    return "".join(t)


def semi_global(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, a in enumerate(p):
            new.append(min(row[i] + (a != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_equals_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("etaoinsh") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 24, 3, 12, 1, 30])] + [(90, None), (91, "  ")]
    texts = [None, "", " ".join(word() for _ in range(400))]
    for i, t in items[:6]:
        for k in (0, 2, len(t) // 13, len(t) // 10, len(t) // 5):
            texts.append(" ".join([word(), word(), edit(t, k, r).upper() if k % 2 else edit(t, k, r), "\n", word()]))
    table = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i): dist for d, t in enumerate(texts) for i, item in items[:6] for n in [decontam.normalize(item)] for dist in [semi_global(n, decontam.normalize(t or ""))] if dist <= int(len(n) * 0.08)}
    for block in (4_000_000, 150):  # one block, and several
        got = decontam.benchmark_matches(frame(spark, texts), table, error_rate=0.08, block_bytes=block).collect()
        assert {(x.doc_id, x.item_id): x.distance for x in got} == want
    for x in got:
        t = decontam.normalize(texts[x.doc_id])
        assert semi_global(decontam.normalize(dict(items)[x.item_id]), t[x.start : x.end]) == x.distance
    kept = decontam.drop_contaminated(frame(spark, texts), table, error_rate=0.08, block_bytes=150)
    assert {x.doc_id for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in want} and kept.columns == ["doc_id", "text", "score", "g"]
    assert decontam.benchmark_matches(frame(spark, texts), table.where("false")).count() == 0


def test_shingle_sets():
    r = random.Random(3)
    texts = ["".join(r.choice("aB é \t\n") for _ in range(r.randint(0, 40))) for _ in range(800)] + ["", "  ", " a", "A " * 9]
    raw = [t.encode() for t in texts]
    packed = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    known = {}
    for t, s in zip(raw, shingles.distinct_shingles(*packed), strict=True):
        w = t.lower().split()
        want = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        assert len(s) == len(want) and known.setdefault(want, s.tobytes()) == s.tobytes()
    assert len(set(known.values())) == len(known)


def test_lightly_edited_passage_is_contamination(spark, tmp_path):
    """An item with nine errors in a hundred characters, for the query and the pipeline's stage."""
    import corpus_pipeline
    from foldframe.llm.queries import QUERIES

    r = random.Random(3)
    item = "".join(r.choice("abcdefghijklmnop") for _ in range(100))
    edited = "".join("z" if i % 11 == 5 else c for i, c in enumerate(item))
    docs = spark.createDataFrame([(1, "before " + edited + " after"), (2, "nothing of it")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(x.doc_id, x.item_id, x.distance) for x in QUERIES["op10_decontamination"](spark, str(tmp_path)).collect()] == [(1, 7, 9)]
    assert [x.doc_id for x in corpus_pipeline.contamination(spark, docs, str(tmp_path)).collect()] == [2]


def test_sections_of_odd_tables(spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(1, "a b\nc", 9, "x"), (1, "a b\nc", 9, "x"), (2, None, 8, "y"), (None, "z", 7, "w")], "doc_id long, text string, section int, start string")
    got = sorted((str(x.doc_id), x.section, x.start, x.end, x.n_tokens) for x in token_counts.section_token_counts(docs, path, pattern).collect())
    once = [("1", 0, 0, 4), ("1", 1, 4, 5)]
    assert [g[:4] for g in got] == sorted([*once, *once, ("2", 0, 0, 0), ("None", 0, 0, 1)])
    assert token_counts.section_token_counts(docs.where("false"), path, pattern).count() == 0


def test_licenses_of_repeated_rows(spark):
    text = "we say: " + licenses.TEMPLATES["GPL-3.0-notice"]
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, "nothing of the kind is said here", 1), (3, text * 2, 1)], "doc_id long, text string, template int")
    got = [(x.doc_id, x.template) for x in licenses.license_matches(docs).collect()]
    assert sorted(got) == [(1, "GPL-3.0-notice"), (3, "GPL-3.0-notice")]


def test_whole_license_texts_and_rows_without_an_id(spark):
    words = licenses.TEMPLATES["BSD-3-Clause"].split()
    texts = [("x " * 500 + " ".join(words), 1), (" ".join(words[:120]), 2), (licenses.TEMPLATES["Zlib"].replace(" ", "\n * "), 3), (" ".join(words), None), ("y " + licenses.TEMPLATES["MIT"] + " z" * 300, 4)]
    docs = spark.createDataFrame([(i, t) for t, i in texts], "doc_id long, text string")
    got = {(r.doc_id, r.template): r.containment for r in licenses.license_matches(docs).collect()}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [licenses._plain_words(t)] for i in range(len(w) - 4)}
    share = {(i, n): len(grams(t) & grams(text)) / len(grams(t)) for text, i in texts if i for n, t in licenses.TEMPLATES.items()}
    assert set(got) == {k for k, v in share.items() if v >= 0.75} and {(1, "BSD-3-Clause"), (1, "BSD-2-Clause"), (3, "Zlib"), (4, "MIT"), (4, "MIT-grant")} <= set(got)


def test_scores_of_odd_tables(spark):
    """No rows, no ids, no texts: scores are defined, and without an id there is no fold."""
    rows = labelled(300)
    texts, y = [t for _, t, _, _ in rows], np.array([q for _, _, q, _ in rows])
    network = quality.ByteNet().fit([t.encode() for t in texts], y, float(y.mean()))
    model = toxicity.ToxicityModel().fit(texts, np.array([t for *_, t in rows]), 0.2)
    docs = spark.createDataFrame([(None, "a river", 1), (1, None, 2), (1, None, 2), (2, "", 3), (3, "long " * 20_000, 4)], "doc_id long, text string, score int")
    for scored in (quality.quality_scores(docs, network), toxicity.toxicity_scores(docs, model)):
        found = scored.collect()
        assert len(found) == 5 and all(0 <= x.score <= 1 and x.predicted in (0, 1) for x in found)
        assert [x.held_out for x in found if x.doc_id is None] == [None] and len({x.score for x in found if x.doc_id in (1, 2)}) == 1
    assert quality.quality_scores(docs.where("false"), network).count() == toxicity.toxicity_scores(docs.where("false"), model).count() == 0


def test_toxicity_features_by_hand():
    lexicon = toxicity.Lexicon()
    word = sorted(w for w in lexicon.words if w.isalpha() and len(w) > 3)[0]
    text = f"you are a {word.upper()}!"
    got = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon), strict=True))
    values = list(got.values())
    assert len(values) == 17 and values[0] == 1 / 4 and abs(values[1] - np.log(2)) < 1e-6 and values[4] == 1
    assert abs(values[5] - 1 / (1 + 3)) < 1e-6 and values[6] == 1 / 4  # "you" stands three words before
    assert abs(values[7] - len(word) / len(text)) < 1e-6 and values[8] == 1 / 4  # capitals, and words in capitals
    assert abs(values[14] - np.log(5)) < 1e-6 and abs(values[15] - (3 + 3 + 1 + len(word)) / 4) < 1e-6
    assert toxicity.features("", lexicon) == [0.0] * 17


def test_items_without_an_id_are_matched(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = spark.createDataFrame([(1, f"well {item} indeed"), (None, item), (2, "nothing of that kind"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (4, item), (None, None), (5, "")], "item_id long, text string")
    got = sorted(map(tuple, decontam.benchmark_matches(docs, items).select("doc_id", "item_id", "distance").collect()), key=repr)
    assert got == [(1, 4, 0), (1, None, 0), (None, 4, 0), (None, None, 0)]
    assert [r.doc_id for r in decontam.drop_contaminated(docs, items.where("item_id is null")).collect()] == [2, 3]


def test_decontamination_ties(spark):
    """Of two places of equal distance the first is reported; the window filter never loses a match."""
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    wrong = item.replace("brown", "brawn")
    items = spark.createDataFrame([(5, item), (5, item)], "item_id long, text string")
    got = decontam.benchmark_matches(frame(spark, [f"xx {wrong} yy {wrong} zz", f"{wrong} {item}"]), items, error_rate=0.1).collect()
    assert {(x.doc_id, x.item_id, x.distance, x.start) for x in got} == {(0, 5, 1, 3), (1, 5, 0, len(wrong) + 1)}
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(20, 120)
        text = "".join(r.choice("abcd ") for _ in range(n))
        k = max(1, n // 10)
        assert decontam.worth_verifying(text, k, "zz" + edit(text, k, r) + "zz")


def test_pieces_check_every_segment(spark):
    """A wrong id of any segment is seen, be it a word, the start of a line or a run of blanks."""
    model = pieces.piece_model(piece_model_path())
    for text, segment in (("a bee\nsees", "sees"), ("a bee\nsees", "▁bee"), ("x\n   \ny", "▁▁▁")):
        model.cache.clear()
        model.encode_texts(["fine", text])
        assert segment in model.cache and model.agree([segment], [], [])
        model.cache[segment] = np.array([17], "<u4").tobytes()
        assert not model.agree([segment], [], [])
    model.cache.clear()
