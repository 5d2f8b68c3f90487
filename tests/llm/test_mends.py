"""Finite vectors of any size, samples with repeated ids, ranges of repetitive texts, and the models' inner steps."""

import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import bpe, common, language_id, ngram_join, quality_classifier, shingles, substring_dedup, topk_search
from lexloom.llm.common import Tables

MOST = topk_search.MOST


def test_scores_beyond_64_bits_have_a_defined_end(spark):
    vectors = {0: [1e308, 1.0], 1: [1e17, -1.0], 2: [-1e17, 0.0], 3: [0.5, 0.25], 4: [1e-300, -1e-300], 50: [1e308, 1e308]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    whole = {i: [256 * int(x) if abs(x) >= 2**53 else int(np.floor(256 * x)) for x in v] for i, v in vectors.items()}
    want = []
    for q in (0, 50):
        scores = sorted((-max(-MOST, min(MOST, sum(a * b for a, b in zip(whole[q], whole[i])))), i) for i in whole if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    got = topk_search.top_k(df.where("vec_id % 50 = 0"), df, 5).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_an_id_asked_twice_is_asked_with_its_smallest_vector(spark):
    df = spark.createDataFrame([(50, [2.0]), (50, [1.0]), (1, [3.0])], "vec_id long, embedding array<double>")
    got = topk_search.top_k(df.where("vec_id = 50"), df, 5).collect()
    assert list(map(tuple, got)) == [(50, 1, 1, 256 * 768)]


def test_ranges_on_two_diagonals_are_not_merged(spark):
    passage = [f"w{k}" for k in range(52)]
    lead = [f"x{k}" for k in range(30)] + passage[:51] + [f"y{k}" for k in range(400)] + passage[1:] + ["z"]
    rows = spark.createDataFrame([(1, " ".join(lead)), (2, " ".join([f"v{k}" for k in range(40)] + passage))], "id long, text string")
    met = spark.createDataFrame([(8, 1, 0, len(lead) - 51), (8, 2, 0, 41)], "key long, id long, i int, j int")
    none = spark.createDataFrame([], "doc_id long, start int, end int, first_id long, first_start int, first_end int, similarity double")
    got = substring_dedup.exact_repeats(rows, met, none, 5, 47, Tables(spark)).collect()
    words = {1: lead, 2: [f"v{k}" for k in range(40)] + passage}
    assert got
    for r in got:
        assert words[r["doc_id"]][r["start"] : r["end"]] == words[r["first_id"]][r["first_start"] : r["first_end"]]
    assert {i for r in got for i in range(r["start"], r["end"])} == set(range(40, 92))


def test_samples_are_bounded_in_rows(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(quality_classifier, "fit", lambda families, labels: sent.append((len(families), labels)))
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "a b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    quality_classifier.train(docs, labels)
    assert sent == [(3, [0, 0, 1])]
    named = docs.withColumn("lang", F.lit("en"))
    assert len(language_id.labelled_sample(named, 400, "doc_id", "text", "lang")) == 2


def test_log_ratios_and_dual_descent_against_plain_python():
    rng = np.random.default_rng(3)
    y = np.array([0, 1] * 20)
    rows = [np.unique(np.concatenate([rng.integers(0, 30, 8), [40 + label]])) for label in y]
    ratio = quality_classifier.log_ratios(rows, y)
    counts = {0: {}, 1: {}}
    for features, label in zip(rows, y):
        for f in features.tolist():
            counts[label][f] = counts[label].get(f, 0) + 1
    totals = {c: sum(counts[c].values()) + quality_classifier.BUCKETS for c in (0, 1)}
    for f in range(45):
        assert ratio[f] == pytest.approx(np.log((counts[1].get(f, 0) + 1) / totals[1]) - np.log((counts[0].get(f, 0) + 1) / totals[0]))
    values = [np.ones(len(r)) for r in rows]
    signs, bound = np.where(y == 1, 1.0, -1.0), np.ones(len(y))
    w, b = quality_classifier.dual_descent(rows, values, signs, bound, 200)
    margins = np.array([w[r] @ v + b for r, v in zip(rows, values)])
    primal = 0.5 * (w @ w + b * b) + np.maximum(0, 1 - signs * margins).sum()
    assert (np.sign(margins) == signs).all()
    for _ in range(200):  # no neighbour is better: the minimum of a convex loss
        u, c = w.copy(), b + rng.normal(0, 0.01)
        u[:45] += rng.normal(0, 0.01, 45)
        moved = np.array([u[r] @ v + c for r, v in zip(rows, values)])
        assert 0.5 * (u @ u + c * c) + np.maximum(0, 1 - signs * moved).sum() >= primal - 1e-6


def test_the_join_frees_the_encoder_that_an_earlier_stage_left():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a b c d e f g", "a b c d e f g h", None])], names=["id", "text"])
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    for step in (ngram_join._prefixes(5, 80, none), ngram_join._fragments(5, 80), lambda b: ngram_join._hot_counts(5)(x.select([1]) for x in b)):
        bpe.encoder(public_tokenizers.path("word_bpe_49k.json"))
        assert common._kept
        assert list(step(iter([batch])))
        assert not common._kept
    got = list(ngram_join._hot_counts(5)(iter([batch.select([1])])))
    values = shingles.ngram_sets(batch.column(1), 5)[0]
    keys, counts = np.unique(values, return_counts=True)
    assert got[0].column(0).to_pylist() == keys[counts > 1].tolist() and set(got[0].column(1).to_pylist()) == {2}


def test_maps_free_what_another_stage_left_and_keep_their_own():
    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", "c"])], names=["text"])
    arrow = pa.schema([("n", pa.int64())])
    made = lambda: lambda texts: {"n": list(map(len, texts))}
    for keeps, left in ((path, 1), (None, 0)):
        first = bpe.encoder(path)
        assert [b.column(0).to_pylist() for b in common.map_texts(Frame(), ["text"], made, "n long", arrow, keeps)(iter([batch]))] == [[3, 1]]
        assert len(common._kept) == left
        assert not left or bpe.encoder(path) is first
    texts = ["le chat le chat", "", "a " * 50_000]
    for text, (grams, counts) in zip(texts, language_id.gram_counts(texts), strict=True):
        want = Counter(g for w in text.split() for g in language_id.word_grams(w))
        assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == want


def plain_passages(x, y, least, percent, shift):
    """What ``shared_passages`` gives, by sets and without bounds."""
    place = [min((p for p in range(len(y)) if y[p] == v), key=lambda p: (abs(p - min(max(i + shift, 0), len(y) - 1)), -p), default=None) for i, v in enumerate(x)]
    places = [i for i, p in enumerate(place) if p is not None]
    found, stack = [], [(0, len(places))]
    while stack:
        lo, hi = stack.pop()
        own = places[lo:hi]
        if hi - lo < 2 or own[-1] + 1 - own[0] < least:
            continue
        start, end, to = own[0], own[-1] + 1, [place[i] for i in own]
        off = [b - a for a, b in zip(own, to, strict=True)]
        near = [b for b, d in zip(to, off, strict=True) if abs(d - sorted(off)[len(own) // 2]) <= max(10, (end - start) // 4)]
        lo2, hi2 = min(near), max(near) + 1
        a, b = set(x[start:end]), set(y[lo2:hi2])
        if 100 * len(a & b) >= percent * len(a | b) and 100 * (hi2 - lo2) >= percent * (end - start):
            found.append((start, end, lo2, hi2, len(a & b) / len(a | b)))
            continue
        gaps, jumps = ([q - p for p, q in zip(c[:-1], c[1:], strict=True)] for c in (own, to))
        cut = gaps.index(max(gaps)) if max(gaps) > 1 else max(range(len(jumps)), key=lambda k: (abs(jumps[k] - 1), -k))
        stack += [(lo, lo + cut + 1), (lo + cut + 1, hi)]
    return found


def test_passages_of_repetitive_texts_are_those_of_sets():
    rng, some = np.random.default_rng(31), 0
    for _ in range(300):
        words = int(rng.choice([3, 12, 400]))
        y = rng.integers(0, words, int(rng.integers(1, 60))).astype(np.int64) + 1
        x = y.copy()[: int(rng.integers(1, 60))]
        x = np.concatenate([np.repeat(x[:1], int(rng.integers(0, 40))), x, rng.integers(0, words, 9)])
        x[rng.random(len(x)) < 0.1] = rng.integers(0, 2 * words)
        shift, least = int(rng.integers(-20, 20)), int(rng.integers(2, 12))
        want = plain_passages(x.tolist(), y.tolist(), least, 80, shift)
        assert substring_dedup.shared_passages(x, y, least, 80, shift) == want
        some += len(want)
    assert some > 100


def test_a_long_repetition_takes_no_time_of_its_square():
    x, y = np.ones(60_000, np.int64), np.ones(90, np.int64)
    began = time.process_time()
    found = substring_dedup.shared_passages(x, y, 47, 80)
    assert time.process_time() - began < 5
    assert all(e - s >= 47 and 100 * (e2 - s2) >= 80 * (e - s) for s, e, s2, e2, _ in found)


def test_the_prefixes_of_a_join_are_shuffled_once(spark, monkeypatch):
    """Beyond the broadcast bound too, the sums by n-gram and the join with them read one shuffle of the prefixes."""
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    plans, write = [], Tables.write

    def noted(self, df):
        if "hub" in df.columns and "c" in df.columns:
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return write(self, df)

    monkeypatch.setattr(Tables, "write", noted)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[: 40 + i % 3] + [f"d{i // 10}x{k}" for k in range(30)])) for i in range(1, 60)]
    got = {r["id"]: r["component"] for r in ngram_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string")).classes().collect()}
    assert got == {i: max(1, i - i % 10) for i in range(1, 60)}
    assert len(plans) == 1 and "ReusedExchange" in plans[0]


def test_slices_of_comparisons_give_the_rows_of_all_at_once(spark, monkeypatch):
    # What is shuffled at once is bounded by documents, not by the pairs of a family of near copies.
    rng = random.Random(9)
    passages = [[f"{k}w{i}" for i in range(70)] for k in range(3)]
    near = lambda words: " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.012 else w for w in words)
    rows = [(i, " ".join([f"a{i}b{k}" for k in range(20)]) + " " + near(passages[i % 3])) for i in range(45)]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, counts, compared, slices = [], [], substring_dedup._compared_slice, substring_dedup._slices

    def noted(texts, regions, *rest):
        sizes.append(regions.count())
        return compared(texts, regions, *rest)

    monkeypatch.setattr(substring_dedup, "_compared_slice", noted)
    monkeypatch.setattr(substring_dedup, "_slices", lambda count, *rest: counts.append(count) or slices(count, *rest))
    whole = sorted(map(tuple, substring_dedup.repeated_passages(rows).collect()))
    first, pairs, second = counts
    assert len(whole) > 40 and sizes == [first, second] and min(counts) > 1
    sizes.clear()
    for name, value in {"COMPARED": first // 2 + 1, "COMPARED_EACH": 0, "PAIRS": pairs // 2 + 1, "PAIRS_EACH": 0}.items():
        monkeypatch.setattr(substring_dedup, name, value)
    assert sorted(map(tuple, substring_dedup.repeated_passages(rows).collect())) == whole
    assert sum(sizes) == first + second and len(sizes) >= 4 and max(sizes) < max(first, second)
