"""Joins, passages and search against brute force; pipeline stages."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import ngram_join, shingles, substring_dedup, topk_search
from lexloom.llm.common import Tables
from lexloom.llm.components import components


def words(text):
    return (text or "").encode().lower().split()


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()


def reach(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_join(rows, n, percent):
    sets = {i: grams(t, n) for i, t in rows}
    ids = sorted(i for i in sets if i is not None)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(sets[i]) for i in ids}, reach(ids, links)


def test_join_matches_sql(spark, sf, same):
    same(ngram_join.op3_ngram_join(spark, sf), ngram_join.ORACLE)


def variants(seed):
    """Chains of edits, so that some links are only reached through others, and one passage in many texts."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows, i = [], 0
    for _ in range(6):
        text = rnd.sample(base, 40)
        for _ in range(8):
            rows.append((i, " ".join(text)))
            i += 1
            if rnd.random() < 0.7:
                text = list(text)
                text[rnd.randrange(len(text))] = f"v{rnd.randrange(9)}"
    shared = " ".join(f"s{k}" for k in range(30))
    rows += [(i + k, shared + " " + " ".join(rnd.sample(base, 20))) for k in range(20)]
    return rows + [(i + 50, None), (i + 51, ""), (i + 52, "one two"), (i + 53, "One TWO")]


def test_join_matches_brute_force(spark):
    for seed, n, percent in ((1, 2, 80), (3, 1, 60)):
        rows = variants(seed)
        sizes, least = brute_join(rows, n, percent)
        got = ngram_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).classes().collect()
        assert {r["id"]: (r["n"], r["component"]) for r in got} == {i: (sizes[i], least[i]) for i in sizes}


def test_linked_sets_share_a_fragment():
    rnd = np.random.default_rng(3)
    for percent in (75, 80, 85, 95):
        for size in (1, 2, 5, 9, 20, 60, 200, 700, 3000):
            for _ in range(12):
                a = np.unique(rnd.integers(-(2**63), 2**63 - 1, size))
                # As many n-grams changed or dropped as the threshold allows.
                gone, new = rnd.permutation(len(a)), 0
                b = a
                for k in range(len(a) + 1):
                    new = k if rnd.random() < 0.5 else new
                    other = np.unique(np.concatenate([np.delete(a, gone[:k]), rnd.integers(-(2**63), 2**63 - 1, min(new, k))]))
                    same = len(np.intersect1d(a, other))
                    if not len(other) or 100 * same < percent * (len(a) + len(other) - same):
                        break
                    b = other
                of, keys = ngram_join.fragment_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())


def test_crowded_buckets_lose_no_link(spark):
    """Over 32 documents in every bucket: one text with edits, linked in chains, beside others that share half of it."""
    rnd = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    rows, text = [], list(base)
    for i in range(60):
        rows.append((i, " ".join(text)))
        text = list(text if i % 3 else base)
        text[rnd.randrange(120)] = f"v{rnd.randrange(99)}"
    rows += [(100 + k, " ".join(base[:60] + [f"o{k}x{j}" for j in range(40)])) for k in range(40)]
    sizes, least = brute_join(rows, 4, 85)
    got = ngram_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).classes().collect()
    assert {r["id"]: (r["n"], r["component"]) for r in got} == {i: (sizes[i], least[i]) for i in sizes}


def test_join_on_odd_rows(odd, empty):
    got = ngram_join.JaccardJoin(odd).classes().collect()
    assert len(got) == 9 and all(r["component"] == r["id"] for r in got)
    assert ngram_join.JaccardJoin(empty).classes().count() == 0


def test_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)]
    got = components(spark.createDataFrame([*links, (None, 3)], "a long, b long"), "a", "b").collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    want = reach({x for e in links for x in e}, links)
    assert {r["id"]: r["component"] for r in got} == {i: want[i] for i in linked}


def test_windows_cover_each_passage_once():
    rnd = np.random.default_rng(1)
    high = lambda most, n: rnd.integers(0, most, n).astype(np.uint64) << np.uint64(40)
    for values in (high(50, 40), high(2**20, 90), np.zeros(30, np.uint64)):
        found = substring_dedup.compact_windows(values, 6)
        for i in range(len(values)):
            for j in range(i + 5, len(values)):
                own = [w for w in found if w[0] <= i <= w[1] <= j <= w[2]]
                assert len(own) == 1 and values[own[0][1]] == values[i : j + 1].min()


def test_repeated_passages_are_found(spark):
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(5000)}"
    fresh = lambda n: [word() for _ in range(n)]
    passage, copy = fresh(60), fresh(90)
    near = list(passage)
    near[30] = "changed"
    rows = [(k, " ".join(fresh(100) + passage + fresh(80))) for k in range(5)]
    rows += [(10, " ".join(fresh(50) + near + fresh(70))), (11, " ".join(copy)), (12, " ".join(copy))]
    rows += [(20 + k, " ".join(fresh(200))) for k in range(10)] + [(40, " ".join(fresh(40) + passage[:30] + fresh(40))), (41, None), (42, "")]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"] for r in got} | {r["first_id"] for r in got}
    assert found == {0, 1, 2, 3, 4, 10, 11, 12}
    assert any((r["doc_id"], r["start"], r["end"], r["first_start"]) == (3, 100, 160, 100) for r in got)
    assert all(r["similarity"] >= 0.8 and r["end"] - r["start"] > 50 for r in got)


def test_repeats_behind_leads_by_chance_are_found(spark):
    """The smallest and the largest id hold the least tokens of a passage under four functions, and no more of it."""
    rnd = random.Random(8)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    tokens = lambda w: shingles.run_hashes(*shingles.word_hashes(pa.array([" ".join(w)])), 5)[0]
    hashes = lambda w, f: substring_dedup.function_hash(tokens(w), f)
    passage = fresh(51)

    def lead():
        """Both least tokens of a pair of functions near each other, among other words."""
        out = []
        for f in (0, 2, 4):
            c, d = (int(hashes(passage, g).argmin()) for g in (f, f + 1))
            while True:
                part = fresh(15) + passage[c : c + 5] + fresh(6) + passage[d : d + 5] + fresh(20)
                if hashes(part, f).argmin() == 15 and hashes(part, f + 1).argmin() == 26:
                    break
            out += part
        return " ".join(out)

    rows = [(1, lead()), (100, lead()), *((k, " ".join(fresh(30) + passage + fresh(k))) for k in range(10, 21))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} | {r["first_id"] for r in got} == set(range(10, 21))
    assert all((r["start"], r["end"], r["first_start"], r["first_end"], r["similarity"]) == (30, 81, 30, 81, 1.0) for r in got)


def test_near_repeats_that_share_no_lead_are_found(spark):
    """The smallest and the largest id hold the least tokens under every pair of functions; the others are near to each other alone."""
    rnd = random.Random(18)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    tokens = lambda w: shingles.run_hashes(*shingles.word_hashes(pa.array([" ".join(w)])), 5)[0]
    hashes = lambda w, f: substring_dedup.function_hash(tokens(w), f)
    # Each run of 47 tokens holds the least one under every function.
    least = {0}
    while not all(5 <= c <= 46 for c in least):
        passage = fresh(56)
        least = {int(hashes(passage, f).argmin()) for f in range(6)}

    def lead():
        out = []
        for f in (0, 2, 4):
            c, d = (int(hashes(passage, g).argmin()) for g in (f, f + 1))
            while True:
                part = fresh(15) + passage[c : c + 5] + fresh(6) + passage[d : d + 5] + fresh(20)
                if hashes(part, f).argmin() == 15 and hashes(part, f + 1).argmin() == 26:
                    break
            out += part
        return " ".join(out)

    def near():
        """One word changed that no least token holds, so that no other token becomes the least."""
        while True:
            p = rnd.randrange(5, 51)
            out = [*passage[:p], *fresh(1), *passage[p + 1 :]]
            if not any(p - 4 <= c <= p for c in least) and all(hashes(out, f).argmin() == hashes(passage, f).argmin() for f in range(6)):
                return out

    rows = [(1, lead()), (100, lead()), (10, " ".join(passage)), (11, " ".join(near()))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["first_id"]) for r in got} == {(11, 10)}
    assert all(0.8 <= r["similarity"] < 1 and (r["start"], r["end"], r["first_start"], r["first_end"]) == (0, 56, 0, 56) for r in got)


def test_runs_that_reach_the_similarity_share_a_token_of_their_prefixes():
    rng = np.random.default_rng(7)
    for k in range(300):
        base = rng.integers(0, 2**63, 80).astype(np.uint64)
        x, y = base[10 : 60 + k % 20].copy(), base[5 : 58 + k % 17].copy()
        lead = np.concatenate([base[20 : 20 + k % 45], rng.integers(0, 2**63, 10).astype(np.uint64)])
        for part in (x, y):
            part[rng.integers(0, len(part), k % 6)] = rng.integers(0, 2**63, k % 6).astype(np.uint64)
        if k % 3 == 0:
            x[30:34] = x[26:30]
        sets = [[set(part[s : s + 47].tolist()) for s in range(len(part) - 46)] for part in (x, y)]
        linked = any(100 * len(p & q) >= 80 * len(p | q) for p in sets[0] for q in sets[1])
        a, b = (set(part[substring_dedup.prefix_places(part, lead, 47, 80)].tolist()) for part in (x, y))
        assert not linked or a & b


def test_every_place_of_a_repeat_has_a_row(spark):
    text = " ".join(f"a{k}" for k in range(60))
    rows = spark.createDataFrame([(1, f"{text} x {text}"), (2, text)], "id long, text string")
    met = spark.createDataFrame([(8, 1, 0, 9), (8, 1, 61, 70), (8, 2, 0, 9)], "key long, id long, i int, j int")
    none = spark.createDataFrame([], "doc_id long, start int, end int, first_id long, first_start int, first_end int, similarity double")
    got = substring_dedup.exact_repeats(rows, met, none, 5, 47, Tables(spark)).collect()
    assert {(r["doc_id"], r["start"], r["end"], r["first_id"], r["first_start"], r["first_end"]) for r in got} == {(2, 0, 60, 1, 0, 60), (1, 61, 121, 2, 0, 60)}


def test_stretches_are_the_joined_windows_of_two_functions():
    rnd = np.random.default_rng(6)
    tokens = rnd.integers(0, 2**63, 300).astype(np.uint64)
    tokens[100:180] = np.tile(tokens[100:104], 20)
    offsets = np.array([0, 0, 120, 130, 300])
    want = []
    for p in (0, 2):
        for text, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            part, before = tokens[a:b], None
            values = [substring_dedup.function_hash(part, p + q) for q in (0, 1)]
            trees = [substring_dedup.compact_windows(v, 12) for v in values]
            for s in range(max(0, b - a - 11)):
                owners = [next(w for w in t if w[0] <= s <= w[1] <= s + 11 <= w[2]) for t in trees]
                signature = tuple(int(part[w[1]]) for w in owners)
                if signature == before:
                    want[-1][2] = s
                else:
                    want.append([text, s, s, owners[0][1]])
                before = signature
    got = zip(*substring_dedup.stretches(tokens, offsets, 12, 4))
    assert [(t, i, j, c) for t, _, i, j, c in got] == [tuple(w) for w in want]


def test_recall_of_near_repeats(spark):
    """Passages with a changed word in about 50, at the contract's similarity, in texts of other words."""
    rnd = random.Random(12)
    fresh = lambda n: [f"w{rnd.randrange(10**5)}" for _ in range(n)]
    rows, planted = [], []
    for k in range(200):
        passage = fresh(rnd.randrange(60, 160))
        near = list(passage)
        while True:
            changed = list(near)
            changed[rnd.randrange(len(near))] = f"c{rnd.randrange(10**6)}"
            if len(grams(" ".join(passage), 5) & grams(" ".join(changed), 5)) < 0.8 * len(grams(" ".join(passage), 5) | grams(" ".join(changed), 5)):
                break
            near = changed
        rows += [(2 * k, " ".join(fresh(40) + passage + fresh(60))), (2 * k + 1, " ".join(fresh(70) + near + fresh(30)))]
        planted.append((2 * k, 2 * k + 1))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {tuple(sorted((r["doc_id"], r["first_id"]))) for r in got}
    assert found <= set(planted) and len(found) >= 0.95 * len(planted)


def test_matches_on_two_far_diagonals_are_no_failure():
    x = np.arange(60)
    y = np.concatenate([x[:30], 1000 + np.arange(500), x[30:]])
    assert substring_dedup.shared_passages(x, y, 47, 80) == []
    assert substring_dedup.shared_passages(x, y, 20, 80) == [(30, 60, 530, 560, 1.0), (0, 30, 0, 30, 1.0)]


def test_every_repeat_of_51_words_is_found(spark, sf, docs):
    rows = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    where = {}
    for i, w in rows.items():
        for k in range(len(w) - 50):
            where.setdefault(tuple(w[k : k + 51]), set()).add(i)
    truth = {i for ids in where.values() if len(ids) > 1 for i in ids}
    got = substring_dedup.op8_substring_dedup(spark, sf).collect()
    assert truth <= {r["doc_id"] for r in got} | {r["first_id"] for r in got}


def test_passages_on_odd_rows(odd, empty):
    assert substring_dedup.repeated_passages(odd).count() == 0
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_search_matches_sql(spark, sf, same):
    same(topk_search.op5_topk_search(spark, sf), topk_search.ORACLE)


def test_search_with_ties_blocks_and_odd_vectors(spark):
    rnd = random.Random(2)
    rows = [(i, [float(rnd.randrange(-2, 3)) for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(200)]
    rows += [(900, None), (950, [1.0, None, 0.0, 0.0]), (1000, [float("nan")] * 4), (1001, [1.0, 2.0]), (1002, []), (1050, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = topk_search.top_k(df.where("vec_id % 50 = 0"), df, 5, block=3).collect()
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    assert topk_search.top_k(df.limit(0), df).count() == 0


def test_a_tile_of_any_size_gives_the_best_k_beside_the_own_row():
    rnd = np.random.default_rng(4)
    for n in (3, 5, 6, *range(48, 56), 500, 501, 502, 503, 2048):
        ids = np.arange(n) * 3
        for scores in (rnd.integers(-50, 50, (4, n)), -rnd.integers(1, 9, (4, n)), rnd.integers(-(2**53), 2**53, (4, n))):
            own = np.array([0, ids[1], ids[-1], 1])
            rows, found, values = topk_search._best(scores, ids, own, 5)
            for r in range(4):
                want = sorted((-int(s), int(i)) for s, i in zip(scores[r], ids, strict=True) if i != own[r])[:5]
                assert sorted((-int(v), int(i)) for a, i, v in zip(rows, found, values, strict=True) if a == r) == want


def test_pipeline_stages(spark, sf, docs):
    from lexloom.llm import bpe_codec

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_join", "secret_scan", "mixing", "bpe_codec"]
    noise = spark.createDataFrame([(10**6, "123 456", None, "src0", 7), (10**6 + 1, None, None, None, None)], docs.schema)
    kept = stages["language_id"](spark, docs.unionByName(noise), sf)
    assert kept.columns == docs.columns and kept.where("doc_id >= 1000000").count() == 0 and kept.count() == docs.count()
    single = stages["ngram_join"](spark, docs, sf)
    _, least = brute_join([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert {r["doc_id"] for r in single.collect()} == set(least.values())
    redacted = stages["secret_scan"](spark, docs, sf)
    assert redacted.count() == docs.count() and redacted.where("text rlike '[0-9a-f]{32}'").count() == 0
    assert redacted.where("n_chars <> length(text) and text like '%REDACTED%'").count() == 0
    mixed = stages["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns and mixed.exceptAll(docs).count() > 0
    ids = stages["bpe_codec"](spark, mixed, sf)
    assert isinstance(ids.schema["ids"].dataType.elementType.typeName(), str) and ids.count() == mixed.count()
    del bpe_codec


def test_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids"] and out.count() > 0 and out.where(F.col("ids").isNull()).count() == 0
