"""Operator 12 against plain Python."""

import hashlib
import math
import re
import zlib

from lexloom.llm import importance_resampling as ir

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, target, percent=5, min_words=20):
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        grams = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(g.encode()) % 10_000 for g in grams]

    s, t, found = [0] * 10_000, [0] * 10_000, []
    for i, text in docs:
        n, buckets = features(text)
        found.append((i, n, buckets))
        for b in buckets:
            s[b] += 1
    for _, text in target:
        for b in features(text)[1]:
            t[b] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log(float(t[k] + 1) * float(all_s + 10_000) / (float(s[k] + 1) * float(all_t + 10_000)))) for k in range(10_000)]
    out = []
    for i, n, buckets in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        out.append([i, n, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(order[: len(order) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def got(df, target, **options):
    return sorted((tuple(r) for r in ir.resample(df, target, **options).collect()), key=repr)


def test_tables(spark, sf, docs):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in target.select("item_id", "text").collect()])
    assert got(docs, target) == want
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    out = ir.QUERIES["op12_importance_resampling"](spark, sf)
    assert sorted((tuple(r[n] for n in names) for r in out.collect()), key=repr) == want
    assert dict(out.dtypes) == dict.fromkeys(names, "bigint")


def test_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([(1, "the cat sat"), (1, None), (None, "")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    whole = odd.unionByName(odd)
    options = {"percent": 60, "min_words": 3}
    pairs = [tuple(r) for r in target.collect()]
    assert got(odd, target, **options) == brute(rows, pairs, **options)
    assert got(whole, target, **options) == brute(rows + rows, pairs, **options)
    assert got(empty, target) == []
    assert got(odd, target.limit(0), **options) == brute(rows, [], **options)


def test_words_of_any_letters(spark):
    texts = ["ÀB cD-1é  x", " lead and trail ", "Σ σ Straße İ", "--", "a", "a b", "0 9:@[`{z"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    target = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert got(df, target, min_words=1, percent=100) == brute(list(enumerate(texts)), [(1, "a b c")], min_words=1, percent=100)
