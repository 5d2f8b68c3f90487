"""Audits of bundles: every rule on records by hand, and the comparison of builds against counters."""

import random
from collections import Counter

import pytest

from lexloom.operators import bundle_audit

SHAPE = [("present", 2), ("past", 1)]
RECORDS = "name string, conjugation array<array<string>>, freq double, extra int"
GOOD = [["a", "b"], ["c"]]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(
        [
            ("good", GOOD, 3.0, 1), ("twice", GOOD, 0.0, 1), ("twice", GOOD, 8.0, 2), ("twice", GOOD, None, 3),
            ("short", [["a", "b"]], 99.0, 1), ("none", None, 1.0, 1), ("shape", [["a"], None], 1.0, 1), ("null cell", [["a", None], ["c"]], 1.0, 1),
            ("empty", [["", ""], [""]], 1.0, 1), ("dirty", [["a", "x�"], ["{{y}}"]], 1.0, 1), ("nan", GOOD, float("nan"), 1),
            ("high", GOOD, 8.01, 1), ("inf", GOOD, float("-inf"), 1), (None, GOOD, 1.0, 1), (None, GOOD, 1.0, 1), ("v", [["a/b/c", "a"], ["d"]], 1.0, 1),
        ],
        RECORDS,
    )


def test_record_violations(records):
    got = {(r["name"], r["reason"], r["tense"]): r["n"] for r in bundle_audit.record_violations(records, SHAPE).collect()}
    assert got == {
        ("twice", "duplicate root", None): 2, (None, "duplicate root", None): 1, ("short", "wrong tense count", None): 1, ("none", "wrong tense count", None): 1,
        ("shape", "wrong row shape", "present"): 1, ("shape", "wrong row shape", "past"): 1, ("null cell", "wrong row shape", "present"): 1,
        ("empty", "empty table", None): 1, ("dirty", "dirty cell", None): 1,
        ("nan", "invalid frequency", None): 1, ("high", "invalid frequency", None): 1, ("inf", "invalid frequency", None): 1,
    }
    assert bundle_audit.record_violations(records.limit(0), SHAPE).count() == 0


def test_filled_cells_and_samples(records):
    got = {r["tense"]: (r["filled"], r["total"]) for r in bundle_audit.filled_cells(records, SHAPE).collect()}
    assert got == {"present": (26, 29), "past": (12, 13)}
    rows = bundle_audit.samples(records, 2).collect()
    kind = lambda k: [(r["rank"], r["name"], r["measure"]) for r in rows if r["kind"] == k]
    assert kind("sparse") == [(1, "empty", 0), (2, "none", 0)] and kind("variants") == [(1, "v", 3), (2, "dirty", 1)]
    assert len(kind("digest")) == 2
    assert bundle_audit.samples(records.limit(0), 2).count() == 0


def test_difference_equals_counters(spark):
    rng = random.Random(3)
    make = lambda: [(rng.choice("abc "), rng.choice([1, 2, None]), "hot") for _ in range(60)] + [("hot", 1, None)] * 50
    left, right = make(), make()[:-7]
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, x string")
    got = {(r["k"], r["v"], r["x"]): r["surplus"] for r in bundle_audit.difference(frame(left), frame(right).select("x", "v", "k")).collect()}
    want = Counter(right)
    want.subtract(Counter(left))
    assert got == {k: n for k, n in want.items() if n}
    assert bundle_audit.difference(frame(left), frame(left[::-1])).count() == 0
    with pytest.raises(ValueError):
        bundle_audit.difference(frame(left), frame(left).drop("x"))


def test_index_and_download(spark, records):
    index = lambda rows: spark.createDataFrame(rows, "prefix string, ids array<long>")
    rows = index([("a", [0, 15]), ("", [1]), (None, [1]), ("b", []), ("c", None), ("d", [16]), ("e", [-1]), ("f", [None]), ("g", [1] * 201)])
    got = {r["prefix"]: r["reason"] for r in bundle_audit.index_violations(rows, records).collect() if r["prefix"]}
    assert got == {"b": "no ids", "c": "no ids", "d": "id out of range", "e": "id out of range", "f": "id out of range", "g": "too many ids"}
    verbs = lambda rows: spark.createDataFrame(rows, "name string, name_plain string, freq double, conjugation array<array<string>>")
    good = [("a", "a", 1.0, GOOD), ("b", "b", -1.0, GOOD)]
    problems = lambda v, i: {r["reason"]: r["n"] for r in bundle_audit.download_problems(verbs(v), index(i), SHAPE).collect()}
    assert problems(good, [("a", [0, 1])]) == {}
    assert problems([], [("a", [0])]) == {"no verbs": 1, "invalid search references": 1}
    assert problems(good, []) == {"no search index": 1}
    bad = [("", "x", 1.0, GOOD), ("x", None, 1.0, GOOD), ("x", "x", float("inf"), GOOD), ("x", "x", None, GOOD), ("x", "x", 1.0, GOOD[:1]), ("x", "x", 1.0, [["a"], ["c"]])]
    assert problems(bad, [("a", [5])]) == {"incompatible conjugation data": 5, "incompatible pronoun data": 1}
