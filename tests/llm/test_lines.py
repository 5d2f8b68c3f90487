"""Operator 11 against plain Python and its SQL."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from lexloom.llm import line_dedup as ld

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_chars=20, min_docs=3):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for r, (_, lines) in enumerate(split):
        for line in lines:
            if len(key(line)) >= min_chars:
                held[key(line)].add(r)
    keeper = {k: max((split[r][0] for r in rs if split[r][0] is not None), default=None) for k, rs in held.items() if len(rs) >= min_docs}
    out = []
    for i, lines in split:
        kept = [x for x in lines if keeper.get(key(x)) in (None, i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in ld.dedup_lines(df, **options).collect()), key=repr)


COMMON = "All rights reserved by the authors"
ROWS = [
    (1, f"{COMMON}\nown line of the first document\n{COMMON}"),
    (2, f"  {COMMON.upper()}\t\nshort"),
    (3, f"{COMMON}\n"),
    (3, f"{COMMON} \nanother text of the same id"),
    (4, "é" * 20 + "\n" + "é" * 19),
    (5, "é" * 20 + "\r\n" + "é" * 19),
    (6, "É" * 20 + "\n" + "é" * 19),
    (7, "é" * 20),
    (None, f"{COMMON}\nheld by rows without an id"),
    (None, "held by rows without an id"),
    (None, "held by rows without an id"),
    (8, None),
    (9, ""),
    (10, "\n\n"),
    (11, "x" * 20 + " "),
    (12, "x" * 20),
    (13, "x" * 20),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, line string, row_key long")
    want = brute(ROWS)
    assert got(df) == want
    # Every way: keys in shards alone, and all in the broadcast table.
    assert got(df, probes=2) == want
    assert got(df, hot=1) == want
    assert got(df, hot=10**9) == want


def test_odd_rows_and_empty(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd, min_docs=2) == brute(rows, min_docs=2)
    assert got(empty) == []


def test_tables(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == brute(rows)
    hashed = {(r[0], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute(rows)}
    out = ld.dedup_lines(docs).select("doc_id", F.sha2("text", 256).alias("h")).collect()
    assert {tuple(r) for r in out} == hashed


def test_query_and_sql(spark, sf, same):
    same(ld.QUERIES["op11_line_dedup"](spark, sf), ld.ORACLES["op11_line_dedup"])
