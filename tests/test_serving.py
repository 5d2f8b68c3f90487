"""A table that a stream keeps current."""

import random

import pytest

from lexloom.streaming.serving import ServingTable, keep_current

SCHEMA = "word string, at int, gloss string, deleted boolean"


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return ServingTable(spark, str(tmp_path / "table"), schema, "word", ["at"], buckets=8)


def rows(df):
    return sorted(tuple(r)[:3] for r in df.collect())


def of(spark, *values):
    return spark.createDataFrame([(*v, False)[:4] if len(v) == 3 else v for v in values], SCHEMA)


def test_stream_of_files(spark, table, tmp_path):
    files = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files)
    of(spark, ("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z"), (None, 1, "n")).coalesce(1).write.parquet(files)
    keep_current(stream(), table, str(tmp_path / "state"))
    assert rows(table.rows()) == [("a", 2, "z"), ("b", 1, "y")]
    before = table._folders()
    of(spark, ("b", 2, "w"), ("a", 1, "late")).coalesce(1).write.mode("append").parquet(files)
    keep_current(stream(), table, str(tmp_path / "state"))
    assert rows(table.rows()) == [("a", 2, "z"), ("b", 2, "w")] and rows(table.rows(0)) == [("a", 2, "z"), ("b", 1, "y")]
    # A row that came late rewrites its bucket and changes nothing, so only b is emitted.
    assert [(r["word"], r["emitted"]) for r in table.emitted(0).collect()] == [("b", "changed")]
    assert len(before) == 2 and rows(table.lookup(of(spark, ("b", 0, ""), ("q", 0, "")))) == [("b", 2, "w")]


def test_other_buckets_stay(spark, table):
    table.refresh(of(spark, *[(w, 1, "x") for w in "abcdefghij"]), 0)
    before = table._folders()
    touched = table.refresh(of(spark, ("c", 2, "y")), 1)
    after = table._folders()
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == set(touched)


def test_deleted_keys_stay_gone(spark, table):
    table.refresh(of(spark, ("a", 1, "x"), ("b", 1, "x")), 0)
    table.refresh(of(spark, ("a", 5, None, True)), 1)
    table.refresh(of(spark, ("a", 3, "late"), ("c", 1, "x")), 2)
    assert rows(table.rows()) == [("b", 1, "x"), ("c", 1, "x")]
    assert sorted((r["word"], r["emitted"]) for r in table.emitted(0).collect()) == [("a", "gone"), ("c", "new")]
    assert sorted((r["word"], r["emitted"]) for r in table.emitted(-1).collect()) == [("b", "new"), ("c", "new")]


def test_replayed_and_lost_batches(spark, table, monkeypatch):
    table.refresh(of(spark, ("a", 1, "x")), 0)
    assert table.refresh(of(spark, ("a", 9, "again")), 0) == []
    # The driver is lost after the data is written and before it is named.
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.refresh(spark.range(1).selectExpr("'a' word", "2 at", "'y' gloss", "false deleted"), 1)
    assert rows(table.rows()) == [("a", 1, "x")]
    table.refresh(of(spark, ("a", 2, "y")), 1)
    assert rows(table.rows()) == [("a", 2, "y")]


def test_empty(spark, table):
    assert table.rows().collect() == [] and table.refresh(of(spark, (None, 1, "x")), 0) == [] and table.emitted(-1).collect() == []


def test_equals_all_rows_at_once(spark, table):
    rng, seen = random.Random(3), {}
    for batch in range(3):
        came = [(rng.choice("abcdefghijklmnop"), rng.randrange(20), rng.choice("xyz"), rng.random() < 0.2) for _ in range(30)]
        table.refresh(of(spark, *came), batch)
        for w, at, gloss, gone in came:
            seen[w] = max(seen.get(w, (-1, False, "")), (at, gone, gloss))
    assert rows(table.rows()) == sorted((w, at, gloss) for w, (at, gone, gloss) in seen.items() if not gone)
