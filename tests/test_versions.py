"""Published versions: validation, pruning of folders, lost writers and retired versions."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from lexloom.operators import index_tables
from lexloom.sources.versions import Layout, Versions, source_label


@pytest.fixture
def versions(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")


def words(spark, n, tag=""):
    return spark.range(n).select(F.concat(F.lit(f"w{tag}"), F.col("id")).alias("w"), F.col("id"))


def test_publish_and_lookup(spark, versions):
    assert versions.current() is None
    versions.publish("a", {"words": Layout(words(spark, 50), "w", 8, ["w"]), "meta": Layout(spark.createDataFrame([("n", 50)], "k string, v long"))})
    found = versions.current("a")
    assert sorted(r.id for r in found["words"].rows().collect()) == list(range(50))
    asked = spark.createDataFrame([("q1", "w7"), ("q2", "w41"), ("q3", "none"), ("q4", None)], "q string, k string")
    got = found["words"].lookup(asked, "k")
    assert sorted((r.q, r.w, r.id) for r in got.collect()) == [("q1", "w7", 7), ("q2", "w41", 41)]
    assert versions.current("b") is None


def test_only_asked_buckets_are_opened(spark, versions):
    table = versions.publish("a", {"words": Layout(words(spark, 400), "w", 16, ["w"])})["words"]
    asked = spark.createDataFrame([("w7",)], "k string")
    found = table.lookup(asked, "k")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan
    opened = {r[0] for r in table.df.where(F.col("_bucket").isin([r[0] for r in asked.select(F.pmod(F.xxhash64("k"), F.lit(16)).cast("int")).collect()])).select(F.input_file_name()).distinct().collect()}
    assert len(opened) == 1 and all("_bucket=" in x for x in opened)
    assert [r.id for r in found.collect()] == [7]


def test_empty_tables(spark, versions):
    versions.publish("a", {"words": Layout(words(spark, 0), "w", 8, ["w"]), "plain": Layout(words(spark, 0))})
    found = versions.current("a")
    assert found["words"].rows().count() == found["plain"].rows().count() == 0
    assert found["words"].lookup(spark.createDataFrame([("w1",)], "k string"), "k").count() == 0


def test_failed_check_leaves_the_old_version(spark, versions):
    versions.publish("a", {"words": Layout(words(spark, 5))})
    with pytest.raises(ValueError, match="too few"):
        versions.publish("a", {"words": Layout(words(spark, 2))}, lambda t: ["too few"] if t["words"].count() < 3 else [])
    assert versions.current("a")["words"].rows().count() == 5


def test_writer_lost_before_its_row(spark, versions, monkeypatch):
    versions.publish("a", {"words": Layout(words(spark, 5))})
    monkeypatch.setattr(Versions, "_say", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        versions.publish("a", {"words": Layout(words(spark, 9))})
    monkeypatch.undo()
    assert versions.current("a")["words"].rows().count() == 5
    versions.publish("a", {"words": Layout(words(spark, 9))})
    assert versions.current("a")["words"].rows().count() == 9


def test_prune_retires_before_it_deletes(spark, versions):
    for n in (1, 2, 3):
        versions.publish("a", {"words": Layout(words(spark, n))})
    versions.publish("b", {"words": Layout(words(spark, 7))})
    bases = [r.base for r in versions.published().where("label = 'a'").orderBy("at").collect()]
    assert versions.prune(1) == bases[1::-1] or set(versions.prune(1)) <= set(bases[:2])
    assert [os.path.isdir(b.removeprefix("file:")) for b in bases] == [False, False, True]
    assert versions.current("a")["words"].rows().count() == 3 and versions.current("b")["words"].rows().count() == 7
    assert versions.prune(1) == []


def test_bring_holds_tables_against_their_manifest(spark, versions):
    versions.publish("a", {"words": Layout(words(spark, 5), "w", 4)})
    row = versions.published().first()
    manifest = {n: (x.rows, x.digest) for n, x in row.tables.items()}
    other = Versions(spark, f"{versions.root}-other")
    other.bring("a", manifest, {"words": Layout(versions.current("a")["words"].rows(), "w", 2)})
    assert other.current("a")["words"].rows().count() == 5
    with pytest.raises(ValueError, match="other contents"):
        other.bring("a", manifest, {"words": Layout(words(spark, 5, "x"), "w", 2)})
    with pytest.raises(ValueError, match="missing"):
        other.bring("a", manifest, {})
    with pytest.raises(ValueError, match="not in the manifest"):
        other.bring("a", manifest, {"words": Layout(words(spark, 5)), "more": Layout(words(spark, 1))})


def test_source_label_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    words(spark, 3).write.parquet(path)
    first = source_label(spark.read.parquet(path))
    assert first == source_label(spark.read.parquet(path))
    words(spark, 3).write.mode("append").parquet(path)
    assert source_label(spark.read.parquet(path)) != first


def test_lexicon_index_is_built_once(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    root = f"file://{tmp_path}/index"
    found = index_tables.lexicon_index(docs, root)
    monkeypatch.setattr(index_tables, "build", None)
    again = index_tables.lexicon_index(docs, root)
    assert {n: t.rows().count() for n, t in found.items()} == {n: t.rows().count() for n, t in again.items()}


def test_problems_are_named(spark):
    good = spark.createDataFrame([("a", "en", 1, "a"), ("b", "en", 2, "b")], "w string, lang string, gid long, f string")
    ids, post = good.select("gid"), good.select("w")
    tables = {"words": good, "forms": good, "heads": ids, "trigrams": ids, "postings": post}
    assert index_tables.problems(tables) == []
    bad = tables | {"words": good.union(good.limit(1)), "heads": spark.createDataFrame([(9,)], "gid long"), "postings": spark.createDataFrame([("z",)], "w string")}
    assert [p.split(":")[0] for p in index_tables.problems(bad)] == ["words", "words", "heads", "forms", "postings"]
