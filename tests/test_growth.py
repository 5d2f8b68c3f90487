"""What keeps figures from growing faster than the input."""

from pyspark.sql import functions as F

import corpus_pipeline
from lexloom import catalogue
from lexloom.functions import text as t
from lexloom.operators import entry_details, index_tables
from lexloom.sources.versions import Versions


def test_stages_of_the_pipeline_get_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "the dog and the cat", "en", "a", 19)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(name)
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_duplicates, corpus_pipeline.encode_ids):
        spark.conf.set(name, "10000")
        stage(spark, docs, "")
        assert int(spark.conf.get(name)) <= 1000
    spark.conf.set(name, before)


def _parts(spark, tmp_path, *names):
    spark.createDataFrame([(1, "a b b", "en"), (1, "b", "en"), (2, "A c d", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/docs")
    docs, root = spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/index"
    found = index_tables.lexicon_index(docs, root, names)
    return found, {r["label"].rsplit("/", 1)[1] for r in Versions(spark, root).published().collect()}


def test_words_alone_make_no_postings(spark, tmp_path):
    found, published = _parts(spark, tmp_path, "words", "forms")
    assert published == {"lexicon", "words"}
    assert sorted(r.w for r in found["words"].rows().collect()) == ["a", "b", "c", "d"]


def test_prefixes_alone_make_no_other_table(spark, tmp_path):
    assert _parts(spark, tmp_path, "prefixes")[1] == {"lexicon", "prefixes"}


def test_postings_are_distinct_and_bucketed_by_their_own_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_tables, "BUCKET_ROWS", 1)
    found, _ = _parts(spark, tmp_path, "postings", "form_lookup")
    assert sorted((r.w, r.doc_id) for r in found["postings"].rows().collect()) == [("a", 1), ("a", 2), ("b", 1), ("c", 2), ("d", 2)]
    # Seven tokens of four words.
    assert found["postings"].buckets == 7


def test_romanised_words_are_spread_by_number(spark, sf):
    plan = catalogue.QUERIES["romanization_words"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_readings_are_made_once(spark, sf):
    plan = catalogue.QUERIES["headword_romanizations"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("romanization, ") + plan.count("arrays_overlap") == plan.count("arrays_overlap") == 1


def test_romanised_keys_stay_as_they_were(spark):
    rows = spark.createDataFrame([("Šč áž",), ("  ",), ("’",), (None,), ("ǰ-x",)], "w string")
    got = [r[0] for r in rows.select(t.romanization_key(F.col("w"), "ru")).collect()]
    assert got == ["shch azh", None, "’", None, "y kh"]


def test_readings_of_repeated_forms_keep_their_order(spark):
    forms = "array<struct<form:string,tags:array<string>,source:string,roman:string>>"
    tag = ["romanization"]
    rows = spark.createDataFrame([("ru", "слово", [("b ", tag, None, None), ("a", tag, None, None), ("b", tag, None, None), ("b ", tag, None, None), ("-", tag, None, None)])], f"lang_code string, word string, forms {forms}")
    assert rows.select(entry_details.romanizations().alias("r")).first().r == ["b", "a"]
