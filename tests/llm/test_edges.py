"""Nulls, empty and repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest

from acopio.llm import decontaminate, html_extract, language_id, license_scan, line_dedup, near_dedup, packing, pii, quality_classifier, quality_rules
from corpus_pipeline import STAGES
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, r1 string, n_lines string, row string, node string, bucket int, piece int, ids string, whole string, c1 int"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 3000
ROWS = [
    (1, "a shared line of some length here\nown text of the first", "en"), (2, "a shared line of some length here\nown text of the second", None), (3, "A SHARED line of some length here  \nthird", "en"),
    (4, None, None), (5, "", "en"), (5, "", "en"), (None, "text without an id", "en"), (None, None, None), (6, LONG, "en"), (6, LONG, "en"), (7, "   \n\n ", "en"), (8, "\n", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "s", None, "x", "y", "z", "n", 1, 2, "i", "w", 3) for i, t, g in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_line_dedup(docs, none):
    out = line_dedup.line_dedup(docs)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.count() == len(ROWS)
    assert rows[1, "own text of the first"]["n_dropped"] == 1
    assert rows[3, "A SHARED line of some length here  \nthird"]["n_dropped"] == 0
    assert rows[4, ""]["n_lines"] == 1 and rows[8, "\n"]["n_lines"] == 2
    assert line_dedup.line_dedup(none).count() == 0


def test_quality_rules(docs, none):
    out = quality_rules.quality_rules(docs).collect()
    assert len(out) == len(ROWS) and all(r["base_failed"] for r in out if r["doc_id"] in (4, 5, 7, 8))
    assert not any(r["kept"] for r in out if r["n_words"] < 10)
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.quality_rules(none).count() == 0 == quality_rules.keep_good(none).count()


def test_packing(docs, none):
    out = packing.pack(docs, keep_ids=True)
    rows = out.collect()
    per = {}
    for r in rows:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in per.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert [r["length"] for r in rows if r["doc_id"] == 4] == [1]
    assert packing.sequences(out).count() == len(per)
    assert packing.pack(none).count() == 0


def test_classifier_and_language(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, F.lit(True))
    out = quality_classifier.classify(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    empty = quality_classifier.fit(none, labels.where("false"), F.lit(True))
    assert quality_classifier.classify(none, empty).count() == 0
    found = {r["doc_id"]: r for r in language_id.identify(docs, language_id.fit(docs, F.lit(True))).collect()}
    assert found[4]["lang_pred"] == found[7]["lang_pred"] == "und" and found[1]["lang_pred"] == "en"
    assert language_id.fit(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


def test_near_dedup(docs, none):
    nodes, rows = near_dedup.near_duplicates(docs)
    assert rows.count() == len(ROWS) and nodes.where("kept").count() == nodes.select("class_id", "node").where("kept or true").select("class_id").distinct().count() + nodes.where("class_id is null").count() - nodes.where("class_id is null").select("class_id").distinct().count()
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 6").count() == 1 and kept.where("doc_id = 5").count() <= 1
    assert near_dedup.drop_near_duplicates(none).count() == 0


def test_decontaminate(spark, docs, none):
    benchmark = spark.createDataFrame([(1, "nine ten eleven twelve thirteen fourteen one two"), (2, None), (3, "too short")], "item_id long, text string")
    out = decontaminate.find_matches(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(6, 1)} and len(out) == 2
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert decontaminate.drop_contaminated(docs, benchmark.where("false")).count() == len(ROWS)
    assert decontaminate.find_matches(docs, benchmark.where("false")).count() == 0
    assert decontaminate.find_matches(none, benchmark).count() == 0


def test_pii(docs, none):
    out = pii.pseudonymise(docs)
    assert set(out.columns) == set(docs.columns) | {"n_entities", "entity_kinds"} and out.count() == len(ROWS)
    assert out.where("doc_id = 4 and text is null and n_entities = 0").count() == 1
    assert pii.pseudonymise(none).count() == 0


def test_license_and_html(spark, docs, none):
    assert license_scan.scan(docs).count() == 0 == license_scan.scan(none).count()
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (None, "u", "<p>x"), (3, None, "<article><p>A&amp;B <b>c</article>")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_extract.extract(pages, html_extract.fit(pages), keep=("url",)).collect()}
    assert out[1]["text"] == out[2]["text"] == "" and out[3]["text"] == "A&B c" and out[3]["n_chars"] == 5
    assert html_extract.extract(pages.where("false"), html_extract.PRIOR).count() == 0


def test_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, "nine ten eleven twelve thirteen fourteen one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, none):
        for name, stage in STAGES:
            out = stage(spark, table, str(tmp_path))
            assert name == STAGES[-1][0] or out.columns == docs.columns
            assert out.count() >= 0
