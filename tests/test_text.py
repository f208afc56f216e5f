"""Column functions against hand-computed cases."""

from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.operators import ingest


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


def test_chunk_ids_sort_by_page_then_chunk(spark):
    ids = ["doc_page_10_chunk_1", "doc_page_2_chunk_3", "doc_page_2_chunk_1", "doc_page_Sheet_A_chunk_1"]
    rows = ingest.sequence_chunks(spark.createDataFrame([("f", i) for i in ids], "file_name string, chunk_id string")).collect()
    assert {r["chunk_id"]: r["sequence_number"] for r in rows} == {"doc_page_2_chunk_1": 1, "doc_page_2_chunk_3": 2, "doc_page_10_chunk_1": 3, "doc_page_Sheet_A_chunk_1": 4}


def test_names(spark):
    assert one(spark, "  Baker-Hughes! ", t.norm_name) == "baker hughes"
    assert one(spark, "Baker - Hughes", t.norm_name) == "baker   hughes"
    assert one(spark, "Baker - Hughes", t.loose_name) == "baker hughes"
    assert one(spark, "  Baker-Hughes! ", t.entity_key) == one(spark, "baker hughes", t.entity_key)
    assert one(spark, "漢字", t.norm_name) == ""


def test_keywords(spark):
    words = lambda x: t.norm_keywords(x, F.lit("supplies"), 2)
    assert one(spark, ["Safety Case", "safety-case", "Permit"], words, "array<string>") == ["safety_case", "permit"]
    assert one(spark, [], words, "array<string>") == ["supplies"]
    assert one(spark, None, words, "array<string>") == ["supplies"]


def test_section_hint(spark):
    assert one(spark, "3.2 PERFORMANCE TESTS\nbody", t.section_hint) == "3.2 PERFORMANCE TESTS"
    assert one(spark, "SCOPE OF WORK\nbody", t.section_hint) == "SCOPE OF WORK"
    assert one(spark, "A plain sentence that goes on.\nbody", t.section_hint) is None
    assert one(spark, "", t.section_hint) is None


def test_scores(spark):
    assert [one(spark, x, t.confidence) for x in ("0.4", "1.5", "-1", "NaN", "high", None)] == [0.4, 1.0, 0.0, 0.0, 0.75, 0.75]
    assert [one(spark, x, t.strength) for x in ("7", "99", "0", "7.9", " 8 ", None)] == [7, 10, 1, 5, 8, 5]


def test_clip_and_whitespace(spark):
    assert one(spark, "a  b\n c", lambda x: t.clip(x, 10)) == "a b c"
    assert one(spark, "abcdefghij", lambda x: t.clip(x, 5)) == "abcd…"
    assert one(spark, "a\r\n\r\n\r\n\r\nb  c ", t.clean_whitespace) == "a\n\nb c"


def test_clean_chunks(spark):
    rows = [("f", p, f"ACME Tender\nText of page {p}.\nPage {p} of 3\n-----") for p in (1, 2, 3)] + [("g", 1, "12")]
    out = {(r["file_name"], r["page"]): (r["status"], r["cleaned"]) for r in ingest.clean_chunks(spark.createDataFrame(rows, "file_name string, page int, text string")).collect()}
    assert out[("f", 2)] == ("cleaned", "Text of page 2.")
    assert out[("g", 1)] == ("fully_removed", "")
