"""Label sections of the audit queries."""

from __future__ import annotations

from casemill.plans import audits


def test_all_sections_of_a_substance_are_mined(spark, tmp_path):
    docs = [
        (1, "ALPHAMINE with BETAMINE", "label_section"),
        (2, "ALPHAMINE: avoid GAMMAMINE, muscle pain", "label_section"),
        (3, "ALPHAMINE and BETAMINE: muscle pain", "label_section"),
        (4, "Avoid BETAMINE with ALPHAMINE", "label_section"),
        (5, "GAMMAMINE alone", "label_section"),
        (6, "BETAMINE and GAMMAMINE", "post"),
        (7, None, "label_section"),
    ]
    spark.createDataFrame(docs, "doc_id bigint, text string, doc_type string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("ALPHAMINE",), ("BETAMINE",), ("GAMMAMINE",)], "name string").write.parquet(str(tmp_path / "substances.parquet"))
    got = {(r["item_a"], r["item_b"]) for r in audits.mention_pairs(spark, str(tmp_path)).collect()}
    assert got == {("ALPHAMINE", "BETAMINE"), ("ALPHAMINE", "GAMMAMINE")}
    status = {(r["item_a"], r["item_b"]): (r["texts_available"], r["named"], r["status"]) for r in audits.verified_controls(spark, str(tmp_path)).collect()}
    assert status == {("ALPHAMINE", "BETAMINE"): (1, True, "restriction"), ("ALPHAMINE", "GAMMAMINE"): (2, True, "restriction")}
