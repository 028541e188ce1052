from siftwise.llm import warc
from siftwise.llm.scratch import Scratch
from tests.llm.helpers import real


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, file int, digest string, seq int")


def test_audit_finds_exactly_the_damage(spark):
    rows = pages(spark, [(i, f"http://x/{i}", "é" * (i % 50), 0, "", 0) for i in range(2300)])
    found = warc.audit_pages(rows).collect()
    assert len(found) == 2300
    assert {r["page_id"] for r in found if r["corrupt"]} == {i for i in range(2300) if i % 101 == 7 or i % 211 == 3}
    for file in {r["file"] for r in found}:
        at = 0
        for r in sorted((r for r in found if r["file"] == file), key=lambda r: r["seq"]):
            assert r["record_offset"] == at
            at += r["record_length"]


def test_missing_records_and_shifted_offsets(spark):
    scratch = Scratch(spark, "test")
    rows = pages(spark, [(i, "u", "h", 0, "", 0) for i in range(40)])
    whole = warc.manifest(warc.to_records(rows), scratch)
    trees = [warc.tree_levels(t, 2) for t in (whole, whole.filter("page_id < 38"), whole)]
    assert sorted(r["node"] for r in warc.audit(trees[0], trees[1], scratch).collect()) == [38, 39]
    assert warc.audit(trees[0], trees[2], scratch).count() == 0


def test_a_file_of_very_many_records(spark):
    """Equal page_ids share a file; its tree is as high as it needs to be, and no node has more than FANOUT children."""
    rows = spark.range(5000).selectExpr("7L AS page_id", "'u' AS url", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('h', id) END AS html")
    found = warc.audit_pages(rows.union(spark.range(20).selectExpr("id", "'u'", "repeat('x', 1000000)"))).collect()
    own = sorted((r for r in found if r["page_id"] == 7), key=lambda r: r["seq"])
    assert len(found) == 5020 and len(own) == 5001 and all(r["corrupt"] for r in own)
    assert {r["page_id"] for r in found if r["corrupt"]} == {3, 7}
    scratch = Scratch(spark, "test")
    kept = warc.manifest(warc.to_records(rows), scratch)
    assert warc.levels_for(kept) == 4
    at = 0
    for r in sorted(kept.collect(), key=lambda r: r["seq"]):
        assert r["offset"] == at
        at += r["length"]


def test_round_trip_through_files(spark, tmp_path):
    path = str(tmp_path / "warc")
    rows = [*real(spark, "pages").limit(30).collect(), (1001, None, None), (1002, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nx\r\n\r\n")]
    df = spark.createDataFrame([tuple(r) for r in rows], "page_id long, url string, html string")
    records = warc.to_records(df)
    warc.write_warc(records, path)
    back = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert {i: (r["url"], r["html"]) for i, r in back.items()} == {r[0]: (r[1] or "", r[2] or "") for r in rows}
    told = {r["page_id"]: r["offset"] for r in warc.manifest(records, Scratch(spark, "test")).collect()}
    assert told == {i: r["offset"] for i, r in back.items()}


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = pages(spark, [(None, None, None, 0, "", 0), (None, "a", "b", 0, "", 0), (7, "u", "h", 0, "", 0), (7, "u", "h", 0, "", 0)])
    found = warc.audit_pages(df).collect()
    assert len(found) == 4 and [r["corrupt"] for r in found if r["page_id"] == 7] == [True, True]
    assert not any(r["corrupt"] for r in found if r["page_id"] is None)
    assert warc.audit_pages(df.limit(0)).count() == 0
