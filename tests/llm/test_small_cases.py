"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import (arc_convert, bwt_repeats, decontaminate, html_blocks, line_frequency,
                            packing, pseudonyms, size_aware_join, token_rollup, url_lists)
from tallyspark.llm.queries import vocabulary


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "one"), (2, None), (3, ""), (None, "the same text twice")],
                                 "item_id long, text string")


def operators(items):
    return {
        "quality": line_frequency.judge,
        "join": size_aware_join.join_classes,
        "decontaminate": lambda d: decontaminate.contaminated(d, items),
        "pseudonyms": lambda d: pseudonyms.pseudonymise(d, b"key"),
        "packing": lambda d: packing.pack_documents(d, vocabulary()),
        "repeats": bwt_repeats.remove_repeats,
        "counts": lambda d: token_rollup.token_counts(d, {"words-1": ""}),
        "pages": lambda d: html_blocks.extract(d, "doc_id", "url", "text"),
        "archive": lambda d: arc_convert.read_back(
            arc_convert.convert(arc_convert.to_arc(d, "doc_id", "url", "text", "date"))),
    }


@pytest.mark.parametrize("name", ["quality", "join", "decontaminate", "pseudonyms", "packing",
                                  "repeats", "counts", "pages", "archive"])
def test_odd_rows_and_empty_tables(name, odd, items):
    run = operators(items)[name]
    rows = run(odd).collect()
    if name not in ("decontaminate",):
        assert len(rows) == 11 if name != "packing" else len({r["sequence_id"] for r in rows}) > 0
    assert run(odd.where("false")).collect() == []


def test_defined_results(odd, items):
    ops = operators(items)
    kept = {r["doc_id"]: r for r in ops["quality"](odd).where("doc_id is not null").collect()}
    assert kept[1]["n_words"] == 0 and kept[1]["base_failed"] and not kept[1]["kept"]
    assert kept[6]["kept"] and kept[7]["kept"]
    found = {r["doc_id"]: r["component_id"] for r in ops["join"](odd).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, None: None}
    hits = sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in ops["decontaminate"](odd).collect())
    assert (4, 1) in hits and hits.count((6, 0)) == 2 and (7, 0) in hits
    cut = sorted((r["doc_id"] or 0, r["n_removed"]) for r in ops["repeats"](odd).collect())
    assert (7, 50) in cut and cut.count((6, 0)) == 2
    types = [(r["page_id"], r["record_type"], r["refers_to"]) for r in ops["archive"](odd).collect()]
    assert sorted(t for t in types if t[0] in (6, 7)) == [
        (6, "revisit", 7), (6, "revisit", 7), (7, "response", None)]


def test_one_response_for_a_payload(spark):
    """Rows with one id, also the largest, and rows without id share a payload."""
    rows = [(7, "u", "same"), (7, "u", "same"), (7, "v", "same"), (3, "u", "same"),
            (None, "u", "other"), (None, "u", "other"), (5, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "fetch_date", F.lit("20200101000000"))
    got = arc_convert.read_back(arc_convert.convert(arc_convert.to_arc(pages))).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == [
        (0, "response", 0), (0, "revisit", 0), (3, "revisit", 7), (5, "response", 0),
        (7, "response", 0), (7, "revisit", 7), (7, "revisit", 7)]


def test_urls(spark):
    rows = [(1, "http://a.b.example/x", "2024-03-01"), (1, "http://a.b.example/x", "2024-03-01"),
            (2, None, "2024-03-01"), (3, "http://a.b.example", None), (4, "no url", "2024-03-01"),
            (5, "http://a.b.example", "2024-02-29"), (6, "http://A.B.example.:80/", "2024-03-31"),
            (None, "https://u@c.example/?q", "2024-04-01")]
    captures = spark.createDataFrame(rows, "page_id long, url string, day string").withColumn(
        "month", F.lit(1)).withColumn("pattern", F.lit("x"))
    entries = spark.createDataFrame(
        [("b.example", "spam", "2024-03-01", "add"), ("b.example", "spam", "2024-03-31", "remove"),
         ("b.example", "spam", "2024-03-31", "add"), ("a.b.example", "adult", "2020-01-01", "add"),
         ("C.example", "spam", "2024-04-01", "add"), (None, "spam", "2024-04-01", "add"),
         ("c.example", None, "2024-04-01", "add"), ("c.example", "spam", None, "add")],
        "pattern string, category string, day string, action string")
    got = sorted(((r["page_id"] or 0), r["categories"], r["pattern"] or "")
                 for r in url_lists.judge_captures(captures, entries).collect())
    both = "adult,spam"
    assert got == [(0, "spam", "c.example"), (1, both, "a.b.example"), (1, both, "a.b.example"),
                   (2, "", ""), (3, "", ""), (4, "", ""), (5, "adult", "a.b.example"),
                   (6, "adult", "a.b.example")]
    assert url_lists.judge_captures(captures.where("false"), entries).count() == 0
    assert url_lists.judge_captures(captures, entries.where("false")).where("blocked").count() == 0


@pytest.mark.parametrize("url,host", [
    ("http://[::1]:80/x", "[::1]"), ("http://./x", None), ("http://a.B./x", "a.b"), ("http://", None),
    ("http://u:p@c.example:8080?q", "c.example"), ("no url", None), (None, None), ("http://[::1", None)])
def test_hosts(spark, url, host):
    frame = spark.createDataFrame([(url,)], "url string")
    assert frame.select(url_lists.host_of(F.col("url"))).first()[0] == host


def test_rollup_counts_a_batch_once(spark, tmp_path, docs):
    counts = token_rollup.token_counts(docs([(1, "a b c"), (2, None), (None, "d", None, None)]),
                                       {"words-1": ""})
    rollup = token_rollup.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().collect() == []
    assert rollup.commit("first", token_rollup.signed(counts, 1))
    assert not rollup.commit("first", token_rollup.signed(counts, 1))
    one = counts.where("doc_id = 1")
    assert rollup.commit("second", token_rollup.signed(one, -1))
    got = {(r["source"], r["documents"], r["tokens"]) for r in rollup.totals().collect()}
    assert got == {("src0", 1, 0), (None, 1, 1)}
    # Sums without a mark are those of a job that ended half-way.
    token_rollup.signed(one, 5).write.parquet(str(tmp_path / "rollup" / "sums" / "third"))
    assert {(r["source"], r["documents"], r["tokens"]) for r in rollup.totals().collect()} == got
    with pytest.raises(ValueError):
        rollup.commit("../x", token_rollup.signed(one, 1))


@pytest.mark.parametrize("k", range(5))
def test_stages(k, spark, odd, folder):
    name, step = corpus_pipeline.STAGES[k]
    rows = step(spark, odd, folder)
    if k < 4:
        assert rows.columns == corpus_pipeline.COLUMNS
    rows.collect()
    assert step(spark, odd.where("false"), folder).collect() == []
