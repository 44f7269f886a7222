"""Stages of the pipeline on odd tables, and operators whose tables are too large to be sent."""

import random

import pytest

import corpus_pipeline
from cataloom.llm import line_dedup, pii

SF = "/root/testdata/sf0.001"
RNG = random.Random(12)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(3, 8))) for _ in range(500)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n)) + "."


def odd_documents(spark):
    same = prose(60)
    rows = [(i, prose(40) + "\n" + prose(30), "en", "s", 0, "h", "i") for i in range(20)]
    rows += [(100, same, "en", "s", 0, "h", "i"), (101, same, "en", "s", 0, "h", "i"), (101, same, "en", "s", 0, "h", "i")]
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "s", 0, "h", "i"), (None, prose(50), "en", "s", 0, "h", "i"), (202, prose(9000), "en", "s", 0, "h", "i")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, id string")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty_documents(spark, name, stage):
    docs = odd_documents(spark)
    got = stage(spark, docs, SF)
    rows = got.collect()
    empty = stage(spark, docs.filter("false"), SF)
    assert empty.count() == 0 and empty.columns == got.columns
    if name == "packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
        return
    assert got.columns == docs.columns
    kept = {r.doc_id for r in rows}
    assert set(range(20)) <= kept and 202 in kept and None in kept  # clean documents stay
    if name == "near_dedup":
        assert len(kept & {100, 101}) == 1
    if name in ("toxicity", "decontamination"):
        assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))
    if name == "line_dedup":
        assert [r.text for r in rows if r.doc_id == 101] == ["", ""] and next(r.text for r in rows if r.doc_id == 100)


def test_tables_that_are_not_sent_give_the_same(spark, monkeypatch):
    rows = [(i, f"Zorblax writes from zed@mail.org in text {i}\n" + prose(20) + "\nthe same line of eight words stands here\n" + f"the same line of eight words stands {i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = lambda: sorted(map(str, pii.find_spans(df).collect()))
    lines = lambda: sorted(map(str, line_dedup.dedup_lines(df).collect()))
    before = spans(), lines()
    monkeypatch.setattr("cataloom.llm.common.SEND_BYTES", 0)
    assert (spans(), lines()) == before
