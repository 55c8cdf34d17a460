"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing names."""

import pytest

import corpus_pipeline
from tallyweave.llm import (
    copies, decontaminate, language, licenses, lines, neardup, pieces, quality, secrets, suffixes, toxicity,
)
from tallyweave.llm.queries import sentencepiece_model


def _benchmark(spark):
    return spark.createDataFrame([("b1", "one two three four five six"), (None, "x"), ("b2", None), ("b3", "")],
                                 "item_id string, text string")


def _labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda s, d: quality.quality_rules(d),
    "secrets": lambda s, d: secrets.digests(secrets.scan(d)),
    "language": lambda s, d: language.identify(d),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "licenses": lambda s, d: licenses.scan(d),
    "pieces": lambda s, d: pieces.encode_documents(d, sentencepiece_model(), digests=True),
    "lines": lambda s, d: lines.deduplicate_lines(d),
    "line report": lambda s, d: lines.line_report(d),
    "decontaminate": lambda s, d: decontaminate.contamination(d, _benchmark(s)),
    "suffixes": lambda s, d: suffixes.digests(suffixes.repeated_substrings(d, block_bytes=50_000)),
    "toxicity": lambda s, d: toxicity.toxicity(d, _labels(s)),
    "copies": lambda s, d: copies.exact_copies(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, odd, name):
    out = OPERATORS[name](spark, odd)
    key = lambda r: (r is None, r or 0)
    got = sorted((r["doc_id"] for r in out.collect()), key=key)
    assert got == sorted((r["doc_id"] for r in odd.collect()), key=key)
    repeated = [r for r in out.collect() if r["doc_id"] == 4]
    assert len(repeated) == 3
    assert any(repeated[i] == repeated[j] for i, j in ((0, 1), (0, 2), (1, 2)))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](spark, odd.filter("1 = 0")).collect() == []


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_columns(spark, odd, stage, tmp_path):
    _labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    _benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, odd, str(tmp_path))
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in odd.collect()}
    assert run(spark, odd.filter("1 = 0"), str(tmp_path)).collect() == []
