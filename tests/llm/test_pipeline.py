"""The corpus pipeline and the registered queries of the subpackage."""

from __future__ import annotations

import re

import brute
import pytest

import __spark_entry__ as E
import corpus_pipeline
from termlens.llm.common import written
from oracle_check import compare

SF = "/root/testdata/sf0.001"
NAMES = [n for n in E.queries() if n == "pipeline" or re.match(r"op\d+_", n)]


def test_all_fourteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES if n != "pipeline") == list(range(1, 14)) and "pipeline" in NAMES


@pytest.mark.parametrize("name", [n for n in NAMES if n in E.oracle_sql()])
def test_query_matches_sql(spark, duck, name):
    assert compare(E.queries()[name](spark, SF).toPandas(), duck.execute(E.oracle_sql()[name]).df()) is None


def test_stages_step_by_step(spark):
    """Every stage against the plain version of its decision, on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = stage(spark, docs, SF)
        if name == "best_fit_packing":
            break
        docs = written(docs, name)
        after = docs.toPandas()
        assert docs.columns == cols
        kept = set(after.doc_id)
        if name == "language_id":
            assert kept == {d for d, t in zip(before.doc_id, before.text) if t and any(map(str.isalpha, t))}
        elif name == "simhash_near_dedup":
            comp = brute.linked(before.doc_id.tolist(), [brute.simhash(t) for t in before.text])
            assert kept == set(comp) and len(after) == len(kept)
        elif name == "benchmark_decontamination":
            assert kept == {d for d, t in zip(before.doc_id, before.text) if not brute.contamination(t, items)[1]}
        elif name == "pii":
            assert kept == set(before.doc_id) and not any(brute.pii_base(t) for t in after.text)
            clean = {d: t for d, t in zip(before.doc_id, before.text) if not re.search("[0-9@]", t)}
            assert all(t == clean[d] for d, t in zip(after.doc_id, after.text) if d in clean)
    got = docs.toPandas()
    assert set(got.doc_id) == kept and got.groupby("sequence_id").length.sum().max() <= 2048


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
