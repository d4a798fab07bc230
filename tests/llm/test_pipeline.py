"""The pipeline's stages, and every corpus query on the smallest tables."""

import os
import re

import pytest

import corpus_pipeline
from herdflow.llm import decontam, queries, simhash
from tests.conftest import SF_SMALL
from tests.llm import common

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test tables not present")


def test_stages_and_all_dealt_operators_are_registered():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "simhash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    found = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found if n != "pipeline") == list(range(1, 14))
    assert set(queries.oracles()) <= set(found)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [decontam.normalised(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF_SMALL).cache()
        if name != "sharding":
            assert after.columns == columns
        kept = {r.doc_id: r.text for r in after.collect()}
        came = {r.doc_id: r.text for r in before.collect()}
        assert set(kept) <= set(came) and all(kept[k] == came[k] for k in kept)
        if name == "simhash near-dedup":
            prints = [simhash.fingerprint(t) for t in kept.values()]
            assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
        if name == "benchmark decontamination":
            assert not any(b in decontam.normalised(t) for t in kept.values() for b in bench)
        before = after
    assert after.columns == [*columns, "shard", "slot"]
    whole = corpus_pipeline.run(spark, SF_SMALL)
    assert common.rows(whole, *whole.columns) == common.rows(after, *after.columns)
