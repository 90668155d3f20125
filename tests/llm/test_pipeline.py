"""The pipeline's stages on the smallest tables and on the awkward one."""

import os

import corpus_pipeline
import pytest
from edge import documents, empty
from pyspark.sql import functions as F

import __spark_entry__ as entry
from splitclock.llm import bpe, pii, quality
from splitclock.llm.common import table, written
from splitclock.session import shared_dir


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)) and names["pipeline"] is corpus_pipeline.run
    assert {"op1_embedding", "op11_trie", "op12_ledger", "op13_merkle"} <= set(entry.oracle_sql())


def test_stages_take_effect(spark, tiny):
    docs = table(spark, tiny, "documents")
    kept = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = written(stage(spark, frame, tiny), name)
        assert frame.columns == docs.columns and dict(frame.dtypes) == dict(docs.dtypes)
        kept[name] = {r.doc_id: r.text for r in frame.collect()}
    first = {r.doc_id for r in quality.judged(docs, table(spark, tiny, "labels")).where("kept").collect()}
    assert set(kept["quality_rules"]) == first
    assert set(kept["simhash_dedup"]) < first and set(kept["suffix_dedup"]) == set(kept["simhash_dedup"]) == set(kept["mask_pii"])
    assert sum(map(len, kept["suffix_dedup"].values())) < sum(map(len, kept["simhash_dedup"].values()))
    assert not any(pii.base_spans(t)[0] for t in kept["mask_pii"].values())
    packed = corpus_pipeline.run(spark, tiny).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    enc = bpe.Encoder(bpe.public_vocabulary())
    assert {r.doc_id: r.n for r in packed} == {d: len(next(enc.encode([t]))) // 4 + 1 for d, t in kept["mask_pii"].items()}


@pytest.mark.parametrize("make", [documents, empty])
def test_stages_on_awkward_rows(spark, tiny, make):
    frame = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, tiny)
        assert out.columns == frame.columns
        frame = written(out, "stage")
    assert corpus_pipeline.STAGES[-1][1](spark, frame, tiny).count() >= frame.count()


def test_quality_rules_write_no_texts(spark, tiny, monkeypatch):
    """The texts that were written with their statistics stayed on disk while all later stages ran."""
    columns = []
    monkeypatch.setattr(quality, "written", lambda df, name: columns.append(df.columns) or written(df, name))
    before = set(os.listdir(shared_dir(spark)))
    docs = table(spark, tiny, "documents")
    out = corpus_pipeline.quality_rules(spark, docs, tiny)
    assert columns and not {"_row", "text"} & {c for names in columns for c in names}
    assert not set(os.listdir(shared_dir(spark))) - before
    want = {r.doc_id for r in quality.judged(docs, table(spark, tiny, "labels")).where("kept").collect()}
    assert {r.doc_id for r in out.collect()} == want and out.columns == docs.columns
