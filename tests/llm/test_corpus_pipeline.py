from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontamination import by_hand as overlaps_by_hand
from test_packing import expected
from test_simhash import by_hand as print_by_hand
from test_simhash import classes

import corpus_pipeline
from habitus.llm import pii, toxicity


@pytest.fixture(scope="module")
def stages(spark, sample, tmp_path_factory):
    """What each stage gets and gives, written and read as the pipeline does."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sample).write.parquet(f"{folder}/{name}")
        out.append((docs, spark.read.parquet(f"{folder}/{name}")))
        docs = out[-1][1]
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_of_documents_stay(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_toxic_documents_go(spark, sample, stages):
    before, after = stages[0]
    chain = toxicity.train(before, spark.read.parquet(f"{sample}/labels.parquet"))
    clean = toxicity.score(before, chain).where("NOT toxic")
    assert ids(after) == ids(clean) and 0 < before.count() - after.count() < 0.3 * before.count()


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]
    rows = before.collect()
    names = [r.doc_id for r in rows]
    assert ids(after) == sorted(set(classes(names, [print_by_hand(r.text) for r in rows])))
    assert after.count() < before.count()


def test_contaminated_documents_go(spark, sample, stages):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sample}/benchmark.parquet").collect()]
    found = {d for d, *_ in overlaps_by_hand([(r.doc_id, r.text) for r in before.collect()], items)}
    assert found and ids(after) == sorted(set(ids(before)) - found)


def test_personal_data_is_masked(stages):
    before, after = stages[3]
    assert ids(after) == ids(before)
    assert pii.find(before).where(F.size("spans") > 0).count() > 0
    texts = {r.doc_id: r.text for r in after.collect()}
    for r in pii.find(before).collect():
        for s in r.spans:
            assert f"[{s['kind'].upper()}]" in texts[r.doc_id]


def test_all_ids_are_packed(stages, vocabulary):
    before, after = stages[4]
    rows = before.collect()
    packed = {}
    for r in after.collect():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        packed.setdefault(r.doc_id, []).append((r.start, r.ids))
    for r, want in zip(rows, expected([r.text for r in rows], vocabulary), strict=True):
        assert [i for _, part in sorted(packed[r.doc_id]) for i in part] == want


def test_run_gives_the_last_stage(spark, sample, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "sequence_id"]
    got = corpus_pipeline.run(spark, sample).select(columns).collect()
    assert sorted(got) == sorted(stages[-1][1].select(columns).collect())


def test_odd_rows_pass_every_stage(spark, sample, make_docs):
    docs = make_docs([(None, "a b c"), (None, None), (1, None), (1, None), (2, ""), (3, "x y z"), (3, "x y z"), (4, "p q r s t")])
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for none in (docs, docs.where("false")):
        rows = none
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sample)
        assert rows.count() == 0 or none is docs
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sample).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == [("3", "x y z"), ("4", "p q r s t"), ("None", "a b c")]
    assert [r.doc_id for r in kept if not r.text] == [1]  # blank texts are one group


def test_unrelated_rows_of_one_id_stay(spark, sample, words):
    rows = [(1, words(1, 30)), (1, words(2, 30)), (None, words(1, 30)), (None, words(3, 30))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sample).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in (rows[0], rows[1], rows[3]))
