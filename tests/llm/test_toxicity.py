from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from habitus.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark, words):
    """Clean texts; toxic ones hold one bad word among many, some in another language."""
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(900):
        own, lang, toxic = words(k, rng.randint(20, 120)).split(), rng.choice(["en", "fr"]), k % 5 == 0
        if toxic:
            bad = rng.choice(["vile", "nasty", "scumbag"] if lang == "en" else ["vilain", "ordure"])
            own.insert(rng.randrange(len(own)), rng.choice([bad, bad.upper() + "!!", bad + ","]))
        docs.append((k, " ".join(own), lang))
        labels.append((k, int(toxic)))
    docs += [(5000, None, "en"), (5001, "", None), (5002, "x", "en"), (None, "vile vile", "en"), (5, docs[5][1], "en")]
    labels += [(5001, 0), (5003, 1), (None, 1), (5002, None), (7, 0), (7, 0)]
    make = spark.createDataFrame
    return (
        make(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as toxic", "2 as english"),
        make(labels, "doc_id long, toxic int").selectExpr("*", "'x' as text", "0 as lang"),
    )


def test_unseen_toxic_documents_are_found_and_clean_ones_are_not(corpus):
    docs, labels = corpus
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = toxicity.score(docs.where("doc_id < 900 and doc_id % 3 = 0"), chain).collect()
    assert rows and all(r.toxic == (r.doc_id % 5 == 0) for r in rows)
    english = {r.doc_id: r.lang == "en" for r in docs.select("doc_id", "lang").collect()}
    for r in rows:
        if r.toxic:
            assert (r.p_toxic_english > r.p_toxic_other) == english[r.doc_id]


def test_every_row_is_scored(corpus):
    docs, labels = corpus
    chain = toxicity.train(docs, labels)
    rows = toxicity.score(docs, chain).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert not by_id[5000].toxic and not by_id[5001].toxic and by_id[None].toxic
    assert by_id[5000].p_toxic == by_id[5001].p_toxic
    kept = toxicity.accepted(docs, chain)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.toxic for r in rows)


def test_training_is_repeatable_and_bounded(corpus):
    docs, labels = corpus
    assert toxicity.labelled_words(docs, labels, 100).select("doc_id").distinct().count() <= 100
    one, two = (toxicity.train(docs.repartition(n), labels) for n in (2, 5))
    for a, b in zip(one, two, strict=True):
        assert (a.words == b.words).all() and abs(a.bias - b.bias) < 1e-9


def test_the_bound_holds_for_rows(corpus):
    docs, labels = corpus
    one = labels.where("toxic = 1").select("doc_id").first()[0]
    many = docs
    for k in range(5):  # one labelled id with very many rows, of equal and of different texts
        again = docs.where(f"doc_id = {one}").withColumn("text", F.concat("text", F.lit(f" {k}")))
        many = many.unionByName(again).unionByName(again)
    assert toxicity.labelled_words(many, labels.where(f"doc_id = {one}")).count() == 6
    assert toxicity.labelled_words(many, labels, 2).count() == 2


def test_later_models_see_the_earlier_categories(corpus):
    docs, labels = corpus
    chain = toxicity.train(docs, labels)
    assert [len(m.chained) for m in chain] == [0, 1, 2]
    assert chain[2].chained.min() > 0


def test_without_toxic_labels_nothing_is_toxic(corpus):
    docs, labels = corpus
    for none in (labels.where("toxic = 0"), labels.where("false")):
        chain = toxicity.train(docs, none)
        assert not any(r.toxic for r in toxicity.score(docs, chain).collect())
    assert toxicity.score(docs.where("false"), toxicity.train(docs, labels)).count() == 0
    assert toxicity.train(docs.where("false"), labels)


def test_sample_documents(spark, sample):
    folder = sample.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rows = toxicity.score(docs, chain).join(
        labels.select("doc_id", labels.toxic.alias("label")).where("doc_id % 2 = 1"), "doc_id"
    ).collect()
    assert sum(r.toxic and not r.label for r in rows) <= 0.02 * len(rows)
    assert sum(r.toxic and r.label > 0 for r in rows) >= 0.8 * sum(r.label > 0 for r in rows)
