"""Clean texts far longer than any that the models were fitted on."""

import os
import random

import numpy as np
import pytest

from driftline.llm import language_id, toxicity

SF = os.environ.get("TEST_LONG_SF_DIR", "/root/testdata/sf0.1")
SIZES = (100_000, 1_000_000, 5_000_000)


def joined(texts, size, r):
    out, length = [], 0
    while length < size:
        out.append(r.choice(texts))
        length += len(out[-1])
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_toxicity_does_not_grow_with_length(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(spark, docs, labels)
    found = toxicity.score(spark, docs, model).join(labels.selectExpr("doc_id", "toxic as label"), "doc_id").join(docs.select("doc_id", "text", "lang"), "doc_id").where("text is not null").collect()
    r, long, kept = random.Random(5), [], {}
    for x in found:
        if x.label == 0 and not x.toxic:
            kept.setdefault(x.lang, []).append(x.text)
    assert set(kept) == {"de", "en", "es", "fr"}
    for texts in kept.values():
        for size in SIZES:
            long += [(len(long), "\n".join(joined(texts, size, r))) for _ in range(5 if size < SIZES[-1] else 1)]
    severe = [x.text for x in found if x.label == 1 and x.p_toxic > 0.9][:5]
    hidden = []
    for text in severe:
        around = joined(kept["en"], 1_000_000, r)
        around.insert(len(around) // 2, text)
        hidden.append((len(long) + len(hidden), "\n".join(around)))
    out = {x.doc_id: x.toxic for x in toxicity.score(spark, spark.createDataFrame(long + hidden, "doc_id long, text string").repartition(8), model).collect()}
    assert len(severe) == 5 and [i for i, _ in long if out[i]] == []
    assert all(out[i] for i, _ in hidden)


def test_few_long_training_texts_set_no_lower_limit():
    r = np.random.default_rng(3)
    distance = np.concatenate([r.uniform(0.2, 0.56, 3000), r.uniform(0.08, 0.1, 60)])
    size = np.concatenate([np.full(3000, 10), np.full(60, 15)])
    limit = language_id.distance_limits(distance, size)
    assert limit[10] < 0.71 and (limit[10:] >= limit[10]).all() and (limit[:9] == 0.999).all()


def test_language_of_texts_longer_than_the_learned(spark, docs):
    by = {}
    for x in docs.where("lang is not null and length(text) between 300 and 4000").select("lang", "text").orderBy("doc_id").collect():
        by.setdefault(x.lang, []).append(x.text)
    r, train, long = random.Random(6), [], []
    for lang, texts in sorted(by.items()):
        train += [(lang, t) for t in texts[:500]] + [(lang, "\n".join(joined(texts, 60_000, r))) for _ in range(20)]
        long += [(lang, "\n".join(joined(texts, size, r))) for size in SIZES]
    model = language_id.fit(spark, spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train)], "doc_id long, text string, lang string"))
    out = {x.doc_id: (x.lang_pred, x.rejected) for x in language_id.identify(spark, spark.createDataFrame([(i, t) for i, (_, t) in enumerate(long)], "doc_id long, text string").repartition(8), model).collect()}
    assert [out[i] for i in range(len(long))] == [(lang, False) for lang, _ in long]
