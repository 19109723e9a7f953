"""Op 8: held-out accuracy on made and on given documents, edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from subscope.llm import quality
from tests.llm.helpers import docs, words


def made(rng, n):
    rows, good = [], {}
    for i in range(n):
        ok = rng.random() < 0.7
        text = words(rng, rng.randrange(20, 200))
        if not ok:
            text = text.replace(" ", "### " if i % 2 else " junkword ")
        source = "clean" if ok and rng.random() < 0.8 else "mixed"
        rows.append((i, text, "en", source, len(text)))
        good[i] = ok
    return rows, good


def test_views_and_combination_on_held_out_documents(spark):
    rng = random.Random(2)
    rows, good = made(rng, 900)
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in good.items() if i % 3 == 0],
                                   "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    model = quality.train(d, quality.good_labels(labels))
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    assert len(got) == 900
    rest = [i for i in good if i % 3]
    assert np.mean([got[i].accepted == good[i] for i in rest]) > 0.97
    meta = [got[i].metadata_score for i in rest]
    assert np.mean([m for m, i in zip(meta, rest) if good[i]]) > np.mean([m for m, i in zip(meta, rest) if not good[i]])
    assert all(0 <= x <= 1 for r in got.values() for x in (r.content_score, r.metadata_score, r.quality))


def test_given_documents_keep_the_clean_ones(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = quality.good_labels(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    model = quality.train(d, labels.where(F.col("doc_id") % 2 == 0))
    got = quality.score(d, model).join(labels.where(F.col("doc_id") % 2 == 1), "doc_id").collect()
    clean = [r.accepted for r in got if r.good]
    bad = [r.accepted for r in got if not r.good]
    assert np.mean(clean) > 0.97 and np.mean(bad) < 0.4


def test_a_few_wrong_labels_do_not_open_the_gate(spark):
    rng = random.Random(5)
    rows, good = made(rng, 900)
    said = {i: g for i, g in good.items() if i % 3 == 0}
    for i in [i for i, g in said.items() if not g][::8]:
        said[i] = True
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in said.items()], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    got = {r.doc_id: r.accepted for r in quality.score(d, quality.train(d, quality.good_labels(labels))).collect()}
    rest = [i for i in good if i % 3]
    assert np.mean([got[i] for i in rest if good[i]]) > 0.97
    assert np.mean([got[i] for i in rest if not good[i]]) < 0.1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "a b"), (5, "x y"), (5, "x y"), (6, "w " * 30_000)]
    d = docs(spark, rows).withColumn("quality", F.lit("extra"))
    none = quality.good_labels(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    model = quality.train(d, none)
    got = quality.score(d, model).collect()
    assert len(got) == 7 and all(r.accepted for r in got)
    some = spark.createDataFrame([(i, i % 2 if i < 9 else None, None) for i in range(12)] + [(1, 0, 0)],
                                 "doc_id long, quality int, toxic int")
    many = docs(spark, [(i, "good words here" if i % 2 else "bad ### !!") for i in range(12)] + rows)
    assert quality.score(many, quality.train(many, quality.good_labels(some))).count() == 19
    assert quality.score(docs(spark, []), model).count() == 0
    assert quality.train(docs(spark, []), none) is quality.ACCEPT_ALL
