"""Op 6: held-out accuracy, calibration and the defined edge cases."""

import random
import zlib

import numpy as np

from subscope.llm import langid, linear
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs

SYLLABLES = {"aa": ["ba", "lo", "mi", "ra"], "bb": ["sch", "ung", "ein", "ß"], "cc": ["é", "tion", "ou", "ai"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_learns_and_calibrates(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((i, text(rng, lang, rng.randrange(3, 60)), lang if i % 7 else None, "s", 0))
    got = {r.doc_id: r for r in langid.identify(docs(spark, rows)).collect()}
    assert len(got) == 600
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    known = [(got[r[0]].lang_pred == r[2]) for r in rows if r[2] and got[r[0]].held_out]
    assert np.mean(known) > 0.97


def test_held_out_accuracy_on_the_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9


def test_edges(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12 !?", "en", "s", 4), (None, "abc", "en", "s", 3),
            (5, "the of and", "en", "s", 9), (5, "the of and", "en", "s", 9), (6, "x" * 40_000, None, "s", 9)]
    got = langid.identify(docs(spark, rows)).collect()
    assert len(got) == 7
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)] == [("und", 0.0)] * 3
    assert langid.identify(docs(spark, [])).count() == 0
    none = langid.identify(docs(spark, [(1, "abc", None, "s", 3)])).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)


def test_temperature_and_sparsity():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    s = np.zeros((4000, 2))
    s[np.arange(4000), np.where(rng.random(4000) < 0.8, y, 1 - y)] = 8.0  # far too sure at 80 % right
    t = linear.temperature(s, y)
    assert abs(linear.softmax(s / t).max(axis=1).mean() - 0.8) < 0.02
    x = linear.rows_of([np.array([0, 2 + i % 50]) if c else np.array([1, 2 + i % 50]) for i, c in enumerate(y[:500])],
                       [np.ones(2)] * 500)
    w = linear.Ftrl(52, 2, l1=8.0).learn(x, y[:500], 3).weights()
    assert (w[0, 1] > 0 > w[0, 0]) and (w[2:] == 0).all()
