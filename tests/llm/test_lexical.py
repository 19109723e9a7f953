"""Op 13 against a score of every document for every item."""

import math
import random
import re

from pyspark.sql import functions as F

from subscope.llm import lexical
from tests.llm.helpers import docs, words

ITEMS = "item_id long, text string"


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(rows, items, top=20):
    docs_ = [(d, terms(t)) for d, t in rows]
    docs_ = [(d, w) for d, w in docs_ if w]
    n, length = len(docs_), sum(len(w) for _, w in docs_)
    df = {}
    for _, w in docs_:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, w in docs_:
            m = 100 - 25 + 25 * len(w) * n // length
            s = 0
            for x in terms(text):
                tf = w.count(x)
                if tf:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def corpus(rng, n=300):
    rows = [(i * 7 % 1009, words(rng, rng.choice([1, 3, 30, 30, 30, 200]), 300)) for i in range(n)]
    rows += [(2000 + i, rows[5][1]) for i in range(60)]  # ties beyond the top
    rows += [(5000, None), (5001, ""), (5002, "...;;"), (None, rows[5][1]), (None, words(rng, 20)), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(6000, "ÀÉ x1-W1 w1_W1 日本 K \x00w2\x7fw3"), (6001, "w1 " * 5000), (6002, "q" * 60_000)]
    items = [(i, words(rng, rng.choice([1, 4, 20, 40]), 320)) for i in range(25)]
    return rows, items + [(30, None), (31, ""), (32, "w1 w1 W1 w2"), (32, "w1 w1 W1 w2"), (33, rows[5][1]), (34, "nowhere"), (35, "àé ÀÉ 日本")]


def test_equals_plain(spark, monkeypatch):
    rows, items = corpus(random.Random(13))
    d = docs(spark, rows).repartition(4).withColumns({c: F.lit(1) for c in ("doc", "n", "terms", "row", "m", "score", "rank", "item")})
    b = spark.createDataFrame(items, ITEMS).withColumn("item", F.lit("x"))
    want = plain(rows, items)
    assert got(lexical.ranked(d, b)) == want and len(want) > 400
    # small blocks of documents, items, postings and visits
    for name, value in (("BLOCK_DOCS", 7), ("ITEM_BYTES", 900), ("PAIRS", 50), ("WINDOW_BYTES", 2000), ("PART_POSTINGS", 500)):
        monkeypatch.setattr(lexical, name, value)
    assert got(lexical.ranked(d, b)) == want
    assert got(lexical.ranked(d, b, top=3)) == plain(rows, items, 3)


def test_one_stratum_is_dealt_over_tasks(spark, monkeypatch):
    """Rows of one normaliser, without ids to tell them apart."""
    monkeypatch.setattr(lexical, "PART_POSTINGS", 1000)
    d = docs(spark, [(None, f"a{i % 50} b{i % 7} c") for i in range(4000)])
    items = next(lexical.item_blocks(spark.createDataFrame([(1, "a1 b1 c")], ITEMS), "item_id", "text"))
    counted = lexical.term_counts(d, items.vocabulary, "doc_id", "text")
    index = lexical.build_index(counted, lexical.collection(counted, len(items.vocabulary)))
    sizes = [r[1] for r in index.groupBy(F.input_file_name()).agg(F.sum(F.size("docs"))).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500


def test_blocks_out_of_reach_are_skipped():
    import numpy as np
    import pyarrow as pa
    items = lexical.Items([1], ["a"])
    search = lexical.Search(items, np.array([1000]), 2)

    def block(ids, tf, m):
        one = lambda x: np.array(x, "<u4").tobytes()
        return lexical.Block(m, pa.array(ids), one([0]), one([tf]), one([len(ids)]), one(range(len(ids))))

    for b in (block([5, 6], 3, 100), block([1, 2], 1, 100), block([3], 3, 100)):
        search.visit(b, search.bounds(b))
    assert (search.visited, search.skipped) == (2, 1) and search.found[1].tolist() == [3, 5]


def test_empty_tables(spark):
    d, b = docs(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], ITEMS)
    assert got(lexical.ranked(d, b)) == got(lexical.ranked(d, b, top=1)) != []
    assert lexical.ranked(d.limit(0), b).count() == 0 and lexical.ranked(d, b.limit(0)).count() == 0


def test_large_sums_are_exact():
    import numpy as np
    v = np.array([(1 << 54) + 1, 3, (1 << 55) + 7])
    assert lexical._sums(np.array([0, 1, 0]), v, 2).tolist() == [(1 << 54) + (1 << 55) + 8, 3]
