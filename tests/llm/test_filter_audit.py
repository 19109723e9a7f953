"""Op 11 against plain Python on tables with copies, ties and nulls."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from subscope.llm import filter_audit
from tests.llm.helpers import docs

LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    texts = [(d, t or "", g or "") for d, t, g, *_ in rows]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    fails = []
    for d, t, _ in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        bad = {"A"} if len(w) < 100 else set()
        if 100 * len(set(w)) < 80 * len(w):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            bad.add("C")
        if re.search(r"[#$%&*|]", t):
            bad.add("D")
        if d is not None and any(e is not None and e < d and u == t for e, u, _ in texts):
            bad.add("E")
        fails.append(bad)
    out = []
    for part in {g for _, _, g in texts}:
        own = [(f, d) for f, (d, _, g) in zip(fails, texts) if g == part]
        total = {}
        some = []
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [(f, d) for f, d in own if letter in f and not f & before]
                total[letter] = total.get(letter, 0) + len(gone)
                some.append((part, "".join(order), step, letter, sum(not f & {*before, letter} for f, _ in own), len(gone),
                             sum(letter in f and bool(f & before) for f, _ in own), sum(f == {letter} for f, _ in own),
                             sum(d in good for _, d in gone), sum(d in toxic for _, d in gone)))
        out += [(*r[:3], *r[4:], total[r[3]]) for r in some]
    return sorted(out)


def corpus(rng):
    pool = [" ".join(rng.choice(["a", "bb", "Ccc", "dd%", "EEE"]) + str(rng.randrange(k)) for _ in range(n))
            for n, k in [(0, 1), (5, 9), (99, 400), (100, 400), (100, 10), (300, 4000), (300, 90), (2000, 9000)]]
    pool += [None, "", "  \t\n\x0b", "É" * 300, "ABC " * 200, "x" * 50_000, "one\x85two\xa0" * 60]
    rows = []
    for i in range(160):
        text = rng.choice(pool)
        rows.append((rng.choice([i, i, i, rng.randrange(40), None]), text, rng.choice(["en", "de", "", None]), "s", 1))
    rows += [rows[3], rows[3], (-5, pool[5], "en", "s", 1), (10**12, pool[5], "xx", "s", 1)]
    labels = [(rng.choice([rng.randrange(160), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    return rows, labels


def test_equals_plain(spark):
    rows, labels = corpus(random.Random(4))
    d = docs(spark, rows).repartition(5).withColumns({
        c: F.lit(1) for c in ("part", "bits", "n", "hash", "id", "good", "_text", "_hash", "_part", "own", "step")})
    got = filter_audit.audit(d, spark.createDataFrame(labels, LABELS)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == plain(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs(spark, []), none).count() == 0
    got = filter_audit.audit(docs(spark, [(1, None), (2, "")]), none).where("filter_order = 'EABCD' AND step = 1").first()
    assert (got.kept, got.removed, got.redundant, got.unique_fails) == (1, 1, 0, 0)


def test_a_third_of_the_rows_are_copies(spark):
    rows = [(i, "same text") for i in range(3000)] + [(10_000 + i, f"text {i % 4000}") for i in range(6000)]
    got = filter_audit.repeated_texts(docs(spark, rows).repartition(8))
    assert got.count() == 2999 + 2000 and got.agg(F.min("doc_id")).first()[0] == 1
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
