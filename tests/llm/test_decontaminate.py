"""Op 5 against exact containment of every item in every document."""

import random

from subscope.llm import decontaminate
from tests.llm.helpers import docs, words


def shingles(text, k):
    t = (text or "").lower().split()
    return {tuple(t[i:i + k]) for i in range(len(t) - k + 1)}


def plain(rows, items, k=5, least=0.8):
    out = set()
    for i, text in items:
        n = len((text or "").split())
        if n:
            own = shingles(text, min(k, n))
            for d, t in rows:
                shared = len(own & shingles(t, min(k, n)))
                if shared >= least * len(own):
                    out.add((d, i, shared, len(own)))
    return out


def corpus(rng):
    items = [(i, words(rng, rng.choice([2, 4, 5, 6, 9, 12, 30, 60]))) for i in range(40)]
    items += [(40, None), (41, "  "), (42, items[0][1]), (43, "Ünï Côdé É ß x y z")]
    rows = [(d, words(rng, rng.choice([0, 3, 50, 800, 5000]))) for d in range(50)]
    for d in range(50, 110):
        t = rng.choice(items)[1] or ""
        toks = t.split()
        if len(toks) > 6 and rng.random() < 0.5:
            toks[rng.randrange(len(toks))] = "changed"
        text = f"{words(rng, rng.randrange(0, 2000))}\n{' '.join(toks).upper()}\t{words(rng, rng.randrange(0, 50))}"
        rows.append((d, text))
    return rows + [(200, None), (201, ""), (202, "q" * 30_000)], items


def test_matches_exact_containment(spark, monkeypatch):
    rows, items = corpus(random.Random(8))
    d, b = docs(spark, rows).repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = plain(rows, items)
    got = {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontaminate.contained_items(d, b).collect()}
    assert got == want and len(want) > 40
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    got = {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontaminate.contained_items(d, b).collect()}
    assert got == want


def test_empty_tables_and_repeats(spark):
    b = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "item_id long, text string")
    d = docs(spark, [(1, "x a b c d e f y"), (1, "x a b c d e f y"), (None, "a b c d e f")])
    assert decontaminate.contained_items(d, b).count() == 6
    assert decontaminate.contained_items(d, b.limit(0)).count() == 0
    assert decontaminate.contained_items(d.limit(0), b).count() == 0
