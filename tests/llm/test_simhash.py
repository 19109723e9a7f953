"""Op 2 against brute force over all pairs."""

import random
import re

import xxhash

from subscope.llm import simhash
from tests.llm.helpers import docs, words


def plain_fingerprint(text, k=4):
    toks = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not toks:
        return 0
    shingles = [" ".join(toks[i:i + k]) for i in range(max(1, len(toks) - k + 1))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps: dict, distance: int) -> dict:
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def corpus(rng):
    rows, base = [], [words(rng, rng.randrange(30, 200)) for _ in range(25)]
    for b in base:
        for _ in range(rng.randrange(1, 6)):
            toks = b.split()
            for _ in range(rng.randrange(0, 3)):
                toks[rng.randrange(len(toks))] = f"x{rng.randrange(999)}"
            rows.append(" ".join(toks))
    rows += [None, "", "  \t\n", "One", "one", "ONE two", "É É é", "a b c d e f", "z" * 50_000]
    rng.shuffle(rows)
    return list(enumerate(rows, start=3))


def test_matches_brute_force(spark):
    rows = corpus(random.Random(4))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == plain_components(fps, 4)


def test_links_of_random_and_dense_fingerprints_on_every_path(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    near = {centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(7))}) for _ in range(150)}
    values = sorted(near | {rng.getrandbits(64) for _ in range(50)} | {0, 2**64 - 1})
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    want = plain_components(dict(enumerate(values)), 4)
    for hot, group in ((1 << 16, 1 << 21), (5, 1 << 12), (0, 1)):  # cold; some hot; all hot down to whole variants
        edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(df, len(values), 4, hot, group).collect()]
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
        assert [find(v) for v in values] == [values[want[i]] for i in range(len(values))]


def test_empty_table_nulls_repeats_and_extra_columns(spark):
    from pyspark.sql import functions as F

    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    df = docs(spark, [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "q r s t u v"), (7, None), (6, "")])
    df = df.withColumn("fp", F.lit(1)).withColumn("least", F.lit(2)).withColumn("component_id", F.lit("x"))
    got = sorted(((r.doc_id or -1), r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5), (6, 6), (7, 6)]
