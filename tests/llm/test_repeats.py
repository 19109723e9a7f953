"""Op 9 against brute force over all 50-byte strings."""

import pytest
import random

from pyspark.sql import functions as F

from subscope.llm import repeats
from tests.llm.helpers import docs, words


def plain(rows, length=50):
    first = {}
    raw = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for s in range(len(b) - length + 1):
            w = b[s: s + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s: s + length]] < i:
                gone[s: s + length] = b"\1" * length
        out.append((i, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])),
                    bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def result(df):
    return sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans),
                   len(r.spans), bytes(r.kept)) for r in df.collect())


def corpus(rng, n=150):
    passages = [words(rng, rng.randrange(8, 60), 3000) for _ in range(12)] + ["ab" * 100, "é" * 60, "x" * 200]
    rows = []
    for i in rng.sample(range(-100, 10_000), n):
        parts = [words(rng, rng.randrange(0, 60), 3000)]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            lo = rng.randrange(0, max(1, len(p) - 55)) if rng.random() < 0.5 else 0
            parts += [p[lo: lo + rng.choice([49, 50, 51, 80, 400])], words(rng, rng.randrange(0, 9), 3000)]
        rows.append((i, rng.choice(["", " "]).join(parts)))
    copies = [t for _, t in rng.sample(rows, 20)]
    return rows + [(20_000 + i, t) for i, t in enumerate(copies)] + [
        (30_000, None), (30_001, ""), (30_002, "q" * 9000), (30_003, "q" * 49), (30_004, "q" * 50)]


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(11))
    got = result(repeats.repeated_passages(docs(spark, rows).repartition(5)))
    assert got == plain(rows) and sum(r[2] > 0 for r in got) > 60


def test_segments_and_blocks_do_not_change_the_result(monkeypatch):
    import numpy as np
    import zstandard

    rng = random.Random(5)
    data = (words(rng, 900, 50) + "ab" * 300).encode()
    args = (np.array([1, 2], "<i8").tobytes(), np.array([700, len(data) - 700], "<i8").tobytes(),
            zstandard.ZstdCompressor().compress(data), 50)
    whole = repeats.Block(*args)
    monkeypatch.setattr(repeats, "SEGMENT", 97)
    cut = repeats.Block(*args)

    def by_window(b):
        return {int(s) + j: (int(t), int(p) - j) for s, n, t, p in zip(b.start, b.windows, b.trigger, b.place)
                for j in range(n)}

    assert by_window(whole) == by_window(cut)
    assert sorted(by_window(whole)) == [*range(651), *range(700, len(data) - 49)]


def test_edges(spark):
    p = "a passage that is certainly longer than fifty bytes, is it not"
    rows = [(1, p), (1, p), (None, p), (None, p + "!"), (5, p), (5, p + p)]
    d = docs(spark, rows).withColumn("block", F.lit(1)).withColumn("id", F.lit("x")).withColumn("kept", F.lit(0))
    assert result(repeats.repeated_passages(d)) == plain(rows)
    assert repeats.repeated_passages(docs(spark, [])).count() == 0
    assert result(repeats.repeated_passages(docs(spark, [(1, None), (2, "short")]))) == [(1, 0, 0, 0, b""), (2, 5, 0, 0, b"short")]


@pytest.mark.parametrize("length", [64, 86])
def test_other_lengths(spark, length):
    rng = random.Random(length)
    passages = ["".join(rng.choice("ab c") for _ in range(rng.randrange(length - 4, 300))) for _ in range(12)]
    rows = [(d, "".join(rng.choice(passages) if rng.random() < 0.6 else "".join(
        rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 200))) for _ in range(5))) for d in range(60)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in repeats.repeated_passages(docs(spark, rows), length).collect()}
    want = {}
    seen: set = set()
    for d, t in rows:
        b = t.encode()
        covered = set()
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                covered.update(range(i, i + length))
        want[d] = covered
        seen |= {b[i:i + length] for i in range(len(b) - length + 1)}
    assert {d: {x for a, e in s for x in range(a, e)} for d, s in got.items()} == want and any(want.values())


@pytest.mark.parametrize("length", [23, 87, 150])
def test_lengths_out_of_reach_are_refused(spark, length):
    with pytest.raises(ValueError, match="length"):
        repeats.repeated_passages(docs(spark, [(1, "a")]), length)
