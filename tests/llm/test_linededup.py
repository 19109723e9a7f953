"""Op 4 against brute force over all pairs of lines."""

import random

import pytest
from pyspark.sql import functions as F

from subscope.llm import linededup
from tests.llm.helpers import docs, words


def plain(rows, percent=80):
    """{(doc, line)} removed."""
    lines = [(d, i, frozenset(x.split())) for d, t in rows for i, x in enumerate((t or "").split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    out = set()
    for k, (d, i, s) in enumerate(lines):
        if any(100 * len(s & r) >= percent * len(s | r) for _, _, r in lines[:k]):
            out.add((d, i))
    return out


def corpus(rng, n=120):
    base = [words(rng, rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 45]), 120) for _ in range(60)]
    rows = []
    for d in rng.sample(range(-50, 10_000), n):
        lines = []
        for _ in range(rng.randrange(0, 7)):
            toks = rng.choice(base).split() if rng.random() < 0.7 else words(rng, rng.randrange(1, 30), 120).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                j = rng.randrange(len(toks))
                toks[j:j + 1] = rng.choice([[], [f"n{rng.randrange(60)}"], [toks[j], f"n{rng.randrange(60)}"]])
                toks = toks or ["x"]
            rng.shuffle(toks)
            lines.append("  ".join(toks))
        lines += rng.choice([[], [""], ["\t ", ""], ["same line here"]])
        rows.append((d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed, listed, block", [(1, 16, 10_000), (2, 2, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, listed, block):
    monkeypatch.setattr(linededup, "BLOCK", block)
    rows = corpus(random.Random(seed))
    got = {(r.doc, r.line) for r in linededup.removed_lines(docs(spark, rows).repartition(4), listed=listed).collect()}
    assert got == plain(rows)


def test_blocks_of_a_common_word_find_the_same(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    sets = [sorted({0, *rng.sample(range(1, 10), rng.randrange(4, 9))}) for _ in range(120)]
    e = np.zeros(len(sets), linededup.ENTRY)
    e["doc"], e["n"], e["tok"] = np.arange(len(sets)), [len(s) for s in sets], 7
    e["bits"] = [sum(1 << x for x in s) for s in sets]
    table = pa.table({"entries": [linededup._pack(e)], "gone": pa.nulls(1, pa.binary())})

    def pairs(t):
        return {(a, b) for a, b, x in zip(t["doc"].to_pylist(), t["cdoc"].to_pylist(), t["block"].to_pylist()) if x is None}

    whole = linededup._meeting(80, 10_000)(table)
    cut = linededup._meeting(80, 10_000, block=9)(table)
    assert not pairs(cut)
    blocks = spark.createDataFrame(cut.select(["word", "number", "low", "high", "block"]).drop_null())
    met = linededup._compare_blocks(linededup._block_pairs(blocks, 80), 80, 10_000).collect()
    run = [(r.doc, r.cdoc) for r in met]
    assert set(run) == pairs(whole) and len(set(run)) == len(run) > 50
    best = linededup._meeting(80, 1)(table)
    found = {x for x, _ in pairs(whole)}
    assert {x for x, _ in pairs(best)} == found and pairs(best) <= pairs(whole)


def test_a_common_word_leaves_its_task_once(spark):
    """200,000 lines of one prefix word: the task that meets them emits each
    entry once, and a pair of blocks holds two blocks."""
    import numpy as np
    import pyarrow as pa

    n, block = 200_000, 2_000
    e = np.zeros(n, linededup.ENTRY)
    e["doc"], e["n"], e["tok"] = np.arange(n), 5 + np.arange(n) % 40, 7
    e["bits"] = np.random.default_rng(1).integers(0, 1 << 63, n)
    out = linededup._meeting(80, 1, block=block)(pa.table({"entries": [linededup._pack(e)], "gone": pa.nulls(1, pa.binary())}))
    packed = out["block"].drop_null().to_pylist()
    assert len(packed) == n // block == out.num_rows
    assert sum(map(len, packed)) == n * linededup.ENTRY.itemsize + 8 * len(packed)
    blocks = spark.createDataFrame(out.select(["word", "number", "low", "high", "block"]).drop_null())
    pairs = linededup._block_pairs(blocks, 80).selectExpr("greatest(length(x), length(y)) AS size").collect()
    assert n // block < len(pairs) < (n // block) ** 2 / 3  # those of similar sizes only
    assert max(r["size"] for r in pairs) == block * linededup.ENTRY.itemsize + 8


def test_packing_round_trip():
    import numpy as np

    e = np.zeros(7, linededup.ENTRY)
    for i, f in enumerate(e.dtype.names):
        e[f] = np.arange(7) * 1_000_003 ** (1 + i % 2) + i
    assert (linededup._unpack(linededup._pack(e)) == e).all()


def test_text_and_edges(spark):
    rows = [(3, "a b c d e\nkeep me\n\na b c d e"), (1, "A\na b c d e f"), (2, None), (4, ""), (5, "\n\n"), (6, "x " * 9000),
            (7, "x"), (None, "A\nnew"), (None, "A\nnew"), (8, "one\ntwo"), (8, "one\ntwo"), (8, "three\ntwo")]
    d = docs(spark, rows).withColumn("gone", F.lit(1)).withColumn("bits", F.lit("b")).withColumn("line", F.lit(0))
    got = linededup.dedup_lines(d)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "bits", "line", "n_lines", "lines_removed"]
    out = sorted([(r.doc_id or 99, r.text, r.n_lines, r.lines_removed) for r in got.collect()], key=str)
    assert out == sorted([
        (1, "A\na b c d e f", 2, []), (2, None, 0, []), (3, "keep me\n", 4, [0, 3]), (4, "", 1, []), (5, "\n\n", 3, []),
        (6, "x " * 9000, 1, []), (7, "", 1, [0]), (8, "one\ntwo", 2, []), (8, "one\ntwo", 2, []),
        (8, "three\ntwo", 2, []), (99, "new", 2, [0]), (99, "new", 2, [0])], key=str)
    assert linededup.dedup_lines(docs(spark, [])).count() == 0
    assert linededup.dedup_lines(docs(spark, [(1, None), (2, " ")])).count() == 2


def test_a_text_of_over_a_million_lines(spark):
    n = (1 << 20) + 5
    lines = [f"w{i}" for i in range(n - 2)] + ["a b c d e", "w0"]
    d = docs(spark, [(1, "\n".join(lines)), (2, "e d c b a f\nlast")])
    got = {r.doc_id: r for r in linededup.dedup_lines(d).collect()}
    assert got[1].n_lines == n and got[1].lines_removed == [n - 1] and got[1].text == "\n".join(lines[:-1])
    assert got[2].lines_removed == [0] and got[2].text == "last"
