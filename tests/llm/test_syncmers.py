"""Op 1 against a plain Python version."""

import hashlib
import random

import xxhash

from subscope.llm import syncmers
from tests.llm.helpers import docs, words


def spark_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little"), seed=h).intdigest()
    return h - 2**64 if h >= 2**63 else h


def plain_sketch(text, k=5, s=2, size=128):
    h = [spark_hash(w) for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not h:
        return []
    out = []
    for i in range(len(h) - k + 1):
        g = [spark_hash(*h[i + j: i + j + s]) for j in range(k - s + 1)]
        if min(g) in (g[0], g[-1]):
            out.append(spark_hash(*h[i: i + k]))
    return sorted({x >> 32 for x in out or [spark_hash(*h)]})[:size]


def plain_likeness(a, b, size=128):
    u = sorted({*a, *b})[:size]
    return len({*u} & {*a} & {*b}) / len(u) if u else 1.0


def text_of(sk):
    return "".join(f"{x & 0xFFFFFFFF:08x}" for x in sk)


def check(rows, got):
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(after)
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (text_of(a), text_of(b))
        assert abs(r.near_edited - plain_likeness(a, b)) < 1e-12 and abs(r.near_next - plain_likeness(a, c)) < 1e-12


def test_matches_plain_version(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.choice([0, 1, 3, 4, 5, 6, 30, 400, 3000])) for _ in range(80)]
    texts += [None, "", " \n\t ", "same same same same same same same", "é中 \U0001f600 x y z ü w", "q" * 20_000]
    ids = rng.sample(range(-5, 10_000), len(texts))
    rows = list(zip(ids, texts))
    got = syncmers.edited_fingerprints(docs(spark, rows).repartition(4)).collect()
    check(rows, {r.doc_id: r for r in got})
    same = [r for r in got if rows[ids.index(r.doc_id)][1] in (None, "", " \n\t ")]
    assert len({r.fingerprint for r in same}) == 1


def test_single_empty_repeated_and_null_ids(spark):
    from pyspark.sql import functions as F

    assert syncmers.edited_fingerprints(docs(spark, [])).count() == 0
    one = syncmers.edited_fingerprints(docs(spark, [(3, "a b c d e f")])).first()
    assert one.near_next == 1.0
    many = docs(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "x"), (None, "n"), (None, None)])
    got = syncmers.edited_fingerprints(many.withColumn("sk", F.lit(1)).withColumn("next_text", F.lit("z"))).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 2
    assert syncmers.edited_fingerprints(docs(spark, [(None, "a b"), (None, "c")])).count() == 2


def test_anchors_are_context_free(spark):
    rng = random.Random(5)
    passage = words(rng, 60, 10_000)
    df = docs(spark, [(1, words(rng, 37, 10_000) + " " + passage), (2, passage + " " + words(rng, 11, 10_000))])
    a, b = ({x.hash: x.position for x in r.a} for r in
            df.select("doc_id", syncmers.anchors(df["text"]).alias("a")).orderBy("doc_id").collect())
    common = {a[h] - b[h] for h in a.keys() & b.keys()}
    assert common == {37} and len(a.keys() & b.keys()) > 10
