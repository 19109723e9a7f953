"""The pipeline's stages against brute force, each on its own input."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.helpers import DOCS, words
from tests.llm.test_decontaminate import plain as contained
from tests.llm.test_linededup import plain as lines_removed
from tests.llm.test_packing import check as check_pieces
from tests.llm.test_simhash import plain_components, plain_fingerprint


def corpus(rng):
    items = [(i, words(rng, rng.randrange(8, 30), 5000)) for i in range(8)]
    shared = [words(rng, rng.randrange(6, 20), 5000) for _ in range(6)]
    rows, labels = [], []
    for i in range(260):
        lines = [words(rng, rng.randrange(5, 40), 5000) for _ in range(rng.randrange(1, 5))]
        lines += rng.sample(shared, rng.randrange(0, 2))
        if rng.random() < 0.15:
            lines.insert(0, words(rng, 20, 5000) + " " + rng.choice(items)[1])
        good = rng.random() < 0.8
        text = "\n".join(lines)
        if not good:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    for i in range(260, 300):
        toks = rows[rng.randrange(200)][1].split(" ")
        toks[rng.randrange(len(toks))] = "changed"
        text = " ".join(toks)
        rows.append((i, text, "en", "src9", len(text)))
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (301, "", "en", "s", 0), (None, "null id", "en", "s", 7),
             (None, "other", "en", "s", 5), (302, "long " * 20_000, "en", "s", 100_000)]
    return rows, labels, items


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, labels, items = corpus(random.Random(12))
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_every_stage_on_its_own_input(spark, sf_dir, tmp_path):
    stage = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def step(name, df):
        stage[name](spark, df, sf_dir).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        return out, [tuple(r) for r in out.collect()]

    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    before = sorted(map(tuple, docs.collect()), key=key)
    df, rows = step("quality", docs)
    rows.sort(key=key)
    assert df.columns == docs.columns
    junk = {r[0] for r in before if "###" in (r[1] or "")}
    gone = {r[0] for r in before} - {r[0] for r in rows}
    assert len(gone & junk) > 0.9 * len(junk) and len(gone - junk) < 8 and all(r in before for r in rows)

    ids = [(r[0] if r[0] is not None else (1 << 63) - 1, r[1]) for r in rows]
    cut = lines_removed(ids)
    want = []
    for (i, text), r in zip(ids, rows):
        lines = None if text is None else [x for k, x in enumerate(text.split("\n")) if (i, k) not in cut]
        new = None if lines is None else "\n".join(lines)
        want.append((r[0], new, r[2], r[3], r[4] if new == text else len(new)))
    df, rows = step("line_dedup", df)
    assert sorted(rows, key=key) == sorted(want, key=key) and len(cut) > 40

    fps = {n: plain_fingerprint(r[1]) for n, r in enumerate(rows)}
    group = plain_components(fps, 4)
    least = {}
    for n, r in enumerate(rows):
        k = (r[0] is None, r[0] or 0, fps[n] - (2**64 if fps[n] >= 2**63 else 0))
        least[group[n]] = min(least.get(group[n], (k, r)), (k, r), key=lambda x: x[0])
    df, rows = step("near_dedup", df)
    assert sorted(rows, key=key) == sorted((r for _, r in least.values()), key=key)

    leaks = {d for d, *_ in contained([(n, r[1]) for n, r in enumerate(rows)], items)}
    want = [r for n, r in enumerate(rows) if n not in leaks]
    df, rows = step("decontamination", df)
    assert sorted(rows, key=key) == sorted(want, key=key) and len(leaks) > 10

    out, _ = step("packing", df)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = out.where(F.col("doc_id").isNotNull()).collect()
    known = [(r[0], r[1]) for r in rows if r[0] is not None]
    if len(known) == len(rows):
        check_pieces(known, got, whole, 2048)
    assert {r.doc_id for r in got} == {i for i, _ in known}


def test_run_equals_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in P.STAGES[:-1]:
        docs = f(spark, docs, sf_dir)
    got = P.run(spark, sf_dir)
    kept = {(r.doc_id, r.doc_tokens) for r in got.select("doc_id", "doc_tokens").collect()}
    assert {i for i, _ in kept} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, f in P.STAGES:
        f(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() == 0
