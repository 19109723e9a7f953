"""Op 7: ids equal the tokenizers library, pieces cover every id once."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from subscope.llm import packing
from tests.llm.helpers import docs, words

ODD = ["", " ", "  a  b ", "a\n b\t\tc \n", "it's we'll 've 'S", "naïve ünïcödé 12 345 ٣٤ 中文 字", "a b c  d",
       "x <|endoftext|> y", "<|endoftext|>", "tab\tword  two   three\n\n\nfour", "!!! ### a&&& b%%%", "é \U0001f600 ok",
       "word " * 40, "z" * 9000, " lead", "trail "]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_tokenizers(whole):
    rng, encode = random.Random(1), packing.Encoder("byte_bpe_50k")
    parts = [" ", "  ", "\n", "\t", "a", "The", "9", "é", "'s", "!", "中", " ", "​", "\x1c", "\r\n", "ß", ",", "ab12"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def check(rows, got, whole, length):
    want = {i: whole.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    seen, used = {i: [] for i in want}, {}
    for r in got:
        ids = want[r.doc_id][r.start: r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert np.frombuffer(r.ids, "<u2").tolist() == ids
        seen[r.doc_id].append((r.start, r.length))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in want.items():
        at = 0
        for s, n in sorted(seen[i]):
            assert s == at
            at += n
        assert at == len(ids)
    total = sum(map(len, want.values()))
    assert sorted(used) == list(range(-(-total // length)))
    for s, spans in used.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == (length if s < max(used) else total - length * max(used))


@pytest.mark.parametrize("length", [16, 2048])
def test_pieces_cover_every_id_once(spark, whole, length):
    rng = random.Random(2)
    rows = list(enumerate(ODD + [None] + [words(rng, rng.randrange(0, 300)) for _ in range(60)]))
    got = packing.pack(docs(spark, rows).repartition(5), length).collect()
    check(rows, got, whole, length)


def test_empty_table_and_repeated_or_null_ids(spark):
    from pyspark.sql import functions as F

    assert packing.pack(docs(spark, [])).count() == 0
    df = docs(spark, [(1, "a b"), (1, "a b"), (None, None)]).withColumn("ids", F.lit(1)).withColumn("part", F.lit(2))
    got = packing.pack(df).collect()
    assert sorted((r.doc_id or 0, r.start, r.length) for r in got) == [(0, 0, 1), (1, 0, 3), (1, 0, 3)]
    assert sorted(r.offset for r in got)[0] == 0
