"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with elastic-net
penalties, then temperature calibration.

Features are hashed n-grams of one to three code points of the lower-cased
text, in which everything but letters counts as one blank: logarithmic
counts, times the inverse document frequency over all learnable documents,
scaled to length one. The weights are learnt from at most
``PER_LANGUAGE`` documents of each language, chosen by a hash of the id; four
fifths of them train and one fifth sets the temperature. Everything else
(document frequencies, language counts, predictions) covers all documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope.llm import linear
from subscope.llm.common import lowered, text_slices

BITS = 14
FEATURES = 1 << BITS
PER_LANGUAGE = 1500
EPOCHS = 4
_MUL = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a lower-cased text; null without a
    letter."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    codes = np.concatenate(([32], codes[(codes != 32) | np.r_[True, codes[:-1] != 32]], [32])).astype(np.uint64)
    two = codes[1:] | (codes[:-1] << np.uint64(21))
    three = codes[2:] | (two[:-1] << np.uint64(21))
    shift = np.uint64(64 - BITS)
    out = np.zeros(FEATURES, np.int64)
    for n, grams in ((1, codes), (2, two), (3, three)):
        x = (grams + np.uint64(n << 59)) * _MUL
        x = (x ^ (x >> np.uint64(29))) * _MUL
        out += np.bincount((x >> shift).astype(np.int64), minlength=FEATURES)
    return out


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx = np.flatnonzero(counts)
    v = np.log1p(counts[idx]) * idf[idx]
    return idx, v / max(np.sqrt(v @ v), 1e-12)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text modulo 4 is 2 (a null id counts as the empty
    text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _document_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """How many documents hold each feature, and how many there are (last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for part in text_slices(batch, text_col):
                for text in lowered(part.column(0)).to_pylist():
                    counts = ngram_counts(text)
                    if counts is not None:
                        df[:-1] += counts > 0
                        df[-1] += 1
        idx = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(df[idx])], names=["feature", "n"])

    rows = docs.select(text_col).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(FEATURES + 1)
    for r in rows.collect():  # at most FEATURES + 1 rows
        out[r.feature] = r.n
    return out


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, scale: float):
        self.languages, self.idf, self.weights, self.scale = languages, idf, weights, scale

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        idx, val = _vector(counts, self.idf)
        p = linear.softmax(val @ self.weights[idx] / self.scale)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(learnable: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Model:
    """``learnable``: documents with a text and a language. Without any, the
    model knows no language."""
    counts = {r[0]: r[1] for r in learnable.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    df = _document_frequencies(learnable, text_col)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1.0
    pick = F.lit(False)
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    for lang, n in counts.items():
        pick = F.when(F.col(lang_col) == lang, part < min(1.0, per_language / n)).otherwise(pick)
    schema = f"order long, lang {learnable.schema[lang_col].dataType.simpleString()}, idx binary, val binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch, text_col):
                keep, idx, val = [], [], []
                for i, text in enumerate(lowered(s.column(2)).to_pylist()):
                    c = ngram_counts(text)
                    if c is not None:
                        x, v = _vector(c, idf)
                        keep.append(i)
                        idx.append(x.astype("<u2").tobytes())
                        val.append(v.astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(pa.array(keep, pa.int64())), s.column(1).take(pa.array(keep, pa.int64())),
                     pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["order", "lang", "idx", "val"])

    sample = learnable.where(pick).select(F.xxhash64(F.col(id_col).cast("string")).alias("order"),
                                          F.col(lang_col).alias("lang"), text_col)
    got = sample.mapInArrow(run, schema).toArrow()  # at most about PER_LANGUAGE rows a language
    rows = sorted(zip(got["order"].to_pylist(), got["lang"].to_pylist(), got["idx"].to_pylist(), got["val"].to_pylist()))
    if not rows:
        return Model([], idf, np.zeros((FEATURES, 0)), 1.0)
    data = linear.rows_of([np.frombuffer(r[2], "<u2").astype(np.int64) for r in rows],
                          [np.frombuffer(r[3], "<f4").astype(np.float64) for r in rows])
    y = np.array([languages.index(r[1]) for r in rows])
    tune = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~tune)
    model = linear.Ftrl(FEATURES, len(languages), alpha=1.0, l1=0.05, l2=0.05).learn(data.take(fit), y[fit], epochs)
    weights = model.weights()
    scale = linear.temperature(linear.scores(data.take(np.flatnonzero(tune)), weights), y[tune])
    return Model(languages, idf, weights, scale)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, lang_pred, score). A text that is null or has no
    letter is ``und`` with score 0; a language column is not read."""
    kept = [id_col, *(keep or [])]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch, text_col):
                found = [sent.value.predict(t) for t in lowered(s.column(len(kept))).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*s.columns[: len(kept)], pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())], names=schema.fieldNames())

    return docs.select(*kept, text_col).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every document, learning only from
    labelled documents that are not held out. Ids may repeat or be null (null
    ids are not learnt from)."""
    out = held_out(id_col)
    learnable = docs.where(~out & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    model = train(learnable.select(id_col, text_col, lang_col), id_col, text_col, lang_col)
    return predict(docs.select(id_col, text_col, out.alias("held_out")), model, id_col, text_col, ["held_out"])
