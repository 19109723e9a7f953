"""Quality classifier by co-training.

Two logistic classifiers see each document from different sides: the content
view reads its words (hashed, present or not) and the make-up of its
characters; the metadata view reads source, language and the shape of the
page (length, lines). Both start from the labelled documents. In each round
either view labels the unlabelled documents it is surest of, and the *other*
view learns from them. The labelled documents are dealt into ``FOLDS`` and
each is scored by views that did not learn its fold; on these scores either
view is calibrated, and a logistic regression over the two calibrated scores
gives the quality of every document.

A document is rejected if its quality is under the threshold: the probability
at which the expected share of good documents lost, ``CLEAN_WEIGHT`` times,
balances the expected share of bad ones kept. Calibration and threshold rest
on all labelled documents, so a few odd or wrong labels hardly move them.

Fitted on at most about ``LABELLED`` labelled and ``POOL`` further documents
chosen by a hash of the id; every document is scored, on its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope.llm import linear
from subscope.llm.common import ALNUM, byte_arrays, lowered, text_slices, word_hashes, word_spans

LABELLED, POOL = 8000, 8000
ROUNDS, SURE, PER_ROUND = 3, 0.97, 400
FOLDS = 3
CLEAN_WEIGHT = 4
WORD_BITS = 20
WORDS = 1 << WORD_BITS
_PUNCT = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
DENSE = len(_PUNCT) + 7  # punctuation, upper, digits, white space, line ends, distinct words, word length, one
CONTENT = WORDS + DENSE
META_BITS = 10
META = 1 << META_BITS


def content_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, word feature) pairs without repeats, and the dense
    features of every text."""
    n = len(col)
    data, offsets = byte_arrays(col)
    size = np.maximum(np.diff(offsets), 1)
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    bytes_of = np.bincount(text_of * 256 + data, minlength=n * 256).reshape(n, 256)
    low, low_offsets = byte_arrays(lowered(col))
    starts, ends, text = word_spans(low, low_offsets, ALNUM)
    key = (text << WORD_BITS) | (word_hashes(low, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key = np.unique(key)
    words = np.maximum(np.bincount(text, minlength=n), 1)
    distinct = np.bincount(key >> WORD_BITS, minlength=n)
    length = np.bincount(text, weights=ends - starts, minlength=n) / words
    shares = np.column_stack([
        bytes_of[:, _PUNCT], bytes_of[:, 65:91].sum(1), bytes_of[:, 48:58].sum(1),
        bytes_of[:, [9, 11, 12, 13, 32]].sum(1), bytes_of[:, 10]])
    dense = np.column_stack([
        4 * np.sqrt(shares / size[:, None]), 4 * distinct / words, np.minimum(length, 40) / 5, np.ones(n)])
    return key >> WORD_BITS, key & (WORDS - 1), dense


def metadata_features(text: pa.Array, fields: list[pa.Array]) -> np.ndarray:
    """One active feature per field and per shape bucket of every document."""
    data, offsets = byte_arrays(text)
    size = np.diff(offsets)
    lines = np.add.reduceat(np.r_[data == 10, False], offsets[:-1]) if len(size) else size
    lines = np.where(size > 0, lines, 0) + 1
    columns = [[zlib.crc32(f"{i}:{v!r}".encode()) for v in f.to_pylist()] for i, f in enumerate(fields)]
    for name, x in (("length", np.log2(size + 1)), ("lines", 2 * np.log2(lines)), ("line", np.log2(size / lines + 1))):
        columns.append([zlib.crc32(f"{name}:{int(v)}".encode()) for v in x])
    columns.append([0] * len(size))
    return np.array(columns, np.int64).reshape(len(columns), len(size)).T & (META - 1)


@dataclass
class Model:
    words: np.ndarray  # per hashed word, good minus bad
    dense: np.ndarray
    meta: np.ndarray
    platt: np.ndarray  # slope and intercept of either view
    stack: np.ndarray
    threshold: float

    def views(self, text: pa.Array, fields: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        doc, word, dense = content_features(text)
        content = dense @ self.dense + np.bincount(doc, weights=self.words[word], minlength=len(text))
        return content, self.meta[metadata_features(text, fields)].sum(axis=1)

    def combine(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of either view and of both."""
        c = self.platt[0, 0] * content + self.platt[0, 1]
        m = self.platt[1, 0] * meta + self.platt[1, 1]
        return _p(c), _p(m), _p(self.stack[0] * c + self.stack[1] * m + self.stack[2])


def _p(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


ACCEPT_ALL = Model(np.zeros(WORDS, np.float32), np.zeros(DENSE), np.zeros(META), np.zeros((2, 2)),
                   np.array([0.0, 0.0, 40.0]), 0.0)


def _share(id_col: str, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fields: list[str], labelled: int,
           pool: int) -> pa.Table:
    """Features of the documents to learn from. ``labels`` (id, good): a
    document with several labels is good if all say so."""
    one = labels.where(F.col("good").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min(F.col("good").cast("int")).alias("good"))
    n_labels, n_docs = one.count(), docs.count()
    # at most about `labelled` rows, whatever the table: the bound of the broadcast
    some = one.where(_share(id_col, "labels") < labelled / max(n_labels, 1)).select(
        F.col(id_col).alias("_id"), F.col("good").alias("_good"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[
        F.col(f).alias(f"_{i}") for i, f in enumerate(fields)]).join(F.broadcast(some), "_id", "left")
    rows = rows.where(F.col("_good").isNotNull() | (_share("_id", "pool") < pool / max(n_docs, 1)))
    rows = rows.select(F.xxhash64(F.col("_id").cast("string")).alias("order"), "_good", "_text",
                       *[f"_{i}" for i in range(len(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch, "_text"):
                doc, word, dense = content_features(s.column(2))
                cut = np.searchsorted(doc, np.arange(s.num_rows + 1))
                meta = metadata_features(s.column(2), s.columns[3:])
                yield pa.RecordBatch.from_arrays([
                    s.column(0), s.column(1),
                    pa.array([word[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.array([d.astype("<f4").tobytes() for d in dense], pa.binary()),
                    pa.array([m.astype("<i4").tobytes() for m in meta], pa.binary())],
                    names=["order", "good", "words", "dense", "meta"])

    return rows.mapInArrow(run, "order long, good int, words binary, dense binary, meta binary").toArrow()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          fields: tuple[str, ...] = ("source", "lang"), labelled: int = LABELLED, pool: int = POOL,
          rounds: int = ROUNDS) -> Model:
    """Without labels of both kinds every document is accepted."""
    return fit_views(sample(docs, labels, id_col, text_col, list(fields), labelled, pool).to_pylist(), rounds)


def fit_views(sampled: list[dict], rounds: int = ROUNDS) -> Model:
    """The model of a sample's feature rows."""
    got = sorted(sampled, key=lambda r: (r["order"], r["words"], r["good"] is None))
    y = np.array([-1 if r["good"] is None else r["good"] for r in got])
    seen = np.flatnonzero(y >= 0)
    free = np.flatnonzero(y < 0)
    if min((y[seen] == 0).sum(), (y[seen] == 1).sum()) < FOLDS:
        return ACCEPT_ALL
    content, meta = [], []
    for r in got:
        w = np.frombuffer(r["words"], "<i4").astype(np.int64)
        content.append((np.r_[w, np.arange(WORDS, CONTENT)], np.r_[np.ones(len(w)), np.frombuffer(r["dense"], "<f4")]))
        m = np.unique(np.frombuffer(r["meta"], "<i4")).astype(np.int64)
        meta.append((m, np.ones(len(m))))
    rows = [linear.rows_of(*map(list, zip(*view))) for view in (content, meta)]
    del got, content, meta, sampled  # the rows below are indexed, never copied
    fold = np.empty(len(seen), np.int64)
    for label in (0, 1):  # every fold holds both kinds
        of = y[seen] == label
        fold[of] = np.arange(of.sum()) % FOLDS
    margin = [np.empty(len(seen)), np.empty(len(seen))]
    for f in range(FOLDS):
        diff = _co_train(rows, y, seen[fold != f], free, rounds)
        for v in (0, 1):
            margin[v][fold == f] = linear.scores(rows[v], diff[v][:, None], seen[fold == f])[:, 0]
    diff = _co_train(rows, y, seen, free, rounds)
    platt = np.array([linear.logistic_fit(m[:, None], y[seen]) for m in margin])
    platt[:, 0] = np.maximum(platt[:, 0], 0.0)  # a useless view may not vote against itself
    stack = linear.logistic_fit(
        np.column_stack([platt[v, 0] * margin[v] + platt[v, 1] for v in (0, 1)]), y[seen])
    bad, good = np.bincount(y[seen])
    return Model(diff[0][:WORDS].astype(np.float32), diff[0][WORDS:], diff[1], platt, stack,
                 float(good / (good + CLEAN_WEIGHT * bad)))


def _co_train(rows: list[linear.Rows], y: np.ndarray, fit: np.ndarray, free: np.ndarray,
              rounds: int) -> list[np.ndarray]:
    """The weights of either view, good minus bad, from the labelled rows
    ``fit`` and the unlabelled rows ``free``."""
    views = [linear.Ftrl(CONTENT, 2, alpha=0.1, l1=1.0, l2=1.0).learn(rows[0], y, 4, which=fit),
             linear.Ftrl(META, 2, alpha=0.1, l1=0.5, l2=1.0).learn(rows[1], y, 4, which=fit)]
    taken = [np.zeros(len(y), bool), np.zeros(len(y), bool)]
    for _ in range(rounds):
        given = []
        for v, view in enumerate(views):
            left = free[~taken[1 - v][free]]
            p = linear.softmax(linear.scores(rows[v], view.weights(), left))
            for label in (0, 1):
                sure = np.argsort(-p[:, label], kind="stable")[:PER_ROUND]
                sure = left[sure[p[sure, label] >= SURE]]
                given.append((1 - v, sure, label))
        for to, which, label in given:  # what one view is sure of, the other learns
            new = which[~taken[to][which]]
            taken[to][new] = True
            views[to].learn(rows[to], np.full(len(y), label), 1, which=new)
    weights = [view.weights() for view in views]
    return [w[:, 1] - w[:, 0] for w in weights]


def score(docs: DataFrame, model: Model, text_col: str = "text",
          fields: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """All columns of ``docs`` and content_score, metadata_score, quality
    (probabilities of being good) and accepted. Null texts are empty."""
    named = {"content_score", "metadata_score", "quality", "accepted"}
    kept = [c for c in docs.columns if c not in named]
    schema = docs.select(*kept).schema
    for c in ("content_score", "metadata_score", "quality"):
        schema = schema.add(c, "double")
    schema = schema.add("accepted", "boolean")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    read = [kept.index(f) for f in fields]
    text_at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for s in text_slices(batch, text_col):
                c, d, q = m.combine(*m.views(s.column(text_at), [s.column(i) for i in read]))
                yield pa.RecordBatch.from_arrays(
                    [*s.columns, *[pa.array(x, pa.float64()) for x in (c, d, q)], pa.array(q >= m.threshold)],
                    names=schema.fieldNames())

    return docs.select(*kept).mapInArrow(run, schema)


def good_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, good) of a label table: quality 1 and not toxic."""
    return labels.select(id_col, ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
