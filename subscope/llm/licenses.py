"""License scan: MinHash bands over overlapping windows retrieve templates
(short ones: a lookup of their shingles), exact shingle containment verifies
them.

Templates are grouped by length (powers of two of their words). For a group
of at most ``L`` words the documents are cut into windows of ``2 L`` words
that start every ``L`` words, so a passage of up to ``L + 1`` words lies
whole in one window. A window is signed by MinHash values, each a band of one
row. A window that holds the least share of a template's shingles agrees with
it in at least a known part J of the union of their shingles; a group has so
many bands that none agrees with a probability (1 - J)^bands of at most
``MISS``. Templates of under ``SHORT`` shingles share too little with a window
for that: every window that holds any of their shingles is retrieved.
Retrieved windows are verified by the exact share of the template's shingles
in them.

Words are runs of letters and digits in lower case with every digit read as
0, so punctuation and version numbers do not matter. Templates are few and
given as a parameter; documents are read in place and nothing is shuffled but
the hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import ALNUM, byte_arrays, lowered, mix64, shingle_hashes, text_slices, word_hashes, word_spans

K, LEAST = 5, 0.8
MISS, SHORT = 1e-6, 8

# Notices as they are commonly written.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                     "except in compliance with the License. You may obtain a copy of the License at",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are "
                          "permitted provided that the following conditions are met:",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                  "GNU General Public License as published by the Free Software Foundation",
    "mit-notice": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                      "and associated documentation files (the \"Software\"), to deal in the Software without "
                      "restriction",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_DIGITS = np.arange(256, dtype=np.uint8)
_DIGITS[48:58] = 48


def _shingles(col: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """(hash, first word, text of each word, word starts, word ends)."""
    data, offsets = byte_arrays(lowered(col))
    data = _DIGITS[data]
    starts, ends, text = word_spans(data, offsets, ALNUM)
    h, first = shingle_hashes(word_hashes(data, starts, ends), text, k)
    return h, first, text, starts - offsets[text], ends - offsets[text]


def _permuted(h: np.ndarray, band: int) -> np.ndarray:
    x = (h ^ mix64(np.array([band + 1], np.uint64))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Group:
    """Templates of at most ``words`` words and of more than half as many;
    short ones without bands."""

    def __init__(self, words: int, short: bool, names: list[str], sets: list[np.ndarray], least: float):
        self.words, self.short, self.names, self.sets = words, short, names, sets
        bands = 0 if short else max(_bands(len(s), 2 * words, least) for s in sets)
        self.minima = [np.array([_permuted(s, b).min() for s in sets]) for b in range(bands)]
        self.maybe = [_table_of(m) for m in self.minima]
        self.any = _table_of(np.concatenate(sets))


def _bands(shingles: int, window: int, least: float) -> int:
    """Bands by which a window of so many shingles that holds the least share
    of a template is missed with a probability of at most ``MISS``."""
    need = max(1, math.ceil(least * shingles - 1e-9))
    return math.ceil(math.log(MISS) / math.log1p(-need / (window + shingles - need)))


def _table_of(h: np.ndarray) -> np.ndarray:
    """Which values of the high 16 bits occur."""
    table = np.zeros(1 << 16, bool)
    table[(h >> np.uint64(48)).astype(np.int64)] = True
    return table


def groups_of(templates: dict[str, str], k: int, least: float = LEAST) -> list[Group]:
    by: dict[tuple[int, bool], tuple[list, list]] = {}
    for name, text in sorted(templates.items()):
        h, _, words, _, _ = _shingles(pa.array([text]), k)
        if not len(h):
            raise ValueError(f"template {name} has fewer than {k} words")
        own = np.unique(h)
        kind = 1 << (len(words) - 1).bit_length(), len(own) < SHORT
        by.setdefault(kind, ([], []))
        by[kind][0].append(name)
        by[kind][1].append(own)
    return [Group(*kind, *by[kind], least) for kind in sorted(by)]


def _scan(col: pa.Array, groups: list[Group], k: int, least: float) -> Iterator[tuple]:
    """(text, template, shared, shingles, start byte, end byte) of each window
    that holds a template."""
    h, first, text, starts, ends = _shingles(col, k)
    if not len(h):
        return
    doc = text[first]
    # place of a shingle's first word in its text
    begins = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    at = first - begins[np.searchsorted(begins, first, side="right") - 1]
    windows = []
    for g in groups:
        # half windows: runs of shingles that start in the same L words; a
        # window is a run and the next one of the same text
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] // g.words != at[:-1] // g.words)])
        pair = np.r_[doc[new[1:]] == doc[new[:-1]], False]
        windows.append((new, pair))
    hits = [set() for _ in groups]
    for g, (new, pair), found in zip(groups, windows, hits):
        if g.short:
            some = np.flatnonzero(g.any[(h >> np.uint64(48)).astype(np.int64)])
            for t, own in enumerate(g.sets):
                run = np.unique(np.searchsorted(new, some[np.isin(h[some], own)], side="right") - 1)
                before = run[run > 0] - 1  # the window that a run ends
                found.update((w, t) for w in np.r_[run, before[pair[before]]].tolist())
    for b in range(max((len(g.minima) for g in groups), default=0)):
        x = _permuted(h, b)
        for g, (new, pair), found in zip(groups, windows, hits):
            if b >= len(g.minima):
                continue
            low = np.minimum.reduceat(x, new)
            low[:-1] = np.where(pair[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
            for w in np.flatnonzero(g.maybe[b][(low >> np.uint64(48)).astype(np.int64)]).tolist():
                for t in np.flatnonzero(g.minima[b] == low[w]).tolist():
                    found.add((w, t))
    for g, (new, pair), found in zip(groups, windows, hits):
        bounds = np.r_[new, len(h)]
        for w, t in sorted(found):
            lo, hi = int(bounds[w]), int(bounds[w + 2 if pair[w] else w + 1])
            mine = np.flatnonzero(np.isin(h[lo:hi], g.sets[t]))
            shared = len(np.unique(h[lo:hi][mine]))
            if shared >= least * len(g.sets[t]) - 1e-9:
                yield (int(doc[lo]), g.names[t], shared, len(g.sets[t]),
                       int(starts[first[lo + mine[0]]]), int(ends[first[lo + mine[-1]] + k - 1]))


def license_hits(docs: DataFrame, templates: dict[str, str] | None = None, k: int = K, least: float = LEAST,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, shared, template_shingles, start_byte, end_byte): one
    row for every window that verifies, so a passage in two overlapping
    windows comes twice. Null and empty texts have none; repeated rows each
    give their own."""
    schema = docs.select(id_col).schema.add("license", "string").add("shared", "long").add(
        "template_shingles", "long").add("start_byte", "long").add("end_byte", "long")
    chosen = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groups_of(chosen, k, least)
        for batch in batches:
            for part in text_slices(batch, text_col, 1 << 20):
                hits = list(_scan(part.column(1), groups, k, least))
                if hits:
                    cols = list(zip(*hits))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.string()),
                         *[pa.array(c, pa.int64()) for c in cols[2:]]], names=schema.fieldNames())

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def licenses_by_document(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, license, containment, passages): the best share of each license
    found in a document and its distinct places."""
    return hits.groupBy(id_col, "license").agg(
        F.max(F.col("shared") / F.col("template_shingles")).alias("containment"),
        F.count_distinct("start_byte").alias("passages"))
