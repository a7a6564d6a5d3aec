"""License scan: MinHash bands over overlapping text windows retrieve templates, shingles verify.

Words are runs of letters and digits (ASCII marks and white space separate them), A-Z count as
a-z, and shingles have WIDTH words; a shorter template is one shingle of all its words.  A
template of T words is looked for in windows of T + s - 1 words, one each s = max(1, T // 4)
words, so any T words in a row lie whole in some window.  A text that holds CONTAINED of the
template's shingles within T words has a window whose resemblance to the template is at least
CONTAINED * m / (m + s - 1 + (1 - CONTAINED) * m) for m shingles; there are as many bands of one
MinHash value as give such a window a collision with probability GUARANTEE.  A window that
collides is verified: the share of the template's shingles that it holds.

The minima of all windows of a band come from minima of runs of 1, 2, 4 ... shingles, which all
families of one shingle width share.  A row with fewer shingles than a match needs has no windows.
Nothing moves between tasks: templates are a small checked table that goes with the function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import ceil, log
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import pack, tidied
from ledgerline.llm.words import MARKS, mix, shingles, text_chunks, word_hashes

_U = np.uint64
WIDTH, CONTAINED, GUARANTEE = 5, 0.8, 0.9999
#: Templates and words of all of them that a scan takes.
MAX_TEMPLATES, MAX_WORDS = 5_000, 2_000_000
#: Shingles whose windows are looked at together.
PART = 1 << 18

#: Public licence notices, as their owners ask to write them.
NOTICES = (
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("mit-line", "Released under the MIT License."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("all-rights-reserved", "All rights reserved."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)

#: Whole licence texts and file headers, named by SPDX identifier (with -header).
LICENSES = Path(__file__).parent / "licenses"


def licences() -> list[tuple[str, str]]:
    """The default templates: NOTICES and the texts of LICENSES."""
    return [*NOTICES, *((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(LICENSES.glob("*.txt")))]


@dataclass
class Family:
    """The templates of one number of words."""

    words: int
    width: int
    stride: int
    bands: int
    ids: list[str]
    members: list[np.ndarray]
    values: np.ndarray  # bands x templates


def bands_for(m: int, stride: int) -> int:
    """Bands that a window holding CONTAINED of m shingles needs for GUARANTEE."""
    need = ceil(CONTAINED * m - 1e-9)
    alike = need / (m + stride - 1 + m - need)
    return 1 if alike >= 1 else ceil(log(1 - GUARANTEE) / log(1 - alike))


def _permuted(values: np.ndarray, band: int) -> np.ndarray:
    seed = mix(np.array([band + 1], np.uint64))
    return (values ^ seed) * (mix(seed) | _U(1))


def families(templates: list[tuple[str, str]]) -> list[Family]:
    by: dict[int, list[tuple[str, np.ndarray]]] = {}
    for name, text in templates:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        hashes, firsts = word_hashes(raw, np.array([0, len(raw)]), MARKS)
        if len(hashes):
            made, _ = shingles(hashes, firsts, min(WIDTH, len(hashes)))
            by.setdefault(len(hashes), []).append((name, np.unique(made)))
    out = []
    for words, group in sorted(by.items()):
        width = min(WIDTH, words)
        stride = max(1, words // 4)
        bands = max(bands_for(len(m), stride) for _, m in group)
        values = np.array([[_permuted(m, b).min() for _, m in group] for b in range(bands)], np.uint64)
        out.append(Family(words, width, stride, bands, [n for n, _ in group], [m for _, m in group], values))
    return out


def _windows(counts: np.ndarray, starts: np.ndarray, f: Family) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first shingle, end) of a family's windows over rows of so many shingles; a row that can't hold enough has none.

    A row of at most one window's shingles is one window; else the last window ends with the row.
    """
    span = max(1, f.words + f.stride - 1 - f.width + 1)
    least = min(ceil(CONTAINED * len(m) - 1e-9) for m in f.members)
    rows = np.flatnonzero(counts >= least)
    room = np.maximum(counts[rows] - span, 0)
    number = -(-room // f.stride) + 1
    place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    begin = np.minimum(place * f.stride, np.repeat(room, number))
    row = np.repeat(rows, number)
    return row, starts[row] + begin, starts[row] + np.minimum(begin + span, counts[row])


def _least_of(values: np.ndarray, low: np.ndarray, high: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The minimum of values[low:high] for each pair, from minima of runs of 1, 2, 4 ... that ``levels`` gathers."""
    if not levels:
        levels.append(values)
    top = np.frexp(high - low)[1] - 1
    while len(levels) <= top.max(initial=0):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    out = np.empty(len(low), np.uint64)
    for k in np.unique(top):
        at = np.flatnonzero(top == k)
        out[at] = np.minimum(levels[k][low[at]], levels[k][high[at] - (1 << int(k))])
    return out


def _retrieved(made: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], group: list[Family]) -> list[np.ndarray]:
    """For each family the (window, template) pairs that share a MinHash value in some band.

    ``made`` is gone through PART shingles at a time, with the windows that begin there.
    """
    met: list[list[np.ndarray]] = [[] for _ in group]
    for part in range(0, max(len(made), 1), PART):
        inside = [np.arange(*np.searchsorted(low, [part, part + PART])) if np.all(low[1:] >= low[:-1]) else np.flatnonzero((low >= part) & (low < part + PART))
                  for _, low, _ in windows]
        end = max([int(high[at].max()) for at, (_, _, high) in zip(inside, windows) if len(at)], default=part)
        for band in range(max(f.bands for f in group)):
            levels: list[np.ndarray] = []
            values = None
            for f, at, (_, low, high), out in zip(group, inside, windows, met):
                if band >= f.bands or not len(at):
                    continue
                if values is None:
                    values = _permuted(made[part:end], band)
                least = _least_of(values, low[at] - part, high[at] - part, levels)
                order = np.argsort(f.values[band])
                ranked = f.values[band][order]
                first, last = np.searchsorted(ranked, least, "left"), np.searchsorted(ranked, least, "right")
                for i in np.flatnonzero(last > first):
                    out += [np.array([at[i], order[j]]) for j in range(first[i], last[i])]
    return [np.unique(np.array(m).reshape(-1, 2), axis=0) for m in met]


def _matches(made: np.ndarray, counts: np.ndarray, starts: np.ndarray, group: list[Family]) -> Iterator[tuple[Family, int, int, int, float]]:
    """(family, row, template, first shingle in the row, containment) of the retrieved windows that hold enough."""
    windows = [_windows(counts, starts, f) for f in group]
    for f, (row, low, high), met in zip(group, windows, _retrieved(made, windows, group)):
        for window, k in met.tolist():
            share = float(np.isin(f.members[k], made[low[window] : high[window]]).mean())
            if share >= CONTAINED - 1e-12:
                yield f, int(row[window]), k, int(low[window] - starts[row[window]]), share


@tidied
def _scan(batches: Iterator[pa.RecordBatch], templates: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    by_width: dict[int, list[Family]] = {}
    for f in families(templates):
        by_width.setdefault(f.width, []).append(f)
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for first, raw, offsets in text_chunks(batch.column("text")):
            hashes, firsts = word_hashes(raw, offsets, MARKS)
            words = np.diff(firsts)
            for width, group in by_width.items():
                if not (words >= width).any():
                    continue
                made, starts = shingles(hashes, firsts, width)
                counts = np.where(words >= width, np.diff(starts), 0)
                found: dict[tuple[int, str], list] = {}
                for f, row, k, start, share in _matches(made, counts, starts, group):
                    found.setdefault((row, f.ids[k]), []).append((start, share, f.words))
                for (row, name), places in sorted(found.items()):
                    places.sort()
                    spans, at = 0, -places[0][2]
                    for start, _, length in places:
                        if start - at >= length:
                            spans, at = spans + 1, start
                    for column, value in zip(out, (first + row, name, spans, max(s for _, s, _ in places), places[0][0])):
                        column.append(value)
        take = pa.array(out[0], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(take), batch.column("_rest").take(take), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.int64())],
            names=["doc_id", "_rest", "template_id", "n_spans", "containment", "first_word"],
        )


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text) and template it holds: doc_id, _rest, template_id, n_spans, containment, first_word.

    ``templates`` has (template_id, text), by default ``licences()``; MAX_TEMPLATES and MAX_WORDS bound
    it, more is an error.  ``containment`` is the best window's share of the template's shingles,
    ``first_word`` where the first such window starts, ``n_spans`` counts places that lie apart.
    Null and empty texts and templates match nothing; a null doc_id stays null.  Repeated rows have rows of their own;
    ``_rest`` holds the table's other columns.
    """
    rows = licences()
    if templates is not None:
        got = templates.select(F.col("template_id").cast("string"), "text").filter("text is not null").limit(MAX_TEMPLATES + 1).collect()
        rows = sorted((r[0] or "", r[1]) for r in got)
        if len(rows) > MAX_TEMPLATES or sum(len(t.split()) for _, t in rows) > MAX_WORDS:
            raise ValueError("too many templates")
    packed = pack(docs, ["doc_id", "text"])
    types = {f.name: f.dataType.simpleString() for f in packed.schema}
    ddl = f"doc_id {types['doc_id']}, _rest {types['_rest']}, template_id string, n_spans long, containment double, first_word long"
    return packed.mapInArrow(partial(_scan, templates=rows), ddl)
