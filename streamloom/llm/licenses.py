"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import minima, permutations, row_shingles

WORDS, CONTAINMENT = 5, 0.8
#: A band is one minimum. A window of at most 2 * n shingles that holds 0.8 of a template's n has a Jaccard similarity of at
#: least 0.8 / (1 + 2 - 0.8) = 0.36, so that all 24 bands miss it with a chance of 0.64**24 = 2e-5.
BANDS = 24

#: Single sentences by which licenses are named in texts. Whole license texts and the notices that go into
#: files are in the folder license_texts.
SENTENCES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd-short": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-short": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,",
    "mpl-2.0-short": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_MARKS = re.compile(r"[\W_]+")


def templates_of_texts() -> dict[str, str]:
    """The sentences, and every text of the folder by its name."""
    folder = resources.files(__package__) / "license_texts"
    return SENTENCES | {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}


def plain_words(text: str) -> str:
    """Letters and digits in lower case; punctuation, quotes, comment marks and white space are single spaces."""
    return _MARKS.sub(" ", text.lower())


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_shingle, n_shingles) for each row and template that its text holds.

    For each size of template, s shingles, the text's 5-word shingles are cut into windows of 2 s every s / 2, so that
    each passage of s shingles lies whole in one. A window whose MinHash shares one of ``BANDS`` minima with a template
    of that size is compared with it: containment is the exact share of the template's distinct shingles in the window.
    The best window of a text counts, the first of equals. Words are runs of letters and digits, in lower case, so that
    quotes, line ends and comment marks make no difference; templates of one to four words are single shingles of that
    many words and found by equality. Null and blank texts hold nothing, an empty table gives no rows, repeated rows
    repeat their results, other columns are left out. Long texts are searched whole. Nothing is shuffled; templates are
    few and go to all tasks.
    """
    given = {n: w for n, t in (templates_of_texts() if templates is None else templates).items() if t and (w := plain_words(t)).strip()}
    names = sorted(given)
    perms = permutations(BANDS, 8)
    by_k: dict[int, list[tuple[str, np.ndarray]]] = defaultdict(list)
    for n in names:
        k = min(WORDS, len(given[n].split()))
        _, _, sh, _ = next(row_shingles([given[n]], k))
        by_k[k].append((n, np.unique(sh)))
    sized: dict[tuple[int, int], list[tuple[str, np.ndarray, np.ndarray]]] = defaultdict(list)
    for k, found in by_k.items():
        for n, sh in found:
            sized[k, len(sh)].append((n, sh, minima(sh, np.array([0, len(sh)]), perms)[0]))
    kinds = sorted(by_k)
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, license string, containment double, first_shingle long, n_shingles long"

    def one(sh: np.ndarray, k: int) -> Iterator[tuple[str, float, int]]:
        for (kk, s), group in sized.items():
            if kk != k or not len(sh):
                continue
            step = max(1, s // 2)
            begins = np.arange(0, max(len(sh) - s, 0) + step, step)
            begins = begins[begins < len(sh)]
            # Minima of windows: rows of whole steps first, then the least of the steps in a window.
            per = minima(sh, np.append(begins, len(sh)), perms)
            wide = max(1, 2 * s // step)
            least = per.copy()
            for j in range(1, wide):
                least[:-j] = np.minimum(least[:-j], per[j:]) if j < len(per) else least[:-j]
            for n, own, mins in group:
                best = (0.0, 0)
                for w in np.flatnonzero((least == mins).any(axis=1)):
                    part = sh[begins[w] : begins[w] + wide * step]
                    share = len(np.intersect1d(own, part)) / len(own)
                    if share > best[0] + 1e-12:
                        best = (share, int(begins[w] + np.flatnonzero(np.isin(part, own))[0]))
                if best[0] >= containment - 1e-9:
                    yield n, best[0], best[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = {k: np.unique(np.concatenate([sh for _, sh in by_k[k]])) for k in kinds}
        for batch in batches:
            ids = batch.column(0)
            texts = [None if t is None else plain_words(t) for t in batch.column(1).to_pylist()]
            rows: list[tuple[int, str, float, int, int]] = []
            for k in kinds:
                for a, b, sh, ends in row_shingles(texts, k):
                    # Only texts that share a shingle with some template can hold one.
                    near = np.unique(np.searchsorted(ends, np.flatnonzero(np.isin(sh, every[k])), side="right") - 1)
                    for i in near:
                        own = sh[ends[i] : ends[i + 1]]
                        rows += [(a + int(i), n, share, at, len(own)) for n, share, at in one(own, k)]
            rows.sort()
            out = [ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[doc_id, "license", "containment", "first_shingle", "n_shingles"])

    return docs.select(doc_id, text).mapInArrow(run, schema)
