"""License notices found by patience alignment with templates.

Words that occur once in both the text and a template are anchors; the longest run of anchors in the same order in both
is kept, and the gaps between them are aligned in the same way. The aligned words' share of the template is its coverage.
Where a gap has no anchor, equal words at its two ends are still taken.

A text is searched piece by piece: a notice is short, so the text is cut into stretches around the words it shares
with the template, and only stretches that could reach the coverage are aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.columns import documents, map_texts, text_of

#: Share of a template's words that a text has to hold in order.
COVERAGE = 0.8
#: A notice may be spread over so many times the template's words: any that is no longer lies whole in one of the stretches that are aligned.
SPREAD = 2

#: Short notices of public licenses, by SPDX identifier, and the notice that reserves all rights.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "LicenseRef-All-Rights-Reserved": ("All rights reserved.",),
}

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ascending in the first, that also ascends in the second: patience piles with back links."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            ends.append(k)
        else:
            tops[pile], ends[pile] = b, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of aligned equal words, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # equal words at the gap's ends
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _increasing([(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at_b])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _stretches(text: list[str], template: list[str], least: int):
    """(start, end) of the text's stretches that may hold `least` of the template's words: around runs of shared words with no
    gap longer than the template. Stretches are a third longer than SPREAD templates and start a quarter of their length apart, so each
    run of SPREAD templates lies in one."""
    vocabulary = set(template)
    hits = [i for i, w in enumerate(text) if w in vocabulary]
    width = -(-4 * SPREAD * len(template) // 3) + 4
    at = 0
    while at < len(hits):
        start = hits[at]
        end = bisect_left(hits, start + width, at)
        if end - at >= least:
            yield start, hits[end - 1] + 1
        step = bisect_left(hits, start + max(1, width // 4), at)
        at = max(at + 1, step)


def find(text: list[str], template: list[str], coverage: float) -> tuple[float, int, int]:
    """Coverage of the template in its best stretch, and the first and last aligned word's place; (0, -1, -1) below."""
    least = -(-int(coverage * 1000) * len(template) // 1000)
    best = (0.0, -1, -1)
    for start, end in _stretches(text, template, least):
        pairs = align(text[start:end], template)
        share = len(pairs) / len(template)
        if share > best[0]:
            best = (share, start + pairs[0][0], start + pairs[-1][0])
            if share == 1.0:
                break
    return best if len(template) and best[0] >= coverage else (0.0, -1, -1)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Rows (key, license, coverage, first_word, last_word, n_licenses) of all documents: the best-covered license (the
    first in the order of `templates` among equals; longer notices win), where its notice stands, and how many different
    licenses the text holds. Without one, license is null, coverage 0, the places -1. A null text counts as empty and null keys
    stay null; repeated rows have equal results, an empty table none. Other columns are passed over, whatever their names; a key named as
    one of the results is an error."""
    if key in ("license", "coverage", "first_word", "last_word", "n_licenses"):
        raise ValueError(f"the key is named as a result: {key}")
    cut = [(name, words(t)) for name, ts in (templates or TEMPLATES).items() for t in ts]
    vocabulary = {w for _, t in cut for w in t}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in batch.column("_text").to_pylist():
            own = words(t)
            shared = vocabulary.intersection(own)
            found = []
            for name, template in cut:
                distinct = set(template)
                # what is missing from the text can't be aligned
                if sum(w in shared for w in template) >= coverage * len(template) and distinct & shared:
                    share, a, b = find(own, template, coverage)
                    if a >= 0:
                        found.append((share * len(template), share, name, a, b))
            best = max(found, key=lambda f: f[0], default=(0, 0.0, None, -1, -1))
            rows.append((best[2], best[1], best[3], best[4], len({f[2] for f in found})))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        names = ["license", "coverage", "first_word", "last_word", "n_licenses"]
        return pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, *names])

    base = docs.select(key, text_of(text).alias("_text"))
    return map_texts(base, "_text", run, f"{key} {base.schema[key].dataType.simpleString()}, license string, coverage double, first_word long, last_word long, n_licenses long")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
