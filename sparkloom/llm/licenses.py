"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line, every paragraph and every window of a template's number of words
within a paragraph of a whole text is a vector of its words' frequencies times their inverse document frequency among the templates (words
of no template have the largest). The best cosine of LEAST or more names the
text's own licence. Each template's heaviest words are its key words: without
one of them a vector's cosine stays below LEAST, so such lines need no scoring.
Of the windows only those are scored whose cosine could reach LEAST if no word
stood in them twice, which is an upper bound.

A licence file is one that is named so, or half of whose words stand in licence
lines. A file without a licence of its own takes that of the licence file in
the nearest directory on its path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import mapped, shipped, written
from ._text import ASCII_LOWER, runs, slices, span_hashes

LEAST = 0.7
NAMED = r"(?i)(^|/)(un)?licen[sc]e|(^|/)copying|(^|/)notice"

# Notices and headers of common licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    *((name, f"SPDX-License-Identifier: {spdx}") for name, spdx in (
        ("GPL-3.0", "GPL-3.0"), ("GPL-3.0", "GPL-3.0-or-later"), ("GPL-2.0", "GPL-2.0"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"),
        ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"),
        ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC0-1.0", "CC0-1.0"), ("MPL-2.0", "MPL-2.0"),
        ("BSD-3-Clause", "BSD-3-Clause"), ("ISC", "ISC"), ("Unlicense", "Unlicense"),
    )),
    # the other paragraphs of short licences in whole
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
)

# Short forms that name a licence by their words together: all of them must be there. So it is with SPDX lines.
TITLES: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)

# Words that tell licences apart: a text without them isn't the short notice that has them.
NAMES = frozenset(b"mit apache gnu affero lesser cc creative noncommercial sharealike cc0 mozilla bsd".split())
SHORT = 16  # words

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Scorer:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES + TITLES, least: float = LEAST):
        self.least = least
        bags = [Counter(_WORD.findall(text.lower().encode())) for _, text in templates]
        df = Counter(w for b in bags for w in b)
        self.unseen = 1 + math.log(1 + len(bags))
        self.idf = {w: 1 + math.log((1 + len(bags)) / (1 + n)) for w, n in df.items()}
        self.vectors, self.own_keys = [], []
        key: set[bytes] = set()
        for (name, _), bag in zip(templates, bags, strict=True):
            v = {w: n * self.idf[w] for w, n in bag.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {w: x / norm for w, x in v.items()}
            self.vectors.append((name, v))
            own: set[bytes] = set()
            rest = 1.0
            for w, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
                if rest < least * least:
                    break
                own.add(w)
                rest -= x * x
            key |= own
            self.own_keys.append(own)
        self.key_words = frozenset(key)
        whole = [text.startswith("SPDX-") or (name, text) in TITLES for name, text in templates]
        self.needed = [bag.keys() if all_ else bag.keys() & NAMES if sum(bag.values()) <= SHORT else set() for bag, all_ in zip(bags, whole, strict=True)]
        self.lengths = [sum(bag.values()) for bag in bags]
        self.number = {w: i for i, w in enumerate(sorted(self.idf))}
        self.weight = np.array([self.idf[w] for w in self.number] + [self.unseen])  # the last is any word of no template
        self.parts = np.array([[t.get(w, 0.0) for w in self.number] + [0.0] for _, t in self.vectors]) * self.weight
        words = np.frombuffer(b" ".join(sorted(key)), np.uint8)
        starts, ends, _ = runs(_INNER[words], np.array([0, len(words)]))
        self.keys = np.unique(span_hashes(words, starts, ends))

    def score(self, part: bytes) -> tuple[str | None, float]:
        """The best template's licence and cosine; ties to the name that sorts first."""
        bag = Counter(_WORD.findall(part.lower()))
        if self.key_words.isdisjoint(bag):
            return None, 0.0
        v = {w: n * self.idf.get(w, self.unseen) for w, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        best: tuple[float, str] | None = None
        for (name, t), own, needed in zip(self.vectors, self.own_keys, self.needed, strict=True):
            if own.isdisjoint(bag) or not needed <= bag.keys():
                continue
            cosine = round(sum(x * v[w] for w, x in t.items() if w in v) / norm, 9) if norm else 0.0
            if cosine >= self.least and (best is None or (-cosine, name) < (-best[0], best[1])):
                best = (cosine, name)
        return (best[1], best[0]) if best else (None, 0.0)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[str | None, float, float]]:
        """For each text: its licence, the cosine, and the share of its words that stand in licence lines."""
        low = ASCII_LOWER[data]
        starts, ends, per_row = runs(_INNER[low], offsets)
        hit = np.isin(span_hashes(low, starts, ends), self.keys)
        row = np.repeat(np.arange(len(per_row)), per_row)
        out: list[tuple[str | None, float, float]] = [(None, 0.0, 0.0)] * len(per_row)
        raw = data.tobytes()
        for r in np.unique(row[hit]).tolist():
            out[r] = self._text(raw[offsets[r] : offsets[r + 1]])
        return out

    def windows(self, words: list[bytes], part: np.ndarray) -> tuple[tuple[str | None, float], np.ndarray]:
        """The best licence of windows that lie in one part, and which words stand in windows of LEAST or more."""
        other = len(self.number)
        ids = np.fromiter((self.number.get(w, other) for w in words), np.int64, len(words))
        norms = np.concatenate(([0.0], np.cumsum(self.weight[ids] ** 2)))
        inside, best = np.zeros(len(words), bool), (None, 0.0)
        present = set(words)
        known = present & self.key_words
        for (name, t), own, m, parts, needed in zip(self.vectors, self.own_keys, self.lengths, self.parts, self.needed, strict=True):
            if m > len(words) or own.isdisjoint(known) or not needed <= present:
                continue
            dots = np.concatenate(([0.0], np.cumsum(parts[ids])))
            may = dots[m:] - dots[:-m] >= (self.least - 1e-6) * np.sqrt(norms[m:] - norms[:-m])
            for i in np.flatnonzero(may & (part[m - 1 :] == part[: len(part) - m + 1])).tolist():
                bag = Counter(words[i : i + m])
                if not needed <= bag.keys():
                    continue
                v = {w: n * self.idf.get(w, self.unseen) for w, n in bag.items()}
                cosine = round(sum(x * v[w] for w, x in t.items() if w in v) / math.sqrt(sum(x * x for x in v.values())), 9)
                if cosine >= self.least:
                    inside[i : i + m] = True
                    best = min(best, (name, cosine), key=lambda x: (-x[1], x[0] or ""))
        return best, inside

    def _text(self, text: bytes) -> tuple[str | None, float, float]:
        best: tuple[str | None, float] = (None, 0.0)
        words: list[bytes] = []
        marks: list[bool] = []
        sizes: list[int] = []
        for part in re.split(rb"\n[ \t\r]*\n", text):
            lines = part.split(b"\n")
            found = [self.score(x) for x in lines]
            mine = [_WORD.findall(x.lower()) for x in lines]
            whole = self.score(part.replace(b"\n", b" ")) if len(lines) > 1 else (None, 0.0)
            for x, (name, _) in zip(mine, found, strict=True):
                words += x
                marks += [bool(whole[0] or name)] * len(x)
            sizes.append(sum(map(len, mine)))
            best = min([best, whole, *found], key=lambda x: (-x[1], x[0] or ""))
        if not words:
            return None, 0.0, 0.0
        most, inside = self.windows(words, np.repeat(np.arange(len(sizes)), sizes))
        best = min([best, most], key=lambda x: (-x[1], x[0] or ""))
        return best[0], best[1], float(np.mean(inside | np.array(marks)))


@cache
def _scorer(templates: tuple[tuple[str, str], ...]) -> Scorer:
    return Scorer(templates)


def license_scan(files: DataFrame, more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """files (path, text, ...) without text, with own_license, own_score, is_license_file, license, inherited_from.

    more are (licence, text) templates besides the built-in ones, such as whole
    licence files. Null and empty texts have no licence of their own; a null
    path has no directory and inherits nothing. Of a directory's licence files
    the one of the highest cosine counts, then the licence that sorts first.
    The directory's own licence file is nearest; inherited_from is its
    directory ('' for the top), null where the licence is the file's own.
    Columns of files with these names are replaced, others stay whatever their
    names; repeated rows stay. The scan reads each text once; its result is
    written to the shared folder.
    """
    shipped(files.sparkSession)
    files = files.drop("own_license", "own_score", "is_license_file", "license", "inherited_from")
    keep = [c for c in files.columns if c != "text"]
    mark = "_"
    while any(c.lower().endswith(mark) for c in keep):
        mark += "_"
    share, folder, up, given = (f"{x}{mark}" for x in ("share", "folder", "up", "given"))
    templates = TEMPLATES + TITLES + tuple(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, offsets, data in slices(batch, "text"):
                name, score, part = zip(*_scorer(templates).scan(data, offsets), strict=True)
                rows = rows.select(keep).append_column("own_license", pa.array(name, pa.string()))
                yield rows.append_column("own_score", pa.array(score, pa.float64())).append_column(share, pa.array(part, pa.float64()))

    schema = files.select(*keep, F.lit("").alias("own_license"), F.lit(0.0).alias("own_score"), F.lit(0.0).alias(share)).schema
    for f in schema.fields:
        f.nullable = True
    found = written(mapped(files, run, schema), "licenses")
    named = F.coalesce(F.col("path").rlike(NAMED), F.lit(False)) | (F.col(share) >= 0.5)
    found = found.withColumn("is_license_file", F.col("own_license").isNotNull() & named).drop(share)
    found = found.withColumn(folder, F.regexp_extract("path", r"^(.*)/[^/]*$", 1))

    # nearest licence of every directory; there are far fewer directories than files
    notices = found.where(F.col("is_license_file") & F.col(folder).isNotNull()).groupBy(F.col(folder).alias(up))
    notices = notices.agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_license")).getField("own_license").alias(given))
    dirs = found.where(F.col(folder).isNotNull()).select(folder).distinct()
    steps = F.split(folder, "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    dirs = dirs.select(folder, F.explode(F.array_distinct(ups)).alias(up)).join(notices, up)
    dirs = dirs.groupBy(folder).agg(F.max(F.struct(F.length(up).alias("d"), up, given)).alias("at"))
    dirs = dirs.select(folder, F.col("at").getField(up).alias(up), F.col("at").getField(given).alias(given))
    mine = F.col("own_license").isNotNull()
    return found.join(dirs, folder, "left").select(
        *(F.col(f"`{c}`") for c in keep),
        "own_license",
        "own_score",
        "is_license_file",
        F.coalesce("own_license", given).alias("license"),
        F.when(~mine, F.col(up)).alias("inherited_from"),
    )


def document_path() -> Column:
    """Where a document lies, by a rule: source, language, fifty documents to a folder; null without doc_id. A null step is left out."""
    folder = F.floor(F.col("doc_id") / 50).cast("string")
    return F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", "source", "lang", folder, F.col("doc_id").cast("string")))
