"""License scans by conditional compression.

Candidate blocks are runs of lines that name a licence or share three-word runs with a template. Each
block, and each window of it about as long as a template it shares words with, is compressed by itself
and with the template as a zstandard raw dictionary. Every template that shortens the block or a window
enough is confirmed by the exact wording differences: nearly all template words must stand there in
order, and words that tell licences apart (numbers, versions, terms) must be equal.

One pass over whole texts without a shuffle; templates are a small fixed table or a parameter.

Defined results: null and empty texts have no blocks; equal blocks in one text are each reported;
templates tied in reduction are ranked by name; repeated rows are judged alike; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.store import ship, table

#: Public wordings of licence notices and grants.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
)
#: Every template above has one of these.
HINT = re.compile(r"licen[sc]|copyright|public domain|hereby granted|redistribut|all rights reserved|free software", re.I)
#: Words whose change makes another licence.
TELLING = re.compile(r"\d|^(mit|apache|gnu|lesser|affero|bsd|mpl|mozilla|cc|cc0|by(-\w+)*|nc|nd|sa|isc|attribution(-\w+)*|not|neither|without)$")
MIN_REDUCTION, MIN_WORDS = 0.15, 0.9
MATCHES = "array<struct<license:string,start:int,end:int,reduction:double,words_changed:int,exact:boolean>>"
_WORD = re.compile(r"\w+(?:[-./]\w+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates=TEMPLATES):
        import zstandard as z

        self.templates = [(name, text, words(text)) for name, text in templates]
        self.grams = {g for _, _, w in self.templates for g in zip(w, w[1:], w[2:], strict=False)}
        self.plain = z.ZstdCompressor(level=9, write_content_size=False)
        self.given = [z.ZstdCompressor(level=9, write_content_size=False, dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for _, t, _ in self.templates]

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Character spans of runs of candidate lines; blank lines don't end a run."""
        if not HINT.search(text):
            return []
        spans: list[list[int]] = []
        at, open_ = 0, False
        for line in text.split("\n"):
            end = at + len(line)
            if line.strip():
                w = words(line)
                if HINT.search(line) or sum(g in self.grams for g in zip(w, w[1:], w[2:], strict=False)) >= 2:
                    if open_:
                        spans[-1][1] = end
                    else:
                        spans.append([at, end])
                    open_ = True
                else:
                    open_ = False
            at = end + 1
        return [(a, b) for a, b in spans]

    def windows(self, template: list[str], block: list[str]) -> list[tuple[int, int]]:
        """Word spans of about the template's size around the pairs of words that the block shares with it."""
        n, at = len(template), {}
        for i, g in enumerate(zip(template, template[1:], strict=False)):
            at.setdefault(g, []).append(i)
        slack = max(2, n // 8)
        starts = sorted({j - i for j, g in enumerate(zip(block, block[1:], strict=False)) for i in at.get(g, ())})
        out: list[tuple[int, int]] = []
        last = None
        for x in starts:
            if last is None or x - last > slack // 2:
                out.append((max(0, x - slack), min(len(block), x + n + slack)))
                last = x
        return out

    def differences(self, template: list[str], block: list[str]) -> int | None:
        """Words to change in the block's matching stretch to get the template; None if it isn't that template."""
        ops = difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
        same = sum(b - a for tag, a, b, _, _ in ops if tag == "equal")
        if same < MIN_WORDS * len(template):
            return None
        first = next(i for i, op in enumerate(ops) if op[0] == "equal")
        last = max(i for i, op in enumerate(ops) if op[0] == "equal")
        changed = 0
        for i, (tag, a, b, c, d) in enumerate(ops):
            if tag == "equal":
                continue
            inside = first < i < last
            if any(TELLING.search(w) for w in template[a:b]) or inside and any(TELLING.search(w) for w in block[c:d]):
                return None
            changed += max(b - a, d - c) if inside else b - a
        return changed

    def scan(self, text: str | None) -> list[dict]:
        out = []
        for a, b in self.blocks(text) if text else []:
            block = text[a:b]
            data = block.encode("utf-8", "surrogatepass")
            alone = len(self.plain.compress(data))
            own = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(block)]
            plain = [w for w, _, _ in own]
            found = []
            for c, (name, _, w) in zip(self.given, self.templates, strict=True):
                reduction = 1 - len(c.compress(data)) / alone
                n = self.differences(w, plain) if reduction >= MIN_REDUCTION else None
                if n is not None:
                    found.append((-reduction, name, n))
                for i, j in self.windows(w, plain) if n != 0 else ():
                    part = block[own[i][1] : own[j - 1][2]].encode("utf-8", "surrogatepass")
                    reduction = 1 - len(c.compress(part)) / len(self.plain.compress(part))
                    if reduction >= MIN_REDUCTION and (n := self.differences(w, plain[i:j])) is not None:
                        found.append((-reduction, name, n))
            best: dict[str, dict] = {}
            for reduction, name, n in sorted(found, key=lambda x: (x[2] > 0, *x)):  # a verbatim grant counts before a changed one
                if name not in best:
                    best[name] = {"license": name, "start": a, "end": b, "reduction": round(-reduction, 6), "words_changed": n, "exact": n == 0}
            out += sorted(best.values(), key=lambda m: (-m["reduction"], m["license"]))
        return out


def licenses(spark: SparkSession, text: Column, templates=TEMPLATES) -> Column:
    """The licences that a text carries."""
    ship(spark)

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(templates)
        for texts in batches:
            yield pd.Series([scanner.scan(t) for t in texts], dtype=object)

    return F.pandas_udf(scan, MATCHES).asNondeterministic()(text)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", licenses(spark, F.col("text")).alias("matches"))
    return found.select("doc_id", F.array_sort(F.array_distinct("matches.license")).alias("licenses"), F.size("matches").alias("n_matches"), "matches")
