"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Words are runs of ASCII letters and digits and of other than ASCII bytes, in lower case; shingles are five words, or
the whole template if it is shorter. Templates fall into length classes, powers of two. Windows of a class overlap so
that every template-long stretch lies whole in one of them: the step is a quarter of the class, the width the class
plus the step less one. At containment 0.8 the Jaccard similarity of a template and that window is then at least
0.8 * c/2 / (5/4 c + 0.1 c) > 0.29, and with 32 bands of one row the template is retrieved with probability over
1 - (1 - 0.29) ** 32 > 0.9999. A retrieved template is verified on the shingles of the window themselves.

A window without any shingle of any template contains none, so only windows over such shingles are hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.shared import Words, blocks, mixed
from loamwork.sources.tables import table

#: License notices, headers, and texts of licenses that are short.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Apache-2.0-disclaimer", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0-text", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("MIT-license", "This project is licensed under the MIT License."),
    ("MIT-warranty", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-text", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("LGPL-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("BSD-2-clauses", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("SPDX-MIT", "SPDX-License-Identifier: MIT"),
    ("SPDX-Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("SPDX-GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("SPDX-BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)

SHINGLE, BANDS, CONTAINMENT = 5, 32, 0.8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Template(NamedTuple):
    name: str
    words: int
    shingles: np.ndarray
    signature: np.ndarray
    size: int


def license_words(texts: pa.Array) -> Words:
    return Words(texts, apart=_APART, change=_LOWER)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of BANDS hashes; a band has one row."""
    return np.array([mixed(shingles, 101 + k).min() for k in range(BANDS)], np.uint64)


def prepared(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[Template]:
    out = []
    for name, text in templates:
        words = license_words(pa.array([text]))
        n = len(words.start)
        if n:
            size = min(SHINGLE, n)
            hashes, whole = words.windows(size)
            shingles = np.unique(hashes[whole])
            out.append(Template(name, n, shingles, signature(shingles), size))
    return out


def matches(words: Words, templates: list[Template], least: float = CONTAINMENT) -> list[tuple[int, str, int, int, float]]:
    """(row, name, first word, end word, containment) of each stretch that holds a template."""
    found: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
    for size in sorted({t.size for t in templates}):
        some = [t for t in templates if t.size == size]
        hashes, whole = words.windows(size)
        every = np.unique(np.concatenate([t.shingles for t in some]))
        near = np.minimum(np.searchsorted(every, hashes), len(every) - 1)
        hits = np.flatnonzero((every[near] == hashes) & whole)
        for kind in sorted({int(len(t.shingles) - 1).bit_length() for t in some}):
            mine = [t for t in some if int(len(t.shingles) - 1).bit_length() == kind]
            step = max(1, (1 << kind) // 4)
            width = (1 << kind) + step - 1
            # windows begin at a text's words 0, step, 2 * step ...; those that may hold a hit
            begin = words.first[words.doc[hits]]
            last = (hits - begin) // step
            windows = np.unique(np.concatenate([begin + np.maximum(last - k, 0) * step for k in range(-(-width // step) + 1)])) if len(hits) else hits
            for a in windows.tolist():
                doc = int(words.doc[a])
                b = min(a + width, int(words.first[doc + 1]) - size + 1)
                inside = np.unique(hashes[a:b])
                if not len(inside):
                    continue
                mark = signature(inside)
                for t in mine:
                    if not (mark == t.signature).any():
                        continue
                    at = a + np.flatnonzero(np.isin(hashes[a:b], t.shingles))
                    share = len(np.unique(hashes[at])) / len(t.shingles)
                    if share >= least:
                        found.setdefault((doc, t.name), []).append((int(at[0]), int(at[-1]) + size, share))
    out = []
    for (doc, name), stretches in found.items():
        kept: list[tuple[int, int, float]] = []
        for a, b, share in sorted(stretches):
            if kept and a < kept[-1][1]:
                kept[-1] = (kept[-1][0], max(b, kept[-1][1]), max(share, kept[-1][2]))
            else:
                kept.append((a, b, share))
        out += [(doc, name, a, b, share) for a, b, share in kept]
    return sorted(out)


RESULT = "doc_id long, n_matches int, licenses string, spans string, least_containment double"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the templates found and where, as ``name:start:end`` in code points, end exclusive.

    Stretches of one template that overlap count once. Null and empty texts hold none; rows are scanned each for
    itself, whole, in one pass without a shuffle, so repeated rows get equal answers; an empty table gives no rows, and
    other columns make no difference. The templates are a fixed table that goes with the function.
    """
    ready = prepared(templates)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = license_words(block.column("text"))
            by_row: list[list[tuple[int, int, str, float]]] = [[] for _ in range(block.num_rows)]
            points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            for doc, name, a, b, share in matches(words, ready, least):
                zero = points[words.offsets[doc]]
                by_row[doc].append((int(points[words.start[a]] - zero), int(points[words.end[b - 1]] - zero), name, share))
            yield pa.record_batch(
                [
                    block.column("doc_id"),
                    pa.array([len(x) for x in by_row], pa.int32()),
                    pa.array([",".join(sorted({m[2] for m in x})) for x in by_row], pa.string()),
                    pa.array([",".join(f"{name}:{a}:{b}" for a, b, name, _ in sorted(x)) for x in by_row], pa.string()),
                    pa.array([round(min((m[3] for m in x), default=0.0), 6) for x in by_row]),
                ],
                names=["doc_id", "n_matches", "licenses", "spans", "least_containment"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scanned, RESULT)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES: dict[str, str] = {}
