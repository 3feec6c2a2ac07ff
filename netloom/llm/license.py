"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A document's lines, paragraphs and whole text are compared with every template;
its own licence is that of the closest one from ``THRESHOLD`` on. A document
without one takes the licence of the nearest directory above it that has a
licence file with one. Term weights come from the templates alone, so a text's
result does not depend on the rest of the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm import bytewords, common

THRESHOLD = 0.75

_SOFTWARE = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TOP = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_END = (
    "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
    "You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)


def _gnu(name: str, version: str, later: bool) -> str:
    """The notice that files under a GNU licence carry."""
    which = f"either version {version} of the License, or (at your option) any later version. " if later else f"version {version} of the License. "
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {which}This program " + _GNU_END.format(name=name)


_GNU = (("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("AGPL", "Affero General Public License", ("3",)))

# Short notices, header notices, and the whole texts of the short licences. A longer licence is known by its notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _SOFTWARE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((f"{short}-{v if '.' in v else v + '.0'}-only", f"This work is licensed under the GNU {name}, version {v}.") for short, name, versions in _GNU for v in versions),
    *((f"{short}-{v if '.' in v else v + '.0'}-{'or-later' if later else 'only'}", _gnu(name, v, later)) for short, name, versions in _GNU for v in versions for later in (False, True)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", _BSD_TOP + _BSD_END),
    ("BSD-3-Clause", _BSD_TOP + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AUTHOR),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AUTHOR),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        + _SOFTWARE.replace("NONINFRINGEMENT", "TITLE AND NON-INFRINGEMENT").replace("AUTHORS OR COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        + _SOFTWARE.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to <https://unlicense.org>"),
)

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _blocks(texts: pa.Array) -> Iterator[tuple[int, bytewords.Block]]:
    return bytewords.blocks(texts, lower=True, blank=_NOT_WORD)


class Matcher:
    """Templates as sparse vectors over hashed terms; terms outside of them all weigh alike."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [name for name, _ in templates]
        terms = [Counter(b.hashes.tolist()) for text in templates for _, b in _blocks(pa.array([text[1]]))]
        held = Counter(t for c in terms for t in c)
        weigh = lambda n: math.log((1 + len(templates)) / (1 + n)) + 1
        self.other = weigh(0)
        self.weight = {t: weigh(n) for t, n in held.items()}
        self.vocabulary = np.array(sorted(held), np.uint64)
        self.squares = np.array([self.weight[t] ** 2 for t in self.vocabulary.tolist()])
        self.vectors = []
        for c in terms:
            norm = math.sqrt(sum((n * self.weight[t]) ** 2 for t, n in c.items()))
            self.vectors.append({t: n * self.weight[t] / norm for t, n in c.items()})

    def closest(self, terms: list[int]) -> tuple[float, int]:
        """The largest cosine and its template (the first of equals)."""
        counts = {t: n * self.weight.get(t, self.other) for t, n in Counter(terms).items()}
        norm = math.sqrt(sum(x * x for x in counts.values()))
        best = max(((sum(x * v.get(t, 0.0) for t, x in counts.items()) / norm, -k) for k, v in enumerate(self.vectors)), default=(0.0, 0))
        return min(1.0, best[0]), -best[1]

    def match(self, texts: pa.Array, threshold: float) -> tuple[list[str | None], list[float]]:
        """The own licence of each text, null without one, and the cosine that decided it."""
        names, scores = [None] * len(texts), [0.0] * len(texts)
        for base, block in _blocks(texts):
            n = len(block.hashes)
            if not n:
                continue
            known = np.minimum(np.searchsorted(self.vocabulary, block.hashes), len(self.vocabulary) - 1)
            inside = self.vocabulary[known] == block.hashes
            running = np.concatenate([[0], np.cumsum(~inside)])
            document = np.repeat(np.arange(len(block.first) - 1), np.diff(block.first))
            feeds = np.flatnonzero(block.data == 10)
            line = np.searchsorted(feeds, block.starts)
            # A blank line ends a paragraph: the feeds between two words hold nothing but white space.
            jump = np.diff(line, prepend=line[:1])
            for parts in (jump > 0, jump > 1, np.zeros(n, bool)):
                cut = parts.copy()
                cut[1:] |= document[1:] != document[:-1]
                cut[0] = True
                a = np.flatnonzero(cut)
                b = np.append(a[1:], n)
                others = running[b] - running[a]
                # The templates' terms weigh what they do; the others at least as if all differed.
                segment = np.repeat(np.arange(len(a)), b - a)[inside]
                term, times = np.unique(segment * len(self.vocabulary) + known[inside], return_counts=True)
                top = np.bincount(term // len(self.vocabulary), times**2 * self.squares[term % len(self.vocabulary)], len(a))
                possible = top >= threshold**2 * (top + others * self.other**2)
                for i in np.flatnonzero(possible & (others < b - a)):
                    score, k = self.closest(block.hashes[a[i] : b[i]].tolist())
                    d = base + int(document[a[i]])
                    if score >= threshold and score > scores[d]:
                        names[d], scores[d] = self.names[k], score
        return names, scores


def own_licenses(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own, score): the licence that each file's own text states, null without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates)
        for batch in batches:
            names, scores = matcher.match(batch.column(2), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "path", "own", "score"])

    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, path string, own string, score double")


def directory_of(path: Column) -> Column:
    """Everything before the last slash; "" for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_license_file(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*)$", 1)).rlike(r"^(licen[cs]e|copying|notice|unlicense)([.\-_].*)?$")


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per file: doc_id, path, license, score, basis (own, inherited or none), inherited_from.

    files: doc_id, path, text; other columns are not read. A null or empty text
    states nothing; of equally close templates the first counts; a null path has no directory and inherits nothing. Of several
    licence files in a directory the closest match counts (to nine digits), then
    the smallest path. Repeated rows each get a row. Whole texts are compared; each distinct
    directory, not each file, looks for its ancestors.
    """
    own = common.materialize(own_licenses(files, templates, threshold).withColumn("directory", directory_of(F.col("path"))), "own-licenses")
    best = F.min(F.struct((-F.round("score", 9)).alias("rank"), "path", "own", "score"))
    stated = own.filter(F.col("own").isNotNull() & is_license_file(F.col("path"))).groupBy("directory").agg(best.alias("best"))
    stated = common.materialize(stated.select(F.col("directory").alias("ancestor"), F.col("best.path").alias("inherited_from"), F.col("best.own").alias("theirs"), F.col("best.score").alias("their_score")), "licensed-directories")
    directories = own.filter(F.col("directory").isNotNull()).select("directory").distinct()
    parts = F.split("directory", "/")
    depths = F.explode(F.sequence(F.lit(0), F.when(F.col("directory") == "", F.lit(0)).otherwise(F.size(parts)))).alias("depth")
    above = directories.select("directory", depths).withColumn("ancestor", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    found = above.join(common.maybe_broadcast(stated), "ancestor")
    nearest = found.groupBy("directory").agg(F.max_by(F.struct("inherited_from", "theirs", "their_score"), "depth").alias("n")).select("directory", "n.*")
    nearest = common.materialize(nearest, "nearest")
    out = own.join(common.maybe_broadcast(nearest), "directory", "left")
    states = F.col("own").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("own", "theirs").alias("license"),
        F.when(states, F.col("score")).otherwise(F.coalesce("their_score", F.lit(0.0))).alias("score"),
        F.when(states, F.lit("own")).when(F.col("theirs").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("basis"),
        F.when(~states, F.col("inherited_from")).alias("inherited_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text) of a documents table, which has no paths.

    A path is source / language / fifties of ids / name; the first document of
    each fifty is its folder's licence file, and every 500th its source's.
    """
    fifty = F.col("doc_id") - F.pmod("doc_id", F.lit(50))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    folder = F.concat_ws("/", "source", "lang", fifty.cast("string"))
    path = F.when(F.pmod("doc_id", F.lit(500)) == 0, F.concat_ws("/", "source", F.concat(F.lit("LICENSE-"), name))).when(F.pmod("doc_id", F.lit(50)) == 0, F.concat_ws("/", folder, F.lit("LICENSE"))).otherwise(F.concat_ws("/", folder, name))
    return docs.select("doc_id", path.alias("path"), "text")
