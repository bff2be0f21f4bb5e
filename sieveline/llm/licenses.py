"""License scans by diagonal voting: word k-grams joined to template positions, votes by offset, merged and verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import releasing, saved, ship, small, with_row_key
from sieveline.llm.textarrays import hash_of, hashes, rolled, slices, tokens

#: Words of a k-gram; diagonals this near are one span; share of a template's k-grams, and its longest stretch, that make a span a candidate; word
#: edits per word of the template that a verified span may have.
GRAM, NEAR, COVERED, STRETCH, EDITS = 3, 4, 0.5, 1.6, 0.12
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public notices, as they stand in works under these licenses, and labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("bsd", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, np.uint8)
_WORD[48:58] = _WORD[97:123] = 1
_WORD[128:] = 1


def _gram_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their sizes, the row of each word, and hashes of the k-grams that start at each word but the last ones."""
    data = _LOWER[data]
    starts, ends, row = tokens(data, rows, _WORD)
    h = hashes(data, starts, ends)
    return h, ends - starts, row, rolled(h, GRAM)


def base_counts(data: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """n_words, n_base, first_word, last_word (-1: none) and a bit for each phrase found, by row."""
    n = len(rows) - 1
    h, size, row, _ = _gram_hashes(data, rows)
    begin = np.searchsorted(row, np.arange(n))
    count, first, last, found = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
    places, which = [], []
    for bit, phrase in enumerate(PHRASES):
        words = [(np.uint64(hash_of(w.encode())), len(w)) for w in phrase.split()]  # at most eight bytes each, so hash and size tell them
        m = len(h) - len(words) + 1
        if m <= 0:
            continue
        hit = row[:m] == row[len(words) - 1 :]
        for i, (w, chars) in enumerate(words):
            hit &= (h[i : i + m] == w) & (size[i : i + m] == chars)
        at = np.flatnonzero(hit)
        places.append(at)
        which.append(np.full(len(at), bit))
    if places:
        at = np.concatenate(places)
        bits = np.concatenate(which)
        order = np.argsort(at, kind="stable")
        at, bits = at[order], bits[order]
        r = row[at]
        count += np.bincount(r, minlength=n)
        np.bitwise_or.at(found, r, 1 << bits)
        where = at - begin[r]
        last[r] = where
        first[r[::-1]] = where[::-1]
    return [np.bincount(row, minlength=n), count, first, last, found]


def scanned(docs: DataFrame, templates=None) -> DataFrame:
    """doc_id, th, n_words, n_base, first_word, last_word, found, grams: one pass over the texts for all that follows.

    grams has the rolling k-gram hashes of a text, each with the word it starts at, but for those that no template has: they would meet nothing in the join. The
    hashes of the templates given are all that a task needs for that.
    """
    known = np.unique(np.concatenate([_template_grams(text) for _, text in templates or TEMPLATES]))

    def each(batches):
        for batch in batches:
            for lo, hi, data, rows in slices(batch.column(2)):
                words, count, first, last, found = base_counts(data, rows)
                _, _, row, g = _gram_hashes(data, rows)
                at = np.searchsorted(known, g)
                at[at == len(known)] = 0
                hit = np.flatnonzero((known[at] == g) & (row[: len(g)] == row[GRAM - 1 :])) if len(g) else np.zeros(0, np.int64)
                begin = np.searchsorted(row, np.arange(hi - lo))
                ends = np.append(0, np.cumsum(np.bincount(row[hit], minlength=hi - lo))).astype(np.int32)
                grams = pa.StructArray.from_arrays([pa.array((hit - begin[row[hit]]).astype(np.int32)), pa.array(g[hit].view(np.int64))], names=["pos", "gram"])
                none = first < 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(words), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(found), pa.ListArray.from_arrays(pa.array(ends), grams)], names=["doc_id", "th", "n_words", "n_base", "first_word", "last_word", "found", "grams"])

    return docs.mapInArrow(releasing(each), "doc_id long, th long, n_words long, n_base long, first_word long, last_word long, found long, grams array<struct<pos:int,gram:long>>")


def _template_grams(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _gram_hashes(data, np.array([0, len(data)]))[3]


def template_positions(spark: SparkSession, templates=None) -> DataFrame:
    """template, label, t_pos, gram, t_grams: one row per k-gram of a template. As large as the templates given."""
    out = []
    for i, (label, text) in enumerate(templates or TEMPLATES):
        g = _template_grams(text)
        out += [(i, label, p, int(x), len(g)) for p, x in enumerate(g.view(np.int64))]
    return spark.createDataFrame(out, "template int, label string, t_pos int, gram long, t_grams int")


def spans(docs: DataFrame, found: DataFrame, templates=None) -> DataFrame:
    """doc_id, th, label, first, last (words), score: verified template spans; found is the saved table of scanned().

    Rolling k-gram hashes meet the template positions in a join; matches are counted by document, template and diagonal
    (document position less template position); diagonals within NEAR of the one before form a span; a span is a candidate if it has at least
    COVERED of the template's k-grams and is not longer than STRETCH times the template, and counts if verified() word by word. Only matches are shuffled.
    """
    positions = F.broadcast(template_positions(docs.sparkSession, templates))
    places = found.select("doc_id", "th", F.inline("grams")).join(positions, "gram").drop("gram")
    votes = places.groupBy("doc_id", "th", "template", "label", "t_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("hits"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    own = Window.partitionBy("doc_id", "th", "template").orderBy("diagonal")
    votes = votes.withColumn("gap", F.col("diagonal") - F.lag("diagonal").over(own))
    run = F.sum(F.when(F.col("gap") <= NEAR, 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    merged = votes.withColumn("run", run).groupBy("doc_id", "th", "template", "t_grams", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    some = merged.where((F.col("n") >= COVERED * F.col("t_grams")) & (F.col("last") - F.col("first") + GRAM <= STRETCH * (F.col("t_grams") + GRAM)))
    return verified(docs, saved(some.groupBy("doc_id", "th").agg(F.collect_list(F.struct("template", "first", "last")).alias("some")), "candidates"), templates)


def word_edits(template: np.ndarray, words: np.ndarray) -> int:
    """The fewest words to insert, drop or change to make the template of some stretch of words."""
    j = np.arange(len(words) + 1)
    cost = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(template.tolist(), 1):
        fresh = np.append(i, np.minimum(cost[:-1] + (words != w), cost[1:] + 1))
        cost = np.minimum.accumulate(fresh - j) + j
    return int(cost.min())


def verified(docs: DataFrame, candidates: DataFrame, templates=None) -> DataFrame:
    """doc_id, th, label, first, last, score: the candidate spans (array some) whose words are the template's but for EDITS of them; score is the share kept.

    The words are compared where the texts are: candidates are joined to their documents, by broadcast while they are few.
    """
    known = [(label, _words_of(text)) for label, text in templates or TEMPLATES]

    def each(batches):
        for batch in batches:
            out = []
            for row, (text, some) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = _words_of(text)
                for c in {(c["template"], c["first"], c["last"]): c for c in some}.values():
                    label, own = known[c["template"]]
                    slack = int(EDITS * len(own))
                    edits = word_edits(own, words[max(0, c["first"] - len(own)) : c["last"] + GRAM + len(own)] if slack else words[max(0, c["first"]) : c["last"] + GRAM])
                    if edits <= slack:
                        out.append((row, label, c["first"], c["last"] + GRAM - 1, 1 - edits / len(own)))
            rows = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array([o[i] for o in out], kind) for i, kind in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64())))], names=["doc_id", "th", "label", "first", "last", "score"])

    keyed, keys = with_row_key(docs, F.col("th"))
    some, own = with_row_key(candidates, F.col("th"))
    some = some.select(*(F.col(k).alias(n) for k, n in zip(own, keys, strict=True)), "some")
    return keyed.join(small(some, 2_000_000), keys).select("doc_id", "th", "text", "some").mapInArrow(releasing(each), "doc_id long, th long, label string, first long, last long, score double")


def _words_of(text: str) -> np.ndarray:
    """Hashes of a text's words, in order."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return _gram_hashes(data, np.array([0, len(data)]))[0]


def scan(docs: DataFrame, templates=None) -> DataFrame:
    """Labels of every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels are those of PHRASES found as consecutive words; labels adds those of verified spans. score is the best span's, or
    0.5 for a base label without a span, or 0. Null texts are empty; repeated rows stay; documents without labels have ''.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    base = saved(scanned(docs, templates), "scanned")
    found = spans(docs, base, templates).groupBy("doc_id", "th").agg(F.collect_set("label").alias("own"), F.max("score").alias("best")).withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t")
    labels = F.filter(F.array(*(F.when(F.col("found").bitwiseAND(F.lit(1 << i)) != 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))), lambda x: x.isNotNull())
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").withColumn("base", F.array_sort(F.array_distinct(labels)))
    every = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
