"""License scans: Dice coefficient over word bigrams between normalised text and licence templates.

DataFrame functions only. The lines of a text, its sentences and the whole text are units; each is lower-cased and
reduced to words of letters and digits. A unit of m distinct bigrams can reach a Dice coefficient of t with a template
of n only if t / (2 - t) <= m / n <= (2 - t) / t, so units outside of all templates' bounds are left out before their
bigrams are formed, and templates outside of a unit's bounds before they are compared. The templates are a fixed table
of some thousand bigrams, which is broadcast.

A notice that is wrapped over lines, or stands inside a longer sentence or document, is found by windows: runs of as many
words as a template has, which begin at a bigram of it. A window reaches a coefficient of t only if it has t / (2 - t) of the
template's bigrams, so a text without any word of SCREEN can't have one (`screen` makes sure), nor a stretch of a text with
fewer of the bigrams. Long texts are compared in stretches of BLOCK words, each long enough for the windows that begin in it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a text compared with the templates at once.
BLOCK = 512
_STOP = set("a all and any are as at be but by for from have if in is it no not of on or so that the their these this to under was with you".split())

# Notices by which works are put under common licences, and the texts of short licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


def template_rows() -> list[tuple[str, int, str, str, int]]:
    """(license, template, bigram's two words, number of the template's bigrams)."""
    out = []
    for license, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            words = re.findall("[a-z0-9]+", text.lower())
            pairs = sorted(set(zip(words, words[1:])))
            out += [(license, k, a, b, len(pairs)) for a, b in pairs]
    return out


def screen(threshold: float) -> list[str]:
    """Words of which every text has one that has a window at the threshold: without them, too few bigrams of any template are left."""
    chosen: set[str] = set()
    for texts in TEMPLATES.values():
        for text in texts:
            words = re.findall("[a-z0-9]+", text.lower())
            pairs = set(zip(words, words[1:]))
            # rather words chosen already and those in many bigrams; common ones only if there is no other way
            for word in sorted(set(words), key=lambda w: (w not in chosen, w in _STOP, -sum(w in p for p in pairs), -len(w), w)):
                if sum(not chosen & set(p) for p in pairs) < _least(len(pairs), threshold):
                    break
                chosen.add(word)
    return sorted(chosen)


def _least(n: int, threshold: float) -> int:
    """Bigrams that a window shares at least with a template of n."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _windows(documents: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, license, dice, n_units): the greatest coefficient of a window, and how many windows of different bigrams have it."""
    by_template: dict[tuple[str, int], set] = {}
    for license, k, a, b, _ in template_rows():
        by_template.setdefault((license, k), set()).add((a, b))
    rows = [(license, len(re.findall("[a-z0-9]+", TEMPLATES[license][k].lower())) - 1, len(p), _least(len(p), threshold), [list(x) for x in sorted(p)]) for (license, k), p in by_template.items()]
    templates = documents.sparkSession.createDataFrame(rows, "license string, size int, n int, least int, words array<array<string>>")
    templates = templates.select("license", "size", "n", "least", F.transform("words", lambda p: F.xxhash64(p[0], p[1])).alias("own"))
    longest = max(r[1] for r in rows)
    some = documents.where("doc_id is not null").where(F.lower(F.col("text").cast("string")).rlike("(?<![a-z0-9])(?:" + "|".join(screen(threshold)) + ")(?![a-z0-9])"))
    # arrays go through explode, else Spark would work them out anew for each element
    df = some.select(F.col("doc_id").cast("long"), F.explode(F.array(_words(F.col("text").cast("string")))).alias("w"))
    df = df.select("doc_id", F.explode(F.array(F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, i: F.xxhash64(a, F.get("w", i + 1))))).alias("pairs"))
    df = df.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("pairs"), F.lit(BLOCK)), lambda b: F.slice("pairs", b + 1, BLOCK + longest))).alias("pairs"))
    near = df.join(F.broadcast(templates), F.size(F.array_intersect("pairs", "own")) >= F.col("least"))
    hits = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.array_contains("own", F.get("pairs", i)))
    near = near.select("*", F.explode(F.array(hits)).alias("hits"))
    # a window that begins at one hit has room for enough others
    near = near.select("doc_id", "license", "size", "n", "own", "pairs", F.explode(F.arrays_zip(F.col("hits").alias("a"), F.expr("slice(hits, least, size(hits))").alias("z"))).alias("hit"))
    near = near.where((F.col("hit.a") < BLOCK) & (F.col("hit.z") - F.col("hit.a") < F.col("size")))
    near = near.select("doc_id", "license", "n", "own", F.explode(F.array(F.array_distinct(F.slice("pairs", F.col("hit.a") + 1, F.col("size"))))).alias("pairs"))
    near = near.select("doc_id", "license", F.xxhash64(F.array_sort("pairs")).alias("unit"), (F.lit(2.0) * F.size(F.array_intersect("pairs", "own")) / (F.size("pairs") + F.col("n"))).alias("dice"))
    same = near.where(F.col("dice") >= threshold).groupBy("doc_id", "license", "dice").agg(F.countDistinct("unit").alias("n_units"))
    return same.groupBy("doc_id", "license").agg(F.max(F.struct("dice", "n_units")).alias("best")).select("doc_id", "license", "best.*")


def license_matches(documents: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row per document and licence found: doc_id, license, dice (of the best unit, 6 decimals), n_units.

    n_units counts the document's distinct units that reach the threshold with any of the licence's templates. Where no
    unit does, the best windows take their place: dice is theirs, and n_units counts those of that dice. Null,
    empty and one-word texts match nothing. doc_id is the key: repeated rows of a document count once. Rows with a null
    doc_id are left out. Other columns are ignored.
    """
    spark = documents.sparkSession
    rows = template_rows()
    sizes = {row[-1] for row in rows}
    least, most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    templates = spark.createDataFrame(rows, "license string, template int, a string, b string, n int").select("license", "template", "n", F.xxhash64("a", "b").alias("pair"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, "([.!?]) +", "$1\u0001"), "\u0001")))
    units = F.array_distinct(F.concat(F.array(text), lines, sentences))
    # explode_outer, `when` and coalesce instead of filters, also implied ones: Spark would push those below the arrays and
    # work them out anew for each element
    df = documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.explode_outer(units).alias("unit")).select("doc_id", _words(F.col("unit")).alias("w"))
    pairs = F.array_distinct(F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, i: F.xxhash64(a, F.get("w", i + 1))))
    df = df.select("doc_id", F.xxhash64("w").alias("unit"), pairs.alias("pairs")).select("doc_id", "unit", "pairs", F.coalesce(F.size("pairs"), F.lit(0)).alias("m"))
    near = F.when((F.col("m") >= least) & (F.col("m") <= most), F.col("pairs"))
    hits = df.select("doc_id", "unit", "m", F.explode_outer(near).alias("pair")).join(F.broadcast(templates), "pair").distinct()
    hits = hits.where((F.col("m") >= F.col("n") * (threshold / (2 - threshold))) & (F.col("m") <= F.col("n") * ((2 - threshold) / threshold)))
    dice = hits.groupBy("doc_id", "unit", "m", "license", "template", "n").agg(F.count("*").alias("both")).withColumn("dice", F.lit(2.0) * F.col("both") / (F.col("m") + F.col("n")))
    found = dice.where(F.col("dice") >= threshold)
    found = found.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.countDistinct("unit").alias("n_units"))
    both = found.withColumn("kind", F.lit(1)).unionByName(_windows(documents, threshold).withColumn("kind", F.lit(0)))
    best = both.groupBy("doc_id", "license").agg(F.max(F.struct("kind", "dice", "n_units")).alias("best"))
    return best.select("doc_id", "license", F.round("best.dice", 6).alias("dice"), "best.n_units")
