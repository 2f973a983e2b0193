"""License scan, in DataFrame operations only: MinHash bands over text windows, verified by exact containment.

Templates (``TEMPLATES``: notices, headers and permission texts) fall into classes by their number of five-word shingles, each up to twice as large as the one
before; for a class of up to u shingles a text is read as windows of 2u shingles that start every u, so a
notice lies whole in some window.  A window that holds 80 % of a notice has a Jaccard similarity of 0.19 or more with
it; with ``BANDS`` bands of one minimum each, they meet in a band but for one case in 700,000.  Only windows with a
shingle of a template of their class are hashed, of texts that hold 80 % of the smallest of the class.  What meets is verified: the share of the notice's shingles that the whole text holds must be 0.8 or more.

A text is lower-cased, cut at white space (0x20, 0x09-0x0D), and its words lose punctuation at their ends.
More than a fifth of each template's shingles have one of a few marker words (found greedily); a text without any of them as a
substring lacks those and cannot hold 80 % of a template, so only the others are cut into words.

Edge cases: a null or empty text matches nothing; one of fewer than five words is one shingle, the whole sequence; a notice
found many times in a text gives one row; rows that repeat a doc_id share their rows of results (the largest share
counts); a null doc_id stays null.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS, K = 64, 5
ENDS = ".,;:!?()[]{}\"'"
# License notices, headers and texts as their publishers print them, (license id, text); one id may have many.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("LGPL-2.1", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License version 2.1"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def notice_words(text: str) -> list[str]:
    return [w for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if (w := x.strip(ENDS))]


def notice_shingles(text: str) -> list[str]:
    w = notice_words(text)
    return list(dict.fromkeys(" ".join(w[i : i + K]) for i in range(max(1, len(w) - K + 1)))) if w else []


def markers(notices: list[list[str]]) -> list[str]:
    """A few long words, found greedily, such that more than a fifth of each notice's shingles have one of them.

    A text that holds 80 % of a notice then holds a shingle with a marker.
    """
    left, out = [set(s) for s in notices], []
    while short := [s for s, n in zip(left, notices) if len(n) - len(s) <= len(n) // 5]:
        count = Counter(w for s in short for x in s for w in set(x.split(" ")))
        out.append(max(count, key=lambda w: (min(len(w), 8) ** 3 * count[w], w)))
        left = [{x for x in s if out[-1] not in x} for s in left]
    return out


def words(text: Column) -> Column:
    cut = F.transform(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: F.btrim(w, F.lit(ENDS)))
    return F.filter(cut, lambda w: w != "")


def once(value: Column) -> Column:
    """``value`` as a generated column: evaluated once a row, however often it is used and wherever filters move."""
    return F.explode(F.array(value))


def shingle_hashes(w: Column) -> Column:
    """In text order; an array without words gives none."""
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (K - 1))))
    return F.coalesce(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, K), " "))), F.array().cast("array<bigint>"))


def minima(hashes: Column) -> Column:
    low = lambda held: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.array_min(F.transform(held, lambda h: F.xxhash64(h, i))))
    return F.flatten(F.transform(F.array(hashes), low))  # ``hashes`` is evaluated once


def starts(sh: Column, u: int, wanted: list[int], least: int) -> Column:
    """Where the windows of class ``u`` start that hold one of the ``wanted`` hashes; none unless the text holds ``least`` of them."""
    at = F.filter(F.transform(sh, lambda h, i: F.when(h.isin(wanted), i)), lambda i: i.isNotNull())
    near = lambda a: F.array_distinct(F.flatten(F.transform(a, lambda i: F.array(i - i % u, F.greatest(i - i % u - u, F.lit(0))))))
    return F.flatten(F.transform(F.array(at), lambda a: F.when(F.size(a) >= least, near(a)).otherwise(F.array().cast("array<int>"))))


def licensed(spark: SparkSession, docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license_id, template, shared, notice_shingles, first_shingle) for every text and template with 80 % or more of the template in it.

    template: its place in the list; first_shingle: where the first window that met it starts.
    """
    rows = [(name, i, s, len(s), (1 << len(s).bit_length()) - 1) for i, (name, t) in enumerate(templates) if (s := notice_shingles(t))]
    known = spark.createDataFrame(rows, "license_id string, template int, texts array<string>, notice_shingles int, u int").select("license_id", "template", "notice_shingles", "u", F.transform("texts", lambda t: F.xxhash64(t)).alias("notice"))
    bands = known.select("license_id", "template", "notice_shingles", "u", "notice", F.posexplode(minima(F.col("notice"))).alias("band", "low"))
    classes: dict[int, tuple[set[int], int]] = {}
    for u, n, notice in known.select("u", "notice_shingles", "notice").collect():  # the templates' own, not the documents'
        held, least = classes.get(u, (set(), n))
        classes[u] = (held | set(notice), min(least, n))
    low = F.lower("text")
    able = None
    for m in markers([r[2] for r in rows]):
        able = F.contains(low, F.lit(m)) if able is None else able | F.contains(low, F.lit(m))
    sh = docs.where(able).select("doc_id", once(words(F.col("text"))).alias("w")).select("doc_id", once(shingle_hashes(F.col("w"))).alias("sh"))
    places = F.array(*[F.struct(F.lit(u).alias("u"), starts(F.col("sh"), u, sorted(held), -(-4 * least // 5)).alias("firsts")) for u, (held, least) in sorted(classes.items())])
    windows = sh.select("doc_id", "sh", F.explode(places).alias("p")).select("doc_id", "sh", "p.u", F.explode("p.firsts").alias("first"))
    met = windows.select("doc_id", "sh", "u", "first", F.posexplode(minima(F.expr("slice(sh, first + 1, 2 * u)"))).alias("band", "low"))
    met = met.join(F.broadcast(bands), ["u", "band", "low"])  # BANDS rows a notice
    met = met.withColumn("shared", F.size(F.array_intersect("notice", "sh"))).where("10 * shared >= 8 * notice_shingles")
    return met.groupBy("doc_id", "license_id", "template").agg(F.max("shared").cast("long").alias("shared"), F.first("notice_shingles").cast("long").alias("notice_shingles"), F.min("first").cast("long").alias("first_shingle"))
