"""License scans: normalised text against license templates by Dice coefficient over word bigrams.

A document's segments are its lines, its paragraphs, its whole text, and all windows of as many words as a template has.
Lines, paragraphs and the whole text are compared with every template whose size allows the threshold: with n and m
distinct bigrams, Dice is at most 2 min(n, m) / (n + m), so for a threshold t only templates with n between m t / (2 - t)
and m (2 - t) / t can reach it. Others are pruned.

Windows run over the words of the whole text, so line ends, comment signs and what stands around a grant do not matter. One
that reaches t shares at least c = m t / (2 - t) of the template's m bigrams. So only those are compared that hold c places
of such bigrams: where the c-th next place is less than a window away.

Before that, texts are passed over in which no template can reach the threshold. ``trigger_words`` chooses words such that,
for each template, fewer than c of its bigrams are free of them; so a segment without a trigger word matches
no template, and the filter loses nothing.

Everything is one projection of built-in expressions: no shuffle, no Python, no state between rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Usual wordings of license notices and grants.
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-full": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}

#: What is not a word character; what separates paragraphs.
NOT_WORD, PARAGRAPH = r"[^\p{L}\p{N}]+", r"\n[ \t]*\n"


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, which is plain ASCII."""
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def least_common(size: int, threshold: float) -> int:
    """How many of a template's ``size`` bigrams a segment that reaches the threshold has at least."""
    return next(c for c in range(size + 1) if 2 * c / (c + size) >= threshold)


#: Words too frequent to tell a license from other text; chosen as triggers only where a template has no others.
FREQUENT = frozenset("a an and are as at be by can for from in is it may not of on or that the this to under use was which with you".split())


def trigger_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words without one of which no segment can reach the threshold for any template.

    Greedy: of the words in free bigrams of unfinished templates, the one in most of them; rare words come before
    frequent ones, longer before shorter, then by the alphabet. A template is finished when its bigrams
    without a chosen word are too few to match.
    """
    bigrams = {name: [set(b.split()) for b in template_bigrams(text)] for name, text in templates.items()}
    chosen: list[str] = []
    while True:
        counts: dict[str, int] = {}
        for pairs in bigrams.values():
            free = [p for p in pairs if p.isdisjoint(chosen)]
            if free and len(free) >= len(pairs) * threshold / (2 - threshold):
                for word in {w for p in free for w in p}:
                    counts[word] = counts.get(word, 0) + sum(word in p for p in free)
        if not counts:
            return sorted(chosen)
        chosen.append(min(counts, key=lambda w: (w in FREQUENT or len(w) < 3 and not w.isalpha(), -counts[w], -len(w), w)))


def normalise(text: Column) -> Column:
    """Lower-case words with one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def bigrams(normal: Column) -> Column:
    """The word bigrams of a normalised segment, in order, repeated ones too; none if it has fewer than two words."""

    def pairs(words: Column) -> Column:
        return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    return _let(F.split(normal, " "), lambda words: F.when(F.size(words) > 1, pairs(words)).otherwise(F.array().cast("array<string>")))


def _dice(found: Column, template: Column) -> Column:
    """Of distinct bigrams and a template."""
    return 2.0 * F.size(F.array_intersect(found, template["bigrams"])) / (F.size(found) + F.size(template["bigrams"]))


def window_dice(grams: Column, template: Column) -> Column:
    """The best Dice coefficient of a window of the template's length that can reach the threshold; null if none can."""
    need, span = template["need"], template["span"]
    places = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(template["bigrams"], g), i)), lambda i: i.isNotNull())

    def of_starts(at: Column) -> Column:
        def starts(k: Column) -> Column:
            first, last = F.greatest(F.lit(0), F.get(at, k + need - 1) - span + 1), F.least(F.get(at, k), F.size(grams) - span)
            return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

        groups = F.when(F.size(at) >= need, F.transform(F.sequence(F.lit(0), F.size(at) - need), starts)).otherwise(F.array().cast("array<array<int>>"))
        windows = F.array_distinct(F.flatten(groups))
        return F.array_max(F.transform(windows, lambda s: _dice(F.array_distinct(F.slice(grams, s + 1, span)), template)))

    return _let(places, of_starts)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of ``df``: id, n_licenses, license (the best match), dice, licenses (all, by name).

    Equal scores are decided by template name. Null and empty texts match nothing (license and dice null).
    """
    templates = TEMPLATES if templates is None else templates
    reach = (2 - threshold) / threshold
    table = [
        {"name": name, "bigrams": (found := template_bigrams(text)), "low": len(found) / reach, "high": len(found) * reach, "need": least_common(len(found), threshold), "span": len(template_words(text)) - 1}
        for name, text in templates.items()
    ]
    known = F.from_json(F.lit(json.dumps(table)), "array<struct<name string, bigrams array<string>, low double, high double, need int, span int>>")
    every = F.from_json(F.lit(json.dumps(sorted({b for t in table for b in t["bigrams"]}))), "array<string>")
    low, high = min(t["low"] for t in table), max(t["high"] for t in table)
    text = F.col(text_col)
    triggers = "|".join(trigger_words(templates, threshold))
    hit = text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{triggers})(?![\p{{L}}\p{{N}}])")
    none = F.array().cast("array<struct<name:string,dice:double>>")

    segments = F.concat(F.split(text, "\n"), F.split(text, PARAGRAPH), F.array(text))
    normal = F.array_distinct(F.transform(segments, normalise))
    normal = F.filter(normal, lambda s: s.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{triggers})(?![\p{{L}}\p{{N}}])"))
    sets = F.filter(F.transform(normal, lambda x: F.array_distinct(bigrams(x))), lambda b: F.size(b).between(low, high))

    def scores(b: Column) -> Column:
        fits = F.filter(known, lambda t: F.size(b).between(t["low"], t["high"]))
        return F.transform(fits, lambda t: F.struct(t["name"].alias("name"), _dice(b, t).alias("dice")))

    def windows(grams: Column) -> Column:
        common = F.array_intersect(grams, every)
        fits = _let(common, lambda c: F.filter(known, lambda t: F.size(F.array_intersect(c, t["bigrams"])) >= t["need"]))
        return F.transform(fits, lambda t: F.struct(t["name"].alias("name"), window_dice(grams, t).alias("dice")))

    found = F.concat(F.flatten(F.transform(sets, scores)), _let(bigrams(normalise(text)), windows))
    matches = F.filter(found, lambda m: m["dice"] >= threshold)
    out = df.select(F.col(id_col).alias(id_col), F.when(hit, matches).otherwise(none).alias("__matches"))
    names = F.array_sort(F.array_distinct(F.transform("__matches", lambda m: m["name"])))
    best = F.array_min(F.transform("__matches", lambda m: F.struct((-m["dice"]).alias("order"), m["name"].alias("name"))))
    return out.select(
        id_col, F.size(names).cast("long").alias("n_licenses"), best["name"].alias("license"), F.round(-best["order"], 6).alias("dice"), F.array_join(names, ",").alias("licenses")
    )


def oracle_sql() -> str:
    """The same scan of ``documents`` in DuckDB, without trigger words and with bounds on segments' and windows' bigrams only."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())
    grams = "list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    words = r"string_split(trim(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    return rf"""
WITH templates AS (SELECT name, {words.format(t="t")} AS w FROM (VALUES {values}) v(name, t)),
known AS (
  SELECT name, g, len(w) - 1 AS span, (SELECT min(c) FROM range(1, 1000) r(c) WHERE 2.0::DOUBLE * c / (c + len(g)) >= {THRESHOLD}) AS need
  FROM (SELECT name, w, list_distinct({grams.format(w="w")}) AS g FROM templates)
),
segments AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents
    UNION ALL SELECT doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) FROM documents
    UNION ALL SELECT doc_id, text FROM documents
)),
worded AS (SELECT doc_id, {words.format(t="s")} AS w FROM segments),
sets AS (SELECT doc_id, list_distinct({grams.format(w="w")}) AS g FROM worded WHERE len(w) > 1),
whole AS (SELECT doc_id, {grams.format(w="w")} AS g FROM (SELECT doc_id, {words.format(t="text")} AS w FROM documents)),
grams AS (SELECT doc_id, unnest(g) AS gram, unnest(range(len(g))) AS i FROM whole),
places AS (
  SELECT doc_id, name, span, need, i, row_number() OVER (PARTITION BY doc_id, name ORDER BY i) AS r
  FROM grams JOIN (SELECT name, span, need, unnest(g) AS gram FROM known) USING (gram)
),
starts AS (
  SELECT DISTINCT a.doc_id, a.name, unnest(range(greatest(0, b.i - a.span + 1), least(a.i, len(w.g) - a.span) + 1)) AS s
  FROM places a JOIN places b ON a.doc_id = b.doc_id AND a.name = b.name AND b.r = a.r + a.need - 1 JOIN whole w ON w.doc_id = a.doc_id
),
windows AS (SELECT doc_id, name, list_distinct(w.g[s + 1 : s + k.span]) AS g, k.g AS t FROM starts JOIN known k USING (name) JOIN whole w USING (doc_id)),
compared AS (
  SELECT doc_id, name, g, t FROM windows
  UNION ALL SELECT doc_id, name, s.g, k.g FROM sets s JOIN known k ON len(s.g) >= k.need AND {THRESHOLD} * (len(s.g) + len(k.g)) <= 2 * len(k.g) + 1e-9
),
scored AS (SELECT doc_id, name, max(2.0::DOUBLE * len(list_intersect(g, t)) / (len(g) + len(t))) AS dice FROM compared GROUP BY doc_id, name),
found AS (SELECT * FROM scored WHERE dice >= {THRESHOLD}),
best AS (
  SELECT doc_id, count(*) AS n, arg_min(name, struct_pack(o := -dice, n := name)) AS license, max(dice) AS dice, string_agg(name, ',' ORDER BY name) AS licenses
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(b.n, 0)::BIGINT AS n_licenses, b.license, round(b.dice, 6) AS dice, coalesce(b.licenses, '') AS licenses
FROM documents d LEFT JOIN best b USING (doc_id)
"""
