"""Operator 2: licence scans with a positional index of rare tokens.

One pass over the texts keeps the places of licence words, of the base phrases and of the templates' key phrases; a phrase is
looked for only around its least common word. The inverse document frequencies of licence words are counted over all
documents. For each template a document looks up the postings of the RARE rarest words of that template that it holds, and of these alone: a posting says at which place of the
template a word stands, so place in the text less place in the template is where a copy would begin. Where the beginnings of two rare words meet there is a candidate; most
documents have none and go no further. A candidate is verified: all key phrases of the template must stand there, and the template's words that do must hold LEAST of its weight, the sum of
its words' frequencies.

Words put in or left out move what follows. Beginnings therefore meet if they lie within an eighth of the template's length: they are dealt to bins of twice that width, twice, half
a bin apart, so beginnings that near share a bin. Templates of fewer than eight words are met word for word.

DataFrame operations alone. Only places of licence words are written and shuffled, by row, so neither a hot source nor a common
passage gathers in one task; the postings and frequencies have as many rows as the templates have words.

Defined results: null counts as empty, with no words, no places and score 0; every row is judged by itself, repeated ones too.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import staged, table

#: Base phrases with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label: (template, key phrases).
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license version 2"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "conditions are met"]),
    "cc-by-nc": ("licensed under cc by nc", ["cc by nc"]),
    "cc-by-sa": ("licensed under a creative commons attribution sharealike license", ["creative commons attribution sharealike"]),
    "copyright-notice": ("copyright all rights reserved", ["all rights reserved"]),
    "gnu-gpl": ("licensed under the gnu general public license", ["gnu general public license"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "hereby granted"]),
    "mit": ("released under the mit license", ["mit license"]),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
}
#: Whole texts of licences.
TEXTS = {
    "mit-whole": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
 files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
 distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
 following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
 THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
 MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
 CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
 THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-whole": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
 conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
 and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to
 endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
 AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
 FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
 EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
 BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
 ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-whole": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
 that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
 WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
 DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
 NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
 arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
 it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
 wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
 altered from any source distribution.""",
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
 obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under
 the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
 governing permissions and limitations under the License.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
 Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
 but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
 details. You should have received a copy of the GNU General Public License along with this program.""",
}
#: The whole texts' key phrases.
PHRASES = {
    "mit-whole": ["obtaining a copy of this software and associated documentation files", "provided as is without warranty of any kind"],
    "bsd-whole": ["redistributions of source code must retain", "even if advised of the possibility of such damage"],
    "isc-whole": ["copy modify and or distribute this software", "tortious action"],
    "zlib": ["altered source versions must be plainly marked", "altered from any source distribution"],
    "apache-notice": ["licensed under the apache license version 2 0", "permissions and limitations under the license"],
    "gpl-notice": ["redistribute it and or modify it under the terms of the gnu general public license", "free software foundation"],
}
#: Too common to be looked up.
COMMON = set("a an and any are at be by for if in into is not of on or that the this to was with you 0 2 v".split())
#: A template's rarest words in a document that choose the candidates, how many of these must agree; the least share of its weight.
RARE, AGREEING, LEAST = 6, 2, 0.7
#: The part of a template's length by which beginnings may differ.
DRIFT = 8
TEMPLATES |= {k: (" ".join(re.findall("[a-z0-9]+", x.lower())), PHRASES[k]) for k, x in TEXTS.items()}
WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def record(**fields: Column) -> Column:
    return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])


def words_of(text: Column) -> Column:
    # Lower-casing other letters too leaves words and their ASCII letters as they are, but for the Kelvin sign.
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("κ")))
    return F.array_remove(F.split(low, WORDS), "")


def anchored(phrase: str) -> tuple[str, int]:
    """The phrase's longest uncommon word and its place."""
    own = phrase.split()
    at = max((i for i, w in enumerate(own) if w not in COMMON), key=lambda i: len(own[i]))
    return own[at], at


def phrase_starts(words: Column, hits: Column, phrase: str) -> Column:
    """Where the phrase begins, ascending."""
    word, at = anchored(phrase)
    own = phrase.split()
    starts = F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["i"] - at)
    full = F.array(*map(F.lit, own))
    return F.filter(starts, lambda s: F.when(s >= 0, F.slice(words, s + 1, len(own)) == full).otherwise(False))


def places(df: DataFrame, key: str, text: str, base: dict[str, str], templates: dict) -> DataFrame:
    """row, key, n_words, hits, base (label, start) and phrases (number, start) of each row."""
    phrases = [p for _, own in templates.values() for p in own]
    vocabulary = sorted({w for t, _ in templates.values() for w in t.split() if w not in COMMON} | {anchored(p)[0] for p in [*base, *phrases]})

    def found(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(vocabulary), record(w=w, i=i))), lambda h: h.isNotNull())

        def spots(h: Column) -> Column:
            def at(phrase: str, name: str) -> Column:
                return F.transform(phrase_starts(words, h, phrase), lambda s: record(what=F.lit(name), start=s))

            def of(pairs) -> Column:
                return F.flatten(F.array(*[at(p, x) for p, x in pairs]))

            return record(n_words=F.size(words), hits=h, base=of(base.items()), phrases=of((p, str(i)) for i, p in enumerate(phrases)))

        return let(hits, spots)

    return df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), let(words_of(F.col(text)), found).alias("x")).select("row", "key", "x.*")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, templates: dict = TEMPLATES, rare: int = RARE, least: float = LEAST) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = df.sparkSession
    rows = staged(places(df, key, text, base, templates), "licence-words")  # row numbers are fixed from here on
    n = rows.count()
    seen = {r.w: r.n for r in rows.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each licence word
    weight = lambda w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1
    postings, needed, phrase_rows, own_words, i = [], [], [], [], 0
    for label, (template, own) in templates.items():
        spots = [(w, at) for at, w in enumerate(template.split()) if w not in COMMON]
        total = sum(weight(w) for w, _ in spots)
        postings += [(w, label, at, weight(w) / total) for w, at in spots]
        distinct = sorted({w for w, _ in spots}, key=lambda w: (-weight(w), w))
        own_words.append((label, min(AGREEING, len(distinct)), distinct))
        drift = len(template.split()) // DRIFT
        needed.append((label, min(AGREEING, len(distinct)), len(own), max(1, 2 * drift), drift))
        for p in own:
            at = next(k for k in range(len(template.split())) if template.split()[k : k + len(p.split())] == p.split())
            phrase_rows.append((str(i), label, at))
            i += 1
    index = F.broadcast(spark.createDataFrame(postings, "w string, label string, at int, share double"))  # a row for each template word
    where = F.broadcast(spark.createDataFrame(phrase_rows, "what string, label string, at int"))
    bins = F.broadcast(spark.createDataFrame(needed, "label string, need_rare int, need_phrases int, width int, drift int"))

    def binned(at: DataFrame) -> DataFrame:
        """With the bins of each beginning: half (0 or 1) and bin."""
        halves = F.when(F.col("drift") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return at.withColumn("half", F.explode(halves)).withColumn("bin", F.floor((F.col("begin") + F.col("half") * F.col("drift")) / F.col("width")))

    # The rarest words of each template that a document holds, where there are enough to agree.
    present = F.array_distinct("hits.w")
    rarest = F.filter(F.array(*(F.struct(F.lit(x).alias("label"), F.slice(F.filter(F.array(*map(F.lit, words)), lambda w: F.array_contains(F.col("present"), w)), 1, rare).alias("rare"), F.lit(k).alias("k")) for x, k, words in own_words)), lambda r: F.size(r["rare"]) >= r["k"])
    asked = rows.where(F.size("hits") > 0).select("row", "hits", present.alias("present")).select("row", "hits", F.inline(rarest))
    looked_up = asked.select("row", "label", F.explode(F.filter("hits", lambda h: F.array_contains("rare", h["w"]))).alias("h")).select("row", "label", "h.w", "h.i")
    met = binned(looked_up.join(index.drop("share"), ["w", "label"]).withColumn("begin", F.col("i") - F.col("at")).join(bins, "label"))
    agreed = met.groupBy("row", "label", "half", "bin").agg(F.size(F.collect_set("w")).alias("n_rare"), F.first("need_rare").alias("need_rare")).where("n_rare >= need_rare")  # as many words as are looked up
    found = staged(agreed.select("row", "label", "half", "bin"), "licence-candidates")
    held = found.select("row", "label").distinct().join(rows.select("row", "hits", "phrases"), "row")
    words = held.select("row", "label", F.explode("hits").alias("h")).select("row", "label", "h.w", "h.i").join(index, ["w", "label"]).select("row", "label", (F.col("i") - F.col("at")).alias("begin"), "at", "share", F.lit(None).cast("string").alias("what"))
    phrases = held.select("row", "label", F.inline("phrases")).join(where, ["what", "label"]).select("row", "label", (F.col("start") - F.col("at")).alias("begin"), F.lit(-1).alias("at"), F.lit(0.0).alias("share"), "what")
    each = binned(words.unionByName(phrases).join(bins, "label")).join(found, ["row", "label", "half", "bin"], "left_semi")
    each = each.groupBy("row", "label", "half", "bin", "at", "what").agg(F.first("share").alias("share"), F.first("need_phrases").alias("need_phrases"))
    sums = each.groupBy("row", "label", "half", "bin").agg(F.sum("share").alias("share"), F.count("what").alias("n_phrases"), F.first("need_phrases").alias("need_phrases"))
    good = sums.where((F.col("n_phrases") >= F.col("need_phrases")) & (F.col("share") >= least))
    own = good.groupBy(F.col("row").alias("of")).agg(F.collect_set("label").alias("own"), F.max(F.least("share", F.lit(1.0))).alias("share"))  # labels are as few as templates
    base_labels = F.sort_array(F.array_distinct("base.what"))
    none = F.array().cast("array<string>")
    return rows.join(own, F.col("row") == F.col("of"), "left").select(
        F.col("key").alias(key),
        F.col("n_words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"),
        F.array_max("base.start").cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, F.coalesce("own", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
