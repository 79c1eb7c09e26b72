"""License scans by MinHash bands over overlapping windows, with Spark expressions only.

Words are runs of digits, a-z (A-Z lower-cased) and characters from U+0080; a shingle is five words. A text's shingle hashes
are cut into blocks of BLOCK; a window is two neighbouring blocks, so windows overlap by half. A window's signature has BANDS
bands of one row: the least hash under each of BANDS orders (the hashes xor a constant each). Templates of LONG shingles and
more give a window at each of their positions. A whole copy has a window that equals one of these; with a fifth of the
shingles changed some window still has a resemblance of 0.6 or more to one, and it shares a band with probability
1 - 0.4 ** BANDS = 0.9993. Shorter templates, which can't fill a window, give windows of one shingle, where sharing one is
certain to be seen.

What shares a band is a candidate, and the exact share of the template's shingles that stand in the text decides: CONTAINED
or more is a match.

Bands of the templates stand in the plan as a set, BOUND of them at most; a larger library is taken in parts below the
bound. Texts aren't shuffled: the shingles of a text with candidates travel with it to the next table, and are joined there
with the few rows that name the candidates.

Null text: no words. Null doc_id, repeated rows: each is a row of the result. Texts of under five words: no match. Very long
texts are scanned whole. An empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, text_of

WIDTH, BLOCK, BANDS, CONTAINED = 5, 8, 8, 0.8
#: Shingles of a template from which it fills a window wherever it stands.
LONG = 3 * BLOCK
BOUND = 40_000
# fixed values: notices by which licenses are declared
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}


def library() -> list[tuple[str, str]]:
    return [(name, text) for name, texts in TEMPLATES.items() for text in texts]


#: The orders' constants: odd multiples of a fixed irrational fraction of 2 ** 64.
_ORDERS = [((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63) for k in range(BANDS)]


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), r"[^0-9a-z\x{80}-\x{10FFFF}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of all shingles in order."""
    return F.when(F.size(w) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)]))).otherwise(F.array().cast("array<long>"))


def _under(c: int):
    return lambda x: x.bitwiseXOR(F.lit(c))


def _bands(own: Column) -> list[Column]:
    """Least hash under each order, as a key that differs by order."""
    return [F.xxhash64(F.lit(k), F.array_min(F.transform(own, _under(c)))) for k, c in enumerate(_ORDERS)]


def template_keys(spark: SparkSession, templates: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """(number of the template, key of one of its windows)."""
    t = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(templates)], "t int, text string").select("t", shingles(words(F.col("text"))).alias("h"))
    n = 2 * BLOCK
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.array(*_bands(F.slice("h", i + 1, n))))
    keys = F.when(F.size("h") >= LONG, F.flatten(windows)).otherwise(F.transform("h", lambda x: F.xxhash64(F.lit(-1), x)))
    return [(r[0], r[1]) for r in t.filter(F.size("h") > 0).select("t", F.explode(F.array_distinct(keys))).collect()]


def with_keys(own: DataFrame) -> DataFrame:
    """Adds keys: of all windows of a text, of one shingle, then of two blocks (or of the last alone) for each order."""
    h = F.col("h")

    def least(c: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(h) / BLOCK).cast("int") - 1, F.lit(0))), lambda i: F.array_min(F.transform(F.slice(h, i * BLOCK + 1, BLOCK), _under(c))))

    def pairs(k: int, m: Column) -> Column:
        return F.transform(m, lambda x, i: F.xxhash64(F.lit(k), F.least(x, F.get(m, i + 1))))

    own = own.withColumns({f"_m{k}": least(c) for k, c in enumerate(_ORDERS)})
    keys = F.concat(F.transform(h, lambda x: F.xxhash64(F.lit(-1), x)), *[pairs(k, F.col(f"_m{k}")) for k in range(BANDS)])
    return own.withColumn("keys", keys).drop(*[f"_m{k}" for k in range(BANDS)])


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words long, licenses array<string>, sorted: names of the templates that are contained."""
    spark, templates = docs.sparkSession, library() if templates is None else templates
    keys = template_keys(spark, templates)
    n_parts = max(1, -(-len(keys) // BOUND))
    own = with_keys(docs.select("doc_id", words(text_of("text")).alias("w")).select("doc_id", "w", shingles(F.col("w")).alias("h")))
    parts = [sorted({k for t, k in keys if t % n_parts == p}) for p in range(n_parts)]
    # one parsed set for each part: a literal at a time would be a call to the JVM each
    own = own.withColumn("keys", F.array_distinct(F.concat(*[F.expr(f"filter(keys, x -> x IN ({', '.join(f'{k}L' for k in part)}))") for part in parts if part])) if keys else F.array().cast("array<long>"))
    # the shingles stay with texts that have candidates, the others are done
    own = materialize(own.select("doc_id", F.size("w").cast("long").alias("n_words"), "keys", F.when(F.size("keys") > 0, F.col("h")).alias("h")).withColumn("row", F.monotonically_increasing_id()), "license-candidates")
    of_key = spark.createDataFrame(keys, "t int, key long")
    texts = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, name string, text string").select("t", "name", F.array_distinct(shingles(words(F.col("text")))).alias("ht"))
    # a row's candidates first, without its shingles; these are read again for the rows that have some, and are not dealt out by template
    pairs = own.select("row", F.explode("keys").alias("key")).join(of_key, "key").groupBy("row").agg(F.collect_set("t").alias("ts"))
    candidates = own.filter(F.size("keys") > 0).select("row", "h").join(materialize(pairs, "license-pairs"), "row")
    tried = candidates.select("row", "h", F.explode("ts").alias("t")).join(texts, "t").filter(F.size(F.array_intersect("ht", "h")) >= CONTAINED * F.size("ht"))
    match = tried.select("row", "name").groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("licenses"))
    return own.select("row", "doc_id", "n_words").join(materialize(match, "license-matches"), "row", "left").select("doc_id", "n_words", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    rule = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')"
    values = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(library()))
    gram = "list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' '))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {rule.format("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT t, name, {rule.format("text")} AS w FROM (VALUES {values}) v(t, name, text)),
tg AS (SELECT DISTINCT t, name, unnest({gram}) AS g FROM t),
tn AS (SELECT t, count(*) AS n FROM tg GROUP BY t),
dg AS (SELECT DISTINCT r, g FROM (SELECT r, unnest({gram}) AS g FROM d WHERE len(w) > 4) WHERE g IN (SELECT g FROM tg)),
hit AS (SELECT r, t, name, count(*) AS k FROM dg JOIN tg USING (g) GROUP BY r, t, name),
m AS (SELECT r, count(DISTINCT name) AS n_licenses, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM hit JOIN tn USING (t) WHERE k >= {CONTAINED} * n GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses FROM d LEFT JOIN m USING (r)
"""


SQL = _sql()
