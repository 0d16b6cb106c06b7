"""Licence texts by canonical digest: whole texts, paragraphs and lines against known licences."""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.session import materialize

# Published spellings that count as the same word, as (spelling, common spelling).
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("copyright-holder", "copyright holder"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("fulfil ", "fulfill "),
    ("wilful", "willful"),
    ("programme", "program"),
    ("https://", "http://"),
    ("&", " and "),
)

# Published licence texts and the notices by which works name their licence.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)

# Lines at which the terms begin after a heading, and behind which they end before advice on their use.
_BEGINS = re.compile(r"^[ \t]*(?:Preamble|0\. PREAMBLE|Statement of Purpose|1\. Definitions\.?|TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION|Redistribution and use in .*|This version of the GNU Lesser .*|Permission is hereby granted, .*)[ \t]*$", re.M)
_ENDS = re.compile(r"^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$|^(?=[ \t]*(?:ADDENDUM: How to use|E(?i:xhibit) A ?-))", re.M)
_TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"), "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License"), "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License"), "Unlicense": ("The Unlicense",)}

# Words that follow "copyright" in licence texts, where it begins no statement of a holder.
_NO_HOLDER = (
    "a act an and are as at by-laws claims? disclaimer disclaims? does doctrines? exceptions? for from holders? if in infringement interests? is it laws? licen[cs]es? licen[cs]ing licensors? may "
    "notices? of office on or owners? ownership permissions? policy protection registration resulting rights? statements? status terms that the this to treaty treaties under which"
).replace(" ", "|")
# a line that states a holder, in lower case; not every line that begins with the word
_COPYRIGHT = (
    r"(?m)^[ \t]*(?:copyright[ \t:,]*(?:\(c\)|©|[0-9]{4}|[<\[{])[^\n]*"
    rf"|copyright[ \t:]+(?:by[ \t]+)?(?!(?:{_NO_HOLDER})(?![a-z0-9]))[a-z\u00df-\u024f][^\n]*"
    r"|copyright[ \t:]+by[ \t][^\n]*|copyright[ \t:]+the[ \t](?=[^\n]*(?:authors|contributors|foundation|project|regents|university))[^\n]*"
    r"|\(c\)(?=[ \t]*copyright|[^\n]*(?<![0-9])(?:19|20)[0-9]{2}(?![0-9]))[^\n]*|©[^\n]*|all rights reserved[ \t.!]*)\r?$"
)
_MARKS = "[!-/:-@\\[-`{-~«»“”‘’–—©\t\u000b\f\r ]+"  # ASCII punctuation, quotes, dashes and blanks, not the line end


def canonical(text: str | Column) -> Column:
    """Lower case, no lines that state a copyright holder, one spelling, no punctuation, single blanks; line ends stay."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, "")
    for spelling, common in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(common))
    return F.regexp_replace(out, _MARKS, " ")


def joined(canon: str | Column) -> Column:
    """A canonical text on one line."""
    return F.trim(F.regexp_replace(canon, r"[ \n]+", " "))


def digests(known: DataFrame) -> DataFrame:
    """(digest, license) of a table of licence texts; of several licences with one text, the first in name."""
    return known.select(F.md5(joined(canonical("text")).cast("binary")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of the folder ``license_texts``, a file a licence, and of MIT and ISC: with each usual heading and without, with what follows the terms and without."""
    folder = files("cindermap.llm").joinpath("license_texts")
    texts = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]
    texts += [(name, text) for name, text in KNOWN if name in ("MIT", "ISC") and "\n\n" in text]
    out = set()
    for name, text in texts:
        begin, end = _BEGINS.search(text), _ENDS.search(text)
        for first in {0, begin.start() if begin else 0}:
            out |= {(name, text[first:last].strip()) for last in ({len(text), end.start(), end.end()} if end else {len(text)})}
        bare = text[begin.start() :] if begin else text
        out |= {(name, f"{title}\n\n{bare.strip()}") for title in _TITLES.get(name, ())}
    return sorted(out)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, text): the notices above and all whole texts."""
    return spark.createDataFrame(sorted({*KNOWN, *whole_texts()}), "license string, text string")


def paragraphs_of(canon: str | Column) -> Column:
    """The paragraphs of a canonical text, each on one line, without empty ones."""
    return F.filter(F.transform(F.split(canon, r"\n *(?:\n *)+"), lambda p: joined(p)), lambda p: p != "")


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences that documents are, or hold as consecutive paragraphs, a paragraph or a line of their own.

    Each document's canonical text, its paragraphs (parted by blank lines), its lines, and from each paragraph with which a known text of several
    paragraphs begins as many paragraphs as that text has, are digested
    whole and looked up among the digests of ``known`` (license, text); what matches only in
    part is no match. Returns one row per document: key, whole_license (of the whole text, or null),
    licenses (distinct names, sorted, joined by a comma; empty if none) and n_blocks (runs of paragraphs, paragraphs and
    lines that matched; a paragraph of one line counts once, a text found with and without its heading twice).

    ``known`` is a list of licences, not data: its digests are collected and part known from unknown ones inside the row; the names come from a hash
    join of what is left, for which Spark broadcasts the list as long as it is small. Only matches are regrouped. A null or empty text matches nothing, a text of punctuation alone neither. Rows that repeat
    key and text have the same result, each on its own row; a null key is a key. What other columns ``docs`` has plays no part.
    """
    table = materialize(digests(known), "known")  # a written table has a size that joins can check
    digest_list = sorted(r["digest"] for r in table.select("digest").collect())
    canon = docs.select(F.col(key).alias("key"), F.md5(F.col(text).cast("binary")).alias("text_digest"), canonical(text).alias("c"))
    # a paragraph that is more than one line; lines stand for the others
    paragraphs = F.filter(F.transform(F.split("c", r"\n *(?:\n *)+"), lambda p: F.trim(F.regexp_replace(p, r"^[ \n]+|[ \n]+$", ""))), lambda p: F.contains(p, F.lit("\n")))
    blocks = F.filter(F.transform(F.concat(F.split("c", "\n"), paragraphs), lambda b: joined(b)), lambda b: b != "")
    first = F.md5(F.element_at("ps", 1).cast("binary")).alias("first")
    begins = known.select(paragraphs_of(canonical("text")).alias("ps")).filter(F.size("ps") > 1).select(first, F.size("ps").alias("n")).distinct().collect()
    digested = F.transform(blocks, lambda b: F.md5(b.cast("binary")))
    if begins:
        runs = F.array(*[F.struct(F.lit(r["first"]).alias("first"), F.lit(r["n"]).alias("n")) for r in sorted(begins)])
        firsts = sorted({r["first"] for r in begins})
        canon = canon.withColumn("ps", F.when(F.contains("c", F.lit("\n")), paragraphs_of("c")))
        starts = F.filter(F.transform("ps", lambda p, i: F.struct(i.alias("i"), F.md5(p.cast("binary")).alias("d"))), lambda s: s["d"].isin(firsts))
        canon = canon.withColumn("starts", F.when(F.size("ps") > 1, starts))
        ran = F.flatten(
            F.transform(
                "starts",
                lambda s: F.transform(
                    F.filter(runs, lambda x: (x["first"] == s["d"]) & (x["n"] <= F.size("ps") - s["i"])),
                    lambda x: F.md5(F.array_join(F.slice("ps", s["i"] + 1, x["n"]), " ").cast("binary")),
                ),
            )
        )
        digested = F.concat(digested, F.coalesce(ran, F.array().cast("array<string>")))
    # only what is known leaves the row
    matched = F.filter(F.transform(digested, lambda d, i: F.struct(i.alias("at"), d.alias("digest"))), lambda b: b["digest"].isin(digest_list))
    narrow = materialize(canon.select("key", "text_digest", F.md5(joined("c").cast("binary")).alias("whole"), matched.alias("blocks")), "licences")
    held = (
        narrow.select("key", "text_digest", F.inline("blocks"))
        .join(table, "digest")
        .groupBy("key", "text_digest")
        .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count_distinct("at").alias("n_blocks"))
        .select(F.col("key").alias("k"), F.col("text_digest").alias("d"), "licenses", "n_blocks")
    )
    return (
        narrow.join(table.select(F.col("digest").alias("whole"), F.col("license").alias("whole_license")), "whole", "left")
        .join(held, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_digest") == F.col("d")), "left")
        .select(
            F.col("key").alias(key),
            "whole_license",
            F.coalesce("licenses", F.lit("")).alias("licenses"),
            F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
        )
    )
