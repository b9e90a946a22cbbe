"""Known licences, found by the digest of the canonical text.

Canonical means: lines that state a copyright are removed, letters are ASCII lower case, everything
else but digits is one space, and equivalent spellings are made equal by rule. A document is looked up
whole by joining its digest with those of the known texts; each of its lines is looked up whole
among the short notices in the same way.

Defined cases: a null text counts as empty; a text without letters or digits is no licence, whatever the
known texts. Two known texts with one digest give the name that sorts first. Repeated rows give
repeated results; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence texts without their copyright lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""
TEXTS = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_TERMS + _BSD_END),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_NAME + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_TERMS + _BSD_NAME + _BSD_END),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB),
)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
)
#: Patterns replaced one after another; they mean the same to Java and to RE2.
COPYRIGHT = (
    r"(?m)^[ \t*#/;-]*(?:[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt][ \t]*(?:\([Cc]\)|©|[0-9]{4}|[<\[])|\([Cc]\)[ \t]*[0-9]{4}|©)[^\n]*$"
)
RESERVED = r"(?m)^[ \t*#/;-]*[Aa]ll [Rr]ights [Rr]eserved\.?[ \t]*$"
SPELLINGS = (
    (r"\b([a-z]{3,})is(e|ed|es|ing|ation|ations)\b", r"\1iz\2"),  # organise, utilisation
    (r"\b([a-z]{3,})our(s|ed|able|ite|ing|)\b", r"\1or\2"),  # favour, labour
    (r"\b([a-z]{3,})ogue(s|)\b", r"\1og\2"),  # catalogue
    (r"\b([a-z]{3,})ll(ed|ing)\b", r"\1l\2"),  # labelling, cancelled
    (r"\b([a-z]{3,})dgement(s|)\b", r"\1dgment\2"),  # judgement, acknowledgement
    (r"\b(sub |)licen[cs]e(s|d|es|)\b", r"\1license\2"), (r"\bsub license", r"sublicense"),
    (r"\bcentre(s|)\b", r"center\1"), (r"\bnon commercial", r"noncommercial"), (r"\bper cent\b", r"percent"),
    (r"\bcopyright owner", r"copyright holder"), (r"\bwhilst\b", r"while"), (r"\bhttps\b", r"http"),
)
#: A literal that every match of the rule of the same place holds: where a text lacks it, that rule leaves it as it is.
NEEDLES = ("is", "our", "ogue", "ll", "dgement", "licen", "sub license", "centre", "non commercial", "per cent",
           "copyright owner", "whilst", "https")


def canonical(text: Column) -> Column:
    out = _unless(F.coalesce(text, F.lit("")), _states, lambda s: F.regexp_replace(s, COPYRIGHT, " "))
    return _words(_unless(out, lambda s: s.contains("eserved"), lambda s: F.regexp_replace(s, RESERVED, " ")))


def _states(text: Column) -> Column:
    """False only where ``COPYRIGHT`` cannot match: a text without any spelling of copyright, (c) or ©."""
    return F.translate(text, "COPYRIGHT", "copyright").contains("copyright") | text.contains("(c)") | text.contains("(C)") | text.contains("©")


def _unless(out: Column, holds, then) -> Column:
    """``then(out)`` where ``holds(out)``, else ``out`` unchanged; ``out`` is bound once, so rules in a row stay linear."""
    return F.transform(F.array(out), lambda s: F.when(holds(s), then(s)).otherwise(s))[0]


def _words(out: Column) -> Column:
    out = F.trim(F.lower(F.regexp_replace(out, "[^A-Za-z0-9]+", " ")))
    for (pattern, by), needle in zip(SPELLINGS, NEEDLES, strict=True):
        out = _unless(out, lambda s, n=needle: s.contains(n), lambda s, p=pattern, b=by: F.regexp_replace(s, p, b.replace("\\", "$")))
    return out


def known_digests(known: DataFrame) -> DataFrame:
    """``(digest, license)`` of a table ``(license, text)``."""
    words = known.select("license", canonical(F.col("text")).alias("words")).filter("words <> ''")
    return words.groupBy(F.sha2("words", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, notices: DataFrame) -> DataFrame:
    """``(doc_id, digest, license, n_notices, notice, notices)``: the canonical text's digest, the known licence
    it is, the number of lines which are known notices, the first of their licences by name, and the sorted
    distinct licences of these lines and of lines which state a copyright and end in a known notice.

    ``notices`` is a short fixed list, so its digests become a literal map."""
    short = {r["digest"]: r["license"] for r in known_digests(notices).collect()}
    names = F.create_map(*[F.lit(x) for pair in sorted(short.items()) for x in pair])
    found = F.filter(
        F.transform("lines", lambda line: F.try_element_at(names, F.sha2(canonical(line), 256))),
        lambda name: name.isNotNull(),
    )
    ends = notices.select(canonical(F.col("text")).alias("words"), "license").filter("words <> ''").distinct().collect()
    stated = F.transform(F.filter("lines", lambda line: _states(line) & line.rlike(COPYRIGHT)), _words)

    def ending(words: str, name: str) -> Column:
        return F.transform(F.filter("stated", lambda line: F.endswith(line, F.lit(f" {words}"))), lambda _: F.lit(name))

    # lines and the copyright lines are columns of their own, made once a row, not once for each notice that reads them
    behind = F.flatten(F.array(*[ending(r["words"], r["license"]) for r in ends]))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), lines.alias("lines"))
    rows = rows.select("doc_id", "digest", found.alias("found"), stated.alias("stated"))
    rows = rows.select("doc_id", "digest", "found", behind.alias("behind"))
    return rows.join(known_digests(known), "digest", "left").select(
        "doc_id", "digest", "license", F.size("found").cast("long").alias("n_notices"), F.array_min("found").alias("notice"),
        F.array_sort(F.array_distinct(F.concat("found", "behind"))).alias("notices"),
    )


def sql_canonical(text: str) -> str:
    """The same in SQL text."""
    quoted = lambda s: s.replace("'", "''")
    out = f"regexp_replace(regexp_replace(coalesce({text}, ''), '{quoted(COPYRIGHT)}', ' ', 'g'), '{quoted(RESERVED)}', ' ', 'g')"
    out = f"trim(lower(regexp_replace({out}, '[^A-Za-z0-9]+', ' ', 'g')))"
    for pattern, by in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out
