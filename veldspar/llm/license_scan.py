"""Licence scans by sentence-rule recognition, with built-in functions only.

Sentences of the whole text are normalised (A-Z lower-cased, all but a-z and 0-9 to single spaces) and mapped to the
identifiers of known licence sentences; the document's identifier sequence is then matched against licence rules,
which are ordered identifier sequences. Longer rules are matched first and use up their identifiers, so a sentence is
not counted again by a rule it is only a part of. Unknown sentences between known ones are skipped.

A known sentence starts where a line or sentence starts and ends where one ends; within it the text may be wrapped, or
commented out, line by line. The sentences and rules of the statement `SQL` are SENTENCES and RULES; PUBLISHED and
FURTHER_RULES add the notices as licences print them, with their variants.

Edge cases: null or empty text has no finding; a null id is reported as null; rows that share an id are scanned as
one document; an empty table gives an empty result. Result: one row per document and licence found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.text import UPPER

#: Short notices, one sentence each.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "Released under the MIT License.",
    3: "This work is licensed under the GNU General Public License, version 3.",
    4: "Licensed under CC BY-NC 4.0.",
    5: "All rights reserved.",
    6: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    7: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    8: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    9: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    10: "You should have received a copy of the GNU General Public License along with this program.",
    11: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    12: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    13: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    14: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    15: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    16: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: (licence, ordered sentence identifiers)
RULES = [
    ("Apache-2.0", (1, 6)),
    ("Apache-2.0", (1,)),
    ("MIT", (7, 8)),
    ("MIT", (2,)),
    ("GPL-3.0", (9, 10)),
    ("GPL-3.0", (3,)),
    ("CC-BY-NC-4.0", (4,)),
    ("CC-BY-NC-4.0", (11,)),
    ("CC-BY-4.0", (12,)),
    ("BSD-2-Clause", (13, 14, 15)),
    ("MPL-2.0", (16,)),
    ("proprietary", (5,)),
]

_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_APACHE = "the apache license version 2 0 the license you may not use this file except in compliance with the license"
_AS_IS = "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
_GPL = "^is free software you can redistribute it and or modify it under the terms of the gnu general public license"
_LESSER = _GPL.replace("gnu general", "gnu (?:lesser|library) general")
_AFFERO = _GPL.replace("gnu general", "gnu affero general")
_FSF = "as published by the free software foundation"
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
#: (identifier, normalised sentence as published, a regular expression). "_" is a name of up to 12 words, "^" one of up
#: to 6 words on one line, "~" whatever is left of the line.
PUBLISHED = [
    (1, f"licensed under {_APACHE}"),
    (1, f"the asf licenses this file to you under {_APACHE}"),
    (6, "you may obtain a copy of the license at https? (?:www )?apache org licenses license 2 0(?: txt)?"),
    (6, f"you may obtain a copy of the license at https? (?:www )?apache org licenses license 2 0(?: txt)? {_AS_IS}"),
    (7, _MIT_GRANT),
    (8, "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    (16, "this source code form is subject to the terms of the mozilla public license v(?: 2 0)?"),
    (17, f"{_MIT_GRANT} the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    (21, f"{_GPL} {_FSF}(?: either)? version 3(?: of the license)?(?: or at your option any later version)?"),
    (21, f"{_GPL} version 3(?: only)? {_FSF}"),
    (10, "you should have received a copy of the gnu general public license along with _(?: if not(?: see| write to) ~)?"),
    (11, "this work is licensed under (?:a|the) creative commons attribution noncommercial 4 0 international license"),
    (12, "this work is licensed under (?:a|the) creative commons attribution 4 0 international license"),
    (13, f"{_BSD_GRANT}(?: 1)?"),
    (18, "(?:neither )?the names? of _ (?:nor the names of (?:its|any|the|their)(?: other)? contributors )?may(?: not)? be used to endorse or promote products derived from this software without(?: specific)? prior written permission"),
    (19, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment this product includes software developed by _"),
    (20, f"{_GPL} {_FSF}(?: either)? version 2(?: of the license)?(?: or at your option any later version)?"),
    (20, f"{_GPL} version 2(?: only)? {_FSF}"),
    (22, "permission to use copy modify and(?: or)? distribute this software(?: and its documentation)? for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (23, f"{_LESSER} {_FSF}(?: either)? version 2 1(?: of the license)?(?: or at your option any later version)?"),
    (24, f"{_LESSER} {_FSF}(?: either)? version 3(?: of the license)?(?: or at your option any later version)?"),
    (25, "you should have received a copy of the gnu lesser general public license along with _(?: if not(?: see| write to) ~)?"),
    (26, f"{_AFFERO} {_FSF}(?: either)? version 3(?: of the license)?(?: or at your option any later version)?"),
    (27, "you should have received a copy of the gnu affero general public license along with _(?: if not(?: see| write to) ~)?"),
    (28, "this work is licensed under (?:a|the) creative commons attribution sharealike 4 0 international license"),
    (29, "this work is licensed under (?:a|the) creative commons attribution noncommercial sharealike 4 0 international license"),
    (30, "to the extent possible under law _ ha(?:s|ve) waived all copyright and related or neighboring rights to _"),
    (31, "this is free and unencumbered software released into the public domain"),
    (32, "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    (33, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    (34, "this software is provided as is without any express or implied warranty"),
    (35, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    (36, "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 2 0 which ~"),
]
FURTHER_RULES = [
    ("ISC", (22,)),
    ("LGPL-2.1", (23, 25)),
    ("LGPL-2.1", (23,)),
    ("LGPL-3.0", (24, 25)),
    ("LGPL-3.0", (24,)),
    ("AGPL-3.0", (26, 27)),
    ("AGPL-3.0", (26,)),
    ("CC-BY-SA-4.0", (28,)),
    ("CC-BY-NC-SA-4.0", (29,)),
    ("CC0-1.0", (30,)),
    ("Unlicense", (31, 32)),
    ("Unlicense", (31,)),
    ("BSL-1.0", (33,)),
    ("Zlib", (34, 35)),
    ("EPL-2.0", (36,)),
    ("MIT", (17,)),
    ("BSD-4-Clause", (13, 14, 15, 19, 18)),
    ("BSD-3-Clause", (13, 14, 15, 18)),
    ("GPL-2.0", (20, 10)),
    ("GPL-2.0", (20,)),
    ("GPL-3.0", (21, 10)),
    ("GPL-3.0", (21,)),
]
#: Tags that name a licence outright: one sentence and one rule for each licence named above.
_NAMED = sorted({name for name, _ in (*RULES, *FURTHER_RULES)} - {"proprietary"})
TAGS = [(100 + i, f"spdx license identifier {' '.join(name.lower().replace('-', ' ').replace('.', ' ').split())}(?: only| or later)?") for i, name in enumerate(_NAMED)]
TAG_RULES = [(name, (100 + i,)) for i, name in enumerate(_NAMED)]
#: Around a sentence that was found; normalised text has no such characters.
OPENED, CLOSED = "\x02", "\x03"


def normalise(text: Column) -> Column:
    """Normalised text with one line feed between sentences."""
    lower = F.translate(text, UPPER, UPPER.lower())
    broken = F.regexp_replace(F.regexp_replace(lower, r"([.!?])[\x20\x09-\x0D]+", "$1\n"), r"[\r\n]+", "\n")
    return F.regexp_replace(broken, r"[^a-z0-9\n]+", " ")


def _pattern(sentence: str) -> str:
    """Regular expression of a normalised sentence whose words may stand on several lines."""
    names = {"_": r"(?:[a-z0-9]++[ \n]++){0,11}?[a-z0-9]++", "^": r"(?:[a-z0-9]++ ++){1,6}?", "~": r"[a-z0-9 ]*+"}
    return "".join({" ": r"[ \n]++", **names}.get(c, c) for c in sentence)


def _known(sentences: dict[int, str], published) -> list[tuple[int, str]]:
    """(identifier, regular expression), longer sentences first."""
    plain = [(i, " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in s.lower()).split())) for i, s in sentences.items()]
    return [(i, _pattern(s)) for i, s in sorted([*published, *plain], key=lambda x: -len(x[1]))]


def scan_licenses(docs: DataFrame, sentences: dict[int, str] = SENTENCES, rules=(*RULES, *FURTHER_RULES, *TAG_RULES), id_col: str = "doc_id", text_col: str = "text", published=(*PUBLISHED, *TAGS)) -> DataFrame:
    """One row per document and licence: doc_id, license, n_matches, n_sentences (known ones), sentence_ids."""
    known = _known(sentences, published)
    whole = rf"(?<![^\n]) ?+(?:{'|'.join(p for _, p in known)})(?= ?(?:\n|\z))"
    marked = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(normalise(F.coalesce(F.col(text_col), F.lit(""))), whole, f"{OPENED}$0{CLOSED}").alias("t")).filter(F.contains("t", F.lit(OPENED)))
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x, i: F.when(x.startswith(OPENED), i)), lambda i: i.isNotNull())
    texts = F.transform(F.slice(F.split("t", OPENED), 2, 1 << 30), lambda x: F.trim(F.substring_index(x, CLOSED, 1)))
    each = marked.select("doc_id", F.explode(F.arrays_zip(lines.alias("pos"), texts.alias("s"))).alias("x")).select("doc_id", "x.pos", "x.s")
    sid = F.coalesce(*[F.when(F.col("s").rlike(rf"\A(?:{p})\z"), i) for i, p in known])
    found = each.select("doc_id", "pos", sid.alias("sid"))
    # Known sentences are a fixed list, so what a document gathers here is a few bytes for each line of its own.
    order = F.sort_array(F.collect_list(F.struct("pos", "sid")))
    seq = found.groupBy("doc_id").agg(order.alias("o")).select("doc_id", F.transform("o", lambda x: x["sid"]).alias("sentence_ids"))
    left = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")
    counts: dict[str, Column] = {}
    for name, ids in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        pattern = "".join(f"<{i}>" for i in ids)
        rest = F.replace(left, F.lit(pattern), F.lit("|" * len(ids)))
        n = (F.length(left) - F.length(rest)) / (len(pattern) - len(ids))
        counts[name] = counts[name] + n if name in counts else n
        left = rest
    hits = F.array(*[F.struct(F.lit(name).alias("license"), n.cast("long").alias("n_matches")) for name, n in sorted(counts.items())])
    out = seq.select("doc_id", "sentence_ids", F.explode(F.filter(hits, lambda h: h["n_matches"] > 0)).alias("h"))
    return out.select("doc_id", "h.license", "h.n_matches", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join(F.col("sentence_ids").cast("array<string>"), ",").alias("sentence_ids"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and licence found in it."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    values = ", ".join(f"({i}, '{s}')" for i, s in SENTENCES.items())
    ordered = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    norm = lambda c: f"regexp_replace(regexp_replace(regexp_replace(translate(coalesce({c}, ''), '{UPPER}', '{UPPER.lower()}'), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(10), 'g'), '[\\r\\n]+', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g')"
    steps, last = "", "q0"
    for k, (name, ids) in enumerate(ordered):
        pattern, bars = "".join(f"<{i}>" for i in ids), "|" * len(ids)
        steps += f", q{k + 1} AS (SELECT *, replace(s{k}, '{pattern}', '{bars}') AS s{k + 1}, (length(s{k}) - length(replace(s{k}, '{pattern}', '{bars}'))) // {len(pattern) - len(ids)} AS n{k} FROM q{k})"
        last = f"q{k + 1}"
    rows = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS license, n{k} AS n, ids, cnt FROM {last}" for k, (name, _) in enumerate(ordered))
    return f"""
WITH k0(sid, raw) AS (VALUES {values}),
k AS (SELECT s, min(sid) AS sid FROM (SELECT sid, trim(unnest(string_split({norm('raw')}, chr(10)))) AS s FROM k0) WHERE length(s) > 8 GROUP BY s),
l AS (SELECT doc_id, trim(unnest(ss)) AS s, unnest(range(len(ss))) AS pos FROM (SELECT doc_id, string_split({norm('text')}, chr(10)) AS ss FROM documents)),
f AS (SELECT l.doc_id, l.pos, k.sid FROM l JOIN k USING (s)),
q0 AS (SELECT doc_id, string_agg(sid::VARCHAR, ',' ORDER BY pos, sid) AS ids, count(*) AS cnt, string_agg('<' || sid || '>', '' ORDER BY pos, sid) AS s0 FROM f GROUP BY doc_id){steps}
SELECT doc_id, license, CAST(sum(n) AS BIGINT) AS n_matches, cnt AS n_sentences, ids AS sentence_ids
FROM ({rows}) WHERE n > 0 GROUP BY doc_id, license, cnt, ids
"""


SQL = _sql()
