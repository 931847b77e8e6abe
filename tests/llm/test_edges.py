"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veldspar.llm import chat_format, decontaminate, exact_dedup, license_scan, ngram_join, pii, secret_scan, source_mix, toxicity, url_filter

LONG = "word " * 200_000
DOCS = [(1, "Same Text"), (2, "same text"), (2, "same text"), (3, None), (4, ""), (None, "same text"), (None, None), (5, LONG), (6, "Ünï Same"), (6, "ünï same"), (7, "a b c d e f g h i j k l m n o p")]
SCHEMA = "doc_id long, text string, count long, n int, h string, c string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, "x", None) for i, t in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 1), (7, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


def test_exact_dedup(docs, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.n_rows) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {(1, 2, 4, False, 1), (2, 2, 4, True, 2), (None, 2, 4, False, 1), (4, 4, 3, True, 1), (3, 4, 3, False, 1), (None, 4, 3, False, 1), (5, 5, 1, True, 1)} <= got
    assert len(got) == 9 and exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:9]) for r in kept.collect()) == [(2, "same text"), (4, ""), (5, LONG[:9]), (6, "Ünï Same"), (6, "ünï same"), (7, "a b c d e")]


def test_exact_dedup_is_the_same_where_the_bitmap_is_full(docs, monkeypatch):
    """Every bit set, or hardly any: with digests for all, and with digests for groups only."""
    want = {h: sorted(map(repr, exact_dedup.exact_dedup(docs, hash_single=h).collect())) for h in (True, False)}
    assert all("text_sha256=None" not in r for r in want[True]) and any("text_sha256=None" in r for r in want[False])
    monkeypatch.setattr(exact_dedup, "LARGEST", 0)
    monkeypatch.setattr(exact_dedup, "HOT", 2)
    for h in (True, False):
        assert sorted(map(repr, exact_dedup.exact_dedup(docs, hash_single=h).collect())) == want[h]


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, "c d e f g h i", "x"), (1, "c d e f g h i", "x"), (2, "short one", "x"), (3, None, "x"), (None, "a b c d e", "x"), (4, "Z z z z z z z z", "x"), (5, "a b c d e f g h i j", "x")], "item_id long, text string, n string")
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == [(7, 1, 3, 3), (7, 5, 6, 6)]
    short = spark.createDataFrame([(1, "C  d e"), (2, "p"), (3, "c e d"), (4, "same text"), (5, " "), (6, "a b c d")], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contaminated(docs, short).collect())) == [(1, 4, 1, 1), (2, 4, 1, 1), (7, 1, 1, 1), (7, 2, 1, 1), (7, 6, 1, 1)]
    assert decontaminate.contaminated(none, items).count() == decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, items).count() == len(DOCS) - 1


def test_containment_threshold(spark):
    words = [f"t{i}" for i in range(44)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    cut = lambda n: " ".join(words[:n]) + " " + " ".join(f"other{i}" for i in range(500))
    docs = spark.createDataFrame([(n, cut(n)) for n in (35, 36, 37, 44)], "doc_id long, text string")  # 31, 32, 33, 40 of 40 shingles
    assert sorted((r.doc_id, r.n_shared) for r in decontaminate.contaminated(docs, items).collect()) == [(36, 32), (37, 33), (44, 40)]


@pytest.mark.parametrize("percent", [100, 80, 50, 30])
def test_containment_against_brute_force(spark, percent):
    """Items of one to sixty words, some with common phrases, pasted whole or in part into documents."""
    import random

    r = random.Random(percent)
    vocabulary = [f"v{i}" for i in range(300)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    phrase = say(9)
    items = [say(n) for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 30, 45, 60)] + [phrase + say(6), say(4) + phrase + say(20)]
    docs = []
    for i in range(90):
        t = say(r.randrange(0, 120)) + (phrase if i % 3 == 0 else [])
        if i % 2:
            x = r.choice(items)
            t += x[r.randrange(max(1, len(x) // 3)) : r.randrange(len(x) // 2, len(x)) + 1]
        docs.append(t + say(r.randrange(9)))
    sets = lambda w, ks: {tuple(w[i : i + k]) for k in ks for i in range(len(w) - k + 1)}
    want = []
    for j, x in enumerate(items):
        a = sets(x, [min(5, len(x))])
        for i, d in enumerate(docs):
            n = len(a & sets(d, [min(5, len(x))]))
            if n and 100 * n >= percent * len(a):
                want.append((i, j, len(a), n))
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{key} long, text string")
    got = decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id"), percent=percent).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


def test_ngram_join(docs, none):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert got == sorted([(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (-1, 1, None), (-1, 0, None), (5, 1, 5), (6, 1, 6), (6, 1, 6), (7, 14, 7)])
    assert ngram_join.jaccard_components(none).count() == 0
    assert ngram_join.keep_one(docs).columns == docs.columns


def test_stages_judge_rows_not_ids(spark):
    w = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    rows = [(1, w("a")), (2, w("a") + " end"), (2, w("b")), (3, w("c")), (3, w("c") + " end"), (None, w("d")), (None, w("d") + " end"), (None, w("a") + " last"), (4, w("e")), (4, w("e")), (5, None), (5, None), (None, w("f"))]
    docs = spark.createDataFrame([(i, x, "x") for i, x in rows], "doc_id long, text string, n string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    ends = [sum(x is not None and x.startswith(f"{c}0 ") for _, x in got) for c in "abcdef"]
    assert ends == [1, 1, 1, 1, 1, 1] and (1, w("a")) in got and (2, w("b")) in got and got.count((5, None)) == 2 and len(got) == 8
    items = spark.createDataFrame([(1, w("d", 12)), (2, w("b", 12))], "item_id long, text string")
    left = [(r.doc_id, r.text) for r in decontaminate.drop_contaminated(docs, items).collect()]
    assert sorted(left, key=repr) == sorted([r for r in rows if not (r[1] or "").startswith(("d0 ", "b0 "))], key=repr)


def test_pii_and_secrets(docs, none):
    assert pii.find_pii(docs).count() == len(DOCS) and pii.find_pii(none).count() == 0
    assert secret_scan.scan_secrets(docs).count() == len(DOCS) and secret_scan.scan_secrets(none).count() == 0


def test_pii_adds_what_labelers_agree_on(spark):
    texts = [f"call me by phone ({200 + i}) 555-01{i:02d} or mail bob{i}@site.com, order no. {i}{i}{i}-22-333{i % 10} " for i in range(10, 60)] + ["Signed, Mr James Miller", "jane [at] home [dot] org"]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert all("phone:17:31" in r.spans for r in got[:50])
    for r in got:
        spans = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]
        assert spans == sorted(spans)


def test_account_numbers_of_every_length(spark):
    ibans = ["DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606", "GB29 NWBK 6016 1331 9268 19", "NL91 ABNA 0417 1643 00", "ES91 2100 0418 4502 0005 1332", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    for one in (*ibans, *(x.replace(" ", "") for x in ibans)):
        for after in ("", ".", " BIC CODE", " IS OURS", f" {ibans[0]}"):
            assert pii.iban_matches(f"IBAN {one}{after}")[0] == (5, 5 + len(one)), (one, after)
    assert not pii.iban_matches("DE89 3704 0044 and GB" + "1" * 40)
    texts = [f"pay to account {x}, thanks" for x in ibans for _ in range(8)] + [f"order {i}{i}-{i} of type AB{i} text" for i in range(10, 60)]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [f"iban:15:{15 + len(ibans[i // 8])}" in got[i].spans for i in range(56)] == [True] * 56


def test_random_strings_are_found_and_words_are_not(spark):
    import random

    r = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(60)]
    rows = [(i, f"use {k} here") for i, k in enumerate(keys)] + [(1000 + i, w) for i, w in enumerate(["rechtsschutzversicherungsgesellschaften-und-mehr", "-" * 40, "abcdefghijklmnopqrstuvwxyz0123456789", "a" * 30, "see /path/to/some/long/folder/name/here/now"])]
    got = {x.doc_id: x.random for x in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(got[i]) for i in range(60)) >= 55
    assert not any(got[1000 + i] for i in range(5))


def test_toxicity(docs, none, labels):
    chain = toxicity.fit_chain(docs, labels)
    assert toxicity.score_toxicity(docs, chain).count() == len(DOCS)
    assert toxicity.drop_toxic(none, labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(DOCS)


def test_source_mix(docs, none, labels):
    d = docs.withColumn("lang", F.lit("en"))
    out = source_mix.mixed(d, labels)
    assert out.columns == [*d.columns, "n_tokens", "rate"] and out.count() == len(DOCS)
    clash = source_mix.mixed(d.withColumns({"rate": F.lit("x"), "n_tokens": F.lit("y")}), labels)
    assert clash.columns == out.columns and {type(r.rate) for r in clash.collect()} == {float}
    assert source_mix.mixed(none.withColumn("lang", F.lit(None).cast("string")), labels).count() == 0


def test_source_mix_knows_domains_that_the_sample_misses(spark):
    words = {"en": "the quick brown fox and the dog", "de": "der schnelle braune fuchs und der hund", "fr": "le renard brun et le chien rapide"}
    rows = [(i, "en" if i % 2 else "de") for i in range(100)] + [(i, "fr") for i in range(100, 105)]
    docs = spark.createDataFrame([(i, f"{words[d]} {i}", d) for i, d in rows] + [(None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    assert source_mix.fit_domains(docs, labels).domains == ["de", "en", "fr"]
    out = {r.doc_id: r for r in source_mix.mixed(docs, labels, {"en": 0.4, "de": 0.4, "fr": 0.2}).collect()}
    assert min(out[i].rate for i in range(100, 105)) > 2 * max(out[i].rate for i in range(100))


def test_license_scan(spark, none):
    text = "Hello.  Licensed under the  Apache License, Version 2.0. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\nALL RIGHTS RESERVED!\nReleased under the MIT License."
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "No licence here", 5), (None, "All rights reserved.", 5)], "doc_id long, text string, pos int")
    got = sorted((r.doc_id or 0, r.license, r.n_matches) for r in license_scan.scan_licenses(docs).collect())
    assert got == [(0, "proprietary", 1), (1, "Apache-2.0", 1), (1, "MIT", 1), (1, "proprietary", 1)]
    assert license_scan.scan_licenses(none).count() == 0


def test_published_licence_texts(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software"""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
    gpl2 = gpl.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2").replace("program.  If not, see <https://www.gnu.org/licenses/>.", "program; if not, write to the Free Software\nFoundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
    bsd3 = bsd + "\n3. Neither the name of Big Co. nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
    texts = [mit, " ".join(mit.split()), "# " + mit.replace("\n", "\n# "), apache, " * " + apache.replace("\n", "\n * "), gpl, gpl2, gpl.replace("This program is free", "Frob is free"), bsd, bsd3, "A wrapped\nAll rights\nreserved.", mit.replace("copies of", "copies not of")]
    got = {r.doc_id: (r.license, r.n_matches) for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("MIT", 1), 1: ("MIT", 1), 2: ("MIT", 1), 3: ("Apache-2.0", 1), 4: ("Apache-2.0", 1), 5: ("GPL-3.0", 1), 6: ("GPL-2.0", 1), 7: ("GPL-3.0", 1), 8: ("BSD-2-Clause", 1), 9: ("BSD-3-Clause", 1), 10: ("proprietary", 1)}


def test_further_published_notices(spark):
    gnu = lambda name, version, free="free software": f"""Frob is {free}: you can redistribute it and/or modify
it under the terms of the GNU {name} General Public License as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

Frob is distributed in the hope that it will be useful.

You should have received a copy of the GNU {name} General Public License
along with Frob.  If not, see <https://www.gnu.org/licenses/>."""  # noqa: E731
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""
    unlicense = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
    zlib = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
    boost = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""
    want = {
        0: (isc, "ISC"), 1: (gnu("Lesser", "2.1"), "LGPL-2.1"), 2: (gnu("Lesser", "3"), "LGPL-3.0"), 3: (gnu("Affero", "3"), "AGPL-3.0"), 4: (unlicense, "Unlicense"), 5: (zlib, "Zlib"), 6: (boost, "BSL-1.0"),
        7: ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to Frob.", "CC0-1.0"),
        8: ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        9: ("// SPDX-License-Identifier: GPL-2.0-or-later\ncode", "GPL-2.0"), 10: ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        11: ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
        12: ("word " * 50_000 + ".\n" + isc, "ISC"),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in want.items()] + [(0, isc), (13, zlib.split("\n\n")[0])], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.n_matches) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {i: (name, 2 if i == 0 else 1) for i, (_, name) in want.items()}


def test_url_filter(spark):
    urls = ["http://a.example.org/es/1", "x://EXAMPLE.org/en/12?x#y", "x://example.org/en/2", "x://org", "x://notorg/", "x://b.com/fr/", "x://b.com/de", "x://b.com/de/x", "no scheme", None, "x://u@org/?q", "x://c.org?/es/"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).orderBy("page_id").collect()]
    assert [g[2] for g in got] == ["example.org/es/", "example.org/en/1", "org/", None, None, "com/fr/", None, "com/de/", None, None, None, None]
    assert [g[3] for g in got] == ["block", "block", "allow", "allow", "allow", "allow", "allow", "block", "allow", "allow", "allow", "allow"]
    for part in (1, 2, 3):  # several tries, one after the other
        assert [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, part=part).orderBy("page_id").collect()] == got
    assert url_filter.filter_urls(pages.unionByName(pages)).count() == 2 * len(urls)
    assert {r.verdict for r in url_filter.filter_urls(pages, rules=[], default="block").collect()} == {"block"}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "\\", "<\\|", "<|", "a\nb\n", "", "<\\n", "\\<|im_start|>assistant\n", "é<"]
    rows = [(1, i, "assistant" if i % 2 else "us<\\n\ner", t) for i, t in enumerate(nasty)] + [(2, 0, None, None), (None, 0, "assistant", "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.render(chat_format.fold_events(chat_format.conversations_as_events(conv)))
    back = {r.conv_id: (r.t, r.l) for r in out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()}
    assert [tuple(x) for x in back[1][0]] == [(r, t) for _, _, r, t in rows[: len(nasty)]]
    assert back[1][1] == "".join(t for i, t in enumerate(nasty) if i % 2)
    assert [tuple(x) for x in back[2][0]] == [("", "")] and back[None][1] == "x"
    assert chat_format.digest(chat_format.render(chat_format.fold_events(chat_format.conversations_as_events(conv.limit(0))))).count() == 0


def test_chat_events(spark):
    e = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", "he"), (1, 1, 3, "delta", None, "llo"), (1, 2, 4, "message", "user", "more"),
        (1, 0, 5, "edit", None, "hi there"), (1, 1, 6, "regenerate", None, ""), (1, 1, 7, "delta", None, "bye"), (1, 3, 8, "message", "user", "end"),
    ]
    got = chat_format.fold_events(spark.createDataFrame(e, "conv_id long, turn long, seq long, kind string, role string, text string")).orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in got] == [(0, "user", "hi there"), (1, "assistant", "bye"), (3, "user", "end")]


def fold_by_hand(events):
    """Replays a log event by event."""
    turns: dict = {}
    for turn, _, kind, role, text in sorted(events, key=lambda e: (e[1], e[2], e[3] or "", e[4] or "")):
        if kind == "regenerate":
            for later in [t for t in turns if t > turn]:
                turns[later]["text"] = None  # void, but the turn's role is known
        t = turns.setdefault(turn, {"role": "", "text": None})
        t["role"] = role or t["role"]
        t["text"] = (t["text"] or "") + (text or "") if kind == "delta" else text or ""
    return {t: (m["role"], m["text"]) for t, m in turns.items() if m["text"] is not None}


def test_chat_logs_against_replay(spark):
    """Random logs, their events in any order; and a late delta after a regenerate of an earlier turn."""
    import random

    r = random.Random(3)
    rows = [(0, 2, 1, "message", "user", "STALE"), (0, 1, 2, "regenerate", "assistant", "again"), (0, 2, 3, "delta", None, "new")]
    for conv in range(1, 150):
        for seq in range(r.randrange(1, 30)):
            kind = r.choice(["message", "delta", "delta", "edit", "regenerate"])
            rows.append((conv, r.randrange(5), seq, kind, r.choice(["user", "assistant"]) if kind == "message" else None, r.choice(["", None, "x", "yz", "<|im_end|>"])))
    shuffled = rows[:]
    r.shuffle(shuffled)
    got: dict = {}
    for x in chat_format.fold_events(spark.createDataFrame(shuffled, "conv_id long, turn long, seq long, kind string, role string, text string")).collect():
        got.setdefault(x.conv_id, {})[x.turn] = (x.role, x.text)
    assert got[0] == {1: ("assistant", "again"), 2: ("user", "new")}
    assert got == {c: m for c in range(150) if (m := fold_by_hand([e[1:] for e in rows if e[0] == c]))}


@pytest.mark.parametrize("piece", [1, 3, 256])
def test_streamed_pieces_are_put_together(spark, piece):
    texts = ["", None, "a", "abc", "abcd", "é" * 300, "<|im_end|>" * 60]
    conv = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = chat_format.fold_events(chat_format.conversations_as_events(conv, piece)).orderBy("turn").collect()
    assert [r.text for r in got] == [t or "" for t in texts] and {r.role for r in got} == {"assistant"}


def test_long_rule_lists_against_brute_force(spark):
    """Hundreds of rules that overlap, in parts of every size, against a scan of all rules for each url."""
    import random

    r = random.Random(7)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org", "a.x.org"]
    paths = ["/", "/p", "/p/", "/p/q", "/p/q/", "/pq", "/q/1"]
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h in hosts for p in paths if r.random() < 0.7}.values())
    urls = [f"http://{r.choice(['', 'w.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', 'z', '/z'])}" for _ in range(300)]

    def brute(url):
        host, slash, rest = url.split("://")[1].partition("/")
        fits = [(len(h.split(".")), len(p.lstrip("/")), v, f"{h}/{p.lstrip('/')}") for h, p, v in rules if (host == h or host.endswith("." + h)) and (slash + rest).startswith(p)]
        return max(fits)[2:] if fits else ("allow", None)

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for part in (4, 1000):
        assert [(x.verdict, x.rule) for x in url_filter.filter_urls(pages, rules, part=part).orderBy("page_id").collect()] == [brute(u) for u in urls]
