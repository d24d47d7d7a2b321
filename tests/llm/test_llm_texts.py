"""The text operators: held-out accuracy, exact round trips, edge cases."""

import datetime as dt
import hashlib
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from oracle import compare, duck_connect
from tidepool.llm import bpe, licences, pseudonyms, quality, queries, toxicity
from tidepool.sources.tables import load

SF = "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, "   \n"), (4, "word"), (4, "word"), (5, "long " * 60_000), (None, "§§ ### 漢字 😀")]


def edge(spark, clash):
    return spark.createDataFrame(EDGE, "doc_id long, text string").withColumn(clash, F.lit("clash")).withColumn("more", F.lit(1))


@pytest.fixture(scope="module")
def parts():
    return queries.bpe_parts()


@pytest.fixture(scope="module")
def coder(parts):
    return bpe.PrefixEncoder(parts[0])


@pytest.fixture(scope="module")
def other(parts):
    return tiktoken.Encoding("own", pat_str=parts[1], mergeable_ranks=parts[0], special_tokens={})


def merged(ranks, piece):
    """Plain lowest-rank-first merging."""
    if piece in ranks:
        return [ranks[piece]]
    p = [piece[i:i + 1] for i in range(len(piece))]
    while len(p) > 1:
        r = [ranks.get(a + b, 1 << 40) for a, b in zip(p, p[1:])]
        if min(r) == 1 << 40:
            break
        i = r.index(min(r))
        p[i:i + 2] = [p[i] + p[i + 1]]
    return [ranks[x] for x in p]


@settings(max_examples=300, deadline=None)
@given(piece=st.one_of(st.binary(min_size=1, max_size=24), st.text("abehinorst ", min_size=1, max_size=24).map(str.encode),
                       st.text("a =-\n", min_size=1, max_size=40).map(str.encode)))
def test_prefix_encoding_equals_plain_merging(parts, coder, piece):
    assert coder.encode(piece) == merged(parts[0], piece)


def test_appends_and_edits_equal_encoding_anew(parts, coder):
    rng = random.Random(3)
    text = "".join(rng.choice("aeionrst th") for _ in range(900)).encode()
    e = bpe.EditableEncoding(coder, text[:500])
    stored = list(e.last)
    e.append(text[500:])
    assert e.last[:501] == stored and e.ids() == coder.encode(text)
    for _ in range(20):
        a = rng.randrange(len(e.data))
        b = min(len(e.data), a + rng.randrange(5))
        e.replace(a, b, bytes(rng.choice(b"abc xyz") for _ in range(rng.randrange(6))))
        assert e.last == bpe.EditableEncoding(coder, e.data).last
    e = bpe.EditableEncoding(coder, text)
    e.replace(100, 101, b"q")
    assert e.recomputed < len(text) // 2


def test_documents_encode_like_tiktoken(spark, parts, other):
    rows = {r["doc_id"]: r for r in queries.op10_bpe(spark, SF_SMALL).collect()}
    for r in load(spark, SF_SMALL, "documents").collect():
        ids = other.encode_ordinary(r["text"])
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_encoding_edge_cases(spark, parts, other):
    out = bpe.decode(bpe.encode(edge(spark, "token_ids"), *parts), parts[0]).collect()
    assert len(out) == len(EDGE) and out[0].asDict().keys() == {"doc_id", "text", "more", "token_ids", "decoded"}
    for r in out:
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == other.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(edge(spark, "x").limit(0), *parts).collect() == []


@pytest.mark.parametrize("module,label,query,threshold", [(toxicity, "toxic", queries.op1_toxicity, 0.7), (quality, "quality", queries.op4_quality, 0.5)])
def test_held_out_accuracy(spark, module, label, query, threshold):
    rows = query(spark, SF).join(load(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    assert len(rows) > 80
    assert np.mean([r["predicted"] == r[label] for r in rows]) >= 0.93
    assert all(r["predicted"] == int(r["score"] >= threshold) and 0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_scoring_edge_cases(spark, module, label):
    model = module.fit(load(spark, SF_SMALL, "documents"), load(spark, SF_SMALL, "labels"))
    rows = module.score(edge(spark, "score"), model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault(r["text"] and r["text"].strip(), r["score"]) == r["score"]
    none = module.fit(load(spark, SF_SMALL, "documents"), load(spark, SF_SMALL, "labels").limit(0))
    assert {round(r["score"], 6) for r in module.score(edge(spark, "score"), none).collect()} == {0.0 if module is toxicity else 0.5}
    assert module.score(edge(spark, "score").limit(0), model).collect() == []


def test_kernel_tolerates_gaps_and_inserted_characters():
    s = toxicity.Settings()
    k = toxicity.kernel(["numbskull", "numbskkull", "numxbskull", "nmbskull", "breakfast"], ["numbskull"], s)[:, 0]
    assert k[0] == max(k) and min(k[1:4]) > 4 * k[4]
    assert toxicity.plain('"n-u-m-b.5kull!"') == "numbskull" and "numbskull" in toxicity.words_of("you n u m b s k u l l there")


def test_training_learns_the_word_that_sets_toxic_texts_apart():
    s = toxicity.Settings(rounds=1, epochs=2)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    clean = [" ".join(word() for _ in range(30)) for _ in range(40)]
    model = toxicity.train(clean + [c + " numbskull" for c in clean[:20]], [0] * 40 + [1] * 20, s)
    one = toxicity.Scorer(model).scores(["a nice day", "what a numbskkull"])
    assert one[1] > one[0]


SAMPLES = {"card": "4111 1111 1111 1111", "phone": "+1 (446) 555-8962", "ssn": "123-45-6789", "iso": "2024-02-29", "dmy": "29.02.2024",
           "ip": "11.180.247.116", "iban": "DE89 3704 0044 0532 0130 00", "email": "ab.c7@mail4.example.com"}


def test_pseudonyms_keep_format_and_checks_and_can_be_undone():
    there, back = pseudonyms.Pseudonymiser(b"k"), pseudonyms.Pseudonymiser(b"k", forward=False)
    for kind, value in SAMPLES.items():
        text = f"before {value}, after"
        new, n = there.replace(text)
        assert n == 1 and value not in new, kind
        assert there.spans(new)[0][2] == kind and back.replace(new) == (text, 1), (kind, new)
        assert pseudonyms.Pseudonymiser(b"other").replace(text)[0] != new
    card = "".join(c for c in there.replace(SAMPLES["card"])[0] if c.isdigit())
    assert pseudonyms.luhn_digit(card[:-1]) == card[-1]
    dt.date.fromisoformat(there.replace(SAMPLES["iso"])[0])


def test_invalid_values_stay():
    p = pseudonyms.Pseudonymiser(b"k")
    for text in ("4111 1111 1111 1112", "2023-02-29", "31.04.2024", "1.2.3.999", "666-12-1234", "DE88 3704 0044 0532 0130 00", "version 2.0", "a@b"):
        assert p.replace(text) == (text, 0), text


@pytest.mark.parametrize("value,around", [
    ("2024-02-29", "at {}T10:00:00Z"), ("2024-02-29", "{}t10:00"), ("31/12/2020", "on {}, so"), ("13/01/1999", "{}"), ("12/31/2020", "{}"),
    ("DE89 3704 0044 0532 0130 00", "{} BIC COBADEFFXXX"), ("DE89370400440532013000", "{} EUR"), ("DE89370400440532013000", "{}EUR"),
    ("GB82 WEST 1234 5698 7654 32", "to {} SWIFT ABCDGB22 9 12/31/2020"), ("NO9386011117947", "{} A B")])
def test_values_are_found_whatever_follows(value, around):
    there, back = pseudonyms.Pseudonymiser(b"k"), pseudonyms.Pseudonymiser(b"k", forward=False)
    text = around.format(value)
    new, n = there.replace(text)
    assert n >= 1 and value not in new and len(new) == len(text) and back.replace(new) == (text, n)
    assert around.split("{}")[1][:5] == new[len(around.split("{}")[0]) + len(value):][:5]


def test_slash_dates_stay_one_to_one():
    p, days = pseudonyms.Pseudonymiser(b"k"), [dt.date(2019, 1, 1) + dt.timedelta(i) for i in range(1000)]
    texts = {f"{d:%m/%d/%Y}" for d in days} | {f"{d:%d/%m/%Y}" for d in days}
    new = {p.replace(t)[0] for t in texts}
    assert len(new) == len(texts) and all(p.replace(t)[1] == 1 for t in texts)


@settings(max_examples=200, deadline=None)
@given(n=st.integers(1, 10 ** 30), x=st.integers(0, 10 ** 30))
def test_feistel_is_a_permutation(n, x):
    f = pseudonyms.Feistel(b"key")
    x %= n
    y = f.permute(x, n, "t")
    assert 0 <= y < n and f.restore(y, n, "t") == x


@pytest.mark.parametrize("bits", [129, 400, 1003, 4096, 20_001])
def test_feistel_changes_all_of_large_values(bits):
    f, rng = pseudonyms.Feistel(b"key"), random.Random(bits)
    n = (1 << bits) - rng.getrandbits(bits // 2)
    for _ in range(5):
        x = rng.randrange(n)
        y = f.permute(x, n, "t")
        assert 0 <= y < n and f.restore(y, n, "t") == x
        assert (x ^ y) >> (bits - 60) and len({(x ^ y) >> i & 255 for i in range(0, bits - 8, 8)}) > min(60, bits // 16)


@pytest.mark.parametrize("size", [20, 100, 128, 200, 5000])
def test_long_credentials_change_from_end_to_end(size):
    there, back = pseudonyms.Pseudonymiser(b"k"), pseudonyms.Pseudonymiser(b"k", forward=False)
    rng = random.Random(size)
    value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
    new, n = there.replace("token=" + value)
    same = [a == b for a, b in zip(new[6:], value)]
    assert n == 1 and sum(same) < max(size // 8, 6) and not all(same[:4]) and back.replace(new) == ("token=" + value, 1)


@pytest.mark.parametrize("text,value", [
    ("secret=wJalrXUtnFEMI/K7MDENG/bPxRfiCYzq and", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzq"),
    ("token: eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJ_-x~a==\n", "eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJ_-x~a=="),
    ('{"password": "abcd efgh+Z9", "x": 1}', "abcd efgh+Z9"), ("PASSWORD=Hunter2Hunter2", "Hunter2Hunter2"),
    ("{'Api_Key':'k1k2k3k4!k5'}", "k1k2k3k4!k5"), ('{\\"token\\":\\"abcdEFGH0123\\"}', "abcdEFGH0123"),
    ("passwd = abcdefgh@Home99, next", "abcdefgh@Home99")])
def test_credentials_are_replaced_whole(text, value):
    there, back = pseudonyms.Pseudonymiser(b"k"), pseudonyms.Pseudonymiser(b"k", forward=False)
    new, n = there.replace(text)
    at = text.index(value)
    got = new[at:at + len(value)]
    assert n == 1 and new[:at] == text[:at] and new[at + len(value):] == text[at + len(value):]
    for cut in range(0, len(value) - 4, 4):
        assert got[cut:cut + 5] != value[cut:cut + 5]
    assert [c for c in got if not c.isalnum()] == [c for c in value if not c.isalnum()] and back.replace(new) == (text, 1)


def test_keys_without_letters_or_digits_after_them_are_no_credentials():
    p = pseudonyms.Pseudonymiser(b"k")
    for text in ("token=........", "secret: ---------- ", "password=\u6f22\u5b57\u6f22\u5b57\u6f22\u5b57\u6f22\u5b57"):
        assert p.replace(text) == (text, 0), text


def test_feistel_reaches_every_value():
    f = pseudonyms.Feistel(b"key")
    assert sorted(f.permute(x, 97, "t") for x in range(97)) == list(range(97))


def test_equal_values_stay_linked_and_edge_cases(spark):
    rows = [(1, "call +1 (446) 555-8962 now"), (2, "or +1 (446) 555-8962"), (3, "not 1-446-555-8962"), (3, "not 1-446-555-8962")]
    out = pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"k").orderBy("doc_id").collect()
    digits = ["".join(c for c in r["text"] if c.isdigit()) for r in out]
    assert len(set(digits)) == 1 and digits[0] != "14465558962"
    out = pseudonyms.pseudonymise(edge(spark, "n_replaced"), b"k").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == sorted(EDGE, key=repr) and {r["n_replaced"] for r in out} == {0}


def test_no_card_number_or_address_is_left(spark):
    import re
    before = " ".join(r["text"] for r in load(spark, SF, "documents").select("text").collect())
    after, kinds = " ".join(r["text"] for r in queries.op2_pseudonyms(spark, SF).collect()), 0
    for pattern in (r"(?<![\w-])\d{16}(?!\w)", r"\(\d{3}\) 555-\d{4}", r"\w+\.\d\d@mail", r"AKIA\w{16}", r"password=(\w{18})", r"(?<![\w.])\d+\.\d+\.\d+\.\d+(?!\w)"):
        old, new = set(re.findall(pattern, before)), set(re.findall(pattern, after))
        if "{16}(?!" in pattern:  # numbers without a right check digit are no cards, and stay
            other = {n for n in old if pseudonyms.luhn_digit(n[:-1]) != n[-1]}
            assert other and other <= new
            old -= other
        if r"\d+\.\d+\.\d+" in pattern:
            old = {n for n in old if all(int(x) < 256 for x in n.split("."))}
        assert not old & new, (pattern, list(old & new)[:3])
        kinds += bool(old)
    assert kinds >= 4


def test_licence_rules(spark):
    rows = [(1, "Intro here.\nLicensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
            (2, "released   under the MIT LICENSE"), (3, "Released under the MIT License.\nAll rights reserved."), (4, "nothing"), (5, None),
            (6, ""), (2, "released   under the MIT LICENSE"), (7, "Licensed under CC BY-NC 4.0.\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licences", F.lit("clash"))
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in licences.scan(df, licences.known_table(spark)).collect()}
    assert got[1] == (["apache2-under", "apache2-use"], ["Apache-2.0"]) and got[2] == (["mit-under"], ["MIT"])
    assert got[3] == (["mit-under", "all-rights"], ["MIT", "Proprietary"]) and got[4] == got[5] == got[6] == ([], [])
    assert len(got[7][0]) == 3000 and got[7][1] == ["CC-BY-NC-4.0"]
    assert licences.scan(df.limit(0), licences.known_table(spark)).collect() == []


NOTICES = {
    "Apache-2.0": """Copyright 2020 A. Writer

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "MIT": """MIT License

Copyright (c) 2020 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
""",
    "BSD-3-Clause": """Copyright (c) 2009 The Example Authors.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of Example Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.
""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all
copyright and related and neighboring rights to this software to the
public domain worldwide. This software is distributed without any warranty.
""",
    "CC-BY-SA-4.0": """This work is licensed under a Creative Commons
Attribution-ShareAlike 4.0 International License.
""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software.
""",
}


def test_licences_of_verbatim_notices(spark):
    forms = {"wrapped": lambda t: t, "one line": lambda t: " ".join(t.split()), "crlf": lambda t: t.replace("\n", "\r\n"),
             "comment": lambda t: "".join(f" * {x}\n" for x in t.splitlines()), "hash": lambda t: "".join(f"# {x}\n" for x in t.splitlines()),
             "inside": lambda t: f"Some words before\n\n{t}\n\nand after", "close": lambda t: f"Some words before\n{t}and after"}
    rows = [(name, form, f(t)) for name, t in NOTICES.items() for form, f in forms.items()]
    df = spark.createDataFrame(rows, "name string, form string, text string")
    got = {(r["name"], r["form"]): r["licences"] for r in licences.scan(df, licences.known_table(spark)).collect()}
    wrong = {k: v for k, v in got.items() if v != [k[0]]}
    assert not wrong, wrong


def test_licence_sql_joins_wrapped_lines_like_the_operator(spark):
    rows = [(i, f"Some words before\n{t}and after") for i, t in enumerate(NOTICES.values())]
    rows += [(100 + i, " * " + t.replace("\n", "\n * ")) for i, t in enumerate(NOTICES.values())]
    rows += [(200, None), (201, ""), (202, "Released\nunder\nthe\nMIT\nLicense"), (202, "Released\nunder\nthe\nMIT\nLicense"),
             (203, "Released under the\n\nMIT License"), (204, "the software\n" * 50 + "All rights reserved.\n" * 50),
             (205, "// SPDX-License-Identifier: Apache-2.0\n/* SPDX-License-Identifier: MIT */"), (206, "SPDX-License-Identifier: GPL-2.0-or-later")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], ",".join(r["sentence_ids"]), ",".join(r["licences"])) for r in licences.scan(df, licences.known_table(spark)).collect())
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    assert got == sorted(con.execute(queries.ORACLE["op3_licences"]).fetchall())
    found = {d: names for d, _, names in got}
    assert found[205] == "Apache-2.0,MIT" and found[206] == "GPL-2.0-or-later" and found[203] == ""


def test_licences_of_a_text_of_known_pieces_take_time_in_proportion(spark):
    text = "the software\n" * 100_000
    df = spark.createDataFrame([(1, text), (2, text + "is provided as is without warranty\nof any kind")], "doc_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r["sentence_ids"] for r in licences.scan(df, licences.known_table(spark)).collect()}
    assert got == {1: [], 2: ["no-warranty"]} and time.monotonic() - began < 90


def test_licence_sentences_do_not_cross_paragraphs(spark):
    rows = [(1, "Released under the\n\nMIT License"), (2, "Released under the\nMIT License\nAll rights reserved"),
            (3, "Released\nunder\nthe\nMIT\nLicense"), (4, "permission\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.scan(df, licences.known_table(spark)).collect()}
    assert got == {1: [], 2: ["MIT", "Proprietary"], 3: ["MIT"], 4: []}
    none = licences.scan(df, licences.known_table(spark).limit(0)).collect()
    assert all(r["licences"] == [] and r["sentence_ids"] == [] for r in none)


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, duck, key):
    assert compare(spark, key, SF_SMALL, duck)["status"] == "match"


def test_pipeline(spark):
    import corpus_pipeline as P
    docs = load(spark, SF_SMALL, "documents")
    steps = [docs]
    for _, stage in P.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], SF_SMALL))
        assert steps[-1].columns == docs.columns
    clean = docs.join(load(spark, SF_SMALL, "labels").filter("toxic = 0"), "doc_id", "left_semi").count()
    kept = steps[1].join(load(spark, SF_SMALL, "labels").filter("toxic = 0"), "doc_id", "left_semi").count()
    assert kept >= 0.97 * clean
    assert P.run(spark, SF_SMALL).count() == steps[-1].count() > 0


def test_near_copies_keep_one_row_of_each_group(spark):
    import corpus_pipeline as P
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a, "x"), (2, a + " more", "x"), (2, b, "x"),  # an id shared by a copy and a clean document
            (3, c, "x"), (3, c, "x"), (3, c, "y"), (3, c, None),  # repeated rows, and an id shared by copies
            (None, d, "x"), (None, d, "x"), (None, d + " more", "x"), (None, a, "x"),  # no id
            (4, None, "x"), (4, "", "x"), (4, "", "x"), (None, " \n", None), (5, "one", "x"), (6, "ONE", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("made", F.lit("2024-01-01").cast("timestamp"))
    out = P.drop_near_copies(spark, docs, SF_SMALL)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    group = lambda t: (t or "").removesuffix(" more").strip().lower()
    assert out.columns == docs.columns
    assert sorted(group(t) for _, t in got if group(t)) == sorted([a, b, c, d, "one"])
    by = {group(t): i for i, t in got if group(t)}
    assert by == {a: 1, b: 2, c: 3, d: None, "one": 5}
    assert sum(not group(t) for _, t in got) == 4
    assert P.drop_near_copies(spark, docs.limit(0), SF_SMALL).collect() == []
