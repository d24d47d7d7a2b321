"""Licence scan by sentence rules.

A text is cut into lines and these into sentences, each piece is normalised (lower
case, runs of anything but letters and digits as one space), and pieces are looked
up among known licence sentences: alone, or joined with those of the next lines
of a paragraph, the longest sentence first from the first line on. Pieces are
joined only to as many words as a known sentence that begins with the first has.
What remains of a document is its sequence of sentence identifiers. Rules are
sequences of identifiers with a licence each, tried in order; a rule matches
where its identifiers follow one another in the sequence (unknown sentences
between them do not count), and what it matched no later rule can use.

Results by case: null, empty and licence-free texts have empty lists; repeated
rows get a row each; texts are read whole; an empty table gives an empty table;
columns named like the new ones are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded

BROADCAST_ROWS = 50_000
BROADCAST_RUNS = 1_000_000

# Licence sentences, normalised, with their identifiers.
_APACHE_LAW = (" unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
               " without warranties or conditions of any kind either express or implied")
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software"
_MIT_RIGHTS = (" and associated documentation files the software to deal in the software without restriction including without limitation"
               " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons"
               " to whom the software is furnished to do so subject to the following conditions")
_MIT_NOTICE = "shall be included in all copies or substantial portions of the software"
_BSD_USE = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
               " in the documentation and or other materials provided with the distribution")
_BSD_END = "may be used to endorse or promote products derived from this software without specific prior written permission"
_ISC = "permission to use copy modify {}distribute this software for any purpose with or without fee is hereby granted"
_ISC_IF = " provided that the above copyright notice and this permission notice appear in all copies"
_GNU = "you can redistribute it and or modify it under the terms of the gnu {}general public license "
_FSF = "as published by the free software foundation"
# the kind of licence in its name and in words, and its versions with their dates
_GNU_KINDS = [("GPL", "", [("2", "june 1991"), ("3", "29 june 2007")]),
              ("LGPL", "lesser ", [("2 1", "february 1999"), ("3", "29 june 2007")]),
              ("LGPL", "library ", [("2", "june 1991")]),
              ("AGPL", "affero ", [("3", "19 november 2007")])]
_CC_KINDS = {"by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives",
             "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
_UNDER = ["", "is ", "this project is ", "this software is ", "this work is ", "this file is ", "this code is "]


def _gnu_sentences() -> list[tuple[str, str]]:
    """Notices and titles of the GNU licences. The colon of newer notices ends a sentence, the semicolon of older ones does not."""
    out = []
    for kind, word, versions in _GNU_KINDS:
        for version, date in versions:
            name = (kind + version).lower().replace(" ", "")
            any_later = f" either version {version} of the license or at your option any later version"
            texts = [(f"{name}-later", _GNU.format(word) + _FSF + any_later), (f"{name}-only", _GNU.format(word) + f"version {version} {_FSF}"),
                     (f"{name}-only", _GNU.format(word) + _FSF + f" version {version}"),
                     (f"{name}-only", _GNU.format(word) + _FSF + f" version {version} of the license")]
            out += texts + [(i, f"{what} is free software {t}") for i, t in texts for what in ("this program", "this library", "this file")]
            out.append((f"{name}-title", f"gnu {word}general public license version {version} {date}"))
    return out


def _cc_sentences() -> list[tuple[str, str]]:
    out = []
    for kind, words in _CC_KINDS.items():
        for version, where in (("4 0", "international"), ("3 0", "unported")):
            name = f"cc{kind}{version[0]}".replace(" ", "")
            for title in (f"creative commons {words} {version} {where}", f"creative commons {words} {version}"):
                out += [(f"{name}-under", f"{lead}licensed under {a}{title}{end}") for lead in ("", "this work is ")
                        for a in ("", "a ", "the ") for end in ("", " license")]
            out.append((f"{name}-title", f"{words} {version} {where}"))
            out += [(f"{name}-under", f"{lead}licensed under {a}cc {kind} {version}{end}") for lead in ("", "this work is ")
                    for a in ("", "the ") for end in ("", " license")]
    return out


def _bsd_names() -> list[str]:
    """The third clause of BSD, and its ends from any word on: a line of its own begins somewhere after the owner's name."""
    out = [f"neither the name of {o} nor the names of {c}contributors {_BSD_END}"
           for o in ("the copyright holder", "the copyright holders", "the organization", "the author", "the university", "the owner")
           for c in ("its ", "any ", "")] + [f"the name of the author may not {_BSD_END[4:]}"]
    for clause in (f"nor the names of its contributors {_BSD_END}", f"nor the names of any contributors {_BSD_END}"):
        words = clause.split()
        out += [" ".join(words[i:]) for i in range(len(words) - 4)]
    return list(dict.fromkeys(out))


SENTENCES = list(dict.fromkeys([
    ("apache2-under", "licensed under the apache license version 2 0"),
    ("apache2-under", "licensed under the apache license version 2 0 the license"),
    *[("apache2-under", f"{u}licensed under the apache {v}") for u in _UNDER
      for v in ("license version 2 0", "license 2 0", "2 0 license", "license version 2 0 the license")],
    *[("apache2-notice", f"{u}licensed under the apache license version 2 0 the license {y} may not use this file except in compliance with the license")
      for u in _UNDER for y in ("you", "and you")],
    ("apache2-use", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at"),
    *[("apache2-copy", f"you may obtain a copy of the license at {h} www apache org licenses license 2 0{law}")
      for h in ("http", "https") for law in ("", _APACHE_LAW)],
    *[("apache2-title", f"apache license version 2 0 january 2004{h}") for h in ("", " http www apache org licenses", " https www apache org licenses")],
    ("gpl3-work", "this work is licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software"),
    ("lib-free", "this library is free software"),
    *_gnu_sentences(),
    ("mit-under", "released under the mit license"),
    *[("mit-under", f"{u}{v} under the {w}") for u in _UNDER for v in ("licensed", "released", "distributed") for w in ("mit license", "terms of the mit license")],
    ("mit-grant", _MIT_GRANT),
    ("mit-grant", _MIT_GRANT + _MIT_RIGHTS),
    *[("mit-notice", f"the above copyright notice and this permission notice {p}{_MIT_NOTICE}") for p in ("", "including the next paragraph ")],
    ("no-warranty", "the software is provided as is without warranty of any kind"),
    *[("no-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to"
       f" the warranties of merchantability fitness for a particular purpose and {n}") for n in ("noninfringement", "non infringement")],
    *[("bsd-use", _BSD_USE), ("bsd-source", _BSD_SOURCE), ("bsd-binary", _BSD_BINARY)],
    *[("bsd-name", t) for t in _bsd_names()],
    *[("isc-grant", _ISC.format(a) + _ISC_IF) for a in ("and or ", "and ")],
    *[("0bsd-grant", _ISC.format(a)) for a in ("and or ", "and ")],
    ("mpl2-under", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl2-under", "this source code form is subject to the terms of the mozilla public license version 2 0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl2-title", "mozilla public license version 2 0"),
    ("cc0-title", "cc0 1 0 universal"),
    *[("cc0-waive", f"to the extent possible under law {w}") for w in (
        "the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
        "the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
        "the author has waived all copyright and related or neighboring rights to this work")],
    ("ccbync4-under", "licensed under cc by nc 4 0"),
    ("ccby4-under", "licensed under cc by 4 0"),
    *_cc_sentences(),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights", "all rights reserved"),
]))


def _gnu_rules() -> list[tuple[str, list[str]]]:
    out = []
    for kind, version in dict.fromkeys((k, v) for k, _, vs in _GNU_KINDS for v, _ in vs):
        spdx, name = f"{kind}-{version.replace(' ', '.') if ' ' in version else version + '.0'}", (kind + version).lower().replace(" ", "")
        for end in ("later", "only"):
            licence = spdx + ("-or-later" if end == "later" else "-only")
            out += [(licence, [free, f"{name}-{end}"]) for free in ("gpl-free", "lib-free")] + [(licence, [f"{name}-{end}"])]
        out.append((spdx, [f"{name}-title"]))
    return out


def _cc_rules() -> list[tuple[str, list[str]]]:
    return [(f"CC-{k.replace(' ', '-').upper()}-{v}.0", [f"cc{k}{v}-{end}".replace(" ", "")]) for k in _CC_KINDS for v in "43" for end in ("under", "title")]


# how a file names its licence in one line; expressions of several licences are not taken apart
_SPDX = "spdx license identifier "
_BSD = ["bsd-use", "bsd-source", "bsd-binary"]

# Rules in order, the more specific before the shorter.
RULES = [
    ("Apache-2.0", ["apache2-under", "apache2-use", "apache2-copy"]),
    ("Apache-2.0", ["apache2-under", "apache2-use"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("MIT", ["all-rights", "mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant", "mit-notice", "no-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["all-rights", *_BSD, "bsd-name"]),
    ("BSD-3-Clause", [*_BSD, "bsd-name"]),
    ("BSD-2-Clause", ["all-rights", *_BSD]),
    ("BSD-2-Clause", _BSD),
    ("Apache-2.0", ["apache2-under"]),
    ("Apache-2.0", ["apache2-title"]),
    *_gnu_rules(),
    ("GPL-3.0", ["gpl3-work"]),
    ("GPL", ["gpl-free"]),
    ("MIT", ["mit-under"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["all-rights", "isc-grant"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("MPL-2.0", ["mpl2-under"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("CC0-1.0", ["cc0-waive"]),
    ("CC0-1.0", ["cc0-title"]),
    ("CC-BY-NC-4.0", ["ccbync4-under"]),
    ("CC-BY-4.0", ["ccby4-under"]),
    *_cc_rules(),
    ("Unlicense", ["unlicense"]),
    ("Proprietary", ["all-rights"]),
]
_NAMED = [n for n in dict.fromkeys(n for n, _ in RULES) if n not in ("GPL", "Proprietary")]
SENTENCES += [(f"spdx-{n.lower()}", _SPDX + re.sub("[^a-z0-9]+", " ", n.lower())) for n in _NAMED]
RULES = [(n, [f"spdx-{n.lower()}"]) for n in _NAMED] + RULES

# A sentence ends at . ! ? or : before a space, and between paragraphs.
SENTENCE_END = r"[.!?:]+(?:\s+|$)"
# Notices often follow a copyright line without a stop; a piece begins at these words.
OPENINGS = ["permission is hereby", "permission to use", "redistribution and use", "this program is free", "this library is free",
            "licensed under the apache license, version 2.0 (the", "this source code form"]
NOT_PLAIN = r"[^a-z0-9\n]+"
# Fixed value: the colon of this line ends no sentence.
SPDX_LINE = "spdx-license-identifier:"


def sentences(text: Column) -> Column:
    """Normalised pieces: a sentence, or each line of one (from its opening words, if there are any). An empty piece lies between sentences and
    between paragraphs. Ends become line ends first, so one pass cleans all of them."""
    ended = F.regexp_replace(F.replace(F.lower(text), F.lit(SPDX_LINE), F.lit("\n" + _SPDX)), SENTENCE_END, "\n\n")
    for words in OPENINGS:
        ended = F.replace(ended, F.lit(words), F.lit("\n" + words))
    return F.split(F.regexp_replace(ended, NOT_PLAIN, " "), r" ?\n ?")


def known_table(spark, sentences_: list[tuple[str, str]] = SENTENCES) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in sentences_], "sentence string, id string")


def match_rules(sequence: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Licences, in the order of their first rules. ``sequence``: identifiers, each between bars."""
    names = F.array(*[F.lit(n) for n in dict.fromkeys(n for n, _ in rules)])
    table = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit("".join(f"|{i}|" for i in ids)).alias("want")) for name, ids in rules])
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(now: Column, rule: Column) -> Column:
        hit = F.contains(now["left"], rule["want"])
        return F.struct(F.when(hit, F.replace(now["left"], rule["want"], F.lit("|#|"))).otherwise(now["left"]).alias("left"),
                        F.when(hit, F.array_append(now["found"], rule["licence"])).otherwise(now["found"]).alias("found"))

    found = F.aggregate(table, start, step, lambda now: now["found"])
    return F.filter(names, lambda n: F.array_contains(found, n))


def fragments(known: DataFrame) -> DataFrame:
    """Hashes of all runs of words in the known sentences, and how many words the sentences have that start with the run."""
    words = known.select(F.split("sentence", " ").alias("w"))
    runs = words.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    hashes = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("i") + 1),
                         lambda n: F.xxhash64(F.array_join(F.slice("w", F.col("i"), n), " ")))
    return runs.select(F.when(F.col("i") == 1, F.size("w")).alias("length"), F.explode(hashes).alias("fragment")) \
        .groupBy("fragment").agg(F.array_sort(F.collect_set("length")).alias("lengths"))


def runs(parts: Column) -> Column:
    """(at, n, sentence) of the runs of n pieces that follow one another and have as many words as a sentence that begins with their first piece."""

    def of_length(p: Column, i: Column, length: Column) -> Column:
        def step(now: Column, k: Column) -> Column:
            q = F.get(parts, i + k - 1)
            on = (now["words"] < length) & (now["n"] == k - 1) & (q["at"] == p["at"] + k - 1)
            return F.when(on, F.struct(k.alias("n"), (now["words"] + q["words"]).alias("words"))).otherwise(now)

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))
        n = F.aggregate(F.sequence(F.lit(1), F.least(length, F.size(parts) - i)), start, step,
                        lambda now: F.when(now["words"] == length, now["n"]).otherwise(0))
        return F.struct(p["at"].alias("at"), n.alias("n"))

    def of_one(p: Column, i: Column) -> Column:
        whole = F.filter(F.transform(p["lengths"], lambda length: of_length(p, i, length)), lambda r: r["n"] > 0)
        return F.transform(whole, lambda r: F.struct(r["at"].alias("at"), r["n"].alias("n"), F.array_join(
            F.transform(F.sequence(i, i + r["n"] - 1), lambda k: F.get(parts, k)["piece"]), " ").alias("sentence")))

    return F.flatten(F.transform(parts, of_one))


def outermost(hits: Column) -> Column:
    """Identifiers of the sentences in order, without those that begin inside an earlier or longer one. ``hits``: (at, -n, id), sorted."""
    start = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("last"), F.array().cast("array<string>").alias("ids"))

    def step(now: Column, h: Column) -> Column:
        last = h["at"] - h["back"] - 1
        new = (h["at"] > now["last"]) | ((h["at"] == now["at"]) & (last == now["last"]))
        return F.when(new, F.struct(h["at"].alias("at"), last.alias("last"), F.array_append(now["ids"], h["id"]).alias("ids"))).otherwise(now)

    return F.aggregate(hits, start, step, lambda now: now["ids"])


def scan(docs: DataFrame, known: DataFrame, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """Append sentence_ids (known ones, in order) and licences."""
    return shielded(docs, ("text",), ("sentence_ids", "licences"), lambda d: _scanned(d, known, rules))


def _scanned(docs: DataFrame, known: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    # the text is the key, so repeated rows and ids do no harm
    key = F.sha2(F.col("text"), 256)
    # the key is made before the pieces are put in rows, or every row would hash the text again; the pieces
    # are made within the generator, or the filter that Spark puts before it would make them, too
    said = docs.filter(F.col("text").isNotNull()).select(key.alias("key"), "text") \
        .select("key", F.posexplode(sentences(F.col("text"))).alias("at", "piece")) \
        .withColumn("piece", F.trim("piece")).filter("piece != ''")
    # the known sentences are a parameter; they and their fragments are broadcast up to a checked size
    known = known.filter("sentence != ''")
    n = F.size(F.split("sentence", " "))
    size, n_runs = known.agg(F.count("*"), F.coalesce(F.sum(n * (n + 1)), F.lit(0))).first()
    pieces = fragments(known)
    if size <= BROADCAST_ROWS:
        known = F.broadcast(known)
    if n_runs // 2 <= BROADCAST_RUNS:
        pieces = F.broadcast(pieces)
    said = said.join(pieces, F.xxhash64("piece") == F.col("fragment"))
    per = said.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(
        "at", "piece", F.size(F.split("piece", " ")).alias("words"), "lengths"))).alias("parts"))
    hits = per.select("key", F.inline(runs(F.col("parts")))).join(known, "sentence")
    per = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", (-F.col("n")).alias("back"), "id"))).alias("hits")) \
        .select("key", outermost(F.col("hits")).alias("sentence_ids"))
    per = per.withColumn("licences", match_rules(
        F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|")), rules))
    out = docs.withColumn("_key", key).join(per.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
    blank = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, blank) for c in ("sentence_ids", "licences")})
