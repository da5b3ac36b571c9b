"""License scans by sentence rules."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import bound_batches, per_batch

#: Known licence sentences by identifier, as licences print them.
SENTENCES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-2-compliance": "you may not use this file except in compliance with the License.",
    "apache-2-copy": "You may obtain a copy of the License at",
    "apache-2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3-only": "Licensed under the GNU General Public License, version 3.",
    "gpl-2-line": "Licensed under the GNU General Public License, version 2.",
    "lgpl-3-line": "Licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3-line": "Licensed under the GNU Affero General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-sa-4-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4-line": "Licensed under CC BY-ND 4.0.",
    "cc0-line": "This work is dedicated to the public domain under CC0 1.0.",
}

#: Ordered rules. A rule is a licence and the identifiers that follow one another.
RULES = [
    ("Apache-2.0", ["apache-2-grant", "apache-2-compliance", "apache-2-copy"]),
    ("Apache-2.0", ["apache-2-as-is", "apache-2-see"]),
    ("Apache-2.0", ["apache-2-line"]),
    ("MIT", ["mit-permission", "mit-notice", "as-is"]),
    ("MIT", ["mit-permission", "mit-notice"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["mit-licensed"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-only", ["gpl-3-line"]),
    ("GPL-3.0-only", ["gpl-3-only"]),
    ("GPL-2.0-only", ["gpl-2-line"]),
    ("LGPL-3.0-only", ["lgpl-3-line"]),
    ("AGPL-3.0-only", ["agpl-3-line"]),
    ("MPL-2.0", ["mpl-2-form"]),
    ("CC-BY-4.0", ["cc-by-4-line"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-line"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-line"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4-line"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4-line"]),
    ("CC0-1.0", ["cc0-line"]),
    ("LicenseRef-proprietary", ["all-rights-reserved"]),
]

#: A sentence ends at a newline, or at its last mark before white space.
END = re.compile(r"\n|[.!?:;]+[\x20\x09-\x0D]+")
WORDS, LETTER = re.compile(r"[a-z0-9]+"), re.compile(r"[^\W_]")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Numbers or letters of list items: before a sentence, or cut off as one of their own.
ITEM, NUMBER = re.compile(r"[^a-z0-9]*(?:[0-9]{1,2}|[a-z])\)\s+"), re.compile(r"[^a-z0-9]*(?:[0-9]{1,2}|[a-z])\)?", re.ASCII)
#: Stands for what is no sentence: list numbers and lines of marks alone, as in comments.
NOTHING = ""


def normalise(sentence: str) -> str:
    """Lower-case ASCII letters and digits, runs of anything else as one space."""
    return " ".join(WORDS.findall(sentence.translate(LOWER)))


class RuleBook:
    """Sentence identifiers by normalised sentence, and rules by first identifier."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES):
        self.of: dict[str, tuple[str, ...]] = {}
        for name, text in sentences.items():
            # A known sentence with marks inside is cut like any text; its parts must follow one another.
            parts = [p for p in map(normalise, END.split(text)) if p]
            self.of.setdefault(parts[0], ())
            self.of[parts[0]] += ((name, *parts),)
        for parts in self.of:
            self.of[parts] = tuple(sorted(self.of[parts], key=lambda p: (-len(p), p[0])))
        # By first word: whole known sentences as words, longest first.
        self.words: dict[str, list[tuple[str, list[str]]]] = {}
        for name, text in sorted(sentences.items(), key=lambda x: (-len(normalise(x[1]).split()), x[0])):
            self.words.setdefault(normalise(text).split()[0], []).append((name, normalise(text).split()))
        #: A known sentence and its first part begin with the same word, so others need not be normalised.
        self.begins = frozenset(self.words)
        self.rules: dict[str, list[tuple[int, str, list[str]]]] = {}
        for n, (licence, ids) in enumerate(rules):
            self.rules.setdefault(ids[0], []).append((n, licence, ids))
        for known in self.rules.values():
            known.sort(key=lambda r: (-len(r[2]), r[0]))

    def identify(self, text: str | None) -> list[tuple[str | None, int]]:
        """Identifier (None: unknown) and number of each sentence that is not blank."""
        text = (text or "").translate(LOWER)
        sentences, breaks, at, end = [], [], 0, 0
        for mark in [*END.finditer(text), None]:
            s = text[at : mark.start() if mark else len(text)]
            if s and not s.isspace():
                breaks.append(text.count("\n", end, at) > 1)
                sentences.append(s)
                end = at + len(s)
            at = mark.end() if mark else at
        breaks.append(True)
        out: list[tuple[str | None, int]] = []
        i = 0
        while i < len(sentences):
            known, s = (), sentences[i]
            first = WORDS.search(s)
            if not first and not LETTER.search(s) or len(s) < 12 and NUMBER.fullmatch(s):
                out.append((NOTHING, i))
                i += 1
                continue
            if first and len(first[0]) <= 2:
                s = ITEM.sub("", s, count=1)
                first = WORDS.search(s)
            likely = first is not None and first[0] in self.begins
            if likely:
                known = self.of.get(normalise(s), ())
            for name, *parts in known:
                if normalise(s) == parts[0] and all(i + k < len(sentences) and normalise(sentences[i + k]) == p for k, p in enumerate(parts[1:], 1)):
                    out.append((name, i))
                    i += len(parts)
                    break
            else:
                name, n = self.over_lines(s, sentences, breaks, i) if likely else (None, 1)
                out.append((name, i))
                i += n
        return out

    def over_lines(self, s: str, sentences: list[str], breaks: list[bool], i: int) -> tuple[str | None, int]:
        """Identifier of the known sentence that goes on from ``s`` over single newlines, and how many pieces it takes."""
        begin = normalise(s).split()
        for name, words in self.words.get(begin[0], ()) if begin else ():
            have, n = begin, 1
            while len(have) < len(words) and have == words[: len(have)] and not breaks[i + n] and (more := normalise(sentences[i + n])):
                have = have + more.split()
                n += 1
            if have == words:
                return name, n
        return None, 1

    def match(self, found: list[tuple[str | None, int]]) -> list[tuple[int, str, int, int]]:
        """(rule, licence, first sentence, last sentence), left to right, longest rule first, without overlap."""
        found = [f for f in found if f[0] != NOTHING]
        out, i = [], 0
        while i < len(found):
            for n, licence, ids in self.rules.get(found[i][0], ()):
                if [f[0] for f in found[i : i + len(ids)]] == ids:
                    out.append((n, licence, found[i][1], found[i + len(ids) - 1][1]))
                    i += len(ids)
                    break
            else:
                i += 1
        return out


def scan(docs: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """``(doc_id, n_sentences, n_known, licences, first_licence, matches)`` of every row of ``docs(doc_id, text)``.

    Whole texts are cut into sentences, sentences are normalised and looked up, and the
    sequence of identifiers is matched left to right against the rules: at each place
    the longest rule whose identifiers follow one another directly holds, ties go to the
    rule listed first. A known sentence may be wrapped over lines, and list numbers
    and lines of marks may lie between those of a rule. ``licences`` are the distinct licences, sorted and comma-joined
    (empty: none); ``matches`` holds (rule, licence, first sentence, last sentence).

    The rule table is a constant of the code and goes to all tasks; nothing is
    shuffled. Null and empty texts have no sentence. Repeated rows each get their row.
    """
    book = book or RuleBook()
    names = ["doc_id", "n_sentences", "n_known", "licences", "first_licence", "matches"]
    match = pa.list_(pa.struct([("rule", pa.int32()), ("licence", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), match]

    def run(batch):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = book.identify(text)
            hits = book.match(found)
            licences = sorted({h[1] for h in hits})
            rows.append((doc, len(found), sum(bool(f[0]) for f in found), ",".join(licences), hits[0][1] if hits else None,
                         [dict(zip(("rule", "licence", "first", "last"), h)) for h in hits]))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, n_sentences long, n_known long, licences string, first_licence string, matches array<struct<rule:int,licence:string,first:long,last:long>>"
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(per_batch(run), schema)
