"""Licence scan by sentence rules, in SQL functions only.

A text is cut into parts, at line feeds and after . ! ? ; : before white space; each part is normalised (lower case,
comment and list marks at its ends stripped, quotes and marks dropped, white space as one space).  A known licence sentence
is found where it is one part or several parts on end: wrapped lines and marks within a sentence don't hide it, and a
one-line notice needs no stop.  Where known sentences share parts, the first and longest counts.  A rule is a sequence
of identifiers of known sentences; a text carries the rule's licence where the sequence occurs, in order and without
other KNOWN sentences in between.  Where rules overlap, the one listed first wins: identifiers used by one match
aren't used again.

The rule base is fixed, so its table is a constant of the plan: no join, no shuffle, no Python.

Defined cases: a null or empty text has no licence (empty arrays, 0 matches); a licence that is stated
several times is listed once and counted in n_matches; repeated rows each give their row; an empty
table gives an empty result; other columns of the input don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences: (identifier, sentence as it reads after normalisation).  Fixed values from the public licence texts and their usual notices.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("gpl3-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-short", "licensed under the gnu general public license version 3"),
    ("gpl-redistribute", "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (at your option) any later version"),
    ("gpl2-redistribute", "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or (at your option) any later version"),
    ("gpl-no-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("lgpl3-notice", "this work is licensed under the gnu lesser general public license version 3"),
    ("agpl3-notice", "this work is licensed under the gnu affero general public license version 3"),
    ("ccbync4-notice", "licensed under cc by-nc 4.0"),
    ("ccby4-notice", "licensed under cc by 4.0"),
    ("ccbysa4-notice", "licensed under cc by-sa 4.0"),
    ("cc0-notice", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mit-notice", "released under the mit license"),
    ("mit-short", "licensed under the mit license"),
    ("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the software) to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice-kept", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache2-notice", "licensed under the apache license version 2.0"),
    ("apache2-header", "licensed under the apache license version 2.0 (the license) you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at http //www.apache.org/licenses/license-2.0"),
    ("apache2-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-permission", "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl2-notice", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("unlicense-notice", "this is free and unencumbered software released into the public domain"),
)

#: Rules in order of precedence: (licence, identifiers in order).  Longer rules stand before their parts.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-no-warranty", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-no-warranty", "gpl-see")),
    ("MIT", ("mit-permission", "mit-notice-kept", "mit-as-is")),
    ("MIT-0", ("mit-permission", "mit-as-is")),
    ("Apache-2.0", ("apache2-header", "apache2-copy", "apache2-as-is", "apache2-see")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("GPL-2.0-or-later", ("gpl2-redistribute",)),
    ("Apache-2.0", ("apache2-header",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("LGPL-3.0-only", ("lgpl3-notice",)),
    ("AGPL-3.0-only", ("agpl3-notice",)),
    ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("CC-BY-4.0", ("ccby4-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-short",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("ISC", ("isc-permission",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("Unlicense", ("unlicense-notice",)),
)

#: Further wordings of known sentences, as they read after normalisation: MIT-0's permission has no conditions.
FORMS: tuple[tuple[str, str], ...] = (
    ("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the software) to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("apache2-copy", "you may obtain a copy of the license at https //www.apache.org/licenses/license-2.0"),
)

#: Steps from a lower-case text to its parts, one a line.  Each pattern passes over the text once (no step back over long runs).
STEPS: tuple[tuple[str, str], ...] = (
    (r"(?<=[.!?;:])[ \t\f\x0B\r]+", "\n"),  # a part ends at a line feed, or after these marks before white space
    (r"(?md)^[ \t\f\x0B\r]*+(?:dnl|rem)(?=[ \t])|\(\*|\*\)", " "),  # comment marks with letters or brackets
    (r"[\"',;:*#‘’“”]", " "),  # marks that don't count, at any place
    (r"[ \t\f\x0B\r]++", " "),
    (r"(?<=\() | (?=\))", ""),
    (r"(?md)^[^\p{L}\p{N}(\n]++", ""),  # comment marks, list marks and white space before a part
    (r"(?<![^\p{L}\p{N})\n])[^\p{L}\p{N})\n]++(?=\n|\z)", ""),  # and behind it, with its stops
    (r"\n{2,}+", "\n"),
)


def parts(text: Column) -> Column:
    """The normalised parts of a text, one a line."""
    out = F.lower(text)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return out


def _rare(known: list[str]) -> list[str]:
    """Words of which each known sentence has one at least, so that texts without any need no normalising."""
    out: list[str] = []
    left = known
    while left:
        words = sorted({w for s in left for w in s.split() if w.isalpha()} or {w for s in left for w in s.split()})
        out.append(max(words, key=lambda w: (sum(w in s for s in left) * (len(w) > 6 and w != "without"), len(w))))
        left = [s for s in left if out[-1] not in s]
    return out


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """doc_id, sentence_ids (in order), licenses (distinct, sorted), n_matches; one row for each row."""
    ids = {name: chr(0x100 + k) for k, (name, _) in enumerate(sentences)}  # one character for each identifier: sequences are strings
    by_text = {s: ids[name] for name, s in (*(f for f in FORMS if f[0] in ids), *sentences)}
    known = sorted(by_text, key=len, reverse=True)
    table = F.create_map(*[F.lit(x) for pair in by_text.items() for x in pair])
    names = F.create_map(*[F.lit(x) for name, c in ids.items() for x in (c, name)])

    # a sentence begins and ends where a part does; its spaces may be ends of parts
    pattern = "(?md)^(?:" + "|".join("[ \n]".join(map(_quote, s.split(" "))) for s in known) + ")$"
    whole = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(whole)
    likely = F.lit(False)
    for word in _rare(known):
        likely = likely | F.contains(low, F.lit(word))
    hits = F.when(likely, F.regexp_extract_all(parts(whole), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    sequence = F.array_join(F.transform(hits, lambda s: F.element_at(table, F.translate(s, "\n", " "))), "")

    frame = docs.select(F.col(doc_id).alias("doc_id"), sequence.alias("_seq"))
    # each rule consumes its places, in order of precedence: a match turns into the rule's own mark
    marks = {k: chr(0x2000 + k) for k in range(len(rules))}
    left = F.col("_seq")
    for k, (_, steps) in enumerate(rules):
        left = F.replace(left, F.lit("".join(ids[s] for s in steps)), F.lit(marks[k]))
    frame = frame.withColumn("_left", F.when(F.col("_seq") == "", F.lit("")).otherwise(left))
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    licence = F.create_map(*[F.lit(x) for k, (name, _) in enumerate(rules) for x in (marks[k], name)])
    found = F.filter(F.transform(chars(F.col("_left")), lambda c: F.element_at(licence, c)), lambda x: x.isNotNull())
    return frame.select(
        "doc_id",
        F.transform(chars(F.col("_seq")), lambda c: F.element_at(names, c)).alias("sentence_ids"),
        F.array_sort(F.array_distinct(found)).alias("licenses"),
        F.size(found).cast("long").alias("n_matches"),
    )


def _quote(word: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in word)
