"""Licence recognition by sentence rules, in SQL functions alone.

A text is cut into sentences, each sentence is normalised (ASCII lower case, runs of other characters
one space) and looked up among the known licence sentences; the identifiers found, in text order, are
matched against ordered rules. A rule fires if its identifiers occur in that order, others between or not, unless an
earlier rule that fired needs all of its identifiers and more (three clauses of BSD are not two as well).

Defined cases: null and empty texts have no sentence and no licence; repeated sentences count each time;
a sentence is known only whole. A sentence ends at a full stop or the like, or at a line without letters and digits; it
may be wrapped over lines (comment marks count as white space) and may start or end at any line break. There is no join and no shuffle: the tables of sentences and rules are
literals, and a text without any of a few key words skips the sentence work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import texts

_GNU = "you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
# Normalised sentences of public licence notices and texts, by identifier.
SENTENCES = {
    "apache2_notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache2_compliance": ["you may not use this file except in compliance with the license"],
    "apache2_copy": ["you may obtain a copy of the license at"],
    "apache2_asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit_notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit_asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl3_notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl2_notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl_terms": [_GNU.format("general")],
    "lgpl_terms": [_GNU.format("lesser general")],
    "agpl_terms": [_GNU.format("affero general")],
    "gpl2_only_terms": ["you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"],
    "gpl2_later_terms": [f"{_GNU.format('general')} {_LATER.format('2')}"],
    "gpl3_later_terms": [f"{_GNU.format('general')} {_LATER.format('3')}"],
    "lgpl21_later_terms": [f"{_GNU.format('lesser general')} {_LATER.format('2 1')}"],
    "lgpl3_later_terms": [f"{_GNU.format('lesser general')} {_LATER.format('3')}"],
    "agpl3_later_terms": [f"{_GNU.format('affero general')} {_LATER.format('3')}"],
    "version2_later": [_LATER.format("2")],
    "version21_later": [_LATER.format("2 1")],
    "version3_later": [_LATER.format("3")],
    "version2_only": ["version 2 of the license"],
    "version3_only": ["version 3 of the license"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "gpl_received": ["you should have received a copy of the gnu general public license along with this program"],
    "mpl_subject": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl2_obtain": [f"if a copy of the mpl was not distributed with this file you can obtain one at {x} mozilla org mpl 2 0" for x in ("https", "http")],
    "isc_grant": [f"permission to use copy modify {x} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for x in ("and or", "and")],
    "isc_asis": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "epl2_notice": [f"this program and the accompanying materials are made available under the terms of the eclipse public license {x} which {y}is available at {z} www eclipse org legal epl 2 0" for x in ("2 0", "v 2 0", "v2 0") for y in ("", "accompanies this distribution and ") for z in ("https", "http")],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc0_dedication": [f"to the extent possible under law {x} dedicated all copyright and related and neighboring rights to this {y} to the public domain worldwide" for x in ("the author s have", "the author has", "the authors have") for y in ("software", "work")],
    "zlib_asis": ["this software is provided as is without any express or implied warranty"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "ccbync_notice": ["licensed under cc by nc 4 0"],
    "ccbysa_notice": ["licensed under cc by sa 4 0"],
    "ccby_notice": ["licensed under cc by 4 0"],
    "bsd_redistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_endorse": [f"neither the name of the {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" for x in ("copyright holder", "university", "author", "organization")],
    "all_rights": ["all rights reserved"],
}
# Ordered rules, (licence, identifiers that follow one another).
RULES = [
    ("Apache-2.0", ["apache2_notice"]),
    ("Apache-2.0", ["apache2_compliance", "apache2_copy", "apache2_asis"]),
    ("MIT", ["mit_notice"]),
    ("MIT", ["mit_grant", "mit_condition", "mit_asis"]),
    ("GPL-3.0-only", ["gpl3_notice"]),
    ("GPL-2.0-only", ["gpl2_notice"]),
    ("GPL-2.0-only", ["gpl2_only_terms"]),
    ("GPL-2.0-or-later", ["gpl2_later_terms"]),
    ("GPL-3.0-or-later", ["gpl3_later_terms"]),
    ("GPL-2.0-or-later", ["gpl_terms", "version2_later"]),
    ("GPL-3.0-or-later", ["gpl_terms", "version3_later"]),
    ("GPL-2.0-only", ["gpl_terms", "version2_only"]),
    ("GPL-3.0-only", ["gpl_terms", "version3_only"]),
    ("LGPL-2.1-or-later", ["lgpl21_later_terms"]),
    ("LGPL-3.0-or-later", ["lgpl3_later_terms"]),
    ("LGPL-2.1-or-later", ["lgpl_terms", "version21_later"]),
    ("LGPL-3.0-or-later", ["lgpl_terms", "version3_later"]),
    ("AGPL-3.0-or-later", ["agpl3_later_terms"]),
    ("AGPL-3.0-or-later", ["agpl_terms", "version3_later"]),
    ("GPL-1.0-or-later", ["gpl_terms", "gpl_hope", "gpl_received"]),
    ("MPL-2.0", ["mpl_subject", "mpl2_obtain"]),
    ("ISC", ["isc_grant", "isc_asis"]),
    ("EPL-2.0", ["epl2_notice"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0_dedication"]),
    ("Zlib", ["zlib_asis", "zlib_grant"]),
    ("CC-BY-NC-4.0", ["ccbync_notice"]),
    ("CC-BY-SA-4.0", ["ccbysa_notice"]),
    ("CC-BY-4.0", ["ccby_notice"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary"]),
    ("Proprietary", ["all_rights"]),
]
# Rules that hold back others, as they say more about the same sentence: (held back, by).
HELD_BACK = [("GPL-1.0-or-later", ["GPL-2.0-or-later", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-3.0-only"]), ("Proprietary", ["BSD-3-Clause", "BSD-2-Clause"])]
#: Every known sentence holds one of these; a test asserts it.
KEYS = ("licens", "copyright", "permission", "redistribut", "warrant", "reserved", "gnu general", "public domain", "mozilla")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-case words; sentences end at \\x01, line breaks within them are \\n, all else between words is one space."""
    steps = [
        (r"\r\n?", "\n"),
        (r"[.!?;:]++[\t\n ]++", "\x01"),
        (r"\n[^a-z0-9\x01\n]*+(?=\n)", "\x01"),
        (r"[^a-z0-9\x01\n]++", " "),
        (r" ?([\x01\n]) ?", "$1"),
    ]
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in its order."""
    low = F.translate(text, UPPER + "\x01", LOWER + " ")
    wanted = F.lit(False)
    for key in KEYS:
        wanted = wanted | F.contains(low, F.lit(key))
    forms = sorted(((form, name) for name, of in SENTENCES.items() for form in of), key=lambda x: (-len(x[0]), x))
    whole = "(?<![^\x01\n])(?:" + "|".join(form.replace(" ", "[ \n]") for form, _ in forms) + ")(?![^\x01\n])"

    def known(sentence: Column) -> Column:
        found = F.lit(None).cast("string")
        for form, name in forms:
            found = F.when(sentence == form, F.lit(name)).otherwise(found)
        return found

    ids = F.transform(F.regexp_extract_all(normalised(low), F.lit(whole), F.lit(0)), lambda s: known(F.translate(s, "\n", " ")))
    return F.when(wanted, ids).otherwise(F.array().cast("array<string>"))


def _pattern(rule: list[str]) -> str:
    return ".*".join(f" {x} " for x in rule)


def _before(k: int) -> list[list[str]]:
    """Identifiers of the rules that hold the k-th rule back."""
    name, rule = RULES[k]
    above = [r for _, r in RULES[:k] if set(rule) < set(r)]
    return above + [r for held, by in HELD_BACK if held == name for n, r in RULES if n in by]


def licences(ids: Column) -> Column:
    """The licences whose rule fires, sorted."""
    line = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    fired = []
    for k, (name, rule) in enumerate(RULES):
        fires = line.rlike(_pattern(rule))
        for other in _before(k):
            fires = fires & ~line.rlike(_pattern(other))
        fired.append(F.when(fires, F.lit(name)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*fired))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sentence_ids (array, text order), licences (array)."""
    found = texts(docs, key, text).select("doc_id", identifiers(F.col("text")).alias("sentence_ids"))
    return found.select("doc_id", "sentence_ids", licences(F.col("sentence_ids")).alias("licences"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    """The same in DuckDB, whose patterns cannot look around: line breaks and sentence ends are doubled, so that each neighbour has one of its own."""
    forms = sorted(((form, name) for name, of in SENTENCES.items() for form in of), key=lambda x: (-len(x[0]), x))
    known = " UNION ALL ".join(f"SELECT '{name}' AS id, '{form}' AS form" for form, name in forms)
    whole = "(?:^|[\x01\n])(" + "|".join(form.replace(" ", "(?: |\n\n)") for form, _ in forms) + ")(?:$|[\x01\n])"
    wanted = " OR ".join(f"contains(low, '{key}')" for key in KEYS)

    def fires(k: int) -> str:
        held = "".join(f" AND NOT regexp_matches(line, '{_pattern(other)}')" for other in _before(k))
        return f"CASE WHEN regexp_matches(line, '{_pattern(RULES[k][1])}'){held} THEN '{RULES[k][0]}' END"

    low = "low"
    for pattern, to in ((r"\r\n?", "\n"), (r"[.!?;:]+[\t\n ]+", "\x01"), (r"(?:\n[^a-z0-9\x01\n]*)+\n", "\x01\n"), (r"[^a-z0-9\x01\n]+", " "), (r" ?([\x01\n]) ?", r"\1\1")):
        low = f"regexp_replace({low}, '{pattern}', '{to}', 'g')"
    return f"""
WITH known AS ({known}),
t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}' || chr(1), '{LOWER} ') AS low FROM documents),
n AS (SELECT doc_id, regexp_extract_all(trim({low}, ' '), '{whole}', 1) AS found FROM t WHERE {wanted}),
s AS (SELECT doc_id, unnest(found) AS form, generate_subscripts(found, 1) AS k FROM n),
f AS (SELECT doc_id, list(id ORDER BY k) AS ids FROM s JOIN known ON replace(s.form, '\n\n', ' ') = known.form GROUP BY doc_id),
l AS (
  SELECT d.doc_id, coalesce(ids, []) AS ids, ' ' || coalesce(array_to_string(ids, '  '), '') || ' ' AS line
  FROM documents d LEFT JOIN f USING (doc_id)
)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_sort(list_distinct(list_filter([{", ".join(map(fires, range(len(RULES))))}], lambda x: x IS NOT NULL))), ',') AS licences
FROM l
"""


OP3_SQL = _sql()
