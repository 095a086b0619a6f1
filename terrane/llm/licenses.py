"""Licence recognition by sentences and rules.

A text is cut into sentences, which are normalised to lower-case words. Lines with an SPDX identifier, a copyright or
a reservation of rights end with the line, and a sentence that names several licences is cut before each further one.
Sentences that speak of licences are mapped to identifiers; the sequence of identifiers of a text is matched against rules in order, each rule a sequence. What a
rule has matched no later rule can use. All of it is column expressions over one row, so nothing moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAD = r"(released|licensed|distributed|available|published|covered|provided|dual licensed|licence|license|use|used|redistributed) (under|by|is|of|are) "
# "+" stands before what goes on after "or" and "and"; normalised words have no such character
_GRANT = r"^(\+ (under )?|(.* )?" + _LEAD + r")(the )?(terms? of (the )?|conditions of (the )?)?(either )?(of )?(the )?"
_SPDX = r"^(\+ |(.* )?spdx license identifier )"
_WITH = r"( with .*)?$"
_END = r"( .*)?$"

# Sentences of public licence texts and notices, as patterns over normalised words. The first that fits counts.
SENTENCES = [
    ("spdx_mit", _SPDX + r"mit$"),
    ("spdx_apache_2", _SPDX + r"apache 2 0" + _WITH),
    ("spdx_agpl_3", _SPDX + r"agpl 3 0( only| or later)?" + _WITH),
    ("spdx_lgpl", _SPDX + r"lgpl [23] [01]( only| or later)?" + _WITH),
    ("spdx_gpl_3", _SPDX + r"gpl 3 0( only| or later)?" + _WITH),
    ("spdx_gpl_2", _SPDX + r"gpl 2 0( only| or later)?" + _WITH),
    ("spdx_bsd_3", _SPDX + r"bsd 3 clause$"),
    ("spdx_bsd_2", _SPDX + r"bsd 2 clause$"),
    ("spdx_mpl_2", _SPDX + r"mpl 2 0$"),
    ("spdx_isc", _SPDX + r"isc$"),
    ("spdx_cc0", _SPDX + r"cc0 1 0$"),
    ("spdx_unlicense", _SPDX + r"unlicense$"),
    ("grant_agpl_3", _GRANT + r"gnu affero general public licen[sc]e" + _END),
    ("grant_lgpl", _GRANT + r"gnu (lesser|library) general public licen[sc]e" + _END),
    ("grant_gpl_2", _GRANT + r"gnu general public licen[sc]e (as published by the free software foundation )?(either )?(version |v)2" + _END),
    ("grant_gpl_3", _GRANT + r"gnu general public licen[sc]e (as published by the free software foundation )?(either )?(version |v)3" + _END),
    ("grant_gpl", _GRANT + r"gnu general public licen[sc]e" + _END),
    ("grant_apache_2", _GRANT + r"apache( licen[sc]e)? (version |v ?)?2 0" + _END),
    ("grant_mpl_2", _GRANT + r"mozilla public licen[sc]e (version |v )?2 0" + _END),
    ("grant_mit", _GRANT + r"mit licen[sc]es?" + _END),
    ("grant_mit", r"^(\+ |(.* )?(licensed|released|distributed|available) under )(either )?(of )?(the )?mit$"),
    ("grant_mit", r"^(.* )?mit licensed" + _END),
    ("grant_bsd_3", _GRANT + r"(3 clause bsd|bsd 3 clause|new bsd|modified bsd) licen[sc]e" + _END),
    ("grant_bsd_2", _GRANT + r"(2 clause bsd|bsd 2 clause|simplified bsd) licen[sc]e" + _END),
    ("grant_bsd", _GRANT + r"bsd( style)? licen[sc]es?" + _END),
    ("grant_isc", _GRANT + r"isc licen[sc]e" + _END),
    ("grant_cc_by_nc_4", _GRANT + r"(a )?(cc|creative commons) (by nc|attribution non ?commercial) 4 0" + _END),
    ("grant_cc_by_sa_4", _GRANT + r"(a )?(cc|creative commons) (by sa|attribution share ?alike) 4 0" + _END),
    ("grant_cc_by_nd_4", _GRANT + r"(a )?(cc|creative commons) (by nd|attribution no ?derivatives) 4 0" + _END),
    ("grant_cc_by_4", _GRANT + r"(a )?(cc|creative commons) (by|attribution) 4 0" + _END),
    ("grant_cc0", _GRANT + r"(cc0|creative commons zero)" + _END),
    ("mit_permission", r"^permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files" + _END),
    ("mit_notice", r"^the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software$"),
    ("mit_warranty", r"^the software is provided as is without warranty of any kind express or implied" + _END),
    ("isc_permission", r"^permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted" + _END),
    ("isc_warranty", r"^the software is provided as is and the author disclaims all warranties" + _END),
    ("bsd_permission", r"^redistribution and use in source and binary forms with or without modification are permitted" + _END),
    ("bsd_source", r"^(.* )?redistributions of source code must retain the above copyright notice" + _END),
    ("bsd_binary", r"^(.* )?redistributions in binary form must reproduce the above copyright notice" + _END),
    ("bsd_name", r"^(.* )?neither the name of .* may be used to endorse or promote products" + _END),
    ("bsd_warranty", r"^this software is provided by the copyright holders and contributors as is" + _END),
    ("apache_obtain", r"^you may obtain a copy of the license at" + _END),
    ("apache_unless", r"^unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis" + _END),
    ("apache_comply", r"^you may not use this file except in compliance with the license$"),
    ("gpl_later", r"^(.* )?either version [23] of the license or at your option any later version$"),
    ("unlicense", r"^this is free and unencumbered software released into the public domain$"),
    ("public_domain", r"^(.* )?(released into|in|dedicated to) the public domain$"),
    ("all_rights", r"^(.* )?all rights reserved$"),
    ("copyright", r"^copyright (c )?([0-9][0-9][0-9][0-9]|by)" + _END),
]
#: Only sentences with one of these words are compared with the patterns.
HINT = r"licen[sc]e|permission|copyright|redistribution|warrant|rights reserved|public domain|neither the name|software is provided|at your option| cc |cc0|creative commons"

_COMMENT = r"[ \t#/*;%-]*"


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: What ends with its line: patterns over the text with a group for what stays together.
LINES = [
    "(" + _any_case("spdx-license-identifier") + r":[^\n]*)",
    r"(?:^|\n)" + _COMMENT + "(" + _any_case("copyright") + r" (?:\([Cc]\) ?|© ?)?[0-9][0-9][0-9][0-9][^\n]*)",
    "(" + _any_case("all rights reserved") + r")[ \t\r.!#/*-]*\n",
]
# Names that go on with a list of licences.
_NEXT = (r" (?:or|and) ((?:under )?(?:the )?(?:terms? of (?:the )?)?(?:mit licen|apache (?:licen|v|2)|gnu (?:general|lesser|library|affero)|mozilla public|isc licen|bsd |"
         r"[23] clause bsd|(?:new|modified|simplified) bsd|creative commons|cc by|cc0))")
_NEXT_SPDX = r" (?:or|and) (mit|apache 2|gpl [23]|lgpl [23]|agpl 3|bsd [23]|mpl 2|isc|cc0 1|unlicense)"

_CUT = r"[.!?]+([ \t\r\n]|$)|\n[ \t\r]*\n"

# Rules in the order in which they are tried, longer ones first.
RULES = [
    ("MIT", ["mit_permission", "mit_notice", "mit_warranty"]),
    ("ISC", ["isc_permission", "isc_warranty"]),
    ("BSD-3-Clause", ["bsd_permission", "bsd_source", "bsd_binary", "bsd_name", "bsd_warranty"]),
    ("BSD-2-Clause", ["bsd_permission", "bsd_source", "bsd_binary", "bsd_warranty"]),
    ("Apache-2.0", ["grant_apache_2", "apache_comply", "apache_obtain", "apache_unless"]),
    ("GPL-3.0-or-later", ["grant_gpl_3", "gpl_later"]),
    ("GPL-2.0-or-later", ["grant_gpl_2", "gpl_later"]),
    ("MIT", ["mit_permission"]), ("MIT", ["grant_mit"]), ("MIT", ["spdx_mit"]),
    ("AGPL-3.0", ["spdx_agpl_3"]), ("LGPL", ["spdx_lgpl"]), ("BSD-2-Clause", ["spdx_bsd_2"]), ("ISC", ["spdx_isc"]), ("CC0-1.0", ["spdx_cc0"]), ("Unlicense", ["spdx_unlicense"]),
    ("Apache-2.0", ["grant_apache_2"]), ("Apache-2.0", ["spdx_apache_2"]),
    ("AGPL-3.0", ["grant_agpl_3"]), ("LGPL", ["grant_lgpl"]),
    ("GPL-3.0", ["grant_gpl_3"]), ("GPL-3.0", ["spdx_gpl_3"]), ("GPL-2.0", ["grant_gpl_2"]), ("GPL-2.0", ["spdx_gpl_2"]), ("GPL", ["grant_gpl"]),
    ("MPL-2.0", ["grant_mpl_2"]), ("MPL-2.0", ["spdx_mpl_2"]),
    ("BSD-3-Clause", ["grant_bsd_3"]), ("BSD-3-Clause", ["spdx_bsd_3"]), ("BSD-2-Clause", ["grant_bsd_2"]), ("BSD", ["grant_bsd"]),
    ("ISC", ["grant_isc"]), ("ISC", ["isc_permission"]),
    ("CC-BY-NC-4.0", ["grant_cc_by_nc_4"]), ("CC-BY-SA-4.0", ["grant_cc_by_sa_4"]), ("CC-BY-ND-4.0", ["grant_cc_by_nd_4"]),
    ("CC-BY-4.0", ["grant_cc_by_4"]), ("CC0-1.0", ["grant_cc0"]),
    ("Unlicense", ["unlicense"]), ("Public-Domain", ["public_domain"]),
    ("All-Rights-Reserved", ["copyright", "all_rights"]), ("All-Rights-Reserved", ["all_rights"]),
]


def sentences(text: Column) -> Column:
    """Normalised sentences that may speak of licences.

    Cut at . ! ? before a blank or the end, at empty lines, around LINES, and before each further licence of a list,
    where a "+" takes the place of "or" and "and".
    """
    text = F.coalesce(text, F.lit(""))
    for line in LINES:
        text = F.regexp_replace(text, line, "\x01$1\x01")
    cut = F.filter(F.split(F.regexp_replace(text, _CUT, "\x01"), "\x01"), lambda s: s != "")
    plain = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " ")))
    told = F.filter(plain, lambda s: F.concat(F.lit(" "), s, F.lit(" ")).rlike(HINT))
    listed = F.transform(told, lambda s: F.when(s.contains("spdx license identifier "), F.regexp_replace(s, _NEXT_SPDX, "\x01+ $1"))
                         .when(s.rlike(_LEAD), F.regexp_replace(s, _NEXT, "\x01+ $1")).otherwise(s))
    return F.flatten(F.transform(listed, lambda s: F.split(s, "\x01")))


def identifiers(normal: Column) -> Column:
    """The identifiers of known sentences in order; unknown ones are left out."""
    def known(s: Column) -> Column:
        out = F.when(s.rlike(SENTENCES[0][1]), SENTENCES[0][0])
        for name, pattern in SENTENCES[1:]:
            out = out.when(s.rlike(pattern), name)
        return out

    return F.filter(F.transform(normal, known), lambda s: s.isNotNull())


def matched(ids: Column) -> Column:
    """The sequence after all rules: <licence> where a rule matched, identifiers where none did."""
    out = F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))
    for licence, rule in RULES:
        out = F.replace(out, F.lit("," + ",,".join(rule) + ","), F.lit(f",<{licence}>,"))
    return F.filter(F.split(out, ","), lambda s: s != "")


def scanned(docs: DataFrame, text: str = "text", out: str = "_licences") -> DataFrame:
    """`docs` with a struct: `sentences` (identifiers in order), `licences` (by rule, in order) and `unmatched` identifiers.

    Null and empty texts and texts without a known sentence: empty lists. Long texts are read whole; a licence that
    stands several times is listed as often. Repeated rows get equal results; an empty table gives no rows. Other
    columns pass through; a column `out` of `docs` is replaced.
    """
    docs = docs.drop(out)
    # most texts hold no hint at all and stop here
    found = F.when(F.lower(F.col(f"`{text}`")).rlike(HINT.replace(" cc ", "(^|[^a-z0-9])cc([^a-z0-9]|$)").replace(" ", "[^a-z0-9]+")), sentences(F.col(f"`{text}`"))).otherwise(F.array().cast("array<string>"))
    return (docs.withColumn(out, identifiers(found)).withColumn(out, F.struct(F.col(out).alias("sentences"), matched(F.col(out)).alias("marks")))
            .withColumn(out, F.struct(F.col(out)["sentences"].alias("sentences"),
                                      F.transform(F.filter(F.col(out)["marks"], lambda s: s.startswith("<")), lambda s: F.regexp_replace(s, "[<>]", "")).alias("licences"),
                                      F.filter(F.col(out)["marks"], lambda s: ~s.startswith("<")).alias("unmatched"))))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    case = " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{n}'" for n, p in SENTENCES)
    marks = "',' || array_to_string(ids, ',,') || ','"
    for licence, rule in RULES:
        marks = f"replace({marks}, ',{',,'.join(rule)},', ',<{licence}>,')"
    lines = "coalesce(text, '')"
    for line in LINES:
        lines = f"regexp_replace({lines}, '{line}', chr(1) || '\\1' || chr(1), 'g')"
    return rf"""
WITH s AS (
  SELECT doc_id, list_transform(string_split(regexp_replace({lines}, '{_CUT}', chr(1), 'g'), chr(1)),
    lambda x: trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))) AS plain FROM documents
), t AS (
  SELECT doc_id, list_filter(plain, lambda s: regexp_matches(' ' || s || ' ', '{HINT}')) AS told FROM s
), l AS (
  SELECT doc_id, flatten(list_transform(told, lambda s: string_split(CASE
    WHEN contains(s, 'spdx license identifier ') THEN regexp_replace(s, '{_NEXT_SPDX}', chr(1) || '+ \1', 'g')
    WHEN regexp_matches(s, '{_LEAD}') THEN regexp_replace(s, '{_NEXT}', chr(1) || '+ \1', 'g') ELSE s END, chr(1)))) AS listed FROM t
), i AS (
  SELECT doc_id, list_filter(list_transform(listed, lambda s: CASE {case} END), lambda s: s IS NOT NULL) AS ids FROM l
), m AS (SELECT doc_id, ids, list_filter(string_split({marks}, ','), lambda x: x <> '') AS marks FROM i)
SELECT doc_id, array_to_string(ids, ',') AS sentences, array_to_string(list_transform(list_filter(marks, lambda x: x[1] = '<'), lambda x: replace(replace(x, '<', ''), '>', '')), ',') AS licences,
       CAST(len(list_filter(marks, lambda x: x[1] <> '<')) AS BIGINT) AS n_unmatched
FROM m
"""
