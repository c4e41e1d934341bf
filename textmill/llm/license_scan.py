"""License scans by sentence-rule recognition (German, Manabe and Inoue, 2010).

A text is normalised (lower case, comment marks, quotes and commas dropped, British spelling made
American) and cut into sentences.  Sentences are mapped to the identifiers of known licence sentences:
all that occur in a sentence, from left to right; at each place the first entry of ``SENTENCES`` that
fits is taken.  The sequence of identifiers is then matched against the rules from its first
identifier on: at each place the first rule of the list that fits is taken and its identifiers are
used up; an identifier that begins no rule is skipped.  A licence text that lacks a required sentence is thus not
reported as that licence but as ``unknown``.

All of it is Column expressions in one narrow pass: no shuffle, no Python.  The tables are constants.

Defined results: documents without a known sentence (null, empty and wordless texts too) have no row;
repeated rows and rows with a null doc_id each have a row of their own; a licence that a document
states several times is named once; texts are scanned whole; other columns are ignored.  Documents
are sieved by ``NEEDED`` first, of which every expression has a word, so the sieve loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every expression of ``SENTENCES`` needs one of these: without them a document states no licence.
#: All are letters and digits, so that only quotes (which cleaning drops) can part them in a text.
NEEDED = (
    r"licen|spdx|cc0|\bcc\b|creative|waive|attribution|applicable|gpl|warranty|permission|provided|event|redistribut|endorse"
    r"|advertising|bsd|mpl|unencumbered|domain|wtfpl|altered|rights|copyright|copying"
)

#: (identifier, expression over a normalised sentence); the first that occurs names the sentence.
SENTENCES: list[tuple[str, str]] = [
    ("SpdxMit", r"spdx-license-identifier: ?mit\b"),
    ("SpdxApache2", r"spdx-license-identifier: ?apache-2\.0\b"),
    ("SpdxGpl3", r"spdx-license-identifier: ?gpl-3\.0"),
    ("SpdxGpl2", r"spdx-license-identifier: ?gpl-2\.0"),
    ("SpdxLgpl", r"spdx-license-identifier: ?lgpl-"),
    ("SpdxBsd3", r"spdx-license-identifier: ?bsd-3-clause\b"),
    ("SpdxBsd2", r"spdx-license-identifier: ?bsd-2-clause\b"),
    ("SpdxMpl2", r"spdx-license-identifier: ?mpl-2\.0"),
    ("SpdxOther", r"spdx-license-identifier: ?[a-z0-9]"),
    ("CcZero", r"\bcc0\b|creative commons zero|waive[sd]? all copyright"),
    ("CcByNcSa", r"\bcc[ -]by-nc-sa\b|attribution-noncommercial-sharealike"),
    ("CcByNcNd", r"\bcc[ -]by-nc-nd\b|attribution-noncommercial-noderiv"),
    ("CcByNc", r"\bcc[ -]by-nc\b|attribution-noncommercial"),
    ("CcBySa", r"\bcc[ -]by-sa\b|attribution-sharealike"),
    ("CcByNd", r"\bcc[ -]by-nd\b|attribution-noderiv"),
    ("CcBy", r"\bcc[ -]by\b|creative commons attribution"),
    ("ApacheObtain", r"you may obtain a copy of the license at"),
    ("ApacheUnless", r"unless required by applicable law or agreed to in writing"),
    ("ApacheGoverning", r"see the license for the specific language governing permissions"),
    ("ApacheMayNotUse", r"you may not use this (?:file|software|work) except in compliance with the license"),
    ("Apache2", r"\bapache license,? ?(?:version )?2(?:\.0)?\b|\bapache software license version 2"),
    ("LgplVersion", r"\b(?:gnu )?(?:lesser|library) general public license\b|\blgpl"),
    ("AgplVersion", r"\baffero general public license\b|\bagpl"),
    ("GplWarranty", r"without even the implied warranty of merchantability"),
    ("GplReceived", r"you should have received a copy of the gnu general public license"),
    ("Gpl3OrLater", r"(?:gnu general public license|gnu gpl|\bgpl).*(?:version ?3|\bv3|-3\.0).*(?:any later|or later)"),
    ("Gpl2OrLater", r"(?:gnu general public license|gnu gpl|\bgpl).*(?:version ?2|\bv2|-2\.0).*(?:any later|or later)"),
    ("Gpl3", r"(?:gnu general public license|gnu gpl|\bgpl).*(?:version ?3|\bv3|-3\.0)"),
    ("Gpl2", r"(?:gnu general public license|gnu gpl|\bgpl).*(?:version ?2|\bv2|-2\.0)"),
    ("GplAny", r"gnu general public license|gnu gpl"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MitNotice", r"(?:above copyright notice|notice) and this permission notice shall be included in all copies"),
    ("IscGrant", r"permission to use copy modify and/?(?:or)? distribute this software for any purpose"),
    ("AsIs", r"\bprovided (?:by .{1,80})?as[ -]is\b"),
    ("NoLiability", r"in no event shall|in no event will"),
    ("BsdConditions", r"redistribution and use in source and binary forms"),
    ("BsdSource", r"redistributions? of source code must retain"),
    ("BsdBinary", r"redistributions? in binary form must reproduce"),
    ("BsdEndorse", r"may be used to endorse or promote products"),
    ("BsdAdvertise", r"all advertising materials mentioning features"),
    ("Mit", r"\bmit license\b|\bmit-licensed?\b|\blicense: ?mit\b"),
    ("IscName", r"\bisc license\b"),
    ("Bsd3Name", r"\b(?:bsd 3-clause|3-clause bsd|new bsd|modified bsd)\b"),
    ("Bsd2Name", r"\b(?:bsd 2-clause|2-clause bsd|simplified bsd)\b"),
    ("BsdName", r"\bbsd(?:-style)? license\b"),
    ("Mpl2", r"\bmozilla public license.{0,20}2\.0|\bmpl[ -]2\.0"),
    ("Epl", r"\beclipse public license\b"),
    ("Unlicense", r"free and unencumbered software released into the public domain|\bthe unlicense\b"),
    ("PublicDomain", r"\b(?:in|into|to) the public domain\b"),
    ("Wtfpl", r"\bdo what the fuck you want to public license\b|\bwtfpl\b"),
    ("Boost", r"\bboost software license\b"),
    ("Zlib", r"\bzlib license\b|altered source versions must be plainly marked"),
    ("AllRights", r"\ball rights reserved\b"),
    ("CopyrightLine", r"\bcopyright\b.{0,20}\b(?:19|20)[0-9]{2}\b|\bcopyright c\b"),
    ("SeeFile", r"see (?:the )?(?:file )?(?:license|copying)(?:\.txt|\.md)?\b"),
]

#: Forms for finding several identifiers in a sentence, where an expression would use up others' words.
_HEADS = {name: "(?=.*".join(e.split(".*", 1)) + ")" for name, e in SENTENCES if ".*" in e} | {
    "CcBy": r"\bcc[ -]by\b|creative commons attribution(?!-(?:noncommercial|sharealike|noderiv))",
    "AsIs": r"\bprovided (?=(?:by .{1,80})?as[ -]is\b)",
    "Mpl2": r"\bmozilla public license(?=.{0,20}2\.0)|\bmpl[ -]2\.0",
    "CopyrightLine": r"\bcopyright\b(?=.{0,20}\b(?:19|20)[0-9]{2}\b)|\bcopyright c\b",
}
_ALTERNATIVES = "(?s)" + "|".join(f"(?<{name}>{_HEADS.get(name, e)})" for name, e in SENTENCES)

#: (licence, identifiers in order); at each place the first rule that fits is taken.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("Apache2", "ApacheMayNotUse", "ApacheObtain", "ApacheUnless", "ApacheGoverning")),
    ("Apache-2.0", ("Apache2", "ApacheMayNotUse", "ApacheObtain")),
    ("Apache-2.0", ("Apache2",)),
    ("BSD-4-Clause", ("BsdConditions", "BsdSource", "BsdBinary", "BsdAdvertise", "BsdEndorse")),
    ("BSD-3-Clause", ("BsdConditions", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-3-Clause", ("BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdConditions", "BsdSource", "BsdBinary")),
    ("BSD-2-Clause", ("BsdSource", "BsdBinary")),
    ("MIT", ("Mit", "CopyrightLine", "MitGrant", "MitNotice", "AsIs", "NoLiability")),
    ("MIT", ("MitGrant", "MitNotice", "AsIs", "NoLiability")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("MIT", ("Mit",)),
    ("ISC", ("IscGrant", "AsIs", "NoLiability")),
    ("ISC", ("IscGrant", "AsIs")),
    ("ISC", ("IscName",)),
    ("GPL-3.0-or-later", ("Gpl3OrLater", "GplWarranty", "GplReceived")),
    ("GPL-3.0-or-later", ("Gpl3OrLater",)),
    ("GPL-2.0-or-later", ("Gpl2OrLater", "GplWarranty", "GplReceived")),
    ("GPL-2.0-or-later", ("Gpl2OrLater",)),
    ("GPL-3.0", ("Gpl3", "GplWarranty", "GplReceived")),
    ("GPL-3.0", ("Gpl3",)),
    ("GPL-2.0", ("Gpl2", "GplWarranty", "GplReceived")),
    ("GPL-2.0", ("Gpl2",)),
    ("GPL", ("GplAny",)),
    ("LGPL", ("LgplVersion", "GplWarranty", "LgplVersion")),
    ("LGPL", ("LgplVersion",)),
    ("AGPL", ("AgplVersion", "GplWarranty", "AgplVersion")),
    ("AGPL", ("AgplVersion",)),
    ("MPL-2.0", ("Mpl2",)),
    ("EPL", ("Epl",)),
    ("Unlicense", ("Unlicense",)),
    ("WTFPL", ("Wtfpl",)),
    ("BSL-1.0", ("Boost",)),
    ("Zlib", ("Zlib",)),
    ("BSD-3-Clause", ("Bsd3Name",)),
    ("BSD-2-Clause", ("Bsd2Name",)),
    ("BSD", ("BsdName",)),
    ("CC0-1.0", ("CcZero",)),
    ("CC-BY-NC-SA", ("CcByNcSa",)),
    ("CC-BY-NC-ND", ("CcByNcNd",)),
    ("CC-BY-NC", ("CcByNc",)),
    ("CC-BY-SA", ("CcBySa",)),
    ("CC-BY-ND", ("CcByNd",)),
    ("CC-BY", ("CcBy",)),
    ("MIT", ("SpdxMit",)),
    ("Apache-2.0", ("SpdxApache2",)),
    ("GPL-3.0", ("SpdxGpl3",)),
    ("GPL-2.0", ("SpdxGpl2",)),
    ("LGPL", ("SpdxLgpl",)),
    ("BSD-3-Clause", ("SpdxBsd3",)),
    ("BSD-2-Clause", ("SpdxBsd2",)),
    ("MPL-2.0", ("SpdxMpl2",)),
    ("public domain", ("PublicDomain",)),
    ("all rights reserved", ("CopyrightLine", "AllRights")),
    ("all rights reserved", ("AllRights",)),
]

#: Replacements that normalise a text, in order; the last one marks the ends of sentences.
_QUOTES = r"[\"'`,()\x{201C}\x{201D}\x{2018}\x{2019}]"
_CLEAN: list[tuple[str, str]] = [
    (r"\n[ \t]*[/*#;%!-]+[ \t]*", "\n"),
    (_QUOTES, ""),
    (r"licence", "license"),
    (r"\bver?\. ?([0-9])", "version $1"),
    (r"\n[ \t\r]*\n", "\x01"),
    (r"([.!?])[ \t\r\n]+", "$1\x01"),
    (r"\n[ \t]*spdx-", "\x01spdx-"),
    (r"[ \t\r\n]+", " "),
]


def sentences(text: Column) -> Column:
    """Normalised sentences of a text."""
    clean = F.concat(F.lit("\n"), F.lower(text))
    for old, new in _CLEAN:
        clean = F.regexp_replace(clean, F.lit(old), F.lit(new))
    return F.split(clean, "\x01")


def identifiers(sentence: Column) -> Column:
    """Identifiers in a normalised sentence, from left to right."""
    # each find becomes all names, each with the words its own alternative took; sentences have no capitals
    marks = "".join(f"{name}\x03${{{name}}}\x04" for name, _ in SENTENCES)
    marked = F.regexp_replace(sentence, F.lit(_ALTERNATIVES), F.lit(marks))
    return F.regexp_extract_all(marked, F.lit("([A-Z][A-Za-z0-9]*)\x03[^\x04]"), F.lit(1))


#: Rules of the scan: also the GPL's usual header, which names the licence again between two sentences.
_SCAN_RULES = [
    (f"GPL-{v}.0{later}", (f"Gpl{v}{name}", "GplWarranty", "GplAny", "GplReceived")) for v in (3, 2) for later, name in (("-or-later", "OrLater"), ("", ""))
] + RULES


def _rule_expression(rules: list[tuple[str, tuple[str, ...]]]) -> str:
    return "|".join("".join(f"<{x}>" for x in rule) for _, rule in rules)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, sentence_ids, n_sentences) of every document with a known licence sentence.

    ``licenses``: names in alphabetical order between semicolons, ``unknown`` if no rule fits.
    """
    # the first pass keeps the expensive cleaning away from documents in which no expression can occur
    rows = docs.where(F.regexp_replace(F.lower("text"), F.lit(_QUOTES), F.lit("")).rlike(NEEDED))
    known = F.filter(F.transform(sentences(F.col("text")), identifiers), lambda x: F.size(x) > 0)
    named = rows.select("doc_id", known.alias("known")).where(F.size("known") > 0)
    named = named.select("doc_id", F.flatten("known").alias("ids"), F.size("known").cast("bigint").alias("n_sentences"))
    sequence = F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))
    parts = F.regexp_extract_all(sequence, F.lit(_rule_expression(_SCAN_RULES)), F.lit(0))
    names = F.create_map(*[F.lit(x) for licence, rule in _SCAN_RULES for x in ("".join(f"<{i}>" for i in rule), licence)])
    licences = F.array_join(F.array_sort(F.array_distinct(F.transform(parts, lambda p: names[p]))), ";")
    out = named.select("doc_id", licences.alias("licenses"), F.array_join("ids", ",").alias("sentence_ids"), "n_sentences")
    return out.withColumn("licenses", F.when(F.col("licenses") == "", "unknown").otherwise(F.col("licenses")))


#: For the SQL, whose expressions can't look ahead: the words that a find of an expression uses up ...
_USED = {name: e.split(".*", 1)[0] for name, e in SENTENCES if ".*" in e} | {
    "CcBy": r"\bcc[ -]by\b|creative commons attribution",
    "AsIs": r"\bprovided ",
    "Mpl2": r"\bmozilla public license|\bmpl[ -]2\.0",
    "CopyrightLine": r"\bcopyright\b",
}
#: ... and what an expression must not be followed by.
_UNLESS = {"CcBy": r"creative commons attribution-(?:noncommercial|sharealike|noderiv)"}


def oracle_sql() -> str:
    """The same by DuckDB over all of ``documents``, one find after the other by a recursive query."""

    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    clean = "chr(10) || lower(text)"
    for old, new in _CLEAN:
        clean = f"regexp_replace({clean}, {quote(old)}, {quote(new.replace('$1', chr(92) + '1'))}, 'g')"
    used = {name: _USED.get(name, e) for name, e in SENTENCES}
    heads = "|".join(f"(?:{e})" for e in used.values())

    # a rest begins with the character before it, for the word boundaries
    def fits(name: str, e: str) -> str:
        test = f"regexp_matches(t, {quote(f'(?s)^.(?:{e})')})"
        return test + (f" AND NOT regexp_matches(t, {quote(f'(?s)^.(?:{_UNLESS[name]})')})" if name in _UNLESS else "")

    case = " ".join(f"WHEN {fits(n, e)} THEN {quote(n)}" for n, e in SENTENCES)
    length = " ".join(f"WHEN {quote(n)} THEN length(regexp_extract(t, {quote(f'(?s)^.({e})')}, 1))" for n, e in used.items())
    seen: dict[str, str] = {}
    for licence, rule in _SCAN_RULES:
        seen.setdefault("".join(f"<{i}>" for i in rule), licence)
    name = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in seen.items())
    begin = f"regexp_extract(rest, {quote(f'(?s)^(.*?).(?:{heads})')}, 1)"
    return f"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS r, doc_id, string_split({clean}, chr(1)) AS parts
  FROM documents WHERE text IS NOT NULL),
each AS (
  SELECT r, doc_id, t.i, ' ' || parts[t.i] AS s FROM cut, unnest(range(1, len(parts) + 1)) AS t(i)),
finds AS (
  SELECT r, i, 0 AS k, s AS rest, NULL::VARCHAR AS id FROM each WHERE regexp_matches(s, {quote(f'(?s).(?:{heads})')})
  UNION ALL
  SELECT r, i, k + 1, substr(t, CASE WHEN id IS NULL THEN 2 ELSE 1 + CASE id {length} END END), id
  FROM (SELECT r, i, k, t, CASE {case} END AS id
        FROM (SELECT r, i, k, substr(rest, 1 + length({begin})) AS t
              FROM finds WHERE regexp_matches(rest, {quote(f'(?s).(?:{heads})')})))),
named AS (SELECT r, i, k, id FROM finds WHERE id IS NOT NULL),
lists AS (
  SELECT r, string_agg(id, ',' ORDER BY i, k) AS ids, count(DISTINCT i) AS n FROM named GROUP BY r),
found AS (
  SELECT r, unnest(regexp_extract_all('<' || replace(ids, ',', '><') || '>', {quote(_rule_expression(_SCAN_RULES))})) AS part FROM lists),
names AS (
  SELECT r, string_agg(DISTINCT name, ';' ORDER BY name) AS licenses
  FROM (SELECT r, CASE part {name} END AS name FROM found) GROUP BY r)
SELECT doc_id, coalesce(licenses, 'unknown') AS licenses, ids AS sentence_ids, n AS n_sentences
FROM lists JOIN cut USING (r) LEFT JOIN names USING (r)"""
