"""Licence recognition by sentences and rules, with column expressions only.

A text is cut into sentences; those that speak of rights are normalised and mapped to identifiers
of known licence sentences; the row of identifiers is then matched against licence rules in their
order, longer ones first. What a rule matches is used up, so a notice is not counted again as one
of its parts. All of it happens inside a row: there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import named, table

# Identifiers of licence sentences and what their normalised form matches.
# Normalised: lower case, everything but letters and digits one blank.
SENTENCES = [
    ("spdx", r"^(.* )?spdx license identifier [a-z0-9 ]+$"),
    ("apache-2.0", r"\bapache (software )?license,? version 2( 0)?\b|\bapache 2( 0)?\b.*licen[cs]e"),
    ("apache-copy", r"you may not use this file except in compliance with the license"),
    ("agpl-3.0", r"\b(gnu )?affero general public license\b"),
    ("lgpl-3.0", r"\blesser general public license\b.*\bversion 3\b"),
    ("lgpl-2.1", r"\blesser general public license\b.*\bversion 2 1\b"),
    ("gpl-3.0", r"\bgnu general public license\b.*\b(version|v) ?3\b"),
    ("gpl-2.0", r"\bgnu general public license\b.*\b(version|v) ?2\b"),
    ("gpl-later", r"^(or )?at your option any later version$"),
    ("mpl-2.0", r"\bmozilla public license\b.*\b2 0\b"),
    ("epl-2.0", r"\beclipse public license\b.*\b2 0\b"),
    ("cc-by-nc-4.0", r"\bcc by nc 4 0\b|\bcreative commons attribution non ?commercial 4 0\b"),
    ("cc-by-sa-4.0", r"\bcc by sa 4 0\b|\bcreative commons attribution share ?alike 4 0\b"),
    ("cc-by-4.0", r"\bcc by 4 0\b|\bcreative commons attribution 4 0\b"),
    ("cc0-1.0", r"\bcc0( 1 0)?\b"),
    ("mit-ref", r"\b(the )?mit licen[cs]e\b"),
    ("bsd-ref", r"\bbsd( 3 clause)? licen[cs]e\b"),
    ("isc-grant", r"^permission to use copy modify and or distribute this software for any purpose"),
    ("mit-grant", r"^permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", r"^the above copyright notice and this permission notice shall be included"),
    ("bsd-intro", r"^redistribution and use in source and binary forms with or without modification"),
    ("bsd-source", r"^(\d )?redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"^(\d )?redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-names", r"^(\d )?neither the names? of .* may be used to endorse or promote products"),
    ("as-is", r"^(this|the) software is provided .*as is\b"),
    ("public-domain", r"\b(released|dedicated|placed) (in)?to the public domain\b|\bis in the public domain\b"),
    ("all-rights", r"^all rights reserved$"),
    ("copyright", r"^copyright\b"),
]
# Rules in their order, a row of sentence identifiers and its licence.
RULES = [
    (("bsd-intro", "bsd-source", "bsd-binary", "bsd-names", "as-is"), "BSD-3-Clause"),
    (("bsd-intro", "bsd-source", "bsd-binary", "as-is"), "BSD-2-Clause"),
    (("mit-grant", "mit-notice", "as-is"), "MIT"),
    (("mit-ref", "mit-grant", "mit-notice"), "MIT"),
    (("apache-2.0", "apache-copy"), "Apache-2.0"),
    (("isc-grant", "as-is"), "ISC"),
    (("gpl-3.0", "gpl-later"), "GPL-3.0-or-later"),
    (("gpl-2.0", "gpl-later"), "GPL-2.0-or-later"),
    (("copyright", "all-rights"), "Proprietary"),
    (("apache-2.0",), "Apache-2.0"),
    (("agpl-3.0",), "AGPL-3.0"),
    (("lgpl-3.0",), "LGPL-3.0"),
    (("lgpl-2.1",), "LGPL-2.1"),
    (("gpl-3.0",), "GPL-3.0"),
    (("gpl-2.0",), "GPL-2.0"),
    (("mpl-2.0",), "MPL-2.0"),
    (("epl-2.0",), "EPL-2.0"),
    (("cc-by-nc-4.0",), "CC-BY-NC-4.0"),
    (("cc-by-sa-4.0",), "CC-BY-SA-4.0"),
    (("cc-by-4.0",), "CC-BY-4.0"),
    (("cc0-1.0",), "CC0-1.0"),
    (("mit-ref",), "MIT"),
    (("bsd-ref",), "BSD-3-Clause"),
    (("isc-grant",), "ISC"),
    (("public-domain",), "Public-Domain"),
    (("all-rights",), "Proprietary"),
]
# Sentences without any of these are none of the known ones.
HINT = r"licen[cs]e|copyright|permission|redistribution|rights reserved|public domain|spdx|as is|cc by|cc0|later version|neither the name"
TEXT_HINT = r"(?i)licen[cs]e|copyright|permission|redistribution|rights.reserved|public.domain|spdx|as.is|cc.by|cc0|later.version|neither.the.name"
# A sentence ends at a line break, or at a full stop, exclamation or question mark before white space.
END = r"([.!?])[ \t\r\f]+"

# The SQL check is made of the lists above; what follows adds to them standard notices it cannot cut.
# Rules that go before the others.
MORE_RULES = [
    (("agpl-3.0", "gpl-later"), "AGPL-3.0-or-later"),
    (("lgpl-3.0", "gpl-later"), "LGPL-3.0-or-later"),
    (("lgpl-2.1", "gpl-later"), "LGPL-2.1-or-later"),
]
COMMENT = r"[ \t]*(?:(?:/\*+|//+|#+|\*+|--+|;+|dnl)[ \t]+)?"
NAME_WORDS = "GNU|General|Lesser|Affero|Public|Licen[cs]e|Free|Software|Foundation|Mozilla|Eclipse|Apache|MIT|BSD|Creative|Commons|Version"
# What is rewritten, in this order, before a text is cut.
FORMS = [
    (r"(?i)(spdx-license-identifier\s*:[^\n]*[^\n.])(?=\n)", "$1."),
    # A single line break inside a sentence: lower case, a word of a licence's name or all capitals go on.
    (rf"([^.!?:;\s])[ \t\r\f]*\n{COMMENT}(?=[a-z(]|\d+(?:\.\d+)+\b|(?:{NAME_WORDS})\b(?! [Ll]icen[cs]e[ \t\r]*\n))", "$1 "),
    (r"([A-Z]{2},?\"?)[ \t\r\f]*\n" + COMMENT + r"(?=\"?[A-Z]{2,}[ ,\"])", "$1 "),
    (r"(?i)\bv(?:er)?\.\s*(?=\d)", "version "),
    (r"(?i)\b(licen[cs]e[\s,(-]*)v(?=\d)", "$1version "),
    (r"(?i)\b((?:mozilla|eclipse)\s+public\s+licen[cs]e[\s,(-]*(?:version\s+)?2)(?!\d|\.\d)", "$1.0"),
    # The later versions of a notice are a sentence of their own.
    (r"(?i),?\s+or,?\s+\(?at\s+your\s+option\)?,?\s+any\s+later\s+version\b", "\nor at your option any later version\n"),
]
SPDX_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
SPDX = rf"(?i)spdx-license-identifier\s*:\s*(\(*{SPDX_ID}\)*(?:\s+(?:AND|OR|WITH)\s+\(*{SPDX_ID}\)*)*)"


def _spdx_names(expression: Column) -> Column:
    """Licences of an SPDX expression, under the names of the rules; others as they are written."""
    known = {name.lower(): name for _, name in RULES + MORE_RULES}
    for name in [n for n in known.values() if "GPL" in n and "later" not in n]:
        known |= {f"{name}-only".lower(): name, f"{name}+".lower(): f"{name}-or-later", f"{name}-or-later".lower(): f"{name}-or-later"}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    parts = F.split(F.regexp_replace(expression, r"(?i)\s+WITH\s+[^\s()]+|[()]", ""), r"(?i)\s+(?:AND|OR)\s+", -1)
    return F.transform(parts, lambda x: F.coalesce(F.element_at(names, F.lower(F.trim(x))), F.trim(x)))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in their order; that of an SPDX line is
    ``spdx:`` and its expression."""
    # Line breaks and comment signs may stand between the words of a hint.
    some = text.rlike(TEXT_HINT.replace(".", r"[\W_]+"))
    formed = text
    for pattern, form in FORMS:
        formed = F.regexp_replace(formed, pattern, form)
    sentences = F.split(F.regexp_replace(formed, END, "$1\n"), "\n", -1)
    normal = F.transform(sentences, lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))

    def known(sentence: Column) -> Column:
        chain = F.when(~sentence.rlike(HINT), F.lit(""))
        for name, pattern in SENTENCES:
            chain = chain.when(sentence.rlike(pattern), F.lit(name))
        return chain.otherwise("")

    def carried(name: Column, i: Column) -> Column:
        expression = F.regexp_extract(F.get(sentences, i), SPDX, 1)
        spdx = F.when(expression != "", F.concat(F.lit("spdx:"), expression)).otherwise(name)
        return F.when(name == "spdx", spdx).otherwise(name)

    found = F.filter(F.transform(F.transform(normal, known), carried), lambda s: s != "")
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


def matched(ids: Column) -> Column:
    """Struct of a row of identifiers: the licences by rule order, and what no rule uses."""
    rules = F.array(*[F.struct(F.lit(f",{','.join(seq)},").alias("seq"), F.lit(name).alias("name")) for seq, name in MORE_RULES + RULES])
    # ",," between identifiers lets neighbours be matched without sharing a comma.
    # SPDX lines say their licences themselves, before all rules.
    spdx = F.filter(ids, lambda s: F.startswith(s, F.lit("spdx:")))
    others = F.transform(ids, lambda s: F.when(F.startswith(s, F.lit("spdx:")), F.lit("|")).otherwise(s))
    begin = F.struct(
        F.concat(F.lit(","), F.array_join(others, ",,"), F.lit(",")).alias("rest"),
        F.array_distinct(F.flatten(F.transform(spdx, lambda s: _spdx_names(F.substring(s, F.lit(6), F.length(s)))))).alias("names"),
    )

    def apply(state: Column, rule: Column) -> Column:
        seq = F.replace(F.substring(rule["seq"], F.lit(2), F.length(rule["seq"]) - 2), F.lit(","), F.lit(",,"))
        seq = F.concat(F.lit(","), seq, F.lit(","))
        hit = F.contains(state["rest"], seq)
        return F.struct(
            F.when(hit, F.replace(state["rest"], seq, F.lit("|"))).otherwise(state["rest"]).alias("rest"),
            F.when(hit, F.array_union(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"),
        )

    return F.aggregate(rules, begin, apply)


def scan_licenses(docs: DataFrame, text_col: str = "text", result_col: str = "licenses") -> DataFrame:
    """``docs`` with a struct ``result_col``: sentences (identifiers in order), licenses (names by
    rule order, each once) and n_unmatched (identifiers that no rule uses).

    Null and empty texts have no sentences. A column of that name is replaced.
    """
    ids = sentence_ids(F.coalesce(named(text_col).cast("string"), F.lit("")))
    scanned = docs.withColumn(result_col, ids)
    ids = named(result_col)
    state = F.when(F.size(ids) > 0, matched(ids))
    rest = F.filter(F.split(F.replace(state["rest"], F.lit("|"), F.lit(",")), ","), lambda s: s != "")
    return scanned.withColumn(
        result_col,
        F.struct(
            ids.alias("sentences"),
            F.coalesce(state["names"], F.array().cast("array<string>")).alias("licenses"),
            F.coalesce(F.size(rest), F.lit(0)).cast("long").alias("n_unmatched"),
        ),
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = F.col("r")
    return scan_licenses(docs, result_col="r").select(
        "doc_id",
        F.size(r["sentences"]).cast("long").alias("n_sentences"),
        F.array_join(r["sentences"], ",").alias("sentence_ids"),
        F.array_join(r["licenses"], ",").alias("licenses"),
        r["n_unmatched"].alias("n_unmatched"),
    )


def op8_sql() -> str:
    """The same in SQL: one step for each rule."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN {quoted(name)}" for name, p in SENTENCES)
    steps, before = [], "r0"
    for k, (seq, name) in enumerate(RULES, 1):
        mark = quoted("," + ",,".join(seq) + ",")
        steps.append(
            f"r{k} AS (SELECT doc_id, ids, replace(rest, {mark}, '|') AS rest, CASE WHEN contains(rest, {mark}) "
            f"AND NOT list_contains(names, {quoted(name)}) THEN list_append(names, {quoted(name)}) ELSE names END AS names FROM {before})"
        )
        before = f"r{k}"
    return f"""
WITH n AS (SELECT doc_id, pos, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS s
           FROM (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS raw
                 FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), {quoted(END)}, '\\1' || chr(10), 'g'), chr(10)) AS p FROM documents))),
k AS (SELECT doc_id, pos, CASE WHEN NOT regexp_matches(s, {quoted(HINT)}) THEN '' {cases} ELSE '' END AS id FROM n),
r0 AS (SELECT doc_id, list(id ORDER BY pos) AS ids, ',' || string_agg(id, ',,' ORDER BY pos) || ',' AS rest,
              CAST([] AS VARCHAR[]) AS names FROM k WHERE id <> '' GROUP BY doc_id),
{", ".join(steps)}
SELECT d.doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(names, ','), '') AS licenses,
       CAST(coalesce(len(list_filter(string_split(replace(rest, '|', ','), ','), lambda x: x <> '')), 0) AS BIGINT) AS n_unmatched
FROM documents d LEFT JOIN {before} USING (doc_id)
"""
