"""Licence scans by sentence rules, in DataFrame functions.

A text is cut into sentences (at line ends, and at ``.``, ``!`` or ``?`` before white
space), each is normalised to lower-case letters and digits, and looked up among the
known licence sentences. The identifiers found, in order, are matched against the
licence rules: the first rule takes every stretch that it matches, later rules what
is left. Unknown sentences between the sentences of a rule do not part them.

Defined cases: null and empty texts have no sentences; texts are read whole;
repeated rows get equal results; extra columns are handed through, except those with
the names of result columns, which are replaced.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framelore.llm.exactdup import LOWER, UPPER, folded

# Sentences of public licences and of the usual notices.
SENTENCES = {
    "mit-title": "The MIT License (MIT)",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache2-head": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ccbync4-notice": "Licensed under CC BY-NC 4.0.",
    "ccby4-notice": "Licensed under CC BY 4.0.",
}
# Fixed values: (licence, identifiers in order). Longer rules come before those they contain.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-keep"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("MIT", ["mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant"]),
    ("Apache-2.0", ["apache2-head", "apache2-copy", "apache2-url"]),
    ("Apache-2.0", ["apache2-head"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("CC-BY-NC-4.0", ["ccbync4-notice"]),
    ("CC-BY-4.0", ["ccby4-notice"]),
    ("ISC", ["isc-grant"]),
]


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence)).strip(" ")


KNOWN = {normal(sentence): name for name, sentence in SENTENCES.items()}


def known_sentences(text: Column) -> Column:
    """The array of (position, id) of known sentences, in order."""
    lines = F.split(F.regexp_replace(folded(text), r"([.!?])[ \t\r\n]+", "$1\n"), "\n")
    plain = F.transform(lines, lambda s, k: F.struct(k.alias("position"), F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")).alias("s")))
    table = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    found = F.filter(plain, lambda x: F.map_contains_key(table, x["s"]))
    return F.transform(found, lambda x: F.struct(x["position"].alias("position"), F.element_at(table, x["s"]).alias("id")))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``sentences`` [(position, id)], ``licenses`` (in order, one for each match) and ``unmatched`` ids."""
    with_ids = docs.withColumn("sentences", known_sentences(F.col(text)))
    rest = F.concat_ws("", F.transform("sentences", lambda x: F.concat(F.lit("<"), x["id"], F.lit(">"))))
    for license_, ids in RULES:
        rest = F.replace(rest, F.lit("".join(f"<{i}>" for i in ids)), F.lit(f"{{{license_}}}"))
    return (with_ids.withColumn("licenses", F.regexp_extract_all(rest, F.lit(r"\{([^}]+)\}"), F.lit(1)))
            .withColumn("unmatched", F.regexp_extract_all(rest, F.lit("<([^>]+)>"), F.lit(1))))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = scan_licenses(docs)
    return got.select("doc_id", F.concat_ws(",", F.transform("sentences", lambda x: F.concat_ws(":", x["position"].cast("string"), x["id"]))).alias("sentences"),
                      F.concat_ws(",", "licenses").alias("licenses"), F.size("unmatched").cast("long").alias("unmatched"))


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{name}')" for s, name in KNOWN.items())
    rest = "coalesce(ids, '')"
    for license_, ids in RULES:
        rest = f"replace({rest}, '{''.join(f'<{i}>' for i in ids)}', '{{{license_}}}')"
    return rf"""
WITH known(s, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS raw, unnest(range(len(lines))) AS k FROM d),
f AS (SELECT r, k, id FROM l JOIN known ON trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) = s),
g AS (SELECT r, string_agg('<' || id || '>', '' ORDER BY k) AS ids, string_agg(k || ':' || id, ',' ORDER BY k) AS listed FROM f GROUP BY r),
m AS (SELECT doc_id, coalesce(listed, '') AS sentences, {rest} AS rest FROM d LEFT JOIN g USING (r))
SELECT doc_id, sentences, array_to_string(regexp_extract_all(rest, '\{{([^}}]+)\}}', 1), ',') AS licenses,
       CAST(len(regexp_extract_all(rest, '<([^>]+)>', 1)) AS BIGINT) AS unmatched
FROM m"""


OP6_SQL = _oracle()
