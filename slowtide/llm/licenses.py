"""Licence scans by sentence rules, as DataFrame expressions.

A text is divided into sentences; a sentence is normalised (lower case, words
only) and mapped to the identifiers of the known licence sentences it holds. The
sequence of identifiers is then matched against the licence rules in their
order: a rule names identifiers that must follow each other, other identifiers
may come between, and what a rule matched is gone for later rules. So the
rules of long licences come before those of sentences they share.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, normalised, by identifier. Every
# sentence holds one of the words of TRIGGERS.
SENTENCES = {
    "apache-mention": "licensed under the apache license version 2 0",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license"
    " is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-mention": "released under the mit license",
    "mit-mention-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial"
    " portions of the software",
    "as-is": "the software is provided as is without warranty of any kind",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is"
    " hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided"
    " that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the"
    " following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
    " following disclaimer",
    "bsd-name": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-mention": "licensed under the gnu general public license version 3",
    "gpl2-mention": "licensed under the gnu general public license version 2",
    "gpl-terms": "under the terms of the gnu general public license as published by the free software foundation",
    "gpl3-version": "either version 3 of the license or at your option any later version",
    "gpl2-version": "either version 2 of the license or at your option any later version",
    "lgpl-terms": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-mention": "subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-mention": "licensed under cc by nc 4 0",
    "cc-by-nc-long": "licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-mention": "licensed under cc by 4 0",
    "cc-by-sa-mention": "licensed under cc by sa 4 0",
    "lgpl21-version": "either version 2 1 of the license or at your option any later version",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
# Identifiers that stand for a licence in a line of their own kind, and its name.
IDENTIFIERS = {
    "apache-2.0": "Apache-2.0",
    "mit": "MIT",
    "isc": "ISC",
    "bsd-2-clause": "BSD-2-Clause",
    "bsd-3-clause": "BSD-3-Clause",
    "gpl-2.0-only": "GPL-2.0",
    "gpl-2.0-or-later": "GPL-2.0-or-later",
    "gpl-3.0-only": "GPL-3.0",
    "gpl-3.0-or-later": "GPL-3.0-or-later",
    "lgpl-2.1-or-later": "LGPL-2.1-or-later",
    "lgpl-3.0-or-later": "LGPL-3.0-or-later",
    "mpl-2.0": "MPL-2.0",
    "cc-by-4.0": "CC-BY-4.0",
    "cc-by-nc-4.0": "CC-BY-NC-4.0",
    "cc-by-sa-4.0": "CC-BY-SA-4.0",
    "unlicense": "Unlicense",
}
# an identifier is a sentence with a last word of its own, so that a longer one does not hold it
SENTENCES |= {f"spdx-{i}".replace(".", "-"): f"spdx license identifier {i.replace('-', ' ').replace('.', ' ')} end" for i in IDENTIFIERS}
# Every known sentence holds one of these.
TRIGGERS = ("licens", "permission", "redistribut", "warrant", "unencumbered")
# A licence and the sentences that make it, in the order of matching.
RULES = [
    ("Apache-2.0", ["apache-mention", "apache-compliance", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", ["apache-mention"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-mention"]),
    ("MIT", ["mit-mention-licensed"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "gpl3-version"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "lgpl21-version"]),
    ("LGPL-2.0-or-later", ["lgpl-terms", "gpl2-version"]),
    ("GPL-3.0-or-later", ["gpl-terms", "gpl3-version"]),
    ("GPL-2.0-or-later", ["gpl-terms", "gpl2-version"]),
    ("GPL-3.0", ["gpl3-mention"]),
    ("GPL-2.0", ["gpl2-mention"]),
    ("MPL-2.0", ["mpl-mention"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-mention"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-mention"]),
    ("CC-BY-4.0", ["cc-by-mention"]),
    ("Unlicense", ["unlicense"]),
    ("unknown warranty", ["as-is"]),
]
RULES += [(name, [f"spdx-{i}".replace(".", "-")]) for i, name in IDENTIFIERS.items()]
# Fixed values. A sentence ends at a mark before white space, or at an empty line; other line
# ends, with what starts a comment, stand for a space. The mark of a shortened "version" before a number
# ends nothing, and an identifier's line is a sentence up to the identifier's end.
VERSION = r"(^|[^a-z0-9])(v|ver|vers)\.[ \t\r\n]*([0-9])"
IDENTIFIER = r"spdx-license-identifier:[ \t(]*([a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?)"
END_MARK = r"([.!?;])[ \t\r\n]+"
EMPTY_LINE = r"\n[ \t\r]*\n"
LINE_END = r"\n[ \t\r*#/%;-]*"
BREAK = "\x01"


def sentences(text: Column) -> Column:
    """A text's normalised sentences (array of string), each with a space at both ends."""
    plain = F.regexp_replace(F.translate(F.lower(text), BREAK, " "), VERSION, "$1$2 $3")
    plain = F.regexp_replace(plain, IDENTIFIER, f"{BREAK}spdx license identifier $1 end{BREAK}")
    divided = F.regexp_replace(plain, END_MARK, f"$1{BREAK}")
    divided = F.regexp_replace(F.regexp_replace(divided, EMPTY_LINE, BREAK), LINE_END, " ")
    return F.transform(
        F.split(divided, BREAK), lambda s: F.concat(F.lit(" "), F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), F.lit(" "))
    )


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences in a text, in its order (array of string).

    Several in one sentence come in the order of the list of sentences.
    """
    lowered = F.lower(text)
    may_hold = F.lit(False)
    for word in TRIGGERS:
        may_hold = may_hold | F.contains(lowered, F.lit(word))

    def known(sentence: Column) -> Column:
        found = [F.when(F.contains(sentence, F.lit(f" {words} ")), F.lit(name)) for name, words in SENTENCES.items()]
        return F.array_compact(F.array(*found))

    none = F.array().cast("array<string>")
    return F.when(may_hold, F.flatten(F.transform(sentences(text), known))).otherwise(none)


def rule_pattern(ids: list[str]) -> tuple[str, str]:
    """For identifiers that follow each other in ``,id,,id,,id,``: a pattern, and what stays of a match."""
    between = "((?:,[a-z0-9-]+,)*?)"
    return between.join(f",{name}," for name in ids), "".join(f"${i}" for i in range(1, len(ids)))


def licences(ids: Column) -> Column:
    """Licences whose rules match a sequence of identifiers, each once, by name (array of string)."""
    none = F.array().cast("array<string>")
    rules = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern"), F.lit(left).alias("left"))
            for name, (pattern, left) in ((name, rule_pattern(rule)) for name, rule in RULES)
        ]
    )
    start = F.struct(
        F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit(","), i, F.lit(",")))).alias("rest"), none.alias("found")
    )

    def apply(state: Column, rule: Column) -> Column:
        fits = F.regexp(state["rest"], rule["pattern"])
        return F.struct(
            F.regexp_replace(state["rest"], rule["pattern"], rule["left"]).alias("rest"),
            F.when(fits, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"),
        )

    matched = F.aggregate(rules, start, apply, lambda state: F.array_sort(F.array_distinct(state["found"])))
    return F.when(F.size(ids) > 0, matched).otherwise(none)


def scan_licences(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``sentence_ids`` and ``licences`` (arrays of string, empty if there are none).

    Null and empty texts have none. Whole texts are read, row by row: nothing is
    shuffled. Extra columns stay; columns named like the added ones are replaced.
    """
    found = df.withColumn("sentence_ids", sentence_ids(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return found.withColumn("licences", licences(F.col("sentence_ids")))
