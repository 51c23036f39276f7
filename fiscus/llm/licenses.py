"""Licence scan by sentence rules.

Texts are normalised and held against a fixed table of known licence
sentences, which may be wrapped over lines and stand in comments; the
identifiers found, in order, are matched against ordered rules.  A rule
matches when its identifiers occur in that order; other sentences may stand
between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import text_or_empty

# Sentences of public licence texts and notices, as normal_sentence gives them.
SENTENCES = {
    "mit-notice": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license",
                   "this software is released under the mit license"),
    "apache-2-notice": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license",
                        "released under the apache license version 2 0"),
    "gpl-3-notice": ("this work is licensed under the gnu general public license version 3",
                     "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"),
    "gpl-2-notice": ("this work is licensed under the gnu general public license version 2",
                     "licensed under the gnu general public license version 2"),
    "cc-by-nc-4-notice": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"),
    "cc-by-4-notice": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0"),
    "cc-by-sa-4-notice": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"),
    "bsd-3-notice": ("licensed under the bsd 3 clause license", "released under the bsd 3 clause license"),
    "all-rights": ("all rights reserved",),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
                  "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
                  "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
                  "furnished to do so subject to the following conditions",),
    "mit-keep": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as-is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
              "merchantability fitness for a particular purpose and noninfringement",),
    "apache-comply": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at http www apache org licenses license 2 0",
                    "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                  "conditions are met",),
    "bsd-endorse": tuple(f"neither the name of {who} may be used to endorse or promote products derived from this software without specific "
                         "prior written permission" for who in (
                             "the copyright holder nor the names of its contributors", "the copyright holders nor the names of its contributors",
                             "the copyright holders nor the names of their contributors", "the copyright owner nor the names of its contributors",
                             "the author nor the names of its contributors", "the author nor the names of contributors",
                             "the authors nor the names of its contributors", "the organization nor the names of its contributors",
                             "the university nor the names of its contributors")),
    "bsd-as-is": tuple(f"this software is provided by the {who} as is and any express or implied warranties including but not limited to the "
                       "implied warranties of merchantability and fitness for a particular purpose are disclaimed" for who in (
                           "copyright holders and contributors", "copyright holder and contributors", "copyright owner and contributors",
                           "author and contributors", "authors and contributors", "regents and contributors")),
    "spdx-mit": ("spdx license identifier mit",),
    "spdx-apache-2": ("spdx license identifier apache 2 0",),
    "spdx-gpl-3": ("spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later"),
}
# Licence, identifier, its names in notices, its SPDX identifiers; both as normal_text gives them.
COMMON = (
    ("MIT", "mit", ("the mit license", "the mit licence", "mit", "mit license", "the terms of the mit license"), ("mit",)),
    ("Apache-2.0", "apache-2", ("the apache license version 2 0", "the apache license version 2 0 the license", "the apache license 2 0",
                                "the apache 2 0 license", "apache 2 0", "apache license 2 0"), ("apache 2 0",)),
    ("GPL-3.0", "gpl-3", ("the gnu general public license version 3", "the gnu general public license v3 0", "the gnu gpl v3", "the gpl v3",
                          "the gplv3", "gplv3", "gpl 3 0"), ("gpl 3 0 only", "gpl 3 0 or later", "gpl 3 0")),
    ("GPL-2.0", "gpl-2", ("the gnu general public license version 2", "the gnu general public license v2 0", "the gnu gpl v2", "the gpl v2",
                          "the gplv2", "gplv2", "gpl 2 0"), ("gpl 2 0 only", "gpl 2 0 or later", "gpl 2 0")),
    ("CC-BY-NC-4.0", "cc-by-nc-4", ("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license"), ("cc by nc 4 0",)),
    ("CC-BY-4.0", "cc-by-4", ("cc by 4 0", "a creative commons attribution 4 0 international license"), ("cc by 4 0",)),
    ("CC-BY-SA-4.0", "cc-by-sa-4", ("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license"), ("cc by sa 4 0",)),
    ("BSD-3-Clause", "bsd-3", ("the bsd 3 clause license", "the 3 clause bsd license", "the new bsd license", "bsd 3 clause"), ("bsd 3 clause",)),
    ("BSD-2-Clause", "bsd-2", ("the bsd 2 clause license", "the 2 clause bsd license", "the simplified bsd license", "bsd 2 clause"), ("bsd 2 clause",)),
    ("LGPL-3.0", "lgpl-3", ("the gnu lesser general public license version 3", "the gnu lgpl v3", "the lgpl v3", "the lgplv3", "lgplv3", "lgpl 3 0"),
     ("lgpl 3 0 only", "lgpl 3 0 or later", "lgpl 3 0")),
    ("LGPL-2.1", "lgpl-2-1", ("the gnu lesser general public license version 2 1", "the gnu lgpl v2 1", "the lgpl v2 1", "lgplv2 1", "lgpl 2 1"),
     ("lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 2 1")),
    ("AGPL-3.0", "agpl-3", ("the gnu affero general public license version 3", "the gnu agpl v3", "the agpl v3", "the agplv3", "agplv3", "agpl 3 0"),
     ("agpl 3 0 only", "agpl 3 0 or later", "agpl 3 0")),
    ("MPL-2.0", "mpl-2", ("the mozilla public license version 2 0", "the mozilla public license 2 0", "the mpl 2 0", "mpl 2 0",
                          "the terms of the mozilla public license v 2 0"), ("mpl 2 0",)),
    ("ISC", "isc", ("the isc license", "isc", "isc license"), ("isc",)),
    ("Unlicense", "unlicense", ("the unlicense",), ("unlicense",)),
    ("CC0-1.0", "cc0", ("cc0 1 0", "cc0 1 0 universal", "the cc0 1 0 universal license", "cc0"), ("cc0 1 0",)),
)
LEADS = tuple(f"{who}{how} under " for who in ("", *(f"this {x} is " for x in (
    "project", "software", "work", "program", "library", "package", "code", "file", "repository"))) for how in ("licensed", "released", "distributed"))
for _, _key, _names, _tags in COMMON:
    SENTENCES[f"{_key}-notice"] = tuple(dict.fromkeys((*SENTENCES.get(f"{_key}-notice", ()), *(a + b for b in _names for a in LEADS))))
    SENTENCES[f"spdx-{_key}"] = tuple(dict.fromkeys((*SENTENCES.get(f"spdx-{_key}", ()), *(f"spdx license identifier {x}" for x in _tags))))
SENTENCES |= {
    "mpl-2-text": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "isc-grant": tuple(f"permission to use copy modify {x}or distribute this software for any purpose with or without fee is hereby granted "
                       "provided that the above copyright notice and this permission notice appear in all copies" for x in ("", "and ")),
    "unlicense-text": ("this is free and unencumbered software released into the public domain",),
}
# Licence, kind, and the sentence identifiers that must follow each other.
RULES = (
    ("MIT", "text", ("mit-grant", "mit-keep", "as-is")),
    ("MIT", "grant", ("mit-grant", "mit-keep")),
    ("MIT", "notice", ("mit-notice",)),
    ("MIT", "tag", ("spdx-mit",)),
    ("Apache-2.0", "header", ("apache-2-notice", "apache-comply", "apache-copy")),
    ("Apache-2.0", "notice", ("apache-2-notice",)),
    ("Apache-2.0", "tag", ("spdx-apache-2",)),
    ("GPL-3.0", "notice", ("gpl-3-notice",)),
    ("GPL-3.0", "tag", ("spdx-gpl-3",)),
    ("GPL-2.0", "notice", ("gpl-2-notice",)),
    ("CC-BY-NC-4.0", "notice", ("cc-by-nc-4-notice",)),
    ("CC-BY-4.0", "notice", ("cc-by-4-notice",)),
    ("CC-BY-SA-4.0", "notice", ("cc-by-sa-4-notice",)),
    ("BSD-3-Clause", "grant", ("bsd-grant", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", "notice", ("bsd-3-notice",)),
    ("proprietary", "reservation", ("all-rights",)),
    ("MPL-2.0", "header", ("mpl-2-text",)),
    ("ISC", "grant", ("isc-grant",)),
    ("Unlicense", "text", ("unlicense-text",)),
)
RULES += tuple(r for name, key, _, _ in COMMON for r in ((name, "notice", (f"{key}-notice",)), (name, "tag", (f"spdx-{key}",))) if r not in RULES)


# Lower-case text to words, with "\n" where a line ends and "S" where a
# sentence does (after .!?;: before a blank or a line end).  Each step is one
# pass: no run is read again from its middle.
STEPS = (
    (r"(?<![^\n])[^a-z0-9\n]*+(?:(?:dnl|rem)[ \t]+)?", ""),  # blanks and comment signs that start a line
    (r"(spdx-license-identifier):[ \t]*", "$1 "),  # the colon of a tag ends no sentence
    (r"(?<![a-z0-9])v\.[ \t]*+(?=[0-9])", "v "),  # nor does the point of "v. 2.0"
    (r"[.!?;:][ \t]+", "S"),
    (r"[^a-z0-9S\n.!?;:]++", " "),
    (r"[.!?;:][ .!?;:]*+", "."),
    (r"\.(?=\n|\z)", "S"),
    (r"[ .]++", " "),
    (r"[ \n]{2,}+", "\n"),
    (r"[ \n]?S[ \nS]*+", "S"),
    (r" \z", ""),
)


def normal_text(t: Column) -> Column:
    """Words of a-z and 0-9 with one blank, line end or "S" between them."""
    t = F.lower(t)
    for pattern, by in STEPS:
        t = F.regexp_replace(t, pattern, by)
    return t


def _tree(sentences) -> str:
    """A pattern of the sentences, longest first, that reads shared beginnings once."""
    rest: dict = {}
    for s in sorted(sentences):
        first, _, more = s.partition(" ")
        rest.setdefault(first, []).append(more)
    parts = []
    for first, more in rest.items():
        longer = [x for x in more if x]
        tail = r"[ \n]" + _tree(longer) if longer else ""
        parts.append(first + (f"(?:{tail})?" if longer and "" in more else tail))
    return "(?:" + "|".join(parts) + ")"


def recognised(t: Column, known: dict = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order.  A sentence
    starts where a line or sentence starts, ends where one ends, and may run
    over line ends and blank lines, not over the end of another sentence."""
    ids = {s: k for k, group in known.items() for s in group}
    pattern = rf"(?<![^\nS]){_tree(ids)}(?![^\nS])"
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return F.transform(F.regexp_extract_all(normal_text(t), F.lit(pattern), F.lit(0)), lambda s: F.element_at(table, F.translate(s, "\n", " ")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict = SENTENCES, rules=RULES) -> DataFrame:
    """One row per row of ``docs``: id, n_sentences (licence sentences found),
    sentence_ids (comma-joined, in order), licenses (comma-joined names, in
    the order of the rules) and rules (name/kind of every rule that matches).

    Null and empty texts, and texts without licence sentences, give 0 and
    empty strings.  Rows are judged one by one: repeated rows and null ids are
    allowed, extra columns are ignored, and nothing is shuffled.
    """
    found = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.explode(F.array(recognised(text_or_empty(text_col), known))).alias("ids"))
    found = found.select("id", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("sentence_ids"))
    line = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    hits = [(name, f"{name}/{kind}", line.rlike("," + ",(?:.*,)?".join(order) + ",")) for name, kind, order in rules]
    names = F.array_distinct(F.filter(F.array(*[F.when(h, F.lit(n)) for n, _, h in hits]), lambda x: x.isNotNull()))
    kinds = F.filter(F.array(*[F.when(h, F.lit(k)) for _, k, h in hits]), lambda x: x.isNotNull())
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_sentences"), "sentence_ids",
                        F.array_join(names, ",").alias("licenses"), F.array_join(kinds, ",").alias("rules"))
