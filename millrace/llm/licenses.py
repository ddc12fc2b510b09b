"""License scan by sentence rules. DataFrame functions only; no shuffle.

Besides sentences that licences print, notices (a beginning and a licence's name, by rule) and short-form tags are sentences, too.

A text, in lower case and with single spaces between letters and digits, keeps its cuts (ends of sentences and lines) as
newlines. A known licence sentence is found where its words stand between two cuts; cuts inside it ("v. 2.0", "software: you")
and its line breaks and comment marks don't matter. A licence is found where its rule's sentences occur in the text's sequence of
identifiers in the rule's order, with anything between them. A licence whose rule another one's contains is named only where
that other is not found (``WITHIN``).

Nulls: a null text has no sentences. Every row is kept, repeated ones too; an empty table gives no rows; extra columns are not
read; texts of any length are read whole. Where two sentences begin at one place the longer is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Normalised licence sentences; an identifier is a sentence's place in the list, from 1.
SENTENCES = [
    "released under the mit license",
    "licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "licensed under the apache license version 2 0",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at",
    "this work is licensed under the gnu general public license version 3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "all rights reserved",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "this is free and unencumbered software released into the public domain",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "distributed under the boost software license version 1 0",
    "neither the name of the copyright holder nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
]

#: The same sentences as licences print them at greater length or in other words, and their identifiers.
LONGER = {
    SENTENCES[2] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": 3,
    SENTENCES[29] + " https www eclipse org legal epl 2 0": 30,
    SENTENCES[34].replace("of contributors", "of any contributors"): 35,
    SENTENCES[15].replace("copyright holder", "organization"): 16,
}

# Licences and the identifiers that their rules ask for, in order.
RULES = [
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("MIT", (3, 4)),
    ("Apache-2.0", (5,)),
    ("Apache-2.0", (6, 7)),
    ("GPL-2.0-only", (20,)),
    ("GPL-2.0-or-later", (19,)),
    ("GPL-3.0-only", (8,)),
    ("GPL-3.0-or-later", (9,)),
    ("LGPL-2.1-or-later", (21,)),
    ("LGPL-3.0-or-later", (22,)),
    ("LGPL-3.0-or-later", (23,)),
    ("AGPL-3.0-or-later", (24,)),
    ("CC-BY-NC-4.0", (10,)),
    ("CC-BY-NC-4.0", (33,)),
    ("CC-BY-4.0", (11,)),
    ("CC-BY-4.0", (31,)),
    ("CC-BY-SA-4.0", (12,)),
    ("CC-BY-SA-4.0", (32,)),
    ("BSD-2-Clause", (13, 14, 15)),
    ("BSD-3-Clause", (13, 14, 15, 16)),
    ("BSD-3-Clause", (13, 14, 15, 35)),
    ("ISC", (25,)),
    ("ISC", (26,)),
    ("Zlib", (27,)),
    ("BSL-1.0", (34,)),
    ("MPL-2.0", (17,)),
    ("EPL-2.0", (30,)),
    ("Unlicense", (28,)),
    ("CC0-1.0", (29,)),
    ("Proprietary", (18,)),
]

# Licences and the names that notices call them by, normalised.
NAMES = [
    ("MIT", "mit license"), ("Apache-2.0", "apache license version 2 0"), ("Apache-2.0", "apache license 2 0"), ("Apache-1.1", "apache software license version 1 1"),
    ("GPL-2.0-only", "gnu general public license version 2"), ("GPL-3.0-only", "gnu general public license version 3"), ("GPL-2.0-only", "gnu general public license v2 0"), ("GPL-3.0-only", "gnu general public license v3 0"),
    ("LGPL-2.1-only", "gnu lesser general public license version 2 1"), ("LGPL-3.0-only", "gnu lesser general public license version 3"), ("AGPL-3.0-only", "gnu affero general public license version 3"), ("GFDL-1.3-only", "gnu free documentation license version 1 3"),
    ("BSD-2-Clause", "bsd 2 clause license"), ("BSD-3-Clause", "bsd 3 clause license"), ("0BSD", "bsd zero clause license"), ("ISC", "isc license"), ("Zlib", "zlib license"), ("BSL-1.0", "boost software license version 1 0"),
    ("MPL-1.1", "mozilla public license version 1 1"), ("MPL-2.0", "mozilla public license version 2 0"), ("MPL-2.0", "mozilla public license 2 0"), ("EPL-1.0", "eclipse public license version 1 0"), ("EPL-2.0", "eclipse public license version 2 0"), ("EPL-2.0", "eclipse public license 2 0"),
    ("CDDL-1.0", "common development and distribution license version 1 0"), ("CPL-1.0", "common public license version 1 0"), ("EUPL-1.2", "european union public licence version 1 2"), ("OSL-3.0", "open software license version 3 0"), ("AFL-3.0", "academic free license version 3 0"),
    ("Artistic-2.0", "artistic license 2 0"), ("OFL-1.1", "sil open font license version 1 1"), ("MS-PL", "microsoft public license"), ("Unlicense", "unlicense"), ("WTFPL", "do what the fuck you want to public license"), ("NCSA", "university of illinois ncsa open source license"),
    ("PostgreSQL", "postgresql license"), ("Python-2.0", "python software foundation license"), ("PHP-3.01", "php license version 3 01"), ("ODbL-1.0", "open database license"), ("BUSL-1.1", "business source license 1 1"), ("Elastic-2.0", "elastic license 2 0"), ("SSPL-1.0", "server side public license version 1"),
    ("CC0-1.0", "cc0 1 0 universal"), ("CC0-1.0", "creative commons zero v1 0 universal"), ("CC-BY-4.0", "creative commons attribution 4 0 international license"), ("CC-BY-SA-4.0", "creative commons attribution sharealike 4 0 international license"), ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4 0 international license"),
    ("CC-BY-ND-4.0", "creative commons attribution noderivatives 4 0 international license"), ("CC-BY-NC-SA-4.0", "creative commons attribution noncommercial sharealike 4 0 international license"), ("CC-BY-NC-ND-4.0", "creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("CC-BY-3.0", "creative commons attribution 3 0 unported license"), ("CC-BY-SA-3.0", "creative commons attribution sharealike 3 0 unported license"), ("CC-BY-SA-4.0", "cc by sa 4 0"), ("CC-BY-ND-4.0", "cc by nd 4 0"), ("CC-BY-NC-SA-4.0", "cc by nc sa 4 0"), ("CC-BY-NC-ND-4.0", "cc by nc nd 4 0"), ("CC-BY-4.0", "cc by 4 0"), ("CC-BY-NC-4.0", "cc by nc 4 0"),
]

# How notices begin. A notice is a beginning and a name; its identifier is NAMED plus the name's place in the list.
BEGINNINGS = [f"{subject}{verb} under {article}" for subject in ("", *(f"this {x} is " for x in ("project", "software", "work", "program", "library", "code", "file", "package", "repository"))) for verb in ("licensed", "released", "distributed", "made available", "provided") for article in ("", "the ", "a ", "the terms of the ")]
NAMED = 100
#: A tag in a file's head names a licence by its short form; its identifier is TAGGED plus that licence's place in ``TAGS``.
TAG = "spdx license identifier "
TAGGED = 300
TAGS = list(dict.fromkeys([*(n for n, _ in RULES if n != "Proprietary"), *(n for n, _ in NAMES)]))
RULES += [(name, (NAMED + i,)) for i, (name, _) in enumerate(NAMES)] + [(name, (TAGGED + i,)) for i, name in enumerate(TAGS)]


def short_form(name: str) -> str:
    """A licence's short form, normalised as texts are."""
    return "".join(c if c.isalnum() else " " for c in name.lower())


#: Licences whose rule is part of another's: named only where the other is not found. A notice of a known licence may reserve rights.
WITHIN = {"BSD-2-Clause": ("BSD-3-Clause",), "Proprietary": tuple(dict.fromkeys(n for n, _ in RULES if n != "Proprietary"))}

#: Where sentences end.
CUT = r"[.!?;:]+(?:[ \t\r\n]+|$)|\n+"
#: Texts without any of these have no licence sentence.
HINT = "(?i)licen|permission|redistribut|copyright|rights reserved|free software|unencumbered|cc0|cc.by|creative commons"


def normalised(text: Column) -> Column:
    """The words of a text with single spaces, and a newline for each cut and at both ends."""
    return F.concat(F.lit("\n"), F.regexp_replace(F.lower(F.regexp_replace(text, CUT, "\n")), "[^a-z0-9\n]+", " "), F.lit("\n"))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences, notices and tags of a text, in order."""
    known = LONGER | {s: i for i, s in enumerate(SENTENCES, 1)}
    names, tags = [name for _, name in NAMES], [short_form(t) for t in TAGS]
    longest = lambda xs: "|".join(sorted(xs, key=len, reverse=True))
    forms = [longest(known), f"(?:{longest(BEGINNINGS)})(?:{longest(names)})", f"{TAG}(?:{longest(tags)})"]
    pattern = "(?<=\n) ?(?:" + "|".join(forms).replace(" ", "[ \n]+") + ") ?(?=\n)"
    place = lambda x, values: F.array_position(F.array(*map(F.lit, values)), x).cast("int")

    def identifier(found: Column) -> Column:
        x = F.trim(F.regexp_replace(found, "[ \n]+", " "))
        own = F.get(F.array(*map(F.lit, known.values())), place(x, known) - 1)
        tag = TAGGED - 1 + F.nullif(place(F.replace(x, F.lit(TAG), F.lit("")), tags), F.lit(0))
        name = NAMED - 1 + place(F.regexp_replace(x, f"^(?:{longest(BEGINNINGS)})(?=(?:{longest(names)})$)", ""), names)
        return F.coalesce(own, F.when(F.startswith(x, F.lit(TAG)), tag), name)

    found = F.transform(F.regexp_extract_all(normalised(text), F.lit(pattern), F.lit(0)), identifier)
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<int>"))


def licenses_of(ids: Column) -> Column:
    """Licences whose rules the sequence matches, each once, in the rules' order."""
    line = F.concat(F.lit(","), F.array_join(ids.cast("array<string>"), ",,"), F.lit(","))
    hits = [F.when(line.like("%" + "%".join(f",{i}," for i in rule) + "%"), F.lit(name)) for name, rule in RULES]
    covered = lambda found, name: F.coalesce(*[F.when(name == F.lit(n), F.arrays_overlap(found, F.array(*map(F.lit, by)))) for n, by in WITHIN.items()], F.lit(False))
    named = let(F.array_distinct(F.array_compact(F.array(*hits))), lambda found: F.filter(found, lambda name: ~covered(found, name)))
    return F.when(F.size(ids) > 0, named).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's doc_id, sentences (identifiers, in order) and licenses (names)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), let(sentence_ids(F.coalesce(F.col(text_col), F.lit(""))), lambda x: F.struct(x.alias("ids"), licenses_of(x).alias("names"))).alias("found"))
    return rows.select("doc_id", F.col("found.ids").alias("sentences"), F.col("found.names").alias("licenses"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), F.array_join(F.col("sentences").cast("array<string>"), ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def oracle() -> str:
    """The digest as DuckDB SQL."""
    quoted = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    rules = ", ".join(f"CASE WHEN line LIKE '%{'%'.join(f',{i},' for i in rule)}%' THEN '{name}' END" for name, rule in RULES)
    order = list(dict.fromkeys(name for name, _ in RULES))
    within = " ".join(f"WHEN n = '{n}' THEN NOT list_has_any(hits, {quoted(by)})" for n, by in WITHIN.items())
    known = LONGER | {x: i for i, x in enumerate(SENTENCES, 1)}
    more = [(TAG + short_form(t), TAGGED + i) for i, t in enumerate(TAGS)]
    words = f"trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '{CUT}', chr(10), 'g')), '[^a-z0-9\n]+', ' ', 'g'))"
    # Every run of pieces between cuts that begins at a piece, joined with single spaces, is looked up; the longest that is known counts.
    return f"""
    WITH printed(s, i) AS (VALUES {', '.join(f"('{x}', {i})" for x, i in [*known.items(), *more])}),
    named_by(name, i) AS (VALUES {', '.join(f"('{x}', {NAMED + i})" for i, (_, x) in enumerate(NAMES))}),
    notices AS (SELECT b || name AS s, min(i) AS i FROM named_by, (SELECT unnest({quoted(BEGINNINGS)}) AS b) GROUP BY 1),
    known AS (SELECT * FROM printed UNION ALL SELECT * FROM notices WHERE s NOT IN (SELECT s FROM printed)),
    hinted AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
    cut AS (SELECT id, list_filter(list_transform(string_split({words}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM hinted WHERE regexp_matches(coalesce(text, ''), '{HINT}')),
    starts AS (SELECT id, p, unnest(range(1, len(p) + 1)) AS a FROM cut),
    firsts AS (SELECT DISTINCT string_split(s, ' ')[1] AS w FROM known),
    runs AS (SELECT id, a, unnest(range(1, least(len(p) - a + 1, 40) + 1)) AS n, p FROM starts WHERE string_split(p[a], ' ')[1] IN (SELECT w FROM firsts)),
    met AS (SELECT id, a, n, known.i FROM runs JOIN known ON known.s = array_to_string(p[a:a + n - 1], ' ')),
    ids AS (SELECT h.doc_id, h.id, coalesce(list(m.i ORDER BY m.a) FILTER (m.i IS NOT NULL), []) AS ids FROM hinted h LEFT JOIN (SELECT id, a, i FROM met QUALIFY row_number() OVER (PARTITION BY id, a ORDER BY n DESC) = 1) m USING (id) GROUP BY h.doc_id, h.id),
    lines AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',,') || ',' AS line FROM ids),
    named AS (SELECT doc_id, ids, [{rules}] AS hits FROM lines)
    SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
           array_to_string(list_filter({quoted(order)}, lambda n: list_contains(hits, n) AND CASE {within} ELSE true END), ',') AS licenses FROM named"""
