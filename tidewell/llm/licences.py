"""Licence notices in files, by a positional index of rare template words.

The words of a file that stand in templates are written once as postings (word, place). An index leads from the
words of highest IDF in each mandatory phrase to (template, position); the words of a file that it holds are looked
up, which gives the starts that each of them stands for. Starts that all rare words of a phrase agree on remain, and
there the phrase is verified. The index and the templates are literals, so the plan does not grow with their number,
and all of it works inside the row of a file: nothing is shuffled but the word counts.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ascii_lower, unpacked
from tidewell.session import written

#: words before A-Z are lower-cased
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


@dataclass(frozen=True)
class Template:
    """A notice in ASCII. ``mandatory``: spans [first, end) of ``words`` that must stand word by word."""

    label: str
    text: str
    base: bool = False
    phrase: str | None = None

    @property
    def words(self) -> list[str]:
        return _words(self.text)

    @property
    def mandatory(self) -> tuple[int, int]:
        words, phrase = self.words, _words(self.phrase or self.text)
        first = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        return first, first + len(phrase)


# --- fixed values: the base phrases and their labels, then wording of well-known notices ---
TEMPLATES = [
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("mit", "SPDX-License-Identifier: MIT"),
    Template("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    Template("bsd", "SPDX-License-Identifier: BSD"),
    Template("gpl", "SPDX-License-Identifier: GPL"),
    Template("lgpl", "SPDX-License-Identifier: LGPL"),
    Template("mpl-2", "SPDX-License-Identifier: MPL-2.0"),
    Template("isc", "SPDX-License-Identifier: ISC"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        phrase="Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    Template(
        "ncsa",
        'documentation files (the "Software"), to deal with the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        phrase="to deal with the Software without restriction",
    ),
    Template(
        "bsl-1",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, '
        "execute, and transmit the Software, and to prepare derivative works of the Software",
        phrase="any person or organization obtaining a copy of the software and accompanying documentation",
    ),
    Template(
        "x11",
        "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to "
        "promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
        phrase="shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer.",
        phrase="Redistribution and use in source and binary forms",
    ),
    Template(
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        phrase="may be used to endorse or promote products derived from this software",
    ),
    Template(
        "bsd-4",
        "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
        phrase="All advertising materials mentioning features or use of this software",
    ),
    Template(
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at",
        phrase="Licensed under the Apache License, Version 2.0",
    ),
    Template(
        "gpl",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        phrase="GNU General Public License",
    ),
    Template(
        "gpl-2",
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or "
        "(at your option) any later version.",
        phrase="GNU General Public License as published by the Free Software Foundation; either version 2",
    ),
    Template(
        "gpl-3",
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
        phrase="GNU General Public License as published by the Free Software Foundation, either version 3",
    ),
    Template(
        "gpl",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        phrase="copy and distribute verbatim copies of this license document",
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
        phrase="GNU Lesser General Public License",
    ),
    Template(
        "agpl",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        phrase="GNU Affero General Public License",
    ),
    Template(
        "gfdl",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
        "Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
        phrase="GNU Free Documentation License",
    ),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
        phrase="Mozilla Public License",
    ),
    Template(
        "epl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
        phrase="Eclipse Public License",
    ),
    Template(
        "cddl",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the "
        '"License"). You may not use this file except in compliance with the License.',
        phrase="Common Development and Distribution License",
    ),
    Template(
        "eupl",
        "or as soon they will be approved by the European Commission subsequent versions of the EUPL; You may not use this "
        "work except in compliance with the Licence.",
        phrase="subsequent versions of the EUPL",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        phrase="for any purpose with or without fee is hereby granted",
    ),
    Template(
        "postgresql",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, "
        "and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph "
        "and the following two paragraphs appear in all copies.",
        phrase="without fee, and without a written agreement is hereby granted",
    ),
    Template(
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:",
        phrase="Permission is granted to anyone to use this software for any purpose, including commercial applications",
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
        phrase="unencumbered software",
    ),
    Template(
        "cc0-1",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and "
        "related or neighboring rights to this work.",
        phrase="waived all copyright and related or neighboring rights",
    ),
    Template(
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        phrase="Creative Commons Attribution 4.0",
    ),
    Template(
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        phrase="Creative Commons Attribution-ShareAlike",
    ),
    Template(
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        phrase="Creative Commons Attribution-NonCommercial",
    ),
    Template(
        "cc-by-nd",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        phrase="Creative Commons Attribution-NoDerivatives",
    ),
    Template(
        "odbl-1",
        "is made available under the Open Database License. Any rights in individual contents of the database are licensed "
        "under the Database Contents License",
        phrase="made available under the Open Database License",
    ),
    Template(
        "ofl-1",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is "
        "also available with a FAQ at",
        phrase="SIL Open Font License",
    ),
    Template(
        "artistic",
        "The intent of this document is to state the conditions under which a Package may be copied, such that the "
        "Copyright Holder maintains some semblance of artistic control over the development of the package",
        phrase="some semblance of artistic control over the development of the package",
    ),
    Template(
        "psf-2",
        'This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization '
        '("Licensee") accessing and otherwise using this software',
        phrase="LICENSE AGREEMENT is between the Python Software Foundation",
    ),
    Template(
        "openssl",
        "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit.",
        phrase="software developed by the OpenSSL Project",
    ),
    Template(
        "ms-pl",
        "This license governs use of the accompanying software. If you use the software, you accept this license. If you do "
        "not accept the license, do not use the software.",
        phrase="This license governs use of the accompanying software",
    ),
    Template(
        "beerware",
        "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think "
        "this stuff is worth it, you can buy me a beer in return",
        phrase="you can do whatever you want with this stuff",
    ),
]
# --- end of fixed values ---


def _frequency(posted: DataFrame, templates: Sequence[Template]) -> dict[str, int]:
    """Document frequency of every template word over all files; as many rows as the templates have words."""
    held = posted.select(F.explode(F.array_distinct("words")).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for t in templates for w in t.words}


def rare_positions(template: Template, frequency: dict[str, int], rare: int) -> list[tuple[str, int]]:
    """The ``rare`` words of highest IDF of the mandatory phrase, each with a position; the last repeats if there are fewer."""
    first, end = template.mandatory
    found: dict[str, int] = {}
    for i in sorted(range(first, end), key=lambda i: (frequency[template.words[i]], i)):
        found.setdefault(template.words[i], i - first)
    own = list(found.items())[:rare]
    return own + own[-1:] * (rare - len(own))


def _constant(value: list, kind: str) -> Column:
    """A nested literal; the optimizer parses it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


class PositionalIndex:
    """Word -> (template, position), in buckets by CRC-32 so that a lookup takes no search."""

    def __init__(self, entries: Sequence[tuple[str, int, int]]):
        self.size = 1 << max(2 * len(entries), 1).bit_length()
        buckets: list[list[dict]] = [[] for _ in range(self.size)]
        for word, template, position in entries:
            buckets[zlib.crc32(word.encode()) % self.size].append({"w": word, "t": template, "p": position})
        self.buckets = _constant(buckets, "array<array<struct<w: string, t: long, p: int>>>")

    def starts(self, words: str) -> Column:
        """For each word of the file the starts that it stands for: template * 2^32 + number of the posting, or -1."""

        def of(word: Column, at: Column) -> Column:
            own = F.get(self.buckets, F.pmod(F.crc32(word), F.lit(self.size)).cast("int"))
            start = lambda e: F.when(at >= e["p"], e["t"] * F.lit(1 << 32) + (at - e["p"])).otherwise(F.lit(-1))
            return F.transform(F.filter(own, lambda e: e["w"] == word), start)

        return F.flatten(F.transform(words, of))


def scan_licences(
    files: DataFrame,
    text: str = "text",
    templates: Sequence[Template] | None = None,
    rare: int = 2,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The files with ``n_words``, places and labels of the licence notices in them.

    ``n_base``, ``first_word`` and ``last_word`` count the places of the base phrases (all of them, starts
    from word 0, null without any); ``base_labels`` and ``labels`` are distinct, sorted and comma-joined.
    A template without ``base`` counts where its mandatory phrase stands. ``score`` is the largest share of
    a template's words that stand in their places at one of these (1 for a whole notice, 0 without any).
    ``rare`` words of each mandatory phrase are in the index; every place holds them all, so none is missed.
    A null or empty text has no words, no tables no rows. Repeated rows each give their row; extra columns pass
    through. ``keep`` names the columns to return (all, the text too, if not given); they are written once,
    next to the words of the file that templates hold.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for t in templates for w in t.words})
    own = [files[f"`{c}`"] for c in (files.columns if keep is None else keep)]
    raw = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(RAW_WORD), F.lit(0))
    split = files.select(F.struct(*own).alias("_row"), raw.alias("raw"))
    # lower() is quick but knows more letters than A-Z; no other word becomes one of a template by the second step
    known = lambda w, i: F.when(F.lower(w).isin(vocabulary), F.struct(ascii_lower(w).alias("w"), i.alias("i")))
    posted = split.select("_row", F.size("raw").cast("long").alias("n_words"), F.array_compact(F.transform("raw", known)).alias("hits"))
    posted = written(posted.select("_row", "n_words", F.col("hits.w").alias("words"), F.col("hits.i").alias("places")), "postings")

    frequency = _frequency(posted, templates)
    anchors = [rare_positions(t, frequency, rare) for t in templates]
    index = [PositionalIndex([(own[r][0], n, own[r][1]) for n, own in enumerate(anchors)]) for r in range(rare)]
    agreed = index[0].starts("words")
    for one in index[1:]:
        agreed = F.array_intersect(agreed, one.starts("words"))
    base = posted.select("_row", "n_words", "words", "places", F.array_distinct(F.filter(agreed, lambda c: c >= 0)).alias("agreed"))

    phrases = _constant([t.words[slice(*t.mandatory)] for t in templates], "array<array<string>>")
    wording = _constant([t.words for t in templates], "array<array<string>>")
    firsts = _constant([t.mandatory[0] for t in templates], "array<int>")
    names = _constant([t.label for t in templates], "array<string>")
    bases = _constant([t.base for t in templates], "array<boolean>")
    template = lambda c: F.shiftright(c, 32).cast("int")
    posting = lambda c: c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")

    def stands(c: Column) -> Column:
        """All words of the phrase are words of templates, so they are neighbours among the postings too."""
        phrase, b = F.get(phrases, template(c)), posting(c)
        last = F.get("places", b + F.size(phrase) - 1)
        return (last - F.get("places", b) == F.size(phrase) - 1) & (F.slice("words", b + 1, F.size(phrase)) == phrase)

    def share(c: Column) -> Column:
        """Share of the template's words that stand in place around the phrase."""
        own, first, b = F.get(wording, template(c)), F.get(firsts, template(c)), posting(c)
        near = F.sequence(F.greatest(b - first, F.lit(0)), F.least(b - first + F.size(own), F.size("words")) - 1)
        in_place = lambda j: F.get(own, F.get("places", j) - F.get("places", b) + first) == F.get("words", j)
        return F.size(F.filter(near, in_place)) / F.size(own)

    base = base.select("_row", "n_words", "words", "places", F.filter("agreed", stands).alias("found"))
    of_base = F.filter("found", lambda c: F.get(bases, template(c)))
    at_base = F.transform(of_base, lambda c: F.get("places", posting(c)))
    labels = lambda own: F.array_join(F.array_sort(F.array_distinct(F.transform(own, lambda c: F.get(names, template(c))))), ",")
    return unpacked(
        base,
        n_words=F.col("n_words"),
        n_base=F.size(at_base).cast("long"),
        first_word=F.array_min(at_base).cast("long"),
        last_word=F.array_max(at_base).cast("long"),
        base_labels=labels(of_base),
        labels=labels(F.col("found")),
        score=F.coalesce(F.array_max(F.transform("found", share)), F.lit(0.0)).cast("double"),
    )


def licence_sql(words: str, lower: str, templates: Sequence[Template] | None = None) -> str:
    """The same in DuckDB's SQL over ``documents``: the phrase is compared wherever its first word stands."""
    templates = TEMPLATES if templates is None else templates
    listed = lambda own: "[" + ", ".join(f"'{w}'" for w in own) + "]"
    rows = ", ".join(
        f"('{t.label}', {t.base}, {t.mandatory[0]}, {listed(t.words)}, {listed(t.words[slice(*t.mandatory)])})" for t in templates
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), {lower}), {words}) AS w FROM documents),
    t AS (SELECT *, phrase[1] AS head FROM (VALUES {rows}) v(label, base, first, wording, phrase)),
    p AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
    c AS (SELECT p.rid, p.i, t.* FROM p JOIN t ON p.x = t.head),
    f AS (SELECT c.*, greatest(c.first - c.i, 0) AS cut,
                 list_slice(d.w, greatest(c.i - c.first, 0) + 1, c.i - c.first + len(c.wording)) AS near
          FROM c JOIN d ON c.rid = d.rid WHERE list_slice(d.w, c.i + 1, c.i + len(c.phrase)) = c.phrase),
    s AS (SELECT *, len(list_filter(range(0, len(wording)), lambda k: k >= cut AND near[k - cut + 1] = wording[k + 1])) / len(wording)
                 AS share FROM f),
    a AS (SELECT rid, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM s GROUP BY rid)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM d LEFT JOIN a ON d.rid = a.rid"""
