"""Licence recognition by sentence rules.

A text is cut into sentences, each sentence is normalised (lower case, only letters,
digits and single spaces) and looked up among known licence sentences. A line's end ends a
sentence, but lines that follow each other may also be one known sentence, wrapped, with
comment marks or not. The identifiers found, in order, are matched against ordered licence rules: a rule that finds its
identifiers next to each other names its licence and uses them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where a sentence ends, in lower-cased text.
SENTENCE_END = r"[.!?;:]+[ \t\r\n]+|[ \t\r]*\n+"

# Normalised licence sentences and their identifiers.
SENTENCES: dict[str, str] = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "licensed under the apache license version 2 0": "apache-ref",
    "licensed under the apache license version 2 0 the license": "apache-header",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "this work is licensed under the gnu general public license version 3": "gpl-3-ref",
    "this work is licensed under the gnu general public license version 2": "gpl-2-ref",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later",
    "licensed under cc by nc 4 0": "cc-by-nc-ref",
    "licensed under cc by 4 0": "cc-by-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-ref",
    "this is free and unencumbered software released into the public domain": "unlicense-ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-ref",
    "all rights reserved": "reserved",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "apache-grant",
    "gnu general public license": "gpl-title",
    "gnu lesser general public license": "lgpl-title",
    "gnu affero general public license": "agpl-title",
    "version 2 june 1991": "gpl-2-date",
    "version 3 29 june 2007": "gpl-3-date",
    "version 2 1 february 1999": "lgpl-2-1-date",
    "version 3 19 november 2007": "agpl-3-date",
    "this library is free software": "lgpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "either version 2 of the license or at your option any later version": "either-2-later",
    "either version 2 1 of the license or at your option any later version": "either-2-1-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl-2-only",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-later",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-liability",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2-ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl-1-ref",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-head",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-copy",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-ref",
}

# Licence rules in order; each is a licence and the identifiers it needs.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-header", "apache-compliance", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-compliance", "apache-copy")),
    ("Apache-2.0", ("apache-grant",)),
    ("ISC", ("isc-grant", "isc-as-is", "isc-liability")),
    ("0BSD", ("0bsd-grant", "isc-as-is", "isc-liability")),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("BSL-1.0", ("bsl-grant",)),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-3-later")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl-3-later")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl-3-later")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "either-2-1-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "either-2-later")),
    ("GPL-2.0-only", ("gpl-free", "gpl-2-only")),
    ("AGPL-3.0-only", ("agpl-title", "agpl-3-date")),
    ("LGPL-3.0-only", ("lgpl-title", "gpl-3-date")),
    ("LGPL-2.1-only", ("lgpl-title", "lgpl-2-1-date")),
    ("GPL-3.0-only", ("gpl-title", "gpl-3-date")),
    ("GPL-2.0-only", ("gpl-title", "gpl-2-date")),
    ("EPL-2.0", ("epl-2-ref",)),
    ("EPL-1.0", ("epl-1-ref",)),
    ("MPL-2.0", ("mpl-head", "mpl-copy")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-2-later")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-ref",)),
    ("GPL-3.0-only", ("gpl-3-ref",)),
    ("GPL-2.0-only", ("gpl-2-ref",)),
    ("MIT", ("mit-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("Unlicense", ("unlicense-ref",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
]


def normalised_sentences(text: Column) -> Column:
    """The normalised sentences of a text that hold a letter or digit, in order."""
    lower = F.translate(text, UPPER, LOWER)
    lines = F.regexp_replace(lower, SENTENCE_END, "\n")
    plain = F.regexp_replace(lines, r"[^a-z0-9\n]+", " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def known_sentences(text: Column) -> Column:
    """The known sentences of a text, normalised, in order: whole sentences, or several lines
    that no punctuation and no blank line parts; of those that start alike the longest. A
    line of marks only is blank, as in a comment."""
    hard = F.regexp_replace(F.translate(text, UPPER, LOWER), r"[.!?;:]+[ \t\r\n]+", "E")
    plain = F.regexp_replace(hard, r"[^a-z0-9\nE]+", " ")
    plain = F.regexp_replace(plain, r" ?\n(?: ?\n)+", "E")
    lines = F.regexp_replace(F.trim(plain), r" ?([\nE]) ?", "$1")
    longest_first = sorted(SENTENCES, key=len, reverse=True)
    wrapped = "|".join(s.replace(" ", r"[ \n]") for s in longest_first)
    found = F.regexp_extract_all(lines, F.lit(rf"(?<![^\nE])(?:{wrapped})(?![^\nE])"), F.lit(0))
    return F.transform(found, lambda s: F.translate(s, "\n", " "))


def pattern(identifiers: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in identifiers)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_sentences, n_known, sentence_ids (known
    identifiers in order, each as <id>), licenses (comma-joined, each once, in the order
    of the rules), unresolved (identifiers that no rule used).

    Null and empty texts have no sentences; repeated rows stay repeated; an empty table
    gives an empty one; other columns are not read. n_sentences counts a wrapped sentence by
    its lines, n_known and the rest count it once. Words as comment marks (`rem`, `dnl`) are
    not left out."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    rules = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(pattern(ids)).alias("pattern")) for name, ids in RULES]
    )
    no_names = F.array().cast("array<string>")
    matched = F.aggregate(
        rules,
        F.struct(F.col("sentence_ids").alias("left"), no_names.alias("names")),
        lambda acc, rule: F.when(
            acc["left"].contains(rule["pattern"]),
            F.struct(
                F.replace(acc["left"], rule["pattern"], F.lit("|")).alias("left"),
                F.concat(acc["names"], F.array(rule["name"])).alias("names"),
            ),
        ).otherwise(acc),
    )
    nothing = F.struct(F.col("sentence_ids").alias("left"), no_names.alias("names"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), normalised_sentences(text).alias("_sentences"), known_sentences(text).alias("_known"))
        .select(
            "doc_id",
            F.size("_sentences").cast("long").alias("n_sentences"),
            F.transform("_known", lambda s: known[s]).alias("_ids"),
        )
        .withColumn(
            "sentence_ids", F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
        )
        .withColumn("_matched", F.when(F.size("_ids") > 0, matched).otherwise(nothing))
        .select(
            "doc_id",
            "n_sentences",
            F.size("_ids").cast("long").alias("n_known"),
            "sentence_ids",
            F.array_join(F.array_distinct("_matched.names"), ",").alias("licenses"),
            F.replace(F.col("_matched.left"), F.lit("|"), F.lit("")).alias("unresolved"),
        )
    )


def scan_sql(source: str = "documents") -> str:
    """The same rows in SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    keys = ", ".join(quoted(k) for k in SENTENCES)
    values = ", ".join(quoted(v) for v in SENTENCES.values())
    # Every separator is doubled: this engine's patterns look neither behind nor ahead, so
    # a sentence takes the mark before it and the one after it.
    longest_first = sorted(SENTENCES, key=len, reverse=True)
    wrapped = "|".join(s.replace(" ", r"(?: |\n\n)") for s in longest_first)
    steps = [
        f"""s AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS lower FROM {source})""",
        f"""n AS (SELECT doc_id, lower, len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower,
            '{SENTENCE_END}', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS n FROM s)""",
        r"""p AS (SELECT doc_id, n, trim(regexp_replace(regexp_replace(regexp_replace(lower, '[.!?;:]+[ \t\r\n]+', 'E', 'g'),
            '[^a-z0-9\nE]+', ' ', 'g'), ' ?\n(?: ?\n)+', 'E', 'g'), ' ') AS plain FROM n)""",
        r"""l AS (SELECT doc_id, n, 'E' || regexp_replace(plain, ' ?([\nE]) ?', '\1\1', 'g') || 'E' AS lines FROM p)""",
        f"""i AS (SELECT doc_id, n, list_transform(regexp_extract_all(lines, '[\\nE]({wrapped})[\\nE]', 1),
            lambda x: [{values}][list_position([{keys}], replace(x, chr(10) || chr(10), ' '))]) AS ids FROM l)""",
        """r0 AS (SELECT doc_id, n, ids, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS seq,
            coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS unused, CAST([] AS VARCHAR[]) AS names FROM i)""",
    ]
    for at, (name, ids) in enumerate(RULES):
        p = quoted(pattern(ids))
        steps.append(
            f"r{at + 1} AS (SELECT doc_id, n, ids, seq, replace(unused, {p}, '|') AS unused, CASE WHEN contains(unused, {p}) "
            f"AND NOT list_contains(names, {quoted(name)}) THEN list_append(names, {quoted(name)}) ELSE names END AS names FROM r{at})"
        )
    return (
        "WITH " + ",\n".join(steps) + f""" SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, CAST(len(ids) AS BIGINT) AS n_known,
        seq AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licenses, replace(unused, '|', '') AS unresolved FROM r{len(RULES)}"""
    )
