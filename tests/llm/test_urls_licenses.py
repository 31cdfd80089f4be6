from __future__ import annotations

import re
import textwrap

import compare
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import licenses, queries, urls

GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir):
    assert compare.differences(queries.QUERIES[name](spark, sf_dir), compare.connect(sf_dir), queries.ORACLE_SQL[name]) == ""


def test_licences(frame):
    rows = [
        (1, "Intro text.\nReleased under the MIT License.\nAll rights reserved."),
        (2, GPL + "More."),
        (3, None),
        (4, ""),
        (None, "licensed under the apache license, version 2.0!"),
        (5, "x " * 60_000 + ". All Rights RESERVED."),
        (5, "All rights reserved.\nAll rights reserved."),
        (6, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ]
    got = sorted(((r["doc_id"] or 0, r["licenses"], r["unresolved"]) for r in licenses.scan(frame(rows)).collect()))
    assert got == [
        (0, "Apache-2.0", ""),
        (1, "MIT,LicenseRef-all-rights-reserved", ""),
        (2, "GPL-3.0-or-later", ""),
        (3, "", ""),
        (4, "", ""),
        (5, "LicenseRef-all-rights-reserved", ""),
        (5, "LicenseRef-all-rights-reserved", ""),
        (6, "", "<mit-notice>"),
    ]
    assert licenses.scan(frame([])).count() == 0
    plan = licenses.scan(frame(rows))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


MIT = """MIT License
Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
BSD = """Copyright (c) 2020, Some One.
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
   disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
   products derived from this software without specific prior written permission.
"""


def _wrapped(text, width, mark=""):
    paragraphs = [textwrap.wrap(p, width) or [""] for p in text.replace("\n   ", " ").split("\n\n") for p in re.split(r"\n(?=[23]\. )", p)]
    return "\n".join((mark + line).rstrip() for p in paragraphs for line in [*p, ""])


@pytest.mark.parametrize(("width", "mark"), [(70, ""), (76, " * "), (60, "# "), (40, "// ")])
def test_wrapped_licences(frame, width, mark):
    texts = [MIT, BSD, BSD + BSD_3, GPL, GPL.replace("version 3", "version 2")]
    rows = [(i, _wrapped(t, width, mark)) for i, t in enumerate(texts)]
    rows += [(10, MIT.split("\n\n")[1].replace(" ", "\r\n")), (11, "All rights\n\nreserved"), (12, "x all rights\nreserved"), (13, "Title\nAll rights\nreserved\nmore")]
    got = {r["doc_id"]: (r["licenses"], r["unresolved"]) for r in licenses.scan(frame(rows)).collect()}
    reserved = "LicenseRef-all-rights-reserved"
    assert [got[i][0] for i in range(5)] == ["MIT", f"BSD-2-Clause,{reserved}", f"BSD-3-Clause,{reserved}", "GPL-3.0-or-later", "GPL-2.0-or-later"]
    assert [got[i] for i in range(10, 14)] == [("", "<mit-grant>"), ("", ""), ("", ""), (reserved, "")]


ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
GNU = "This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.\n"
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/\n"
COMMON = [
    (ISC, "ISC"),
    (ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""), "0BSD"),
    (ZLIB, "Zlib"),
    (APACHE, "Apache-2.0"),
    (MPL, "MPL-2.0"),
    (EPL, "EPL-2.0"),
    (GNU.format(what="library", sep=";", kind="Lesser ", comma=";", version="2.1"), "LGPL-2.1-or-later"),
    (GNU.format(what="program", sep=":", kind="Lesser ", comma=",", version="3"), "LGPL-3.0-or-later"),
    (GNU.format(what="program", sep=":", kind="Affero ", comma=",", version="3"), "AGPL-3.0-or-later"),
    (GNU.format(what="program", sep=";", kind="", comma=";", version="2"), "GPL-2.0-or-later"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n", "AGPL-3.0-only"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n\nVersion 2.1, February 1999\n", "LGPL-2.1-only"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n", "GPL-2.0-only"),
]


@pytest.mark.parametrize(("width", "mark"), [(10_000, ""), (72, " * "), (50, "# ")])
def test_common_licences(frame, width, mark):
    # Lines of a title are kept apart.
    texts = ["\n".join(_wrapped(line, width, mark).strip("\n") for line in t.split("\n")) for t, _ in COMMON]
    got = {r["doc_id"]: (r["licenses"], r["unresolved"]) for r in licenses.scan(frame(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(COMMON))] == [(name, "") for _, name in COMMON]


def test_sql_gives_the_rows_of_the_query_on_wrapped_texts(frame):
    duckdb = pytest.importorskip("duckdb")
    whole = [MIT, BSD, BSD + BSD_3, GPL, *[t for t, _ in COMMON]]
    texts = [_wrapped(t, width, mark) for t in whole for width, mark in ((70, ""), (40, "// "), (76, " * "))]
    texts += [None, "", "\n", "All rights\n\nreserved", "x all rights\nreserved", "Title\nAll rights\nreserved\nall rights reserved\nmore"]
    texts += ["all rights reserved. ALL RIGHTS\r\nRESERVED! all rights reserved;;\nE", "all rights reserved\u00e9", "all rights reserved" * 2, "\t".join(["all rights reserved;"] * 3)]
    texts += [MIT.split("\n\n")[1].replace(" ", "\r\n"), MIT * 200, "E all rights reservedE\nall\nrights\nreserved"]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = licenses.scan(frame(rows))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    theirs = con.sql(licenses.scan_sql())
    assert theirs.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(theirs.fetchall())


def _judge(spark, pages, listed):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("key", F.lit(1))
    names = spark.createDataFrame([(u,) for u in listed], "url string")
    return {r["page_id"]: tuple(r)[1:] for r in urls.judge(df, names, queries.URL_RULES).collect()}


def test_urls(spark):
    pages = [
        "http://a.example.net/en/1",
        "http://example.net/de/1",
        "https://X.Example.COM/de/",
        "http://b.org/fr/x?y=1",
        "http://b.org/en/",
        None,
        "no scheme/net/",
        "http://net",
        "http://notexample.com/de/",
        "x?u=://q.net/z#f",
        "http://www.bad.site/a/?utm_source=z&b=2&a=1#top",
        "http://www.bad.site/a/?utm_source=z&b=2&a=1#top",
    ]
    got = _judge(spark, pages, ["https://bad.site/a?a=1&b=2", "https://bad.site/a?a=1&b=2", None, "junk"])
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow", False)
    assert got[1] == ("example.net", "/de/1", "net/", "block", False)
    assert got[2] == ("x.example.com", "/de/", "example.com/de/", "block", False)
    assert got[3] == ("b.org", "/fr/x", "org/fr/", "allow", False)
    assert got[4] == ("b.org", "/en/", None, "allow", False)
    assert got[5] == got[6] == ("", "", None, "allow", False)
    assert got[7] == ("net", "", None, "allow", False)
    assert got[8][2:] == (None, "allow", False)
    assert got[9] == ("q.net", "/z", "net/", "block", False)
    assert got[10] == got[11] == ("www.bad.site", "/a/", None, "block", True)
    assert _judge(spark, [], ["http://a.b/"]) == {}
    assert _judge(spark, ["http://a.b/"], [])[0][3] == "allow"


def test_filter_has_no_false_negative_and_the_join_no_false_positive(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_URL", 1)
    listed = [f"http://s{i}.example/p{i}" for i in range(0, 4000, 2)]
    got = _judge(spark, [f"https://www.s{i}.example/p{i}/" for i in range(4000)], listed)
    assert [got[i][4] for i in range(4000)] == [i % 2 == 0 for i in range(4000)]
