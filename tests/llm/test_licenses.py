import re
from collections import Counter

import pytest

from kinstrand.llm import licenses

MIT = """/* Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal in the Software.
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE
 * AUTHORS BE LIABLE FOR ANY CLAIM. */"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
{}
THIS SOFTWARE IS PROVIDED BY THE AUTHORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY DAMAGES."""
GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published; either
version 2 of the License, or (at your option) any later version."""


@pytest.mark.parametrize(
    "text, want",
    [
        (MIT, [("MIT", "mit-full", 4)]),
        ("foo bar\n" + BSD.format("3. Neither the name of X may be used to endorse or promote products derived from it.\n"), [("BSD-3-Clause", "bsd-3", 6)]),
        (BSD.format(""), [("BSD-2-Clause", "bsd-2", 5)]),
        (GPL.replace("published; either", "published. Either"), [("GPL-2.0-or-later", "gpl-short", 2)]),
        ("Licensed under the Apache License, Version 2.0.", [("Apache-2.0", "apache-named", 1)]),
        ("Some text\nThis work is licensed under the GNU General Public License, version 3.\nmore", [("GPL-3.0-only", "gpl-named", 1)]),
        ("Licensed under CC BY-NC 4.0. Released under the MIT License.", [("CC-BY-NC-4.0", "cc-named", 1), ("MIT", "mit-named", 1)]),
        ("# SPDX-License-Identifier: gpl-2.0-only", [("gpl-2.0-only", "spdx", 1)]),
        ("Redistributions of source code must retain the copyright notice.", [("UNKNOWN", "bsd-source", 1)]),
        ("a licence to kill. Copyright is a word", []),
        ("", []),
    ],
)
def test_rules(text, want):
    assert [m[:3] for m in licenses.scan(text)] == want


GPL_HEADER = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU {k}General Public License
as published by the Free Software Foundation; either version {v}
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {k}General Public License for more details.

You should have received a copy of the GNU {k}General Public License
along with this program; if not, see <https://www.gnu.org/licenses/>.
"""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize(
    "text, want",
    [
        (GPL_HEADER.format(k="", v="2"), [("GPL-2.0-or-later", "gpl-header", 4)]),
        (GPL_HEADER.format(k="Lesser ", v="2.1"), [("LGPL-2.1-or-later", "gpl-header", 4)]),
        (APACHE_HEADER, [("Apache-2.0", "apache-header", 4)]),
    ],
)
def test_headers_as_written(text, want, mark):
    assert [m[:3] for m in licenses.scan("".join(mark + line for line in text.splitlines(True)))] == want


@pytest.mark.parametrize(
    "text, want",
    [
        (GPL, [("GPL-2.0-or-later", "gpl-short", 2)]),
        ("This is free and unencumbered software released into the public domain.", [("Unlicense", "unlicense", 1)]),
        ("All rights reserved, " + GPL, [("LicenseRef-all-rights-reserved", "reserved", 1), ("GPL-2.0-or-later", "gpl-short", 2)]),
        ("Code is released under the MIT License; texts are licensed under CC BY 4.0.", [("MIT", "mit-named", 1), ("CC-BY-4.0", "cc-named", 1)]),
    ],
)
def test_several_in_one_sentence(text, want):
    assert [m[:3] for m in licenses.scan(text)] == want


ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_BODY = """                              Apache License
                        Version 2.0, January 2004
                     http://www.apache.org/licenses/

TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

1. Definitions.

   "License" shall mean the terms and conditions for use, reproduction,
   and distribution as defined by Sections 1 through 9 of this document.

2. Grant of Copyright License. Subject to the terms and conditions of
   this License, each Contributor hereby grants to You a perpetual,
   worldwide, non-exclusive, no-charge, royalty-free, irrevocable
   copyright license to reproduce.

3. Grant of Patent License. Subject to the terms and conditions of
   this License, each Contributor hereby grants to You a perpetual,
   worldwide, non-exclusive, no-charge, royalty-free, irrevocable
   (except as stated in this section) patent license to make."""
GPL_BODY = """                    GNU {k}GENERAL PUBLIC LICENSE
                       Version {v}

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  {one}

{two}"""
GPL2 = GPL_BODY.format(k="", v="2, June 1991", one="The licenses for most software are designed to take away your\nfreedom to share and change it.", two="0. This License applies to any program or other work which contains\na notice placed by the copyright holder saying so.")
GPL3 = ("The GNU {}General Public License is a free, copyleft license for\nsoftware and other kinds of works.", "All rights granted under this License are granted for the term of\ncopyright on the Program, and are irrevocable provided the stated\nconditions are met.")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


@pytest.mark.parametrize("mark", ["", "# ", " * "])
@pytest.mark.parametrize(
    "text, want",
    [
        (ZLIB, ("Zlib", "zlib-full")),
        (APACHE_BODY, ("Apache-2.0", "apache-body")),
        (GPL2, ("GPL-2.0", "gpl2-body")),
        (GPL_BODY.format(k="", v="3, 29 June 2007", one=GPL3[0].format(""), two=GPL3[1]), ("GPL-3.0", "gpl3-body")),
        (GPL_BODY.format(k="AFFERO ", v="3, 19 November 2007", one=GPL3[0].format("Affero "), two=GPL3[1]), ("AGPL-3.0", "gpl3-body")),
        (MPL, ("MPL-2.0", "mpl-header")),
        ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0", ("EPL-2.0", "epl-named")),
        ("Distributed under the Boost Software License,\nVersion 1.0. (See accompanying file)", ("BSL-1.0", "boost-named")),
        ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", ("CC-BY-SA-4.0", "cc-long")),
        ("placed in the public\ndomain.", ("LicenseRef-public-domain", "public-domain")),
        ("All rights\nreserved.", ("LicenseRef-all-rights-reserved", "reserved")),
        ("Licensed under CC0 1.0", ("CC0-1.0", "cc0-named")),
    ],
)
def test_bodies_and_wrapped_lines(spark, text, want, mark):
    text = "".join(mark + line for line in text.splitlines(True))
    assert [m[:2] for m in licenses.scan(text)] == [want]
    assert re.search(licenses.HINT, text)


def test_every_sentence_is_found_and_hinted():
    fill = {"{v}": "2.0", "{v}{l}": "2.0 or later", "{k}": "lesser", "{cc}": "by-sa", "cc-{cc}": "cc-by", "{ccname}": "attribution-sharealike", "{n}-clause": "3-clause", "{id}": "mit", "*": "any other words"}
    for name, sentence in licenses.SENTENCES.items():
        for short in (False, True):
            words = [fill.get(w, w.removesuffix("?").split("|")[-1 if short else 0]) for w in sentence.split() if not (short and w.endswith("?"))]
            plain = " ".join(words)
            assert licenses.normalise(plain) == plain, name
            assert name in {n for n, _ in licenses.identify("some words " + plain + " and more")}, name
            assert re.search(licenses.HINT, plain), name


def test_documents_against_search(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "LicenseRef-all-rights-reserved",
    }
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    want = Counter((d, name) for d, t in texts.items() for line, name in lines.items() for _ in re.findall(re.escape(line), t))
    rows = licenses.scan_licenses(df).collect()
    assert Counter((r["doc_id"], r["license"]) for r in rows) == want and want
    for r in rows:
        assert any(line in texts[r["doc_id"]][r["first"] : r["last"]] for line in lines)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (4, "word " * 200000 + ". Released under the MIT License. " + "x " * 100000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    assert Counter(r["doc_id"] for r in licenses.scan_licenses(df).collect()) == {None: 1, 3: 2, 4: 1}
    assert licenses.scan_licenses(df.limit(0)).count() == 0
