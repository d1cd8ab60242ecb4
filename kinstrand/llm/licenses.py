"""Licence scans by sentence rules.

A text is cut into sentences, which are normalised, so that line breaks, comment signs and punctuation do not matter. Known
licence sentences stand in a table; the words at each place of a sentence are looked up in it by the hash of the first two,
and what is found there is compared to its end. So a sentence becomes a sequence of identifiers. Licence rules are such
sequences; they are tried in their order at every place of a document's identifiers, and the first that matches takes its
sentences. Documents are scanned as a whole, but for those without any of the words that a known sentence must have.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.arrow_text import bounded_batches, slices

MATCHES = "doc_id long, license string, rule string, n_sentences long, first long, last long"

# Known licence sentences in normalised form (lower case; letters, digits, dots inside numbers, + and - only;
# single spaces). a|b is either word, a? may be missing, * stands for up to 24 words, {v} for a version, {k} for a kind of
# GPL or none, {cc} for a kind of Creative Commons licence, {l} for "or later" or nothing, {id} for any word.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "notice-in-copies": "the above copyright notice and this permission notice including? the? next? paragraph? shall be included in all copies or substantial portions of the software",
    "as-is-provided": "the software is provided as is without warranty of any kind",
    "as-is-bsd": "this software is provided by * as is and any express or implied warranties",
    "no-liability": "in no event shall|will * be held? liable for any",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above? copyright notice",
    "bsd-binary": "redistributions in binary form must reproduce the above? copyright notice",
    "bsd-endorse": "neither the name|names of * may be used to endorse or promote products derived from",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display",
    "isc-grant": "permission to use copy modify and? or? distribute this software for any purpose with or without fee is hereby granted",
    "isc-disclaim": "the software is provided as is and the author disclaims all warranties",
    "zlib-as-is": "this software is provided as-is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "zlib-origin": "the origin of this software must not be misrepresented",
    "zlib-altered": "altered source versions must be plainly marked as such",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "boost-title": "boost software license version {v}",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "boost-notice": "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies",
    "boost-named": "distributed under the boost software license {v}",
    "apache-grant": "licensed under the apache license {v}",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "software distributed under the license is distributed on an as is basis",
    "apache-title": "apache license {v} january|february 2000|2004",
    "apache-terms": "terms and conditions for use reproduction and distribution 1? definitions?",
    "apache-define": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "apache-copyright": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable copyright license",
    "apache-patent": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable except as stated in this section patent license",
    "gpl-free": "is free software you can redistribute it and or? modify it under the terms of the gnu {k} general public license",
    "gpl-later": "either version {v} of the license or at your option any later version",
    "gpl-only": "under the terms of version {v} of the gnu {k} general public license",
    "gpl-hope": "is distributed in the hope that it will be useful",
    "gpl-see": "you should have received a copy of the gnu {k} general public license",
    "gpl-named": "licensed|released|distributed|available under the? terms? of? the? gnu {k} general public license {v}{l}",
    "gpl-title": "gnu {k} general public license version {v} june|february|november|29|19",
    "gpl-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl2-preamble": "the licenses for most software are designed to take away your freedom to share and change it",
    "gpl2-applies": "this license applies to any program or other work which contains a notice placed by the copyright holder",
    "gpl3-preamble": "the gnu {k} general public license is a free copyleft license for software and other kinds of works",
    "gpl3-rights": "all rights granted under this license are granted for the term of copyright on the program and are irrevocable provided the stated conditions are met",
    "lgpl3-adds": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license",
    "lgpl2-library": "a library means a collection of software functions and or? data prepared so as to be conveniently linked with application programs",
    "mit-named": "licensed|released|distributed|available|is under the? terms? of? the mit|expat license",
    "bsd-named": "licensed|released|distributed|available under the? terms? of? the|a? {n}-clause bsd license",
    "mpl-title": "mozilla public license version {v}",
    "mpl-define": "means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "mpl-grant": "each contributor hereby grants you a world-wide royalty-free non-exclusive license",
    "mpl-named": "subject to the terms of the mozilla public license {v}",
    "mpl-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "epl-title": "eclipse public license {v}",
    "epl-provided": "the accompanying program is provided under the terms of this eclipse public license agreement",
    "epl-accept": "any use reproduction or distribution of the program constitutes recipients acceptance of this agreement",
    "epl-named": "made available under the terms of the eclipse public license {v}",
    "cc-title": "creative commons {ccname} {v} international|unported|generic public? license?",
    "cc-accept": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons {ccname} {v} international public license",
    "cc-firm": "creative commons corporation is not a law firm and does not provide legal services",
    "cc0-title": "creative commons legal code cc0 {v} universal",
    "cc0-waive": "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmers copyright and related rights",
    "cc-named": "licensed|released|distributed|available under the|a? cc|creative-commons {cc} {v}",
    "cc-short": "licensed|released|distributed|available under the|a? cc-{cc} {v}",
    "cc-work": "licensed|released|distributed|available under the|a? creative commons {cc} {v}",
    "cc-long": "licensed|released|distributed|available under the|a? creative commons {ccname} {v} international|unported|generic? public? license?",
    "cc0-named": "licensed|released|distributed|available under the|a? cc0 {v}",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "public-domain": "is|are|placed|dedicated|released hereby? in|into|to the public domain",
    "spdx": "spdx-license-identifier {id}",
    "reserved": "all rights reserved",
}

# Licence rules in the order in which they are tried: name, licence, sentences in order, and how many other
# sentences may stand between two of them. {v}, {k} and {l} come from the sentences.
RULES = [
    ("mit-full", "MIT", ["mit-grant", "notice-in-copies", "as-is-provided", "no-liability"], 3),
    ("mit-core", "MIT", ["mit-grant", "notice-in-copies"], 3),
    ("boost-body", "BSL-{v}", ["boost-title", "boost-grant", "boost-notice", "as-is-provided"], 6),
    ("boost-core", "BSL-1.0", ["boost-grant", "boost-notice"], 6),
    ("boost-named", "BSL-{v}", ["boost-named"], 3),
    ("bsd-4", "BSD-4-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "as-is-bsd"], 3),
    ("bsd-3", "BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse", "as-is-bsd", "no-liability"], 3),
    ("bsd-2", "BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "as-is-bsd", "no-liability"], 3),
    ("isc-full", "ISC", ["isc-grant", "isc-disclaim"], 3),
    ("zlib-full", "Zlib", ["zlib-as-is", "no-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"], 4),
    ("zlib-core", "Zlib", ["zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"], 4),
    ("apache-body", "Apache-{v}", ["apache-title", "apache-terms", "apache-define", "apache-copyright", "apache-patent"], 60),
    ("apache-header", "Apache-{v}", ["apache-grant", "apache-compliance", "apache-copy", "apache-as-is"], 3),
    ("apache-title", "Apache-{v}", ["apache-title", "apache-terms"], 6),
    ("gpl2-body", "{k}GPL-{v}", ["gpl-title", "gpl-verbatim", "gpl2-preamble", "gpl2-applies"], 60),
    ("lgpl2-body", "{k}GPL-{v}", ["gpl-title", "gpl-verbatim", "gpl2-preamble", "lgpl2-library"], 90),
    ("gpl3-body", "{k}GPL-{v}", ["gpl-title", "gpl-verbatim", "gpl3-preamble", "gpl3-rights"], 60),
    ("lgpl3-body", "{k}GPL-{v}", ["gpl-title", "gpl-verbatim", "lgpl3-adds"], 9),
    ("gpl-title", "{k}GPL-{v}", ["gpl-title", "gpl-verbatim"], 9),
    ("gpl-header", "{k}GPL-{v}-or-later", ["gpl-free", "gpl-later", "gpl-hope", "gpl-see"], 3),
    ("gpl-short", "{k}GPL-{v}-or-later", ["gpl-free", "gpl-later"], 3),
    ("apache-named", "Apache-{v}", ["apache-grant"], 3),
    ("gpl-named", "{k}GPL-{v}{l}", ["gpl-named"], 3),
    ("gpl-only", "{k}GPL-{v}-only", ["gpl-only"], 3),
    ("mit-named", "MIT", ["mit-named"], 3),
    ("bsd-named", "BSD-{v}-Clause", ["bsd-named"], 3),
    ("mpl-body", "MPL-{v}", ["mpl-title", "mpl-define", "mpl-grant"], 60),
    ("mpl-header", "MPL-{v}", ["mpl-named", "mpl-obtain"], 3),
    ("mpl-named", "MPL-{v}", ["mpl-named"], 3),
    ("epl-body", "EPL-{v}", ["epl-title", "epl-provided", "epl-accept"], 9),
    ("epl-named", "EPL-{v}", ["epl-named"], 3),
    ("cc0-body", "CC0-{v}", ["cc0-title", "cc-firm", "cc0-waive"], 40),
    ("cc0-named", "CC0-{v}", ["cc0-named"], 3),
    ("cc-body", "CC-{k}-{v}", ["cc-title", "cc-accept"], 40),
    ("cc-firm-body", "CC-{k}-{v}", ["cc-firm", "cc-title", "cc-accept"], 40),
    ("cc-accepted", "CC-{k}-{v}", ["cc-accept"], 3),
    ("cc-named", "CC-{k}-{v}", ["cc-named"], 3),
    ("cc-short", "CC-{k}-{v}", ["cc-short"], 3),
    ("cc-work", "CC-{k}-{v}", ["cc-work"], 3),
    ("cc-long", "CC-{k}-{v}", ["cc-long"], 3),
    ("unlicense", "Unlicense", ["unlicense"], 3),
    ("public-domain", "LicenseRef-public-domain", ["public-domain"], 3),
    ("spdx", "{k}", ["spdx"], 3),
    ("reserved", "LicenseRef-all-rights-reserved", ["reserved"], 3),
]
#: Every known sentence has one of these words, whatever stands between its words.
HINT = r"(?i)licen[sc]e|permission|permitted|redistribut|copyright|warrant|liab|software|domain|spdx|hope|reserved|affirmer|commons|endorse|altered|modif|terms|recipient|obtain|\bcc"

_KINDS = {"lesser": "L", "library": "L", "affero": "A", "zero": "0"}
_CC_WORDS = {"attribution": "BY", "noncommercial": "NC", "sharealike": "SA", "noderivatives": "ND", "noderivs": "ND"}
_CC = r"by(?:-nc)?(?:-sa|-nd)?|zero|0"
#: What the parts of a known sentence match, after the space before them.
_PART = {
    "{v}": r" (?:version |v ?)?(?P<v>\d+(?:\.\d+)?)",
    "{v}{l}": r" (?:version |v ?)?(?P<v>\d+(?:\.\d+)?)(?P<l>(?: or at your option)?(?: or)?(?: any)? later| or newer|\+)?",
    "{k}": r"(?: (?P<k>lesser|library|affero))?",
    "{cc}": rf" (?P<k>{_CC})",
    "cc-{cc}": rf" cc-(?P<k>{_CC})",
    "{ccname}": r" (?P<k>attribution(?:[ -](?:noncommercial|sharealike|noderivatives|noderivs))*)",
    "{n}-clause": r" (?P<v>[234])[ -]clause",
    "{id}": r" (?P<k>[a-z0-9.+-]+)",
    "*": r"(?: \S+){0,24}?",
}
_HEADS = {"{k}": ["", "lesser", "library", "affero"]}


def _compiled() -> dict[tuple[str, ...], list[tuple[str, re.Pattern]]]:
    """The known sentences by their first two words, or the first where the second is open."""
    table = defaultdict(list)
    for name, sentence in SENTENCES.items():
        pattern, heads = "", [()]
        for word in sentence.split():
            if word in _PART:
                pattern += _PART[word]
                options = _HEADS.get(word, [None])
            else:
                options = word.removesuffix("?").split("|")
                some = " (?:" + "|".join(map(re.escape, options)) + ")"
                pattern += f"(?:{some})?" if word.endswith("?") else some
                options = [*options, *([""] if word.endswith("?") else [])]
            heads = [h if len(h) == 2 or (h and h[-1] is None) else (*h, o) if o != "" else h for h, o in product(heads, options)]
        rule = re.compile(pattern[1:] + r"(?= |$)")
        for head in dict.fromkeys(heads):
            table[tuple(w for w in head if w is not None)].append((name, rule))
    return dict(table)


_TABLE = _compiled()
_END = re.compile(r"(?<=[.!?])(?<![ \n][Vv]\.)(?=\s)|\n\s*\n|\n(?=\s*(?:[-•]|\d+[.)])\s)")
_COMMENT = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|dnl\b|rem\b)[ \t]*")
_OTHER = re.compile(r"[^a-z0-9.+-]+")
_DOT = re.compile(r"\.(?!\d)|(?<!\d)\.")


def sentences(text: str) -> Iterator[tuple[int, int, str]]:
    """First and last position of each sentence of a text, and its normalised form.

    A sentence ends at a sign followed by white space, at a blank line, or before an item of a list.
    """
    at = 0
    for m in [*_END.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            first = at + len(text[at:end]) - len(text[at:end].lstrip())
            yield first, end, normalise(text[at:end])
        at = m.end() if m else end


def normalise(sentence: str) -> str:
    plain = _COMMENT.sub("", sentence).lower().replace("licence", "license").replace("‘", "").replace("’", "").replace("'", "")
    plain = _DOT.sub(" ", _OTHER.sub(" ", plain))
    return " ".join(w for w in plain.split() if w.strip("-+"))


def identify(sentence: str) -> list[tuple[str, dict[str, str]]]:
    """The identifiers of all known licence sentences in a normalised sentence, in order of their places, and the named
    parts of their patterns. What lies inside another is part of it."""
    words, found, at = sentence.split(" "), [], 0
    for k, word in enumerate(words):
        for key in ((word, words[k + 1]) if k + 1 < len(words) else None, (word,)):
            for name, rule in _TABLE.get(key, ()):
                m = rule.match(sentence, at)
                if m:
                    found.append((at, -m.end(), name, m))
        at += len(word) + 1
    out, end = [], -1
    for _, last, name, m in sorted(found, key=lambda x: x[:2]):
        if -last > end:
            out.append((name, {k: v or "" for k, v in m.groupdict().items()}))
            end = -last
    return out


def _label(template: str, parts: dict[str, str]) -> str:
    kind = parts.get("k", "")
    if kind.startswith("attribution"):
        kind = "-".join(_CC_WORDS[w] for w in kind.replace("-", " ").split())
    kind = _KINDS.get(kind, kind.upper() if template.startswith("CC") else kind)
    version = parts.get("v", "")
    if "GPL" in template and version and "." not in version:
        version += ".0"
    later = ("-or-later" if parts.get("l") else "-only") if "{l}" in template else ""
    return template.format(k=kind, v=version, l=later).rstrip("-")


def scan(text: str) -> list[tuple[str, str, int, int, int]]:
    """Licence, rule, number of known licence sentences, first and last position of every match, in order.

    Several known ones may share a sentence of the text, as where ``;`` or a comma joins them."""
    known = []
    for number, (first, last, plain) in enumerate(sentences(text)):
        known += [(number, name, parts, first, last) for name, parts in (identify(plain) if plain else ())]
    out, k = [], 0
    while k < len(known):
        for rule, label, wanted, gap in RULES:
            took = known[k : k + len(wanted)]
            if [x[1] for x in took] == wanted and all(b[0] - a[0] <= gap + 1 for a, b in zip(took, took[1:], strict=False)):
                parts: dict[str, str] = {}
                for x in took:
                    parts |= {p: v for p, v in x[2].items() if v}
                out.append((_label(label, parts), rule, len(took), took[0][3], took[-1][4]))
                k += len(took)
                break
        else:
            out.append(("UNKNOWN", known[k][1], 1, known[k][3], known[k][4]))
            k += 1
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence matches in whole texts of ``docs`` (doc_id, text), one row each (``MATCHES``).

    ``first`` and ``last`` are positions (code points) of the sentences in the text. A known sentence that no rule takes
    is reported as ``UNKNOWN`` with its identifier as rule. Texts that are null, empty or without known sentences give no
    rows; repeated rows and rows with a null id are scanned each; an empty table gives no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hinted = pc.fill_null(pc.match_substring_regex(batch.column("text"), HINT), False)
            rows = []
            for part in slices(batch.filter(hinted), "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    rows += [(doc, *m) for m in scan(text)]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "license", "rule", "n_sentences", "first", "last"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MATCHES)
