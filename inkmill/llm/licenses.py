"""Licence scan by sentence rules.

A text is cut into sentences, each sentence is normalised, and known licence sentences give identifiers.
Ordered rules then read a document's sequence of identifiers from left to right: at each place the first
rule whose identifiers stand there, one behind the other, names a licence and consumes them. Longer rules
come first, so that a whole notice is one finding and its single sentences are not found again.

A sentence ends with a full stop, question or exclamation mark before white space, or with a line. As
licence texts are also wrapped, a paragraph's lines are joined as well, and two lines of a title; and as they are written
in one run, too, semicolons, colons and the ends of addresses also end one, and a long known sentence also counts
behind a title or a name that runs on into it. What is found in several of these ways
counts once. Normalising drops comment signs and mark-up, lower-cases, and turns all else but letters and digits into
single spaces. Sentences that are no licence sentence may stand between the identifiers of one rule.

Besides whole sentences there are three forms with a gap: sentences with any organisation's name in them (`GAPS`),
those that put a work under a licence by its name or are its title (`NAMES`), and declarations, a line of
`License:` or `SPDX-License-Identifier:` before an expression of public identifiers with OR, AND, WITH, `+` and
parentheses, all of which are given in their order. The name alone never counts within other text.

Defined results: null, empty and licence-free texts have no findings and one row; equal texts have equal
findings; a sentence that repeats is found each time; an expression with an unknown identifier is none; a table
without rows gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from inkmill.llm._shared import small_batches

# Public licence sentences, normalised, with their identifiers.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "this software is released under the mit license": "mit-ref",
    "this project is released under the mit license": "mit-ref",
    "this software is licensed under the mit license": "mit-ref",
    "this code is licensed under the mit license": "mit-ref",
    "spdx license identifier mit": "mit-ref",
    "spdx license identifier apache 2 0": "apache2-ref",
    "spdx license identifier bsd 2 clause": "bsd2-ref",
    "spdx license identifier bsd 3 clause": "bsd3-ref",
    "spdx license identifier isc": "isc-title",
    "spdx license identifier mpl 2 0": "mpl2-ref",
    "spdx license identifier gpl 2 0": "gpl2-ref",
    "spdx license identifier gpl 2 0 only": "gpl2-ref",
    "spdx license identifier gpl 2 0 or later": "gpl2-later",
    "spdx license identifier gpl 3 0": "gpl3-ref",
    "spdx license identifier gpl 3 0 only": "gpl3-ref",
    "spdx license identifier gpl 3 0 or later": "gpl3-later",
    "spdx license identifier lgpl 2 1": "lgpl21-ref",
    "spdx license identifier lgpl 2 1 only": "lgpl21-ref",
    "spdx license identifier lgpl 2 1 or later": "lgpl21-later",
    "spdx license identifier lgpl 3 0 only": "lgpl3-ref",
    "spdx license identifier lgpl 3 0 or later": "lgpl3-later",
    "spdx license identifier agpl 3 0 only": "agpl3-ref",
    "spdx license identifier agpl 3 0 or later": "agpl3-later",
    "spdx license identifier cc0 1 0": "cc0-ref",
    "spdx license identifier epl 2 0": "epl2-ref",
    "spdx license identifier zlib": "zlib-ref",
    "spdx license identifier bsl 1 0": "bsl1-ref",
    "spdx license identifier unlicense": "unlicense-ref",
    "spdx license identifier cc by 4 0": "ccby4-ref",
    "spdx license identifier cc by sa 4 0": "ccbysa4-ref",
    "licensed under the gnu lesser general public license version 2 1": "lgpl21-ref",
    "licensed under the gnu lesser general public license version 3": "lgpl3-ref",
    "licensed under the gnu affero general public license version 3": "agpl3-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the bsd 2 clause license": "bsd2-ref",
    "licensed under the bsd 3 clause license": "bsd3-ref",
    "bsd 2 clause license": "bsd2-ref",
    "bsd 3 clause license": "bsd3-ref",
    "licensed under the mozilla public license version 2 0": "mpl2-ref",
    "licensed under the eclipse public license version 2 0": "epl2-ref",
    "eclipse public license v 2 0": "epl2-ref",
    "cc0 1 0 universal": "cc0-ref",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-ref",
    "boost software license version 1 0": "bsl1-ref",
    "distributed under the boost software license version 1 0": "bsl1-ref",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "gnu lesser general public license": "lgpl-title",
    "gnu affero general public license": "agpl-title",
    "gnu general public license": "gpl-title",
    "version 2 1 february 1999": "lgpl21-date",
    "version 2 june 1991": "gpl2-date",
    "version 3 29 june 2007": "v3-date",
    "version 3 19 november 2007": "agpl3-date",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "isc license": "isc-title",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-licensed",
    "apache license version 2 0": "apache2-title",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-limits",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "licensed under cc by 4 0": "ccby4-ref",
    "licensed under cc by sa 4 0": "ccbysa4-ref",
    "licensed under cc by nc 4 0": "ccbync4-ref",
    "licensed under cc by nd 4 0": "ccbynd4-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4-ref",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "all rights reserved": "reserved",
    "apache license version 2 0 january 2004": "apache2-title",
}
# Beginning and end of sentences with a name between.
GAPS = (
    ("neither the name of ", " may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse"),
    ("the name of ", " may not be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse"),
    ("neither the names of ", " may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse"),
    ("all advertising materials mentioning features or use of this software must display the following acknowledgement", "", "bsd-advert"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation ", " provided with the distribution", "bsd-binary"),
)
# Licences by their public identifiers, each with names it goes by, normalised.
PLAIN_NAMES = {
    "MIT": ("mit", "expat"), "MIT-0": ("mit no attribution", "mit 0"), "Apache-2.0": ("apache", "apache 2 0", "apache 2", "apache v2", "apache license 2 0", "apache license v2 0", "apache license version 2 0", "apache software license 2 0"),
    "Apache-1.1": ("apache software license 1 1", "apache license version 1 1"), "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"), "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"),
    "BSD-4-Clause": ("bsd 4 clause", "4 clause bsd", "original bsd"), "0BSD": ("0bsd", "zero clause bsd", "bsd zero clause"), "ISC": ("isc",), "Zlib": ("zlib",), "X11": ("x11",), "NCSA": ("university of illinois ncsa open source",), "PostgreSQL": ("postgresql",),
    "Artistic-1.0": ("artistic license 1 0", "artistic"), "Artistic-2.0": ("artistic license 2 0", "artistic 2 0", "artistic license version 2 0"), "WTFPL": ("wtfpl", "do what the fuck you want to public license"), "Unlicense": ("unlicense",), "CC0-1.0": ("cc0 1 0", "cc0", "cc0 1 0 universal", "creative commons zero"),
    "MPL-1.1": ("mozilla public license 1 1", "mozilla public license version 1 1", "mpl 1 1"), "MPL-2.0": ("mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0"), "EPL-1.0": ("eclipse public license 1 0", "eclipse public license version 1 0", "epl 1 0"),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license version 2 0", "epl 2 0"), "BSL-1.0": ("boost software license 1 0", "boost software license version 1 0", "boost software"), "EUPL-1.2": ("european union public licence 1 2", "european union public licence v 1 2", "eupl 1 2"),
    "OSL-3.0": ("open software license 3 0", "open software license version 3 0"), "AFL-3.0": ("academic free license 3 0", "academic free license version 3 0"), "MS-PL": ("microsoft public license", "ms pl"), "MS-RL": ("microsoft reciprocal license", "ms rl"), "CDDL-1.0": ("common development and distribution license 1 0", "cddl 1 0"),
    "OFL-1.1": ("sil open font license 1 1", "sil open font license version 1 1", "open font license"), "UPL-1.0": ("universal permissive license 1 0", "upl 1 0"), "PSF-2.0": ("python software foundation license version 2", "psf"), "Python-2.0": ("python license 2 0",), "Ruby": ("ruby",), "Vim": ("vim",), "ODbL-1.0": ("open database license 1 0", "odbl"),
    "JSON": ("json",), "curl": ("curl",), "Libpng": ("libpng",), "OpenSSL": ("openssl",), "PHP-3.01": ("php license version 3 01", "php 3 01"), "W3C": ("w3c software notice and license", "w3c"), "ZPL-2.1": ("zope public license 2 1", "zpl 2 1"), "BlueOak-1.0.0": ("blue oak model license 1 0 0",), "CPL-1.0": ("common public license 1 0",), "IPL-1.0": ("ibm public license 1 0",), "LPPL-1.3c": ("latex project public license 1 3c",), "HPND": ("historical permission notice and disclaimer",), "SSPL-1.0": ("server side public license version 1",), "BUSL-1.1": ("business source license 1 1",), "Elastic-2.0": ("elastic license 2 0",), "MulanPSL-2.0": ("mulan permissive software license version 2",),
}


def _names() -> tuple[dict[str, str], dict[str, str]]:
    """(licences by their names, public identifiers by their lower case); families by version are put together here."""
    names = {n: i for i, some in PLAIN_NAMES.items() for n in some}
    ids = {i.lower(): i for i in PLAIN_NAMES}
    for short, long, versions in (("GPL", "gnu general public license", ("1.0", "2.0", "3.0")), ("LGPL", "gnu lesser general public license", ("2.1", "3.0")), ("LGPL", "gnu library general public license", ("2.0",)), ("AGPL", "gnu affero general public license", ("3.0",))):
        for v in versions:
            only = f"{short}-{v}-only"
            ids |= {f"{short}-{v}".lower(): only, only.lower(): only, f"{short}-{v}-or-later".lower(): f"{short}-{v}-or-later", f"{short}-{v}+".lower(): f"{short}-{v}-or-later"}
            said = v.removesuffix(".0").replace(".", " ")
            for name in (long, long.removeprefix("gnu "), short.lower(), f"gnu {short.lower()}"):
                for end in (f" version {said}", f" v {said}", f" v{said}", f" {said}", f"v{said}", *([f" {said} 0", f" v{said} 0", f" version {said} 0"] if " " not in said else [])):
                    names |= {f"{name}{end}": only, f"{name}{end} or later": f"{short}-{v}-or-later", f"{name}{end} only": only}
    # The parts of these licences' names
    parts = {"BY": "attribution", "SA": "sharealike", "NC": "noncommercial", "ND": "noderivatives"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            spdx, said = f"CC-{kind}-{v}", v.replace(".", " ")
            ids[spdx.lower()] = spdx
            for name in (f"cc {kind.lower().replace('-', ' ')} {said}", f"creative commons {' '.join(parts[p] for p in kind.split('-'))} {said}"):
                names |= {name: spdx, f"{name} international": spdx, f"{name} unported": spdx}
    return names, ids


NAMES, IDS = _names()
#: Titles that say for themselves that they are licences.
TELLING = re.compile(r"licen[cs]e|^(?:0bsd|wtfpl|cc0.*|creative commons .*)$")
UNDER = re.compile(r"^(?:(?:this|the|these|all|our|my) (?:[^\W_]+ ){1,4}?(?:is|are) |it is )?(?:dual |free software )?(?:licensed|released|distributed|available|published|provided|made available) under (?:the )?(?:terms of )?(?:the )?(?:a )?")
LAST_WORD = re.compile(r" licen[cs]e$")
DECLARED = re.compile(r"(?i)^[\W_]*(?:SPDX-License-Identifier|licen[cs]e)[\"']?\s*[:=]\s*[\"'`]?([(A-Za-z0-9][A-Za-z0-9.+() -]*[A-Za-z0-9.+)])[\W_]*$")
WORD = re.compile(r"[A-Za-z0-9.+-]+|[()]")
# Exceptions that stand behind WITH.
EXCEPTIONS = frozenset(("classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "bison-exception-2.2", "autoconf-exception-3.0", "font-exception-2.0", "linux-syscall-note", "openssl-exception", "swift-exception", "universal-foss-exception-1.0"))
# Licences and the identifiers that name them, in the order in which they are tried.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("Apache-2.0", ("apache2-licensed", "apache2-comply", "apache2-copy", "apache2-asis", "apache2-limits")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty", "gpl-details")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("LGPL-2.1-only", ("lgpl-title", "lgpl21-date")),
    ("LGPL-3.0-only", ("lgpl-title", "v3-date")),
    ("AGPL-3.0-only", ("agpl-title", "agpl3-date")),
    ("GPL-2.0-only", ("gpl-title", "gpl2-date")),
    ("GPL-3.0-only", ("gpl-title", "v3-date")),
    ("ISC", ("isc-title", "isc-grant")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-title",)),
    ("Zlib", ("zlib-grant",)),
    ("Zlib", ("zlib-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("LGPL-2.1-only", ("lgpl21-ref",)),
    ("LGPL-3.0-only", ("lgpl3-ref",)),
    ("AGPL-3.0-only", ("agpl3-ref",)),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("EPL-2.0", ("epl2-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("BSL-1.0", ("bsl1-ref",)),
    ("Unlicense", ("unlicense-ref",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache2-licensed",)),
    ("Apache-2.0", ("apache2-title",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("CC-BY-4.0", ("ccby4-ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4-ref",)),
    ("CC-BY-NC-4.0", ("ccbync4-ref",)),
    ("CC-BY-ND-4.0", ("ccbynd4-ref",)),
    ("Unlicense", ("unlicense-grant",)),
    ("all-rights-reserved", ("reserved",)),
    *((spdx, (f"id:{spdx}",)) for spdx in sorted({*IDS.values(), *NAMES.values()})),
)
FIRST_RULES: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
for _rule in RULES:
    FIRST_RULES.setdefault(_rule[1][0], []).append(_rule)
COMMENT = re.compile(r"(?m)^[ \t]*(?:#+|//+|/\*+|\*+/?|--+|;+|%+|<!--|\"\"\")[ \t]?")
PARAGRAPH = re.compile(r"\n[ \t]*\n")
STOP = re.compile(r"[.!?](?=\s|$)|[:;](?=\s*(?:\n|$))")
OTHER = re.compile(r"[\W_]+")
LINE = re.compile(r"[^\n]+")
#: Ends of sentences in texts without lines.
INNER = re.compile(r"https?://\S+|[.!?](?=\s|$)|[;:](?!//)")
#: Full stops of shortened words end no sentence that has an organisation's name in it.
NO_STOP = re.compile(r"(?<!\b[Ii][Nn][Cc])(?<!\b[Ll][Tt][Dd])(?<!\b[Cc][Oo])(?<!\b[Cc][Oo][Rr][Pp])(?<!\b[A-Z])[.!?](?=\s|$)|[:;](?=\s*(?:\n|$))")
#: What texts have that are looked at for sentences cut otherwise than by lines and full stops.
HINT = re.compile(r"(?i)licen[cs]|copyright|permi|redistribut|warrant|software|liable")
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
#: Known sentences of more than so many characters by these at their end, and the longest of them.
LONG_END = 80
ENDINGS: dict[str, list[str]] = {}
for _known in sorted(SENTENCES, key=len, reverse=True):
    if len(_known) > LONG_END:
        ENDINGS.setdefault(_known[-LONG_END:], []).append(_known)
LONGEST = max(map(len, SENTENCES))
#: Two lines that are one title, at most.
TITLE = 160
FIRST_WORDS = frozenset(s.split()[0] for s in (*SENTENCES, *(g[0] for g in GAPS), *NAMES)) | frozenset("the a this these all our my it dual free licensed released distributed available published provided made".split())
FIRST = re.compile(r"[^\W_]+")


def _sentences(text: str, start: int, end: int, stops: re.Pattern = STOP) -> Iterator[tuple[int, int]]:
    at = start
    for stop in stops.finditer(text, start, end):
        yield at, stop.end()
        at = stop.end()
    if at < end:
        yield at, end


def normalise(sentence: str) -> str:
    return OTHER.sub(" ", sentence.lower()).strip()


def _named(sentence: str) -> str | None:
    """The licence of a sentence that puts something under it by its name, or that is its title."""
    under = UNDER.match(sentence)
    name = sentence[under.end() :] if under else sentence.removeprefix("the ")
    found = NAMES.get(name) or NAMES.get(LAST_WORD.sub("", name))
    return found if found and (under or TELLING.search(name)) else None


def _identify(text: str, a: int, b: int) -> str | None:
    # most sentences end here: their first word begins no known one
    first = FIRST.search(text, a, b)
    if not first or first[0].lower() not in FIRST_WORDS:
        return None
    sentence = normalise(text[a:b])
    if name := SENTENCES.get(sentence):
        return name
    for begin, end, name in GAPS:
        if sentence.startswith(begin) and sentence.endswith(end):
            return name
    return f"id:{spdx}" if len(sentence) <= TITLE and (spdx := _named(sentence)) else None


def _ending(text: str, a: int, b: int) -> tuple[int, str] | None:
    """(position, identifier) of a long known sentence at the end of what runs on before it without a stop."""
    if b - a <= LONG_END:
        return None
    words = [m.start() for m in FIRST.finditer(text, max(a, b - 2 * LONGEST), b)]
    sentence = normalise(text[max(a, b - 2 * LONGEST) : b])
    for known in ENDINGS.get(sentence[-LONG_END:], ()):
        if sentence.endswith(f" {known}"):
            return words[-len(known.split())], SENTENCES[known]
    return None


def expression(text: str) -> list[tuple[int, str]] | None:
    """(position, licence) of an expression of public identifiers; None if it is none."""
    found, due, depth, at = [], True, 0, 0
    exception = False
    for m in WORD.finditer(text):
        if text[at : m.start()].strip():
            return None
        at, word = m.end(), m[0]
        if word == "(":
            if not due or exception:
                return None
            depth += 1
        elif word == ")":
            if due or exception or not depth:
                return None
            depth -= 1
        elif word.upper() in ("AND", "OR", "WITH"):
            if due or exception:
                return None
            due, exception = word.upper() != "WITH", word.upper() == "WITH"
        elif exception:
            if word.lower() not in EXCEPTIONS:
                return None
            exception = False
        else:
            spdx = IDS.get(word.lower()) or IDS.get(word.lower().removesuffix("+"))
            if not due or not spdx:
                return None
            found.append((m.start(), spdx))
            due = False
    return None if due or depth or exception or text[at:].strip() else found


def identifiers(text: str | None) -> list[tuple[int, str]]:
    """(position, identifier) of the known sentences of a text, in its order."""
    if not text:
        return []
    blank = lambda m: " " * len(m[0])
    text = COMMENT.sub(blank, text)
    if "<" in text:
        text = TAG.sub(blank, text)
    found: dict[int, tuple[int, str]] = {}
    seen: set[tuple[int, int]] = set()

    def add(spans: Iterator[tuple[int, int]]) -> None:
        for a, b in spans:
            if (a, b) in seen:
                continue
            seen.add((a, b))
            if name := _identify(text, a, b):
                start = b - len(text[a:b].lstrip())
                # of two that begin at one place the longer one counts
                if start not in found or found[start][0] < b:
                    found[start] = (b, name)

    before = None
    for line in LINE.finditer(text):
        a, b = line.span()
        add(_sentences(text, a, b))
        # a title over two lines
        if before is not None and before[1] + 1 == a and b - before[0] <= TITLE:
            add(iter([(before[0], b)]))
        before = (a, b)
        if "icen" in line[0] and (said := DECLARED.match(line[0])) and not any(a <= start < b for start in found):
            for at, spdx in expression(said[1]) or ():
                start = a + said.start(1) + at
                found[start] = (start + 1, f"id:{spdx}")
    at = 0
    hinted = HINT.search(text)
    for end, after in [*((gap.start(), gap.end()) for gap in PARAGRAPH.finditer(text)), (len(text), len(text))]:
        for stops in (STOP, INNER, NO_STOP) if hinted else (STOP,):
            add(_sentences(text, at, end, stops))
        for a, b in _sentences(text, at, end, INNER) if hinted else ():
            if (hit := _ending(text, a, b)) and not any(start <= hit[0] < stop for start, (stop, _) in found.items()):
                found[hit[0]] = (b, hit[1])
        at = after
    out, behind = [], 0
    for start, (end, name) in sorted(found.items()):
        # a line within a longer known sentence is none of its own
        if end > behind:
            out.append((start, name))
            behind = end
    return out


def licences(names: list[str]) -> list[str]:
    """The licences that the rules read from a sequence of identifiers."""
    out, at = [], 0
    while at < len(names):
        for licence, rule in FIRST_RULES.get(names[at], ()):
            if tuple(names[at : at + len(rule)]) == rule:
                out.append(licence)
                at += len(rule)
                break
        else:
            at += 1
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses (both in the text's order) and positions (of the sentences, in characters)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [identifiers(t) for t in batch.column(1).to_pylist()]
            names = [[n for _, n in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array([licences(n) for n in names], pa.list_(pa.string())), pa.array([[p for p, _ in f] for f in found], pa.list_(pa.int32()))],
                names=["doc_id", "sentence_ids", "licenses", "positions"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sentence_ids array<string>, licenses array<string>, positions array<int>")


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids and licenses (joined by `;`) of every document."""
    return scan(docs).selectExpr("doc_id", "cast(size(sentence_ids) as bigint) as n_sentences", "array_join(sentence_ids, ';') as sentence_ids", "array_join(licenses, ';') as licenses")
