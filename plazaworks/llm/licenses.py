"""License scans: ordered signature rules over a text's words, as column expressions.

A text is read as its lower-case words with one blank between them. A rule is
a regular expression on that text behind a keyword that the text must contain,
a literal part of the expression.
Where detections overlap, one that lies within another of the same or higher
priority goes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaworks.llm.shared import LOWER, UPPER, fresh

#: What separates words; the first also takes A-Z as letters.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are always looked for, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_SCORE = 0.9

#: label: (names as regular expressions over words, SPDX identifiers as words, address as words).
SIGNATURES = {
    "mit": (["(?:the )?mit licen[cs]e", "(?:the )?mit x11 licen[cs]e", "mit style licen[cs]e"], ["mit"], "opensource org licenses mit"),
    "x11": (["x11 licen[cs]e", "x consortium licen[cs]e"], ["x11"], None),
    "apache-1.1": (["apache (?:software )?licen[cs]e (?:version |v )?1 1"], ["apache 1 1"], "apache org licenses license 1 1"),
    "apache-2": (["apache (?:software )?licen[cs]e(?: version| v)? ?2(?: 0)?", "apache 2(?: 0)? licen[cs]e", "asl 2(?: 0)?"], ["apache 2 0"], "apache org licenses license 2 0"),
    "gpl-1": (["gnu general public licen[cs]e(?: version| v)? ?1(?: 0)?"], ["gpl 1 0", "gpl 1 0 only", "gpl 1 0 or later"], None),
    "gpl-2": (["(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?", "(?:gnu )?gpl ?v(?:ersion)? ?2(?: 0)?(?: only| or later)?", "gpl 2 0(?: only| or later)?"], ["gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"], "gnu org licenses old licenses gpl 2 0"),
    "gpl-3": (["(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?", "(?:gnu )?gpl ?v(?:ersion)? ?3(?: 0)?(?: only| or later)?", "gpl 3 0(?: only| or later)?"], ["gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"], "gnu org licenses gpl 3 0"),
    "gpl": (["gnu general public licen[cs]e", "gnu gpl"], ["gpl"], "gnu org licenses gpl"),
    "lgpl-2": (["gnu library general public licen[cs]e(?: version| v)? ?2(?: 0)?"], ["lgpl 2 0", "lgpl 2 0 only", "lgpl 2 0 or later"], None),
    "lgpl-2.1": (["gnu lesser general public licen[cs]e(?: version| v)? ?2 1", "(?:gnu )?lgpl ?v(?:ersion)? ?2 1(?: only| or later)?", "lgpl 2 1(?: only| or later)?"], ["lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"], "gnu org licenses old licenses lgpl 2 1"),
    "lgpl-3": (["gnu lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?", "(?:gnu )?lgpl ?v(?:ersion)? ?3(?: 0)?(?: only| or later)?", "lgpl 3 0(?: only| or later)?"], ["lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"], "gnu org licenses lgpl 3 0"),
    "lgpl": (["gnu (?:lesser|library) general public licen[cs]e"], ["lgpl"], "gnu org licenses lgpl"),
    "agpl-3": (["gnu affero general public licen[cs]e(?: version| v)? ?3(?: 0)?", "(?:gnu )?agpl ?v(?:ersion)? ?3(?: 0)?(?: only| or later)?", "agpl 3 0(?: only| or later)?"], ["agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"], "gnu org licenses agpl 3 0"),
    "agpl": (["(?:gnu )?affero general public licen[cs]e"], ["agpl 1 0"], "gnu org licenses agpl"),
    "gfdl": (["gnu free documentation licen[cs]e(?: version 1 [123])?"], ["gfdl 1 1", "gfdl 1 2", "gfdl 1 3"], "gnu org licenses fdl"),
    "bsd-2": (["(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e", "bsd 2 clause(?: licen[cs]e)?"], ["bsd 2 clause"], "opensource org licenses bsd 2 clause"),
    "bsd-3": (["(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e", "bsd 3 clause(?: licen[cs]e)?"], ["bsd 3 clause"], "opensource org licenses bsd 3 clause"),
    "bsd-4": (["(?:original|4 clause|four clause) bsd licen[cs]e", "bsd 4 clause(?: licen[cs]e)?"], ["bsd 4 clause"], None),
    "0bsd": (["(?:zero clause|0 clause) bsd licen[cs]e", "bsd zero clause licen[cs]e"], ["0bsd"], "opensource org licenses 0bsd"),
    "bsd": (["bsd(?: style)? licen[cs]e"], ["bsd"], None),
    "isc": (["isc licen[cs]e", "internet systems consortium licen[cs]e"], ["isc"], "opensource org licenses isc"),
    "mpl-1.1": (["mozilla public licen[cs]e(?: version| v)? ?1 1"], ["mpl 1 1"], "mozilla org mpl 1 1"),
    "mpl-2": (["mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?"], ["mpl 2 0"], "mozilla org mpl 2 0"),
    "mpl": (["mozilla public licen[cs]e"], ["mpl"], "mozilla org mpl"),
    "epl-1": (["eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?"], ["epl 1 0"], "eclipse org legal epl v10"),
    "epl-2": (["eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?"], ["epl 2 0"], "eclipse org legal epl 2 0"),
    "cddl-1": (["common development and distribution licen[cs]e(?: version 1 [01])?"], ["cddl 1 0", "cddl 1 1"], None),
    "cpl-1": (["common public licen[cs]e(?: version 1 0)?"], ["cpl 1 0"], None),
    "cpal-1": (["common public attribution licen[cs]e"], ["cpal 1 0"], None),
    "cc0": (["cc0(?: 1 0)?(?: universal)?"], ["cc0 1 0"], "creativecommons org publicdomain zero 1 0"),
    "cc-by-nc-nd": (["cc by nc nd(?: [1-4] [05])?"], ["cc by nc nd 3 0", "cc by nc nd 4 0"], "creativecommons org licenses by nc nd"),
    "cc-by-nc-sa": (["cc by nc sa(?: [1-4] [05])?"], ["cc by nc sa 3 0", "cc by nc sa 4 0"], "creativecommons org licenses by nc sa"),
    "cc-by-nc": (["cc by nc(?: [1-4] [05])?"], ["cc by nc 3 0", "cc by nc 4 0"], "creativecommons org licenses by nc"),
    "cc-by-nd": (["cc by nd(?: [1-4] [05])?"], ["cc by nd 3 0", "cc by nd 4 0"], "creativecommons org licenses by nd"),
    "cc-by-sa": (["cc by sa(?: [1-4] [05])?"], ["cc by sa 3 0", "cc by sa 4 0"], "creativecommons org licenses by sa"),
    "cc-by": (["cc by(?: [1-4] [05])?"], ["cc by 3 0", "cc by 4 0"], "creativecommons org licenses by"),
    "cc-attribution-nc": (["creative commons attribution non ?commercial(?: [1-4] [05])?"], [], None),
    "cc-attribution-sa": (["creative commons attribution share ?alike(?: [1-4] [05])?"], [], None),
    "cc-attribution": (["creative commons attribution(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"], [], None),
    "public-domain": (["(?:in|into) the public domain", "dedicated to the public domain"], [], None),
    "unlicense": (["the unlicense"], ["unlicense"], "unlicense org"),
    "wtfpl": (["do what the f[a-z]* you want to public licen[cs]e"], ["wtfpl"], "wtfpl net"),
    "zlib": (["zlib licen[cs]e", "zlib libpng licen[cs]e"], ["zlib"], "zlib net zlib license"),
    "boost": (["boost software licen[cs]e(?: version 1 0)?"], ["bsl 1 0"], "boost org license 1 0"),
    "artistic-1": (["artistic licen[cs]e 1 0"], ["artistic 1 0"], None),
    "artistic-2": (["artistic licen[cs]e (?:version )?2(?: 0)?"], ["artistic 2 0"], "opensource org licenses artistic 2 0"),
    "ofl": (["sil open font licen[cs]e(?: version 1 1)?", "open font licen[cs]e"], ["ofl 1 1"], "scripts sil org ofl"),
    "ms-pl": (["microsoft public licen[cs]e"], ["ms pl"], None),
    "ms-rl": (["microsoft reciprocal licen[cs]e"], ["ms rl"], None),
    "eupl-1.1": (["european union public licen[cs]e(?: version| v)? ?1 1"], ["eupl 1 1"], None),
    "eupl-1.2": (["european union public licen[cs]e(?: version| v)? ?1 2"], ["eupl 1 2"], None),
    "psf-2": (["python software foundation licen[cs]e(?: version 2)?"], ["psf 2 0", "python 2 0"], None),
    "php-3": (["php licen[cs]e(?: version)? 3 01?"], ["php 3 0", "php 3 01"], None),
    "ruby": (["ruby licen[cs]e", "same terms as ruby"], ["ruby"], None),
    "perl": (["same terms as perl(?: itself)?"], [], None),
    "postgresql": (["postgresql licen[cs]e"], ["postgresql"], None),
    "ncsa": (["university of illinois ncsa open source licen[cs]e", "ncsa licen[cs]e"], ["ncsa"], None),
    "openssl": (["openssl licen[cs]e"], ["openssl"], None),
    "zpl-2": (["zope public licen[cs]e(?: version 2 [01])?"], ["zpl 2 0", "zpl 2 1"], None),
    "afl-3": (["academic free licen[cs]e(?: version| v)? ?3(?: 0)?"], ["afl 3 0"], None),
    "osl-3": (["open software licen[cs]e(?: version| v)? ?3(?: 0)?"], ["osl 3 0"], None),
    "ecl-2": (["educational community licen[cs]e(?: version)? 2(?: 0)?"], ["ecl 2 0"], None),
    "lppl": (["latex project public licen[cs]e(?: version 1 3c?)?"], ["lppl 1 3c"], "latex project org lppl"),
    "odbl": (["open database licen[cs]e", "open data commons open database licen[cs]e"], ["odbl 1 0"], "opendatacommons org licenses odbl"),
    "odc-by": (["open data commons attribution licen[cs]e"], ["odc by 1 0"], "opendatacommons org licenses by"),
    "pddl": (["open data commons public domain dedication(?: and licen[cs]e)?"], ["pddl 1 0"], "opendatacommons org licenses pddl"),
    "json": (["shall be used for good not evil"], ["json"], None),
    "upl": (["universal permissive licen[cs]e"], ["upl 1 0"], None),
    "mulan": (["mulan (?:psl|permissive software licen[cs]e)(?: version| v)? ?2"], ["mulanpsl 2 0"], None),
    "w3c": (["w3c software (?:notice and )?licen[cs]e"], ["w3c"], None),
    "vim": (["vim licen[cs]e"], ["vim"], None),
    "beerware": (["beer ?ware licen[cs]e"], ["beerware"], None),
    "hpnd": (["historical permission notice and disclaimer"], ["hpnd"], None),
    "elastic-2": (["elastic licen[cs]e(?: version)? 2(?: 0)?"], ["elastic 2 0"], None),
    "sspl": (["server side public licen[cs]e"], ["sspl 1 0"], None),
    "busl": (["business source licen[cs]e(?: 1 1)?"], ["busl 1 1"], None),
    "commons-clause": (["commons clause(?: licen[cs]e)?"], [], None),
    "all-rights-reserved": (["all rights reserved"], [], None),
}

#: Sentences of licences' own texts and of the headers that files carry, as words. They are what the licences say.
_GNU = "free software you can redistribute it and or modify it under the terms of the gnu"
_FSF = "as published by the free software foundation"
_COPY = "you should have received a copy of the gnu"
NOTICES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "x11": ["except as contained in this notice the name of the x consortium shall not be used in advertising"],
    "isc": ["permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"],
    "icu": ["provided that the above copyright notices? and this permission notice appear in all copies of the software and that both the above copyright notices? and this permission notice appear in supporting documentation"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "bsd-3": ["nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-4": ["all advertising materials mentioning features or use of this software must display the following acknowledge?ment"],
    "ncsa": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", "to deal with the software without restriction"],
    "apache-1.1": ["this product includes software developed by the apache software foundation"],
    "apache-2": [
        "licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license",
        "licensed to the apache software foundation(?: asf)? under one or more contributor license agreements",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "apache license version 2 0 january 2004",
    ],
    "gpl-1": [f"{_GNU} general public license {_FSF} either version 1(?: 0)?(?: of the license)?"],
    "gpl-2": [f"{_GNU} general public license {_FSF} either version 2(?: 0)?(?: of the license)?", f"{_GNU} general public license version 2(?: 0)? {_FSF}", "gnu general public license version 2 june 1991"],
    "gpl-3": [f"{_GNU} general public license {_FSF} either version 3(?: 0)?(?: of the license)?", f"{_GNU} general public license version 3(?: 0)? {_FSF}", "gnu general public license version 3 29 june 2007"],
    "gpl": [f"{_COPY} general public license along with this (?:program|library|software|package|file)", f"{_GNU} general public license"],
    "lgpl-2": [f"{_GNU} library general public license {_FSF} either version 2(?: 0)?(?: of the license)?"],
    "lgpl-2.1": [f"{_GNU} lesser general public license {_FSF} either version 2 1(?: of the license)?", "gnu lesser general public license version 2 1 february 1999"],
    "lgpl-3": [f"{_GNU} lesser general public license {_FSF} either version 3(?: 0)?(?: of the license)?", "gnu lesser general public license version 3 29 june 2007"],
    "lgpl": [f"{_COPY} (?:lesser|library) general public license along with this (?:program|library|software|package|file)", f"{_GNU} (?:lesser|library) general public license"],
    "agpl-3": [f"{_GNU} affero general public license {_FSF} either version 3(?: 0)?(?: of the license)?", "gnu affero general public license version 3 19 november 2007"],
    "agpl": [f"{_COPY} affero general public license along with this (?:program|library|software|package|file)"],
    "gnu-text": ["everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"],
    "gfdl": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"],
    "classpath-exception": ["as a special exception the copyright holders of this library give you permission to link this library with independent modules"],
    "gcc-exception": ["as a special exception you may use this file as part of a free software library without restriction", "gcc runtime library exception"],
    "autoconf-exception": ["if you distribute this file as part of a program that contains a configuration script generated by autoconf"],
    "bison-exception": ["as a special exception you may create a larger work that contains part or all of the bison parser skeleton"],
    "openssl-exception": ["permission to link the code of portions of this program with the openssl library"],
    "font-exception": ["if you create a document which uses this font and embed this font or unaltered portions of this font into the document"],
    "mpl-1.1": ["the contents of this file are subject to the mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "epl-1": ["this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0"],
    "epl-2": ["this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? ?2 0"],
    "cpl-1": ["the accompanying program is provided under the terms of this common public license"],
    "cddl-1": ["the contents of this file are subject to the terms of the common development and distribution license"],
    "boost": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "distributed under the boost software license version 1 0 see accompanying file"],
    "zlib": ["the origin of this software must not be misrepresented you must not claim that you wrote the original software", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
    "libpng": ["this copy of the libpng notices is provided for your convenience"],
    "bzip2": ["this program bzip2 the associated library libbzip2 and all documentation"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "blessing": ["the author disclaims copyright to this source code in place of a legal notice here is a blessing"],
    "cc0": ["waived all copyright and related or neighbou?ring rights to this work", "the person who associated a work with this deed has dedicated the work to the public domain"],
    "cc-by-nc-nd": ["licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)"],
    "cc-by-nc-sa": ["licensed under (?:a|the) creative commons attribution non ?commercial share ?alike"],
    "cc-by-nc": ["licensed under (?:a|the) creative commons attribution non ?commercial [1-4] [05]"],
    "cc-by-nd": ["licensed under (?:a|the) creative commons attribution no ?deriv(?:s|atives|ative works)"],
    "cc-by-sa": ["licensed under (?:a|the) creative commons attribution share ?alike"],
    "cc-by": ["licensed under (?:a|the) creative commons attribution [1-4] [05]"],
    "public-domain": ["this (?:file|code|software|work|program|document) is(?: hereby)?(?: placed| released)? in(?:to)? the public domain", "no copyright is claimed", "has been put in the public domain"],
    "ofl": ["this font software is licensed under the sil open font license", "to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software"],
    "artistic-1": ["you may make and give away verbatim copies of the source form of the standard version of this package without restriction"],
    "perl": ["you can redistribute it and or modify it under the same terms as perl itself", "under the same terms as the perl 5 programming language system itself"],
    "ruby": ["you may make and give away verbatim copies of the source form of the software without restriction"],
    "php-3": ["this source file is subject to version 3 0 of the php license", "this source file is subject to version 3 01 of the php license"],
    "psf-2": ["psf is making python available to licensee on an as is basis"],
    "postgresql": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"],
    "hpnd": ["permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"],
    "openssl": ["this product includes software developed by the openssl project for use in the openssl toolkit"],
    "zpl-2": ["this software is subject to the provisions of the zope public license version 2"],
    "afl-3": ["licensed under the academic free license version 3 0"],
    "osl-3": ["licensed under the open software license version 3 0"],
    "eupl-1.1": ["licensed under the eupl version 1 1"],
    "eupl-1.2": ["licensed under the eupl version 1 2"],
    "lppl": ["this work may be distributed and or modified under the conditions of the latex project public license"],
    "odbl": ["this database is made available under the open database license", "is made available under the open database license"],
    "ms-pl": ["this license governs use of the accompanying software if you use the software you accept this license"],
    "json": ["the software shall be used for good not evil"],
    "upl": ["permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"],
    "mulan": ["you can use this software according to the terms and conditions of the mulan psl v2"],
    "w3c": ["by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions"],
    "vim": ["there are no restrictions on distributing unmodified copies of vim"],
    "elastic-2": ["you may not provide the software to third parties as a hosted or managed service"],
    "sspl": ["under the terms of the server side public license version 1"],
    "busl": ["the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"],
    "commons-clause": ["the license does not grant to you and you are not granted the right to sell the software", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"],
    "proprietary": ["proprietary and confidential", "confidential and proprietary", "unauthorized copying of this (?:file|software|work) via any medium is strictly prohibited"],
    "see-license": ["see the licen[cs]e file(?: in the project root)?(?: for(?: the)? (?:details|full licen[cs]e|more information|terms))?", "see licen[cs]e(?: txt| md) for(?: the)? (?:details|full licen[cs]e|more information|terms)", "see the accompanying licen[cs]e file"],
}

_GRANT = "(?:licen[cs]ed|released|distributed|available|published|provided|governed|covered|redistributed) (?:under|by|according to) (?:the )?(?:terms of )?(?:the )?"


#: What an SPDX expression follows, and a mark, no part of any word, in place of the blank before its later identifiers.
_SPDX, _MARK = "spdx license identifier", "|"


@dataclass(frozen=True)
class Rule:
    """priority: 4 identifiers, 3 addresses and notices, 2 grants, 1 bare names."""

    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


def _keyword(name: str) -> str:
    """The longest literal part that every match of an expression has: what stands outside groups, sets and repeated characters."""
    name = re.sub(r"\(\?:[^()]*\)[?*]?|\[[^]]*\][?*]?|.[?*]", "|", name)
    return max(name.split("|"), key=len)


def _rules() -> tuple[Rule, ...]:
    """Each expression stands between blanks, so that it neither starts nor ends within a word."""
    found = []
    for label, (names, ids, address) in SIGNATURES.items():
        found += [Rule(label, f"{_SPDX} {x}", f"(?<= ){_SPDX} {x}(?= )", 4, 1.0) for x in ids]
        found += [Rule(label, address, f"(?<= )(?:https? )?(?:www )?{address}(?: [0-9] [0-9])?(?= )", 3, 0.95)] * bool(address)
        for x in names:
            keyword = _keyword(x)
            found += [Rule(label, keyword, f"(?<= ){_GRANT}{x}(?= )", 2, 0.9), Rule(label, keyword, f"(?<= ){x}(?= )", 1, 0.6)]
    notices = [Rule(label, _keyword(x), f"(?<= ){x}(?= )", 3, 0.95) for label, xs in NOTICES.items() for x in xs]
    return tuple(found + notices)


#: In order: of equal detections the earlier rule's stays.
RULES = _rules()

#: An identifier after the first of an expression is a detection of its own, so that none lies within another.
LATER = tuple(Rule(label, _MARK + x, f"[{_MARK}]{x}(?= )", 4, 1.0) for label, (_, ids, _) in SIGNATURES.items() for x in ids)


def _marked(text: Column) -> Column:
    """Words, of the same length, with the mark before each later identifier of an SPDX expression.

    An expression has known identifiers between and / or, each with an exception
    or without. Each match begins where the last one ended, so that an expression
    of any length is read through.
    """
    known = "|".join(sorted({x for _, ids, _ in SIGNATURES.values() for x in ids}, key=lambda x: (-len(x), x)))
    exception = "(?: with (?:[a-z0-9]+ ){1,6}exception(?: [0-9] [0-9])?)?"
    pattern = rf"(\G(?!^)|(?<= ){_SPDX} )((?:{known}){exception} (?:and|or)) (?=(?:{known})[ ])"
    return F.when(F.contains(text, F.lit(_SPDX)), F.regexp_replace(text, pattern, rf"$1$2{_MARK}")).otherwise(text)


#: Words that any text may have: no gates.
_PROSE = frozenset(
    "accompanying all along also and any anyone appear are associated away basis binary can change changing claim claimed clear clearly code condition conditions configuration contains convenience copies copy create created creative distribute distributed do document documentation embed everyone fee file files following for form free from general generated give granted has have http https in independent into its itself just language larger library list made make making materials may merge misrepresented modifications modified modify modules must net not notice notices object obtain obtaining of one open or part org origin original other parser permission permitted person portions product products program programming project provided public received redistribute reproduced restriction retain right rights runtime same scripts see shall should skeleton source special standard study stuff style subject system term terms text that the their this to unaltered under university use used using version want was what whatever which whole with without work works www you".split()
)


def gates(rules: tuple[Rule, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strings and regular expressions (in any case) of which each text that matches a rule or a base phrase has one.

    For each keyword one of its words is among the strings, if possible a long
    one, and those that most keywords have first; keywords of words too short
    for that are expressions. An expression's later identifiers need none, as
    its first one is found by a rule too.
    """
    left = {k: {w for w in re.findall("[a-z0-9]+", k) if len(w) > 2} - _PROSE for k in (*(r.keyword for r in rules if r.keyword[0] != _MARK), *BASE)}
    short = {" ".join(k.split()) for k, words in left.items() if not words}
    short = {k for k in short if not any(x != k and x in k for x in short)}
    left = {k: {w for w in words if len(w) > 4} or {max(sorted(words), key=len)} for k, words in left.items() if words}
    strings = []
    while left:
        # In words alone, as a keyword may end within a word of the text.
        words = sorted(set().union(*left.values()))
        best = max(words, key=lambda w: (sum(any(w in x for x in xs) for xs in left.values()), len(w)))
        strings.append(best)
        left = {k: xs for k, xs in left.items() if not any(best in x for x in xs)}
    return tuple(strings), tuple(sorted("(?i)" + _GAP.join(map(re.escape, k.split())) for k in short))


def _base_hits(words: Column) -> Column:
    """(i, label) of each place where a base phrase stands."""

    def found(word: Column, i: Column) -> Column:
        out = None
        for phrase, label in BASE.items():
            first, *others = phrase.split()
            here = reduce(lambda a, b: a & b, [F.get(words, i + k + 1) == w for k, w in enumerate(others)], word == first)
            hit = F.struct(i.alias("i"), F.lit(label).alias("label"))
            out = F.when(here, hit) if out is None else out.when(here, hit)
        return out

    return F.filter(F.transform(words, found), lambda x: x.isNotNull())


def _rule_table(rules: tuple[Rule, ...]) -> Column:
    fields = [
        F.struct(F.lit(k).alias("at"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.score).alias("score"))
        for k, r in enumerate(rules)
    ]
    return F.array(*fields)


_DETECTION = "array<struct<start:int,minus:int,below:int,at:int,stop:int,priority:int,label:string,score:double>>"


def _detections(text: Column, rules: Column) -> Column:
    """All matches of rules whose keyword occurs, in the order of suppression: by start, then the longest, then the highest priority."""

    def of(rule: Column) -> Column:
        parts, found = F.split(text, rule["pattern"], -1), F.regexp_extract_all(text, rule["pattern"], F.lit(0))
        sizes = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size")))
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(_DETECTION).alias("all"))

        def add(state: Column, x: Column) -> Column:
            begin = state["pos"] + x["gap"]
            stop = begin + x["size"]
            one = F.struct(begin.alias("start"), (-stop).alias("minus"), (-rule["priority"]).alias("below"), rule["at"].alias("at"), stop.alias("stop"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["score"].alias("score"))
            return F.struct(stop.alias("pos"), F.concat(state["all"], F.array(one)).cast(_DETECTION).alias("all"))

        return F.aggregate(sizes, start, add, lambda s: s["all"])

    fitting = F.filter(rules, lambda r: F.contains(text, r["keyword"]))
    return F.sort_array(F.flatten(F.transform(fitting, of)))


def _without_contained(found: Column) -> Column:
    """Detections that don't lie within an earlier one of the same or higher priority."""
    tiers = (1, 2, 3, 4)
    start = F.struct(*[F.lit(-1).alias(f"e{k}") for k in tiers], F.array().cast(_DETECTION).alias("kept"))

    def add(state: Column, x: Column) -> Column:
        covered = F.greatest(*[F.when(x["priority"] <= k, state[f"e{k}"]).otherwise(-1) for k in tiers]) >= x["stop"]
        ends = [F.when(x["priority"] == k, F.greatest(state[f"e{k}"], x["stop"])).otherwise(state[f"e{k}"]).alias(f"e{k}") for k in tiers]
        return F.struct(*ends, F.when(covered, state["kept"]).otherwise(F.concat(state["kept"], F.array(x)).cast(_DETECTION)).alias("kept"))

    return F.aggregate(found, start, add, lambda s: s["kept"])


def with_licenses(df: DataFrame, text: str = "text", name: str = "licenses", rules: tuple[Rule, ...] = RULES + LATER) -> DataFrame:
    """df with a struct column of what was found in the whole text.

    n_words, n_base, first_word and last_word (long), base_labels and labels
    (distinct, sorted, comma-joined), score, and found: the detections left,
    with start and stop as places in the text of lower-case words that begins
    and ends with a blank, in which a | stands before the later identifiers
    of an SPDX expression. A null or empty text has no words, no labels and
    score 0. Rows and other columns stay as they are, whatever the names; an
    empty table gives an empty table.
    """
    t, w, g, n, h, d, x = fresh(df, "_text", "_words", "_gate", "_n", "_hits", "_norm", "_found")
    keep = [F.col(f"`{c}`") for c in df.columns]
    c = F.col
    low = F.lower(c(t))
    strings, expressions = gates(rules)
    gate = reduce(lambda a, b: a | b, [*(F.contains(low, F.lit(k)) for k in strings), *(F.regexp_like(c(t), F.lit(k)) for k in expressions)])
    read = df.select(*keep, F.coalesce(c(f"`{text}`"), F.lit("")).alias(t))
    read = read.select(*keep, t, F.size(F.array_remove(F.split(c(t), _GAP), "")).cast("long").alias(n), gate.alias(g))
    lower = F.array_remove(F.split(F.translate(c(t), UPPER, LOWER), _LOWER_GAP), "")
    read = read.select(*keep, n, F.when(c(g), lower).alias(w))
    read = read.select(*keep, n, _base_hits(c(w)).alias(h), _marked(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))).alias(d))
    # Only marked texts can match the rules of later identifiers.
    table = F.when(F.contains(c(d), F.lit(_MARK)), _rule_table(rules)).otherwise(_rule_table(tuple(r for r in rules if r.keyword[0] != _MARK)))
    read = read.select(*keep, n, h, _without_contained(_detections(c(d), table)).alias(x))
    places = F.transform(c(h), lambda y: y["i"].cast("long"))
    base = F.transform(c(h), lambda y: y["label"])
    none = F.array().cast("array<string>")
    own = F.transform(c(x), lambda y: y["label"])
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(F.coalesce(labels, none))), ",")
    scores = F.concat(F.array(F.lit(0.0)), F.coalesce(F.transform(c(x), lambda y: y["score"]), F.array().cast("array<double>")), F.transform(F.coalesce(base, none), lambda y: F.lit(BASE_SCORE)))
    result = F.struct(
        c(n).alias("n_words"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(F.coalesce(base, none), F.coalesce(own, none))).alias("labels"),
        F.array_max(scores).alias("score"),
        F.transform(c(x), lambda y: F.struct(y["label"].alias("label"), y["start"].alias("start"), y["stop"].alias("stop"), y["priority"].alias("priority"), y["score"].alias("score"))).alias("found"),
    )
    return read.select(*keep, result.alias(name))
