import random
import re
from re import _parser

from plazaworks.llm.licenses import BASE, BASE_SCORE, NOTICES, RULES, SIGNATURES, gates, with_licenses


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = []
    for phrase, label in BASE.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    norm = " " + " ".join(words) + " "
    found = [(m.start(), m.end(), r.priority, k, r) for k, r in enumerate(RULES) if r.keyword in norm for m in re.finditer(r.pattern, norm)]

    def within(x, y):  # y suppresses x
        if y[0] > x[0] or y[1] < x[1] or y[2] < x[2]:
            return False
        return y[:3] != x[:3] or y[3] < x[3]

    found = [x for x in found if not any(within(x, y) for y in found if y is not x)]
    base = sorted({label for _, label in hits})
    score = max([0.0, *[BASE_SCORE] * bool(hits), *(x[4].score for x in found)])
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted({*base, *(x[4].label for x in found)})), score


CASES = [
    None,
    "",
    "Released under the MIT License.",
    "UNDER-THE-MIT-LICENSE cc by-nc 4.0; cc/by/nc",
    "Licensed under the Apache License, Version 2.0.",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "under the terms of the GNU Lesser General Public License, version 2.1 or gnu general public license v3",
    "See https://creativecommons.org/licenses/by-nc-sa/4.0/ and CC BY-SA 3.0",
    "é under the mit licensé under the mit license",
    "occby nc accept by nc; cc\nby\nnc" + " x" * 3000,
    "BSD 3-Clause License. All rights reserved.",
    "K under the mit license İ",
    "no marks at all here",
]


def test_rules_are_many_and_gated():
    assert len(RULES) >= 300
    assert all(r.keyword == r.keyword.lower() for r in RULES)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = "under the mit license apache version 2 0 cc by nc sa 4 0 gnu lesser general public licensed spdx identifier gpl bsd clause 3 x".split()
    texts = CASES + [" ".join(rng.choice(words) for _ in range(rng.randrange(60))).title() for _ in range(400)]
    texts += [r.pattern.replace("(?= )", "").replace("(?<= )", "") for r in RULES if not re.search(r"[\[?|]", r.pattern.replace("(?= )", "").replace("(?<= )", ""))]
    df = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, licenses string").repartition(4)
    out = with_licenses(df, name="result")
    assert out.columns == ["doc_id", "text", "licenses", "result"]
    for r in out.collect():
        assert tuple(r.result)[:7] == plain(r.text), r.text
    assert with_licenses(df.limit(0), name="result").count() == 0


def test_query_on_the_small_table(spark):
    from plazaworks.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op9_license_scan"](spark, folder).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {k: plain(t) for k, t in texts.items()}
    assert any(r.labels for r in rows)


def samples(pattern):
    """Texts that match a pattern: each alternative with all that is optional left out, and with all of it."""

    def of(parsed, full):
        texts = [""]
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "IN":
                more = [chr(x if str(o) == "LITERAL" else x[0]) for o, x in arg]
            elif name == "SUBPATTERN":
                more = of(arg[-1], full)
            elif name == "BRANCH":
                more = [t for branch in arg[1] for t in of(branch, full)]
            elif name == "MAX_REPEAT":
                more = of(arg[2], full) if full or arg[0] else [""]
            else:
                raise ValueError(name)
            texts = [a + b for a in texts for b in more]
        return texts

    return {t for full in (False, True) for t in of(_parser.parse(pattern), full)}


def test_every_name_and_address_alone_is_found_as_by_all_rules_without_gates(spark):
    texts = {t for names, ids, address in SIGNATURES.values() for x in names for t in samples(x)}
    texts |= {address for _, _, address in SIGNATURES.values() if address}
    texts |= {f"spdx license identifier {x}" for _, ids, _ in SIGNATURES.values() for x in ids}
    texts |= {t for xs in NOTICES.values() for x in xs for t in samples(x)}
    texts |= {"https://www.wtfpl.net/", "https://mozilla.org/MPL/2.0/", "https://www.eclipse.org/legal/epl-2.0/", "https://scripts.sil.org/OFL", "https://www.latex-project.org/lppl/", "GNU GPL", "ASL 2.0", "X Consortium License"}
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "text string")
    for r in with_licenses(df, name="result").collect():
        norm = " " + " ".join(re.findall("[a-z0-9]+", r.text.lower())) + " "
        found = [(m.start(), m.end(), x.priority, k, x) for k, x in enumerate(RULES) for m in re.finditer(x.pattern, norm)]
        hides = lambda y, x: y[0] <= x[0] and x[1] <= y[1] and y[2] >= x[2] and (y[:3] != x[:3] or y[3] < x[3])
        left = [x for x in found if not any(hides(y, x) for y in found if y is not x)]
        base = {label for phrase, label in BASE.items() if f" {phrase} " in norm}
        assert left and r.result.labels == ",".join(sorted({*base, *(x[4].label for x in left)})), r.text
        assert sorted((x.start, x.stop, x.label) for x in r.result.found) == sorted((x[0], x[1], x[4].label) for x in left), r.text


def test_rules_keep_to_whole_words(spark):
    texts = {"unlicensed under the BSD license": "bsd", "xspdx-license-identifier: MIT": "", "nothttps://www.gnu.org/licenses/gpl": "gpl", "subgnu.org/licenses/gpl": "", "licensed under the BSD licensee": "", "a redistributions of source code must retain": ""}
    rows = {r.text: r.result for r in with_licenses(spark.createDataFrame([(t,) for t in texts], "text string"), name="result").collect()}
    assert {t: r.labels for t, r in rows.items()} == texts
    # A bare name, not a grant.
    assert rows["unlicensed under the BSD license"].score == 0.6


def test_a_header_counts_as_a_whole(spark):
    header = """/* This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
 License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. */"""
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    rows = {r.k: r.result for r in with_licenses(spark.createDataFrame([(1, header), (2, bsd)], "k int, text string"), name="result").collect()}
    assert [(x.label, x.priority) for x in rows[1].found] == [("gpl-2", 3)] and rows[2].labels == "bsd" and rows[1].score == 0.95


def test_keywords_stand_in_every_match_and_gates_in_every_keyword():
    strings, expressions = gates(RULES)
    for r in RULES:
        texts = samples(r.pattern.replace("(?= )", "").replace("(?<= )", ""))
        assert texts and all(r.keyword in t for t in texts), r
        assert all(any(g in t for g in strings) or any(re.search(e, t) for e in expressions) for t in texts), r


def test_short_forms_and_expressions(spark):
    texts = {
        "This file is GPLv2": "gpl-2",
        "under GPLv3+ or, at your choice, LGPLv2.1+": "gpl-3,lgpl-2.1",
        "licensed under GPL-2.0-or-later": "gpl-2",
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2,mit",
        "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND BSD-3-Clause": "bsd-3,gpl-2",
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2",
        "SPDX-License-Identifier: GPL-2.0 or later": "gpl-2",
        "SPDX-License-Identifier: MIT or nothing": "mit",
        "mit or apache 2 0": "",
        "SPDX-License-Identifier: " + " OR ".join(["MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0"] * 40): "apache-2,bsd-2,bsd-3,isc,mit,mpl-2",
    }
    rows = {r.text: r.result for r in with_licenses(spark.createDataFrame([(t,) for t in texts], "text string"), name="result").collect()}
    assert {t: r.labels for t, r in rows.items()} == texts
    assert max(len(r.found) for r in rows.values()) == 240 and rows["SPDX-License-Identifier: (MIT OR Apache-2.0)"].score == 1.0
