"""License scan: ordered signature rules over the words of a text.

Method: hundreds of regular expressions in a fixed order (the wording of the licences by hand, forms of their names derived), each gated by a keyword; a
detection is suppressed by one of higher priority which overlaps it, or by a longer one of the
same priority which contains it. Built-in columns only; no shuffle at all.

The text becomes its words, joined by single blanks with one at either end, so a rule sees one
form whatever the punctuation and line breaks. Nearly all documents have no keyword and stop at
one hash probe per word. In the rest, a family's rules are one alternation in order of priority
(its branches are the rules), run only where a word of the text begins with that family's own keyword.

Priorities: exact identifiers (4), full titles with a version and sentences of one licence (3), full titles (2), names in a
licensing phrase (1), loose notices (0). Score: 1 - product of (1 - confidence) over the labels
that remain, confidences by priority 0.95, 0.9, 0.8, 0.6, 0.3; the fixed phrases count as 0.8.

Defined cases: null and empty texts have no words, no label and score 0; repeated rows are
scanned each; an empty table gives an empty table; other columns are kept, those named like an
output give way to it.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import TERM_GAP, ascii_lower, split_words

#: Fixed phrases whose places are counted, with their labels.
BASE = (
    (("cc", "by"), "cc-by"),
    (("general", "public", "license"), "gpl"),
    (("all", "rights", "reserved"), "reserved"),
)

LICENSE = "licen[sc]e"
UNDER = rf"(?:licen[sc]ed|released|distributed|available|published|provided)(?: \w+)? under(?: the)?(?: terms of(?: the)?)?"
CONFIDENCE = {4: 0.95, 3: 0.9, 2: 0.8, 1: 0.6, 0: 0.3}


def _family(keyword, label, names, versions=(), spdx=None):
    """The rules of one licence: (keyword, label, pattern, priority), most exact first.

    ``names`` are written by hand; an identifier, a versioned title, a title and a licensing
    phrase are made from each.
    """
    rules = []
    for v in versions:
        tail = v.replace(".", " ")
        own = f"{label}-{v}"
        rules.append((keyword, own, rf"spdx license identifier {(spdx or label).replace('-', ' ')} {tail}(?: only| or later)?", 4))
        for name in names:
            rules.append((keyword, own, rf"{name}(?: {LICENSE})?(?: version| v|v)? ?{tail}", 3))
            if v.endswith(".0"):
                rules.append((keyword, own, rf"{name}(?: {LICENSE})? ?v{v[:-2]}", 3))
    rules.append((keyword, label, rf"spdx license identifier {(spdx or label).replace('-', ' ')}", 4))
    for name in names:
        rules.append((keyword, label, rf"{name} {LICENSE}", 2))
        rules.append((keyword, label, rf"{UNDER} {name}", 1))
    return rules


_CC = [
    _family(
        code.split("-")[0] if code == "zero" else "cc" if short else "commons", f"cc-{code}",
        [name], ("4.0", "3.0", "2.5", "2.0", "1.0"),
    )
    for short in (True, False)
    for code, name in (
        ("by-nc-nd", "cc by nc nd" if short else "creative commons attribution non ?commercial no ?deriv\\w+"),
        ("by-nc-sa", "cc by nc sa" if short else "creative commons attribution non ?commercial share ?alike"),
        ("by-nc", "cc by nc" if short else "creative commons attribution non ?commercial"),
        ("by-nd", "cc by nd" if short else "creative commons attribution no ?deriv\\w+"),
        ("by-sa", "cc by sa" if short else "creative commons attribution share ?alike"),
        ("by", "cc by" if short else "creative commons attribution"),
    )
]

FAMILIES = [
    *_CC,
    _family("cc0", "cc0", ["cc0"], ("1.0",)),
    _family("lesser", "lgpl", ["gnu lesser general public", "lesser general public"], ("3", "2.1", "2")),
    _family("lgpl", "lgpl", ["gnu lgpl", "lgpl"], ("3", "2.1", "2")),
    _family("affero", "agpl", ["gnu affero general public", "affero general public"], ("3", "1")),
    _family("agpl", "agpl", ["gnu agpl", "agpl"], ("3", "1")),
    _family("general", "gpl", ["gnu general public", "general public"], ("3", "2", "1")),
    _family("gpl", "gpl", ["gnu gpl", "gpl"], ("3", "2", "1")),
    _family("documentation", "gfdl", ["gnu free documentation", "free documentation"], ("1.3", "1.2", "1.1")),
    _family("apache", "apache", ["apache software", "apache"], ("2.0", "1.1", "1.0")),
    _family("mit", "mit", ["the mit", "mit x11", "mit expat", "mit"]),
    _family("expat", "mit", ["expat"]),
    _family("bsd", "bsd", ["new bsd", "modified bsd", "simplified bsd", "revised bsd", "bsd"], ("4 clause", "3 clause", "2 clause", "0 clause")),
    _family("mozilla", "mpl", ["mozilla public"], ("2.0", "1.1", "1.0")),
    _family("mpl", "mpl", ["mpl"], ("2.0", "1.1", "1.0")),
    _family("eclipse", "epl", ["eclipse public"], ("2.0", "1.0")),
    _family("epl", "epl", ["epl"], ("2.0", "1.0")),
    _family("cddl", "cddl", ["cddl"], ("1.1", "1.0")),
    _family("development", "cddl", ["common development and distribution"], ("1.1", "1.0")),
    _family("artistic", "artistic", ["perl artistic", "artistic"], ("2.0", "1.0")),
    _family("boost", "bsl", ["boost software"], ("1.0",)),
    _family("isc", "isc", ["the isc", "isc"]),
    _family("zlib", "zlib", ["zlib libpng", "zlib"]),
    _family("unlicense", "unlicense", ["the unlicense", "unlicense"]),
    _family("wtfpl", "wtfpl", ["wtfpl"], ("2",)),
    _family("european", "eupl", ["european union public"], ("1.2", "1.1", "1.0")),
    _family("eupl", "eupl", ["eupl"], ("1.2", "1.1", "1.0")),
    _family("database", "odbl", ["open database"], ("1.0",)),
    _family("odbl", "odbl", ["odbl"], ("1.0",)),
    _family("cecill", "cecill", ["cecill"], ("2.1", "2.0", "1.0")),
    _family("psf", "psf", ["psf"], ("2",)),
    _family("python", "psf", ["python software foundation", "python"], ("2",)),
    _family("openssl", "openssl", ["openssl"]),
    _family("postgresql", "postgresql", ["postgresql"]),
    _family("sil", "ofl", ["sil open font"], ("1.1", "1.0")),
    [("public", "public-domain", r"(?:in|into|to) the public domain", 1), ("public", "public-domain", r"public domain dedication", 2)],
    [("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d", 0)],
    [("proprietary", "proprietary", r"proprietary and confidential", 1)],
]

#: The wording of the licences themselves, by hand: (keyword, label, pattern, priority). Sentences only one
#: licence has are as good as a full title with a version (3), conditions as a title (2), disclaimers as a phrase (1).
_PUBLISHED = r"general public licen[sc]e(?: gpl| lgpl| agpl)? as published by the free software foundation "
WORDING = [
    # MIT and X11
    ("hereby", "mit", r"permission is hereby granted free of charge to any person obtaining a copy", 3),
    ("sublicense", "mit", r"to use copy modify merge publish distribute sublicense and or sell copies", 2),
    ("substantial", "mit", r"(?:the above copyright notice and )?this permission notice(?: \w+ \w+ \w+ \w+)? shall be included in all copies or substantial portions", 2),
    ("noninfringement", "mit", r"warranties of merchantability fitness for a particular purpose and noninfringement", 1),
    # BSD
    ("redistribution", "bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 3),
    ("redistributions", "bsd", r"redistributions of source code must retain the above copyright notice", 2),
    ("redistributions", "bsd", r"redistributions in binary form must reproduce the above copyright notice", 2),
    ("endorse", "bsd-3 clause", r"neither the names? of(?: \S+){1,16}? (?:may|nor)(?: \S+){1,12}? used to endorse or promote products derived from this software", 3),
    ("advertising", "bsd-4 clause", r"all advertising materials mentioning features or use of this software must display", 3),
    ("disclaimed", "bsd", r"implied warranties of merchantability and fitness for a particular purpose are disclaimed", 1),
    # ISC and zero-clause BSD
    ("hereby", "isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that", 3),
    ("hereby", "isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that", 3),
    ("hereby", "bsd-0 clause", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)", 3),
    ("disclaims", "isc", r"the author disclaims all warranties with regard to this software including all implied warranties", 1),
    # zlib
    ("warranty", "zlib", r"this software is provided as is without any express or implied warranty in no event will the authors? be held liable", 2),
    ("altered", "zlib", r"altered source versions must be plainly marked as such and must not be misrepresented", 3),
    ("misrepresented", "zlib", r"the origin of this software must not be misrepresented", 3),
    # Boost
    ("hereby", "bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 3),
    ("machine", "bsl", r"solely in the form of machine executable object code generated by a source language processor", 3),
    # Unlicense, WTFPL, CC0, public domain
    ("unencumbered", "unlicense", r"this is free and unencumbered software released into the public domain", 3),
    ("compile", "unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", 3),
    ("fuck", "wtfpl", r"you just do what the fuck you want to", 3),
    ("waived", "cc0", r"has waived all copyright and related or neighboring rights", 3),
    ("affirmer", "cc0", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives", 3),
    ("placed", "public-domain", r"(?:has been|is|was|been) (?:hereby )?placed in the public domain", 1),
    # GNU: notices which name the version, then the sentences of notices and texts
    *[("lesser", f"lgpl-{v}", rf"lesser {_PUBLISHED}(?:either )?version {v.replace('.', ' ')}", 3) for v in ("3", "2.1")],
    ("library", "lgpl-2", rf"library {_PUBLISHED}(?:either )?version 2", 3),
    ("affero", "agpl-3", rf"affero {_PUBLISHED}(?:either )?version 3", 3),
    *[("general", f"gpl-{v}", rf"{_PUBLISHED}(?:either )?version {v}", 3) for v in ("3", "2", "1")],
    ("lesser", "lgpl", rf"lesser {_PUBLISHED.rstrip()}", 2),
    ("library", "lgpl", rf"library {_PUBLISHED.rstrip()}", 2),
    ("affero", "agpl", rf"affero {_PUBLISHED.rstrip()}", 2),
    ("general", "gpl", rf"{_PUBLISHED.rstrip()}", 2),
    ("copyleft", "gpl", r"the gnu general public license is a free copyleft license for software", 3),
    ("freedom", "gpl", r"the licenses for most software are designed to take away your freedom to share and change it", 2),
    ("documentation", "gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 2),
    # Apache
    ("apache", "apache-2.0", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 3),
    ("perpetual", "apache-2.0", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license|each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license", 3),
    ("conditions", "apache", r"distributed under the license is distributed on an as is basis without warranties or conditions of any kind", 1),
    # Mozilla, Eclipse, CDDL, EUPL, CeCILL
    ("mozilla", "mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0", 3),
    ("mozilla", "mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", 3),
    ("incompatible", "mpl-2.0", r"this source code form is incompatible with secondary licenses", 3),
    ("accompanying", "epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 2),
    ("development", "cddl", r"the contents of this file are subject to the terms of the common development and distribution license", 2),
    ("eupl", "eupl", r"licensed under the eupl(?: version \d \d)? or as soon they will be approved", 2),
    ("cecill", "cecill", r"this software is governed by the cecill(?: \w)? license under french law", 2),
    # Fonts, languages, libraries
    ("font", "ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", 3),
    ("font", "ofl", r"any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell", 3),
    ("licensee", "psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license", 3),
    ("enhancements", "postgresql", r"has no obligations? to provide maintenance support updates enhancements or modifications", 2),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 2),
    ("semblance", "artistic", r"(?:the copyright holder maintains some semblance of artistic control over the development of the package)", 3),
    ("perl", "artistic", r"free software you can redistribute it and or modify it under the same terms as perl(?: itself)?", 2),
    # Creative Commons: the clauses of the deeds and the legal code
    ("commons", "cc", r"terms of this creative commons public license", 2),
    ("commons", "cc-by", r"creative commons attribution \d \d international public license", 3),
    ("beer", "beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", 3),
    ("confidential", "proprietary", r"unauthorized (?:copying|use|disclosure)(?: \S+){0,12}? is strictly prohibited proprietary and confidential", 2),
    ("prohibited", "proprietary", r"unauthorized (?:copying|use|reproduction|disclosure|distribution)(?: \S+){0,10}? strictly prohibited", 1),
]
FAMILIES.append(WORDING)
RULES = [rule for family in FAMILIES for rule in family]
#: What opens the gate: the keywords, and those written as one word with a version's first number (gpl3, gplv3).
KEYWORDS = sorted({rule[0] for rule in RULES} | {
    f"{keyword}{v}{label.rsplit('-', 1)[1][0]}"
    for keyword, label, _, priority in RULES if priority == 3 and re.search(r"-\d[^-]*$", label) for v in ("", "v")
})


def _grouped():
    """Rules by (keyword, label, priority), in their order: one alternation each."""
    groups: dict[tuple[str, str, int], list[str]] = {}
    for keyword, label, pattern, priority in RULES:
        groups.setdefault((keyword, label, priority), []).append(pattern)
    return groups


SPANS = "array<struct<start:int,end:int,priority:int,label:string>>"


def _rules() -> Column:
    """The rules as one constant, keywords as beginnings of words."""
    rows = [
        {"k": f" {keyword}", "p": r"(?<= )(?:" + "|".join(patterns) + r")(?= )", "l": label, "n": priority}
        for (keyword, label, priority), patterns in _grouped().items()
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<k:string,p:string,l:string,n:int>>")


def _spans(norm: Column, rule: Column) -> Column:
    """Every match as (start, end, priority, label); starts from the lengths of what lies
    between the matches, as no built-in function gives all places."""

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), rule["n"].alias("priority"), rule["l"].alias("label"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.arrays_zip(
        F.split(norm, rule["p"], F.lit(-1)).alias("gap"), F.regexp_extract_all(norm, rule["p"], F.lit(0)).alias("hit")
    )
    whole = F.filter(pairs, lambda pair: pair["hit"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(whole, start, step, lambda acc: acc["spans"])


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score, and
    detections (start, end in the words joined by blanks; priority; label)."""
    outputs = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    t = docs.select(F.struct("*").alias("row"), F.coalesce(text, F.lit("")).alias("t"))
    w = t.select("row", F.explode(F.array(split_words(ascii_lower(F.col("t")), TERM_GAP))).alias("w"))
    # The last word of each phrase gates it: the first ones are common words.
    last = [phrase[-1] for phrase, _ in BASE]
    w = w.withColumn("gate", F.arrays_overlap("w", F.array(*map(F.lit, dict.fromkeys(last)))))
    w = w.withColumn("gated", F.arrays_overlap("w", F.array(*map(F.lit, KEYWORDS))))

    def stands(phrase):
        def test(i):
            return reduce(
                lambda a, b: a & b, (F.coalesce(F.get("w", i + k) == word, F.lit(False)) for k, word in enumerate(phrase))
            )

        n = F.size("w")
        places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), test)
        return F.when(F.col("gate"), places).otherwise(F.array().cast("array<int>"))

    for i, (p, _) in enumerate(BASE):
        w = w.select("*", F.explode(F.array(stands(p))).alias(f"base{i}"))
    all_places = F.concat(*[F.col(f"base{i}") for i in range(len(BASE))])
    w = w.withColumn("norm", F.when(F.col("gated"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))))

    norm = F.col("norm")
    live = F.filter(_rules(), lambda rule: F.contains(norm, rule["k"]))
    found = F.flatten(F.transform(live, lambda rule: _spans(norm, rule)))
    w = w.select("*", F.explode(F.array(F.when(F.col("gated"), found).otherwise(F.array().cast(SPANS)))).alias("all"))

    def beaten(x):
        def beats(y):
            overlap = (y["start"] < x["end"]) & (x["start"] < y["end"])
            inside = (y["start"] <= x["start"]) & (x["end"] <= y["end"])
            longer = (y["end"] - y["start"]) > (x["end"] - x["start"])
            higher = y["priority"] > x["priority"]
            return (overlap & higher) | (inside & longer & (y["priority"] == x["priority"]))

        return F.exists("all", beats)

    kept = F.filter("all", lambda x: ~beaten(x))
    w = w.select("*", F.explode(F.array(kept)).alias("detections"))
    base = F.filter(
        F.array(*[F.when(F.size(f"base{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]),
        lambda x: x.isNotNull(),
    )
    own = F.transform("detections", lambda x: x["label"])
    doubt = F.aggregate(
        F.array_distinct(F.transform("detections", lambda x: F.struct(x["label"].alias("l"), x["priority"].alias("p")))),
        F.lit(1.0),
        lambda acc, x: acc * reduce(
            lambda other, item: F.when(x["p"] == item[0], F.lit(1 - item[1])).otherwise(other), CONFIDENCE.items(), F.lit(1.0)
        ),
    ) * F.pow(F.lit(1 - CONFIDENCE[2]), F.size(base))
    return w.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in outputs],
        F.size("w").cast("long").alias("n_words"),
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.round(1 - doubt, 6).alias("score"),
        "detections",
    )
