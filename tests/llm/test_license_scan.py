import re

import pytest

from sitewise.llm.license_scan import BASE, RULES, WORDING, scan_licenses

TEXTS = [
    (1, "Released under the MIT License."),
    (2, "CC-BY and cc by, all rights reserved. All Rights\nReserved"),
    (3, "This work is licensed under the GNU General Public License, version 3."),
    (4, ""), (5, None), (6, "den mit und der"), (6, "den mit und der"),
    (7, "Licensed under CC BY-NC 4.0."),
    (None, "general public licenses; GENERAL PUBLIC LICENSE"),
    (8, "x " * 3000 + "Licensed under the Apache License, Version 2.0."),
    (9, "éé cc by"),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, labels string")
    return scan_licenses(docs).collect()


def test_fixed_phrases_match_a_plain_scan(found):
    for row in found:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), row.text or ""))
        places, labels = [], set()
        for phrase, label in BASE:
            at = [i for i in range(len(words)) if tuple(words[i:i + len(phrase)]) == phrase]
            places += at
            labels |= {label} if at else set()
        assert row.n_words == len(words) and row.n_base == len(places)
        assert (row.first_word, row.last_word) == ((min(places), max(places)) if places else (None, None))
        assert row.base_labels == ",".join(sorted(labels))
        assert labels <= set(row.labels.split(",")) | {""}
        assert 0 <= row.score <= 1


def test_labels_and_suppression(found):
    labels = {r.doc_id: r.labels for r in found}
    assert labels[1] == "mit" and labels[3] == "gpl,gpl-3" and labels[8] == "apache-2.0"
    assert labels[7] == "cc-by,cc-by-nc-4.0"
    assert labels[4] == labels[5] == labels[6] == ""
    assert len(found) == len(TEXTS)


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_versions_in_one_word(spark):
    texts = {
        "MPL2.0": "mpl-2.0", "GPL3": "gpl-3", "LGPL2.1": "lgpl-2.1", "EPL1.0": "epl-1.0", "CeCILL2.1": "cecill-2.1", "GPLv3": "gpl-3",
        "LGPLv2.1": "lgpl-2.1", "AGPLv3": "agpl-3", "GPLv2+": "gpl-2", "MPLv2": "mpl-2.0", "Apache v2": "apache-2.0", "EUPLv1.2": "eupl-1.2",
    }
    rows = scan_licenses(spark.createDataFrame([(f"It is {t}, see there.",) for t in texts], "text string")).collect()
    assert {r.text[6:-12]: r.labels for r in rows} == texts


def test_every_versioned_rule_passes_its_own_gate(spark):
    wanted = []
    for _, label, pattern, priority in RULES:
        if priority == 3 and "(?: version| v|v)? ?" in pattern:
            name, tail = pattern.replace(" ?commercial", " commercial").replace(" ?deriv", " deriv").replace(" ?alike", " alike").replace(
                "\\w+", "atives").split("(?: licen[sc]e)?(?: version| v|v)? ?")
            wanted += [(f"{name}{v}{tail}", label) for v in ("", "v", " ", " v", " version ")]
    rows = scan_licenses(spark.createDataFrame(wanted, "text string, want string")).collect()
    assert len(rows) > 300 and [r.text for r in rows if r.want not in r.labels.split(",")] == []


def test_wording_without_the_name(spark):
    texts = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided": "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software": "bsd-3 clause",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above": "isc",
        "The origin of this software must not be misrepresented; you must not": "zlib",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered": "bsl",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the": "gpl,gpl-2",
        "the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of": "gpl,lgpl-2.1",
        "the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of": "agpl-3,gpl",
        "This is free and unencumbered software released into the public domain.": "unlicense",
    }
    rows = scan_licenses(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.text: r.labels for r in rows} == texts


def test_wording_holds_its_keyword():
    assert [p for k, _, p, _ in WORDING if not re.search(rf"(?<![a-z]){k}", p)] == []
