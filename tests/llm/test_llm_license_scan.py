import re

import pytest

from lexframe.llm import license_scan as s

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    return (len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
            ",".join(sorted({label for _, label in places})))


TEXTS = ["MIT License", "the MIT-license, mit LICENSE. mit license license", "mitlicense mit\nlicense", "license mit",
         "GNU General Public License version 3 apache license mit license", "general public general public license",
         "é mit license", "license " * 500 + "mit license " * 500, None, ""]


def test_base_against_brute_force(spark, odd_docs, sf_dir):
    docs = odd_docs.select("text").union(spark.createDataFrame([(t,) for t in TEXTS], "text string")).union(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))
    rows = s.scan_licenses(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(r["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


MIT = s.TEMPLATES[8].text


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", {"apache", "Apache-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "GPL-3.0"}),
    ("This work is licensed under the GNU General Public License, version 2.", {"gpl", "GPL-2.0"}),
    ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0"}),
    ("Released under the MIT License.", {"mit", "MIT"}),
    ("x " * 50 + MIT.upper() + " y" * 50, {"MIT"}),
    (MIT.replace("free of charge", "for a fee"), set()),
    ("permission is hereby given", set()),
])
def test_templates(text, labels):
    index = s.LicenseIndex(s.TEMPLATES, {w: 1.0 for w in s.template_words()})
    assert {t.label for t, _, _ in index.places(s.alnum_words(text.encode()))} == labels


def test_clashing_columns_and_empty_table(odd_docs, no_docs):
    out = s.scan_licenses(odd_docs)
    assert out.columns.count("score") == 1 and out.count() == 9
    assert s.scan_licenses(no_docs).count() == 0


@pytest.mark.parametrize("rare, text, label", [
    (b"released", "Distributed under the MIT License.", "MIT"),
    (b"licensed", "Available under the Apache License, Version 2.0.", "Apache-2.0"),
    (b"redistribution", "Use in source and binary forms, with or without modification, are permitted provided that", "BSD"),
    (b"redistribute", "This is free software: you can share it and/or modify it under the terms of the GNU General Public License as"
     " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0"),
    (b"a", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
])
def test_a_missing_rare_word_loses_no_label(rare, text, label):
    index = s.LicenseIndex(s.TEMPLATES, {w: 9.0 if w == rare else 1.0 for w in s.template_words()})
    assert label in {t.label for t, _, _ in index.places(s.alnum_words(text.encode()))}


@pytest.mark.parametrize("text, label", [
    ("Apache License\n  Version 2.0, January 2004", "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "LGPL-2.1"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
     " Public License as published by the Free Software Foundation; either version 2.1 of the License", "LGPL-2.1"),
    ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version.", "AGPL-3.0"),
    ("Mozilla Public License Version 2.0", "MPL-2.0"),
    ("Creative Commons Attribution 4.0 International", "CC-BY-4.0"),
    ("Creative Commons Attribution-ShareAlike 3.0 Unported", "CC-BY-SA-3.0"),
    ("CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
    ("CC0 1.0 Universal", "CC0-1.0"),
    ("# SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
     " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
     " OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "MIT"),
])
@pytest.mark.parametrize("rare", [None, b"the", b"license", b"version"])
def test_headings_headers_and_identifiers(text, label, rare):
    index = s.LicenseIndex(s.TEMPLATES, {w: 9.0 if w == rare else 1.0 for w in s.template_words()})
    found = index.places(s.alnum_words(f"x y {text} z".encode()))
    assert label in {t.label for t, _, _ in found} and all(0 < share <= 1 for _, _, share in found)


def test_a_filled_in_word_keeps_the_key_phrases():
    clause = next(t for t in s.TEMPLATES if t.label == "BSD-3-Clause" and t.slack)
    index = s.LicenseIndex(s.TEMPLATES, {w: 1.0 for w in s.template_words()})
    changed = clause.text.replace("the copyright holder", "Example Institute of Technology")
    assert "BSD-3-Clause" in {t.label for t, _, _ in index.places(s.alnum_words(changed.encode()))}
