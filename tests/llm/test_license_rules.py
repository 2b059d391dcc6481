"""License rules: keywords, labels against a scan without gate and shortcuts, examples of each kind."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LISTED = licenses.MORE_NAMES + licenses.SINGLE + licenses.SENTENCES + licenses.ADDRESSES


@settings(max_examples=4, deadline=None, database=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_every_match_holds_its_keyword(data):
    for _, keyword, pattern, *_ in LISTED:
        plain = pattern.replace(r"\S", "[a-z]")
        found = data.draw(st.from_regex(re.compile(plain, re.A), fullmatch=True))
        assert f" {keyword} " in f" {found} ", (keyword, found)


def test_rules_are_their_own():
    patterns = [(r.label, r.pattern.pattern) for r in licenses.rules() if "spdx" not in r.keyword]
    names = {r.label for r in licenses.rules()}
    assert len(set(patterns)) >= 250 and len(names) >= 100
    assert len({p for _, p in patterns}) >= len(set(patterns)) - 2  # one pattern gives one label


def _plain_scan(text):
    """All rules at all places, each pair of detections compared. "or" and "and" before an id need an SPDX line somewhere."""
    line = f" {' '.join(WORD.findall(''.join(chr(ord(c) + 32) if 'A' <= c <= 'Z' else c for c in text)))} "
    spans = [s for i, rule in enumerate(licenses.rules()) if "spdx" not in rule.keyword or " spdx license identifier " in line
             for s in licenses.spans_of(line, i)]
    order = sorted(set(spans), key=lambda s: (s[0], -s[1], -s[2], s[3]))
    kept = [s for n, s in enumerate(order) if not any(
        o[0] <= s[0] and o[1] >= s[1] and o[2] >= s[2] and (o[:3] != s[:3] or m < n)
        for m, o in enumerate(order) if m != n)]
    base = {v for k, v in licenses.BASE.items() if f" {k} " in line}
    return ",".join(sorted(base | {licenses.rules()[i].label for *_, i in kept}))


PIECES = ["the MIT License", "under the MIT license", "Apache License, Version 2.0", "licensed under the terms of", "GNU General Public License v3",
          "or any later version", "see", "SPDX-License-Identifier: GPL-2.0-or-later", "OR MIT", "CC BY-NC-SA 4.0", "cc by nc", "All rights reserved.",
          "creative commons attribution license", "https://opensource.org/licenses/BSD-3-Clause", "permission is hereby granted",
          "Permission is hereby granted, free of charge, to any person obtaining a copy", "word", "the", "Zope Public License", "public domain",
          "is in the public domain", "artistic license 1.0", "Open Software License 2.1", "BSD license", "GPLv2", "LGPL 2.1 only", "terms of"]


def test_labels_by_brute_force():
    rng = random.Random(6)
    for _ in range(600):
        text = " ".join(rng.choice(PIECES) for _ in range(rng.randint(1, 9)))
        assert licenses.scan_text(text)[5] == _plain_scan(text), text


@pytest.mark.parametrize("text, labels", [
    ("Redistributions of source code must retain the above copyright notice", "bsd"),
    ("Neither the name of Example Corp. nor the names of its contributors may be used to endorse or promote products", "bsd-3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License", "gpl,gpl-3"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2"), ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
    ("The Software shall be used for Good, not Evil.", "json"), ("Business Source License 1.1", "busl"), ("no license at all", ""),
    ("distributed under the terms of the Universal Permissive License", "upl"), ("Open Software License 2.1", "osl-2"),
])
def test_signatures(text, labels):
    assert licenses.scan_text(text)[5] == labels


def test_what_stands_before_a_name_counts():
    assert licenses.scan_text("licensed under the terms of the Zope Public License")[6] == 0.9
    assert licenses.scan_text("subject to the Zope Public License")[6] == 0.8
    assert licenses.scan_text("see the Zope Public License")[6] == 0.7
    assert licenses.scan_text("Zope Public License or any later version")[6] == 0.6
