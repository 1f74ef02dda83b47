"""License scan: neighbouring licenses are told apart, and findings against a plain search."""
import random

import pytest

from casewright.llm import license_scan as L
from casewright.llm.license_templates import TEMPLATES

TEXT = dict(TEMPLATES)


def names(spark, *texts):
    rows = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [sorted({r.license for r in rows if r.doc_id == i}) for i in range(len(texts))], rows


def test_each_template_is_found_as_itself_only(spark):
    found, rows = names(spark, *[f"Some words before. {t} And after it." for _, t in TEMPLATES])
    for (name, _), got in zip(TEMPLATES, found):
        assert name in got and len(got) <= 2 and all(x.split("-")[0].split()[0] == name.split("-")[0].split()[0] for x in got), (name, got)
    assert all(r.coverage == 1.0 for r in rows if r.license == TEMPLATES[r.doc_id][0])


@pytest.mark.parametrize("text,expected", [
    ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0 statement"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0 statement"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0 statement"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0 statement"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0 notice"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0 notice"]),
    (TEXT["AGPL-3.0-or-later notice"].replace("version 3", "version 2"), []),
    ("Licensed under CC BY 3.0.", ["CC-BY-3.0 statement"]),
    ("Licensed under CC BY 2.5.", []),
    ("Released under the BSD License.", ["BSD statement"]),
    ("Released under the Eclipse License.", []),
    ("Not released under the MIT or any other License", []),
    ("This is not released under the MIT License.", []),
    ("It is, as we said, released under the MIT License.", ["MIT statement"]),
    ("Licensed under the Apache License, Version 2", ["Apache-2.0 statement"]),
])
def test_neighbouring_licenses_are_told_apart(spark, text, expected):
    assert names(spark, text)[0] == [expected]


def brute(text):
    """Names of the templates that stand in the text word for word."""
    bare = lambda x: " ".join("".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in x).split())
    return sorted(n for n, t in TEMPLATES if f" {bare(t)} " in f" {bare(text)} ")


def test_planted_statements_are_found_where_a_plain_search_finds_them(spark):
    rng = random.Random(4)
    words = ["under", "the", "license", "version", "free", "of", "work", "is", "this", "lorem", "ipsum"]
    texts = []
    for _ in range(60):
        filler = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40)))
        texts.append(f"{filler()} xx. " + " ".join(f"{rng.choice(TEMPLATES)[1]} yy {filler()} zz." for _ in range(rng.randrange(3))))
    texts += [texts[0], texts[0], None, "", "lorem ipsum " * 30_000 + "Released under the MIT License."]
    found, rows = names(spark, *texts)
    for text, got in zip(texts, found):
        assert set(brute(text or "")) <= set(got) | {"Apache-2.0 statement"}   # the statement opens the longer notice, which covers it
    assert found[60] == found[0] == found[61] and found[62] == found[63] == [] and found[64] == ["MIT statement"]
    for r in rows:
        assert r.matched_words <= r.template_words and 0.8 <= r.coverage <= 1 and 0 <= r.start < r.end <= len(texts[r.doc_id])
