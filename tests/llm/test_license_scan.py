"""License scan: licenses that differ in a few words."""

import random

import pytest

from scanhouse.llm.license_scan import TEMPLATES, Templates, all_templates, license_scan, scan
from scanhouse.llm.license_texts import NAMES, SHORT, whole_texts

ALL = Templates(all_templates(), NAMES, 0.8)
GNU = "This work is licensed under the GNU {}, version {}"


def licenses(text):
    return {name.split()[0] for name, *_ in scan(text, ALL)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY 4.0", {"CC-BY-4.0"}),
        ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0"}),
        ("Licensed under CC BY-NC-SA 4.0.", {"CC-BY-NC-SA-4.0"}),
        ("Licensed under CC BY-NC 3.0.", set()),
        ("Released under the BSD License", {"BSD"}),
        ("Released under the Some License.", set()),
        ("Released under the MIT License-style terms.", set()),
        (GNU.format("General Public License", 2), {"GPL-2.0"}),
        (GNU.format("General Public License", "2.1"), set()),
        (GNU.format("General Public License", "3.0."), {"GPL-3.0"}),
        (GNU.format("Lesser General Public License", 3), {"LGPL-3.0"}),
        (GNU.format("Lesser General Public License", 2.1), {"LGPL-2.1"}),
        (GNU.format("Affero General Public License", 3), {"AGPL-3.0"}),
        (GNU.format("Sleepycat General Public License", 3), set()),
        ("Licensed under the Some License, Version 2.0.", set()),
        ("Licensed under the Apache License, Version 1.1.", set()),
        ("Licensed under the Apache License, Version 2.0.", {"Apache-2.0"}),
    ],
)
def test_other_licenses_are_not_taken_for_one(text, want):
    assert licenses(f"some words before it. {text} and after it") == want


def test_each_template_is_found_as_itself_only():
    for name, text in (TEMPLATES | SHORT).items():
        found = scan(f"# before\n{text}\nafter", ALL)
        assert {n.split()[0] for n, *_ in found} == {name.split()[0]}, name
        assert 1.0 in {c for n, c, *_ in found if n == name}


def test_phrases_are_in_their_templates():
    templates = {t.name: t for of in ALL.by_probe.values() for t in of}
    assert set(NAMES) <= set(templates)
    assert all(templates[n].phrase(a.split()) for n, ps in NAMES.items() for p in ps for a in p.split("|"))


def test_whole_texts(spark):
    texts = whole_texts()
    assert len(texts) == 13
    rows = [(name, "preface " * 7 + text + " end" * 9) for name, text in texts.items()]
    affero = texts["GPL-3.0 whole"].replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("29 June", "19 November")
    found = license_scan(spark.createDataFrame([*rows, ("AGPL-3.0 opening", affero)], "doc_id string, text string")).collect()
    for r in found:
        ids = {m.license.split()[0] for m in r.licenses}
        assert r.doc_id in {m.license for m in r.licenses}
        assert ids <= {r.doc_id.split()[0], *(["GPL-3.0"] if r.doc_id.startswith("AGPL") else [])}
        assert not any(m.license == "GPL-3.0 whole" for m in r.licenses if r.doc_id.startswith("AGPL"))


def test_stretches_are_found_at_every_offset():
    """0.85 of the words, over 1.4 times the template: found whole wherever it starts."""
    n = 40
    template = [f"word{i}" for i in range(n)]
    here = Templates({"T": " ".join(template)}, {}, 0.8)
    rng = random.Random(3)
    kept = sorted(rng.sample(range(n), 34))
    spread = [template[i] for i in kept]
    for k in range(int(1.4 * n) - len(spread)):
        spread.insert(rng.randrange(1, len(spread)), f"x{k}")
    for offset in range(2 * n):
        text = " ".join(["before"] * offset + spread + ["after"] * 50)
        (found,) = scan(text, here)
        assert found == ("T", 34 / n, 7 * offset, 7 * offset + len(" ".join(spread))), offset


@pytest.mark.parametrize("between", [" ", "\n", "\n1 # ", " and more words then "])
@pytest.mark.parametrize("offset", [0, 1, 3, 7])
def test_copies_back_to_back(between, offset):
    for name in ("MIT notice", "GPL-3.0 notice", "GPL-3.0 header", "ISC"):
        text = TEMPLATES[name]
        found = [f for f in scan("start " * offset + between.join([text] * 9), ALL) if f[0] == name]
        assert [f[1] for f in found] == [1.0] * 9
        assert [f[2] for f in found] == [6 * offset + i * len(text + between) for i in range(9)]


def test_changed_copies_back_to_back():
    """Each copy lacks a word and has line numbers in it."""
    rng = random.Random(5)
    for name in ("GPL-3.0 header", "MPL-2.0 header", "ISC", "MIT"):
        here = Templates({name: TEMPLATES[name]}, {}, 0.8)
        copies = []
        for _ in range(8):
            words = TEMPLATES[name].split()
            del words[rng.randrange(5, len(words) - 5)]
            for _ in range(len(words) // 8):
                words.insert(rng.randrange(5, len(words) - 5), str(rng.randrange(100, 999)))
            copies.append(" ".join(words))
        found = scan("\n".join(copies), here)
        assert len(found) == len(copies), name
        assert all(f[1] > 0.9 for f in found)


def test_long_lists_of_notices():
    text = TEMPLATES["GPL-3.0 notice"] + "\n"
    assert len(scan(text * 1000, ALL)) == 1000
