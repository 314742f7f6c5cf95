import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from particula.llm import licenses as L

PHRASES = {**L.NOTICE_PHRASES, **L.BASE_PHRASES}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    at = lambda p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = sorted(i for p in L.BASE_PHRASES for i in at(p))
    base = sorted({v for p, v in L.BASE_PHRASES.items() if at(p)})
    labels = sorted({v for p, v in PHRASES.items() if at(p)})
    return (len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(base), ",".join(labels))


TEXTS = [
    "Released under the MIT License. CC BY-NC 4.0, cc by nc",
    "under the mit licenses", "under the mit license", "Apache License, Version 2.0", "apache license version 20",
    "éunder the mit license", "under the\nMIT\tlicense and cc_by.nc cc by nc under the mit license", "", None,
    "x " * 40000 + "under the mit license", "GNU General Public License, version 3", "ſ Ünder thE mit lICense under the mit license",
]


def test_scan_against_brute_force(spark):
    rows = [(i, t, 1, "a") for i, t in enumerate(TEXTS)] + [(None, "under the mit license", None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, labels string").repartition(3)
    got = sorted((tuple(r)[:7] for r in L.scan(df).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)
    assert L.scan(df.limit(0)).collect() == []


@given(st.lists(st.sampled_from(["under", "the", "mit", "license", "cc", "by", "nc", "apache", "version", "2", "é"]), max_size=30), st.sampled_from([" ", "-", ", ", "\n"]))
@settings(max_examples=200, deadline=None)
def test_scanner_against_brute_force(words, gap):
    text = gap.join(words)
    got = L.Scanner(L.BASE_PHRASES, L.NOTICE_PHRASES)(text.encode())
    assert got[:6] == brute(text) and 0 <= got[6] <= 1


@pytest.mark.parametrize(
    "text, labels, allows, well",
    [
        ("mit", {"mit"}, True, True),
        ("mit or gpl-2.0", {"mit", "gpl"}, True, True),
        ("mit and gpl-2.0", {"mit", "gpl"}, False, True),
        ("gpl-2.0 or mit and gpl-3.0", {"mit", "gpl"}, False, True),
        ("(gpl-2.0 or mit) and apache-2.0", {"mit", "gpl", "apache-2"}, True, True),
        ("gpl-2.0 with classpath-exception-2.0 or bsd-3-clause", {"gpl", "bsd"}, True, True),
        ("apache-2.0 with llvm-exception", {"apache-2"}, True, True),
        ("mit or gpl-2.0 with mit", {"mit", "gpl"}, True, True),
        ("gpl-2.0 with mit", {"gpl"}, False, True),
        ("mit or", {"mit"}, True, False),
        ("(mit", {"mit"}, True, False),
        ("and mit", {"mit"}, True, False),
        ("mit) or gpl-2.0", {"mit"}, True, False),
        ("", set(), False, False),
        ("mit see the file for more", {"mit"}, True, True),
    ],
)
def test_expressions(text, labels, allows, well):
    assert L.evaluate(text) == (labels, allows, well)


def test_tags_add_labels():
    got = L.Scanner(L.BASE_PHRASES, L.NOTICE_PHRASES)(b"// SPDX-License-Identifier: (MIT OR GPL-2.0) AND Apache-2.0\nint x;\n# license-expression: MPL-2.0")
    assert got[5] == "apache-2,gpl,mit,mpl" and got[1] == 0 and got[4] == "" and got[7] is False


def test_phrases_of_any_letters_and_spacing():
    scan = L.Scanner({"sous licence libre à tous": "libre", "許可": "kyoka", "--": "none"}, {"Domaine  Public": "public-domain"})
    got = scan("Texte sous licence libre à tous. 許可 domaine public; sous licence libre à tousse".encode())
    assert got[:6] == (14, 2, 1, 6, "kyoka,libre", "kyoka,libre,public-domain")
    assert scan(b"-- nothing")[1] == 0
