"""The gates of the license scan spare work only."""

import random
import re
from re import _constants as kind
from re import _parser as parser

from test_native_rules import brute_scan

from ledgerloom.llm import license_scan


def drawn(parsed, draw):
    """A string that the parsed regex matches."""
    out = []
    for op, value in parsed:
        if op is kind.LITERAL:
            out.append(chr(value))
        elif op is kind.IN:
            first, second = value[0]
            out.append(chr(second if first is kind.LITERAL else draw.randint(*second)))
        elif op is kind.BRANCH:
            out.append(drawn(draw.choice(value[1]), draw))
        elif op is kind.SUBPATTERN:
            out.append(drawn(value[3], draw))
        else:
            assert op is kind.MAX_REPEAT
            out += [drawn(value[2], draw) for _ in range(draw.randint(value[0], min(value[1], 2)))]
    return "".join(out)


def examples(n):
    draw = random.Random(1)
    for rule in license_scan.rules():
        parsed = parser.parse(rule[4])
        for _ in range(n):
            spaced = drawn(parsed, draw)
            assert re.fullmatch(rule[4], spaced)
            yield rule, spaced


def test_every_match_passes_its_gates():
    stems = [s.replace(" ", "  ") for s in license_scan.STEMS + license_scan.UNDER]
    for (_, _, _, keyword, regex), spaced in examples(60):
        assert keyword in spaced, (regex, spaced)
        assert any(s in spaced for s in stems), (regex, spaced)


def ungated(text, monkeypatch):
    listed = [(n, p, label, "", regex) for n, p, label, _, regex in license_scan.rules()]
    with monkeypatch.context() as m:
        m.setattr(license_scan, "rules", lambda: listed)
        return brute_scan(text)


def test_scan_agrees_without_gates(docs, monkeypatch):
    texts = [
        "Released under the MIT.", "available under the Apache 2.0", "distributed under the GPLv2", "published under the BSD",
        "licensed under the FreeBSD license", "Creative Commons Zero license", "released under Creative Commons Zero 1.0 Universal",
        *(" ".join(spaced.split()) for _, spaced in examples(1)),
    ]
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        wanted = ungated(text, monkeypatch)
        assert (found[i]["labels"], found[i]["score"]) == wanted[5:7], text
        assert [tuple(d) for d in found[i]["detections"]] == wanted[7], text
    assert [found[i]["labels"] for i in range(7)] == ["mit", "apache", "gpl", "bsd", "bsd-2-clause", "cc0", "cc0"]
