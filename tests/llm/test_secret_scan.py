"""Secret spans against plain expressions, text by text."""

import hashlib
import random
import re

import numpy as np
import pytest
from text_fixtures import frame, shipped  # noqa: F401

from casoteca.llm import secret_scan
from casoteca.llm.secret_scan import RULES, Rule


def plain(text, rules=RULES):
    out = []
    for r, rule in enumerate(rules):
        flags = re.ASCII | (re.IGNORECASE if rule.any_case else 0)
        for m in re.finditer(f"(?:{rule.prefix})(?P<body>{rule.body})", text, flags):
            if len(m["body"]) >= rule.least:
                out.append((m.start(), r, m.end()))
    return sorted(out)


def spelled(matches, rules=RULES):
    return ",".join(f"{rules[r].kind}:{a}:{b}" for a, r, b in matches)


TOKENS = ["password", "PassWd", "secret", "token", "api_key", "APIkey", "=", ":", " ", '"', "'", "AKIA", "abc123",
          "ABCDEFGH1234", "0123456789abcdef", "deadbeef", ".", "\n", "é", "🙂", "ghp_", "a" * 36, "eyJ", "x.y",
          "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-", "==", "q", " " * 700, "f" * 1300, "ſecret=abcdefghij"]


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(TOKENS) for _ in range(rng.choice([0, 1, 3, 10, 40, 200]))) for _ in range(n)]


def test_spans_of_random_texts(frame):
    rows = [*enumerate(texts(400)), (1000, None), (1000, "token=abcdefgh"), (None, "token=abcdefgh"),
            (1001, "secret:" + "x" * 2_000_000), (1002, "token" + " " * 500_000 + "=" + "a" * 40),
            (1003, "0" * 31), (1004, "0" * 32), (1005, "token=secret:abcdefghijkl"), (1006, "AKIA" + "A" * 11)]
    found = secret_scan.find_secrets(frame(rows)).collect()
    assert len(found) == len(rows)
    want = sorted((i is None, i, spelled(plain(t or ""))) for i, t in rows if i is not None)
    assert sorted((r.doc_id is None, r.doc_id, r.spans) for r in found if r.doc_id is not None) == want
    by_id = {r.doc_id: r for r in found}
    assert by_id[None].spans == "assign:0:14"
    for i, t in rows[:400]:
        base = [m for m in plain(t) if m[1] < 3]
        assert by_id[i].base_sha256 == hashlib.sha256(spelled(base).encode()).hexdigest()
        assert (by_id[i].n_assign, by_id[i].n_access, by_id[i].n_hex) == tuple(
            sum(m[1] == r for m in base) for r in range(3))


def test_empty_table(frame):
    assert secret_scan.find_secrets(frame([])).collect() == []


def test_lanes_agree_with_one_lane(monkeypatch):
    automaton = secret_scan.compile_rules(RULES)
    stream = np.frombuffer(b"".join(t.encode() + b"\xff" for t in texts(40, 9)), np.uint8)
    whole = automaton.run(stream)
    for size in (1, 7, 64, len(stream)):
        monkeypatch.setattr(secret_scan, "LANE", size)
        part = automaton.run(stream)
        assert (part[0] == whole[0]).all() and (part[1] == whole[1]).all()


def test_own_rules(frame):
    rules = (Rule("ab", "", "ab{2,3}"), Rule("digits", "x(yz)?", "[0-9]{2}"), Rule("word", "", "[a-z]+!"))
    text = "abbbabbxyz123x45abb!zz!"
    found = secret_scan.find_secrets(frame([(1, text)]), rules, rules[:1]).first()
    assert found.spans == spelled(plain(text, rules), rules)
    assert found.n_ab == sum(m[1] == 0 for m in plain(text, rules))


def test_minimised_table_is_smallest():
    """No two states of the combined table give the same labels for every input."""
    automaton = secret_scan.compile_rules(RULES[:3])
    table = automaton.table.reshape(-1, automaton.width) // automaton.width
    label = automaton.ended[::automaton.width]
    again, _ = secret_scan.minimise(table, label)
    assert len(again) == len(table)


@pytest.mark.parametrize("rule", [Rule("r", "", "a(bc)?"), Rule("r", "", "a*"), Rule("r", "", "[^a]"),
                                  Rule("r", "", "(ab"), Rule("r", "", r"\d"), Rule("r", "", "abcd|b"),
                                  Rule("r", "", "é")])
def test_refused_rules(rule):
    with pytest.raises(ValueError):
        secret_scan.compile_rules((rule,))
