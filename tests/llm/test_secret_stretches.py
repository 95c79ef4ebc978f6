"""Secrets in texts made to be slow, and rules whose body is more than one class."""

from __future__ import annotations

import random
import re
import time

import pytest

from plumbline.llm import secrets

JWT = re.compile(rb"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+")
KEY = re.compile(rb"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----[A-Za-z0-9+/=\x20\n\r]*")


@pytest.fixture(scope="module")
def scanner():
    return secrets.compile_rules()


def spans(data, scanner, kind):
    return [(a, b) for a, b, rule in secrets.scan(data, scanner) if scanner.rules[rule].kind == kind]


def by_hand(data, pattern, least):
    return [m.span() for m in pattern.finditer(data) if m.end() - m.start() >= least]


def test_tokens_of_three_parts(scanner):
    pick = random.Random(3)
    for _ in range(1500):
        data = "".join(pick.choice(("eyJ", "eyJ", ".", "a", "b-", "_" * 9, " ", "eyJhbGciOi.eyJzdWIiOi.", "e", "ey")) for _ in range(pick.randrange(14))).encode()
        assert spans(data, scanner, "jwt") == by_hand(data, JWT, 30)


def test_keys(scanner):
    pick = random.Random(4)
    for _ in range(400):
        data = "".join(pick.choice(("-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----", "abc=\n", " ", ".", "BEGIN "))
                       for _ in range(pick.randrange(9))).encode()
        assert spans(data, scanner, "private_key") == by_hand(data, KEY, 27)


@pytest.mark.parametrize("text, found", [
    (b"eyJ" * 350_000, []),                                       # one stretch full of beginnings
    (b"eyJa." * 200_000, None), ((b"eyJ" * 50 + b".") * 6000, None), (b"-----BEGIN PRIVATE KEY" * 45_000, None),
    (b"eyJ" * 300_000 + b".eyJab.cd", [(0, 900_009, 6)]),
    (b"token " * 170_000, []), (b"password" + b" " * 1_000_000, []), (b"a1" * 500_000, [(0, 1_000_000, 2)]),
])
def test_a_megabyte_of_one_stretch(scanner, text, found):
    """Linear time: a megabyte takes a few seconds whatever it repeats."""
    started = time.process_time()
    got = secrets.scan(text, scanner)
    assert time.process_time() - started < 20
    if found is not None:
        assert got == found
    else:
        assert [(a, b) for a, b, rule in got if scanner.rules[rule].kind == "jwt"] == by_hand(text, JWT, 30)
        assert [(a, b) for a, b, rule in got if scanner.rules[rule].kind == "private_key"] == by_hand(text, KEY, 27)
