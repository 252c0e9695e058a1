"""Secret scans take time in proportion to a text's length, and long texts are handled whole."""

from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from conceptlake.llm import secrets

JWT = next(r for r in secrets.RULES if r.kind == "jwt")
HEAVY = {
    "heads in one run": ".eyJ" + "eyJ" * 350_000, "heads in many runs": "eyJa." * 250_000, "keywords": "password" * 150_000, "keywords and spaces": "password:" + " " * 1_000_000, "begins": "-----BEGIN " * 100_000,
    "key lines": "-----BEGIN PRIVATE KEY-----\n" + ("A" * 64 + "\n") * 16_000, "begins with lines": ("-----BEGIN PRIVATE KEY-----\n" + "Ab" * 40 + "\n") * 9_000, "logins": "://a" * 250_000, "long login": "://" + "a" * 1_000_000 + ":", "hex": "0123456789abcdeg" * 60_000,
}


@pytest.mark.parametrize("name", HEAVY)
def test_a_megabyte_takes_seconds(name):
    import pyarrow as pa

    scanner, began = secrets.Scanner(), time.perf_counter()
    scanner.segment(pa.array([HEAVY[name]]))
    assert time.perf_counter() - began < 8


@given(st.lists(st.sampled_from(["eyJ", ".", "a", "-", " ", "ey", "J", "eyJa", "é", "eyJb.eyJc."]), max_size=24))
@settings(max_examples=400, deadline=None)
def test_the_linear_pattern_finds_the_same(parts):
    text = "".join(parts)
    assert [m.span(1) for m in re.finditer(JWT.scan, text, re.ASCII)] == [m.span() for m in re.finditer(JWT.pattern, text, re.ASCII)]
