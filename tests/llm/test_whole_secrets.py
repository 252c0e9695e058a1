"""Whole private keys and long logins are reported and hidden."""

from __future__ import annotations

import pytest

from conceptlake.llm import secrets

LINES = ["MIIEpAIBAAKCAQEA" + c * 48 for c in "abcdefgh"]


def key(label="RSA ", lines=LINES, br="\n", end=True):
    return br.join([f"-----BEGIN {label}PRIVATE KEY-----", *lines, *([f"-----END {label}PRIVATE KEY-----"] if end else [])])


CASES = [
    key(), key(""), key(br="\r\n"), key(br="\\n"), key(end=False), key("EC ", ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123-ab", "", *LINES]),
    key("ENCRYPTED ", [*LINES, "Ab1+/w=="], end=False), "://oauth2:" + "x9-" * 100 + "@", "://" + "u" * 70 + ":hunter22@",
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_nothing_is_left(spark, i):
    text = f"before {CASES[i]}\nhost and after"
    d = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    left = secrets.redact_secrets(d).first()["text"]
    assert left == "before [SECRET]\nhost and after"
    assert any(s.split(":")[1:] == ["7", str(7 + len(CASES[i]))] for s in secrets.scan_secrets(d).first()["spans"].split(","))


def test_blocks_are_kept_apart(spark):
    text = f"a {key(end=False)}\nclean words here\n{key('')} and b"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redact_secrets(d).first()["text"] == "a [SECRET]\nclean words here\n[SECRET] and b"
