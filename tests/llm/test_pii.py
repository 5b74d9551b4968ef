"""Spans against plain patterns, and the cases that a span finder meets."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbline.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    def valid(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(
                sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))
            )
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [
        (kind, *m.span())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text)
        if valid(kind, m[0])
    ]


def base(text):
    return [s for s in pii.spans(text) if s[0] in pii.BASE_KINDS]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.@+-( )4é:/05", max_size=40))
def test_base_spans_equal_the_plain_patterns(text):
    assert base(text) == brute(text)


@pytest.mark.parametrize(
    "text",
    [
        "x@y.z@w.v a.b@c-d.e-f.g. @a.b a@b a@@b.c",
        "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 0000000000.1.1.1",
        "4111 1111 1111 1111, 4111-1111-1111-1112 and 4521940886194967 12345678901234567890",
        "+1 (499) 555-6503 +1  +12 +1-2-3-4-5-6-7-8 (2) +123456789012345678",
        "é" * 50 + " mail: über.x@mail1.example.com.",
    ],
)
def test_named_cases(text):
    assert base(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "+1" + " " * 300_000, "@" * 300_000, "1." * 200_000, "x@" + "a" * 300_000):
        base(text)


def test_addresses_and_accounts():
    text = 'see https://user:pw@host.example.org/a?b=c. IBAN: DE89 3704 0044 0532 0130 00, token = "1eb9c654e721b4f8"'
    assert [(k, text[s:e]) for k, s, e in pii.spans(text) if k in ("address", "account")] == [
        ("address", "https://user:pw@host.example.org/a?b=c"),
        ("account", "DE89 3704 0044 0532 0130 00"),
        ("account", "1eb9c654e721b4f8"),
    ]
    assert pii.spans("the token of accounts is a password. Accounting://") == []


def test_redaction_leaves_clean_text_alone():
    assert pii.redacted("mail a.b@c.de now") == "mail <EMAIL> now"
    assert pii.redacted("nothing here") == "nothing here"
    assert pii.redacted("") == "" and pii.redacted(None) is None


def test_operator_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a@b.cd", "x"), (1, "a@b.cd", "y"), (None, None, "z"), (3, "", None)],
        "doc_id long, text string, spans string",
    )
    rows = {(r.doc_id, r.spans): r for r in pii.digest(pii.find(docs)).collect()}
    assert pii.find(docs).count() == 4 and pii.find(docs.limit(0)).count() == 0
    assert rows[(1, "email:0:6")].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest()
    assert rows[(None, "")].n_email == 0 and rows[(3, "")].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.redact(docs).columns == docs.columns
    assert [r.text for r in pii.redact(docs).orderBy("spans").collect()] == ["", "<EMAIL>", "<EMAIL>", None]


def test_query_equals_brute_force(spark):
    from ebbline.llm.queries import queries
    from tests.conftest import SMALL

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries()["op8_pii"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


@pytest.mark.parametrize("cue", ["API key", "Tax ID", "Customer ID", "Social Security number", "aPi_KeY", "Iban", "ACCT"])
def test_cues_in_any_letter_case(cue):
    text = f"é İ the {cue}: ab12345678 end"
    assert [(k, text[s:e]) for k, s, e in pii.spans(text)] == [("account", "ab12345678")]
    assert pii.redacted(text) == f"é İ the {cue}: <ACCOUNT> end"
    assert pii.spans(f"un{cue}: ab12345678") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("token: github_pat_" + "a1B" * 27, "github_pat_" + "a1B" * 27),
        ("secret=" + "0f" * 64, "0f" * 64),
        ("api key " + "0f" * 64, "0f" * 64),
        ("Password: Tr0ub!dor&x. Next", "Tr0ub!dor&x"),
        ('{"password": "correct horse battery", "a": 1}', "correct horse battery"),
        ("secret = 'open sesame'", "open sesame"),
        ("account: 12345678", "12345678"),
        ("account: holders", None),
        ("the token bucket and a secret garden", None),
    ],
)
def test_values_by_cue(text, want):
    assert [text[s:e] for k, s, e in pii.spans(text) if k == "account"] == ([want] if want else [])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("http://a.com,http://b.com", ["http://a.com", "http://b.com"]),
        ("(http://a.com\u3002 x", ["http://a.com"]),
        ("http://a.com/x?y=z, b", ["http://a.com/x?y=z"]),
        ("http://m\u00fcller.de/weg", ["http://m\u00fcller.de/weg"]),
        ("http://\u4f8b\u3048.\u30c6\u30b9\u30c8:80 x", ["http://\u4f8b\u3048.\u30c6\u30b9\u30c8:80"]),
        ("http://nohost and x://", []),
    ],
)
def test_addresses_end_at_their_host(text, want):
    assert [text[s:e] for k, s, e in pii.spans(text) if k == "address"] == want


def test_long_credentials_take_linear_time():
    for text in ("password=" * 40_000, 'password="' * 40_000, "token:'x" * 40_000, "http://a.b," * 30_000):
        pii.spans(text)
