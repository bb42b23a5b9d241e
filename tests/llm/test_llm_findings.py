"""Secret candidates and their features against a plain restatement; URL vocabularies from a table."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from surcos.llm import secrets, urls

SF = "/root/testdata/sf0.001"
NAMES = re.compile(
    r"(token|secret|passw|pwd|api[ _.-]?key|access[ _.-]?key|private|credential|auth(?!ors?[^a-z])|bearer|client[ _.-]?id|signing)"
    r"[a-z0-9_-]{0,12}[\"'`]?[ \t]{0,3}[=:][ \t]{0,3}[\"'`]?$",
    re.I | re.A,
)
INSIDE = re.compile(r"[a-z0-9_-]*?(token|secret|passw|pwd|api[_-]?key|access[_-]?key|private|credential|auth|bearer|client[_-]?id|signing)[a-z0-9_-]*=", re.I | re.A)
ODD = [
    'password = "Xk!9#vQz"', "password: Summer$2024 and more", "db_password=hunter2hunter2 x", "pwd:shortie", "the author: Montgomery wrote",
    "api key = abc.def;ghi", "token='two words here'", "API_KEY=`0123456789abcdef`", "x?token=abcdefgh12345678&y=1", "secret = é12345678 z",
    "auth: https://a.example.com/b/c/d", "commit 0123456789abcdef0123", "a=b=c=d=0123456789abcdef", "password  :   'spaced out'",
    "password    =    fourblanks", "secret=\n12345678", "token==abcdefgh", "private_signing_key_id: a1b2c3d4", "passwords: " + "z" * 100_000,
    "token=secret=abcdefgh1234", "bearer\t=\t\tTabbed-Value9", "=abcdefgh", "token", "", "client-id: x" + "9" * 15 + " password=pass=word=123",
]


def plain_candidates(text: str):
    """Every place is tried in order, context first."""
    out, i = [], 0
    in_set = lambda c: c.isascii() and (c.isalnum() or c in "+/_=-")
    value = lambda c: c not in "\t\n\x0b\x0c\r \"'`"

    def run(start, test):
        end = start
        while end < len(text) and test(text[end]):
            end += 1
        return end

    while i < len(text):
        end = i
        if i and text[i - 1] in "=: \t\"'`" and NAMES.search(text[max(0, i - 80) : i]):
            end = run(i, value)
            end = end if end - i >= 8 else i
        if end == i and not (i and in_set(text[i - 1])) and in_set(text[i]):
            stop = run(i, in_set)
            held = INSIDE.match(text, i, stop)
            named = held is not None and run(held.end(), value) - held.end() >= 8
            if stop - i >= 16 and re.search("[0-9]", text[i:stop]) and not named:
                end = stop
        if end > i:
            out.append((i, text[i:end]))
            i = end
        else:
            i += 1
    return out


def plain_features(before, c, after, table, known):
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    kind = lambda x: letters.find(x) + 1
    low, n = c.lower(), len(c)
    steps = [table[kind(a) * 37 + kind(b)] for a, b in zip(low, low[1:])]
    parts = re.findall("[A-Za-z]{3,}", re.sub("([a-z])([A-Z])", r"\1 \2", c))
    near = before[-24:]
    return [
        n, sum(steps) / (n - 1), sum(len(p) for p in parts if p.lower() in known) / n, c.count("/") / n,
        bool(re.search(r"(://|[./~\\])\S*$", before, re.A) or re.search("^/|/.*/.*/", c)), len(re.findall("[0-9]", c)) / n,
        len(re.findall("[A-Z]", c)) / n, bool(re.search(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$", c)), len(set(low)) / min(n, 37),
        bool(re.search(secrets.NAMING, near)), bool(re.search(secrets.BENIGN, near)), bool(re.search("[=:]\\s*[\"'`]?$", before)),
        bool(re.search("[\"'`]$", before) and re.search("^[\"'`]", after)), len(re.findall("[0-9]+", c)) / n,
        len(re.findall("[^A-Za-z0-9]", c)) / n, sum(bool(re.search(k, c)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def test_candidates_and_features_equal_plain_ones(spark, docs):
    odd = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(ODD)] + [(-1, ODD[0]), (None, ODD[1]), (-99, None)], "doc_id long, text string")
    table = docs.unionByName(odd)
    log, known = secrets.language(docs)
    found = secrets.with_features(secrets.candidates(table), log, known)
    got = [(r["doc"]["doc_id"], r["nth"], r["candidate"], r["before"], r["after"], [r[f] for f in secrets.FEATURES]) for r in found.collect()]
    want = []
    for doc_id, text in ((r["doc_id"], r["text"]) for r in table.collect()):
        here, last = plain_candidates(text or ""), 0
        for k, (i, c) in enumerate(here):
            stop = here[k + 1][0] if k + 1 < len(here) else len(text)
            before, after = text[last:i][-48:], text[i + len(c) : stop][:24]
            want.append((doc_id, k, c, before, after, plain_features(before, c, after, log, set(known))))
            last = i + len(c)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    got.sort(key=order), want.sort(key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx([float(x) for x in w[5]], rel=1e-9, abs=1e-9), g[2]
    assert sum((i or 0) < 0 for i, *_ in got) >= 18


def test_short_passwords_are_masked_and_words_are_not(spark, docs):
    trained = secrets.train(docs)
    hidden = ["Xk!9#vQz2p", "qWzXvKjTrBnP", "7f3a9c1e55", "T9$kLm2#xR"]
    shown = ["montgomery", "${DATABASE_PASSWORD}", "<your-password-here>", "config.database.name", "get_password(user)", "************"]
    rows = [(k, f'the password = "{v}" is kept', 0) for k, v in enumerate(hidden + shown)]
    out = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), trained)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    for k, v in enumerate(hidden + shown):
        masked = f'the password = "{secrets.MASK if v in hidden else v}" is kept'
        assert texts[k] == masked


def test_vocabulary_from_a_table(spark):
    rows = [("Casino", 2.0), ("casino", 1.0), (" BET ", 1.0), ("win", 0.5), (None, 3.0), ("", 3.0), ("deal", 0.0), ("free", None), ("nan", float("nan"))]
    table = spark.createDataFrame(rows, "term string, weight double")
    strict, soft = urls.vocabulary(table)
    assert strict == ("casino",) and soft == ("bet", "win")
    pages = spark.createDataFrame([(1, "http://a.com/CASINO"), (2, "http://a.com/bet-win"), (3, "http://a.com/bet"), (4, "http://a.com/poker")], "page_id long, url string")
    judged = {r["doc"]["page_id"]: r["verdict"] for r in urls.judge(pages, strict=strict, soft=soft).collect()}
    assert judged == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    nothing = urls.vocabulary(table.limit(0))
    assert nothing == ((), ())
    assert {r["verdict"] for r in urls.judge(pages, strict=(), soft=()).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.vocabulary(table.select(F.lit("a" * 201).alias("term"), "weight"))
