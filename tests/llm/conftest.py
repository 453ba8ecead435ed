"""Awkward documents for every operator: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blob string, hash long, __text string, k1 long, rule string"


def texts():
    r = random.Random(7)
    words = ["the", "of", "and", "thonre", "ouble", "éàü", "Straße", "x1", "die", "la", "#tag", "50%", "a|b", "日本", "\U0001f600", "THE", "İ", "e\u0301"]
    out = [None, "", " ", "\n\n", "one", "ÀÉ Ü", "\x00\x1f", "a\x0bb\x0cc\rd\te"]
    base = " ".join(r.choice(words) for _ in range(120))
    out += [base, base, base + " end", base.upper(), base[:200] + "\n" + base[:200] + "\n\n" + base[200:]]
    out += [" ".join(r.choice(words) for _ in range(n)) for n in (7, 8, 9, 19, 20, 21, 60, 300, 900)]
    out += ["loop of eight words that come again here " * 30, "same line here\n" * 40, "x" * 5000, "word " * 20000, "0123456789abcdef" * 300]
    return out


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", None, "clash", 1, "clash", 2, "clash") for i, t in enumerate(texts())]
    rows += [rows[8], (None, "null id here", "en", None, 3, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_nulls_rows(awkward):
    return [r for r in awkward.collect()]
