import datetime
import ipaddress
import random
import re
import time

import pytest

from barograph.llm import pseudonyms

from test_llm import EDGE, docs

KEY = b"k" * 32


@pytest.mark.parametrize("n", [63, 64, 65, 3_000, 20_000, 100_000])
def test_long_addresses(n):
    p, back = pseudonyms.Pseudonyms(KEY), pseudonyms.Pseudonyms(KEY, True)
    local = "".join(random.Random(n).choices("abcdefghijkLMNOP0123456789._+", k=n))
    s = f"write to {local}@mail.example.com or not"
    t, k = p.text(s)
    assert k == 1 and t != s and len(t) == len(s) and back.text(t) == (s, 1)
    assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))


def test_no_search_goes_back_over_long_runs():
    p = pseudonyms.Pseudonyms(KEY)
    began = time.time()
    for s in ("+49" + "1" * 100_000 + "x", "+49" + " 1" * 50_000 + ":5", "1" * 100_000, "a." * 50_000 + "@", "a@" * 50_000, "x@" + "a." * 50_000 + "1", "AB12 " * 20_000, "1.2." * 25_000, "12-34-" * 20_000):
        p.text(s)
    assert time.time() - began < 20


def test_edges_of_tables(spark):
    assert pseudonyms.pseudonymize(docs(spark, []), KEY, "text", "n").count() == 0
    df = docs(spark, [*EDGE, (9, "call 123-45-6789", "b")]).withColumnRenamed("doc", "N")
    out = pseudonyms.pseudonymize(df, KEY, "text", "n")
    assert out.columns == [*df.columns, "n_"] and out.count() == len(EDGE) + 1
    row = out.where("doc_id = 9").first()
    assert row["n_"] == 1 and row["N"] == "clash" and row.text != "call 123-45-6789"


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _valid(token):
    """A brute-force detector of one token: no patterns, each kind by its definition."""
    if "@" in token:
        local, _, domain = token.partition("@")
        parts = domain.split(".")
        return bool(local) and len(parts) > 1 and all(parts) and len(parts[-1]) > 1 and parts[-1].isalpha()
    if token.isdigit():
        return 13 <= len(token) <= 19 and _luhn(token) and len(set(token)) > 1
    for sep in "-/.":
        parts = token.split(sep)
        if not all(p.isdigit() for p in parts):
            continue
        sizes = [len(p) for p in parts]
        if len(parts) == 4 and sep == ".":
            try:
                ipaddress.IPv4Address(token)
                return True
            except ValueError:
                return False
        if sizes == [3, 2, 4] and sep == "-":
            a, g, s = map(int, parts)
            return 0 < a < 900 and a != 666 and g > 0 and s > 0
        if len(parts) == 3:
            if sizes == [4, 2, 2] and sep in "-/":
                y, m, d = map(int, parts)
            elif max(sizes[:2]) <= 2 and sizes[2] == 4 and sep in "./":
                a, b, y = map(int, parts)
                m, d = (b, a) if sep == "." or a > 12 else (a, b)
            else:
                continue
            try:
                return 1900 <= datetime.date(y, m, d).year < 2100
            except ValueError:
                return False
    if len(token) > 14 and token[:2].isalpha() and token.isalnum() and token.isupper():
        lengths = {"GB": 22, "DE": 22, "ES": 24, "BE": 16}
        number = "".join(str(int(c, 36)) for c in token[4:] + token[:4])
        return lengths.get(token[:2]) == len(token) and 2 <= int(token[2:4]) <= 98 and int(number) % 97 == 1
    return False


def _token(rng):
    kind = rng.randrange(9)
    n = lambda a, b: rng.randint(a, b)
    if kind == 0:
        body = "".join(rng.choices("0123456789", k=n(11, 18)))
        return body + (next(c for c in "0123456789" if _luhn(body + c)) if n(0, 1) else str(n(0, 9)))
    if kind == 1:
        return f"{n(1890, 2110)}-{n(0, 13):02d}-{n(0, 32):02d}"
    if kind == 2:
        return f"{n(0, 32)}.{n(0, 13)}.{n(1890, 2110)}"
    if kind == 3:
        return f"{n(0, 32)}/{n(0, 32)}/{n(1890, 2110)}"
    if kind == 4:
        return ".".join(str(n(0, 280)) for _ in range(4))
    if kind == 5:
        return f"{rng.choice([0, 666, 900, n(1, 999)]):03d}-{n(0, 99):02d}-{n(0, 2) * 777:04d}"
    if kind == 6:
        name = "".join(rng.choices("abcXYZ019_", k=n(1, 9)))
        return f"{name}@{rng.choice(['a.org', 'b-c.example.de', 'nodot', 'x.y', 'x..org'])}"
    if kind == 7:
        t = rng.choice(["GB82WEST12345698765432", "DE89370400440532013000", "ES9121000418450200051332", "BE68539007547034"])
        i = n(4, len(t) - 1)
        return t if n(0, 1) else t[:i] + str((int(t[i], 36) + 1) % 10) + t[i + 1 :]
    return rng.choice(["word", "42", "3.14", "v1.2.3", "C17", "a/b", "1/2"])


def test_detector_equals_brute_force():
    rng, p = random.Random(5), pseudonyms.Pseudonyms(KEY)
    seen = 0
    for _ in range(400):
        tokens = [_token(rng) for _ in range(12)]
        got, n = p.text(" ; ".join(tokens))
        changed = [a != b for a, b in zip(tokens, got.split(" ; "), strict=True)]
        want = [_valid(t) for t in tokens]
        wrong = [(t, c, w) for t, c, w in zip(tokens, changed, want, strict=True) if c != w]
        assert not wrong and n == sum(want)
        seen += n
    assert seen > 1000
