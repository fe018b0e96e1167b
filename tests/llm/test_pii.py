"""Pseudonyms against a plain Feistel network."""

import hashlib
import re

from pyspark.sql import functions as F

from tidemark.llm.pii import ROUNDS, pseudonymise

KEY = "a key"


def plain_feistel(kind, a, b, m, n):
    for i in range(1, ROUNDS + 1):
        said = lambda half: int(hashlib.sha256(f"{KEY}|{kind}|{i}|{half}|{KEY}".encode()).hexdigest()[:14], 16)  # noqa: B023, E731
        if i % 2:
            a = (a + said(b) % m) % m
        else:
            b = (b + said(a) % n) % n
    return a, b


def plain_digits(kind, digits):
    half = len(digits) // 2
    rest = len(digits) - half
    a, b = plain_feistel(kind, int(digits[:half]), int(digits[half:]), 10**half, 10**rest)
    return f"{a:0{half}d}{b:0{rest}d}"


def plain_luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10


def plain_iban(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def said(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pseudonymise(frame, KEY).orderBy("doc_id").collect()]


def test_pseudonyms_equal_a_plain_feistel_network(spark):
    card, phone, ip = "4111111111111111", "(212) 555-0187", "10.20.30.40"
    body = plain_digits("card", card[:-1])
    check = next(c for c in "0123456789" if plain_luhn(body + c) == 0)
    p = plain_digits("phone", "2125550187")
    x, y = plain_feistel("ip", 10 * 256 + 20, 30 * 256 + 40, 65536, 65536)
    area, rest = plain_feistel("ssn", 123 - 1, (45 - 1) * 9999 + 6789 - 1, 898, 99 * 9999)
    ssn = f"{area + 1 + (area >= 665):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
    want = [f"x {body}{check} y", f"({p[:3]}) {p[3:6]}-{p[6:]}", f"{x // 256}.{x % 256}.{y // 256}.{y % 256}", ssn]
    assert said(spark, [f"x {card} y", phone, ip, "123-45-6789"]) == want


def test_values_of_any_length_and_kind(spark):
    secret, iban, phone, token = "deadbeef" * 16, "DE89 3704 0044 0532 0130 00", "+49 30 1234567", "ghp_" + "aB3" * 12
    texts = [secret, f"pay {iban} now", "GB82WEST12345698765432", "DE88370400440532013000", phone, "+442071838750", token, "abcdef" * 6, "a" * 200 + "@" + "b." * 40 + "com", "+12 34", "+1" + "2" * 40]
    got = said(spark, texts)
    assert re.fullmatch("[0-9a-f]{128}", got[0]) and got[0] != secret
    new = re.search("[A-Z].* now", got[1])[0][:-4]
    assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", iban) and new != iban and plain_iban(new.replace(" ", "")) == 1
    assert plain_iban(got[2]) == 1 and got[2][:2] == "GB" and got[2][4:8] == "WEST" and got[2] != texts[2]
    assert got[3] == texts[3]  # the check fails
    assert re.fullmatch(r"\+49 30 \d{7}|\+49 \d\d \d{7}", got[4]) and got[4] != phone and re.fullmatch(r"\+44\d{10}", got[5]) and got[5] != texts[5]
    assert got[6].startswith("ghp_") and len(got[6]) == len(token) and got[6] != token
    assert got[7] != texts[7] and len(got[7]) == 36  # letters alone, in a text without digits
    assert got[8].endswith("@mail.invalid") and len(got[8]) == 38 and got[9:] == texts[9:]


def test_rows_columns_and_nulls_stay(spark):
    rows = [(1, "mail a@b.org", 7, "x"), (1, "mail a@b.org", 7, "x"), (None, None, None, None), (2, "", 1, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_values int, __found string")
    got = pseudonymise(frame, KEY)
    assert got.columns == ["doc_id", "text", "n_values"]
    assert sorted((r.n_values, r.text is None) for r in got.collect()) == [(0, False), (0, True), (1, False), (1, False)]
    assert got.where("doc_id = 1").select("text").distinct().count() == 1
    assert pseudonymise(frame.limit(0), KEY).count() == 0
    both = spark.createDataFrame([(1, "a@b.org", "c@d.org")], "doc_id long, text string, other string").select("*", F.lit(3).alias("x"))
    assert pseudonymise(both, KEY).first().other == "c@d.org"
