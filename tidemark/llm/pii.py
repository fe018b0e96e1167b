"""Personal data: validated values are replaced by keyed pseudonyms of the same format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 that dates are permuted within: 270 * 270, to August 2099.
DAY_SIDE, FIRST_DAY = 270, "1900-01-01"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What each kind looks like, in the order in which they are tried. Possessive repeats and the look-behinds keep long runs
#: without a break linear; no value is too long.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*[A-Za-z0-9-]",
    "token": r"(?<![0-9A-Za-z_-])(?:sk-|pk-|ghp_|gho_|xoxb-|xoxp-|AKIA|AIza)[0-9A-Za-z_-]{16,}",
    "secret": r"(?<![0-9A-Za-z])(?=\d*[A-Fa-f])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "intl": r"(?<![\d+])\+\d{1,3}(?:[ .-]?\d{1,4}){2,6}(?!\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "card": r"(?<![\d])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)",
}
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy")


def _round(key: Column, kind: str, i: Column, value: Column) -> Column:
    """A keyed number below 16^14 from one half."""
    said = F.concat_ws("|", key, F.lit(kind), i.cast("string"), value.cast("string"), key)
    return F.conv(F.substring(F.sha2(said, 256), 1, 14), 16, 10).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: Spark computes an expression anew at each place it stands in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(key: Column, kind: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """A keyed permutation of the pairs (left, right) with left < left_size and right < right_size, as a struct (a, b).

    Rounds add a keyed function of one half to the other, modulo its own size, so any sizes do."""

    def step(acc: Column, i: Column) -> Column:
        a, b = acc["a"], acc["b"]
        new_a = F.when(i % 2 == 1, F.pmod(a + F.pmod(_round(key, kind, i, b), acc["m"]), acc["m"])).otherwise(a)
        new_b = F.when(i % 2 == 0, F.pmod(b + F.pmod(_round(key, kind, i, a), acc["n"]), acc["n"])).otherwise(b)
        return F.struct(new_a.alias("a"), new_b.alias("b"), acc["m"].alias("m"), acc["n"].alias("n"))

    halves = {"a": left, "b": right, "m": left_size, "n": right_size}
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(*[x.cast("long").alias(c) for c, x in halves.items()]), step)


def permute_digits(key: Column, kind: str, digits: Column) -> Column:
    """A keyed permutation of the digit strings of each length from 2 to 36."""

    def permute(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        size = lambda k: F.pow(F.lit(10.0), k).cast("long")
        mixed = feistel(key, kind, F.substr(d, F.lit(1), half).cast("long"), F.substr(d, half + 1).cast("long"), size(half), size(n - half))
        padded = lambda x, k: F.lpad(x.cast("string"), k, F.lit("0"))
        return let(mixed, lambda x: F.concat(padded(x["a"], half), padded(x["b"], n - half)))

    return let(digits, permute)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string; a multiple of ten is valid."""

    def total(d: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            one = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 0, one).when(one > 4, one * 2 - 9).otherwise(one * 2)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), step)

    return let(digits, total)


def _fill(shape: Column, digits: Column) -> Column:
    """shape with its digits, in order, replaced by those given."""

    def fill(d: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            digit = c.between("0", "9")
            new = F.concat(acc["s"], F.when(digit, F.substr(d, acc["k"], F.lit(1))).otherwise(c))
            return F.struct(new.alias("s"), (acc["k"] + digit.cast("int")).alias("k"))

        return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step)["s"]

    return let(digits, fill)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(key: Column, value: Column) -> Column:
    """Luhn-valid numbers of 13 to 19 digits: all but the check digit are permuted, and a fitting one is put behind."""

    def card(d: Column) -> Column:
        check = lambda body: F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        new = let(permute_digits(key, "card", F.substr(d, F.lit(1), F.length(d) - 1)), lambda body: F.concat(body, check(body).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _fill(value, new))

    return let(_digits(value), card)


def _phone(key: Column, value: Column) -> Column:
    """The last ten digits are permuted; the country's code stays. Of numbers with a plus sign that have fewer digits, all but
    the first two are; those with fewer than 8 or more than 15 aren't telephone numbers."""

    def phone(d: Column) -> Column:
        kept = F.greatest(F.length(d) - 10, F.when(F.length(d) == 10, F.when(value.startswith("+"), 2).otherwise(0)).otherwise(F.lit(2)))
        new = F.concat(F.substr(d, F.lit(1), kept), permute_digits(key, "phone", F.substr(d, kept + 1)))
        return F.when(F.length(d).between(8, 15), _fill(value, new))

    return let(_digits(value), phone)


def mod97(text: Column) -> Column:
    """The number that digits and capital letters (A = 10 to Z = 35) spell, modulo 97."""
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + code(c)) % 97)


def _iban(key: Column, value: Column) -> Column:
    """Account numbers with a valid check: their digits are permuted, letters and the country stay, the check is new."""

    def iban(plain: Column) -> Column:
        country, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))

        def write(new: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            return let(check, lambda c: _fill(value, F.concat(c, F.regexp_replace(new, "[^0-9]", ""))))

        digits = F.regexp_replace(body, "[^0-9]", "")
        valid = (mod97(F.concat(body, country, F.substr(plain, F.lit(3), F.lit(2)))) == 1) & (F.length(digits) >= 2)
        return F.when(valid, let(_fill(body, permute_digits(key, "iban", digits)), write))

    return let(F.regexp_replace(value, " ", ""), iban)


def _ssn(key: Column, value: Column) -> Column:
    """Area (001-899 without 666), group (01-99) and serial (0001-9999) are permuted among the valid ones."""
    part = lambda a, n: F.substring(value, a, n).cast("long")
    area = part(1, 3) - 1 - (part(1, 3) > 666).cast("long")
    mixed = feistel(key, "ssn", area, (part(5, 2) - 1) * 9999 + part(8, 4) - 1, F.lit(898), F.lit(99 * 9999))

    def write(x: Column) -> Column:
        parts = ((x["a"] + 1 + (x["a"] >= 665).cast("long"), 3), (F.floor(x["b"] / 9999) + 1, 2), (x["b"] % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(v.cast("string"), n, "0") for v, n in parts])

    return let(mixed, write)


def _ip(key: Column, value: Column) -> Column:
    """IPv4 addresses are permuted as 32-bit numbers."""
    o = [F.split(value, r"\.")[k].cast("long") for k in range(4)]
    mixed = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    return let(
        mixed, lambda x: F.concat_ws(".", *[v.cast("string") for v in (F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256)])
    )


def _date(key: Column, value: Column) -> Column:
    """Dates that exist, from 1900 to August 2099, are permuted among these and written in the same format."""
    first = F.lit(FIRST_DAY).cast("date")

    def writer(form: str) -> Callable[[Column], Column]:
        def write(day: Column) -> Column:
            mixed = feistel(key, "date", F.floor(day / DAY_SIDE), day % DAY_SIDE, F.lit(DAY_SIDE), F.lit(DAY_SIDE))
            new = let(mixed, lambda x: F.date_format(F.date_add(first, (x["a"] * DAY_SIDE + x["b"]).cast("int")), form))
            return F.when(day.between(0, DAY_SIDE * DAY_SIDE - 1), new)

        return write

    out = F.lit(None).cast("string")
    for form in DATE_FORMATS:
        fits = F.translate(value, "123456789", "000000000") == form.translate(str.maketrans("yMd", "000"))
        out = F.when(fits, let(F.datediff(F.try_to_date(value, form), first), writer(form))).otherwise(out)
    return out


def _hex(key: Column, kind: str, value: Column, length: Column) -> Column:
    """Keyed hexadecimal digits, as many as asked."""
    part = lambda i: F.sha2(F.concat_ws("|", key, F.lit(kind), i.cast("string"), value, key), 256)
    return F.substr(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((length - 1) / 64).cast("int")), part), ""), F.lit(1), length)


def _secret(key: Column, value: Column) -> Column:
    """Long hexadecimal keys become keyed hexadecimal digits of the same length and case."""
    return let(_hex(key, "secret", F.lower(value), F.length(value)), lambda new: F.when(F.upper(value) == value, F.upper(new)).otherwise(new))


def _token(key: Column, value: Column) -> Column:
    """Access tokens keep their prefix of four characters and their length."""
    return F.concat(F.substr(value, F.lit(1), F.lit(4)), _hex(key, "token", value, F.length(value) - 4))


def _email(key: Column, value: Column) -> Column:
    """96 bits of a keyed hash: that two of 10^12 addresses share a pseudonym has a chance of 1 in 10^5."""
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(value), key), 256), 1, 24), F.lit("@mail.invalid"))


def pseudonym(key: Column, value: Column) -> Column:
    """The pseudonym of one matched value; null if it doesn't validate."""
    out = F.when(value.contains("@"), _email(key, value))
    makers = {"token": _token, "secret": _secret, "iban": _iban, "ip": _ip, "phone": _phone, "intl": _phone, "ssn": _ssn, "date": _date, "card": _card}
    for kind, make in makers.items():
        out = out.when(value.rlike("^(?:" + PATTERNS[kind] + ")$"), make(key, value))
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_values") -> DataFrame:
    """docs with the personal values of text_col replaced, and how many were (count_col, if any).

    Found: e-mail addresses, access tokens with a known prefix, hexadecimal secrets of 32 digits or more (one a letter), account numbers
    (IBAN), IPv4 addresses, telephone numbers, social security numbers, dates and card numbers; what fails its check
    (Luhn digit, modulo 97, calendar) stays as it is. One key gives equal values
    equal pseudonyms in all documents, and numbers and dates different values different ones. Null texts stay null with
    count 0, texts without such values stay as they are; other columns and repeated rows stay, but for columns named
    count_col, __found and __new, which are replaced or dropped; an empty table gives no rows. Only a text's own row is
    read, so nothing is shuffled."""
    text, pattern = F.col(text_col), "|".join(f"(?:{p})" for p in PATTERNS.values())
    some = F.coalesce(text.rlike("[0-9@]|[a-f]{32}|[A-F]{32}|sk-|pk-|ghp_|gho_|xox[bp]-|AKIA|AIza"), F.lit(False))  # what all patterns need
    found = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    new = F.transform("__found", lambda v: pseudonym(F.lit(key), v))
    between = F.split(text, pattern, -1)
    shown = F.zip_with("__found", "__new", lambda old, n: F.coalesce(n, old))
    mixed = F.concat_ws("", F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))))
    out = docs.withColumn("__found", found).withColumn("__new", new)
    out = out.withColumn(text_col, F.when(F.size("__found") > 0, mixed).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.size(F.filter("__new", lambda x: x.isNotNull())).cast("long"))
    return out.drop("__found", "__new")
