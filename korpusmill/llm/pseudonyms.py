"""Format-preserving pseudonyms for personal data, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.llm.common import fresh

ROUNDS = 8
#: Dates that are permuted: this many days from 1900-01-01 on.
DAYS, DAY_PARTS = 73_000, (250, 292)

#: A name, in any case, and what may stand between it and its secret.
SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ \t]*(?:=|:(?!:))[ \t]*"
#: Without quotes prose may follow the name ("the secret: of success"). A value right after "=" is one; any other has six characters
#: or more, or four letters and digits, and among its first 64 a digit or a capital after a small letter.
BARE = r"(?:(?<==)[^\x20\x09-\x0D]+|(?=[^\x20\x09-\x0D]{6}|(?=[A-Za-z0-9]{4})[0-9]{0,3}[A-Za-z])(?=[^\x20\x09-\x0D]{0,63}[0-9]|[^\x20\x09-\x0D]{0,62}[a-z][A-Z])[^\x20\x09-\x0D]+)"

#: What is looked for, in this order at each place. Digits stand alone: none stands next to them. Each pattern reads a text in
#: linear time and without a deep stack: an address starts where its characters start, and groups of any number are possessive.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "ip": r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3][0-9][./][0-3][0-9][./](?:19|20)[0-9]{2})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
    "abroad": r"\+[1-9](?:[ .-]?[0-9]){7,14}(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5})(?![0-9])",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "password": rf"(?<![A-Za-z0-9]){SECRET}(?:\"(?:[^\"\\\r\n]|\\.)++\"|'(?:[^'\\\r\n]|\\.)++'|{BARE})",
    "plain": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def permute(left: Column, right: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """A keyed permutation of pairs ``l`` below a, ``r`` below b: an unbalanced Feistel network of modular sums."""
    mix = lambda i, x: _number(F.sha2(F.concat_ws(":", F.lit(key), F.lit(tag), a, i, x), 256))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["l"] + mix(i, s["r"]), a)).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + mix(i, s["l"]), b)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _power10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _permuted(digits: Column, key: str, tag: str) -> Column:
    """As many digits, permuted; a number of 2 to 30 digits."""
    n = F.length(digits)
    k = F.floor(n / 2).cast("int")
    left, right = F.substr(digits, F.lit(1), k).cast("long"), F.substr(digits, k + 1, n - k).cast("long")
    pad = lambda x, width: F.lpad(x.cast("string"), width, F.lit("0"))
    return let(permute(left, right, _power10(k), _power10(n - k), key, tag), lambda s: F.concat(pad(s["l"], k), pad(s["r"], n - k)))


def _laid_out(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    char = lambda i: F.substr(m, i, F.lit(1))
    nth = lambda i: F.length(_digits(F.substr(m, F.lit(1), i)))
    new = lambda d: F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(char(i).between("0", "9"), F.substr(d, nth(i), F.lit(1))).otherwise(char(i)))
    return let(digits, lambda d: F.array_join(new(d), ""))


def _luhn(digits: Column) -> Column:
    """Sum that is a multiple of 10 for a valid number."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = _permuted(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    check = lambda b: F.pmod(10 - _luhn(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return F.when(_luhn(d) % 10 == 0, let(body, lambda b: _laid_out(m, F.concat(b, check(b))))).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """Numbers of the North American plan keep to it: area and exchange start with 2 to 9."""
    d = _digits(m)
    n = F.substr(d, F.length(d) - 9, F.lit(10))
    rank = ((F.substr(n, F.lit(1), F.lit(3)).cast("long") - 200) * 800 + F.substr(n, F.lit(4), F.lit(3)).cast("long") - 200) * 10_000 + F.substr(n, F.lit(7), F.lit(4)).cast("long")
    half = F.lit(80_000)

    def shown(s: Column) -> Column:
        out = s["l"] * half + s["r"]
        area, rest = F.floor(out / 8_000_000) + 200, F.pmod(out, F.lit(8_000_000))
        return F.concat(area.cast("string"), (F.floor(rest / 10_000) + 200).cast("string"), F.lpad(F.pmod(rest, F.lit(10_000)).cast("string"), 4, "0"))

    new = let(permute(F.floor(rank / half), F.pmod(rank, half), half, half, key, "phone"), shown)
    return _laid_out(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new))


def _plain(m: Column, key: str) -> Column:
    """Numbers laid out alike that are not of the plan, as area or exchange starts with 0 or 1, stay outside it: 360,000 pairs of both."""
    d = _digits(m)
    n = F.substr(d, F.length(d) - 9, F.lit(10))
    area, exchange = F.substr(n, F.lit(1), F.lit(3)).cast("long"), F.substr(n, F.lit(4), F.lit(3)).cast("long")
    rank = F.when(area < 200, area * 1_000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
    pad = lambda x, width: F.lpad(x.cast("string"), width, F.lit("0"))

    def shown(s: Column) -> Column:
        out, more = s["l"], s["l"] - 200_000
        both = F.when(out < 200_000, out).otherwise((F.floor(more / 200) + 200) * 1_000 + F.pmod(more, F.lit(200)))
        return F.concat(pad(both, 6), pad(s["r"], 4))

    new = let(permute(rank, F.substr(n, F.lit(7), F.lit(4)).cast("long"), F.lit(360_000), F.lit(10_000), key, "plain"), shown)
    return _laid_out(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new))


def _abroad(m: Column, key: str) -> Column:
    d = _digits(m)
    return _laid_out(m, F.concat(F.substr(d, F.lit(1), F.lit(1)), _permuted(F.substr(d, F.lit(2), F.length(d)), key, "abroad")))


def _ip(m: Column, key: str) -> Column:
    at = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    word = F.lit(65_536)
    both = permute(at(1) * 256 + at(2), at(3) * 256 + at(4), word, word, key, "ip")
    return let(both, lambda s: F.concat_ws(".", F.floor(s["l"] / 256), F.pmod(s["l"], F.lit(256)), F.floor(s["r"] / 256), F.pmod(s["r"], F.lit(256))))


def _ssn(m: Column, key: str) -> Column:
    d = _digits(m)
    area = F.substr(d, F.lit(1), F.lit(3)).cast("long")
    rank = area - F.when(area > 666, 2).otherwise(1)  # 898 areas
    rest = (F.substr(d, F.lit(4), F.lit(2)).cast("long") - 1) * 9_999 + F.substr(d, F.lit(6), F.lit(4)).cast("long") - 1
    pad = lambda x, width: F.lpad(x.cast("string"), width, "0")
    new = lambda s: F.concat_ws(
        "-", pad(s["l"] + F.when(s["l"] + 1 >= 666, 2).otherwise(1), 3), pad(F.floor(s["r"] / 9_999) + 1, 2), pad(F.pmod(s["r"], F.lit(9_999)) + 1, 4),
    )
    return let(permute(rank, rest, F.lit(898), F.lit(99 * 9_999), key, "ssn"), new)


def _date(m: Column, key: str) -> Column:
    """Valid dates only; day before month where a slash or a dot leaves the choice and both are possible."""

    def one(fmt: str) -> tuple[Column, Column]:
        day = F.try_to_timestamp(m, F.lit(fmt)).cast("date")
        first = F.lit("1900-01-01").cast("date")
        n = F.datediff(day, first)
        both = permute(F.floor(n / DAY_PARTS[1]), F.pmod(n, F.lit(DAY_PARTS[1])), *(F.lit(p) for p in DAY_PARTS), key, "date")
        return day.isNotNull() & n.between(0, DAYS - 1), let(both, lambda s: F.date_format(F.date_add(first, (s["l"] * DAY_PARTS[1] + s["r"]).cast("int")), fmt))

    out = m
    for fmt, shape in (("MM/dd/yyyy", "/"), ("dd/MM/yyyy", "/"), ("dd.MM.yyyy", "."), ("yyyy-MM-dd", "-")):
        ok, new = one(fmt)
        out = F.when(F.contains(m, F.lit(shape)) & ok, new).otherwise(out)
    return out


def _tag(m: Column, key: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), F.lower(m)), 256)


def _secret(m: Column, key: str) -> Column:
    """Name, blanks and quotes stay; the digest is that of the value alone."""
    head = F.regexp_extract(m, f"^{SECRET}[\"']?", 0)
    quote = F.regexp_extract(m, f"^{SECRET}([\"']?)", 1)
    rest = F.substr(m, F.length(head) + 1, F.length(m))
    closed = (quote != "") & F.endswith(rest, quote)
    value = F.when(closed, F.substr(rest, F.lit(1), F.length(rest) - 1)).otherwise(rest)
    return F.concat(head, F.substring(_tag(value, key), 1, 18), F.when(closed, quote).otherwise(""))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match; a match that its check rejects stays as it is."""
    whole = lambda kind: F.rlike(m, F.lit(f"^(?:{KINDS[kind]})$"))
    upper = F.upper(F.translate(F.substring(_tag(m, key), 1, 16), "01", "GH"))
    return (
        F.when(F.contains(m, F.lit("@")) & whole("email"), F.concat(F.substring(_tag(m, key), 1, 16), F.lit("@example.invalid")))
        .when(whole("key"), F.concat(F.lit("AKIA"), upper))
        .when(whole("password"), _secret(m, key))
        .when(whole("ip"), _ip(m, key)).when(whole("date"), _date(m, key)).when(whole("phone"), _phone(m, key))
        .when(whole("ssn"), _ssn(m, key)).when(whole("card"), _card(m, key)).when(whole("abroad"), _abroad(m, key)).when(whole("plain"), _plain(m, key)).otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of ``docs``; in the text, validated numbers, dates and names of accounts have keyed pseudonyms. ``n_replaced`` counts them.

    Card numbers (Luhn), telephone numbers, IPv4 addresses, social security numbers and dates are permuted by a Feistel
    network within their own format, layout and validity, so equal values get equal pseudonyms in every document and,
    with the key, originals can be had back. Email addresses, access keys and passwords get keyed digests in their format. What
    looks alike but fails its check (a wrong Luhn sum, 31 February) stays.

    A secret follows a name such as ``token`` in any case and ``=`` or ``:``, with or without blanks and quotes; without quotes it
    stands right after ``=`` or looks like one, so prose stays. An address does not follow a letter: ``v1.2.3.4`` is a version.
    There is no default for ``key``: who knows it can undo the permutations.

    Null texts stay null with 0 replaced; texts without a digit, "@", "=", ":" or "AKIA" hold nothing to find; texts of any
    length are read whole, in linear time; each of several equal rows gets the same result; an empty table gives an empty
    result; a column of ``docs`` named ``n_replaced`` is replaced.
    """
    docs = docs.drop("n_replaced")
    source = F.col(text)
    found = F.regexp_extract_all(source, F.lit(PATTERN), F.lit(0))
    pairs = F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    parts = F.split(source, PATTERN, -1)
    out = F.when(F.rlike(source, F.lit("[0-9@=:]|AKIA")), F.struct(pairs.alias("pairs"), parts.alias("parts")))
    hit = fresh(docs, "hit")
    field = lambda name: F.col(hit)[name]
    new = F.array_join(F.zip_with(field("parts"), F.transform(field("pairs"), lambda p: p["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    count = F.size(F.filter(field("pairs"), lambda p: p["old"] != p["new"]))
    some = F.col(hit).isNotNull()
    return docs.withColumn(hit, out).select(
        *[F.when(some, new).otherwise(source).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns], F.when(some, count).otherwise(0).alias("n_replaced"),
    )
