"""PII: format-preserving Feistel pseudonyms for numbers and dates that pass validation.

Each kind of value is read as a number in a range that splits exactly into two halves; a keyed Feistel network
permutes that range, and the result is written in the format of the original. Equal values get equal pseudonyms
in every document, different values of one kind stay different, and checksums and calendars stay valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.llm.text import let

ROUNDS = 8

#: What the kinds look like. The order decides where two could match at one place.
EMAIL = r"(?<![\w.%+-])[\w.%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
#: A secret with a digit is the whole run behind its label, up to a blank, quote or angle bracket; one without is of
#: eight plain signs or more. A match holds the label too, and punctuation at the end is none of it.
LABEL = r"\b(?i:token|password|passwd|secret|api_key|apikey)\s*+[=:]\s*+[\"']?"
RUN = r"[^\s\"'<>]"
SECRET = LABEL + r"(?!" + EMAIL + r")(?:(?=" + RUN + r"*\d)" + RUN + r"{5,}[^\s\"'<>.,;:!?)\]]|[\w+/.=-]{7,}[\w+/=-])"
#: Account numbers have one length per country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    whole, rest = divmod(length - 4, 4)
    tail = rf"(?: ?[A-Z0-9]{{{rest}}})" if rest else ""
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{whole}}}{tail}(?![A-Za-z0-9])"


#: Countries without a known length take the longest match.
IBAN = (
    r"\b(?:" + "|".join(_iban_of(*x) for x in IBAN_LENGTHS.items())
    + r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
)
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![./-]?\d)"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: A phone number of three, three and four digits is no part of a card number.
LOCAL = r"\d{3}[.-]\d{3}[.-]\d{4}(?!-?\d)"
CARD = r"(?<!\d)(?!" + LOCAL + r")\d(?:[ -]?(?!" + LOCAL + r")\d){12,18}(?!\d)"
PHONE = (
    r"(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}"
    r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\d.-])1[.-]\d{3}[.-]\d{3}[.-]\d{4}"
    r"|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4})(?![-]?\d))"
)
ANY = "|".join([EMAIL, SECRET, IBAN, DATE, ADDRESS, SOCIAL, CARD, PHONE])
#: A text without any of these characters can hold no match of the patterns.
SIGNS = "[0-9@=:]"

#: 400 Gregorian years from 1800 have 146,097 = 189 * 773 days.
FIRST_DAY, LAST_DAY, DAY_HALVES = "1800-01-01", "2199-12-31", (189, 773)


def feistel(left: Column, right: Column, sizes: tuple, key: str, kind: str) -> Column:
    """Keyed permutation of pairs (left, right) below ``sizes``, as a struct of ``a`` and ``b``.

    Every round swaps the halves and adds a keyed digest of one to the other; an even number of rounds ends
    with the sizes in their first order. Sizes may be numbers or columns up to 10^15.
    """
    low, high = (F.lit(x).cast("long") if isinstance(x, int) else x for x in sizes)

    def step(s: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i, s["b"], F.lit(key)), 256)
        noise = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        size = F.when(i % 2 == 1, low).otherwise(high)
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(noise, size), size).alias("b"))

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of up to 30 digits permuted among all of its length; an empty one stays."""

    def whole(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        power = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("long")
        left = F.concat(F.lit("0"), F.substring(d, F.lit(1), half))
        right = F.substring(d, half + 1, n - half)
        mixed = feistel(left, right, (power(half), power(n - half)), key, kind)
        return let(mixed, lambda m: F.concat(_padded(m["a"], half), _padded(m["b"], n - half)))

    return F.when(F.length(digits) > 0, let(digits, whole)).otherwise(digits)


def _padded(number: Column, width: Column) -> Column:
    return F.when(width > 0, F.lpad(number.cast("string"), width, F.lit("0"))).otherwise(F.lit(""))


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in turn by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(s: Column, c: Column) -> Column:
        one = F.substring(digits, s["k"], F.lit(1))
        is_digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, one).otherwise(c)).alias("out"),
            (s["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum of Luhn's rule over a digit string whose last digit is the check digit."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")),
        ),
        F.lit(0),
        lambda s, d: s + d,
    )


def card(value: Column, key: str) -> Column:
    """A card number with its first digit kept, the rest permuted and a new check digit; NULL if invalid.

    Where the whole value is not valid, the longest valid beginning of whole groups is taken; the rest stays.
    """

    def changed(printed: Column) -> Column:
        def payload(d: Column) -> Column:
            return F.concat(F.substring(d, 1, 1), permuted_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))

        check = lambda p: F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")
        new = let(let(digits_of(printed), payload), lambda p: refilled(printed, F.concat(p, check(p))))
        rest = F.substring(value, F.length(printed) + 1, F.length(value) - F.length(printed))
        return F.when(printed.isNotNull(), F.concat(new, rest))

    beginnings = F.array(*[F.regexp_extract(value, rf"\A(\d(?:[ -]?\d){{{n - 1}}})(?!\d)", 1) for n in range(19, 12, -1)])
    valid = F.filter(beginnings, lambda p: (p != "") & (F.pmod(luhn_sum(digits_of(p)), F.lit(10)) == 0))
    return let(F.get(valid, 0), changed)


def phone(value: Column, key: str) -> Column:
    """A phone number of 7 to 15 digits with its country code kept; NULL if it has another length."""
    code = F.when(value.rlike(r"\A1[.-]"), "1").otherwise(F.regexp_extract(value, r"^\+(\d{1,3})(?!\d)", 1))

    def changed(d: Column) -> Column:
        rest = F.substring(d, F.length(code) + 1, F.length(d) - F.length(code))
        return F.when(
            F.length(d).between(7, 15), refilled(value, F.concat(code, permuted_digits(rest, key, "phone")))
        )

    return let(digits_of(value), changed)


def social(value: Column, key: str) -> Column:
    """A number of area, group and serial; NULL for areas 000, 666 and from 900, group 00 or serial 0000."""

    def changed(d: Column) -> Column:
        area, group, serial = (F.substring(d, *at).cast("int") for at in ((1, 3), (4, 2), (6, 4)))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
        mixed = feistel(left, serial - 1, (898 * 99, 9999), key, "social")

        def written(m: Column) -> Column:
            at = F.floor(m["a"] / 99).cast("int")
            return F.format_string(
                "%03d-%02d-%04d", at + F.when(at >= 665, 2).otherwise(1), (m["a"] % 99).cast("int") + 1, m["b"] + 1
            )

        return F.when(valid, let(mixed, written))

    return let(digits_of(value), changed)


def address(value: Column, key: str) -> Column:
    """An IPv4 address permuted among all; NULL if a part is over 255."""

    def changed(p: Column) -> Column:
        part = [F.get(p, i).cast("int") for i in range(4)]
        valid = (part[0] < 256) & (part[1] < 256) & (part[2] < 256) & (part[3] < 256)
        mixed = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], (65536, 65536), key, "address")
        split = lambda x: (F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return F.when(valid, let(mixed, lambda m: F.concat_ws(".", *split(m["a"]), *split(m["b"]))))

    return let(F.split(value, r"\."), changed)


def date(value: Column, key: str) -> Column:
    """A calendar date permuted among 1800 to 2199 and written alike; NULL if there is no such date.

    ``dd/mm/yyyy`` and ``dd.mm.yyyy`` are tried day first; with slashes, month first is tried next.
    """
    shapes = [("-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), ("/", "MM/dd/yyyy"), (".", "dd.MM.yyyy")]

    def moved(shape: str) -> Column:
        day = F.try_to_timestamp(value, F.lit(shape)).cast("date")
        at = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        low, high = DAY_HALVES

        def written(m: Column) -> Column:
            return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (m["a"] * high + m["b"]).cast("int")), shape)

        mixed = feistel(F.floor(at / high), at % high, DAY_HALVES, key, "date")
        inside = day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))
        return F.when(inside, let(mixed, written))

    return F.coalesce(*[F.when(value.contains(sign), moved(shape)) for sign, shape in shapes])


def iban_rest(text: Column) -> Column:
    """Remainder by 97 of a string of digits and capitals, where A counts 10 and Z 35."""
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c)) % 97,
    )


def iban(value: Column, key: str) -> Column:
    """An account number with country and letters kept, digits permuted, check digits new; NULL if invalid."""

    def changed(v: Column) -> Column:
        country, body = F.substring(v, 1, 2), F.substring(v, F.lit(5), F.length(v) - 4)
        valid = iban_rest(F.concat(body, F.substring(v, 1, 4))) == 1
        new_body = refilled(body, permuted_digits(digits_of(body), key, "iban"))

        def written(b: Column) -> Column:
            check = F.lpad((98 - iban_rest(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            return refilled(value, F.concat(check, digits_of(b)))

        return F.when(valid & (F.length(digits_of(body)) <= 30), let(new_body, written))

    return let(F.regexp_replace(value, " ", ""), changed)


def masked(value: Column, key: str, kind: str) -> Column:
    """Letters and digits replaced by keyed ones of the same class; the pseudonym of what is no number."""

    def changed(digest: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            code = F.conv(F.substring(digest, (i % 60) * 2 + 1, F.lit(3)), 16, 10).cast("int") + i
            digit = (code % 10).cast("string")
            small = F.char((code % F.when(value.rlike(r"\A[0-9a-f]+\z"), 6).otherwise(26)) + 97)
            return (
                F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), small).when(c.rlike("[A-Z]"), F.upper(small)).otherwise(c)
            )

        return F.array_join(F.transform(F.split(value, ""), one), "")

    return let(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value, F.lit(key)), 512), changed)


def email(value: Column, key: str) -> Column:
    """An address whose letters and digits are masked up to the last dot; case does not matter."""
    lower = F.lower(value)
    return F.concat(masked(F.regexp_extract(lower, r"^(.*)\.", 1), key, "email"), F.regexp_extract(lower, r"(\.[^.]*)$", 1))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match of ``ANY``; what fails validation stays as it is."""

    def whole(pattern: str) -> str:
        return r"\A(?:" + pattern + r")\z"

    kinds: list[tuple[Column, Callable]] = [
        (value.rlike(whole(DATE)), date),
        (value.rlike(whole(ADDRESS)), address),
        (value.rlike(whole(SOCIAL)), social),
        (value.rlike(whole(IBAN)), iban),
    ]
    label = F.regexp_extract(value, r"\A(" + LABEL + ")", 1)
    secret = F.substring(value, F.length(label) + 1, F.length(value) - F.length(label))
    out = F.when(value.rlike(whole(SECRET)), F.concat(label, masked(secret, key, "secret"))).when(
        value.rlike(whole(EMAIL)), email(value, key)
    )
    for matches, change in kinds:
        out = out.when(matches, change(value, key))
    numbers = F.coalesce(F.when(value.rlike(whole(CARD)), card(value, key)), F.when(value.rlike(whole(PHONE)), phone(value, key)))
    plain_number = value.rlike(r"\A[+(]?\d[\d ().-]*\z")
    out = out.when(plain_number, numbers)
    return F.coalesce(out, value)


def pseudonymised(text: Column, key: str) -> Column:
    """``text`` with every validated value replaced and all else untouched."""

    def joined(found: Column) -> Column:
        rests = F.split(text, ANY)
        pairs = F.zip_with(rests, found, lambda rest, one: F.concat(rest, F.coalesce(pseudonym(one, key), F.lit(""))))
        return F.array_join(pairs, "")

    found = F.regexp_extract_all(text, F.lit("(" + ANY + ")"), F.lit(1))
    return F.when(
        text.rlike(SIGNS), let(found, lambda f: F.when(F.size(f) > 0, joined(f)).otherwise(text))
    ).otherwise(text)


def configured_key(spark: SparkSession) -> str:
    """The key in ``spark.gazeframe.pseudonym.key``; unset, the open key of the test tables, which hides nothing."""
    return spark.conf.get("spark.gazeframe.pseudonym.key", "open-test-key")


def protect(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the values in ``text`` replaced by pseudonyms, all other columns and rows as they are.

    Cards (Luhn), phones, IPv4 addresses, social security numbers, account numbers (mod 97) and dates are
    validated and permuted within their format; numbers that fail stay. E-mail addresses and assigned secrets
    have no numeric range and get keyed letters and digits of the same shape. NULL and empty texts stay; repeated
    rows change alike; a table without rows gives none. Whoever knows ``key`` can undo the permutations.
    """
    return docs.withColumn(text, pseudonymised(F.col(f"`{text}`"), key))
