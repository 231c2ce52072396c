"""Personal data replaced by format-preserving pseudonyms.

Card numbers, account numbers, telephone numbers, social security numbers, dates, IP addresses, e-mail addresses and
hexadecimal secrets are found by pattern and validated. Each value is permuted by a keyed Feistel network within its
own format: digits stay digits, separators stay, check digits are made anew, dates stay dates of the same 400-year
cycle. The permutation depends on the key and the kind only, so equal values get equal pseudonyms in all documents.
Everything is built-in SQL; there is one map over the texts and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of a Feistel network; even, so that both halves are back in place.
ROUNDS = 8
#: Dates of one Gregorian cycle are numbered below 146,097 = 27 * 5,411, the two parts that a date's network works on.
CYCLE_YEARS, CYCLE_DAYS, DATE_SPLIT = 400, 146_097, 5_411

# Patterns of the kinds, as Java regular expressions. Each begins and ends at a boundary and its repeats
# are bounded or possessive, so that matching takes time in proportion to the text.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"
# Telephone numbers: with the area in brackets; of zone 1; international without and with separators (8 to 15 digits in all); national in groups of 3, 3 and 4.
PHONE = "|".join((
    r"(?<![A-Za-z0-9])\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    r"(?<![A-Za-z0-9+])\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    r"(?<![A-Za-z0-9+])\+[1-9][0-9]{7,14}(?![0-9])",
    r"(?<![A-Za-z0-9+])\+[1-9](?:[ .-]?\(?[0-9]\)?){7,14}(?![0-9])",
    r"(?<![A-Za-z0-9+])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![A-Za-z0-9.+-])(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-]?[0-9])",
))
COUNTRY = r"^(?:\+[0-9]{1,3}(?=[ .(-])|\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}))?"
ADDRESS = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-SU-Za-su-z]|[Tt](?![0-9])|-[0-9])|(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z/])"
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "phone": PHONE, "address": ADDRESS, "date": DATE, "social": SOCIAL, "card": CARD}
ANY = "|".join(KINDS.values())
#: Letters outside ASCII that e-mail names may hold are permuted within these classes.
LOWER_LATIN, UPPER_LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", LOWER_LATIN, UPPER_LATIN)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digest(key: str, kind: str, i: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), text), 512)


def _number(digest: Column, k: Column) -> Column:
    """The k-th (modulo 16) 32-bit number of a digest."""
    return F.conv(F.substr(digest, (k % 16 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("bigint")


def _shift(c: Column, k: Column, classes: tuple[str, ...]) -> Column:
    """The character k places on in its class; characters of no class stay."""
    out = F.when(F.lit(False), c)
    for members in classes:
        place = F.position(c, F.lit(members))
        out = out.when(place > 0, F.substr(F.lit(members), ((place - 1 + k) % len(members) + 1).cast("int"), F.lit(1)))
    return out.otherwise(c)


def _feistel(text: Column, key: str, kind: str, classes: tuple[str, ...] = _CLASSES) -> Column:
    """A keyed permutation of the strings with the same length and classes of characters."""

    def step(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        mixed = _let(_digest(key, kind, i, right), lambda d: F.array_join(F.transform(F.regexp_extract_all(left, F.lit("(?s)."), F.lit(0)), lambda c, k: _shift(c, _number(d, k), classes)), ""))
        return F.struct(right.alias("l"), mixed.alias("r"))

    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _numbers(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1: a network over the quotient and the remainder by b."""

    def step(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        low = (left + _number(_digest(key, kind, i, right.cast("string")), F.lit(0))) % a
        high = (right + _number(_digest(key, kind + "'", i, low.cast("string")), F.lit(0))) % b
        return F.struct(low.alias("l"), high.alias("r"))

    start = F.struct(F.floor(value / b).cast("bigint").alias("l"), (value % b).cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * b + s["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(shape: Column, values: Column, members: str) -> Column:
    """``shape`` with its characters of the class ``members`` (a pattern) replaced in order by those of ``values``."""
    return F.array_join(F.transform(F.regexp_extract_all(shape, F.lit("(?s)."), F.lit(0)), lambda c, k: F.when(c.rlike(members), F.substr(values, F.length(F.regexp_replace(F.substr(shape, F.lit(1), (k + 1).cast("int")), f"[^{members[1:-1]}]", "")), F.lit(1))).otherwise(c)), "")


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        new = _feistel(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        return _let(new, lambda p: _refilled(m, F.concat(p, F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string")), lambda x: F.call_function("luhn_check", F.concat(p, x))), 1)), "[0-9]"))

    return _let(_digits(m), lambda d: F.when(F.call_function("luhn_check", d), made(d)).otherwise(m))


def _remainder97(text: Column) -> Column:
    """The remainder by 97 of an account number with letters as 10 to 35."""
    place = lambda c: F.position(c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1
    return F.aggregate(F.regexp_extract_all(text, F.lit("."), F.lit(0)), F.lit(0), lambda r, c: F.when(place(c) < 10, (r * 10 + place(c)) % 97).otherwise((r * 100 + place(c)) % 97))


def _iban(m: Column, key: str) -> Column:
    def made(v: Column) -> Column:
        country = F.substr(v, F.lit(1), F.lit(2))
        body = _feistel(F.substr(v, F.lit(5)), key, "iban")
        return _let(body, lambda b: _refilled(m, F.concat(country, F.lpad((98 - _remainder97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b), "[A-Z0-9]"))

    return _let(F.replace(m, F.lit(" "), F.lit("")), lambda v: F.when(_remainder97(F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4)))) == 1, made(v)).otherwise(m))


def _phone(m: Column, key: str) -> Column:
    """All digits but a country code after + are permuted. The code ends at a separator, or else where the numbering plan says."""
    code = F.regexp_extract(m, COUNTRY, 0)
    rest = F.substr(m, F.length(code) + 1)
    return _let(rest, lambda r: F.concat(code, _refilled(r, _feistel(_digits(r), key, "phone"), "[0-9]")))


def _address(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s * 256 + x)
    back = lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    return F.when(F.forall(parts, lambda x: x <= 255), _let(_numbers(value, 65536, 65536, key, "address"), back)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    # A date with slashes that can be read both ways has its day first.
    day_first = F.try_to_date(F.when(~iso, m), "dd/MM/yyyy")
    day = F.coalesce(F.try_to_date(F.when(iso, m), "yyyy-MM-dd"), day_first, F.try_to_date(F.when(~iso, m), "MM/dd/yyyy"))

    def made(d: Column) -> Column:
        epoch = F.lit("2000-01-01").cast("date")
        n = F.datediff(d, epoch).cast("bigint")
        cycle = F.floor(n / CYCLE_DAYS).cast("bigint")
        new = _numbers(n - cycle * CYCLE_DAYS, CYCLE_DAYS // DATE_SPLIT, DATE_SPLIT, key, "date") + cycle * CYCLE_DAYS
        date = _let(new, lambda x: F.date_add(epoch, x.cast("int")))
        return F.when(iso, F.date_format(date, "yyyy-MM-dd")).when(day_first.isNotNull(), F.date_format(date, "dd/MM/yyyy")).otherwise(F.date_format(date, "MM/dd/yyyy"))

    return _let(day, lambda d: F.when(d.isNotNull() & (F.year(d) >= 1000), made(d)).otherwise(m))


def _social(m: Column, key: str) -> Column:
    valid = ~m.rlike("^(000|666|9)|-00-|-0000$")
    return F.when(valid, _refilled(m, _feistel(_digits(m), key, "social"), "[0-9]")).otherwise(m)


def _email(m: Column, key: str) -> Column:
    """Letters and digits of the name are permuted within their classes; the domain stays, so that mail domains can still be counted."""
    name = F.substring_index(m, "@", 1)
    return _let(name, lambda n: F.concat(_feistel(n, key, "email"), F.substr(m, F.length(n) + 1)))


def _secret(m: Column, key: str) -> Column:
    new = _feistel(F.lower(m), key, "secret", ("0123456789abcdef",))
    return F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new)


_MADE = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "address": _address, "date": _date, "social": _social, "card": _card}


def kind_of(m: Column) -> Column:
    """The kind of a match, in the order of KINDS."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, pattern in KINDS.items():
        out = out.when(m.rlike(f"^(?:{pattern})$"), F.lit(kind))
    return out


def _replaced(m: Column, key: str) -> Column:
    out = F.when(F.lit(False), m)
    for kind, pattern in KINDS.items():
        out = out.when(m.rlike(f"^(?:{pattern})$"), _MADE[kind](m, key))
    return out.otherwise(m)


def pseudonymise(documents: DataFrame, *, key: str, text_col: str = "text", report: bool = False) -> DataFrame:
    """``documents`` with every validated value in ``text_col`` replaced by its pseudonym; with ``report``, columns n_found (long) and kinds too.

    Null stays null; empty texts and texts without a value stay as they are. Values that fail validation (a card number
    with a wrong check digit, an impossible date, an octet over 255) stay. Repeated values and rows get equal
    pseudonyms. All other columns stay, whatever their names. An empty table gives no rows.
    """
    text = F.col(f"`{text_col}`")
    # Only texts with a digit or @ can match; the others skip the search.
    may = text.rlike("[0-9@]")
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    between = F.split(text, ANY, -1)
    rebuilt = lambda values: F.array_join(F.zip_with(between, values, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    new = F.when(may, F.when(F.size(found) > 0, rebuilt(F.transform(found, lambda m: _replaced(m, key)))).otherwise(text)).otherwise(text)
    out = documents.withColumn("n_found", F.when(may, F.size(found)).otherwise(0).cast("long")).withColumn("kinds", F.when(may, F.array_sort(F.array_distinct(F.transform(found, kind_of)))).otherwise(F.array().cast("array<string>"))) if report else documents
    return out.withColumn(text_col, new)


#: The query's key; a real run passes its own secret.
QUERY_KEY = "query"


def op8_pii(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(documents, key=QUERY_KEY, report=True)
