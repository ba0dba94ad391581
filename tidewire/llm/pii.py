"""Format-preserving pseudonyms for personal data and secrets, with DataFrame functions only.

Values are found by pattern, validated, and replaced by a keyed Feistel permutation within their own format: digits
become digits, letters letters of their case, card numbers keep a valid check digit, addresses valid octets, dates
valid days. The permutation depends on the key alone, so equal values stay equal across documents and different values
different, and no table of values is kept. Every permutation stays within the values of its kind, so a pseudonym is
found and validated as its value was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private

# The patterns of each kind, tried in this order.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github": r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "jwt": r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])",
    "secret": r"(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)[ ]{0,3}[=:][ ]{0,3}[\"']?)[A-Za-z0-9_+/.-]{8,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?<![vV])(?<!ersion )(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "date_ymd": r"(?<![0-9A-Za-z/])[0-9]{4}/[0-9]{2}/[0-9]{2}(?![0-9/])",
    "date_mdy": r"(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "date_dmy": r"(?<![0-9A-Za-z.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?!\.?[0-9])",
    "date_long": r"(?<![A-Za-z])(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z.-])[2-9][0-9]{2}-[0-9]{4}(?![0-9-]| (?:pages|words|items)\b)",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: Formats of each kind of date.
DATES = {"date": "yyyy-MM-dd", "date_ymd": "yyyy/MM/dd", "date_mdy": "MM/dd/yyyy", "date_dmy": "dd.MM.yyyy", "date_long": "MMMM d, yyyy"}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = tuple(PATTERNS)
ROUNDS = 6
#: Dates are permuted within eras of 365 * 200 days from this day on, of which four count.
ERA_START, ERA_A, ERA_B, ERAS = "1600-01-01", 365, 200, 4
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _byte(hexed: Column, i: Column) -> Column:
    return F.conv(F.substr(hexed, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shifted(char: Column, by: Column) -> Column:
    """The character ``by`` places on in its class, round the end; characters of no class stay."""
    out = char
    for chars in (_DIGITS, _LOWER, _UPPER):
        at = F.instr(F.lit(chars), char)
        out = F.when(at > 0, F.substr(F.lit(chars), F.pmod(at - 1 + by, F.lit(len(chars))) + 1, F.lit(1))).otherwise(out)
    return out


def permuted(value: Column, key: str, tweak: str) -> Column:
    """Feistel permutation of a string within its character classes.

    The string is cut in two; in each round the first half's characters move on in their classes by keyed amounts that
    depend on the other half, and the halves change places. An even number of rounds brings them back in order.
    """
    n = F.length(value)
    first, second = F.substr(value, F.lit(1), (n / 2).cast("int")), F.substr(value, (n / 2).cast("int") + 1, n)

    def turn(state: Column, r: Column) -> Column:
        hexed = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(tweak), r.cast("string"), state["b"]), 256)
        moved = F.array_join(F.transform(F.split(state["a"], ""), lambda c, i: F.when(c == "", c).otherwise(_shifted(c, _byte(hexed, i)))), "")
        return F.struct(state["b"].alias("a"), moved.alias("b"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(first.alias("a"), second.alias("b")), turn)
    return F.concat(done["a"], done["b"])


def _pair(a: Column, b: Column, na: int | Column, nb: int | Column, key: str, tweak: str) -> Column:
    """Feistel permutation of a pair of numbers below (na, nb)."""
    na, nb = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (na, nb))

    def draw(r: Column, x: Column, side: str) -> Column:
        return F.conv(F.substr(F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(tweak + side), r.cast("string"), x.cast("string")), 256), F.lit(1), F.lit(14)), 16, 10).cast("long")

    def turn(s: Column, r: Column) -> Column:
        x = F.pmod(s["a"] + draw(r, s["b"], "a"), na)
        return F.struct(x.alias("a"), s["b"].alias("b"))

    def back(s: Column, r: Column) -> Column:
        x = turn(s, r)
        return F.struct(x["a"].alias("a"), F.pmod(x["b"] + draw(r, x["a"], "b"), nb).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), back)


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Digit sum with every second digit doubled, from the right; ``double_last`` for numbers without their check digit."""

    def add(total: Column, d: Column, i: Column) -> Column:
        two = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(F.pmod(i, F.lit(2)) == (0 if double_last else 1), two).otherwise(d)

    numbered = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(F.coalesce(c.try_cast("int"), F.lit(0)).alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), lambda t, x: add(t, x["d"], x["i"]))


def _refill(shape: Column, digits: Column, places: str = "[0-9]") -> Column:
    """Put ``digits`` in place of the digits of ``shape``, or of other ``places``."""
    step = F.aggregate(
        F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike(places), F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(c.rlike(places), s["at"] + 1).otherwise(s["at"]).alias("at"),
        ),
    )
    return step["out"]


def _email(m: Column, key: str) -> Column:
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    # The host's last label stays; trailing full stops are no part of the pattern.
    top = F.substring_index(host, ".", -1)
    rest = F.substr(host, F.lit(1), F.length(host) - F.length(top))
    return F.concat(permuted(name, key, "email"), F.lit("@"), permuted(rest, key, "host"), top)


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"([A-Za-z0-9_+/.-]{8,})$", 1)
    return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), permuted(value, key, "secret"))


def _jwt(m: Column, key: str) -> Column:
    """Both heads ``eyJ`` stay; what follows each is permuted."""
    part = lambda i, n: permuted(F.substr(F.get(F.split(m, "[.]"), F.lit(i)), F.lit(n + 1), F.length(m)), key, f"jwt{i}")
    return F.concat(F.lit("eyJ"), part(0, 3), F.lit(".eyJ"), part(1, 3), F.lit("."), part(2, 0))


def _ip(m: Column, key: str) -> Column:
    o = [F.get(F.split(m, "[.]"), k).cast("long") for k in range(4)]
    p = _pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    return F.concat_ws(".", *(x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)))


def _day(kind: str, m: Column) -> Column:
    """Days since ERA_START; null for no date."""
    return F.datediff(F.try_to_timestamp(m, F.lit(DATES[kind])).cast("date"), F.lit(ERA_START).cast("date"))


def _date(kind: str, m: Column, key: str) -> Column:
    days = _day(kind, m)
    era = ERA_A * ERA_B
    inside = F.pmod(days, F.lit(era))
    p = _pair(F.floor(inside / ERA_B), inside % ERA_B, ERA_A, ERA_B, key, "date")
    moved = F.date_add(F.lit(ERA_START).cast("date"), ((days - inside) + p["a"] * ERA_B + p["b"]).cast("int"))
    return F.date_format(moved, DATES[kind])


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substr(m, F.lit(s), F.lit(n)).cast("int") for s, n in ((1, 3), (5, 2), (8, 4)))
    p = _pair((area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1))) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
    a = F.floor(p["a"] / 99) + 1
    return F.format_string("%03d-%02d-%04d", F.when(a >= 666, a + 1).otherwise(a), p["a"] % 99 + 1, p["b"] + 1)


def _area(number: Column) -> tuple[Column, Column]:
    """First value and number of the three-digit codes that begin like this one: with 0 or 1, or with 2 to 9."""
    low = number < 200
    return F.when(low, F.lit(0)).otherwise(F.lit(200)), F.when(low, F.lit(200)).otherwise(F.lit(800))


def _phone(m: Column, key: str) -> Column:
    """A leading + and country code stay. Numbers of ten digits, and of seven without a country code, keep what their codes begin with; others are permuted digit by digit."""
    head = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 1)
    tail = F.substr(m, F.length(head) + 1, F.length(m))
    d = F.regexp_replace(tail, "[^0-9]", "")
    area, office, line = F.substr(d, F.lit(1), F.length(d) - 7).try_cast("int"), F.substr(d, F.length(d) - 6, F.lit(3)).cast("int"), F.substr(d, F.length(d) - 3, F.lit(4)).cast("int")
    (a0, na), (b0, nb) = _area(area), _area(office)
    ten = _pair(area - a0, (office - b0) * 10000 + line, na, nb * 10000, key, "phone10")
    seven = _pair(office - b0, line, nb, 10000, key, "phone7")
    new = (
        F.when(F.length(d) == 10, F.format_string("%03d%07d", ten["a"] + a0, ten["b"] + b0 * 10000))
        .when((F.length(d) == 7) & (head == ""), F.format_string("%03d%04d", seven["a"] + b0, seven["b"]))
        .otherwise(permuted(d, key, "phone"))
    )
    return F.concat(head, _refill(tail, new))


def _rest(m: Column) -> Column:
    """Remainder by 97 of a text of digits and capital letters, which count as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(m, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(F.pmod(r * F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(100)) + value(c), F.lit(97))))


def _iban(m: Column, key: str) -> Column:
    """The country stays, the account is permuted, the check digits are those of the new account."""
    plain = F.regexp_replace(m, " ", "")
    land = F.substr(plain, F.lit(1), F.lit(2))
    account = permuted(F.substr(plain, F.lit(5), F.length(plain)), key, "iban")
    new = F.concat(land, F.format_string("%02d", F.lit(98) - _rest(F.concat(account, land, F.lit("00")))), account)
    return _refill(m, new, "[0-9A-Z]")


def _card(m: Column, key: str) -> Column:
    """The first digit stays, the last is the check digit of the others."""
    d = F.regexp_replace(m, "[^0-9]", "")
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    return _refill(m, F.concat(body, F.pmod(-luhn_sum(body, True), F.lit(10)).cast("string")))


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return m.rlike(r"\.[A-Za-z0-9-]*[A-Za-z]$")
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda x: x.cast("int") < 256)
    if kind in DATES:
        shaped = F.date_format(F.try_to_timestamp(m, F.lit(DATES[kind])), DATES[kind]) == m
        return _day(kind, m).between(0, ERA_A * ERA_B * ERAS - 1) & shaped
    if kind == "iban":
        plain = F.regexp_replace(m, " ", "")
        turned = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))
        return F.length(plain).between(15, 34) & (_rest(turned) == 1) & F.substr(plain, F.lit(3), F.lit(2)).between("02", "98")
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(7, 15)
    if kind == "card":
        return F.pmod(luhn_sum(F.regexp_replace(m, "[^0-9]", ""), False), F.lit(10)) == 0
    return F.lit(True)


def kind_of(m: Column) -> Column:
    """The kind of a found value, null where its validation fails."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        whole = m.rlike(f"^(?:{pattern})$")
        out = F.when(whole & F.coalesce(_valid(kind, m), F.lit(False)), F.lit(kind)).otherwise(out)
    return out


def pseudonym(kind: Column, m: Column, key: str) -> Column:
    """The value's replacement; the value itself for a null kind."""
    by = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}
    by |= {k: lambda m, key, k=k: _date(k, m, key) for k in DATES}
    # What a key of a service begins with stays.
    by |= {k: lambda m, key, k=k, n=n: F.concat(F.substr(m, F.lit(1), F.lit(n)), permuted(F.substr(m, F.lit(n + 1), F.length(m)), key, k)) for k, n in (("aws_key", 4), ("github", 4))}
    by["jwt"] = _jwt
    out = m
    for name, f in by.items():
        out = F.when(kind == name, f(m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with personal data in ``text_col`` replaced, and ``pii_found``: the kinds found, in order.

    Kinds: see PATTERNS. A match counts if it is valid: card numbers by check digit, dates by the calendar, addresses by
    octet range, social security numbers by their reserved ranges, phones by their number of digits. account numbers by their remainder. Invalid ones stay
    as they are. ``key`` is any secret string; one key gives one mapping. Null texts stay null and empty ones empty,
    with no finds; texts of any length are read whole; repeated rows get equal results. An existing column
    ``pii_found`` is replaced.
    """
    text, q = F.col(text_col), private(docs.columns)
    # Texts without a digit, @, head of a key or sign of a secret can hold no value and are passed on unsplit.
    suspect = text.rlike("[0-9@]|AKIA|ASIA|gh[pousr]_|eyJ|(?i)(?:password|passwd|pwd|token|secret|key) {0,3}[=:]")
    found = F.when(suspect, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    others = [c for c in docs.columns if c.lower() != "pii_found"]
    staged = (
        docs.select(*others)
        .withColumn(f"{q}_m", F.when(F.size(found) > 0, F.transform(found, lambda m: F.struct(kind_of(m).alias("k"), m.alias("m")))))
        .withColumn(f"{q}_r", F.transform(f"{q}_m", lambda x: pseudonym(x["k"], x["m"], key)))
        .withColumn(f"{q}_t", F.when(F.col(f"{q}_r").isNotNull(), F.array_join(F.zip_with(F.split(text, ANY, -1), f"{q}_r", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text))
        .withColumn("pii_found", F.coalesce(F.filter(F.transform(f"{q}_m", lambda x: x["k"]), lambda k: k.isNotNull()), F.array().cast("array<string>")))
    )
    return staged.select(*[F.col(f"{q}_t").alias(c) if c == text_col else F.col(c) for c in others], "pii_found")
