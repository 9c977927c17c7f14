"""Personal data replaced by format-preserving pseudonyms, in Spark expressions only.

E-mail addresses, telephone and card numbers, US social security numbers, IPv4 addresses and dates are
found and validated (Luhn, number ranges, calendar). Each is permuted by a keyed Feistel network within
its own format, so an equal value has an equal pseudonym in every document, different values stay
different, and the key restores them. What fails validation stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ROUNDS = 6
_EDGE, _STOP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}" + _STOP,
    "card": _EDGE + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _STOP,
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _STOP,
    "date": _EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + _STOP,
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: What a text must hold for any pattern to match.
MAY = r"@|[0-9][0-9 ()./-]{5,}"
#: The country codes of one and of two digits; all others have three.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Days of the 400 years from 1800 on: 189 * 773 = 146,097.
_DAY_SPLIT, _FIRST_DAY = (189, 773), "1800-01-01"


def _let(value: Column, then) -> Column:
    """then(value), the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def _prf(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 512)


def _steps(back: bool) -> Column:
    return F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))])


def _shifted(s: Column, hexes: Column, alphabet: str, back: bool) -> Column:
    """Adds (or takes away) pseudorandom digits to the symbols of s, modulo the alphabet's size."""
    return F.when(F.length(s) == 0, F.lit("")).otherwise(_let(hexes, lambda h: _shifted_by(s, h, alphabet, back)))


def _shifted_by(s: Column, hexes: Column, alphabet: str, back: bool) -> Column:
    base = len(alphabet)

    def one(j: Column) -> Column:
        x = F.instr(F.lit(alphabet), F.substring(s, j + 1, F.lit(1))) - 1
        byte = F.conv(F.substring(hexes, F.pmod(j, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        y = F.pmod(x - byte if back else x + byte, F.lit(base))
        return F.substring(F.lit(alphabet), y + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(s) - 1), one), "")


def permuted_string(s: Column, alphabet: str, key: str, tweak: Column, back: bool = False) -> Column:
    """Feistel network over strings of an alphabet, of any length."""
    return _let(F.struct(s.alias("s"), tweak.alias("t")), lambda x: _permuted_string(x["s"], alphabet, key, x["t"], back))


def _permuted_string(s: Column, alphabet: str, key: str, tweak: Column, back: bool) -> Column:
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        if back:
            return F.struct(_shifted(acc["r"], _prf(key, i, tweak, acc["l"]), alphabet, True).alias("l"), acc["l"].alias("r"))
        return F.struct(acc["r"].alias("l"), _shifted(acc["l"], _prf(key, i, tweak, acc["r"]), alphabet, False).alias("r"))

    return F.aggregate(_steps(back), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def permuted_number(x: Column, p: int, q: int, key: str, tweak: str, back: bool = False) -> Column:
    """Feistel network over 0 .. p*q-1, as pairs modulo p and q."""
    x = x.cast("long")
    start = F.struct(F.floor(x / F.lit(q)).cast("long").alias("a"), F.pmod(x, F.lit(q).cast("long")).alias("b"))

    def turn(acc: Column, i: Column) -> Column:
        def moved(v: Column, other: Column, m: int) -> Column:
            n = F.conv(F.substring(_prf(key, i, F.lit(tweak), other), 1, 12), 16, 10).cast("long")
            return F.pmod(v - n if back else v + n, F.lit(m).cast("long"))

        even = i % 2 == 0
        return F.struct(
            F.when(even, moved(acc["a"], acc["b"], p)).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise(moved(acc["b"], acc["a"], q)).alias("b"),
        )

    return F.aggregate(_steps(back), start, turn, lambda acc: acc["a"] * F.lit(q) + acc["b"])


def _only(s: Column, what: str) -> Column:
    return F.regexp_replace(s, f"[^{what}]", "")


def _refilled(shape: Column, what: str, symbols: Column) -> Column:
    """shape with its characters of class `what` replaced by the symbols in order; capitals stay capitals."""
    return _let(F.struct(shape.alias("shape"), symbols.alias("symbols")), lambda x: _refilled_with(x["shape"], what, x["symbols"]))


def _refilled_with(shape: Column, what: str, symbols: Column) -> Column:

    def one(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        s = F.substring(symbols, F.length(_only(F.substring(shape, F.lit(1), i), what)), F.lit(1))
        return F.when(~c.rlike(f"[{what}]"), c).when(c.rlike("[A-Z]"), F.upper(s)).otherwise(s)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits, from the right, every second one doubled, the first if doubled is 0."""

    def one(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), one), F.lit(0), lambda a, x: a + x)


def _email(m: Column, key: str, back: bool) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

    def filled(letters: Column, digits: Column) -> Column:
        return F.concat(_refilled(_refilled(local, "A-Za-z", letters), "0-9", digits), F.lit("@"), domain)

    def by_letters(letters: Column, digits: Column) -> Column:
        return permuted_string(digits, DIGITS, key, F.concat(F.lit("n"), letters), back)

    def by_digits(letters: Column, digits: Column) -> Column:
        return permuted_string(letters, LETTERS, key, F.concat(F.lit("a"), digits), back)

    def changed(x: Column) -> Column:
        if back:
            return _let(by_letters(x["a"], x["n"]), lambda n: filled(by_digits(x["a"], n), n))
        return _let(by_digits(x["a"], x["n"]), lambda a: filled(a, by_letters(a, x["n"])))

    return _let(F.struct(F.lower(_only(local, "A-Za-z")).alias("a"), _only(local, "0-9").alias("n")), changed)


def _phone(m: Column, key: str, back: bool) -> Column:
    """The country code stays, whatever separators follow it; all other digits are permuted as one string."""

    def changed(digits: Column) -> Column:
        code = F.regexp_extract(digits, COUNTRY, 0)
        rest = F.substring(digits, F.length(code) + 1, F.length(digits))
        return _refilled(m, "0-9", F.concat(code, permuted_string(rest, DIGITS, key, F.lit("phone"), back)))

    return _let(_only(m, "0-9"), changed)


def _card(m: Column, key: str, back: bool) -> Column:
    def changed(digits: Column) -> Column:
        body = permuted_string(F.substring(digits, F.lit(1), F.length(digits) - 1), DIGITS, key, F.lit("card"), back)
        checked = _let(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(b, 0), F.lit(10)).cast("string")))
        return F.when(F.pmod(_luhn_sum(digits, 1), F.lit(10)) == 0, _refilled(m, "0-9", checked))

    return _let(_only(m, "0-9"), changed)


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1).cast("long") * 9999 + serial - 1

    def shown(new: Column) -> Column:
        a = F.floor(new / (99 * 9999)).cast("int")
        parts = F.when(a > 664, a + 2).otherwise(a + 1), F.pmod(F.floor(new / 9999), F.lit(99)).cast("int") + 1, F.pmod(new, F.lit(9999)).cast("int") + 1
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in zip(parts, (3, 2, 4), strict=True)])

    return F.when(valid, _let(permuted_number(index, 898 * 99, 9999, key, "ssn", back), shown))


def _date(m: Column, key: str, back: bool) -> Column:
    """A date written day first, or year first, becomes any date. One that can only be read month first
    becomes another such: its permutation is walked on until the day is above 12 again."""
    first = F.lit(_FIRST_DAY).cast("date")

    def stepped(day: Column, tweak: str) -> Column:
        return permuted_number(day, *_DAY_SPLIT, key, tweak, back)

    def shown(day: Column) -> Column:
        return F.date_format(F.date_add(first, day.cast("int")), "yyyy-MM-dd")

    def moved(iso: Column, tweak: str, walk: bool = False) -> Column:
        def changed(day: Column) -> Column:
            new = stepped(day, tweak)
            if walk:
                # three of five days are above 12, so that so many steps don't suffice once in 10**25 cases
                ends = lambda x: F.dayofmonth(F.date_add(first, x.cast("int"))) > 12
                new = F.aggregate(F.sequence(F.lit(1), F.lit(64)), new, lambda x, _: F.when(ends(x), x).otherwise(stepped(x, tweak)))
            return F.when((day >= 0) & (day < _DAY_SPLIT[0] * _DAY_SPLIT[1]), shown(new))

        return _let(F.datediff(iso.try_cast("date"), first), changed)

    def placed(iso: Column, sep: Column, month_first: bool) -> Column:
        y, mo, d = (F.substring(iso, a, n) for a, n in ((1, 4), (6, 2), (9, 2)))
        parts = (mo, d) if month_first else (d, mo)
        return F.when(iso.isNotNull(), F.concat(parts[0], sep, parts[1], sep, y))

    a, b, y = (F.substring(m, i, n) for i, n in ((1, 2), (4, 2), (7, 4)))
    day_first = _let(moved(F.concat_ws("-", y, b, a), "date"), lambda x: placed(x, F.substring(m, 3, 1), False))
    month_first = _let(moved(F.concat_ws("-", y, a, b), "month first", True), lambda x: placed(x, F.lit("/"), True))
    return (
        F.when(F.substring(m, 5, 1) == "-", moved(m, "date"))
        .when((F.substring(m, 3, 1) == "/") & (b > "12"), month_first)
        .otherwise(day_first)
    )


def _ip(m: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    valid = F.forall(octets, lambda x: x < 256)
    value = F.aggregate(octets, F.expr("0L"), lambda a, x: a * 256 + x)

    def shown(new: Column) -> Column:
        return F.concat_ws(".", *[F.pmod(F.shiftright(new, 8 * i), F.lit(256).cast("long")).cast("string") for i in (3, 2, 1, 0)])

    return F.when(valid, _let(permuted_number(value, 65536, 65536, key, "ip", back), shown))


_MAKERS = {"email": _email, "phone": _phone, "card": _card, "ssn": _ssn, "date": _date, "ip": _ip}


def _hit(kind: str, m: Column):
    return lambda new: F.struct(F.when(new.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(new, m).alias("new"))


def _replaced(m: Column, key: str, back: bool) -> Column:
    """A struct of the kind of a match (null if it isn't valid) and its replacement."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new"))
    for kind in reversed(KINDS):
        hit = _let(_MAKERS[kind](m, key, back), _hit(kind, m))
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), hit).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """All columns of docs, the text's personal data replaced, and an array `pii_kinds` of what was
    replaced, in order (a column of docs with that name is replaced). A null text stays null and an
    empty one empty, with no kinds; rows are independent, so repeated rows get equal results. With
    back=True the same key restores the originals. A date outside 1800 to 2199 and a letter outside ASCII stay."""
    raw = F.col(f"`{text}`")
    matches = F.regexp_extract_all(raw, F.lit(ANY), F.lit(0))
    items = F.when(raw.rlike(MAY), F.transform(matches, lambda m: _replaced(m, key, back)))
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("pii_kinds", "_pii", "_between")])
    found = kept.withColumn("_pii", items)
    between = F.split(raw, ANY, -1)
    some = F.coalesce(F.size("_pii") > 0, F.lit(False))
    pieces = F.transform(F.col("_between"), lambda s, i: F.concat(s, F.coalesce(F.get(F.col("_pii"), i)["new"], F.lit(""))))
    found = found.withColumn("_between", F.when(some, between))
    new = F.when(some, F.array_join(pieces, "")).otherwise(raw)
    kinds = F.coalesce(F.filter(F.transform("_pii", lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    columns = [new.alias(text) if c == text else F.col(f"`{c}`") for c in kept.columns]
    return found.select(*columns, kinds.alias("pii_kinds"))


def counted(done: DataFrame) -> list[Column]:
    """A column n_<kind> for each kind."""

    def number(kind: str) -> Column:
        return F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return [number(kind) for kind in KINDS]
