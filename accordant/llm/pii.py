"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Numbers that pass their format's own check (card numbers by Luhn, telephone and social security
numbers by their ranges, IPv4 addresses, calendar dates) and the names of e-mail addresses are
replaced by a keyed permutation within the format: a Feistel network whose halves are residues
a and b with a * b exactly the number of valid values, so every pseudonym is valid, no two
values share one, and the key's owner can turn it back.  Equal values get equal pseudonyms in every
document, whatever separators they are written with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
KINDS = ("email", "phone", "card", "ssn", "date", "ip")
#: Telephone numbers: three, three and four digits; with a country code after + or 00; behind a trunk 0; nine digits in Spain.
NORTH_AMERICAN = r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
INTERNATIONAL = r"(?:\+|00(?=\d+[ ./-]))[1-9](?:[ ./-]?(?:\(\d{1,5}\)|\d)){4,14}"
TRUNK = (r"(?!\d{3}-\d\d-\d{4}(?!\d))(?!\d\d-\d\d-(?:19|20)\d\d(?!\d))(?!\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})"
         r"(?:0[1-9](?:[ .-]\d\d){4}|(?:\(0[1-9]\d{0,3}\) ?|0[1-9]\d{0,3}[ /-])\d{2,8}(?:[ -]\d{2,8}){0,3})(?![ /.-]?\d)")
SPANISH = r"(?<!\d[ .,])(?:[6-9]\d\d \d{3} \d{3}|[6-9]\d\d \d\d \d\d \d\d|[89]\d \d{3} \d\d \d\d)(?![ .,]?\d)"
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: How each kind is written.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.)+[A-Za-z]{2,}",
    "phone": rf"(?<![\w+])(?:{NORTH_AMERICAN}|{INTERNATIONAL}|{TRUNK}|{SPANISH})(?![\w-])",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "ssn": r"(?<![\w.-])\d{3}-\d\d-\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d([./-])\d\d\1(?:19|20)\d\d)(?=T\d|[^\w/-]|$)",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w.]*\w)",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
#: Dates from 1900-01-01 on, as many as the network has places.
FIRST_DAY, DAYS = "1900-01-01", (250, 292)


def _keyed(key: str, kind: str, turn: Column, value: Column) -> Column:
    """A keyed number below 2 ** 60."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(F.concat(text, F.lit(key)), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, back: bool = False) -> Column:
    """The permuted (left, right) with left < a and right < b; ``back`` undoes it."""
    turns = F.sequence(F.lit(ROUNDS - 1 if back else 0), F.lit(0 if back else ROUNDS - 1))
    sign = -1 if back else 1

    def step(s: Column, t: Column) -> Column:
        on_left = t % 2 == 0
        moved_left = F.pmod(s["l"] + sign * (_keyed(key, kind, t, s["r"]) % a), a)
        moved_right = F.pmod(s["r"] + sign * (_keyed(key, kind, t, s["l"]) % b), b)
        return F.struct(F.when(on_left, moved_left).otherwise(s["l"]).alias("l"), F.when(on_left, s["r"]).otherwise(moved_right).alias("r"))

    return F.aggregate(turns, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _part(d: Column, start, length) -> Column:
    return F.substring(d, F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length).cast("long")


def _padded(value: Column, length: int | Column) -> Column:
    return F.lpad(value.cast("string"), length, F.lit("0") if isinstance(length, Column) else "0")


def _luhn(d: Column) -> Column:
    """The sum of Luhn's check over a digit string, its last digit counted once."""
    return F.aggregate(F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda s, x: s + x)


def _written(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced by the given ones, separators kept."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    step = lambda acc, c: F.when(c.rlike(r"\d"), F.struct(F.concat(acc["s"], F.substring(digits, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(
        F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i")))
    return F.aggregate(F.split(m, ""), start, step)["s"]


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _card(m: Column, key: str, back: bool) -> Column:
    d = _digits(m)
    n = F.length(d) - 2  # without the first digit and the check digit
    half = F.floor(n / 2).cast("int")
    p = feistel(_part(d, 2, n - half), _part(d, F.lit(2) + n - half, half), _power(n - half), _power(half), key, "card", back)
    body = F.concat(F.substring(d, 1, 1), _padded(p["l"], n - half), _padded(p["r"], half))
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    return _written(m, F.concat(body, check.cast("string")))


def _phone(m: Column, key: str, back: bool) -> Column:
    """Country codes, the first two digits of other national numbers, lengths and separators stay.

    A number of the North American plan is permuted among those whose area and exchange codes lie on the same side
    of 200, any other one among all of its length.
    """
    abroad = m.rlike(r"^(?:\+|00)")
    d = F.regexp_replace(_digits(m), F.when(m.startswith("00"), F.lit("^00")).otherwise(F.lit("^$")), F.lit(""))
    length = F.when(abroad, F.length(F.regexp_extract(d, COUNTRY, 0))).otherwise(F.lit(2))
    american = m.rlike(f"^(?:{NORTH_AMERICAN})$") | (abroad & d.startswith("1") & (F.length(d) == 11))
    t = F.substring(d, F.length(d) - 9, F.lit(10))
    area, exchange = _part(t, 1, 3), _part(t, 4, 3)
    low = lambda code: F.when(code < 200, F.lit(0)).otherwise(F.lit(200))
    many = lambda code: F.when(code < 200, F.lit(20_000)).otherwise(F.lit(80_000))
    p = feistel((area - low(area)) * 100 + _part(t, 9, 2), (exchange - low(exchange)) * 100 + _part(t, 7, 2), many(area), many(exchange), key, "phone", back)
    made = F.concat(F.substring(d, F.lit(1), F.length(d) - 10), _padded(F.floor(p["l"] / 100) + low(area), 3), _padded(F.floor(p["r"] / 100) + low(exchange), 3),
                    _padded(p["r"] % 100, 2), _padded(p["l"] % 100, 2))
    n = F.length(d) - length
    half = F.floor(n / 2).cast("int")
    q = feistel(_part(d, length + 1, n - half), _part(d, length + 1 + n - half, half), _power(n - half), _power(half), key, "phone", back)
    other = F.concat(F.substring(d, F.lit(1), length), _padded(q["l"], n - half), _padded(q["r"], half))
    return _written(m, F.concat(F.when(m.startswith("00"), F.lit("00")).otherwise(F.lit("")), F.when(american, made).otherwise(other)))


def _ssn(m: Column, key: str, back: bool) -> Column:
    d = _digits(m)
    area = _part(d, 1, 3)
    left = (F.when(area > 666, area - 1).otherwise(area) - 1) * 99 + _part(d, 4, 2) - 1
    p = feistel(left, _part(d, 6, 4) - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", back)
    a = F.floor(p["l"] / 99) + 1
    return _written(m, F.concat(_padded(F.when(a >= 666, a + 1).otherwise(a), 3), _padded(p["l"] % 99 + 1, 2), _padded(p["r"] + 1, 4)))


#: Separators after which a date that can be read both ways has its month first.
MONTH_FIRST = "/"


def _read(m: Column, month_first: str) -> tuple[Column, Column, Column]:
    """(date, late, month leads) of a match; the date is null if there is none.

    Year first, or else in the usual order of its separator.  A date that is none in that order is read in the other
    one; its day is then past the twelfth (``late``).  With dots the day is always first.
    """
    sep, by_year = F.substring(m, 3, 1), m.rlike("^[0-9]{4}")
    leads = (F.instr(F.lit(month_first), sep) > 0) & (sep != ".")
    part = lambda start, length: F.substring(m, start, length)
    first = F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)).try_cast("date")  # the day first
    second = F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)).try_cast("date")
    usual, other = F.when(leads, second).otherwise(first), F.when(leads, first).when(sep != ".", second)
    late = ~by_year & usual.isNull() & other.isNotNull()
    return F.when(by_year, m.try_cast("date")).otherwise(F.coalesce(usual, other)), late, F.when(late, ~leads).otherwise(leads)


def _days(day: Column) -> Column:
    return F.datediff(day, F.lit(FIRST_DAY).cast("date"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _later(day: Column, key: str, back: bool) -> Column:
    """A permutation of the dates past the twelfth of their month, 1900 to 2099.

    Days up to the 28th change freely; a 29th, 30th or 31st stays one, as other months and years have it too.
    """
    long = F.array(*[F.lit(x) for x in (1, 3, 5, 7, 8, 10, 12)])

    def pick(x: Column, free: Column, feb: Column, whole: Column, rest: Column) -> Column:
        return F.when(x["d"] <= 28, free).when((x["d"] == 29) & (x["mo"] == 2), feb).when(x["d"] == 31, whole).otherwise(rest)

    def permuted(x: Column) -> Column:
        y, mo, d = x["y"], x["mo"], x["d"]
        leaps = F.floor((y - 4) / 4)
        left = pick(x, y * 12 + mo - 1, F.floor(leaps / 7), y, y)
        right = pick(x, d - 13, leaps % 7, F.array_position(long, mo) - 1, F.when(mo == 1, F.lit(0)).otherwise(mo - 2))
        a, b = pick(x, F.lit(2400), F.lit(7), F.lit(200), F.lit(200)), pick(x, F.lit(16), F.lit(7), F.lit(7), F.lit(11))
        sides = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"), a.cast("long").alias("a"), b.cast("long").alias("b"))
        return _let(_let(sides, lambda s: feistel(s["left"], s["right"], s["a"], s["b"], key, "late-date", back)), lambda p: made(x, p["l"], p["r"]))

    def made(x: Column, left: Column, right: Column) -> Column:
        year = pick(x, F.floor(left / 12), (left * 7 + right) * 4 + 4, left, left) + 1900
        month = pick(x, left % 12 + 1, F.lit(2), F.get(long, right.cast("int")), F.when(right == 0, F.lit(1)).otherwise(right + 2))
        return F.make_date(year.cast("int"), month.cast("int"), F.when(x["d"] <= 28, right + 13).otherwise(x["d"]).cast("int"))

    return _let(F.struct((F.year(day) - 1900).alias("y"), F.month(day).alias("mo"), F.dayofmonth(day).alias("d")), permuted)


def _date(m: Column, key: str, back: bool, month_first: str) -> Column:
    def anywhere(day: Column) -> Column:
        p = _let(_days(day), lambda n: feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date", back))
        return _let(p, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int")))

    def written(x: Column) -> Column:
        new = F.when(x["late"], _later(x["day"], key, back)).otherwise(anywhere(x["day"]))
        return _let(new, lambda day: F.when(m.rlike("^[0-9]{4}"), F.date_format(day, "yyyyMMdd")).when(x["leads"], F.date_format(day, "MMddyyyy")).otherwise(F.date_format(day, "ddMMyyyy")))

    day, late, leads = _read(m, month_first)
    return _written(m, _let(F.struct(day.alias("day"), late.alias("late"), leads.alias("leads")), written))


def _ip(m: Column, key: str, back: bool) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    p = feistel(o[0] * 256 + o[2], o[1] * 256 + o[3], F.lit(65_536), F.lit(65_536), key, "ip", back)
    return F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["l"] / 256), F.floor(p["r"] / 256), p["l"] % 256, p["r"] % 256)])


_SIGNS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _email(m: Column, key: str, back: bool) -> Column:
    """Letters and digits of the name stay letters and digits; case, dots and the domain stay.

    Twelve signs at a time, alternately dealt to the two halves.
    """
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    signs = F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), "")
    signs = F.filter(signs, lambda c: c != "")

    def permuted(part: Column) -> Column:
        radix = lambda c: F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(26))
        value = lambda c: F.instr(F.lit(_SIGNS), c) - F.when(c.rlike("[0-9]"), F.lit(1)).otherwise(F.lit(11))
        side = lambda k: F.filter(part, lambda c, i: i % 2 == k)
        size = lambda cs: F.aggregate(cs, F.lit(1).cast("long"), lambda s, c: s * radix(c))
        number = lambda cs: F.aggregate(cs, F.lit(0).cast("long"), lambda s, c: s * radix(c) + value(c))
        p = feistel(number(side(0)), number(side(1)), size(side(0)), size(side(1)), key, "email", back)

        def spelled(n: Column, cs: Column) -> Column:
            start = F.struct(n.alias("n"), F.array().cast("array<string>").alias("out"))
            step = lambda acc, c: F.struct(F.floor(acc["n"] / radix(c)).alias("n"), F.concat(F.array(F.substring(
                F.lit(_SIGNS), (acc["n"] % radix(c) + F.when(radix(c) == 10, F.lit(1)).otherwise(F.lit(11))).cast("int"), F.lit(1))), acc["out"]).alias("out"))
            return F.aggregate(F.reverse(cs), start, step)["out"]

        zipped = F.zip_with(spelled(p["l"], side(0)), spelled(p["r"], side(1)), lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
        return F.array_join(zipped, "")

    starts = F.sequence(F.lit(0), F.floor((F.size(signs) - 1) / 12).cast("int"))
    new = F.when(F.size(signs) > 0, F.array_join(F.transform(starts, lambda k: permuted(F.slice(signs, k * 12 + 1, 12))), "")).otherwise(F.lit(""))
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def put(acc: Column, c: Column) -> Column:
        sign = F.substring(new, acc["i"], F.lit(1))
        sign = F.when(c.rlike("[A-Z]"), F.upper(sign)).otherwise(sign)
        return F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(acc["s"], sign).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i")))

    return F.concat(F.aggregate(F.split(name, ""), start, put)["s"], F.lit("@"), domain)


def kind_of(m: Column, month_first: str = MONTH_FIRST) -> Column:
    """The kind of a match that passes its format's check, else null."""
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    d = _digits(m)
    octets = F.transform(F.split(m, r"\."), lambda x: x.try_cast("int"))
    day, late, _ = _read(m, month_first)
    checked = {
        "email": F.lit(True), "phone": F.length(F.regexp_replace(d, "^00", "")).between(7, 15), "card": _luhn(d) % 10 == 0,
        "ssn": ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 1, 1) != "9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000"),
        "date": _let(F.struct(day.alias("day"), late.alias("late")), lambda x: x["day"].isNotNull() & (x["late"] | _days(x["day"]).between(0, DAYS[0] * DAYS[1] - 1))), "ip": F.forall(octets, lambda x: x <= 255),
    }
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(whole[k], F.when(checked[k], F.lit(k))).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str, back: bool = False, month_first: str = MONTH_FIRST) -> Column:
    """The pseudonym of a match of a known kind."""
    makers = {"email": _email, "phone": _phone, "card": _card, "ssn": _ssn, "date": lambda *a: _date(*a, month_first), "ip": _ip}
    out = m
    for k, make in makers.items():
        out = F.when(kind == k, make(m, key, back)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text", back: bool = False, month_first: str = MONTH_FIRST) -> DataFrame:
    """All rows and columns, ``text_col`` with its personal data replaced, and ``pii``: an array of
    (kind, start, end) in code points of the new text, end exclusive.

    Dates such as 05/04/2024 that can be read both ways have their month first after the separators in ``month_first``
    and their day first after others; 25/12/2024 is read the only way it can be.  Null texts stay null with an
    empty array; repeated rows are each replaced, and alike; texts of any length are replaced whole.  ``back`` turns
    pseudonyms made with the same key into what they stand for.  A column named ``pii`` is replaced, any other name
    may be used.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    text = F.col("__text")
    # Texts without a digit or an at sign, the only things all kinds need, are not searched.
    hit = text.rlike("[0-9@]")
    found = F.when(hit, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = whole.withColumn("__m", found)
    rows = rows.withColumn("__gaps", F.when(F.size("__m") > 0, F.split(text, ANY, -1)))
    known = F.transform("__m", lambda m: F.struct(m.alias("m"), kind_of(m, month_first).alias("k")))
    rows = rows.withColumn("__k", known).withColumn("__new", F.transform("__k", lambda x: F.when(x["k"].isNotNull(), pseudonym(x["m"], x["k"], key, back, month_first)).otherwise(x["m"])))
    joined = F.array_join(F.zip_with("__gaps", "__new", lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    lengths = F.zip_with("__gaps", "__new", lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(F.coalesce(m, F.lit(""))).alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    places = F.aggregate(lengths, start, lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(acc["out"], F.array(
        F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["m"]).alias("end")))).alias("out")))["out"]
    spans = F.filter(F.zip_with("__k", places, lambda k, p: F.struct(k["k"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"))), lambda s: s["kind"].isNotNull())
    spans = F.coalesce(spans, F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    new = F.when(F.size("__m") > 0, joined).otherwise(text)
    rest = [c for c in docs.columns if c != "pii"]
    return rows.select(*[(new if c == text_col else F.col("__row")[c]).alias(c) for c in rest], spans.alias("pii"))
