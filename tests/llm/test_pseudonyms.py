"""Pseudonyms against a Feistel network in plain Python."""

import datetime
import hashlib
import random

from pyspark.sql import functions as F

from accordant.llm import pii

KEY = "a key"


def network(left, right, a, b, kind, back=False):
    for turn in range(7, -1, -1) if back else range(8):
        value = left if turn % 2 else right
        keyed = int(hashlib.sha256(f"{KEY}|{kind}|{turn}|{value}{KEY}".encode()).hexdigest()[:15], 16)
        keyed = -keyed if back else keyed
        if turn % 2 == 0:
            left = (left + keyed) % a
        else:
            right = (right + keyed) % b
    return left, right


def digits(text):
    return [int(c) for c in text if c.isdigit()]


def put(form, new):
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in form)


def any_day(day):
    n = (day - datetime.date(1900, 1, 1)).days
    a, b = network(n // 292, n % 292, 250, 292, "date")
    return datetime.date(1900, 1, 1) + datetime.timedelta(days=a * 292 + b)


LONG = [1, 3, 5, 7, 8, 10, 12]


def late_day(day):
    y, m, d = day.year - 1900, day.month, day.day
    if d <= 28:
        a, b = network(y * 12 + m - 1, d - 13, 2400, 16, "late-date")
        return datetime.date(1900 + a // 12, a % 12 + 1, b + 13)
    if (m, d) == (2, 29):
        k = (day.year - 1904) // 4
        a, b = network(k // 7, k % 7, 7, 7, "late-date")
        return datetime.date(1904 + 4 * (7 * a + b), 2, 29)
    if d == 31:
        a, b = network(y, LONG.index(m), 200, 7, "late-date")
        return datetime.date(1900 + a, LONG[b], 31)
    rest = [1, *range(3, 13)]
    a, b = network(y, rest.index(m), 200, 11, "late-date")
    return datetime.date(1900 + a, rest[b], d)


def parsed(text, form):
    try:
        return datetime.datetime.strptime(text, form).date()
    except ValueError:
        return None


def want_date(text, month_first="/"):
    if text[4] == "-":
        day = parsed(text, "%Y-%m-%d")
        return any_day(day).strftime("%Y-%m-%d") if day else text
    s = text[2]
    forms = [f"%d{s}%m{s}%Y", f"%m{s}%d{s}%Y"]
    if s in month_first:
        forms.reverse()
    usual = parsed(text, forms[0])
    if usual:
        return any_day(usual).strftime(forms[0])
    other = parsed(text, forms[1]) if s != "." else None
    return late_day(other).strftime(forms[1]) if other else text


def run(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return {r.doc_id: r.text for r in pii.pseudonymise(df, key=KEY, **options).collect()}


def test_dates_in_every_order(spark):
    rng = random.Random(1)
    dates = ["25/12/2024", "12/25/2024", "05/04/2024", "25-12-2024", "12-25-2024", "05-04-2024", "25.12.2024", "12.25.2024", "29/02/2000", "29/02/1900", "31/01/1999",
             "30/04/1950", "31/04/1950", "13/13/2000", "00/10/2000", "2024-02-29", "2023-02-29", "02/29/2004", "02-29-2004"]
    dates += [rng.choice([f"{a:02}/{b:02}/{y}", f"{a:02}-{b:02}-{y}", f"{a:02}.{b:02}.{y}", f"{y}-{a:02}-{b:02}"])
              for a, b, y in ((rng.randint(1, 31), rng.randint(1, 31), rng.randint(1900, 2098)) for _ in range(150))]
    for month_first in ("/", "", "/-"):
        got = run(spark, [f"on {d}, then" for d in dates], month_first=month_first)
        assert got == {i: f"on {want_date(d, month_first)}, then" for i, d in enumerate(dates)}
        assert run(spark, [got[i] for i in range(len(dates))], back=True, month_first=month_first) == {i: f"on {d}, then" for i, d in enumerate(dates)}


def test_late_dates_are_permuted():
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(days=n) for n in range(73_049)]
    late = [d for d in days if d.day > 12]
    assert len({late_day(d) for d in late}) == len(late) and all(late_day(d).day > 12 for d in late)


def test_other_kinds_against_the_network(spark):
    def ip(text):
        o = list(map(int, text.split(".")))
        a, b = network(o[0] * 256 + o[2], o[1] * 256 + o[3], 65_536, 65_536, "ip")
        return ".".join(map(str, (a // 256, b // 256, a % 256, b % 256)))

    def ssn(text):
        area, group, serial = map(int, text.split("-"))
        a, b = network(((area - 1 if area > 666 else area) - 1) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        area = a // 99 + 1
        return f"{area + (area >= 666):03}-{a % 99 + 1:02}-{b + 1:04}"

    def luhn(body):
        twice = [2 * x - 9 * (x > 4) if i % 2 == 0 else x for i, x in enumerate(reversed(body))]
        return -sum(twice) % 10

    def card(text):
        d = "".join(map(str, digits(text)))
        n = len(d) - 2
        half = n // 2
        a, b = network(int(d[1 : 1 + n - half]), int(d[1 + n - half : -1]), 10 ** (n - half), 10**half, "card")
        body = d[0] + str(a).zfill(n - half) + str(b).zfill(half)
        return put(text, body + str(luhn(list(map(int, body)))))

    cards = ["4111 1111 1111 1111", "378282246310005", "5500005555555559"]
    texts = {"10.0.0.1": ip("10.0.0.1"), "192.168.255.7": ip("192.168.255.7"), "123-45-6789": ssn("123-45-6789"), "772-01-0001": ssn("772-01-0001")} | {c: card(c) for c in cards}
    got = run(spark, [f"x {t} y" for t in texts])
    assert [got[i] for i in range(len(texts))] == [f"x {w} y" for w in texts.values()]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([("mail a.b@example.org", "m", "k", "n", "g", "s", 1)] * 2, "text string, __m string, __k string, __new string, __gaps string, __spans string, pii int")
    got = pii.pseudonymise(df, key=KEY).collect()
    assert len(got) == 2 and got[0] == got[1] and (got[0]["__m"], got[0]["__k"], got[0]["__new"], got[0]["__gaps"], got[0]["__spans"]) == ("m", "k", "n", "g", "s")
    assert got[0].text != "mail a.b@example.org" and [s.kind for s in got[0].pii] == ["email"]
