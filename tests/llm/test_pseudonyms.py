import datetime as dt
import hashlib
import itertools

import regex

from parley.llm.pseudonyms import ALPHABETS, ANY, DATES, HEX, HEX_UPPER, PATTERNS, ROUNDS, pseudonymize

KEY = "k"


def prf(kind, *parts):
    return int(hashlib.sha256("|".join([KEY, kind, *map(str, parts)]).encode()).hexdigest()[:13], 16)


def text(value, kind, alphabets=ALPHABETS):
    half = len(value) // 2
    left, right = value[:half], value[half:]
    for n in range(1, ROUNDS + 1):
        moved = ""
        for i, c in enumerate(left):
            a = next((a for a in alphabets if c in a), None)
            moved += a[(a.index(c) + prf(kind, n, i, right)) % len(a)] if a else c
        left, right = right, moved
    return left + right


def pair(x, a, y, b, kind):
    for n in range(1, ROUNDS + 1):
        x = (x + prf(kind, n, y)) % a
        y = (y + prf(kind, -n, x)) % b
    return x, y


def luhn(digits):
    return sum((2 * int(d) - (9 if int(d) > 4 else 0)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def mod97(s):
    return int("".join(c if c.isdigit() else str(ord(c) - 55) for c in s)) % 97


def brute_one(m):
    kind = next(k for k, p in PATTERNS.items() if regex.fullmatch(p, m))
    if kind == "email":
        name, _, domain = m.partition("@")
        return text(name, kind) + "@" + domain
    if kind == "key":
        return text(m, kind, HEX if regex.search("[a-f]", m) or not regex.search("[A-F]", m) else HEX_UPPER)
    if kind == "iban":
        if mod97(m[4:] + m[:4]) != 1:
            return m
        bban = text(m[4:], kind)
        return m[:2] + f"{98 - mod97(bban + m[:2] + '00'):02d}" + bban
    if kind == "phone":
        code = regex.match(r"(?:\+\d{1,3}[ .-]?)?", m)[0]
        return code + text(m[len(code):], kind)
    if kind == "ssn":
        a, g, n = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and n):
            return m
        x, y = pair((a - 1 - (a > 666)) * 99 + g - 1, 898 * 99, n - 1, 9999, kind)
        a = x // 99 + 1
        return f"{a + (a >= 666):03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if kind in DATES:
        shape = {"date_iso": "%Y-%m-%d", "date_dot": "%d.%m.%Y", "date_slash": "%m/%d/%Y"}[kind]
        try:
            day = (dt.datetime.strptime(m, shape).date() - dt.date(1800, 1, 1)).days
        except ValueError:
            return m
        if not 0 <= day < 146097:
            return m
        x, y = pair(day % 27, 27, day // 27, 5411, "date")
        return (dt.date(1800, 1, 1) + dt.timedelta(y * 27 + x)).strftime(shape)
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return m
        x, y = pair(o[0] * 256 + o[1], 65536, o[2] * 256 + o[3], 65536, kind)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    digits = regex.sub("[^0-9]", "", m)
    if luhn(digits):
        return m
    body = text(digits[:-1], kind)
    digits = body + str(-luhn(body + "0") % 10)
    sep = regex.search("[ -]", m)
    return sep[0].join(digits[i:i + 4] for i in (0, 4, 8, 12)) if sep else digits


def brute(body):
    found = [m[0] for m in regex.finditer(ANY, body or "")]
    return regex.sub(ANY, lambda m: brute_one(m[0]), body) if body else body, sum(brute_one(m) != m for m in found)


ROWS = ["mail réne.55@mail4.example.com, pay 4845168114407329 or 4845-1681-1440-7329 and 4845168114407328.",
        "+1 (017) 555-7713 on 2024-02-29, 2024-02-30; 31.12.1999 01/02/2003 13/40/2003 ip 129.38.82.176 300.1.1.1 1.2.3.4.5",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 123-45-6789 000-12-3456 GB82WEST12345698765432 GB82WEST12345698765433',
        "7536784127813050 4845168114407329", "A.B+c@x-y.org A@b 9233A8ECF7C5B09FE5949719B6B82BC439E9329B!! 1799-12-31 2199-12-31",
        "4845168114407329", "4845 1681 1440 7329\n(555) 123-4567x 12345678901234567890123", "no data", "", None, "5 apples @ 3", "0 " * 60000]


def test_equals_brute_force_and_keeps_columns(spark):
    rows = [(i, t, i % 3, "x") for i, t in enumerate(ROWS)] + [(None, ROWS[0], 1, "x"), (3, ROWS[3], 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, values int, __pseudonyms string")
    got = pseudonymize(df, KEY)
    assert got.columns == [*df.columns, "n_found"]
    want = [(i, *brute(t)[:1], v, x, brute(t)[1]) for i, t, v, x in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert pseudonymize(df.limit(0), KEY).collect() == []


def test_different_values_stay_different():
    values = [f"{a}.{b}.0.1" for a, b in itertools.product(range(40), range(40))]
    assert len({brute_one(v) for v in values}) == len(values)
    days = [(dt.date(1990, 1, 1) + dt.timedelta(i)).isoformat() for i in range(2000)]
    assert len({brute_one(v) for v in days}) == len(days)


def test_query(spark):
    import __spark_entry__ as E
    global KEY
    from parley.llm.queries import PSEUDONYM_KEY
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    old, KEY = KEY, PSEUDONYM_KEY
    want = [(r.doc_id, *brute(r.text)) for r in docs]
    KEY = old
    got = [tuple(r) for r in E.queries()["op7_pii"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in got) > 30
