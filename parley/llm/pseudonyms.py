"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Card numbers (Luhn), IBANs (mod 97), US social security numbers (issued ranges),
IPv4 addresses (octets up to 255) and dates (of the calendar, 1800 to 2199) are
validated; phone numbers, e-mail names and hexadecimal keys go by their shape.
Of dates with ``/`` or ``-`` and the year last the month stands first, unless
only the day can.  Written IBANs, cards and phone numbers keep their separators.
Each value is permuted within its own format by a keyed Feistel network, so it
stays valid, equal values get equal pseudonyms in every document, and different
ones different pseudonyms.  What does not validate stays as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
# The characters that a character may turn into, by class.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
HEX = ["0123456789abcdef"]
HEX_UPPER = ["0123456789ABCDEF"]

# Fixed value: letters and digits of an IBAN behind its check digits, by country (ISO 13616).
IBAN_LENGTHS = {11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK",
                17: "CH HR LI LV", 18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL",
                20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "LY PT ST", 22: "IS TR", 23: "BI DJ FR GR IT MC MR SM",
                24: "AL AZ BY CY DO GT HN HU LB NI PL SV", 25: "BR EG PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU"}
# Fixed value: country calling codes, of which none begins another (ITU E.164), by length.
CALLING = ["[17]", "(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
           "(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[03578]|9[679])[0-9]"]
_DATED = (r"(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
          r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{1,2}:[0-9]{2})(?![0-9])")
# a digit of a phone number and what may part it from the one before: no lone digit, no date or address follows a separator
_NEXT = rf"(?:[ .-](?=[0-9]{{2}})(?!{_DATED}))?[0-9]"


def _spaced_iban(sep: str) -> str:
    by_length = []
    for n, countries in IBAN_LENGTHS.items():
        rest = f"{sep}[A-Z0-9]{{{n % 4}}}" if n % 4 else ""
        by_length.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:{sep}[A-Z0-9]{{4}}){{{n // 4}}}{rest}")
    return "|".join(by_length)


#: Shapes, in the order in which they are tried at a position.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "key": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![\p{L}\p{N}])",
    "iban_spaced": rf"(?<![\p{{L}}\p{{N}}])(?:{_spaced_iban(' ')}|{_spaced_iban('-')})(?![\p{{L}}\p{{N}}])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "phone_world": rf"(?<![\p{{L}}\p{{N}}+])\+(?:{CALLING[0]}[ .-]?[0-9](?:{_NEXT}){{9}}|{CALLING[1]}[ .-]?[0-9](?:{_NEXT}){{6,12}}"
                   rf"|{CALLING[2]}[ .-]?[0-9](?:{_NEXT}){{5,11}}"
                   rf"|(?:{'|'.join(CALLING)})[ .-]?\([0-9]{{1,5}}\)[ .-]?[0-9](?:{_NEXT}){{4,11}})(?![0-9])",
    "phone_plain": r"(?<![0-9+])(?<![0-9][.-])(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date_iso": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "date_dot": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])",
    "date_slash": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "date_dash": r"(?<![0-9-])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date_year": r"(?<![0-9/])[0-9]{4}/[0-9]{2}/[0-9]{2}(?![0-9/])",
    "date_short": r"(?<![0-9/-])(?<![0-9]\.)(?:[0-9]{1,2}(?:/[0-9]{1,2}/|-[0-9]{1,2}-|\.[0-9]{1,2}\.)[0-9]{4}"
                  r"|[0-9]{4}(?:/[0-9]{1,2}/|-[0-9]{1,2}-)[0-9]{1,2})(?![0-9/-]|\.[0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card_long": r"(?<![0-9])[0-9]{4}(?:-[0-9]{6}-| [0-9]{6} )[0-9]{4,5}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3})(?![0-9])",
}
DATES = {"date_iso": "yyyy-MM-dd", "date_dot": "dd.MM.yyyy", "date_slash": "MM/dd/yyyy", "date_dash": "MM-dd-yyyy",
         "date_year": "yyyy/MM/dd"}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _prf(key: str, kind: str, *parts: Column) -> Column:
    """52 keyed pseudo-random bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def permute_text(value: Column, key: str, kind: str, alphabets: list[str] = ALPHABETS) -> Column:
    """Permute the strings of one shape: each character stays in its alphabet, others stay put.

    A round shifts every character of one half by a keyed function of the other
    half; after an even number of rounds the halves are back in order.
    """
    half = F.floor(F.length(value) / 2).cast("int")

    def shift(c: Column, i: Column, other: Column, turn: Column) -> Column:
        add = _prf(key, kind, turn, i, other)
        out = c
        for a in alphabets:
            at = F.instr(F.lit(a), c)
            moved = F.substring(F.lit(a), (F.pmod(at - 1 + add, F.lit(len(a))) + 1).cast("int"), F.lit(1))
            out = F.when((at > 0) & (F.length(c) > 0), moved).otherwise(out)
        return out

    def turn(state: Column, n: Column) -> Column:
        left, right = state["l"], state["r"]
        moved = F.array_join(F.transform(F.split(left, ""), lambda c, i: shift(c, i, right, n)), "")
        return F.struct(right.alias("l"), moved.alias("r"))

    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def permute_pair(x: Column, a: int, y: Column, b: int, key: str, kind: str) -> Column:
    """Permute the pairs (x below a, y below b); returns a struct of the new x and y."""

    def turn(state: Column, n: Column) -> Column:
        left = F.pmod(state["x"] + _prf(key, kind, n, state["y"]), F.lit(a))
        return F.struct(left.alias("x"), F.pmod(state["y"] + _prf(key, kind, -n, left), F.lit(b)).alias("y"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permute_fields(year: Column, month: Column, day: Column, key: str, *, first: Column, days: Column, months: Column) -> Column:
    """Permute the dates of 1800 to 2199 whose day is ``first`` to ``days`` and whose month is at most ``months`` (9 or 12).

    A round turns one field after the other within the values that are dates with
    the other two, so it is undone step by step; year and month of a 29 February stay.
    """
    all_long = F.array(*[F.lit(m).cast("long") for m in (1, 3, 5, 7, 8, 10, 12)])
    n_long = F.when(months == 9, 5).otherwise(7)

    def prf(field: str, *parts: Column) -> Column:
        return _prf(key, "date fields", F.lit(field), first, days, months, *parts)

    def turn(s: Column, n: Column) -> Column:
        y, m, d = s["y"], s["m"], s["d"]
        y = F.when((m == 2) & (d == 29), y).otherwise(F.pmod(y - 1800 + prf("year", n, m, d), F.lit(400)) + 1800)
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))

    def turn_day(s: Column, n: Column) -> Column:
        y, m, d = s["y"], s["m"], s["d"]
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        d = F.pmod(d - first + prf("day", n, y, m), F.least(length, days) - first + 1) + first
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))

    def turn_month(s: Column, n: Column) -> Column:
        y, m, d = s["y"], s["m"], s["d"]
        add = prf("month", n, y, d)
        other = F.pmod(F.greatest(m - 2, F.lit(0)) + add, months - 1)   # January, March, April, ...: 0, 1, 2, ...
        m = (F.when(d <= 28, F.pmod(m - 1 + add, months) + 1).when(m == 2, m)
             .when(d <= 30, F.when(other == 0, 1).otherwise(other + 2))
             .otherwise(F.get(all_long, F.pmod(F.array_position(all_long, m) - 1 + add, n_long).cast("int"))))
        return F.struct(y.alias("y"), m.cast("long").alias("m"), d.alias("d"))

    def round_(s: Column, n: Column) -> Column:
        # a turn each: one of the three, so that no expression is copied into the next
        return F.when(n % 3 == 1, turn(s, n)).when(n % 3 == 2, turn_day(s, n)).otherwise(turn_month(s, n))

    start = F.struct(year.alias("y"), month.alias("m"), day.alias("d"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(3 * ROUNDS)), start, round_)


def refill(shape: Column, text: Column) -> Column:
    """``shape`` with its letters and digits replaced, in order, by the characters of ``text``; null if that is."""
    used = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), "[^A-Z0-9]", ""))
    return F.when(text.isNotNull(), F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(
        c.rlike("[A-Z0-9]"), F.substring(text, used(i), F.lit(1))).otherwise(c)), ""))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum from the right; every other digit, from the ``doubled``-th (0 or 1) on, counts double."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda s, d: s + d)


def mod97(text: Column) -> Column:
    """Remainder of the number that a letters-and-digits string stands for (A = 10 ... Z = 35)."""
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: (s * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match; null if it does not validate."""
    fits = {kind: m.rlike(f"^(?:{pattern})$") for kind, pattern in PATTERNS.items()}
    part = lambda sep, i: F.element_at(F.split(m, sep), i).cast("long")

    digits = F.regexp_replace(m, "[^0-9]", "")
    body = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    number = F.concat(body, F.pmod(10 - luhn_sum(body, 0) % 10, F.lit(10)).cast("string"))
    sep = F.regexp_extract(m, "[ -]", 0)
    grouped = F.when(sep == "", number).otherwise(F.concat_ws(" ", *[F.substring(number, i, 4) for i in (1, 5, 9, 13)]))
    valid_card = luhn_sum(digits, 1) % 10 == 0
    card = F.when(valid_card, F.when(sep == "-", F.translate(grouped, " ", "-")).otherwise(grouped))

    def iban(m: Column) -> Column:
        bban = permute_text(F.substring(m, F.lit(5), F.length(m)), key, "iban")
        country = F.substring(m, 1, 2)
        check = F.lpad((98 - mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")
        return F.when(mod97(F.concat(F.substring(m, F.lit(5), F.length(m)), F.substring(m, 1, 4))) == 1, F.concat(country, check, bban))

    area, group, serial = part("-", 1), part("-", 2), part("-", 3)
    issued = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)             # 898 areas
    new = permute_pair(place * 99 + group - 1, 898 * 99, serial - 1, 9999, key, "ssn")
    new_area = F.floor(new["x"] / 99) + 1
    ssn = F.when(issued, F.concat_ws(
        "-", F.lpad((new_area + F.when(new_area >= 666, 1).otherwise(0)).cast("string"), 3, "0"),
        F.lpad((new["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((new["y"] + 1).cast("string"), 4, "0")))

    octets = [part("[.]", i) for i in (1, 2, 3, 4)]
    moved = permute_pair(octets[0] * 256 + octets[1], 65536, octets[2] * 256 + octets[3], 65536, key, "ip")
    ip = F.when(reduce(Column.__and__, [o < 256 for o in octets]), F.concat_ws(
        ".", *[f(moved[c]).cast("string") for c in "xy" for f in (lambda v: F.floor(v / 256), lambda v: v % 256)]))

    def date(pattern: str) -> Column:   # 400 years are 27 * 5411 days
        day = F.datediff(F.try_to_timestamp(m, F.lit(pattern)).cast("date"), F.lit("1800-01-01").cast("date"))
        new = permute_pair(day % 27, 27, F.floor(day / 27), 5411, key, "date")
        moved = F.date_add(F.lit("1800-01-01").cast("date"), (new["y"] * 27 + new["x"]).cast("int"))
        return F.when(day.between(0, 146096), F.date_format(moved, pattern))

    year_first, mark = m.rlike("^[0-9]{4}"), F.regexp_extract(m, "[./-]", 0)
    field = lambda i, j: F.try_element_at(F.split(m, "[./-]"), F.when(year_first, i).otherwise(j))
    raw_one, raw_two = field(2, 1), field(3, 2)
    one, two, year = (x.try_cast("long") for x in (raw_one, raw_two, field(1, 3)))
    narrow_one, narrow_two = m.rlike(r"^(?:[0-9]{4}[/-])?[0-9][./-]"), m.rlike(r"[./-][0-9](?:[./-][0-9]{4})?$")
    # of two-digit fields only those that are no date with the month first come here
    day_first = ~year_first & (m.rlike(r"\.") | ~narrow_one)
    day, month = F.when(day_first, one).otherwise(two), F.when(day_first, two).otherwise(one)
    bounds = {"first": F.when(narrow_one | narrow_two, 1).otherwise(13),
              "days": F.when(F.when(day_first, narrow_one).otherwise(narrow_two), 9).otherwise(31),
              "months": F.when(F.when(day_first, narrow_two).otherwise(narrow_one), 9).otherwise(12)}
    valid = day.between(bounds["first"], bounds["days"]) & month.between(F.lit(1), bounds["months"]) & year.between(1800, 2199)
    valid &= F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0)).isNotNull()
    turned = permute_fields(year, month, day, key, **bounds)
    written = F.transform(F.array(turned), lambda t: F.concat_ws(
        "", F.when(year_first, F.concat(t["y"], mark)), F.lpad(F.when(day_first, t["d"]).otherwise(t["m"]).cast("string"), F.length(raw_one), F.lit("0")),
        mark, F.lpad(F.when(day_first, t["m"]).otherwise(t["d"]).cast("string"), F.length(raw_two), F.lit("0")),
        F.when(~year_first, F.concat(mark, t["y"]))))
    by_fields = F.when(valid, F.element_at(written, 1))

    prefix = F.regexp_extract(m, rf"^(?:\+(?:{'|'.join(CALLING)})|1[ .-])?", 0)
    rest = F.substring(m, F.length(prefix) + 1, F.length(m))
    phone = F.concat(prefix, refill(rest, permute_text(F.regexp_replace(rest, "[^0-9]", ""), key, "phone")))

    country_code = F.regexp_extract(m, r"^(?:\+[0-9]{1,3}[ .-]?)?", 0)
    out = {
        "email": F.concat(permute_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1)),
        "key": F.when(m.rlike("[a-f]") | ~m.rlike("[A-F]"), permute_text(m, key, "key", HEX)).otherwise(permute_text(m, key, "key", HEX_UPPER)),
        "iban": iban(m), "iban_spaced": refill(m, iban(F.translate(m, " -", ""))), "ssn": ssn, "ip": ip,
        "card": card, "card_long": F.when(valid_card, refill(m, number)), "date_short": by_fields,
        "phone_world": phone, "phone_plain": phone,
        "phone": F.concat(country_code, permute_text(F.substring(m, F.length(country_code) + 1, F.length(m)), key, "phone")),
    } | {kind: date(pattern) for kind, pattern in DATES.items()}
    for kind in ("date_slash", "date_dash"):
        out[kind] = F.coalesce(out[kind], by_fields)
    chosen = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        chosen = F.when(fits[kind], out[kind]).otherwise(chosen)
    return chosen


def pseudonymize(docs: DataFrame, key: str, *, text_col: str = "text", found_col: str | None = "n_found") -> DataFrame:
    """Replace the personal data in ``text_col``; ``found_col`` counts the replaced values.

    All other columns and rows stay as they are, whatever their names.  A null or
    empty text stays so, with 0 found; repeated rows are treated alike; an empty
    table gives an empty result.  Only texts with a digit or an ``@`` are searched.
    A text is cut at its matches and joined again with their pseudonyms.
    """
    text = F.col(text_col)
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    new = F.transform(matches, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    # an array of one, so that the search is made once for both columns
    once = F.when(text.rlike("[0-9@]"), F.struct(F.split(text, ANY, -1).alias("pieces"), new.alias("values")))
    name = "__pseudonyms"
    while name in docs.columns:
        name += "_"
    work = docs.select("*", F.explode(F.array(once)).alias(name))
    values = F.col(f"{name}.values")
    joined = F.array_join(F.zip_with(F.col(f"{name}.pieces"), values, lambda p, v: F.concat(p, F.coalesce(v["new"], v["old"], F.lit("")))), "")
    columns = [F.when(F.size(values) > 0, joined).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if found_col:
        found = F.size(F.filter(values, lambda v: v["new"].isNotNull()))
        columns.append(F.when(found > 0, found).otherwise(0).cast("long").alias(found_col))
    return work.select(*columns)
