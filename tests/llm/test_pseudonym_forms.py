"""Written forms of personal data; the shapes here are the test's own."""
import datetime as dt
import re

import pytest
from parley.llm.pseudonyms import pseudonymize

PHONES = ["555-123-4567", "415.555.2671", "555 123 4567", "1-800-555-0199", "+1-555-123-4567", "+14155552671", "+44 20 7946 0958",
          "+442079460958", "+44 (0)20 7946 0958", "+49 (30) 901820", "+33 1 23 45 67 89", "+353 1 679 6111", "+354 551 2345"]
IBANS = ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "BE68-5390-0754-7034",
         "FR14 2004 1010 0505 0001 3M02 606"]
CARDS = ["3782 822463 10005", "3782-822463-10005", "3056 930902 5904"]
DATES = ["31/12/1999", "5/3/2021", "5/31/2021", "31/5/2021", "12/3/2021", "2021/03/05", "2021/3/5", "2021-3-5", "31-12-1999",
         "12-31-1999", "5.3.2021", "29/02/2000", "29.2.2000"]
LEFT = ["GB82 WEST 1234 5698 7654 33", "3782 822463 10006", "31/13/1999", "30/2/2021", "32/1/2021", "0/5/2021", "2021/02/30", "5/3/2500",
        "29/02/1900", "+5 000 000", "12-555-123-4567-8", "1.2.3", "version 10.2.2021.4"]


def luhn(text):
    digits = re.sub(r"\D", "", text)
    return sum((2 * int(d) - (9 if int(d) > 4 else 0)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def mod97(text):
    s = re.sub("[ -]", "", text)
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonymize(df, "k").collect()}
    return [(got[i].text, got[i].n_found) for i in range(len(texts))]


def shape(text):
    return re.sub("[A-Z]", "A", re.sub("[0-9]", "9", text))


def is_date(text):
    for form in ("%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d"):
        try:
            return bool(dt.datetime.strptime(re.sub("[.-]", "/", text), form))
        except ValueError:
            pass
    return False


@pytest.mark.parametrize("values, valid", [(PHONES, lambda x: True), (IBANS, lambda x: mod97(x) == 1),
                                           (CARDS, lambda x: luhn(x) == 0), (DATES, is_date)])
def test_form_is_replaced_within_its_shape(spark, values, valid):
    got = replaced(spark, values + [f"see {x}, or ({x}) PAID 7 times.\n{x} on 05/06/2007" for x in values])
    for old, (new, n), (text, m) in zip(values, got[:len(values)], got[len(values):], strict=True):
        assert n == 1 and new != old and shape(new) == shape(old) and valid(new), (old, new)
        assert m == 4 and text.startswith(f"see {new}, or ({new}) PAID 7 times.\n{new} on "), (old, text)


def test_invalid_values_and_other_numbers_stay(spark):
    assert replaced(spark, LEFT) == [(x, 0) for x in LEFT]


def test_separators_do_not_change_the_pseudonym(spark):
    values = ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "+44 20 7946 0958", "+442079460958", "3782 822463 10005",
              "378282246310005"]
    new = [re.sub("[ -]", "", x) for x, _ in replaced(spark, values)]
    assert new[0::2] == new[1::2]


def test_different_dates_stay_different(spark):
    days = [dt.date(1999, 12, 1) + dt.timedelta(i) for i in range(460)]
    forms = ["{d}/{m}/{y}", "{m}/{d}/{y}", "{d:02}/{m:02}/{y}", "{d}.{m}.{y}", "{y}/{m}/{d}"]
    values = sorted({f.format(d=x.day, m=x.month, y=x.year) for x in days for f in forms})
    got = replaced(spark, values)
    assert all(n == 1 and is_date(x) for x, n in got)
    short = [x for old, (x, _) in zip(values, got, strict=True) if old[:4].isdigit() or len(old) < 10 or int(old[:2]) > 12]
    assert len(short) > 1000 and len(set(short)) == len(short)
