"""Format-preserving pseudonyms: validated numbers and dates are permuted by a keyed Feistel network within their format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let, replaced

ROUNDS = 8

#: English months, in full or short, and the calling codes of one or two digits; all others have three.
MONTH = r"(?:[Jj]an(?:uary)?|[Ff]eb(?:ruary)?|[Mm]ar(?:ch)?|[Aa]pr(?:il)?|[Mm]ay|[Jj]une?|[Jj]uly?|[Aa]ug(?:ust)?|[Ss]ept?(?:ember)?|[Oo]ct(?:ober)?|[Nn]ov(?:ember)?|[Dd]ec(?:ember)?)"
CODE = r"^(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: The forms that are looked for. Whether a match counts is decided by its checks below.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![\w.-])\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iso_date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])",
    "date": r"(?<![\w/.-])\d{1,2}([/.-])\d{1,2}\1\d{4}(?![\w/-])",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "plain_phone": r"(?<![\w+])(?<!\d[.,-])(?:\+?1)?[2-9]\d{2}[2-9]\d{6}(?![\w-]|[.,]\d)",
    "abroad": r"(?<![\w+])\+[2-9](?:[ .-]?\(?\d\)?){7,14}(?![\w-])",
    "named_date": rf"(?<![\w/.-])(?:\d{{1,2}}\.? {MONTH}\.?,?|{MONTH}\.? \d{{1,2}},?) \d{{4}}(?![\w/-])",
    "card": r"(?<![\w-])(?:\d{4}(?:-\d{4}){3}|\d{4}(?: \d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-])",
}
ANY = "|".join(f"(?:{p})" for p in FORMS.values())
#: Days are permuted among those of their own span, so that days of our time stay such. Together the spans are all days
#: of the years 1 to 9999: (first day, a, b) with a * b days each, counted from 1900-01-01.
FIRST_DAY = "1900-01-01"
SPANS = ((-693_595, 833, 832), (-539, 49, 11), (0, 271, 270), (73_170, 1699, 1698), (2_958_072, 28, 14))


def feistel(x: Column, a: Column | int, b: Column | int, key: str, tweak: str) -> Column:
    """A keyed permutation of 0..a*b-1: by turns the high and the low part are shifted by a digest of the other."""
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v for v in (a, b))

    def shift(i: Column, other: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("/", F.lit(key), F.lit(tweak), i.cast("string"), other.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size

    def step(s: Column, i: Column) -> Column:
        high = F.struct(((s["h"] + shift(i, s["l"], a)) % a).alias("h"), s["l"].alias("l"))
        low = F.struct(s["h"].alias("h"), ((s["l"] + shift(i, s["h"], b)) % b).alias("l"))
        return F.when(i % 2 == 0, high).otherwise(low)

    start = F.struct(F.call_function("div", x, b).alias("h"), (x % b).alias("l"))
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda s: s["h"] * b + s["l"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _number(s: Column) -> Column:
    return s.cast("long")


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in order, everything else as it was."""
    return let(F.struct(m.alias("m"), digits.alias("d")), lambda x: F.array_join(F.transform(F.split(x["m"], ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(x["d"], F.char_length(_digits(F.substr(x["m"], F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _card(m: Column, key: str) -> Column:
    """All digits but the last are permuted, and the last is the check digit again."""

    def changed(d: Column) -> Column:
        n = F.char_length(d) - 1
        low = _ten(F.call_function("div", n, F.lit(2)).cast("int"))
        body = F.lpad(feistel(_number(F.substr(d, F.lit(1), n)), _ten(n - F.call_function("div", n, F.lit(2)).cast("int")), low, key, "card").cast("string"), n, "0")
        return let(body, lambda x: F.concat(x, F.pmod(F.lit(10) - luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))

    return let(_digits(m), lambda d: F.when(luhn(d) == 0, refill(m, changed(d))).otherwise(m))


def _phone(m: Column, key: str) -> Column:
    """Area and exchange that begin with 2 to 9 do so again; other numbers keep the digits that make them odd."""

    def changed(d: Column) -> Column:
        own = F.right(d, F.lit(10))
        lead = F.substr(d, F.lit(1), F.char_length(d) - 10)
        area, exchange, line = (_number(F.substring(own, *x)) for x in ((1, 3), (4, 3), (7, 4)))
        usual = (area >= 200) & (exchange >= 200)
        x = ((area - 200) * 800 + (exchange - 200)) * 10000 + line
        good = let(feistel(x, 800 * 800, 10000, key, "phone"), lambda y: F.concat(F.lpad((F.call_function("div", y, F.lit(8_000_000).cast("long")) + 200).cast("string"), 3, "0"), F.lpad((F.call_function("div", y, F.lit(10_000).cast("long")) % 800 + 200).cast("string"), 3, "0"), F.lpad((y % 10_000).cast("string"), 4, "0")))
        rest = F.concat(F.substring(own, 2, 2), F.substring(own, 5, 6))
        odd = let(F.lpad(feistel(_number(rest), 10_000, 10_000, key, "phone-other").cast("string"), 8, "0"), lambda y: F.concat(F.substring(own, 1, 1), F.substring(y, 1, 2), F.substring(own, 4, 1), F.substring(y, 3, 6)))
        return F.concat(lead, F.when(usual, good).otherwise(odd))

    return let(_digits(m), lambda d: refill(m, changed(d)))


def _abroad(m: Column, key: str) -> Column:
    """The country code stays, the other digits are permuted among all of their number, however they are grouped."""

    def changed(d: Column) -> Column:
        lead = F.regexp_extract(d, CODE, 0)
        own = F.substr(d, F.char_length(lead) + 1)
        n = F.char_length(own)
        low = F.call_function("div", n, F.lit(2)).cast("int")
        return F.concat(lead, F.lpad(feistel(_number(own), _ten(n - low), _ten(low), key, "abroad").cast("string"), n, "0"))

    return let(_digits(m), lambda d: refill(m, changed(d)))


def _ssn(m: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (_number(F.substring(m, *x)) for x in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1

    def written(y: Column) -> Column:
        a = F.call_function("div", y, F.lit(99 * 9999).cast("long")) + 1
        a = a + (a >= 666).cast("long")
        g = F.call_function("div", y, F.lit(9999).cast("long")) % 99 + 1
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad(g.cast("string"), 2, "0"), F.lpad((y % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, let(feistel(x, 898 * 99, 9999, key, "ssn"), written)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    def changed(o: Column) -> Column:
        part = lambda i: F.element_at(o, i).cast("long")
        valid = ~F.exists(o, lambda x: x.cast("int") > 255)
        x = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
        return F.when(valid, let(feistel(x, 65536, 65536, key, "ip"), lambda y: F.concat_ws(".", *((F.shiftright(y, s) % 256).cast("string") for s in (24, 16, 8, 0))))).otherwise(m)

    return let(F.split(m, r"\."), changed)


def _day(date: Column, write, m: Column, key: str) -> Column:
    """The day is permuted within its span; what isn't a day stays."""
    span = F.filter(F.array(*(F.struct(F.lit(first).cast("long").alias("first"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for first, a, b in SPANS)), lambda s: s["first"] <= F.datediff(date, F.lit(FIRST_DAY).cast("date")))
    moved = let(F.element_at(span, -1), lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["first"] + feistel(F.datediff(date, F.lit(FIRST_DAY).cast("date")).cast("long") - s["first"], s["a"], s["b"], key, "date")).cast("int")))
    return F.when(date.isNotNull(), let(moved, write)).otherwise(m)


def _iso(m: Column, key: str) -> Column:
    return _day(F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date"), lambda d: F.date_format(d, "yyyy-MM-dd"), m, key)


def _numeric_date(m: Column, key: str) -> Column:
    """Month first where that is a date, else day first; the separator and the order stay."""

    def changed(x: Column) -> Column:
        a, b, y = (F.element_at(x, i) for i in (1, 2, 3))
        sep = F.regexp_extract(m, "[/.-]", 0)
        date = lambda month, day: F.try_to_timestamp(F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
        month_first = date(a, b)
        write = lambda one, two: lambda d: F.concat_ws("", F.date_format(d, one), sep, F.date_format(d, two), sep, F.date_format(d, "yyyy"))
        return F.when(month_first.isNotNull(), _day(month_first, write("MM", "dd"), m, key)).otherwise(_day(date(b, a), write("dd", "MM"), m, key))

    return let(F.split(m, "[/.-]"), changed)


def _named_date(m: Column, key: str) -> Column:
    """The order and the length of the month's name stay."""
    name = F.regexp_extract(m, "[A-Za-z]+", 0)
    month = F.call_function("div", F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.left(name, F.lit(3)))) + 2, F.lit(3)).cast("string")
    day = F.regexp_extract(m, r"(?<!\d)\d{1,2}(?!\d)", 0)
    date = F.try_to_timestamp(F.concat_ws("-", F.right(m, F.lit(4)), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

    def written(d: Column) -> Column:
        month = F.when(F.char_length(name) > 4, F.date_format(d, "MMMM")).otherwise(F.date_format(d, "MMM"))
        out = F.regexp_replace(F.regexp_replace(m, F.lit("[A-Za-z]+"), month), F.lit(r"\d{4}$"), F.date_format(d, "yyyy"))
        return F.regexp_replace(out, F.lit(r"(?<!\d)\d{1,2}(?!\d)"), F.date_format(d, "dd"))

    return _day(date, written, m, key)


def _email(m: Column, key: str) -> Column:
    """A name from a keyed digest at a domain that no one can own."""
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("/", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))


_CHANGES = {"email": _email, "ip": _ip, "ssn": _ssn, "iso_date": _iso, "date": _numeric_date, "phone": _phone, "plain_phone": _phone, "abroad": _abroad, "named_date": _named_date, "card": _card}


def pseudonym(m: Column, key: str) -> Column:
    """What stands for one match of ``ANY``; a match that isn't valid stays as it is."""
    out = m
    for kind in reversed(list(FORMS)):
        out = F.when(m.rlike(f"^(?:{FORMS[kind]})$"), _CHANGES[kind](m, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal numbers, dates and addresses of every whole text replaced; equal values get equal pseudonyms.

    Cards with a right check digit, telephone and social-security numbers, IPv4 addresses and days of the years 1 to 9999
    keep their format and stay valid; e-mail addresses get a keyed name. Who has ``key`` can turn a pseudonym back, so it
    is the caller's to keep. Of forms that begin at one place the first of FORMS is taken. Null and empty texts stay, texts
    may be of any length, repeated rows get the same text. All rows and columns are kept, ``n_chars`` too, which is set to
    the new length where it is there. An empty table gives an empty one.
    """
    out = docs.withColumn(text_col, replaced(F.col(text_col), ANY, lambda m: pseudonym(m, key)))
    return out.withColumn("n_chars", F.char_length(text_col).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def report(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, changed) of every document."""
    out = pseudonymised(docs.select("doc_id", "text", F.col("text").alias("before")), key)
    return out.select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("before"))).alias("changed"))
