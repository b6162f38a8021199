"""Format-preserving pseudonyms for personal data, in SQL functions.

Numbers and dates that pass the checks of their format are permuted within it by
a keyed Feistel network: a card number becomes another one of the same length,
grouping, leading digit and a right check digit, a date another date of its
century.  A permutation is one to one, so equal values stay equal in all
documents and different ones different, and who holds the key can undo it.
E-mail addresses and secrets have no numeric format; they get keyed hashes.

A Feistel step adds a keyed function of one half to the other half modulo the
number of values that half has; so any format that is a product of two ranges is
permuted exactly, without values outside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: The key of the queries here; production jobs pass their own.
KEY = "lodeline-demonstration-key"
ROUNDS = 8
#: Set between a value and what a match took besides; no text has these noncharacters in a row.
MARK = "\uFDD0\uFDD1\uFDD0"

#: English names of months, fixed; of each its first three letters are a short form.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS)
#: No pattern repeats a group without a bound: Java goes one call deeper for each.
_PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[A-Za-z0-9\-]++\.){1,127}[A-Za-z]{2,}+",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)\b[\"']?\s*[=:]\s*[\"']?[A-Za-z0-9_\-/+]{16,}+)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "iso": r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])",
    "date": r"(?<![\d/.])(?:\d{1,2}/\d{1,2}/|\d{1,2}\.\d{1,2}\.)\d{4}(?!\d|[/.]\d)",
    "written": rf"(?<![A-Za-z0-9])(?:(?:{_MONTH}) \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}|\d{{1,2}}(?:st|nd|rd|th)? (?:{_MONTH}),? \d{{4}})(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d])",
    "phone": r"(?<![\d(+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|(?<![\d+])\+\d(?:[ .\-]?\d){7,14}(?!\d)",
}
#: A group for each kind would cost a scan each.
_ANY = "|".join(_PATTERNS.values())


def _is(kind: str, m: Column) -> Column:
    return m.rlike("^(?:" + _PATTERNS[kind] + ")$")


def _random(key: str, tweak: Column, step: Column, x: Column, below: Column) -> Column:
    """A keyed pseudo-random number under a bound, from 60 bits of SHA-256."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, step.cast("string"), x.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), below)


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, tweak: Column, key: str) -> Column:
    """Permutes the pairs (a < size_a, b < size_b); a struct of a and b."""
    pair = "struct<a:bigint,b:bigint>"

    def step(s: Column, r: Column) -> Column:
        first = F.pmod(s["a"] + _random(key, tweak, r, s["b"], size_a), size_a)
        second = F.pmod(s["b"] + _random(key, tweak, r, s["a"], size_b), size_b)
        return F.when(r % 2 == 0, F.struct(first.alias("a"), s["b"].alias("b")).cast(pair)).otherwise(F.struct(s["a"].alias("a"), second.alias("b")).cast(pair))

    start = F.when(a.isNotNull() & b.isNotNull(), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")).cast(pair))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10), n).cast("long")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _with(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_digits(d: Column, tweak: Column, key: str) -> Column:
    """Another string of as many digits (2 to 36)."""
    half = F.floor(F.length(d) / 2).cast("int")
    rest = F.length(d) - half
    a, b = F.substring(d, F.lit(1), half), F.substring(d, half + 1, rest)
    moved = feistel(a.cast("long"), b.cast("long"), _ten(half), _ten(rest), F.concat_ws("|", tweak, F.length(d).cast("string")), key)
    return _with(moved, lambda s: F.concat(F.lpad(s["a"].cast("string"), half, "0"), F.lpad(s["b"].cast("string"), rest, "0")))


def fill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order."""
    state = "struct<out:string,k:int>"

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        out = F.concat(s["out"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c))
        return F.struct(out.alias("out"), F.when(digit, s["k"] + 1).otherwise(s["k"]).alias("k")).cast(state)

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")).cast(state), put, lambda s: s["out"])


def luhn(d: Column) -> Column:
    """The Luhn sum of a string of digits modulo 10; 0 for a valid number."""
    def add(s: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return (s + F.when(i % 2 == 1, twice).otherwise(x)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10


def _card(m: Column, key: str) -> Column:
    def change(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), F.concat(F.lit("card"), F.substring(d, 1, 1)), key))
        whole = _with(body, lambda x: F.concat(x, ((10 - luhn(F.concat(x, F.lit("0")))) % 10).cast("string")))
        return F.when((luhn(d) == 0) & (d.rlike("[1-9]")), fill(m, whole)).otherwise(m)

    return _with(_digits(m), change)


def _phone(m: Column, key: str) -> Column:
    def change(d: Column) -> Column:
        lead = F.greatest(F.length(d) - 10, F.lit(0))
        kept = F.substring(d, F.lit(1), lead)
        return fill(m, F.concat(kept, permute_digits(F.substring(d, lead + 1, F.lit(10)), F.concat(F.lit("phone"), kept), key)))

    return _with(_digits(m), change)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)
    row = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel(row * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key)

    def show(s: Column) -> Column:
        a = F.floor(s["a"] / 99).cast("int")
        a = F.when(a > 664, a + 2).otherwise(a + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["b"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _with(moved, show)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, r"\.")
    part = lambda i: F.element_at(o, i).cast("int")
    moved = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), F.lit("ip"), key)
    return _with(moved, lambda s: F.concat_ws(".", *[(x % 65536).cast("int").cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)]))


def _mod97(text: Column) -> Column:
    """A string of digits and capitals, these as 10 to 35, modulo 97."""
    def add(s: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    def change(v: Column) -> Column:
        body = F.substring(v, F.lit(5), F.length(v) - 4)
        d = _digits(body)
        new = F.when(F.length(d) >= 2, fill(body, permute_digits(d, F.concat(F.lit("iban"), F.substring(v, 1, 2)), key))).otherwise(body)

        def show(x: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(x, F.substring(v, 1, 2), F.lit("00")))).cast("string"), 2, "0")
            return fill(m, F.concat(check, _digits(x)))

        valid = _mod97(F.concat(body, F.substring(v, 1, 4))) == 1
        return F.when(valid, _with(new, show)).otherwise(m)

    return _with(F.replace(m, F.lit(" "), F.lit("")), change)


def _valid_card(m: Column) -> Column:
    return _with(_digits(m), lambda d: (luhn(d) == 0) & d.rlike("[1-9]"))


def _valid_iban(m: Column) -> Column:
    return _with(F.replace(m, F.lit(" "), F.lit("")), lambda v: _mod97(F.concat(F.substring(v, F.lit(5), F.length(v) - 4), F.substring(v, 1, 4))) == 1)


def shorter(m: Column) -> Column:
    """Of a card or IBAN that fails its check, the length of the longest part, up
    to the end of a group, that passes it; null if none does or m passes."""
    groups = F.regexp_extract_all(m, F.lit(r"[ \-]?[A-Za-z0-9]+"), F.lit(0))
    parts = F.transform(F.sequence(F.size(groups) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), ""))
    of = lambda kind, valid: F.when(~valid(m), F.length(F.get(F.filter(parts, lambda p: _is(kind, p) & valid(p)), 0)))
    more = F.size(groups) > 1
    return F.when(_is("iban", m) & more, of("iban", _valid_iban)).when(_is("card", m) & more, of("card", _valid_card))


def cut(text: Column, old: Column, mark: str) -> Column:
    """text with a mark behind each shorter part."""
    ends = F.transform(old, lambda m: F.struct(m.alias("m"), shorter(m).alias("n")))
    marked = F.transform(ends, lambda e: F.when(e["n"].isNull(), e["m"]).otherwise(F.concat(F.substring(e["m"], F.lit(1), e["n"]), F.lit(mark), F.substring(e["m"], e["n"] + 1, F.length(e["m"])))))
    return F.array_join(F.zip_with(F.split(text, _ANY, -1), marked, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _moved_day(day: Column, key: str) -> Column:
    """Another day of the same century, the centuries 1600 to 2100."""
    century = F.floor(F.year(day) / 100).cast("int")
    start = F.make_date(century * 100, F.lit(1), F.lit(1))
    leap = century % 4 == 0  # such a century has 36525 = 75 * 487 days, others 36524 = 92 * 397
    wide = F.when(leap, F.lit(487)).otherwise(F.lit(397))
    n = F.datediff(day, start)
    moved = feistel(F.floor(n / wide), n % wide, F.when(leap, F.lit(75)).otherwise(F.lit(92)), wide, F.concat(F.lit("date"), century.cast("string")), key)
    return F.when(century.between(16, 21), _with(moved, lambda s: F.date_add(start, (s["a"] * wide + s["b"]).cast("int"))))


def _iso(m: Column, key: str) -> Column:
    return F.coalesce(F.date_format(_moved_day(F.try_to_date(m, "yyyy-MM-dd"), key), "yyyy-MM-dd"), m)


def _date(m: Column, key: str) -> Column:
    """Day first where that is a date, else month first; the order is kept, and
    whether days and months below ten have two digits."""
    mark = F.when(F.contains(m, F.lit("/")), F.lit("/")).otherwise(F.lit("."))
    part = F.split(m, "[/.]")
    at = lambda i: F.element_at(part, i)
    wide = F.when((F.length(at(1)) == 2) & (F.length(at(2)) == 2), 2).otherwise(1)
    show = lambda x: F.when(x < 10, F.lpad(x.cast("string"), wide, "0")).otherwise(x.cast("string"))

    def moved(day: int, month: int) -> Column:
        found = _moved_day(_day(at(3), at(month), at(day)), key)
        shown = {day: F.dayofmonth, month: F.month}
        return F.when(found.isNotNull(), _with(found, lambda d: F.concat(show(shown[1](d)), mark, show(shown[2](d)), mark, F.lpad(F.year(d).cast("string"), 4, "0"))))

    return F.coalesce(moved(1, 2), moved(2, 1), m)


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _written(m: Column, key: str) -> Column:
    """A date with the name of its month, which stays long or short; so do the order
    and the commas, and an ending of the day is put right."""
    name = F.regexp_extract(m, "[A-Z][a-z]+", 0)
    number = F.regexp_extract(m, r"(?<![0-9])([0-9]{1,2})(?:st|nd|rd|th)?(?![0-9])", 1)
    year = F.regexp_extract(m, r"[0-9]{4}$", 0)
    month = F.array_position(F.array(*[F.lit(x[:3]) for x in MONTHS]), F.substring(name, 1, 3)).cast("int")

    def show(d: Column) -> Column:
        n, long = F.dayofmonth(d), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d))
        new = F.when((F.length(name) > 3) | (name == "May") & (F.month(d) == 5), long).otherwise(F.substring(long, 1, 3))
        ending = F.when(n.isin(1, 21, 31), "st").when(n.isin(2, 22), "nd").when(n.isin(3, 23), "rd").otherwise("th")
        shown = F.concat(n.cast("string"), F.when(m.rlike("[0-9](st|nd|rd|th)"), ending).otherwise(F.lit("")))
        out = F.when(m.rlike("^[A-Z]"), F.concat(new, F.lit(" "), shown)).otherwise(F.concat(shown, F.lit(" "), new))
        return F.concat(out, F.when(F.contains(m, F.lit(",")), ", ").otherwise(F.lit(" ")), F.lpad(F.year(d).cast("string"), 4, "0"))

    moved = _moved_day(_day(year, month.cast("string"), number), key)
    return F.coalesce(F.when(moved.isNotNull(), _with(moved, show)), m)


def _email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@pseudonym.invalid"))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9_\-/+]{16,}$", 0)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(value)).cast("binary"), 512)
    new = F.substring(F.repeat(digest, F.ceil(F.length(value) / 128).cast("int")), F.lit(1), F.length(value))
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), F.when(value == F.upper(value), F.upper(new)).otherwise(new))


_CHANGES = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "iso": _iso, "date": _date, "written": _written, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one found value; a value that fails its checks stays."""
    out = F.when(F.lit(False), m)
    for kind, change in _CHANGES.items():
        out = out.when(_is(kind, m), change(m, key))
    return F.coalesce(out.otherwise(m), m)


def kind(m: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name in _PATTERNS:
        out = out.when(_is(name, m), F.lit("date" if name in ("iso", "written") else name))
    return out


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs(text, ...) with personal data in text replaced, and n_values (how
    many values were) and kinds (sorted, distinct) added; all other columns stay.

    Edges: a null text stays null with no values; empty texts stay empty; a text
    without such values is returned as it is, byte for byte; columns named
    n_values, kinds are replaced; repeated rows are kept and get equal texts.
    """
    names = [c for c in docs.columns if c not in ("n_values", "kinds")]
    # The columns of docs are kept apart, so that none clashes with those made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("kept"))
    text = F.col("kept.text")
    found = rows.withColumn("old", F.when(text.rlike(_ANY), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))))
    # A match that fails its check may have swallowed what follows a valid value;
    # a mark is put between them, and what follows is searched anew.
    short = F.coalesce(F.exists("old", lambda m: F.coalesce(shorter(m) > 0, F.lit(False))), F.lit(False))
    found = found.withColumn("cut", F.when(short, cut(text, F.col("old"), MARK)))
    found = found.withColumn("old", F.when(F.col("cut").isNotNull(), F.regexp_extract_all("cut", F.lit(_ANY), F.lit(0))).otherwise(F.col("old")))
    moved = found.withColumn("new", F.transform("old", lambda m: pseudonym(m, key)))
    pieces = F.zip_with(F.split(F.coalesce("cut", text), _ANY, -1), F.col("new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    whole = F.array_join(pieces, "")
    out = F.when(F.col("cut").isNotNull(), F.replace(whole, F.lit(MARK), F.lit(""))).when(F.col("old").isNotNull(), whole).otherwise(text)
    changed = F.filter(F.arrays_zip("old", "new"), lambda x: x["old"] != x["new"])
    n = F.when(F.col("old").isNull(), F.lit(0)).otherwise(F.size(changed))
    kinds = F.coalesce(F.array_sort(F.array_distinct(F.transform(changed, lambda x: kind(x["old"])))), F.array().cast("array<string>"))
    return moved.select(*[out.alias("text") if c == "text" else F.col(f"kept.`{c}`") for c in names], n.cast("long").alias("n_values"), kinds.alias("kinds"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
