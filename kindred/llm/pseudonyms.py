"""Format-preserving pseudonyms of numbers and dates.

Found values are validated and then permuted with a keyed Feistel network inside
their own format: card numbers keep length and a valid check digit, telephone
and social security numbers their punctuation, IP addresses their four octets,
dates their notation and stay dates. The permutation depends on the key and the
kind alone, so equal values have equal pseudonyms in all documents and different
values different ones. Telephone and social security numbers are permuted again
until the result is one by the same check, so they are permuted among themselves;
a number written in two notations may so get two pseudonyms. Mail addresses are
named by 32 digits of a keyed digest, whatever their length. Everything is a
built-in expression over the row.

Telephone numbers are those with an area code in brackets, three groups of 3, 3
and 4 digits, ``+`` and 7 to 15 digits, ``00`` and such groups, or a leading 0 and
two or three groups; a country code can stand before the first two. Numbers
without any separator, bracket or ``+`` are not told from other digits. Dates
have a year of four digits, first or last, and ``-``, ``/`` or ``.`` between parts
of one or two digits. With ``/`` and ``-`` a year at the end follows the month and
day, or the day and month where that is no date; such a date becomes another one
after the 12th of a month, so that it cannot be read the other way either.

A Feistel round adds a keyed digest of one part to the other, modulo the size of
that part; parts are the two halves of a digit string, or of any domain of a * b
values. Dates are permuted within 73000 = 250 * 292 days from 1900-01-01.

Defined cases: null text stays null and has no values; values that fail their
check (check digit, octets, calendar, area numbers) stay as they are. A text of
any length is searched whole, in one task. Equal values and repeated rows are
treated alike. An empty table gives no rows. The input column text, and one named
values, are replaced; all others pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.exprs import let, packed, unpacked

ROUNDS = 8
EPOCH, DAY_PARTS = "1900-01-01", (250, 292)
#: Two days in five are not after the 12th: 0.4 ** 64 is about 3e-26.
LATE_ROUNDS = 64
#: One number in nine, and at most one telephone number in two, is no value of its kind: 0.5 ** 96 is about 1e-29.
WALK_ROUNDS = 96

MAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = "|".join(
    [
        r"(?:(?<![0-9+])\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,5}\)[ .-]?[0-9]{3,5}[ .-]?[0-9]{3,5}(?![0-9])",
        r"(?<![0-9+])(?<![0-9][.-])(?:(?:\+[0-9]{1,3}|1)[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])",
        r"(?<![0-9+])\+[1-9](?:[ .-]?[0-9]|[ .-]?\([0-9]{1,4}\)){6,14}(?![0-9/]|[.-][0-9])",
        r"(?<![0-9+])(?<![0-9][.-])00[1-9][0-9]{0,2}(?:[ -][0-9]{2,4}){2,4}(?![0-9/]|[.-][0-9])",
        r"(?<![0-9+])(?<![0-9][.-])0[1-9][0-9]{0,3}[ -][0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9/]|[.-][0-9])",
    ]
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Numbers that are never issued.
BARRED_SSN = "^(000|666|9)|-00-|-0000$"
DATE = "|".join(rf"(?<![0-9{c}])(?:[0-9]{{4}}{d}[0-9]{{1,2}}{d}[0-9]{{1,2}}|[0-9]{{1,2}}{d}[0-9]{{1,2}}{d}[0-9]{{4}}){after}" for c, d, after in (("-", "-", "(?![0-9-])"), (".", r"\.", "(?![0-9])"), ("/", "/", "(?![0-9])")))
CARD = r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}([ -])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{6}\1[0-9]{4,5})(?![0-9])"
ANY = "|".join([MAIL, IP, SSN, DATE, CARD, PHONE])


def _digest(key: str, *parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, inverse: bool = False) -> Column:
    """Permutes pairs of 0 <= a < size_a, 0 <= b < size_b. Struct of a and b."""
    rounds = list(range(ROUNDS))
    order = F.array(*map(F.lit, reversed(rounds) if inverse else rounds))
    sign = -1 if inverse else 1

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s.a + sign * F.pmod(_digest(key, i, size_a, s.b), size_a), size_a)
        right = F.pmod(s.b + sign * F.pmod(_digest(key, i, size_b, s.a), size_b), size_b)
        return F.struct(F.when(i % 2 == 0, left).otherwise(s.a).alias("a"), F.when(i % 2 == 1, right).otherwise(s.b).alias("b"))

    return F.aggregate(order, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permute_digits(digits: Column, key: str, inverse: bool = False) -> Column:
    """A digit string of the same length; strings of 2 to 36 digits."""

    def of(d: Column) -> Column:
        left = F.floor(F.length(d) / 2).cast("int")
        right = F.length(d) - left
        ten = lambda n: F.pow(F.lit(10.0), n).cast("long")
        out = feistel(F.substring(d, F.lit(1), left).cast("long"), F.substring(d, left + 1, right).cast("long"), ten(left), ten(right), key, inverse)
        return let(out, lambda s: F.concat(F.lpad(s.a.cast("string"), left, F.lit("0")), F.lpad(s.b.cast("string"), right, F.lit("0"))))

    return F.when(F.length(digits) < 2, digits).otherwise(let(digits, of))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def into_format(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order."""
    done = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s.out, F.substring(digits, s.k, F.lit(1))).alias("out"), (s.k + 1).alias("k"))).otherwise(F.struct(F.concat(s.out, c).alias("out"), s.k.alias("k"))),
    )
    return done.out


def luhn_sum(digits: Column) -> Column:
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + let(F.substring(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)),
    )


def permute_card(digits: Column, key: str, inverse: bool = False) -> Column:
    """All but the check digit are permuted, and the check digit is set anew."""
    body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, inverse)
    return let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))


def permute_date(day: Column, key: str, inverse: bool = False) -> Column:
    at = F.datediff(day, F.lit(EPOCH).cast("date")).cast("long")
    a, b = DAY_PARTS
    out = feistel(F.floor(at / b), at % b, F.lit(a).cast("long"), F.lit(b).cast("long"), key, inverse)
    return let(out, lambda s: F.date_add(F.lit(EPOCH).cast("date"), (s.a * b + s.b).cast("int")))


def permute_late_date(day: Column, key: str) -> Column:
    """Dates after the 12th of a month among themselves: permuted until one is reached again."""
    late = lambda d: F.dayofmonth(d) > 12
    start = permute_date(day, key)
    return F.aggregate(F.sequence(F.lit(1), F.lit(LATE_ROUNDS)), start, lambda d, _: F.when(late(d), d).otherwise(permute_date(d, key)))


def _day(value: Column) -> Column:
    """Struct of the day, or null, and the notation of its parts."""
    plain = F.translate(value, "./", "--")
    read = lambda pattern: F.try_to_timestamp(plain, F.lit(pattern)).cast("date")
    as_ = lambda day, order: F.struct(day.alias("day"), F.lit(order).alias("order"))
    american = read("M-d-yyyy")
    found = F.when(plain.rlike("^[0-9]{4}"), as_(read("yyyy-M-d"), "ymd")).when(F.contains(value, F.lit(".")), as_(read("d-M-yyyy"), "dmy")).when(american.isNotNull(), as_(american, "mdy")).otherwise(as_(read("d-M-yyyy"), "late"))
    inside = lambda d: F.datediff(d, F.lit(EPOCH).cast("date")).between(0, DAY_PARTS[0] * DAY_PARTS[1] - 1)
    return let(found, lambda f: F.struct(F.when(inside(f.day), f.day).alias("day"), f.order.alias("order"), plain.rlike("(^|-)[0-9](-|$)").alias("short")))


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda x: x.cast("int"))


def kind_of(value: Column) -> Column:
    """The kind of a match that passes its check, else null."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    cards = F.when(let(digits_of(value), lambda d: luhn_sum(d) % 10 == 0), F.lit("card"))
    ips = F.when(F.forall(_octets(value), lambda x: x <= 255), F.lit("ip"))
    ssn = F.when(~value.rlike(BARRED_SSN), F.lit("ssn"))
    return (
        F.when(F.contains(value, F.lit("@")), F.lit("mail"))
        .when(whole(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"), ips)
        .when(whole("[0-9]{3}-[0-9]{2}-[0-9]{4}"), ssn)
        .when(whole("[0-9]{4}([./-])[0-9]{1,2}\\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\\2[0-9]{4}"), F.when(_day(value).day.isNotNull(), F.lit("date")))
        .when(whole(CARD), cards)
        .otherwise(F.lit("phone"))
    )


def _is(value: Column, kind: Column) -> Column:
    ssn = value.rlike(f"^(?:{SSN})$") & ~value.rlike(BARRED_SSN)
    return F.when(kind == "ssn", ssn).otherwise(value.rlike(f"^(?:{PHONE})$"))


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    def ip(v: Column) -> Column:
        out = let(_octets(v), lambda o: feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), F.lit(65536).cast("long"), F.lit(65536).cast("long"), key + "ip"))
        return let(out, lambda s: F.concat_ws(".", F.floor(s.a / 256).cast("string"), (s.a % 256).cast("string"), F.floor(s.b / 256).cast("string"), (s.b % 256).cast("string")))

    def date(v: Column) -> Column:
        def of(f: Column) -> Column:
            day = F.when(f.order == "late", permute_late_date(f.day, key + "date")).otherwise(permute_date(f.day, key + "date"))
            shape = lambda d, full, short: F.when(f.short, F.date_format(d, short)).otherwise(F.date_format(d, full))
            plain = let(day, lambda d: F.when(f.order == "ymd", shape(d, "yyyy-MM-dd", "yyyy-M-d")).when(f.order == "mdy", shape(d, "MM-dd-yyyy", "M-d-yyyy")).otherwise(shape(d, "dd-MM-yyyy", "d-M-yyyy")))
            return F.replace(plain, F.lit("-"), F.regexp_extract(v, "[./-]", 0))

        return let(_day(v), of)

    def mail(v: Column) -> Column:
        return F.concat(F.substring(F.sha2(F.concat(F.lit(key + "mail"), F.lower(v)), 256), 1, 32), F.lit("@"), F.substring_index(v, "@", -1))

    def number(v: Column) -> Column:
        """Permuted until the result is a value of the same kind, so that valid values are permuted among themselves."""
        step = lambda x: into_format(x, permute_digits(digits_of(x), key + "number"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK_ROUNDS)), step(v), lambda x, _: F.when(_is(x, kind), x).otherwise(step(x)))

    return (
        F.when(kind == "card", into_format(value, permute_card(digits_of(value), key + "card")))
        .when(kind == "ip", ip(value))
        .when(kind == "date", date(value))
        .when(kind == "mail", mail(value))
        .when(kind.isNotNull(), number(value))
        .otherwise(value)
    )


def original_number(value: Column, kind: Column, key: str) -> Column:
    """The social security or telephone number that has this pseudonym."""
    step = lambda x: into_format(x, permute_digits(digits_of(x), key + "number", inverse=True))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK_ROUNDS)), step(value), lambda x, _: F.when(_is(x, kind), x).otherwise(step(x)))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with replaced values in ``text``, and values: start (code points in the old text), length, kind and pseudonym."""
    text = F.coalesce("text", F.lit(""))
    found = packed(docs, text=F.col("text"), match=F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    named = F.transform("match", lambda v: let(kind_of(v), lambda k: F.struct(k.alias("kind"), v.alias("old"), pseudonym(v, k, key).alias("new"))))
    found = found.withColumn("named", F.when(F.size("match") > 0, named).otherwise(F.array().cast("array<struct<kind:string,old:string,new:string>>")))
    found = found.withColumn("parts", F.when(F.size("match") > 0, F.split("text", ANY, -1)).otherwise(F.array(text)))
    placed = F.aggregate(
        F.arrays_zip(F.col("parts").alias("part"), F.col("named").alias("value")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,kind:string,pseudonym:string>>").alias("values")),
        lambda s, x: F.struct(
            (s.at + F.length(x.part) + F.coalesce(F.length(x.value.old), F.lit(0))).alias("at"),
            F.when(x.value.kind.isNotNull(), F.concat(s["values"], F.array(F.struct((s.at + F.length(x.part)).alias("start"), F.length(x.value.old).alias("length"), x.value.kind.alias("kind"), x.value.new.alias("pseudonym"))))).otherwise(s["values"]).alias("values"),
        ),
        lambda s: s["values"],
    )
    joined = F.array_join(F.flatten(F.zip_with("parts", "named", lambda p, v: F.array(p, F.coalesce(v.new, F.lit(""))))), "")
    new_text = F.when(F.col("text").isNull(), F.lit(None).cast("string")).when(F.size("match") > 0, joined).otherwise(F.col("text"))
    values = F.when(F.size("match") > 0, placed).otherwise(F.array().cast("array<struct<start:int,length:int,kind:string,pseudonym:string>>"))
    return unpacked(found, docs.columns, {"text": new_text, "values": values})
