"""Format-preserving pseudonyms by keyed Feistel networks, in built-in functions only.

Found and validated: payment card numbers (13 to 19 digits, plain or with single separators
anywhere, Luhn check), telephone numbers (with country code, area code in parentheses, trunk zero
or three groups of 3, 3 and 4 digits; 8 to 15 digits), social security numbers, IPv4 addresses
(octets up to 255), dates of 1900 to 2099 (ISO, or by / or . with the day first, else the month;
one or two digits; real calendar days only) and e-mail addresses. Each value's digits (for e-mail: letters and
digits of the local part) are permuted by alternating modular additions of a keyed hash, a
bijection of the values of its format: equal values stay linked across documents, different
ones stay different, a card keeps a valid check digit, a social security number stays a valid one
and a date a date. The domain of an e-mail address stays as it is. What fails its
validation stays as it is; digits that only might have been a card are searched for the other kinds.

Defined results: null text stays null, with no counts; empty text stays empty. No row is
compared with another, so ties, repeated rows and other columns don't matter; all columns are
carried along, but `pii` takes the place of a column of that name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, renamed

ROUNDS = 10
KINDS = ("email", "card", "phone", "ssn", "ip", "date")
_L, _R = r"(?<![0-9A-Za-z])(?<![0-9][.+\-])", r"(?![0-9A-Za-z])"
_PHONES = (
    r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}[\- ][0-9]{4}",
    r"(?:\+?1[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}",
    r"\+1[ .\-]?[0-9]{3}[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}",
    r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,5}\)[ .\-]?)?[0-9]{1,5}(?:[ .\-][0-9]{2,8}){1,4}",
    r"\+[0-9]{8,15}",
    r"\(0[0-9]{1,4}\)[ .\-]?[0-9]{3,8}(?:[ .\-][0-9]{2,4}){0,3}",
    r"(?:1[ .\-])?[0-9]{3}(?<p>[ .\-])[0-9]{3}\k<p>[0-9]{4}(?![.\-][0-9])",
    r"0[0-9]{1,4}(?<q>[ .\-])[0-9]{2,8}(?:\k<q>[0-9]{2,4}){0,4}(?![.\-][0-9])",
)
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}+",
    "card": _L + r"(?:[0-9]{13,19}|[0-9]{4}(?<c>[ .\-])[0-9]{4}\k<c>[0-9]{4}\k<c>[0-9]{4}(?:\k<c>[0-9]{3})?|[0-9]{4}(?<a>[ .\-])[0-9]{6}\k<a>[0-9]{4,5})" + _R,
    "ssn": _L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R,
    "ip": _L + r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": _L + r"(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})" + _R,
    "phone": r"(?<![0-9A-Za-z+])(?<![0-9][.\-])(?:" + "|".join(_PHONES) + ")" + _R,
}
#: Separators anywhere; only the Luhn check tells such cards from other numbers in a row.
_LOOSE_CARD = _L + r"[0-9](?:[ .\-]?[0-9]){12,18}(?![ .\-]?[0-9A-Za-z])"
_STRICT = "|".join(PATTERNS[k] for k in PATTERNS if k != "email")
#: The look-ahead spares the alternatives at all places that no number starts at.
_DIGITS = "(?=[0-9+(])(?:" + _STRICT + "|" + _LOOSE_CARD + ")"
_ALL = PATTERNS["email"] + "|" + _DIGITS
_FIRST_DAY, _LEFT_DAYS, _RIGHT_DAYS = "1900-01-01", 17, 4297  # 17 * 4297 days reach to 2099-12-31


def _let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f).getItem(0)


def _round(key: str, tweak: Column, i: Column, x: Column, mod: Column) -> Column:
    """A keyed hash of one half below `mod`."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), mod)


def feistel(key: str, tweak: Column, left: Column, right: Column, left_mod: Column, right_mod: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs below (left_mod, right_mod)."""

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        moved_l = F.pmod(s.l + _round(key, tweak, i, s.r, left_mod), left_mod)
        moved_r = F.pmod(s.r + _round(key, tweak, i, s.l, right_mod), right_mod)
        return F.struct(F.when(odd, moved_l).otherwise(s.l).alias("l"), F.when(odd, s.r).otherwise(moved_r).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """The digit string's image among digit strings of its length (2 to 36)."""

    def moved(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        out = feistel(key, F.concat(F.lit(kind), n.cast("string")), F.substring(d, F.lit(1), u).cast("long"), F.substring(d, u + 1, n - u).cast("long"), _ten(u), _ten(n - u))
        return _let(out, lambda o: F.concat(F.lpad(o.l.cast("string"), u, "0"), F.lpad(o.r.cast("string"), n - u, "0")))

    return _let(digits, moved)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string with its check digit."""

    def summed(own: Column) -> Column:
        n = F.length(own)

        def add(s: Column, i: Column) -> Column:
            d = F.substring(own, i, F.lit(1)).cast("int")
            twice = (n - i) % 2 == 1
            return s + F.when(twice, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return _let(digits, summed)


def _refilled(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced, in order, by those of `digits`."""

    def filled(own: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            digit = c.between("0", "9")
            return F.struct(F.concat(s.out, F.when(digit, F.substring(own, s.at, F.lit(1))).otherwise(c)).alias("out"), (s.at + digit.cast("int")).alias("at"))

        return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s.out)

    return _let(digits, filled)


def _only_digits(m: Column) -> Column:
    return F.translate(m, "+-.() ", "")


def _card(key: str, m: Column) -> Column:
    def shown(digits: Column) -> Column:
        body = permuted_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
        check = lambda b: F.pmod(10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10))
        return F.when(_luhn_sum(digits) % 10 == 0, _refilled(m, _let(body, lambda b: F.concat(b, check(b).cast("string")))))

    return _let(_only_digits(m), shown)


def _phone(key: str, m: Column) -> Column:
    """Country code or trunk zero stay, the rest is permuted."""
    kept = _only_digits(F.regexp_extract(m, r"^(?:\+[0-9]{1,3}(?=[ .\-(])|\+[0-9]|1(?=[ .\-(])|0(?=[0-9]))", 0))

    def shown(x: Column) -> Column:
        own = F.substring(x.digits, F.length(x.kept) + 1, F.length(x.digits))
        return F.when(F.length(x.digits).between(8, 15), _refilled(m, F.concat(x.kept, permuted_digits(key, "phone", own))))

    return _let(F.struct(_only_digits(m).alias("digits"), kept.alias("kept")), shown)


def _ssn(key: str, m: Column) -> Column:
    """Permuted among the valid numbers: areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area, group, serial = (F.split(m, "-").getItem(i).cast("long") for i in range(3))
    real = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    out = feistel(key, F.lit("ssn"), place, serial - 1, F.lit(898 * 99), F.lit(9999))

    def shown(o: Column) -> Column:
        rank = F.floor(o.l / 99)
        return F.format_string("%03d-%02d-%04d", rank + F.when(rank >= 665, 2).otherwise(1), o.l % 99 + 1, o.r + 1)

    return F.when(real, _let(out, shown))


def _ip(key: str, m: Column) -> Column:
    text = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))

    def shown(p: Column) -> Column:
        out = feistel(key, F.lit("ip"), p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536))
        return F.when((p[0] < 256) & (p[1] < 256) & (p[2] < 256) & (p[3] < 256), _let(out, lambda o: F.concat_ws(".", text(o.l), text(o.r))))

    return _let(F.split(m, r"\.").cast("array<long>"), shown)


def _date(key: str, m: Column) -> Column:
    first = F.to_date(F.lit(_FIRST_DAY))
    iso = m.rlike("^[0-9]{4}-")

    def moved(place: Column) -> Column:
        out = feistel(key, F.lit("date"), F.floor(place / _RIGHT_DAYS), place % _RIGHT_DAYS, F.lit(_LEFT_DAYS), F.lit(_RIGHT_DAYS))
        return _let(out, lambda o: (o.l * _RIGHT_DAYS + o.r).cast("int"))

    def walk(s: Column, _: Column) -> Column:
        # A month-first date goes on to the next day above 12, so that it can't be read day-first.
        return F.when(F.dayofmonth(F.date_add(first, s)) > 12, s).otherwise(moved(s))

    def shown(d: Column) -> Column:
        """`d`: (value, whether its month comes first)."""
        place = F.when(d.turned, F.aggregate(F.sequence(F.lit(1), F.lit(64)), moved(F.date_diff(d.value, first)), walk)).otherwise(moved(F.date_diff(d.value, first)))
        order = F.when(iso, "yyyy-MM-dd").when(d.turned, "MM/dd/yyyy").otherwise("dd/MM/yyyy")
        order = F.when(m.rlike("(^|[^0-9])[0-9]([^0-9]|$)"), F.replace(F.replace(order, F.lit("MM"), F.lit("M")), F.lit("dd"), F.lit("d"))).otherwise(order)
        order = F.when(m.contains("."), F.translate(order, "/", ".")).otherwise(order)
        return F.when(d.value.isNotNull() & F.year(d.value).between(1900, 2099), F.call_function("date_format", F.date_add(first, place), order))

    as_date = lambda y, mo, d: F.try_to_timestamp(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    parts = F.split(m, "[-/.]")
    read = lambda p: F.struct(F.when(iso, as_date(p[0], p[1], p[2])).otherwise(as_date(p[2], p[1], p[0])).alias("day_first"), F.when(~iso, as_date(p[2], p[0], p[1])).alias("month_first"))
    value = _let(_let(parts, read), lambda r: F.struct(F.coalesce(r.day_first, r.month_first).alias("value"), (r.day_first.isNull() & r.month_first.isNotNull()).alias("turned")))
    return _let(value, shown)


def _email(key: str, m: Column) -> Column:
    """Letters and digits of the local part: each is moved within a-z, A-Z or 0-9, the left and
    right halves in turn, by a keyed hash of the other half."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    n = F.length(local)
    cut = F.ceil(n / 2).cast("int")

    def moved(part: Column, other: Column, i: Column) -> Column:
        def at(j: Column) -> Column:
            c = F.substring(part, j, F.lit(1))
            code = F.ascii(c)
            shift = _round(key, F.concat(F.lit("email"), n.cast("string"), F.lit("."), j.cast("string")), i, other, F.lit(26 * 10 * 1000))
            low, size = F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97), F.when(c.rlike("[0-9]"), 10).otherwise(26)
            return F.when(c.rlike("[A-Za-z0-9]"), F.chr(low + (code - low + shift) % size)).otherwise(c)

        return F.when(F.length(part) == 0, part).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), at), ""))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, moved(s.l, s.r, i)).otherwise(s.l).alias("l"), F.when(odd, s.r).otherwise(moved(s.r, s.l, i)).alias("r"))

    start = F.struct(F.substring(local, F.lit(1), cut).alias("l"), F.substring(local, cut + 1, n).alias("r"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return _let(out, lambda o: F.concat(o.l, o.r, F.lit("@"), domain))


_MAKERS = {"email": _email, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date}


def _kind(m: Column) -> Column:
    kind = F.when(m.contains("@"), "email").when(m.contains("(") | m.startswith("+"), "phone").when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    kind = kind.when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
    kind = kind.when(m.rlike(r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}([/.])[0-9]{1,2}\2[0-9]{4})$"), "date")
    return kind.when(F.length(_only_digits(m)) < 13, "phone").otherwise("card")


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?:{pattern})"), F.lit(0))


def _found(key: str, matches: Column) -> Column:
    """Array of struct(kind, old, new) for each match; `new` is null where validation fails."""

    def one(m: Column) -> Column:
        def made(kind: Column) -> Column:
            new = F.lit(None).cast("string")
            for name in KINDS:
                new = F.when(kind == name, _MAKERS[name](key, m)).otherwise(new)
            return F.struct(kind.alias("kind"), m.alias("old"), new.alias("new"))

        return _let(_kind(m), made)

    return F.transform(matches, one)


def _searched(key: str, matches: Column) -> Column:
    """For each match an array of struct(kind, old, new) that make it up: itself, or
    where it is no card after all, what the strict patterns find in it and the text between."""

    def one(f: Column) -> Column:
        none = F.lit(None).cast("string")
        between = lambda p, g: F.array(F.struct(none.alias("kind"), p.alias("old"), none.alias("new")), F.coalesce(g, F.struct(none.alias("kind"), F.lit("").alias("old"), none.alias("new"))))
        inner = F.flatten(F.zip_with(F.split(f.old, _STRICT, -1), _found(key, _matches(f.old, _STRICT)), between))
        return F.when(f.new.isNull() & (f.kind == "card") & f.old.rlike("[^0-9]"), inner).otherwise(F.array(f))

    return F.transform(_found(key, matches), one)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with the text replaced and an array column `pii` of struct(kind, old, new) added."""
    at = f"c{docs.columns.index(text_col)}"
    text = F.col(at).cast("string")
    matches = F.when(text.contains("@"), _matches(text, _ALL)).when(text.rlike("[0-9]"), _matches(text, _DIGITS))
    cut = F.when(text.contains("@"), F.split(text, _ALL, -1)).otherwise(F.split(text, _DIGITS, -1))
    shown = lambda pieces: F.array_join(F.transform(pieces, lambda f: F.coalesce(f.new, f.old)), "")
    whole = F.array_join(F.flatten(F.zip_with(cut, "found", lambda p, f: F.array(p, F.coalesce(shown(f), F.lit(""))))), "")
    out = numbered(docs).withColumn("found", _searched(key, matches))
    out = out.withColumn(at, F.when(F.size("found") > 0, whole).otherwise(text))
    return renamed(out, docs, pii=F.when(F.col(at).isNotNull(), F.filter(F.flatten(F.coalesce("found", F.array())), lambda f: f.new.isNotNull())))
