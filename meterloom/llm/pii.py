"""Format-preserving pseudonyms for personal data, with SQL functions only.

One regular expression finds candidates in the whole text; validation decides what each is; a keyed
permutation replaces it within its format, so that equal values get equal pseudonyms everywhere,
different values of a kind get different ones, and the key gives the values back (``restore_pii``):

* card     13 to 19 digits, in one run or in groups, that pass the Luhn check: all digits but the
           last are permuted, the check digit is computed again. ``cards="any"`` (the default) also
           takes runs of 16 digits that fail the check: the pseudonym fails it by as much.
* phone    +country number, in groups or not: the digits after the country code (by the list of codes)
           are permuted, whatever the writing; (0) after the code stays. North American numbers also
           without +1, as (ddd) ddd-dddd, ddd-ddd-dddd or ddd.ddd.dddd; their area and exchange stay
           valid, or stay invalid.
* ssn      ddd-dd-dddd with a valid area, group and serial number: the area stays, group (01 to 99) and
           serial (0001 to 9999) are permuted.
* iban     two letters, two check digits, 11 to 30 letters and digits with check 97: the account's digits
           are permuted, the check digits are computed again.
* ip       four octets of 0 to 255 without leading zeros: permuted as one 32-bit number.
* date     yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy or mm-dd-yyyy (day first if the first number
           is over 12), a day that exists in the years 1900 to 2099: permuted among the days of its
           class (1 to 12, 13 to 28, 29, 30, 31 of the month, February 29), so a day first stays one.
* email    one way: the address and the domain become keyed hex names, as user.HEX@HEX.example.
* secret   one way: runs of 32 or more hex digits with both letters and digits: keyed hex of that length.
* token    one way: keys with a vendor's prefix, which stays; letters and digits become others, case kept.

The permutation is a Feistel network of eight rounds on two numbers, (l, r) in Z_a x Z_b, each round
adding a keyed MD5 value of one to the other; being a permutation of exactly that product it needs no
cycle walking. One-way names have 80 bits or more, so two of n values share one with a chance of
n*n/2**81. What doesn't validate stays as it is, and so do null texts; punctuation and spacing
around a value stay too. The key is a parameter and belongs in a secret store. Repeated rows are
replaced alike; other columns, whatever their names, pass unchanged; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8

# Prefixes of keys, and what follows them.
TOKENS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|rk)_(?:live|test)_[0-9A-Za-z]{16,}|gh[pousr]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{22,}"
    r"|xox[abprs]-[0-9A-Za-z\-]{10,}|AIza[0-9A-Za-z_\-]{35}|sk-[0-9A-Za-z_\-]{20,}|hf_[0-9A-Za-z]{30,}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,}"
)
PREFIX = r"^(?:AKIA|ASIA|(?:sk|pk|rk)_(?:live|test)_|gh[pousr]_|github_pat_|xox[abprs]-|AIza|sk-|hf_|eyJ)"
# What the scan takes as candidates, in order of preference.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.)+[A-Za-z]{2,24}",
    "token": rf"(?<![A-Za-z0-9_\-])(?:{TOKENS})(?![A-Za-z0-9_])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+(?:1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|\d{1,3}(?:[ .\-]?\(0\))?(?:[ .\-]?\(?\d{2,4}\)?){2,5})(?!\d)",
    "national": r"(?<![\w+(.\-])(?:\([2-9]\d\d\) ?|[2-9]\d\d[.\-])[2-9]\d\d[.\-]\d{4}(?![\d\-]|\.\d)",
    "date": r"(?<![\d./\-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})(?![\d/\-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)",
}
CANDIDATE = "|".join(PATTERNS.values())
#: Without a match of this, a text has no candidate; cheap to test.
HINT = r"@|\d\d|\d\.\d|[0-9a-fA-F]{32}|[_\-][0-9A-Za-z_\-]{10}|AKIA|ASIA|AIza|eyJ"
# The country codes of one and of two digits; all others have three.
ONE, TWO = "^[17]", "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Kinds whose pseudonyms the key does not undo.
ONE_WAY = ("email", "secret", "token")


def _keyed(key: str, *parts: Column) -> Column:
    """A number below 2**52 from the key and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("long")


def _feistel(l: Column, r: Column, a: Column, b: Column, key: str, kind: str, back: bool) -> Column:
    """struct(l, r) of the permuted pair, or with ``back`` of the pair that is permuted to this one; a and b
    are the (positive) moduli."""
    start = F.struct(*(x.cast("long").alias(n) for x, n in ((l, "l"), (r, "r"), (a, "a"), (b, "b"))))
    sign = -1 if back else 1

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        n = _keyed(key, F.lit(kind), i, acc["a"], acc["b"], F.when(even, acc["r"]).otherwise(acc["l"]))
        new_l = F.when(even, F.pmod(acc["l"] + sign * (n % acc["a"]), acc["a"])).otherwise(acc["l"])
        new_r = F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + sign * (n % acc["b"]), acc["b"]))
        return F.struct(new_l.alias("l"), new_r.alias("r"), acc["a"].alias("a"), acc["b"].alias("b"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step)


def _let(value: Column, f) -> Column:
    """f(value), the value being computed once."""
    return F.transform(F.array(value), f)[0]


def _number(c: Column) -> Column:
    return c.cast("long")


def _padded(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _permuted(d: Column, key: str, kind: str, back: bool = False) -> Column:
    """A digit string of up to 34 digits, permuted among those of its length: halves of at most 17. One
    of less than two digits stays."""
    def halves(d: Column) -> Column:
        n = F.length(d)
        h = F.floor(n / 2).cast("int")
        pair = _feistel(F.substr(d, F.lit(1), h), F.substr(d, h + 1), _ten(h), _ten(n - h), key, kind, back)
        return F.when(n < 2, d).otherwise(_let(pair, lambda p: F.concat(_padded(p["l"], h), _padded(p["r"], n - h))))

    return _let(d, halves)


def _poured(m: Column, d: Column, skip: Column | int = 0, taken: str = "[0-9]") -> Column:
    """``m`` with its characters of the class ``taken``, after the first ``skip``, replaced by those of ``d`` in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        mine = c.rlike(taken)
        new = F.when(mine & (acc["k"] >= skip), F.substr(d, acc["k"] - skip + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["k"] + mine.cast("int")).alias("k"))

    return F.aggregate(F.split(m, ""), start, step, lambda acc: acc["out"])


def _luhn_sum(d: Column) -> Column:
    """The Luhn sum of a digit string whose last digit counts singly."""
    def add(acc: Column, i: Column) -> Column:
        v = F.substr(d, F.length(d) - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return acc + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)


def _luhn_digit(body: Column) -> Column:
    return F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))


def _card(m: Column, key: str, back: bool) -> Column:
    def new(d: Column) -> Column:
        body, last = F.substr(d, F.lit(1), F.length(d) - 1), F.substr(d, F.length(d), F.lit(1)).cast("int")
        off = last - _luhn_digit(body)
        return _let(_permuted(body, key, "card", back), lambda p: F.concat(p, F.pmod(_luhn_digit(p) + off, F.lit(10)).cast("string")))

    return _poured(m, _let(_digits(m), new))


def _rest_97(s: Column) -> Column:
    """The remainder of 97 of country, check digits and account, moved and read as an IBAN is."""
    moved = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _iban(m: Column, key: str, back: bool) -> Column:
    def new(s: Column) -> Column:
        country, account = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5))
        moved = _poured(account, _permuted(_digits(account), key, "iban", back))
        return _let(moved, lambda a: F.concat(country, _padded(98 - _rest_97(F.concat(country, F.lit("00"), a)), 2), a))

    return _poured(m, _let(F.regexp_replace(m, " ", ""), new), taken="[0-9A-Z]")


def _north_american(ten: Column, key: str, back: bool) -> Column:
    """Ten digits: area and exchange from 200 on are permuted among such, others among the others."""
    parts = F.struct(*(F.substr(ten, F.lit(at), F.lit(n)).cast("long").alias(name) for name, at, n in (("area", 1, 3), ("exchange", 4, 3), ("line", 7, 4))))

    def new(d: Column) -> Column:
        area, exchange = d["area"], d["exchange"]
        valid = (area >= 200) & (exchange >= 200)
        l = F.when(valid, (area - 200) * 800 + exchange - 200).when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        pair = _feistel(l, d["line"], F.when(valid, 640_000).otherwise(360_000), F.lit(10_000), key, "phone", back)

        def written(p: Column) -> Column:
            x = p["l"]
            six = (
                F.when(p["a"] == 640_000, (F.floor(x / 800) + 200) * 1000 + x % 800 + 200)
                .when(x < 200_000, x)
                .otherwise((F.floor((x - 200_000) / 200) + 200) * 1000 + (x - 200_000) % 200)
            )
            return F.concat(_padded(six, 6), _padded(p["r"], 4))

        return _let(pair, written)

    return _let(parts, new)


def _phone(m: Column, key: str, back: bool) -> Column:
    def new(x: Column) -> Column:
        d = x["d"]
        code = F.when(~x["shown"].startswith("+"), 0).when(d.rlike(ONE), 1).when(d.rlike(TWO), 2).otherwise(3)
        return _let(F.struct(x["shown"].alias("shown"), code.alias("code"), F.substr(d, code + 1).alias("own")), poured)

    def poured(x: Column) -> Column:
        american = (x["code"] < 2) & (F.length(x["own"]) == 10) & ~x["shown"].rlike(r"^\+7")
        own = F.when(american, _north_american(x["own"], key, back)).otherwise(_permuted(x["own"], key, "phone", back))
        return F.replace(_poured(x["shown"], own, x["code"]), F.lit("(o)"), F.lit("(0)"))

    shown = F.replace(m, F.lit("(0)"), F.lit("(o)"))
    return _let(F.struct(shown.alias("shown"), _digits(shown).alias("d")), new)


def _ssn(m: Column, key: str, back: bool) -> Column:
    d = _digits(m)
    pair = _feistel(_number(F.substr(d, F.lit(4), F.lit(2))) - 1, _number(F.substr(d, F.lit(6))) - 1, F.lit(99), F.lit(9999), key, "ssn", back)
    return _let(pair, lambda p: F.concat(F.substr(m, F.lit(1), F.lit(4)), _padded(p["l"] + 1, 2), F.lit("-"), _padded(p["r"] + 1, 4)))


def _day_first(m: Column) -> Column:
    return m.contains(".") | (m.rlike(r"^\d\d[/\-]") & (F.substr(m, F.lit(1), F.lit(2)) > "12"))


def _day(m: Column) -> Column:
    """The date that a candidate writes, else null."""
    plain = F.regexp_replace(m, "[/.]", "-")
    day = F.when(m.rlike(r"^\d{4}"), F.try_to_date(plain, "yyyy-MM-dd")).when(_day_first(m), F.try_to_date(plain, "dd-MM-yyyy")).otherwise(F.try_to_date(plain, "MM-dd-yyyy"))
    return F.when(F.year(day).between(1900, 2099), day)


# The months with 31 days.
LONG_MONTHS = (1, 3, 5, 7, 8, 10, 12)


def _date(m: Column, key: str, back: bool) -> Column:
    among = F.array(*map(F.lit, LONG_MONTHS))

    def new(day: Column) -> Column:
        return _let(F.struct((F.year(day) - 1900).alias("y"), F.month(day).alias("mo"), F.dayofmonth(day).alias("d")), permuted)

    def permuted(x: Column) -> Column:
        # the class of days, as a product of two ranges
        y, mo, d = x["y"], x["mo"], x["d"]
        leap, early, late = (mo == 2) & (d == 29), d <= 12, d.between(13, 28)
        l = F.when(d <= 28, y * 12 + mo - 1).when(leap, F.floor((y - 4) / 28)).otherwise(y)
        r = F.when(early, d - 1).when(late, d - 13).when(leap, F.floor((y - 4) / 4) % 7).when(d == 31, F.array_position(among, mo) - 1).otherwise(F.greatest(mo - 2, F.lit(0)))
        a = F.when(d <= 28, 2400).when(leap, 7).otherwise(200)
        b = F.when(early, 12).when(late, 16).when(leap | (d == 31), 7).otherwise(11)

        def parts(p: Column) -> Column:
            year = F.when(d <= 28, F.floor(p["l"] / 12)).when(leap, p["l"] * 28 + p["r"] * 4 + 4).otherwise(p["l"]) + 1900
            month = F.when(d <= 28, p["l"] % 12 + 1).when(leap, 2).when(d == 31, F.element_at(among, (p["r"] + 1).cast("int"))).otherwise(F.when(p["r"] == 0, 1).otherwise(p["r"] + 2))
            dom = F.when(early, p["r"] + 1).when(late, p["r"] + 13).otherwise(d)
            return _let(F.struct(year.cast("string").alias("y"), _padded(month, 2).alias("m"), _padded(dom, 2).alias("d")), written)

        return _let(_feistel(l, r, a, b, key, "date", back), parts)

    def written(t: Column) -> Column:
        text = F.when(m.rlike(r"^\d{4}"), F.concat_ws("-", t["y"], t["m"], t["d"])).when(_day_first(m), F.concat_ws("-", t["d"], t["m"], t["y"])).otherwise(F.concat_ws("-", t["m"], t["d"], t["y"]))
        return F.replace(text, F.lit("-"), F.regexp_extract(m, "[^0-9]", 0))

    return _let(_day(m), new)


def _ip(m: Column, key: str, back: bool) -> Column:
    def new(o: Column) -> Column:
        pair = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip", back)
        return _let(pair, lambda p: F.concat_ws(".", *((F.floor(v / 256) if hi else v % 256).cast("string") for v in (p["l"], p["r"]) for hi in (1, 0))))

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), new)


def _hex(m: Column, key: str, kind: str, n: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), m), 256), 1, n)


def _email(m: Column, key: str) -> Column:
    low = F.lower(m)
    return F.concat(F.lit("user."), _hex(low, key, "email", 20), F.lit("@"), _hex(F.substring_index(low, "@", -1), key, "domain", 20), F.lit(".example"))


def _secret(m: Column, key: str) -> Column:
    some = F.transform(F.sequence(F.lit(0), F.floor(F.length(m) / 64).cast("int")), lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), i.cast("string"), F.lower(m)), 256))
    new = F.substr(F.array_join(some, ""), F.lit(1), F.length(m))
    return F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new)


def _token(m: Column, key: str) -> Column:
    kept = F.length(F.regexp_extract(m, PREFIX, 0))
    low, up = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def other(c: Column, i: Column) -> Column:
        n = _keyed(key, F.lit("token"), i, m)
        at = (n % 26 + 1).cast("int")
        new = F.when(c.between("0", "9"), (n % 10).cast("string")).when(c.between("a", "z"), F.substr(low, at, F.lit(1))).when(c.between("A", "Z"), F.substr(up, at, F.lit(1))).otherwise(c)
        return F.when(i < kept, c).otherwise(new)

    return F.array_join(F.transform(F.split(m, ""), other), "")


def kind_of(m: Column, cards: str = "any") -> Column:
    """What a candidate is once validated; null if it is nothing."""
    d = _digits(m)
    full = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    card = F.length(d).between(13, 19) & (_luhn_sum(d) % 10 == 0)
    if cards == "any":
        card = card | d.rlike(r"^\d{16}$")
    octet = r"^(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])$"
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(full["secret"]) & m.rlike("[a-fA-F]") & m.rlike(r"\d"), "secret")
        .when(m.rlike(full["token"]), "token")
        .when(m.rlike(full["iban"]), F.when((_rest_97(F.regexp_replace(m, " ", "")) == 1) & F.substr(m, F.lit(3), F.lit(2)).between("02", "98"), "iban"))
        .when(m.startswith("+"), F.when(F.length(_digits(F.replace(m, F.lit("(0)"), F.lit("")))).between(8, 15), "phone"))
        .when(m.rlike(full["national"]), "phone")
        .when(m.rlike(full["date"]), F.when(_day(m).isNotNull(), "date"))
        .when(m.rlike(full["ip"]), F.when(F.forall(F.split(m, r"\."), lambda x: x.rlike(octet)), "ip"))
        .when(m.rlike(full["ssn"]), F.when(~m.rlike(r"^(?:000|666|9\d\d)|-00-|-0000$"), "ssn"))
        .when(m.rlike(full["card"]) & card, "card")
    )


def pseudonym(m: Column, kind: Column, key: str, back: bool = False) -> Column:
    """What replaces a value of a kind; with ``back``, the value that was replaced by this one."""
    out = F.when(kind == "card", _card(m, key, back))
    for name, f in (("phone", _phone), ("ssn", _ssn), ("iban", _iban), ("ip", _ip), ("date", _date)):
        out = out.when(kind == name, f(m, key, back))
    if not back:
        out = out.when(kind == "email", _email(m, key)).when(kind == "secret", _secret(m, key)).when(kind == "token", _token(m, key))
    return out.otherwise(m)


def pseudonymised(text: Column, key: str, cards: str = "any", back: bool = False) -> Column:
    """struct(text, kinds): the text with its personal data replaced, and the kinds found, in order."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    between = F.split(text, CANDIDATE, -1)
    known = F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m, cards).alias("kind")))
    new = F.transform(known, lambda x: F.struct(pseudonym(x["m"], x["kind"], key, back).alias("m"), x["kind"].alias("kind")))

    def whole(pairs: Column) -> Column:
        # the last piece between candidates has no candidate after it
        joined = F.zip_with(between, pairs, lambda t, x: F.concat(t, F.coalesce(x["m"], F.lit(""))))
        kinds = F.filter(F.transform(pairs, lambda x: x["kind"]), lambda k: k.isNotNull())
        return F.struct(F.array_join(joined, "").alias("text"), kinds.alias("kinds"))

    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike(HINT), _let(new, whole)).otherwise(none)


def _replaced(docs: DataFrame, key: str, cards: str, kinds: str | None, back: bool) -> DataFrame:
    tmp = fresh(docs, "pii_out")
    out = docs.withColumn(tmp, pseudonymised(F.col("text"), key, cards, back))
    cols = [F.col(f"{tmp}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols, *([F.col(f"{tmp}.kinds").alias(fresh(docs, kinds))] if kinds else []))


def replace_pii(docs: DataFrame, key: str = "meterloom", cards: str = "any", kinds: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; with ``kinds``, a column of that name (with underscores after
    it if ``docs`` has such a column) lists what was found."""
    return _replaced(docs, key, cards, kinds, False)


def restore_pii(docs: DataFrame, key: str = "meterloom", cards: str = "any") -> DataFrame:
    """``docs``, as replace_pii returned them, with the values that its permutations replaced; one-way
    pseudonyms (email, secret, token) stay."""
    return _replaced(docs, key, cards, None, True)
