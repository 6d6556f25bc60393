"""Format-preserving Feistel pseudonyms for personal data (operator 5).

Numbers and dates that validate as what they look like are permuted within their own format by a keyed
Feistel network: a card number becomes another card number with a right check digit, a date another date.
The permutation is one to one and depends only on the key and the value's digits, so equal values stay
linked across documents, however they are punctuated. Mail addresses are not numbers; they get a keyed
name of a fixed shape, 72 bits of a keyed hash: equal addresses have equal names, different ones all but surely not.
Keyed hashes are HMACs of SHA-256; the key is part of the plan, so who may read plans and event logs may read it.

Everything is column expressions inside a row: no shuffle, no Python.

Defined results: a null text stays null and has no findings; an empty one stays empty; ids may be null or
repeated; an empty table gives an empty result; matches that don't validate (a wrong check digit, a month
13) stay as they are. Other columns of the input are not read. Cards are looked for in what the other kinds leave
(their failed matches too): 13 to 19 digits from the start of one digit group to the end of one, groups parted by
single blanks or hyphens. Every such run is tested, those of a usual card's shape first, then the rest, the longest
at each place first. Phones are ten digits written 3-3-4, with or without a country code, and + with 8 to 15 digits
without separators (E.164); other national groupings are not matched.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let

#: In order of precedence where two start at the same place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![A-Za-z0-9/-])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "phone": r"(?<![A-Za-z0-9+])(?:(?:\+[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}|\+[1-9][0-9]{7,14})(?![A-Za-z0-9-])",
}
KINDS = (*PATTERNS, "card")
ANY = "|".join(PATTERNS.values())
#: Where cards may be: digits, blanks and hyphens, and the word that ends them; character classes only, so that the matcher doesn't recurse.
AREA = r"(?<![A-Za-z0-9.])[0-9][0-9\x20-]{12,}+(?:[A-Za-z][A-Za-z0-9]*+)?+"
GROUP = r"(?<=[\x20-])(?=[0-9])"
CARDS = tuple(rf"^[0-9](?:[\x20-]?[0-9]){{{n - 1}}}(?![A-Za-z0-9])" for n in range(19, 12, -1))
#: How cards are written: without separators, 4-4-4-4, 4-6-5 and 4-6-4.
USUAL = r"^(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})$"
#: Country codes of one and of two digits; all others have three.
ONE, TWO = "^[17]", "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: A text without these holds none of the above.
HINT = r"[0-9]|@"
ROUNDS = 8
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 17, 4297  # 17 * 4297 days: up to 2099-12-31
#: Turns after which a month-first date has long left the days up to 12: two dates in five are among them.
WALK = 64


def _long(x) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")


def keyed(message: Column, key: str) -> Column:
    """HMAC of SHA-256, in hex."""
    block = hashlib.sha256(key.encode()).digest().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256)


def feistel(a: Column, size_a, b: Column, size_b, key: str, tweak: Column) -> Column:
    """A keyed permutation of pairs (a, b), a < size_a and b < size_b, as a struct of the two.

    Rounds add a keyed hash of one half to the other, modulo its size: one to one for halves of any sizes.
    """
    size_a, size_b = _long(size_a), _long(size_b)

    def mix(half: Column, i: Column, size: Column) -> Column:
        digest = keyed(F.concat_ws("|", tweak, i.cast("string"), half.cast("string")), key)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    def turn(s: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(((s["a"] + mix(s["b"], i, size_a)) % size_a).alias("a"), s["b"].alias("b"))
        ).otherwise(F.struct(s["a"].alias("a"), ((s["b"] + mix(s["a"], i, size_b)) % size_b).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_long(a).alias("a"), _long(b).alias("b")), turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """Digits of any number from 2 to 36, to as many digits."""

    def halves(n: Column) -> Column:
        u = F.floor(n / 2).cast("int")
        mixed = feistel(F.substring(digits, F.lit(1), u), _power(u), F.substring(digits, u + 1, n), _power(n - u), key, F.concat_ws("|", tweak, n.cast("string")))
        return let(mixed, lambda p: F.concat(F.lpad(p["a"].cast("string"), u, "0"), F.lpad(p["b"].cast("string"), n - u, "0")))

    return let(F.char_length(digits), halves)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    chars = F.split(shape, "")
    step = lambda acc, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substring(digits, acc["i"] + 1, F.lit(1))).alias("out"), (acc["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["i"].alias("i")))
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step)["out"]


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_digit(body: Column) -> Column:
    """The digit that makes ``body`` followed by it a valid card number."""
    return F.array_join(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: F.call_function("luhn_check", F.concat(body, d))), "")


def _card(m: Column, key: str) -> Column:
    def as_card(digits: Column) -> Column:
        body = permute_digits(F.substring(digits, F.lit(1), F.char_length(digits) - 1), key, F.lit("card"))
        return F.when(F.call_function("luhn_check", digits) & (F.char_length(F.regexp_replace(digits, "0", "")) > 0), let(body, lambda b: _refill(m, F.concat(b, _luhn_digit(b)))))

    return let(_only_digits(m), as_card)


def _phone(m: Column, key: str) -> Column:
    """Area and exchange codes start with 2 to 9, as they must; the country code stays."""
    country = lambda d: F.when(~m.startswith("+"), 0).when(d.rlike(ONE), 1).when(d.rlike(TWO), 2).otherwise(3)

    def as_phone(x: Column) -> Column:
        n = x["national"]
        area, rest = _long(F.substring(n, 1, 3)) - 200, _long(F.substring(n, 4, 7)) - 2_000_000
        plan = let(
            feistel(area, 800, rest, 8_000_000, key, F.lit("phone")),
            lambda p: F.concat((p["a"] + 200).cast("string"), (p["b"] + 2_000_000).cast("string")),
        )
        new = F.when(n.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), plan).otherwise(permute_digits(n, key, F.lit("digits")))
        return _refill(m, F.concat(x["country"], new))

    parts = lambda d: let(country(d), lambda k: F.struct(F.substring(d, F.lit(1), k).alias("country"), F.substring(d, k + 1, F.char_length(d)).alias("national")))
    return let(let(_only_digits(m), parts), as_phone)


def _ip(m: Column, key: str) -> Column:
    def as_ip(p: Column) -> Column:
        octets = F.transform(p, lambda x: x.cast("int"))
        mixed = feistel(octets[0] * 256 + octets[1], 65536, octets[2] * 256 + octets[3], 65536, key, F.lit("ip"))
        text = let(
            mixed,
            lambda h: F.concat_ws(".", *[F.floor(h["a"] / 256).cast("string"), (h["a"] % 256).cast("string"), F.floor(h["b"] / 256).cast("string"), (h["b"] % 256).cast("string")]),
        )
        return F.when(F.forall(octets, lambda o: o <= 255), text)

    return let(F.split(m, r"\."), as_ip)


def _date(m: Column, key: str) -> Column:
    """ISO dates, and dates with strokes read as day first, else as month first; from 1900 to 2099.

    A date that can only be month first becomes one of that kind, by permuting it until it is; so no two dates are written alike.
    """
    form = F.when(m.contains("-"), F.lit("yyyy-MM-dd")).when(F.try_to_date(m, "dd/MM/yyyy").isNotNull(), F.lit("dd/MM/yyyy")).otherwise(F.lit("MM/dd/yyyy"))
    day = F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(m, "dd/MM/yyyy"), F.try_to_date(m, "MM/dd/yyyy"))

    date = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))

    def permuted(n: Column) -> Column:
        return let(feistel(F.floor(n / DAYS_B), DAYS_A, n % DAYS_B, DAYS_B, key, F.lit("date")), lambda p: (p["a"] * DAYS_B + p["b"]).cast("int"))

    def as_date(n: Column) -> Column:
        walked = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x, lambda at, _: F.when(F.dayofmonth(date(at)) <= 12, permuted(at)).otherwise(at))
        new = let(permuted(n), lambda x: date(F.when(form == "MM/dd/yyyy", walked(x)).otherwise(x)))
        written = let(
            new,
            lambda d: F.when(form == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd")).when(form == "dd/MM/yyyy", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")),
        )
        return F.when((n >= 0) & (n < DAYS_A * DAYS_B), written)

    return let(F.datediff(day, F.lit(FIRST_DAY).cast("date")), as_date)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (_long(F.substring(m, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    mixed = feistel(area - 1 - F.when(area > 666, 1).otherwise(0), 898, (group - 1) * 9999 + serial - 1, 99 * 9999, key, F.lit("ssn"))
    number = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    text = let(
        mixed,
        lambda p: F.concat_ws("-", number(p["a"] + 1 + F.when(p["a"] >= 665, 1).otherwise(0), 3), number(F.floor(p["b"] / 9999) + 1, 2), number(p["b"] % 9999 + 1, 4)),
    )
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), text)


def _mod97(x: Column) -> Column:
    """Of a string of digits and capitals, letters counting as 10 to 35."""
    code = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.split(x, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97))


def _iban(m: Column, key: str) -> Column:
    """The digits after the check digits are permuted, the check digits made right again."""

    def as_iban(x: Column) -> Column:
        body = F.substring(x, F.lit(5), F.char_length(x))
        new = let(_only_digits(body), lambda d: F.when(F.char_length(d) >= 2, _refill(body, permute_digits(d, key, F.lit("iban")))).otherwise(body))
        check = lambda b: F.lpad((98 - _mod97(F.concat(b, F.substring(x, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        valid = _mod97(F.concat(body, F.substring(x, 1, 4))) == 1
        return F.when(valid & (F.char_length(_only_digits(body)) <= 36), let(new, lambda b: _refill(m, F.concat(check(b), _only_digits(b)))))

    return let(F.replace(m, F.lit(" "), F.lit("")), as_iban)


def _email(m: Column, key: str) -> Column:
    name = keyed(F.concat_ws("|", F.lit("email"), F.lower(m)), key)
    return F.concat(F.lit("u"), F.substring(name, 1, 12), F.lit("@"), F.lit("mail-"), F.substring(name, 13, 6), F.lit(".example"))


MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}
SEGMENT = "struct<kind:string,value:string,pseudonym:string>"


def _finding(m: Column, key: str) -> Column:
    """The kind of a match and its pseudonym, null where it doesn't validate."""
    shape = {
        "email": m.contains("@"),
        "iban": m.rlike("^[A-Z]"),
        "ip": m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"),
        "date": m.rlike("^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})$"),
        "ssn": m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    }
    kind, new = F.lit("phone"), _phone(m, key)
    for k in reversed(shape):
        kind, new = F.when(shape[k], F.lit(k)).otherwise(kind), F.when(shape[k], MAKERS[k](m, key)).otherwise(new)
    return F.struct(kind.alias("kind"), m.alias("value"), new.alias("pseudonym")).cast(SEGMENT)


def _plain(text: Column) -> Column:
    return F.struct(F.lit(None).alias("kind"), text.alias("value"), F.lit(None).alias("pseudonym")).cast(SEGMENT)


def _others(text: Column, key: str) -> Column:
    """The text in segments: valid matches, and what is between them, failed matches included."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _finding(m, key))

    def step(acc: Column, x: Column) -> Column:
        valid = F.struct(F.concat(acc["out"], F.array(_plain(acc["text"]), x["found"])).alias("out"), x["after"].alias("text"))
        return F.when(x["found"]["pseudonym"].isNotNull(), valid).otherwise(F.struct(acc["out"].alias("out"), F.concat(acc["text"], x["found"]["value"], x["after"]).alias("text")))

    def join(s: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{SEGMENT}>").alias("out"), s[0].alias("text"))
        both = F.transform(found, lambda f, i: F.struct(f.alias("found"), s[i + 1].alias("after")))
        return F.aggregate(both, start, step, lambda acc: F.concat(acc["out"], F.array(_plain(acc["text"]))))

    return let(F.split(text, ANY, -1), join)


def _in_area(area: Column, key: str, usual: bool) -> Column:
    """The segments of an area: from left to right, at each digit group the longest valid card."""

    def card(groups: Column, i: Column) -> Column:
        def valid(x: Column) -> Column:
            return F.struct(F.lit("card").alias("kind"), x.alias("value"), _card(x, key).alias("pseudonym")).cast(SEGMENT)

        runs = let(F.array_join(F.slice(groups, i + 1, 19), ""), lambda j: F.array(*[F.regexp_extract(j, c, 0) for c in CARDS]))
        runs = F.filter(runs, lambda x: (x != "") & (x.rlike(USUAL) if usual else F.lit(True)) & F.call_function("luhn_check", _only_digits(x)))
        return F.get(F.filter(F.transform(runs, valid), lambda x: x["pseudonym"].isNotNull()), F.lit(0))

    def scan(groups: Column) -> Column:
        # ``next`` is the first group that isn't in a segment yet, ``text`` what stands before it.
        def step(acc: Column, i: Column) -> Column:
            def taken(c: Column) -> Column:
                n = F.size(F.split(c["value"], r"[\x20-]"))
                before = _plain(F.concat(acc["text"], F.array_join(F.slice(groups, acc["next"] + 1, i - acc["next"]), "")))
                rest = F.substring(F.array_join(F.slice(groups, i + 1, n), ""), F.char_length(c["value"]) + 1, F.char_length(area))
                new = F.struct(F.concat(acc["out"], F.array(before, c)).alias("out"), (i + n).alias("next"), rest.alias("text"))
                return F.when(c["value"].isNotNull(), new).otherwise(acc)

            return F.when(i < acc["next"], acc).otherwise(let(card(groups, i), taken))

        start = F.struct(F.array().cast(f"array<{SEGMENT}>").alias("out"), F.lit(0).alias("next"), F.lit("").alias("text"))
        end = lambda acc: F.concat(acc["out"], F.array(_plain(F.concat(acc["text"], F.array_join(F.slice(groups, acc["next"] + 1, F.size(groups)), "")))))
        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, end)

    return let(F.split(area, GROUP, -1), scan)


def _cards(text: Column, key: str, usual: bool) -> Column:
    areas = F.regexp_extract_all(text, F.lit(AREA), F.lit(0))
    return let(
        F.split(text, AREA, -1),
        lambda s: F.concat(F.flatten(F.transform(areas, lambda a, i: F.concat(F.array(_plain(s[i])), _in_area(a, key, usual)))), F.array(_plain(s[F.size(s) - 1]))),
    )


def segments(text: Column, key: str) -> Column:
    """The whole text, in order, as structs of kind, value and pseudonym; the first and last are null for what stays."""

    def within(usual: bool):
        return lambda x: F.when(x["kind"].isNull() & x["value"].rlike(AREA), _cards(x["value"], key, usual)).otherwise(F.array(x))

    return F.flatten(F.transform(F.flatten(F.transform(_others(text, key), within(True))), within(False)))


def rewritten(text: Column, found: Column) -> Column:
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda f: F.coalesce(f["pseudonym"], f["value"])), "")).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, columns: tuple[str, ...], counts: bool = False, text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs``, the text rewritten; with ``counts`` also n_<kind>: values replaced by kind."""
    names = [f"__c{i}" for i in range(len(columns))]
    d = docs.select(*[docs[c].alias(n) for c, n in zip(columns, names)], docs[text_col].alias("__t"))
    t = F.col("__t")
    d = d.withColumn("__f", F.when(t.rlike(HINT), segments(t, key)).otherwise(F.array().cast(f"array<{SEGMENT}>")))
    out = [rewritten(t, F.col("__f")).alias(c) if c == text_col else F.col(n).alias(c) for c, n in zip(columns, names)]
    if counts:
        replaced = lambda k: F.filter("__f", lambda f: (f["kind"] == k) & f["pseudonym"].isNotNull())
        out += [F.size(replaced(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select(*out)
