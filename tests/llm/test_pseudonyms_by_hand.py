"""Pseudonyms once more in plain Python, on every document: detection, validation and Feistel rounds of its own."""

import datetime
import hashlib
import hmac
from collections import Counter

import regex
from pyspark.sql import functions as F

from tessera.llm import pii

KEY = "by-hand"
FIRST = datetime.date(1900, 1, 1)


def keyed(message):
    return hmac.new(hashlib.sha256(KEY.encode()).digest(), message.encode(), "sha256").hexdigest()


def feistel(a, size_a, b, size_b, tweak):
    for i in range(8):
        if i % 2 == 0:
            a = (a + int(keyed(f"{tweak}|{i}|{b}")[:15], 16) % size_a) % size_a
        else:
            b = (b + int(keyed(f"{tweak}|{i}|{a}")[:15], 16) % size_b) % size_b
    return a, b


def digits_of(x):
    return "".join(c for c in x if c in "0123456789")


def permuted(digits, tweak):
    n, u = len(digits), len(digits) // 2
    a, b = feistel(int(digits[:u] or 0), 10**u, int(digits[u:]), 10 ** (n - u), f"{tweak}|{n}")
    return f"{a:0{u}d}{b:0{n - u}d}" if u else f"{b:0{n}d}"


def refilled(shape, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in shape)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def card(m):
    d = digits_of(m)
    if luhn(d) and d.strip("0"):
        body = permuted(d[:-1], "card")
        return refilled(m, body + next(c for c in "0123456789" if luhn(body + c)))
    return None


def phone(m):
    d = digits_of(m)
    k = 0 if not m.startswith("+") else 1 if regex.match(pii.ONE, d) else 2 if regex.match(pii.TWO, d) else 3
    country, n = d[:k], d[k:]
    if regex.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", n):
        a, b = feistel(int(n[:3]) - 200, 800, int(n[3:]) - 2_000_000, 8_000_000, "phone")
        new = f"{a + 200}{b + 2_000_000}"
    else:
        new = permuted(n, "digits")
    return refilled(m, country + new)


def ip(m):
    o = [int(x) for x in m.split(".")]
    if max(o) > 255:
        return None
    a, b = feistel(o[0] * 256 + o[1], 65536, o[2] * 256 + o[3], 65536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def date(m):
    for form in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y"):
        try:
            day = datetime.datetime.strptime(m, form).date()
        except ValueError:
            continue
        n = (day - FIRST).days
        if not 0 <= n < 17 * 4297:
            return None

        def turn(n):
            a, b = feistel(n // 4297, 17, n % 4297, 4297, "date")
            return a * 4297 + b

        new = turn(n)
        while form == "%m/%d/%Y" and (FIRST + datetime.timedelta(new)).day <= 12:
            new = turn(new)
        return (FIRST + datetime.timedelta(new)).strftime(form)
    return None


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    a, b = feistel(area - 1 - (area > 666), 898, (group - 1) * 9999 + serial - 1, 99 * 9999, "ssn")
    return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def iban(m):
    x = m.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
    body = x[4:]
    d = digits_of(body)
    if number(body + x[:4]) != 1 or len(d) > 36:
        return None
    new = refilled(body, permuted(d, "iban")) if len(d) >= 2 else body
    return refilled(m, f"{98 - number(new + x[:2] + '00'):02d}" + digits_of(new))


def email(m):
    name = keyed(f"email|{m.lower()}")
    return f"u{name[:12]}@mail-{name[12:18]}.example"


def kind_of(m):
    shapes = {"email": "@", "iban": "^[A-Z]", "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$", "date": "^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})$", "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$"}
    return next((k for k, p in shapes.items() if regex.search(p, m)), "phone")


def cards(text, usual):
    """(text, is a pseudonym) pieces of a plain text."""
    out, at = [], 0
    for area in regex.finditer(pii.AREA, text):
        out.append((text[at : area.start()], None))
        at = area.end()
        groups = regex.split(r"(?<=[\x20-])(?=[0-9])", area[0], flags=regex.V1)
        plain, i = "", 0
        while i < len(groups):
            joined = "".join(groups[i : i + 19])
            runs = [m[0] for p in pii.CARDS if (m := regex.match(p, joined))]
            valid = [r for r in runs if luhn(digits_of(r)) and (not usual or regex.search(pii.USUAL, r)) and card(r)]
            if valid:
                n = len(regex.split(r"[\x20-]", valid[0]))
                out += [(plain, None), (card(valid[0]), "card")]
                plain = "".join(groups[i : i + n])[len(valid[0]) :]
                i += n
            else:
                plain += groups[i]
                i += 1
        out.append((plain, None))
    return [*out, (text[at:], None)]


MAKERS = {"email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone}


def rewritten(text):
    pieces, at, plain = [], 0, ""
    for m in regex.finditer(pii.ANY, text):
        plain += text[at : m.start()]
        at = m.end()
        kind = kind_of(m[0])
        new = MAKERS[kind](m[0])
        if new is None:
            plain += m[0]
        else:
            pieces += [(plain, None), (new, kind)]
            plain = ""
    pieces.append((plain + text[at:], None))
    for usual in (True, False):
        pieces = [p for t, kind in pieces for p in ([(t, kind)] if kind else cards(t, usual))]
    return "".join(t for t, _ in pieces), Counter(k for _, k in pieces if k)


ODD = [
    "call +1 (523) 555-1055, card 4785380592391139$$$ no 4785380592391130", "4785-3805-9239-1139 at 10.1.2.3 mail a.b@c.example.", "29/02/1984 1984-02-29 13/25/2000 12/25/2000 300.1.1.1 10.0.0.256",
    "GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", "123-45-6789 666-12-1234 000-12-1234 899-99-9999", "3782-822463-10005 1234 12 4111 1111 1111 1111 99", "+14155550123 +4930123456 212-555-0199 012-345-6789",
    "7 4111111111111111 12 4111111111111111 99.", "REF AB12 4111 1111 1111 1111 x 0000000000000000", "", "1899-12-31 2100-01-01 01/13/2020 5105105105105100",
]


def test_every_document_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1 - i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, KEY, ("doc_id", "text"), counts=True).collect()}
    kinds = Counter()
    for i, text in rows:
        want, found = rewritten(text)
        assert got[i]["text"] == want, (i, text)
        assert {k: got[i][f"n_{k}"] for k in pii.KINDS} == {k: found[k] for k in pii.KINDS}
        kinds += found
    assert set(kinds) == set(pii.KINDS)
