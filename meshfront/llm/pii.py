"""Format-preserving pseudonyms for personal data by keyed Feistel permutations (native).

Candidates come from one pattern; a candidate counts only if it validates: card numbers by the Luhn sum, IBANs by their country's length and the check digits, IPv4 addresses by their octets, social
security numbers by the ranges in use, phone numbers by their count of digits (8 to 15), dates by the calendar. Each kind is a pair of residues (l mod a, r mod b). Alternating rounds add a
keyed hash of one to the other, which permutes the a * b values of the kind whatever the moduli; where the product exceeds the kind, what falls outside is permuted again until it is inside (cycle walking). So equal
values get equal pseudonyms in all documents, different values different ones, and the result has the format of the input: separators stay, a card number or IBAN keeps right check digits, a date stays a date of the
same layout. Addresses of e-mail have no such domain; they get a keyed digest, which links equal ones too.

Card numbers are sought in the whole run of digit groups around them (4-4-4-4 and, last in a run, 4-6-5), so a year or another number beside one doesn't hide it.
A date or social security number that doesn't validate still takes its text; what overlaps one isn't sought. A date with slashes is read day first, or month first if that is the only reading;
its pseudonym is written month first too and has that one reading again, since days after the 12th get days after the 12th. A phone number's country code, cut by the table of codes, stays; one without "+" is permuted as a
whole, so it isn't linked to its international form.

Other texts stay as they are: among them IPv6 addresses, social security numbers without hyphens, dates with one-digit days or two-digit years, and dates outside 1900-2099. Defined cases: null gives null and no
findings, an empty text is unchanged; very long texts are worked on whole; rows are worked on one by one, so repeated rows, ties and empty tables need no rule. Columns besides the text are kept whatever their
names; a count whose name is taken gets underscores before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshfront.llm.common import free_name

KINDS = ("email", "phone", "ipv4", "ssn", "card", "date", "iban")
ROUNDS = 10

#: Candidate patterns. None has a nested repetition without a bound, so very long texts need no deep recursion.
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+){1,8}",
    "ipv4": r"(?<![0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\p{L}\p{N}])|\([0-9]{3}\) ?[0-9]{3}[-.][0-9]{4}(?![\p{L}\p{N}])|[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\p{L}\p{N}-])|[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![\p{L}\p{N}]|\.[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "card": r"[0-9]{4}(?:[ -][0-9]{4})*[ -][0-9]{6}[ -][0-9]{5}(?![\p{L}\p{N}])|[0-9]{4}(?:[ -][0-9]{4}){3,}(?![\p{L}\p{N}])|[0-9]{13,19}(?![\p{L}\p{N}])",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\p{L}\p{N}-])|[0-9]{2}/[0-9]{2}/[0-9]{4}(?![\p{L}\p{N}/])|[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![\p{L}\p{N}])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "XK": 20,
}
#: Country codes of one and two digits, as a pattern; all others have three.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
CANDIDATE = r"(?<![\p{L}\p{N}])(?:" + "|".join(PATTERNS.values()) + ")"
#: A card number at the start of a card candidate, which is a run of groups of four digits.
CARD = r"^(?:(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|[0-9]{13,19}$)"
#: What any candidate has; texts without it are passed on after one quick search.
HINT = r"@|[0-9][0-9 ().+/-]{5,}[0-9]"

_POWERS = [10**k for k in range(19)]
#: Days from 1900-01-01 to 2099-12-31. Those up to the 12th of a month and those after it are permuted among themselves: how many, and the sides of a product that holds them, with one value outside for the later ones.
DAYS, _EARLY, _LATE = 73_049, (28_800, 160, 180), (44_249, 250, 177)
_LAYOUTS = (("^[0-9]{4}-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), ("/", "MM/dd/yyyy"), (r"\.", "dd.MM.yyyy"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a digit string whose last digit is the check digit."""
    at = F.sequence(F.lit(1), F.length(digits))

    def share(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(at, share), F.lit(0), lambda x, y: x + y) % 10


def _power(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(p).cast("long") for p in _POWERS)), n.cast("int") + 1)


def _feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """``struct(l, r)``: the permuted pair. Each round is undone by subtracting what it added, so it is a permutation."""

    def keyed(value: Column, i: Column, most: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tweak, a.cast("string"), b.cast("string"), i.cast("string"), value.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long") % most

    def turn(x: Column, i: Column) -> Column:
        l, r = x["l"], x["r"]
        return F.when(i % 2 == 0, F.struct(((l + keyed(r, i, a)) % a).alias("l"), r.alias("r"))).otherwise(F.struct(l.alias("l"), ((r + keyed(l, i, b)) % b).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _refill(layout: Column, digits: Column) -> Column:
    """The layout with its digits replaced in order."""

    def at(i: Column) -> Column:
        c = F.substring(layout, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(layout, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(layout)), at), "")


def _refill_all(layout: Column, text: Column) -> Column:
    """The layout with its zeros replaced by the characters of ``text`` in order."""

    def at(i: Column) -> Column:
        c = F.substring(layout, i, F.lit(1))
        return F.when(c == "0", F.substring(text, F.length(_digits(F.substring(layout, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(layout)), at), "")


def _permuted_digits(digits: Column, tweak: str | Column, key: str) -> Column:
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    pair = _feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half), _power(half), _power(n - half), tweak, key)
    return F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["l"].cast("string"), half, F.lit("0")), F.lpad(p["r"].cast("string"), n - half, F.lit("0"))))[0]


def _email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@example.invalid"))


def _phone(m: Column, key: str) -> Column:
    """The country code stays and the other digits are permuted, whatever parts them, so a number has one pseudonym in all layouts."""

    def text(digits: Column) -> Column:
        code = F.when(m.startswith("+"), F.regexp_extract(digits, COUNTRY, 0)).otherwise("")
        new = F.transform(F.array(code), lambda c: F.concat(c, _permuted_digits(F.substring(digits, F.length(c) + 1, F.length(digits)), "phone", key)))[0]
        return F.transform(F.array(new), lambda d: _refill(m, d))[0]

    return F.transform(F.array(_digits(m)), text)[0]


def _ipv4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    whole = F.lit(65536).cast("long")
    pair = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], whole, whole, F.lit("ipv4"), key)
    return F.transform(F.array(pair), lambda p: F.concat_ws(".", *(x.cast("string") for h in ("l", "r") for x in (F.shiftright(p[h], 8), p[h] % 256))))[0]


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (x.cast("long") for x in (F.substring(m, 1, 3), F.substring(m, 5, 2), F.substring(m, 8, 4)))
    left = area - F.when(area > 666, 2).otherwise(1)
    pair = _feistel(left, (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), F.lit("ssn"), key)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.transform(F.array(pair), lambda p: F.concat_ws("-", pad(p["l"] + F.when(p["l"] >= 665, 2).otherwise(1), 3), pad(F.floor(p["r"] / 9999) + 1, 2), pad(p["r"] % 9999 + 1, 4)))[0]


def _card(m: Column, key: str) -> Column:
    body = _permuted_digits(F.substring(_digits(m), F.lit(1), F.length(_digits(m)) - 1), "card", key)
    checked = F.transform(F.array(body), lambda d: F.concat(d, ((10 - _luhn(F.concat(d, F.lit("0")))) % 10).cast("string")))[0]
    return F.transform(F.array(checked), lambda d: _refill(m, d))[0]


def _cards(m: Column) -> Column:
    """``(at, text)`` of each valid card number in a run of digit groups, from the left; of two that overlap the first counts."""

    def step(state: Column, i: Column) -> Column:
        at = i * 5 + 1
        starts = (at >= state["next"]) & ((i == 0) | ~F.substring(m, i * 5, F.lit(1)).rlike("[0-9]"))
        piece = F.when(starts, F.nullif(F.regexp_extract(F.substring(m, at, F.lit(20)), CARD, 0), F.lit("")))
        valid = F.transform(F.array(piece), lambda p: F.when(p.isNotNull(), F.when(_luhn(_digits(p)) == 0, p)))
        more = lambda p: F.struct((at + F.length(p)).alias("next"), F.concat(state["cards"], F.array(F.struct(at.alias("at"), p.alias("text")))).alias("cards"))
        return F.transform(valid, lambda p: F.when(p.isNull(), state).otherwise(more(p)))[0]

    none = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,text:string>>").alias("cards"))
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.length(m) / 5).cast("int")), none, step)["cards"]


def _card_run(m: Column, key: str) -> Column:
    """The run with its card numbers replaced and all else as it was."""

    def joined(cards: Column) -> Column:
        end = lambda i: F.coalesce(F.get(cards, i)["at"] + F.length(F.get(cards, i)["text"]), F.lit(1))
        parts = F.transform(cards, lambda c, i: F.concat(F.substring(m, end(i - 1), c["at"] - end(i - 1)), _card(c["text"], key)))
        return F.concat(F.array_join(parts, ""), F.substring(m, end(F.size(cards) - 1), F.length(m)))

    return F.transform(F.array(_cards(m)), joined)[0]


def _remainder(rearranged: Column) -> Column:
    """The number that the letters (A is 10) and digits spell, modulo 97."""
    at = F.transform(F.split(rearranged, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(at, F.lit(0), lambda n, d: F.when(d < 10, n * 10 + d).otherwise(n * 100 + d) % 97)


def _iban_length(m: Column) -> Column:
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    return F.try_element_at(lengths, F.substring(m, 1, 2))


def _valid_iban(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    right = _remainder(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1
    return F.coalesce((F.length(plain) == _iban_length(m)) & right, F.lit(False))


def _iban(m: Column, key: str) -> Column:
    """Country and letters stay; the account's digits are permuted, by country and place of the letters, and the check digits follow."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    body = F.substring(plain, F.lit(5), F.length(plain))
    shape = F.concat(F.substring(plain, 1, 2), F.regexp_replace(body, "[0-9]", "0"))
    new = F.transform(F.array(body), lambda x: _refill(x, _permuted_digits(_digits(x), F.concat(F.lit("iban"), shape), key)))[0]
    check = F.transform(F.array(new), lambda x: F.concat(F.lpad((98 - _remainder(F.concat(x, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0"), x))[0]
    spaced = F.regexp_replace(F.substring(m, F.lit(3), F.length(m)), "[A-Z0-9]", "0")
    whole = F.transform(F.array(check), lambda x: _refill_all(spaced, x))[0]
    return F.concat(F.substring(m, 1, 2), whole)


def _day(m: Column, layout: str) -> Column:
    day = F.try_to_timestamp(m, F.lit(layout)).cast("date")
    return F.datediff(day, F.lit("1900-01-01").cast("date"))


def _layout(m: Column) -> Column:
    """The first layout in which the text is a day of the domain, as a struct of its name and the day."""
    found = F.lit(None).cast("struct<layout:string,day:int>")
    for mark, layout in reversed(_LAYOUTS):
        day = F.when(m.rlike(mark), _day(m, layout))
        found = F.when(day.between(0, DAYS - 1), F.struct(F.lit(layout).alias("layout"), day.alias("day"))).otherwise(found)
    return found


def _first_of(month: Column) -> Column:
    """Day of the domain on which a month begins; months count from 0."""
    base = F.lit("1900-01-01").cast("date")
    return F.datediff(F.add_months(base, month.cast("int")), base)


def _permuted(n: Column, size: int, a: int, b: int, tweak: str, key: str) -> Column:
    """Another number below ``size``, which a * b exceeds by few."""
    left, right = F.lit(a).cast("long"), F.lit(b).cast("long")

    def step(x: Column, i: Column) -> Column:
        pair = F.transform(F.array(_feistel(F.floor(x / right), x % right, left, right, F.lit(tweak), key)), lambda p: p["l"] * right + p["r"])[0]
        return F.when((i == 0) | (x >= size), pair).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(a * b - size)), n.cast("long"), step)


def _moved(day: Column, key: str) -> Column:
    """Another day of the domain, after the 12th of a month if and only if this one is: a date whose day can only be read as one keeps that."""

    def moved(d: Column) -> Column:
        date = F.date_add(F.lit("1900-01-01").cast("date"), d.cast("int"))
        month, of = (F.year(date) - 1900) * 12 + F.month(date) - 1, F.dayofmonth(date)
        early = F.transform(F.array(_permuted(month * 12 + of - 1, *_EARLY, "date", key)), lambda n: _first_of(F.floor(n / 12)) + n % 12)[0]

        def placed(n: Column) -> Column:
            # Days after the 12th that lie before a month: all days before it but twelve a month. The month of n is near its share.
            before = lambda m: _first_of(m) - 12 * m
            guess = F.floor(n / (_LATE[0] / 2400)).cast("int")
            months = F.filter(F.sequence(F.greatest(guess - 3, F.lit(0)), F.least(guess + 3, F.lit(2399))), lambda m: before(m) <= n)
            return F.transform(F.array(F.array_max(months)), lambda m: _first_of(m) + 12 + n - before(m))[0]

        late = F.transform(F.array(_permuted(d - 12 * (month + 1), *_LATE, "late", key)), placed)[0]
        return F.when(of > 12, late).otherwise(early).cast("long")

    return F.transform(F.array(day.cast("long")), moved)[0]


def _date(m: Column, key: str) -> Column:
    def text(found: Column) -> Column:
        day = F.date_add(F.lit("1900-01-01").cast("date"), _moved(found["day"], key).cast("int"))
        out = F.date_format(day, "yyyy-MM-dd")
        for _, layout in _LAYOUTS[1:]:
            out = F.when(found["layout"] == layout, F.date_format(day, layout)).otherwise(out)
        return out

    return F.transform(F.array(_layout(m)), text)[0]


def _kind(m: Column) -> Column:
    """The kind of a candidate, or null if it doesn't validate."""
    like = {k: m.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    ssn = ~m.rlike("^(?:000|666|9..)-|-00-|-0000$")
    return (
        F.when(m.contains("@"), "email")
        .when(like["ipv4"], F.when(octets, "ipv4"))
        .when(like["ssn"], F.when(ssn, "ssn"))
        .when(like["date"], F.when(_layout(m).isNotNull(), "date"))
        .when(like["card"], F.when(F.size(_cards(m)) > 0, "card"))
        .when(like["iban"], F.when(_valid_iban(m), "iban"))
        .when(like["phone"], F.when(F.length(_digits(m)).between(8, 15), "phone"))
    )


def _replaced(m: Column, key: str) -> Column:
    """``struct(kind, n, text)`` of a candidate; n is how many of the kind it has."""
    makers = {"email": _email, "phone": _phone, "ipv4": _ipv4, "ssn": _ssn, "card": _card_run, "date": _date, "iban": _iban}

    def of(kind: Column) -> Column:
        text = m
        for k, make in makers.items():
            text = F.when(kind == k, make(m, key)).otherwise(text)
        return F.struct(kind.alias("kind"), F.when(kind == "card", F.size(_cards(m))).otherwise(1).alias("n"), text.alias("text"))

    return F.transform(F.array(_kind(m)), of)[0]


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with its text column pseudonymized; with ``counts`` also ``n_<kind>`` for each kind."""
    text = F.col(f"`{text_col}`")
    found, new, gaps = (free_name(docs.columns, f"pii_{n}") for n in ("found", "new", "gaps"))
    rows = docs.withColumn(found, F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(CANDIDATE), 0)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(new, F.transform(found, lambda m: _replaced(m, key)))
    rows = rows.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, CANDIDATE, -1)))
    joined = F.array_join(F.concat(F.transform(new, lambda x, i: F.concat(F.get(gaps, i), x["text"])), F.slice(gaps, -1, 1)), "")
    rows = rows.withColumn(text_col, F.when(F.size(found) > 0, joined).otherwise(text))
    if counts:
        taken = {c.lower() for c in docs.columns}
        count = lambda kind: F.aggregate(new, F.lit(0), lambda n, x: n + F.when(x["kind"] == kind, x["n"]).otherwise(0))
        rows = rows.withColumns({f"n_{k}" if f"n_{k}" not in taken else free_name(docs.columns, f"n_{k}"): count(k) for k in KINDS})
    return rows.drop(found, new, gaps)
