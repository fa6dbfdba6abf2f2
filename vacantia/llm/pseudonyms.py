"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Every value is found by a pattern, validated (check digits, calendar, octets, ranges) and
permuted by a keyed Feistel network within its own format. A permutation is one to one, so equal
values stay equal and different ones stay different in all documents, without any lookup table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import fresh

ROUNDS = 8

# Fixed value: the greatest length of an e-mail address.
_EMAIL_CHARS = 320

#: Steps in which a permuted number that is no date is permuted on; see :func:`_walked`.
_STEPS = 16

# The calendar range of dates, and its length in days, 17 x 4297.
_FIRST_DAY, _DAYS, _DAYS_LEFT = "1900-01-01", 73049, 17

# The patterns by kind, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9/.-])[0-9]{4}([-/.])(?:0[1-9]|1[0-2])\1[0-3][0-9](?![0-9]|[-/.][0-9])",
    "day_date": r"(?<![0-9/.-])[0-3]?[0-9]([-/.])[0-3]?[0-9]\2[0-9]{4}(?![0-9]|[-/.][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
             r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\3[0-9]{4})(?![0-9]|[-.][0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\4[0-9]{4}\4[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\5[0-9]{5})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _digest(key: str, label: str, part: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}\x1f{label}\x1f"), part), 256)


def _number(digest: Column, at: Column | int = 0) -> Column:
    """Twelve hex digits of a digest as a number; a second place gives another number."""
    start = (F.lit(at) if isinstance(at, int) else at) % 16 * 3 + 1
    return F.conv(digest.substr(start, F.lit(12)), 16, 10).cast("long")


def permuted_chars(value: Column, key: str, label: str) -> Column:
    """Permutes strings position by position, each character within its own class.

    Digits stay digits, letters stay letters of the same case, all else stays where it is. The two
    halves of the string shift each other by a keyed digest in ``ROUNDS`` rounds; a shift can be
    undone, so the whole is one to one on strings of the same shape. Letter case does not
    enter the digest: variants in case get variants in case.
    """
    half = F.ceil(F.length(value) / 2).cast("int")
    left, right = value.substr(F.lit(1), half), value.substr(half + 1, F.length(value))

    def shifted(part: Column, other: Column, turn: int) -> Column:
        def shift(c: Column, i: Column) -> Column:
            block = F.floor(i / 16).cast("string")
            digest = _digest(key, f"{label}{turn}", F.concat_ws("|", block, F.lower(other)))
            by, code = _number(digest, i), F.ascii(c)

            def turned(first: str, size: int) -> Column:
                return F.char(F.lit(ord(first)) + F.pmod(code - F.lit(ord(first)) + by, F.lit(size)))

            return (
                F.when(c.between("0", "9") & (code < 128), turned("0", 10))
                .when(c.between("a", "z") & (code < 128), turned("a", 26))
                .when(c.between("A", "Z") & (code < 128), turned("A", 26)).otherwise(c)
            )

        return F.array_join(F.transform(F.split(part, ""), shift), "")

    # Each round goes through a one-element array, so that its text is computed once.
    state = F.array(F.struct(left.alias("l"), right.alias("r")))

    # A function per round: a lambda's second parameter, default or not, would be taken for the index.
    def round_of(turn: int):
        def right_moves(s: Column) -> Column:
            return F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], turn).alias("r"))

        def left_moves(s: Column) -> Column:
            return F.struct(shifted(s["l"], s["r"], turn).alias("l"), s["r"].alias("r"))

        return right_moves if turn % 2 else left_moves

    for turn in range(ROUNDS):
        state = F.transform(state, round_of(turn))
    return F.concat(state[0]["l"], state[0]["r"])


def permuted_number(value: Column, left_size: int | Column, right_size: int | Column, key: str, label: str) -> Column:
    """Permutes 0 .. left_size * right_size - 1 onto itself: two digits of mixed radix shift each other."""
    state = F.array(F.struct(
        F.floor(value / right_size).cast("long").alias("l"), F.pmod(value, F.lit(right_size)).cast("long").alias("r")
    ))

    def round_of(turn: int):
        def right_moves(s: Column) -> Column:
            by = _number(_digest(key, f"{label}{turn}", s["l"].cast("string")))
            return F.struct(s["l"].alias("l"), F.pmod(s["r"] + by, F.lit(right_size)).alias("r"))

        def left_moves(s: Column) -> Column:
            by = _number(_digest(key, f"{label}{turn}", s["r"].cast("string")))
            return F.struct(F.pmod(s["l"] + by, F.lit(left_size)).alias("l"), s["r"].alias("r"))

        return right_moves if turn % 2 else left_moves

    for turn in range(ROUNDS):
        state = F.transform(state, round_of(turn))
    return state[0]["l"] * right_size + state[0]["r"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced, in order, by the given ones."""
    def put(c: Column, i: Column) -> Column:
        nth = F.length(_digits(shape.substr(F.lit(1), i + 1)))
        return F.when(c.rlike("^[0-9]$"), digits.substr(nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), put), "")


def _luhn_sum(digits: Column) -> Column:
    """Sum over the digits of a number without its check digit; the last one is doubled."""
    turned = F.split(F.reverse(digits), "")
    parts = F.transform(turned, lambda c, i: F.when(
        i % 2 == 0, F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10
    ).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _check_digit(payload: Column) -> Column:
    return F.pmod(-_luhn_sum(payload), F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    expanded = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(
        c.rlike("^[A-Z]$"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.aggregate(F.split(expanded, ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)


def _date_of(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def _moved_date(date: Column, key: str) -> Column:
    day = F.datediff(date, F.lit(_FIRST_DAY).cast("date")).cast("long")
    moved = permuted_number(day, _DAYS_LEFT, _DAYS // _DAYS_LEFT, key, "date")
    # NULL outside the range, so that other numbers stay as they are.
    return F.when(
        (day >= 0) & (day < _DAYS), F.date_add(F.lit(_FIRST_DAY).cast("date"), moved.cast("int"))
    )


def _iso_date(m: Column, key: str) -> Column:
    moved = _moved_date(_date_of(m.substr(1, 4), m.substr(6, 2), m.substr(9, 2)), key)
    return F.replace(F.date_format(moved, "yyyy-MM-dd"), F.lit("-"), m.substr(5, 1))


def _walked(date: Column, key: str) -> Column:
    """Permutes the dates of one written form onto themselves.

    ``date`` holds the numbers ``first``, ``second`` and ``year``, the ranges ``low1``, ``n1``, ``low2``, ``n2`` of the
    form's two numbers, and whether the day comes first. All combinations of the ranges are permuted, on
    and on until one is a date again. As a permutation runs in circles this is one to one on dates; at
    most a twentieth of the combinations are no dates, so that ``_STEPS`` steps are always enough.
    """
    def split(d: Column, n: Column) -> list[Column]:
        return [F.floor(n / d["n2"]).cast("long") % d["n1"] + d["low1"], n % d["n2"] + d["low2"],
                F.floor(n / (d["n1"] * d["n2"])).cast("long") + 1900]

    def is_date(d: Column, n: Column) -> Column:
        first, second, year = [p.cast("string") for p in split(d, n)]
        day, month = F.when(d["day_first"], first).otherwise(second), F.when(d["day_first"], second).otherwise(first)
        return _date_of(year, month, day).isNotNull()

    def moved(d: Column) -> Column:
        start = ((d["year"] - 1900) * d["n1"] + d["first"] - d["low1"]) * d["n2"] + d["second"] - d["low2"]
        none = F.struct(start.alias("n"), F.lit(False).alias("done"))

        def step(state: Column, _: Column) -> Column:
            on = F.array(permuted_number(state["n"], 200 * d["n1"], d["n2"], key, "form"))
            return F.when(state["done"], state).otherwise(
                F.transform(on, lambda n: F.struct(n.alias("n"), is_date(d, n).alias("done")))[0])

        return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), none, step, lambda s: F.struct(
            *[p.alias(name) for p, name in zip(split(d, s["n"]), ("first", "second", "year"))]))

    return F.transform(F.array(date), moved)[0]


def _day_date(m: Column, key: str) -> Column:
    """Day first where that is a date, else month first; every form and each length moves within itself."""
    first, second, year = [F.split(m, "[-/.]")[i] for i in range(3)]
    mark = F.regexp_extract(m, "[-/.]", 0)
    day_first, month_first = _date_of(year, second, first), _date_of(year, first, second)
    one, two, is_day = F.length(first), F.length(second), day_first.isNotNull()
    whole = F.replace(F.date_format(_moved_date(day_first, key), "dd-MM-yyyy"), F.lit("-"), mark)
    short = F.when(one == 1, 9)
    # Days up to 12 would read as day first, so the others form a set of their own.
    form = F.struct(
        first.cast("long").alias("first"), second.cast("long").alias("second"), year.cast("long").alias("year"),
        is_day.alias("day_first"), F.lit(1).alias("low1"), F.when(is_day, 1).otherwise(13).alias("low2"),
        short.when(is_day, 31).otherwise(12).cast("long").alias("n1"),
        F.when(~is_day, 19).when(two == 1, 9).otherwise(12).cast("long").alias("n2"))
    written = F.transform(F.array(_walked(form, key)), lambda d: F.concat(
        F.lpad(d["first"].cast("string"), one, "0"), mark, F.lpad(d["second"].cast("string"), two, "0"), mark,
        d["year"].cast("string")))[0]
    return F.when(is_day & (one == 2) & (two == 2), whole).when(
        (is_day | month_first.isNotNull()) & year.cast("int").between(1900, 2099), written)


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    moved = F.array(permuted_number(number, 65536, 65536, key, "ip"))
    text = F.transform(moved, lambda n: F.concat_ws(".", *[
        F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)
    ]))[0]
    return F.when(F.forall(parts, lambda x: x < 256), text)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area, group, serial = m.substr(1, 3).cast("long"), m.substr(5, 2).cast("long"), m.substr(8, 4).cast("long")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    moved = F.array(permuted_number(number, 898 * 99, 9999, key, "ssn"))

    def text(n: Column) -> Column:
        slot = F.floor(n / (99 * 9999)).cast("long")
        return F.concat_ws(
            "-",
            F.lpad((slot + F.when(slot >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((F.floor(n / 9999).cast("long") % 99 + 1).cast("string"), 2, "0"),
            F.lpad((n % 9999 + 1).cast("string"), 4, "0"),
        )

    return F.when(valid, F.transform(moved, text)[0])


def _phone(m: Column, key: str) -> Column:
    """7 to 15 digits in all. Of a number with ``+`` the first digit stays, a region of the world.

    All other digits move together, so that one number written in two ways has one pseudonym.
    """
    digits, kept = _digits(m), F.when(F.startswith(m, F.lit("+")), 1).otherwise(0)
    moved = F.concat(digits.substr(F.lit(1), kept), permuted_chars(digits.substr(kept + 1, F.length(digits)), key, "phone"))
    return F.when(F.length(digits).between(7, 15), _refilled(m, moved))


def _card(m: Column, key: str) -> Column:
    """The check digit is computed anew, so a valid number becomes a valid number."""
    digits = _digits(m)
    payload, check = digits.substr(F.lit(1), F.length(digits) - 1), F.right(digits, F.lit(1))
    moved = F.transform(
        F.array(permuted_chars(payload, key, "card")),
        lambda p: _refilled(m, F.concat(p, _check_digit(p))),
    )[0]
    return F.when(_check_digit(payload) == check, moved)


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, body = plain.substr(1, 2), plain.substr(F.lit(5), F.length(plain))
    moved = F.transform(F.array(permuted_chars(body, key, "iban")), lambda b: F.concat(
        country, F.lpad((F.lit(98) - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b
    ))[0]
    spaced = F.when(
        F.contains(m, F.lit(" ")), F.rtrim(F.regexp_replace(moved, "(.{4})", "$1 "))
    ).otherwise(moved)
    return F.when(_mod97(F.concat(body, plain.substr(1, 4))) == 1, spaced)


def _email(m: Column, key: str) -> Column:
    """Both the local part and the domain's own labels move; the last label stays."""
    cut = F.regexp_extract(m, r"^(.*)(\.[A-Za-z]+)$", 1)
    return F.when(F.length(m) <= _EMAIL_CHARS, F.concat(
        permuted_chars(cut, key, "email"), F.regexp_extract(m, r"(\.[A-Za-z]+)$", 1)))


_MAKERS = {
    "email": _email, "ip": _ip, "iso_date": _iso_date, "day_date": _day_date, "ssn": _ssn,
    "phone": _phone, "card": _card, "iban": _iban,
}


def _alone(kind: str) -> str:
    """The kind's pattern for a match that stands alone; back-references count anew."""
    pattern, groups = PATTERNS[kind], 0
    for n in range(1, 6):
        if f"\\{n}" in pattern:
            groups += 1
            pattern = pattern.replace(f"\\{n}", f"\\{groups}")
    return f"^(?:{pattern})$"


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of a matched text, or the text itself where no validation holds."""
    tries = [
        F.when(match.rlike(_alone(kind)), make(match, key)) for kind, make in _MAKERS.items()
    ]
    return F.coalesce(*tries, match)


def pseudonymize(documents: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Replaces personal data in every document; adds ``n_pseudonyms``, the values replaced.

    E-mail and IPv4 addresses, telephone, payment card, social security and bank account
    numbers and full dates (1900 to 2099) are replaced; numbers that fail their validation stay.
    The key is a secret of the caller. Whole texts are read; no pattern repeats a group without bound,
    so that a text of any length, of any marks, is searched in time in proportion. A NULL text stays
    NULL with count 0, an empty one empty; equal rows get equal results; other columns pass through,
    but a column ``n_pseudonyms`` is replaced.
    """
    text = F.col(f"`{column}`")
    found, new = fresh(documents.columns, "found", "new")
    matches = F.when(text.rlike("[0-9]|@"), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))
    split_at = documents.withColumn(found, matches).withColumn(new, F.transform(found, lambda m: pseudonym(m, key)))
    between = F.split(text, _ANY, -1)
    replaced = F.concat(
        F.array_join(F.transform(between, lambda s, i: F.concat(
            s, F.coalesce(F.get(new, i), F.lit(""))
        )), "")
    )
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    return split_at.select(
        *[
            F.when(F.size(found) > 0, replaced).otherwise(text).alias(column)
            if c == column else F.col(f"`{c}`") for c in documents.columns if c != "n_pseudonyms"
        ],
        F.coalesce(F.when(F.size(found) > 0, changed), F.lit(0)).alias("n_pseudonyms"),
    )
