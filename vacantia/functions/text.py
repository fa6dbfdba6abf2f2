"""Text clean-up, company names, tokens and keyword flags."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import constants as C


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not just the blank."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def na_to_null(text: Column, marker: str = C.MISSING) -> Column:
    return F.nullif(text, F.lit(marker))


def null_to_na(text: Column, marker: str = C.MISSING) -> Column:
    return F.coalesce(text, F.lit(marker))


def present_text(text: Column) -> Column:
    """NULL for the missing marker and for the empty string."""
    return F.nullif(na_to_null(text), F.lit(""))


def normalize_company(name: Column, suffixes: Iterable[str] = C.COMPANY_SUFFIXES) -> Column:
    """Lower-cased, trimmed name without its (single) legal suffix."""
    tail = "|".join(re.escape(s) for s in suffixes)
    return strip(F.regexp_replace(F.lower(strip(name)), rf"(?:{tail})\z", ""))


def mentions_any(text: Column, keywords: Iterable[str]) -> Column:
    """True when the lower-cased text holds one of the substrings; never NULL.

    A keyword that contains another one can add nothing, so it is left out of the plan. The
    lower-cased text is bound to a lambda variable: computed once, whatever the keyword count.
    """
    words = list(dict.fromkeys(keywords))
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    lowered = F.lower(present_text(text))

    def hit(bound: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(bound, F.lit(w)) for w in needed])

    return F.coalesce(F.exists(F.array(lowered), hit), F.lit(False))


def is_remote(description: Column, keywords: Iterable[str] = C.REMOTE_KEYWORDS) -> Column:
    return mentions_any(description, keywords)


def offers_visa(description: Column, keywords: Iterable[str] = C.VISA_KEYWORDS) -> Column:
    return mentions_any(description, keywords)


@lru_cache(maxsize=1)
def _accent_map() -> tuple[str, str]:
    """Accented Latin letters → base letters, then combining marks → nothing.

    Derived from the Unicode decomposition of the Latin blocks.
    """
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(base) > 1 and not unicodedata.combining(base[0]):
            accented.append(letter)
            plain.append(base[0])
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(accented + marks), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without accents: ``Café`` → ``cafe``.

    Text of one byte per character has no accents and skips the translation.
    """
    source, target = _accent_map()
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(F.lower(text), source, target))


def separated(folded: Column) -> Column:
    """Letter/digit runs of a folded text, each with one blank on both sides: `` a b c ``."""
    return F.regexp_replace(F.concat(F.lit(" "), folded, F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def split_words(text: Column) -> Column:
    """Folded letter/digit runs in text order, with an empty one where a text begins or ends with a separator."""
    return F.split(fold(text), r"[^\p{L}\p{N}]+")


def tokens(text: Column) -> Column:
    """Folded letter/digit runs in text order."""
    return F.filter(split_words(text), lambda t: t != "")


def fold_argument(text: str) -> list[str]:
    """Tokens of a short search argument, by the same rules as :func:`tokens`."""
    source, target = _accent_map()
    removed = source[len(target):]
    plain = text.lower().translate(str.maketrans(source[: len(target)], target, removed))
    spaced = "".join(ch if unicodedata.category(ch)[0] in "LN" else " " for ch in plain)
    return spaced.split()


def last_urn_part(urn: Column, prefix: str = C.POSTING_URN_PREFIX) -> Column:
    """Id from a resource name; NULL when the prefix is absent."""
    return F.when(F.contains(urn, F.lit(prefix)), F.substring_index(urn, ":", -1))


def leading_integer(text: Column) -> Column:
    """Integer at the start of the text, 0 when there is none, NULL for NULL."""
    digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(text.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint")))


def json_list(text: Column) -> Column:
    """JSON text → list of strings; anything unreadable → empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
