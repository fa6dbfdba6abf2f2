"""Full-text conditions on posting fields.

Conditions are small immutable values: ``word("python") & ~phrase("machine learning")``.
Each one turns into a column over the text (:meth:`scan`) or into the matching ids from the
inverted index (:func:`search_index`). :func:`from_text` reads the usual one-line form.

Leaves are phrases (:class:`Atom`) and clumps of phrases (:class:`Clump`); everything above them is
Boolean. A leaf holds for a posting when it holds in one of the fields it looks at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.text import fold, fold_argument, separated

NEAR_DEFAULT = 10
#: The widest gap that is matched by a pattern; a wider one is matched on token positions.
PATTERN_GAP = 64
Evidence = Callable[["Leaf"], Column]


class Condition:
    """A condition on the texts of one posting."""

    def __and__(self, other: Condition) -> Condition:
        return Both(self, other)

    def __or__(self, other: Condition) -> Condition:
        return Either(self, other)

    def __invert__(self) -> Condition:
        return Not(self)

    def atoms(self) -> list[Leaf]:
        raise NotImplementedError

    def in_columns(self, columns: Columns) -> Condition:
        """The same condition on fewer fields."""
        raise NotImplementedError

    def check_fields(self, fields: Iterable[str]) -> None:
        """Raises where a leaf names a field that does not exist."""
        known = set(fields)
        unknown = sorted({name for a in self.atoms() for name in a.named_fields()} - known)
        if unknown:
            raise ValueError(f"no such field: {', '.join(unknown)}; there are {', '.join(sorted(known))}")

    def exact_words(self) -> list[str]:
        """Tokens asked for as they are."""
        return sorted({w for a in self.atoms() for w in a.exact()})

    def stems(self) -> list[str]:
        """Beginnings of tokens asked for."""
        return sorted({w for a in self.atoms() for w in a.beginnings()})

    def holds(self, evidence: Evidence) -> Column:
        raise NotImplementedError

    def holds_without_tokens(self) -> bool:
        """Does it hold for a posting in which no asked token occurs?"""
        raise NotImplementedError

    def asks_for(self, token: Column) -> Column:
        """Is the token one that some part of the condition looks for?"""
        exact = self.exact_words()
        wanted = token.isin(exact) if exact else F.lit(False)
        for stem in self.stems():
            wanted = wanted | token.startswith(stem)
        return wanted

    def scan(self, texts: Mapping[str, Column]) -> Column:
        """Predicate that reads the text fields themselves.

        The folded texts are bound to a lambda variable, so each is computed once per row
        however many words are asked for. Words, phrases and pairs of near words are then one pattern
        each, which stops at its first match; only other clumps cut a text into tokens, and only where
        all their words occur.
        """
        self.check_fields(texts)
        names = list(texts)
        folded = F.array(*[F.coalesce(fold(t), F.lit("")) for t in texts.values()])

        def verdict(bound: Column) -> Column:
            fields = {name: bound[i] for i, name in enumerate(names)}
            return self.holds(lambda leaf: leaf.found_in(fields))

        return F.exists(F.array(folded), verdict)


@dataclass(frozen=True)
class Both(Condition):
    left: Condition
    right: Condition

    def atoms(self):
        return self.left.atoms() + self.right.atoms()

    def in_columns(self, columns):
        return Both(self.left.in_columns(columns), self.right.in_columns(columns))

    def holds(self, evidence):
        return self.left.holds(evidence) & self.right.holds(evidence)

    def holds_without_tokens(self):
        return self.left.holds_without_tokens() and self.right.holds_without_tokens()


@dataclass(frozen=True)
class Either(Condition):
    left: Condition
    right: Condition

    def atoms(self):
        return self.left.atoms() + self.right.atoms()

    def in_columns(self, columns):
        return Either(self.left.in_columns(columns), self.right.in_columns(columns))

    def holds(self, evidence):
        return self.left.holds(evidence) | self.right.holds(evidence)

    def holds_without_tokens(self):
        return self.left.holds_without_tokens() or self.right.holds_without_tokens()


@dataclass(frozen=True)
class Not(Condition):
    inner: Condition

    def atoms(self):
        return self.inner.atoms()

    def in_columns(self, columns):
        return Not(self.inner.in_columns(columns))

    def holds(self, evidence):
        return ~self.inner.holds(evidence)

    def holds_without_tokens(self):
        return not self.inner.holds_without_tokens()


@dataclass(frozen=True)
class Columns:
    """A set of fields, or with ``excluded`` all fields but these."""

    names: frozenset[str]
    excluded: bool = False

    def covers(self, field: str) -> bool:
        return (field in self.names) != self.excluded


class Leaf(Condition):
    """Part of a condition that is decided within one field of one posting."""

    field: str | None
    columns: tuple[Columns, ...]

    def atoms(self):
        return [self]

    def in_columns(self, columns):
        if self.field is None and not self.columns and not columns.excluded and len(columns.names) == 1:
            return replace(self, field=next(iter(columns.names)))
        return replace(self, columns=(*self.columns, columns))

    def holds(self, evidence):
        return evidence(self)

    def holds_without_tokens(self):
        return False

    def covers(self, field: str) -> bool:
        return self.field in (None, field) and all(c.covers(field) for c in self.columns)

    def named_fields(self) -> set[str]:
        return {*([self.field] if self.field else []), *(n for c in self.columns for n in c.names)}

    def in_field(self, field: Column) -> Column:
        """:meth:`covers` for a column that holds the field's name."""
        result = F.lit(True) if self.field is None else field == self.field
        for c in self.columns:
            inside = field.isin(sorted(c.names))
            result = result & (~inside if c.excluded else inside)
        return result

    def found_in(self, folded: Mapping[str, Column]) -> Column:
        hits = [self._found_in(text) for name, text in folded.items() if self.covers(name)]
        return reduce(lambda a, b: a | b, hits, F.lit(False))

    def _found_in(self, folded: Column) -> Column:
        """Every token is part of the folded text, so a cheap look for the words comes first."""
        parts = [F.contains(folded, F.lit(w)) for w in dict.fromkeys([*self.exact(), *self.beginnings()])]
        possible = reduce(lambda a, b: a & b, parts)
        pattern = self.pattern()
        if pattern is not None:
            return possible & folded.rlike(pattern)
        return possible & F.exists(F.array(separated(folded)), self.found)

    def pattern(self) -> str | None:
        """One pattern on folded text that says the same, where there is one."""
        return None

    def exact(self) -> list[str]:
        raise NotImplementedError

    def beginnings(self) -> list[str]:
        raise NotImplementedError

    def found(self, text: Column) -> Column:
        """Does it hold in a text of tokens with one blank around each?"""
        raise NotImplementedError

    def indexed(self) -> Column:
        """Does it hold, as an aggregate over the index rows of one field of one posting?"""
        raise NotImplementedError


@dataclass(frozen=True)
class Atom(Leaf):
    """Tokens that must occur together in one field.

    ``adjacent`` tokens form a phrase, the last one a prefix when ``prefix`` is set, at the start of
    the field when ``first`` is; otherwise all must lie within ``gap`` tokens of each other, in any order.
    """

    words: tuple[str, ...]
    field: str | None = None
    prefix: bool = False
    gap: int | None = None
    first: bool = False
    columns: tuple[Columns, ...] = ()

    def exact(self):
        return list(self.words[:-1] if self.prefix else self.words)

    def beginnings(self):
        return [self.words[-1]] if self.prefix else []

    def pattern(self) -> str | None:
        """Tokens are runs of letters and digits. A word comes first in its pattern, so that it is
        searched for as such, and looks back over itself to what stands before it."""
        gap = r"[^\p{L}\p{N}]++"
        end = "" if self.prefix else r"(?![\p{L}\p{N}])"
        if self.gap is None:
            first, rest = self.words[0], "".join(gap + w for w in self.words[1:])
            if self.first:
                return rf"^[^\p{{L}}\p{{N}}]*+{first}{rest}{end}"
            return rf"{first}(?<![\p{{L}}\p{{N}}]{first}){rest}{end}"
        if len(self.words) == 2 and self.gap <= PATTERN_GAP:
            between = rf"{gap}(?:[\p{{L}}\p{{N}}]++{gap}){{0,{self.gap}}}"
            return "|".join(
                rf"{a}(?<![\p{{L}}\p{{N}}]{a}){between}{b}(?![\p{{L}}\p{{N}}])"
                for a, b in (self.words, self.words[::-1]))
        return None

    def found(self, text: Column) -> Column:
        if self.gap is None:
            needle = F.lit(" " + " ".join(self.words) + ("" if self.prefix else " "))
            return F.startswith(text, needle) if self.first else F.contains(text, needle)
        asked = F.array(*[F.lit(w) for w in self.words])
        marks = F.transform(
            F.split(F.trim(text), " "),
            lambda t, i: F.struct(
                i.alias("at"), F.array_position(asked, t).cast("int").alias("which")),
        )
        near = _within(F.filter(marks, lambda m: m["which"] > 0), [1] * len(self.words), self.gap)
        return reduce(lambda a, b: a & b, [F.contains(text, F.lit(f" {w} ")) for w in self.words]) & near

    def starts_in(self, words: Column) -> Column:
        """Places in an array of tokens where the phrase begins."""
        n = len(self.words)

        def begins(at: Column) -> Column:
            parts = [F.get(words, at + i) == w for i, w in enumerate(self.words[:-1])]
            last = F.get(words, at + n - 1)
            parts.append(last.startswith(self.words[-1]) if self.prefix else last == self.words[-1])
            return reduce(lambda a, b: a & b, parts)

        return F.filter(F.transform(words, lambda _, i: i), begins)

    def indexed_starts(self) -> Column:
        """Sorted places where the phrase begins, from the index rows of one field of one posting."""
        token = F.col("token")
        last = self.words[-1]
        last_is = token.startswith(last) if self.prefix else token == last
        tail = F.flatten(F.collect_list(F.when(last_is, F.col("positions"))))
        starts = [F.max(F.when(token == w, F.col("positions"))) for w in self.words[:-1]] + [tail]
        return reduce(F.array_intersect, [_moved_back(p, i) for i, p in enumerate(starts)])

    def indexed(self) -> Column:
        token = F.col("token")
        last_is = token.startswith(self.words[-1]) if self.prefix else token == self.words[-1]
        if len(self.words) == 1:
            return F.max(last_is & (F.get(F.col("positions"), F.lit(0)) == 0) if self.first else last_is)
        if self.gap is not None:
            marks = [
                _marked(F.max(F.when(token == w, F.col("positions"))), i + 1) for i, w in enumerate(self.words)]
            return _within(F.array_sort(F.concat(*marks)), [1] * len(self.words), self.gap)
        starts = self.indexed_starts()
        return F.array_contains(starts, 0) if self.first else F.size(starts) > 0


@dataclass(frozen=True)
class Clump(Leaf):
    """Phrases that stand close together in one field, in any order.

    With the last of them beginning at ``p``, every phrase of ``n`` tokens begins at ``p - n - gap``
    or later.
    """

    phrases: tuple[Atom, ...]
    gap: int = NEAR_DEFAULT
    field: str | None = None
    columns: tuple[Columns, ...] = ()

    def exact(self):
        return [w for p in self.phrases for w in p.exact()]

    def beginnings(self):
        return [w for p in self.phrases for w in p.beginnings()]

    def _near(self, starts: list[Column]) -> Column:
        marks = F.array_sort(F.concat(*[_marked(s, i + 1) for i, s in enumerate(starts)]))
        return _within(marks, [len(p.words) for p in self.phrases], self.gap)

    def found(self, text: Column) -> Column:
        present = reduce(lambda a, b: a & b, [p.found(text) for p in self.phrases])
        words = F.array(F.split(F.trim(text), " "))
        return present & F.exists(words, lambda bound: self._near([p.starts_in(bound) for p in self.phrases]))

    def indexed(self) -> Column:
        return self._near([p.indexed_starts() for p in self.phrases])


def _within(marks: Column, lengths: Sequence[int], gap: int) -> Column:
    """All kinds of marks occur, each at most ``gap`` and its own length before the last of them.

    ``marks`` is ordered by position. The fold keeps the latest position of each kind, so its
    cost grows with the number of marks, not with the number of pairs.
    """
    kinds = len(lengths)
    room = F.array(*[F.lit(n + gap) for n in lengths])
    start = F.struct(
        F.transform(F.sequence(F.lit(1), F.lit(kinds)), lambda _: F.lit(None).cast("int"))
        .alias("last"),
        F.lit(False).alias("found"),
    )

    def step(state: Column, mark: Column) -> Column:
        last = F.transform(
            state["last"],
            lambda old, i: F.when(i + 1 == mark["which"], mark["at"]).otherwise(old),
        )
        far = F.exists(
            F.zip_with(last, room, lambda p, r: F.coalesce(mark["at"] - p > r, F.lit(True))), lambda x: x)
        return F.struct(last.alias("last"), (state["found"] | ~far).alias("found"))

    return F.aggregate(marks, start, step, lambda state: state["found"])


def word(text: str, field: str | None = None) -> Condition:
    """One word; punctuation inside it makes it a phrase of its parts."""
    return Atom(_words(text), field)


def phrase(text: str, field: str | None = None) -> Condition:
    return Atom(_words(text), field)


def prefix(text: str, field: str | None = None) -> Condition:
    return Atom(_words(text), field, prefix=True)


def near(*words: str, gap: int = NEAR_DEFAULT, field: str | None = None) -> Condition:
    """Words or phrases (texts of several words) close together."""
    return _clump([Atom(_words(w)) for w in words], gap, field)


def _clump(phrases: Sequence[Atom], gap: int, field: str | None = None) -> Condition:
    phrases = list(dict.fromkeys(phrases))
    if len(phrases) == 1:
        return replace(phrases[0], field=field)
    if all(len(p.words) == 1 and not p.prefix for p in phrases):
        return Atom(tuple(p.words[0] for p in phrases), field, gap=gap)
    return Clump(tuple(phrases), gap, field)


def _words(text: str) -> tuple[str, ...]:
    found = tuple(fold_argument(text))
    if not found:
        raise ValueError(f"no searchable word in {text!r}")
    return found


class _Reader:
    """Recursive descent over the one-line form; see :func:`from_text`."""

    _COLUMNS = re.compile(r"(-\s*)?(?:(\w+)|\{([^{}]*)\})\s*:")
    _OPERATOR = re.compile(r"(AND|OR|NOT)(?=[\s()]|$)")
    _NEAR = re.compile(r"NEAR\s*\(")
    _QUOTED = re.compile(r'"((?:[^"]|"")*)"')
    _BARE = re.compile(r'[^\s"*(){}:^]+')
    _BARE_IN_NEAR = re.compile(r'[^\s"*(){}:^,]+')
    _PLUS = re.compile(r"\+(?=[\s\"])")

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def read(self) -> Condition:
        found = self.either()
        if self.ahead():
            raise self.problem("unexpected")
        return found

    def ahead(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at:self.at + 1]

    def take(self, pattern: re.Pattern) -> re.Match | None:
        self.ahead()
        found = pattern.match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def skip(self, mark: str) -> bool:
        if self.ahead() == mark:
            self.at += 1
            return True
        return False

    def problem(self, what: str) -> ValueError:
        return ValueError(f"{what} at {self.at} in {self.text!r}: {self.text[self.at:self.at + 20]!r}")

    def operator(self, name: str) -> bool:
        before, found = self.at, self.take(self._OPERATOR)
        if found and found[1] == name:
            return True
        self.at = before
        return False

    def either(self) -> Condition:
        found = self.both()
        while self.operator("OR"):
            found = found | self.both()
        return found

    def both(self) -> Condition:
        found = self.without()
        while self.operator("AND"):
            found = found & self.without()
        return found

    def without(self) -> Condition:
        found = self.run()
        while self.operator("NOT"):
            found = found & ~self.run()
        return found

    def run(self) -> Condition:
        """Units side by side must all hold."""
        units = []
        while self.ahead() not in ("", ")") and not self._OPERATOR.match(self.text, self.at):
            units.append(self.unit())
        if not units:
            raise self.problem("a search term is missing")
        return reduce(lambda a, b: a & b, units)

    def unit(self) -> Condition:
        columns = self.take(self._COLUMNS)
        if columns:
            names = columns[3].split() if columns[2] is None else [columns[2]]
            if not names:
                raise self.problem("an empty set of fields")
            return self.unit().in_columns(Columns(frozenset(names), bool(columns[1])))
        if self.skip("("):
            found = self.either()
            if not self.skip(")"):
                raise self.problem("a closing bracket is missing")
            return found
        if self.take(self._NEAR):
            return self.clump()
        if self.ahead() == "-":
            raise self.problem("an exclusion without a field")
        first = self.skip("^")
        found = self.phrase(self._BARE)
        return replace(found, first=True) if first else found

    def phrase(self, bare: re.Pattern) -> Atom:
        words: tuple[str, ...] = ()
        while True:
            quoted = self.take(self._QUOTED)
            plain = None if quoted else self.take(bare)
            if not quoted and not plain:
                raise self.problem("a word or phrase is missing")
            words += _words(quoted[1].replace('""', '"') if quoted else plain[0])
            if self.skip("*"):
                return Atom(words, prefix=True)
            if not self.take(self._PLUS):
                return Atom(words)

    def clump(self) -> Condition:
        phrases, gap = [], NEAR_DEFAULT
        while self.ahead() not in ("", ",", ")"):
            phrases.append(self.phrase(self._BARE_IN_NEAR))
        if self.skip(","):
            number = self.take(re.compile(r"\d+"))
            if not number:
                raise self.problem("a distance is missing")
            gap = int(number[0])
        if not self.skip(")") or not phrases:
            raise self.problem("NEAR takes phrases and a distance in brackets")
        return _clump(phrases, gap)


def from_text(text: str, fields: Iterable[str] | None = None) -> Condition:
    """The one-line form: ``machine "deep learning" NOT java OR (title:rust AND py*)``.

    Words side by side bind tightest, then NOT, AND and OR, which are upper-case; brackets group. A
    unit is a word, a ``"phrase"``, either with ``*`` for a beginning, phrases joined by `` + `` , or
    ``NEAR(word "a phrase" word, 5)``. ``^`` before a phrase asks for it at the start of a field. A
    field before a unit or a bracket narrows it: ``title:``, ``{title skills}:``, ``-company:`` (all
    fields but this), ``-{title company}:``. Punctuation inside a word makes it a phrase of its parts.
    A line that cannot be read raises ValueError, and so does an unknown field where ``fields`` is given.
    """
    found = _Reader(text).read()
    if fields is not None:
        found.check_fields(fields)
    return found


def field_texts(
    jobs: DataFrame, fields: Sequence[str] = C.INDEXED_FIELDS
) -> dict[str, Column]:
    """Searchable text per field; a list counts as its items side by side."""
    lists = {f.name for f in jobs.schema.fields if f.dataType.typeName() == "array"}
    return {f: F.array_join(f, " ") if f in lists else F.col(f) for f in fields}


def search_scan(
    jobs: DataFrame, condition: Condition, key: str = "job_id",
    fields: Sequence[str] = C.INDEXED_FIELDS,
) -> DataFrame:
    """Matching keys by reading the text."""
    return jobs.filter(condition.scan(field_texts(jobs, fields))).select(key)


def search_index(
    index: DataFrame, condition: Condition, key: str = "job_id",
    everything: DataFrame | None = None, fields: Iterable[str] | None = None,
) -> DataFrame:
    """Matching keys by reading only the index rows of the tokens asked for.

    Rows of a token found everywhere are spread by key. One shuffle on the key serves both
    steps, and a group holds at most the positions of the asked tokens in one posting. A
    condition that also holds for postings without any asked token, such as a bare NOT, needs
    ``everything`` (all keys) and raises without it. With ``fields``, the indexed ones, a condition
    on any other raises.
    """
    if fields is not None:
        condition.check_fields(fields)
    if everything is None and condition.holds_without_tokens():
        raise ValueError("the condition holds for postings without its words: pass all keys")
    atoms = list(dict.fromkeys(condition.atoms()))
    wanted = index.filter(condition.asks_for(F.col("token")))
    per_field = wanted.repartition(F.col(key)).groupBy(key, "field").agg(
        *[F.coalesce(atom.indexed() & atom.in_field(F.col("field")), F.lit(False)).alias(f"_hit{i}")
          for i, atom in enumerate(atoms)]
    )
    flags = per_field.groupBy(key).agg(
        *[F.max(f"_hit{i}").alias(f"_hit{i}") for i in range(len(atoms))]
    )
    if everything is not None:
        flags = everything.select(key).join(flags, key, "left")
    verdict = condition.holds(
        lambda atom: F.coalesce(F.col(f"_hit{atoms.index(atom)}"), F.lit(False))
    )
    return flags.filter(verdict).select(key)


def _marked(positions: Column, which: int) -> Column:
    return F.transform(positions, lambda p: F.struct(p.alias("at"), F.lit(which).alias("which")))


def _moved_back(positions: Column, steps: int) -> Column:
    return F.transform(positions, lambda p: p - steps)
