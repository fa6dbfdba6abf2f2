"""Raw pages → rows.

Spark reads, splits and ships the pages; a small event-driven reader inside each task turns
one page into the text of a few named elements. Which elements is a parameter, so the same
job reads search cards, detail pages, or any other layout.
"""

from __future__ import annotations

import html as html_lib
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import last_urn_part


@dataclass(frozen=True)
class Field:
    """The first element that fits; gives its text, one attribute, or its markup."""

    name: str
    tag: str | None = None
    classes: tuple[str, ...] = ()
    attr: str | None = None
    attr_holds: str = ""
    inside: tuple[str, str] | None = None
    joiner: str = " "
    markup: bool = False

    def fits(self, tag: str, attrs: dict[str, str], open_elements: list) -> bool:
        if self.tag and tag != self.tag:
            return False
        own = attrs.get("class", "").split()
        if self.classes and not any(c in own for c in self.classes):
            return False
        if self.attr and (self.attr not in attrs or self.attr_holds not in attrs[self.attr]):
            return False
        if self.inside:
            parent_tag, parent_class = self.inside
            return any(
                t == parent_tag and (not parent_class or parent_class in a.get("class", "").split())
                for t, a in open_elements
            )
        return True


@dataclass(frozen=True)
class Group:
    """Fields read once per page, or once per container element when one is given."""

    name: str
    fields: tuple[Field, ...]
    tag: str | None = None
    css_class: str | None = None

    @property
    def repeats(self) -> bool:
        return bool(self.tag or self.css_class)

    @cached_property
    def untagged(self) -> list[Field]:
        return [f for f in self.fields if f.tag is None]

    @cached_property
    def by_tag(self) -> dict[str, list[Field]]:
        """The fields an element of a tag may fill."""
        return {
            tag: [f for f in self.fields if f.tag in (tag, None)]
            for tag in {f.tag for f in self.fields if f.tag}
        }


# Where a search card and a detail page keep their fields.
CARD_GROUP = Group("cards", (
    Field("urn", attr="data-entity-urn"),
    Field("title", "h3", ("base-search-card__title",)),
    Field("company", "a", inside=("h4", "base-search-card__subtitle")),
    Field("company_url", "a", attr="href", inside=("h4", "base-search-card__subtitle")),
    Field("location", "span", ("job-search-card__location",)),
    Field("posted_date", "time", ("job-search-card__listdate",)),
    Field("posted_date_iso", "time", ("job-search-card__listdate",), attr="datetime"),
    Field("job_url", "a", ("base-card__full-link",), attr="href"),
    Field("benefits_badge", "span", ("job-posting-benefits__text",)),
), tag="div", css_class="job-search-card")

_DESCRIPTION = ("show-more-less-html__markup", "description__text")

DETAIL_GROUP = Group("detail", (
    Field("title", "h2", ("top-card-layout__title",)),
    Field("company", "a", ("topcard__org-name-link",)),
    Field("company_url", "a", ("topcard__org-name-link",), attr="href"),
    Field("location", "span", ("topcard__flavor--bullet",)),
    Field("posted_date", "span", ("posted-time-ago__text",)),
    Field("posted_datetime", "span", ("posted-time-ago__text",), attr="datetime"),
    Field("number_of_applicants", "figcaption", ("num-applicants__caption",)),
    Field("salary", "div", ("compensation__salary",)),
    Field("raw_description", "div", _DESCRIPTION, markup=True),
    Field("description_text", "div", _DESCRIPTION, joiner="\n"),
    Field("apply_button", classes=("jobs-apply-button--top-card",)),
    Field("apply_label", attr="aria-label", attr_holds="Easy Apply"),
))

CRITERIA_GROUP = Group("criteria", (
    Field("label", "h3"),
    Field("value", "span"),
), tag="li", css_class="description__job-criteria-item")

# Criteria column, the word in its label, and whether the label is lower-cased.
CRITERIA_COLUMNS = (
    ("seniority_level", "seniority", False),
    ("employment_type", "employment", False),
    ("job_function", "function", True),
    ("industries", "industries", True),
)

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))


class _Capture:
    """One record being filled: a container element and the fields found in it so far."""

    def __init__(self, group: Group, depth: int):
        self.group, self.depth = group, depth
        self.values: dict[str, str | None] = {f.name: None for f in group.fields}
        self.open: dict[str, tuple[Field, int, list[str]]] = {}

    def start(self, tag: str, attrs: dict[str, str], raw: str, parents: list, depth: int) -> None:
        for opened, _, parts in self.open.values():
            if opened.markup:
                parts.append(raw)
        for field in self.group.by_tag.get(tag, self.group.untagged):
            taken = self.values[field.name] is not None or field.name in self.open
            if taken or not field.fits(tag, attrs, parents):
                continue
            if field.attr:
                self.values[field.name] = attrs[field.attr]
            elif tag in _VOID:
                self.values[field.name] = ""
            else:
                self.open[field.name] = (field, depth, [raw] if field.markup else [])

    def text(self, data: str) -> None:
        for field, _, parts in self.open.values():
            if field.markup:
                parts.append(html_lib.escape(data, quote=False))
            elif data.strip():
                parts.append(data.strip())

    def close(self, depth: int, raw: str) -> None:
        """Finish the fields whose element lies at ``depth`` or deeper."""
        if not self.open:
            return
        for name, (field, opened, parts) in list(self.open.items()):
            if field.markup and raw:
                parts.append(raw)
            if opened >= depth:
                self.values[name] = ("" if field.markup else field.joiner).join(parts)
                del self.open[name]


class _PageReader(HTMLParser):
    def __init__(self, groups: tuple[Group, ...]):
        super().__init__(convert_charrefs=True)
        self.groups = groups
        self.elements: list[tuple[str, dict[str, str]]] = []
        self.active = [_Capture(g, -1) for g in groups if not g.repeats]
        self.found: dict[str, list[dict]] = {g.name: [] for g in groups}
        for capture in self.active:
            self.found[capture.group.name].append(capture.values)
        self.silent = 0
        self.pending: list[str] = []

    def parse_marked_section(self, i, report=1):
        """Broken sections, as <![foo bar]>, are comments to a browser; the base class raises."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        named = {key: value or "" for key, value in reversed(attrs)}
        depth = len(self.elements)
        for group in self.groups:
            if group.repeats and (not group.tag or tag == group.tag) and (
                not group.css_class or group.css_class in named.get("class", "").split()
            ):
                capture = _Capture(group, depth)
                self.active.append(capture)
                self.found[group.name].append(capture.values)
        raw = self.get_starttag_text() or ""
        for capture in self.active:
            capture.start(tag, named, raw, self.elements, depth)
        if tag not in _VOID:
            self.elements.append((tag, named))
            self.silent += tag in _SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        depth = next(
            (i for i in range(len(self.elements) - 1, -1, -1) if self.elements[i][0] == tag), None
        )
        if depth is None:
            return
        self._leave(depth, f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.pending.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def _flush(self) -> None:
        """Pieces of one text node arrive separately around a stray ``<``."""
        if self.pending:
            data = "".join(self.pending)
            self.pending.clear()
            for capture in self.active:
                capture.text(data)

    def _leave(self, depth: int, raw: str) -> None:
        for capture in self.active:
            capture.close(depth, raw)
        self.silent -= sum(tag in _SILENT for tag, _ in self.elements[depth:])
        del self.elements[depth:]
        self.active = [c for c in self.active if c.depth < depth]

    def finish(self) -> dict[str, list[dict]]:
        self.close()
        self._flush()
        self._leave(0, "")
        return self.found


# Tasks get the reader by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_pages(
    pages: DataFrame, key: str, html_column: str, groups: tuple[Group, ...]
) -> DataFrame:
    """One row per page: the key and, per group, an array of its records.

    Only key and markup travel to Python; one page is in memory as objects at a time.
    """
    layout = {
        g.name: pa.list_(pa.struct([pa.field(f.name, pa.string()) for f in g.fields]))
        for g in groups
    }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records: dict[str, list] = {name: [] for name in layout}
            for markup in batch.column(1):
                reader = _PageReader(groups)
                reader.feed(markup.as_py() or "")
                for name, rows in reader.finish().items():
                    records[name].append(rows)
            columns = [batch.column(0)] + [pa.array(records[n], t) for n, t in layout.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], *layout])

    record_types = ", ".join(
        f"{g.name} array<struct<{', '.join(f'{f.name}: string' for f in g.fields)}>>"
        for g in groups
    )
    key_type = pages.schema[key].dataType.simpleString()
    return pages.select(key, html_column).mapInArrow(read, f"{key} {key_type}, {record_types}")


def extract_group(pages: DataFrame, key: str, html_column: str, group: Group) -> DataFrame:
    """One row per record of one group: key, position on the page, the fields."""
    read = read_pages(pages, key, html_column, (group,))
    return read.select(key, F.posexplode(group.name).alias("position", "record")).select(
        key, "position", "record.*"
    )


def extract_cards(
    pages: DataFrame, key: str = "page_id", html_column: str = "html", group: Group = CARD_GROUP
) -> DataFrame:
    """Search result pages → card rows; cards without a usable id are dropped."""
    cards = extract_group(pages, key, html_column, group)
    return cards.withColumn("job_id", last_urn_part(F.col("urn"))).drop("urn").filter(
        F.col("job_id").isNotNull()
    )


def pivot_criteria(criteria: Column, columns=CRITERIA_COLUMNS) -> dict[str, Column]:
    """Label/value items of one page → columns, chosen by a word in the label.

    An item belongs to the first column whose word it holds; of several items for one column
    the last one stands. The items are in the row already, so nothing is shuffled.
    """
    def belongs(word: str, earlier: list[str]):
        def test(item: Column) -> Column:
            label = F.lower(item["label"])
            hit = F.contains(label, F.lit(word)) & item["value"].isNotNull()
            for other in earlier:
                hit = hit & ~F.contains(label, F.lit(other))
            return hit

        return test

    result, earlier = {}, []
    for name, word, lower_label in columns:
        last = F.try_element_at(F.filter(criteria, belongs(word, list(earlier))), F.lit(-1))
        label = F.lower(last["label"]) if lower_label else last["label"]
        result[name] = F.concat(label, F.lit("\n"), last["value"])
        earlier.append(word)
    return result


def easy_apply_flag(detail: Column) -> Column:
    return detail["apply_button"].isNotNull() | detail["apply_label"].isNotNull()


def extract_details(
    pages: DataFrame, key: str = "job_id", html_column: str = "html"
) -> DataFrame:
    """Detail pages → one wide row each."""
    read = read_pages(pages, key, html_column, (DETAIL_GROUP, CRITERIA_GROUP))
    detail = F.col("detail")[0]
    plain = [
        "title", "company", "company_url", "location", "posted_date", "number_of_applicants",
        "salary", "raw_description", "description_text",
    ]
    return read.select(
        key,
        *[detail[name].alias(name) for name in plain],
        F.coalesce(F.nullif(detail["posted_datetime"], F.lit("")), detail["posted_date"])
        .alias("posted_date_iso"),
        *[column.alias(name) for name, column in pivot_criteria(F.col("criteria")).items()],
        easy_apply_flag(detail).alias("easy_apply"),
    )
