"""Ways to find the value of a titled field in a document.

A strategy turns a document and a title into a text column that is NULL where
the strategy found nothing.  Strategies are tried in order.  ``prepare`` does
the work that all titles of one document share; ``extract`` then costs little
per title.  Any function ``(document, title) -> Column`` can be a strategy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from answergrid.functions import documents, matching

Titles = Sequence[str]


def _always(title: str) -> bool:
    return True


@dataclass(frozen=True)
class Strategy:
    """One way of looking a title up."""

    name: str
    extract: Callable[[Column, str], Column]
    prepare: Callable[[Column, Titles], Column] | None = None
    applies: Callable[[str], bool] = _always

    def value(self, doc: Column, title: str) -> Column:
        """The strategy alone, for one title."""
        prepared = self.prepare(doc, [title]) if self.prepare else doc
        return self.extract(prepared, title)


def as_strategy(item: Strategy | Callable[[Column, str], Column]) -> Strategy:
    if isinstance(item, Strategy):
        return item
    return Strategy(getattr(item, "__name__", "custom"), item)


def strategy_names(strategies: Iterable) -> list[str]:
    return [as_strategy(s).name for s in strategies]


def applicable(strategies: Iterable, title: str) -> list[Strategy]:
    """The strategies that take part for a title, in order."""
    return [s for s in map(as_strategy, strategies) if s.applies(title)]


def _searchable(items: Column, match_keys: Titles, value_keys: Titles, titles: Titles) -> Column:
    """Per record: the lower-case text to search in and the value to return.

    The texts of all match keys are joined by a character no title contains,
    so one search covers them without matching across two texts.  Titles with
    wildcards could match across, so for them the texts are also kept apart.
    """
    mark = matching.unused_character(titles)
    apart = any(matching.has_wildcards(matching.make_pattern(t)) for t in titles)

    def shape(e: Column) -> Column:
        parts = [
            F.lower(F.concat_ws(mark, *[e[k] for k in match_keys])).alias("text"),
            matching.pick_value(e, value_keys).alias("value"),
        ]
        if apart:
            parts.append(F.array(*[F.lower(e[k]) for k in match_keys]).alias("texts"))
        return F.struct(*parts)

    return F.transform(items, shape)


def _first_match(prepared: Column, title: str) -> Column:
    pattern = matching.make_pattern(title)
    if matching.has_wildcards(pattern):
        def test(e: Column) -> Column:
            return F.exists(e["texts"], lambda t: matching.contains_pattern(t, pattern))
    else:
        def test(e: Column) -> Column:
            return matching.contains_pattern(e["text"], pattern)
    return F.get(F.filter(prepared, test), F.lit(0))["value"]


def nested_list(
    value_keys: Titles = matching.LIST_VALUE_KEYS,
    match_keys: Titles = matching.LIST_MATCH_KEYS,
) -> Strategy:
    """The first item of the array ``$.list`` whose title contains the pattern.

    A matched item without a value gives an empty text, which ends the search.
    """
    keys = [*match_keys, *value_keys]
    return Strategy(
        "nested_list",
        _first_match,
        lambda doc, titles: _searchable(
            documents.records(doc, "$.list", keys), match_keys, value_keys, titles
        ),
    )


def flexible_array(
    value_keys: Titles = matching.ARRAY_VALUE_KEYS,
    match_keys: Titles = matching.ARRAY_MATCH_KEYS,
) -> Strategy:
    """The same over the root array, or over the root as the only item."""
    keys = [*match_keys, *value_keys]
    return Strategy(
        "flexible_array",
        _first_match,
        lambda doc, titles: _searchable(
            documents.root_records(doc, keys), match_keys, value_keys, titles
        ),
    )


def direct_field() -> Strategy:
    """The value stored under the title itself, as in ``{"Full Name": "Ann"}``."""
    return Strategy("direct_field", documents.field_text)


def positional() -> Strategy:
    """Rows such as ``["Full Name", "Ann"]``: item 0 matches, item 1 is the value."""

    def prepare(doc: Column, titles: Titles) -> Column:
        rows = F.try_variant_get(doc, documents.ROOT, "array<array<string>>")
        return F.transform(
            rows,
            lambda r: F.struct(
                F.array(F.lower(F.get(r, F.lit(0)))).alias("texts"),
                F.lower(F.get(r, F.lit(0))).alias("text"),
                F.coalesce(F.get(r, F.lit(1)), F.lit("")).alias("value"),
            ),
        )

    return Strategy("positional", _first_match, prepare)


def exact_title(value_key: str = "value_text", match_key: str = "question_title") -> Strategy:
    """An object of records: the one whose title equals the whole title.

    Records are taken in the order of their key's length, then of the key.  A
    record without a value gives NULL, like a title that is absent.
    """
    record = documents.record_type([match_key, value_key])

    def prepare(doc: Column, titles: Titles) -> Column:
        entries = F.map_entries(documents.object_map(doc, value_type=record))
        return F.sort_array(
            F.transform(
                entries,
                lambda e: F.struct(
                    F.octet_length(e["key"]).alias("key_length"),
                    e["key"].alias("key"),
                    e["value"][match_key].alias("title"),
                    e["value"][value_key].alias("value"),
                ),
            )
        )

    def extract(prepared: Column, title: str) -> Column:
        place = F.array_position(prepared["title"], F.lit(title))
        return F.get(prepared["value"], (place - 1).cast("int"))

    return Strategy("exact_title", extract, prepare)


def coalesce_paths(doc: Column, paths: Iterable[str], default: str | None = None) -> Column:
    """The first text found under any of the JSON paths."""
    found = [F.try_variant_get(doc, p, "string") for p in paths]
    return F.coalesce(*found, F.lit(default))


# Where a hidden e-mail address may be stored.
EMAIL_PATHS = (
    "$.hidden.email", "$.hidden.Email", "$.hidden.EMAIL", "$.email", "$.Email", "$.EMAIL",
)


def hidden_email(doc: Column) -> Column:
    """The hidden e-mail address, else the one at the root, else empty."""
    return coalesce_paths(doc, EMAIL_PATHS, default="")


def default_strategies() -> tuple[Strategy, ...]:
    """Item list first, then root array or object."""
    return (nested_list(), flexible_array())
