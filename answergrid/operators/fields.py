"""Titled fields of JSON documents as text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answergrid.functions import documents, matching
from answergrid.functions.names import field_names, free_names
from answergrid.functions.strategies import (
    Strategy,
    applicable,
    as_strategy,
    default_strategies,
    flexible_array,
    nested_list,
)

StrategyLike = Strategy | Callable[[Column, str], Column]


def _chosen_strategies(
    strategies: Iterable[StrategyLike] | None,
    value_keys: Sequence[str] | None,
    match_keys: Sequence[str] | None,
    name_key: str | None,
    value_key: str | None,
    mode: str,
) -> list[Strategy]:
    if strategies is not None:
        return [as_strategy(s) for s in strategies]
    if mode == "keys":
        if not (name_key and value_key):
            raise ValueError("mode 'keys' needs name_key and value_key")
        value_keys, match_keys = [value_key], [name_key]
    elif mode != "compat":
        raise ValueError(f"unknown mode: {mode!r}")
    keys = {}
    if value_keys:
        keys["value_keys"] = tuple(value_keys)
    if match_keys:
        keys["match_keys"] = tuple(match_keys)
    return [nested_list(**keys), flexible_array(**keys)] if keys else list(default_strategies())


def fields_as_columns(
    df: DataFrame,
    json_col: str | Mapping[str, Sequence[str]],
    titles: Sequence[str] | None = None,
    *,
    strategies: Iterable[StrategyLike] | None = None,
    value_keys: Sequence[str] | None = None,
    match_keys: Sequence[str] | None = None,
    name_key: str | None = None,
    value_key: str | None = None,
    mode: str = "compat",
    default: str | None = "",
    pattern_length: int | None = None,
) -> DataFrame:
    """Add one text column per field title, found in a JSON column.

    ``json_col`` is a column name with ``titles``, or a mapping from several
    column names to their titles.  Columns are named by ``field_names`` over
    all titles, so ``select`` puts them anywhere in a select list.

    The first strategy that finds the title decides; ``default`` is the value
    when none does.  ``value_keys`` and ``match_keys`` replace the keys of both
    built-in strategies.  ``name_key`` and ``value_key`` count only in
    ``mode="keys"``, where they are the only keys.  Strategies look for the whole
    title, or for its first ``pattern_length`` characters.  A column of ``df`` is
    never replaced: a title whose name is taken gets its position.

    The result needs no shuffle, so it also runs on streams.  Each document is
    parsed once, what its titles share is prepared once, and each title then
    searches the prepared records.  What is prepared passes through a generator of
    one row, so that a filter on a new column repeats that column's search only.
    """
    wanted = dict(json_col) if isinstance(json_col, Mapping) else {json_col: list(titles or [])}
    chosen = _chosen_strategies(strategies, value_keys, match_keys, name_key, value_key, mode)
    all_titles = [title for column in wanted.values() for title in column]
    if not all_titles:
        return df
    made = field_names(all_titles, df.columns)
    ready, *docs = free_names([*df.columns, *made], "prepared", *(f"document_{i}" for i in range(len(wanted))))

    names, parsed, prepared, results = iter(made), {}, {}, {}
    for i, (column, column_titles) in enumerate(wanted.items()):
        doc = f"document_{i}"
        parsed[docs[i]] = documents.document_of(df, column)
        cut = [matching.make_pattern(t, pattern_length) for t in column_titles]
        for j, strategy in enumerate(chosen):
            own = [t for t in cut if strategy.applies(t)]
            whole = F.col(docs[i])
            prepared[f"{doc}_{j}"] = strategy.prepare(whole, own) if strategy.prepare else whole
        for title in cut:
            found = [
                s.extract(F.col(ready)[f"{doc}_{chosen.index(s)}"], title)
                for s in applicable(chosen, title)
            ]
            results[next(names)] = F.coalesce(*found, F.lit(default))

    once = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in prepared.items()])))
    return df.withColumns(parsed).select("*", once.alias(ready)).withColumns(results).drop(ready, *parsed)


def _sql_search(items: str, match_keys: Sequence[str], value_keys: Sequence[str]) -> str:
    tests = " OR ".join(f"coalesce(lower(e.`{k}`) LIKE pattern, false)" for k in match_keys)
    values = ", ".join(f"e.`{k}`" for k in value_keys)
    return f"get(transform(filter({items}, e -> {tests}), e -> coalesce({values}, '')), 0)"


def _sql_fields(titles: str, pattern_length: int | None) -> str:
    """SQL of the texts that ``titles`` have in the document ``json``."""
    list_keys = [*matching.LIST_MATCH_KEYS, *matching.LIST_VALUE_KEYS]
    root_keys = [*matching.ARRAY_MATCH_KEYS, *matching.ARRAY_VALUE_KEYS]
    root_type = documents.record_type(root_keys)
    in_list = _sql_search("found.in_list", matching.LIST_MATCH_KEYS, matching.LIST_VALUE_KEYS)
    in_root = _sql_search("found.in_root", matching.ARRAY_MATCH_KEYS, matching.ARRAY_VALUE_KEYS)
    start = "title" if pattern_length is None else f"left(title, {pattern_length})"
    # Arrays of one element give a name to what must be worked out only once.
    return f"""
        get(transform(
            transform(array(try_parse_json(json)), doc -> named_struct(
                'in_list', try_variant_get(doc, '$.list', 'array<{documents.record_type(list_keys)}>'),
                'in_root', coalesce(
                    try_variant_get(doc, '$', 'array<{root_type}>'),
                    array(try_variant_get(doc, '$', '{root_type}'))
                )
            )),
            found -> transform(
                transform({titles}, title ->
                    lower(concat('%', replace({start}, chr(92), repeat(chr(92), 2)), '%'))),
                pattern -> coalesce({in_list}, {in_root}, '')
            )
        ), 0)"""


def register_sql_functions(spark: SparkSession, pattern_length: int | None = None) -> None:
    """Make two functions available in SQL for this session.

    ``json_fields(json, titles)`` gives the texts of an array of titles, with one
    parse of the document; ``json_field(json, title)`` gives one.  Both follow
    ``fields_as_columns``.  The optimizer inlines them, so they take part in
    filters, sorts and limits like any expression; every call in the text parses
    by itself, and so does a filter on its result.  To filter with one parse, put
    ``array(json_fields(..)) AS once`` in a subquery and read it through
    ``LATERAL VIEW OUTER explode(once)``.
    """
    documents.configure(spark)
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION json_fields(json STRING, titles ARRAY<STRING>)
        RETURNS ARRAY<STRING>
        RETURN {_sql_fields("titles", pattern_length)}
        """
    )
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION json_field(json STRING, title STRING)
        RETURNS STRING
        RETURN get(json_fields(json, array(title)), 0)
        """
    )


def register_field_table(
    spark: SparkSession, name: str, titles: Sequence[str], pattern_length: int | None = None
) -> list[str]:
    """Make a SQL table function whose columns are the titles; returns their names.

    ``FROM t, LATERAL name(t.json) AS f`` joins one row of texts to every row of ``t``:
    ``f.status`` can stand in select lists, filters and sorts, any number of times, with one
    parse of the document.  The names are those of ``field_names``.
    """
    documents.configure(spark)
    names = field_names(titles)
    text = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    columns = ", ".join(f"`{n}` STRING" for n in names)
    found = ", ".join(f"found[{i}]" for i in range(len(names)))
    # An array of one element, exploded: what lies above does not repeat what it holds.
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION `{name}`(json STRING)
        RETURNS TABLE ({columns})
        RETURN SELECT {found}
        FROM explode(array({_sql_fields(f"array({', '.join(map(text, titles))})", pattern_length)})) AS t(found)
        """
    )
    return names
