"""Small Column helpers shared by the function modules."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values) -> Column:
    """A literal ``array<string>``; typed also when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, words) -> Column:
    return any_of(text.contains(w) for w in words)


def kept(*pairs) -> Column:
    """The values whose condition holds, in order: ``kept((cond, value), …)``."""
    return F.array_compact(F.array(*[F.when(c, v) for c, v in pairs]))


def shown(number: Column, scale: int = 0) -> Column:
    """A number as text, ties rounded to even."""
    rounded = F.bround(number.cast("double"), scale)
    return F.format_string(f"%.{scale}f", rounded)


def computed_once(rows: DataFrame, keep, columns: dict[str, Column]) -> DataFrame:
    """``keep`` plus ``columns``, as a step that later filters do not look through.

    A filter on a projected column is pushed below the projection by repeating the
    column's expression; for long chains of expensive steps that repeats the whole
    chain.  Values that come out of a generator are evaluated once.
    """
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return rows.select(*keep, F.inline_outer(packed))
