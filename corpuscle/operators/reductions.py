"""Users' own reductions that combine before and on the way through the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Reduction(Protocol):
    """A reduction whose parts can be merged in any grouping; a state is a tuple of the state schema's columns."""

    state: str  # schema of a state
    result: str  # schema of the rows that final gives, without the key

    def partial(self, rows: pd.DataFrame) -> tuple:
        """The state of some rows of a key."""

    def merge(self, one: tuple, other: tuple) -> tuple:
        """The state of both ones' rows; the order in which parts come is any."""

    def final(self, state: tuple) -> Iterable[tuple]:
        """Rows of the result."""


#: Keys whose states a task holds before it hands them on, and parts that a key's states are dealt to on their way.
HELD, WAYS = 50_000, 16


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def _plain(value: Any) -> Any:
    return None if value is None or value is pd.NaT or isinstance(value, float) and value != value else value


def reduce_by_key(rows: DataFrame, key: str, make: Callable[[], Reduction], held: int = HELD, ways: int = WAYS) -> DataFrame:
    """(key, result columns) of a user's Reduction over all rows of each key; make() gives one in each task.

    Each task reduces its rows to one state a key, or more where it meets more than held keys. States of a key first
    meet in up to ways parts, then once: even where all rows share one key, no task sees more than its share of rows
    or a ways-th of the tasks' states, and never a group of rows. A null key is a key. Where built-in aggregates do,
    they are the better choice.
    """
    made = make()
    kind = dict(rows.dtypes)[key]
    schema = f"`{key}` {kind}, {made.state}"
    columns = _names(made.state)

    def combine(batches):
        reduction, states = make(), {}
        for batch in batches:
            for value, group in batch.groupby(key, sort=False, dropna=False):
                value, state = _plain(value), reduction.partial(group)
                states[value] = reduction.merge(states[value], state) if value in states else state
            if len(states) > held:
                yield pd.DataFrame([(k, *s) for k, s in states.items()], columns=[key, *columns])
                states = {}
        yield pd.DataFrame([(k, *s) for k, s in states.items()], columns=[key, *columns])

    def merged(group: pd.DataFrame) -> tuple[Any, tuple]:
        reduction, state = make(), None
        for row in group[columns].itertuples(index=False, name=None):
            row = tuple(_plain(x) if not isinstance(x, (list, tuple, dict)) and not hasattr(x, "__len__") else x for x in row)
            state = row if state is None else reduction.merge(state, row)
        return _plain(group[key].iloc[0]), state

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        value, state = merged(group)
        return pd.DataFrame([(value, *state)], columns=[key, *columns])

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        value, state = merged(group)
        return pd.DataFrame([(value, *row) for row in make().final(state)], columns=[key, *_names(made.result)])

    way = "_way"
    partial = rows.mapInPandas(combine, schema).withColumn(way, F.spark_partition_id() % ways)
    half = partial.groupBy(key, way).applyInPandas(lambda g: meet(g.drop(columns=way)), schema)
    return half.groupBy(key).applyInPandas(finish, f"`{key}` {kind}, {made.result}")
