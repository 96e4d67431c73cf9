"""Models as stages of a plan: loaded once a worker, fed with small batches of rows of like length, their errors values.

A stage is a function of columns whose result is a struct of ``value`` and ``error``, one of which is null. A batch on
which the model raises is given to it again row by row, so that only the rows that fail have an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that a model gets at once, and characters of an error that are kept.
BATCH, MOST_ERROR = 32, 300

Model = Callable[[list], list]
Stage = Callable[..., Column]

#: Models that a worker keeps, and the name of the module that holds them.
MOST_MODELS, _KEPT = 4, "docgrid_kept_models"


def _told(e: Exception) -> str:
    return (str(e) or type(e).__name__)[:MOST_ERROR]


def answers(model: Model, rows: list, sizes: list[int], batch: int = BATCH) -> tuple[list, list]:
    """(values, errors) of rows; rows of like size are given together."""
    values, errors = [None] * len(rows), [None] * len(rows)

    def asked(own: list[int]) -> list:
        got = list(model([rows[i] for i in own]))
        if len(got) != len(own):
            raise ValueError(f"the model gave {len(got)} answers to {len(own)} rows")
        return got

    order = sorted(range(len(rows)), key=lambda i: sizes[i])
    for start in range(0, len(order), batch):
        own = order[start : start + batch]
        try:
            for i, v in zip(own, asked(own), strict=True):
                values[i] = v
        except Exception:  # of a model, which may be any
            for i in own:
                try:
                    (values[i],) = asked([i])
                except Exception as e:
                    errors[i] = _told(e)
    return values, errors


def _model(key: str, load: Callable[[], Model]) -> Model:
    """The model of a stage, which the worker keeps from task to task, as it does with those of a few stages."""
    import sys
    import types

    # this package travels by value, so that its own globals are new in each task
    kept = sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)).__dict__.setdefault("models", {})
    if key not in kept:
        while len(kept) >= MOST_MODELS:
            del kept[next(iter(kept))]
        kept[key] = load()
    return kept[key]


def stage(load: Callable[[], Model], kind: str, batch: int = BATCH) -> Stage:
    """A stage of the model that ``load`` gives: a function from a list of rows to as many values of the SQL type ``kind``.

    A row is the value of the one column, or a tuple where there are several; arrays come as lists, structs as dictionaries. Rows whose first column is null
    are not given to the model; their value and error are null. Where ``load`` raises, all rows have its error.
    """
    key = uuid.uuid4().hex

    @F.arrow_udf(f"struct<value:{kind},error:string>")
    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for part in parts:
            columns = [c.to_pylist() for c in (part if isinstance(part, tuple) else (part,))]
            every = list(zip(*columns, strict=True))
            live = [i for i, x in enumerate(columns[0]) if x is not None]
            rows = [every[i] if len(columns) > 1 else every[i][0] for i in live]
            sizes = [sum(len(x) for x in every[i] if isinstance(x, str)) for i in live]
            try:
                got = answers(_model(key, load), rows, sizes, batch)
            except Exception as e:
                got = [None] * len(rows), [_told(e)] * len(rows)
            spread = [[None] * len(every), [None] * len(every)]
            for k in range(2):
                for i, v in zip(live, got[k], strict=True):
                    spread[k][i] = v
            yield pa.StructArray.from_arrays([pa.array(spread[0]), pa.array(spread[1], pa.string())], names=["value", "error"])

    return run


def values_of(made: Stage) -> Stage:
    """The stage's values alone, null where the model failed: for rewriting, planning, scoring and judging, which have a way on without it."""
    return lambda *columns: made(*columns)["value"]
