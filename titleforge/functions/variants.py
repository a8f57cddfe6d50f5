"""Reading records whose fields may be missing, texts or structures."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def each(v: Column, path: str) -> Column:
    """The elements of a list; none if it is no list."""
    return F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def text_of(v: Column) -> Column:
    """A name: the text itself, or the ``name`` of a structure."""
    return F.when(is_object(v), get(v, "name")).otherwise(F.try_variant_get(v, "$", "string"))


def filled(c: Column) -> Column:
    """The text if it is neither empty nor a zero, a false or an empty list."""
    return F.when(~F.trim(c).isin("", "0", "0.0", "false", "[]", "{}"), c)


def first_of(v: Column, paths: str, read: Callable[[Column, str], Column] = get) -> Column:
    """Of paths divided by ``|``, the first with a value."""
    options = paths.split("|")
    if len(options) == 1:
        return read(v, options[0])
    return F.coalesce(*(filled(read(v, p)) for p in options))


def _leaves(x: object) -> Iterator[str]:
    if isinstance(x, str):
        yield x
    elif isinstance(x, dict):
        for k, v in x.items():
            if not k.startswith("_"):
                yield from _leaves(v)
    elif isinstance(x, list):
        for v in x:
            yield from _leaves(v)


@pandas_udf(T.ArrayType(T.StringType()))
def text_leaves(data: pd.Series) -> pd.Series:
    """All texts of a JSON record, at any depth, but for those under a key that starts with ``_``."""

    def one(text: str | None) -> list[str]:
        try:
            return list(_leaves(json.loads(text or "null")))
        except ValueError:
            return []

    return data.map(one)
