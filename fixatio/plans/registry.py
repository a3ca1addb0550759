"""Named queries: a Spark plan over a source folder, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fixatio.plans import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(
    name: str,
    final: str | None = None,
    nums: list[str] | None = None,
    others: list[str] | None = None,
    extra: dict[str, str] | None = None,
    digits: int = 7,
    sums: list[str] | None = None,
):
    """Register the decorated plan; ``final`` is a SELECT giving ``others``, ``nums`` and ``sums``.

    Doubles are rounded on both sides, so that summation order does not matter: ``nums`` to digits
    after the point, ``sums``, which may be of any size, to significant digits.
    """

    def wrap(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: present(fn(spark, sf_dir), digits, sums or [])
        if final is not None:
            picked = [*(others or []), *[oracle.rounded(f'"{n}"', digits) for n in nums or []],
                      *[oracle.significant(f'"{n}"') for n in sums or []]]
            ORACLE[name] = oracle.sql(
                f"select {', '.join(picked)} from ({final.strip()})", extra
            )
        return fn

    return wrap


def present(df: DataFrame, digits: int = 7, sums: Sequence[str] = ()) -> DataFrame:
    """Doubles rounded, arrays as text: the comparable form of a result."""
    out = []
    for f in df.schema.fields:
        if f.name in sums:
            out.append(f"case when `{f.name}` is not null then format_string('%.6e', cast(`{f.name}` as double) * 1.0000000037D + 0.0D) end as `{f.name}`")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(f"round(cast(`{f.name}` as double), {digits}) + 0.0D as `{f.name}`")
        elif isinstance(f.dataType, T.ArrayType):
            out.append(f"array_join(`{f.name}`, ',') as `{f.name}`")
        else:
            out.append(f"`{f.name}`")
    return df.selectExpr(*out)
