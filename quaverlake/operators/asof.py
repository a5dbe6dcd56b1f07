"""As-of joins by union and carry, without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.operators.segments import carry_last, carry_next


def _unioned(left: DataFrame, right: DataFrame, keys, position, seq, values, right_side):
    names = [c for c in left.columns]
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    l = left.select(*keys, F.col(position).alias("__pos"), F.lit(1 - right_side).alias("__side"),
                    F.lit(None).cast("bigint").alias("__seq"),
                    F.struct(*[F.col(c) for c in names]).alias("__row"), F.lit(None).alias("__val"))
    r = right.select(*keys, F.col(position).alias("__pos"), F.lit(right_side).alias("__side"),
                     (F.col(seq) if seq else F.lit(0)).cast("bigint").alias("__seq"),
                     F.lit(None).alias("__row"), payload.alias("__val"))
    return l.unionByName(r), names


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], position: str, values: Sequence[str],
              seq: str | None = None, defaults: dict[str, object] | None = None,
              chunk_width: float | None = None) -> DataFrame:
    """J-09: each left row gets the last right row of its key at or before its position.

    Of several right rows at one position the last written (by ``seq``) counts. ``chunk_width``
    cuts long keys into stretches of that length. Rows before the first right row get
    ``defaults``.
    """
    both, names = _unioned(left, right, keys, position, seq, values, 0)
    chunk = F.floor(F.col("__pos") / F.lit(chunk_width)).cast("bigint") if chunk_width else None
    order = ["__pos", "__side", "__seq"]
    return _finish(carry_last(both, keys, order, F.col("__val"), "__hit", chunk), names, values, defaults)


def asof_next(left: DataFrame, right: DataFrame, keys: Sequence[str], position: str, values: Sequence[str],
              seq: str | None = None, defaults: dict[str, object] | None = None,
              chunk_width: float | None = None, strict: bool = True) -> DataFrame:
    """The first right row after (or, when not strict, at or after) the left row's position."""
    both, names = _unioned(left, right, keys, position, seq, values, 0 if strict else 1)
    chunk = F.floor(F.col("__pos") / F.lit(chunk_width)).cast("bigint") if chunk_width else None
    order = ["__pos", "__side", "__seq"]
    return _finish(carry_next(both, keys, order, F.col("__val"), "__hit", chunk), names, values, defaults)


def _finish(carried: DataFrame, names, values, defaults) -> DataFrame:
    defaults = defaults or {}
    cols: list[Column] = []
    for v in values:
        hit = F.col(f"__hit.{v}")
        cols.append((F.coalesce(hit, F.lit(defaults[v])) if v in defaults else hit).alias(v))
    return (carried.filter(F.col("__row").isNotNull())
            .select(*[F.col(f"__row.{n}").alias(n) for n in names], *cols))
