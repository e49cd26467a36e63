"""Repeated column families (ward path, diagnoses, procedures) as arrays.

A family is packed once at the edge - either from sibling columns of a wide row
(``pack_columns``) or from a long table (``pack_long``) - and all
per-row logic then runs as higher-order functions inside whole-stage codegen,
with no shuffle and no explode/re-group round trip.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColOrName = Column | str


def _c(c: ColOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pack_columns(cols: Sequence[ColOrName]) -> Column:
    """Sibling columns -> one array, in column order (nulls kept in place)."""
    return F.array(*[_c(c) for c in cols])


def pack_long(df: DataFrame, key: str, order: str, fields: Sequence[str], name: str = "path") -> DataFrame:
    """Long rows (key, order, fields...) -> one row per key with the steps sorted by
    ``order``. The input must already hold one row per (key, order) - aggregate it
    first with a partial aggregate - so a key's array is bounded by its number of
    distinct steps, never by its raw row count."""
    step = F.struct(F.col(order).alias(order), *[F.col(f) for f in fields])
    return df.groupBy(key).agg(F.sort_array(F.collect_list(step)).alias(name))


def first_match(arr: ColOrName, pred: Callable[[Column], Column], start: int = 1) -> Column:
    """1-based position of the first element at or after ``start`` for which
    ``pred`` holds (null predicate = no match); null when nothing matches."""
    flags = F.transform(_c(arr), lambda x, i: (i >= start - 1) & F.coalesce(pred(x), F.lit(False)))
    return F.nullif(F.array_position(flags, True), F.lit(0)).cast("int")


def sum_before(arr: ColOrName, pos: Column, field: str) -> Column:
    """Sum of ``field`` over the elements strictly before position ``pos`` (missing
    values count as 0); null when ``pos`` is null."""
    prior = F.slice(_c(arr), F.lit(1), pos - 1)
    return F.aggregate(prior, F.lit(0.0), lambda acc, x: acc + F.coalesce(x[field].cast("double"), F.lit(0.0)))


def sum_present(arr: ColOrName, field: str | None = None) -> Column:
    """Sum of the non-null values (of ``field`` for struct elements); null if none,
    which is how a row-wise ``sum`` skipping missing values behaves."""
    get = (lambda x: x[field]) if field else (lambda x: x)
    return F.aggregate(_c(arr), F.lit(None).cast("double"),
                       lambda acc, x: F.when(get(x).isNull(), acc)
                       .otherwise(F.coalesce(acc, F.lit(0.0)) + get(x).cast("double")))


def elapsed_before_steps(arr: ColOrName, field: str, out: str = "elapsed") -> Column:
    """Running sum of ``field`` before each step (own value excluded), as a new
    struct field ``out`` on every element."""
    a = _c(arr)
    return F.transform(a, lambda x, i: x.withField(out, F.aggregate(
        F.slice(a, F.lit(1), i), F.lit(0.0),
        lambda acc, y: acc + F.coalesce(y[field].cast("double"), F.lit(0.0)))))


def any_of(arr: ColOrName, pred: Callable[[Column], Column]) -> Column:
    """True if some element satisfies ``pred`` (null predicates read as false)."""
    return F.coalesce(F.exists(_c(arr), lambda x: F.coalesce(pred(x), F.lit(False))), F.lit(False))


def all_of(arr: ColOrName, pred: Callable[[Column], Column]) -> Column:
    """True if every element satisfies ``pred`` (null predicates read as false)."""
    return F.coalesce(F.forall(_c(arr), lambda x: F.coalesce(pred(x), F.lit(False))), F.lit(True))


def justify(arr: ColOrName, side: str = "left", invalid: object = None) -> Column:
    """Drop missing (or ``invalid``) entries and shift the rest to one side, order
    and width kept: [a, null, b] -> [a, b, null] (left) / [null, a, b] (right)."""
    a = _c(arr)
    if invalid is None:
        kept = F.filter(a, lambda x: x.isNotNull())
    else:
        kept = F.filter(a, lambda x: x.isNotNull() & (x != F.lit(invalid)))
    # nulls of the family's own type
    pad = F.slice(F.transform(a, lambda x: F.nullif(x, x)), F.lit(1), F.size(a) - F.size(kept))
    if side == "left":
        return F.concat(kept, pad)
    if side == "right":
        return F.concat(pad, kept)
    raise ValueError(f"side must be 'left' or 'right', got {side!r}")


def contains_all(arr: ColOrName, values: Sequence[str]) -> Column:
    """Row holds every value of ``values`` (set containment)."""
    want = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.size(F.array_except(want, F.coalesce(_c(arr), F.array().cast("array<string>")))) == 0,
                      F.lit(False))


def contains_any(arr: ColOrName, values: Sequence[str]) -> Column:
    """Row holds at least one value of ``values``."""
    return any_of(arr, lambda x: x.isin(list(values)))


def true_names(flags: dict[str, ColOrName], sep: str = "") -> Column:
    """Names of the true flags joined by ``sep`` (a row of dummies -> its label)."""
    return F.concat_ws(sep, *[F.when(F.coalesce(_c(c), F.lit(False)), F.lit(n)) for n, c in flags.items()])
