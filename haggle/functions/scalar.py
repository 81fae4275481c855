"""Column helpers: text, time, rounding, buckets, hashes. No Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column | str) -> Column:
    """Missing and empty text are the same."""
    col = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(col.cast("string")), F.lit(""))


def canonical_id(c: Column) -> Column:
    """Lower case, runs of other characters as one underscore."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column, bound: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -bound, bound)))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is null or 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def money(c: Column) -> Column:
    """Half-up to cents in decimals."""
    return F.round(c.cast("decimal(38,6)"), 2).cast("decimal(18,2)")


def entropy_bits(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def short_hash(c: Column, digits: int = 16) -> Column:
    return F.substring(sha256_hex(c), 1, digits)


def hash_uniform(c: Column) -> Column:
    """A draw in [0, 1) from the first 64 bits of a sha256."""
    head = F.conv(F.substring(sha256_hex(c), 1, 16), 16, 10).cast("decimal(20,0)")
    return head.cast("double") / F.lit(float(2**64))


def partition_id(c: Column, n: int) -> Column:
    """int(sha256(text)) mod n, folding the digest eight hex digits at a time."""
    digest = sha256_hex(c)
    acc = F.lit(0).cast("long")
    shift = (16**8) % n
    for i in range(8):
        part = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        acc = F.pmod(acc * F.lit(shift) + part, F.lit(n))
    return acc


def row_text(cols: list[str]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def row_hash(cols: list[str]) -> Column:
    """Upper-case sha256 of the columns joined by the unit separator."""
    return F.upper(F.sha2(row_text(cols), 256))


def json_hash(cols: list[str]) -> Column:
    """sha256 of the sorted-key JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def bucket(c: Column, edges: list[float], labels: list[str], missing: str | None = None,
           last_inclusive: bool = False) -> Column:
    """Half-open buckets: labels[i] below edges[i], the last label above all.
    With last_inclusive the last edge belongs to the bucket below it."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    out = F.when(c.isNull(), F.lit(missing))
    for i, (edge, label) in enumerate(zip(edges, labels)):
        below = c <= edge if last_inclusive and i == len(edges) - 1 else c < edge
        out = out.when(below, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def iso_time(c: Column) -> Column:
    """ISO text (with Z or an offset) to a timestamp, null when malformed."""
    return F.try_to_timestamp(F.trim(c))


def zoned(c: Column) -> Column:
    """Whether the time text names its zone."""
    return F.trim(c).rlike(r"(Z|[+-]\d{2}:?\d{2})$")


def seconds_between(start: Column, end: Column) -> Column:
    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    return (micros(end) - micros(start)) / F.lit(1e6)


def days_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(86400.0)


def hour_fraction(c: Column) -> Column:
    return F.hour(c) + F.minute(c) / F.lit(60.0)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def first_match(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds, null when none does."""
    out = None
    for name, cond in rules.items():
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def count_map(keys: Column, counts: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(keys, counts))))


def unpivot_row(pairs: dict[str, Column], name: str, value: str, cast: str) -> Column:
    """One aggregate row as (name, value) rows."""
    return F.inline(F.array(*[F.struct(F.lit(k).alias(name), v.cast(cast).alias(value)) for k, v in pairs.items()]))
