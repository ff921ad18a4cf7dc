"""Feature functions as columns: bins, buckets, hashed and joined values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_bin(value: str | Column) -> Column:
    """Counters above 2 by the square of their logarithm, the others as SP and the value."""
    v = _col(value)
    return F.when(v > 2, F.floor(F.pow(F.ln(v.cast("double")), 2)).cast("string")).otherwise(F.concat(F.lit("SP"), v.cast("string")))


def hash_bucket(text: str | Column, bins: int = 1_000_000) -> Column:
    """The MD5 as a number, modulo bins - 1, plus 1; worked out in chunks of 32 bits."""
    digest, m = F.md5(_col(text)), bins - 1
    out = F.lit(0).cast("long")
    for i in range(4):
        chunk = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        out = (out * F.lit((1 << 32) % m) + chunk) % m
    return out + 1


def bucket_groups(values: str | Column, lists: list[list[int]]) -> list[Column]:
    """Each value of a list joins the first of lists that has it, or the orphans; each bucket is sorted as text and joined."""
    v = F.transform(_col(values), lambda x: x.cast("string"))
    taken: list[str] = []
    out = []
    for one in lists:
        own = [str(x) for x in one if str(x) not in taken]
        taken += own
        out.append(F.array_join(F.array_sort(_members(v, own)), ","))
    return [*out, F.array_join(F.array_sort(_members(v, taken, inside=False)), ",")]


def _members(values: Column, names: list[str], inside: bool = True) -> Column:
    return F.filter(values, lambda x: x.isin(names) if inside else ~x.isin(names))


def crc32_text(text: str | Column) -> Column:
    """CRC-32 as decimal text."""
    return F.crc32(_col(text)).cast("string")


def soft_log_bins(value: str | Column, shift: int = 0) -> Column:
    """bin:weight texts: missing for negative values, 0 for 0, else the two bins around 1.4 ln(1 + x), weighted by nearness."""
    x = _col(value).cast("double") + shift
    y = 1.4 * F.ln(1 + x)
    low = F.floor(y)
    up = F.bround(y - low, 4)
    both = F.concat_ws(" ", F.concat_ws(":", low.cast("string"), F.bround(1 - (y - low), 4).cast("string")), F.concat_ws(":", (low + 1).cast("string"), up.cast("string")))
    return F.when(x < 0, "NA").when(x == 0, "0").otherwise(both)


def rare_replace(value: str | Column, count: str | Column, field: str, least: int = 10) -> Column:
    """The value, or field and less where it is seen less often than least."""
    return F.when(_col(count) >= least, _col(value).cast("string")).otherwise(f"{field}less")


def request_key(*cols: str) -> Column:
    """Values joined by hyphens, null as empty."""
    return F.concat_ws("-", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))


def ffm_features(fields: dict[str, str], bins: int = 1_000_000) -> Column:
    """field:bucket:1 for each field (number: column), joined by spaces; the bucket is that of number-value."""
    return F.concat_ws(" ", *(F.concat_ws(":", F.lit(f), hash_bucket(F.concat_ws("-", F.lit(f), F.coalesce(F.col(c).cast("string"), F.lit(""))), bins).cast("string"), F.lit("1")) for f, c in fields.items()))


def sigmoid(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def quadratic_pairs(values: str | Column, excluded: tuple[str, ...] = ()) -> Column:
    """a*b for each pair of different places in order, without the excluded pairs."""
    v = _col(values)
    pairs = F.flatten(F.transform(v, lambda a, i: F.transform(F.slice(v, i + 2, F.size(v)), lambda b: F.concat_ws("*", a, b))))
    return F.filter(pairs, lambda p: ~p.isin(*excluded)) if excluded else pairs


def rbf_levenshtein(a: str | Column, b: str | Column, gamma: float = 0.1) -> Column:
    """exp(-gamma d^2) of the edit distance."""
    return F.exp(-gamma * F.pow(F.levenshtein(_col(a), _col(b)), 2))
