"""Column expressions on text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the fast built-in, which then does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def row_key(row_id: Column, text: Column) -> Column:
    """128-bit key of a row, 16 bytes, for stages that judge each row: rows with the same key repeat both id (which may be null) and text."""
    parts = [F.xxhash64(F.lit(seed), row_id.isNull(), row_id, F.coalesce(text, F.lit(""))) for seed in (1, 2)]
    return F.to_binary(F.concat(*[F.lpad(F.hex(p), 16, "0") for p in parts]), F.lit("hex"))


def words(text: Column) -> Column:
    """Maximal runs of non-blank characters of the A-Z-lower-cased text; null and blank text give an empty array."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), BLANKS), "")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, *ks: int) -> Column:
    """Distinct hashes of the k-word shingles of `text`, for each of the given k; none for a k of more than its words."""
    none = F.array().cast("array<bigint>")

    def windows(hashes: Column, k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (k - 1))
        return F.when(F.size(hashes) >= k, F.transform(starts, lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(k)]))).otherwise(none)

    def of(hashes: Column) -> Column:
        return F.array_distinct(windows(hashes, ks[0]) if len(ks) == 1 else F.concat(*[windows(hashes, k) for k in ks]))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of) if ks else none


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by the logistic approximation (error below 0.0002)."""
    z = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))
