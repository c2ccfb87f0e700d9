"""Canonical bytes of values and trials, as columns: a tag, then names and numbers in little-endian order.

Bytes are put together as hexadecimal text by built-in functions and turned into binary once, so they are hashed as
bytes and nothing leaves the JVM. The bits of a double come from its exact hexadecimal notation; every NaN has the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tags of value kinds and of a trial.
TAGS = {"integer": 0x01, "double": 0x02, "boolean": 0x03, "string": 0x04, "selection": 0x05}
TRIAL_TAG = 0x60


def _reversed(digits: Column, size: int) -> Column:
    """Pairs of hexadecimal digits from the last to the first."""
    return F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)])


def long_hex(value: Column) -> Column:
    """Eight bytes of a long."""
    return _reversed(F.lpad(F.hex(value.cast("long")), 16, "0"), 8)


def uint_hex(value: Column) -> Column:
    """Four bytes of a number from 0 to 2^32 - 1."""
    return _reversed(F.lpad(F.hex(value.cast("long")), 8, "0"), 4)


def double_hex(value: Column) -> Column:
    """Eight bytes of a double."""
    parts = F.split(F.format_string("%a", value), "[x.p]")  # sign and 0, leading digit, fraction, exponent of two
    sign = F.when(F.startswith(parts[0], F.lit("-")), 0x800).otherwise(0)
    power = F.when(parts[1] == "1", F.try_element_at(parts, F.lit(4)).cast("int") + 1023).otherwise(0)
    finite = F.concat(F.lpad(F.hex((sign + power).cast("long")), 3, "0"), F.rpad(F.upper(F.try_element_at(parts, F.lit(3))), 13, "0"))
    infinite = F.when(value > 0, "7FF0000000000000").otherwise("FFF0000000000000")
    digits = F.when(F.isnan(value), "7FF8000000000000").when(F.abs(value) == float("inf"), infinite).otherwise(finite)
    return _reversed(digits, 8)


def text_hex(value: Column) -> Column:
    """The bytes of a text in UTF-8."""
    return F.hex(F.encode(value, "UTF-8"))


def framed_hex(value: Column) -> Column:
    """The number of bytes of a text, then the bytes."""
    return F.concat(uint_hex(F.octet_length(value)), text_hex(value))


def _by_bytes(items: Column) -> Column:
    """Distinct texts in the order of their bytes (Spark compares strings so)."""
    return F.array_sort(F.array_distinct(items))


def value_bytes(kind: Column, name: Column, integer: Column, double: Column, boolean: Column, string: Column, selection: Column) -> Column:
    """A value's canonical bytes: its kind's tag, its parameter's name, a zero byte, the value. Selections are sets.

    Null where the kind is unknown or the value of the kind is null."""
    payload = {
        "integer": long_hex(integer),
        "double": double_hex(double),
        "boolean": F.when(boolean, "01").otherwise(F.when(~boolean, "00")),
        "string": framed_hex(string),
        "selection": F.concat(uint_hex(F.size(F.array_distinct(selection))), F.array_join(F.transform(_by_bytes(selection), framed_hex), "")),
    }
    body = reduce(lambda rest, k: F.when(kind == k, F.concat(F.lit(f"{TAGS[k]:02X}"), text_hex(name), F.lit("00"), payload[k])).otherwise(rest), TAGS, F.lit(None).cast("string"))
    return F.unhex(body)


def value_fingerprint(value: Column) -> Column:
    """SHA-256 of canonical bytes, 64 hexadecimal digits."""
    return F.sha2(value, 256)


def trial_bytes(assignments: DataFrame, trial: str = "trial_id") -> DataFrame:
    """(trial, bytes): the canonical bytes of whole trials from rows (trial, element, parameter, fingerprint of the value).

    Elements and their parameters in the order of their names' bytes; of rows that repeat a parameter the largest
    fingerprint counts. A group is one trial's parameters: as large as a plan, not as the table."""
    one = assignments.groupBy(trial, "element", "parameter").agg(F.max("fingerprint").alias("fingerprint"))
    row = F.struct("parameter", F.concat(framed_hex(F.col("parameter")), F.upper("fingerprint")).alias("hex"))
    joined = lambda rows: F.array_join(F.transform(rows, lambda r: r["hex"]), "")
    elements = one.groupBy(trial, "element").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    element = F.struct("element", F.concat(framed_hex(F.col("element")), uint_hex(F.size("_rows")), joined(F.col("_rows"))).alias("hex"))
    trials = elements.groupBy(trial).agg(F.array_sort(F.collect_list(element)).alias("_rows"))
    return trials.select(trial, F.unhex(F.concat(F.lit(f"{TRIAL_TAG:02X}"), uint_hex(F.size("_rows")), joined(F.col("_rows")))).alias("bytes"))
