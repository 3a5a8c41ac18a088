"""Song ids: a 53-bit FNV-1a hash of the file name, and what else a file name tells."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ID = (1 << 53) - 1
# Fixed values of 64-bit FNV-1a; only the low 53 bits of the state matter, for the prime's multiples of
# 2**53 vanish under the mask.
_OFFSET = 14695981039346656037 & MAX_ID
_PRIME_HIGH, _PRIME_LOW = 1 << 40, 435


class InvalidId(ValueError):
    def __init__(self):
        super().__init__(f"Invalid ID format. Must be an unsigned integer between 0 and {MAX_ID}.")


def lyric_id(filename: Column) -> Column:
    """Id of a file name, as a long. The product is split so that it stays within a signed long."""
    digits = F.hex(F.encode(filename, "UTF-8"))
    n = F.octet_length(filename)

    def step(state: Column, i: Column) -> Column:
        x = state.bitwiseXOR(F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
        low = x.bitwiseAND(F.lit((1 << 13) - 1))
        return (low * F.lit(_PRIME_HIGH) + x * F.lit(_PRIME_LOW)).bitwiseAND(F.lit(MAX_ID))

    positions = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(positions, F.lit(_OFFSET).cast("long"), step)


def lyric_id_of(filename: str) -> int:
    """:func:`lyric_id` for a query on the driver."""
    state = _OFFSET
    for b in filename.encode():
        state = ((state ^ b) * ((1 << 40) + 435)) & MAX_ID
    return state


def parse_id(text: str) -> int:
    """A request's id: decimal digits, one plus sign allowed, no blanks."""
    if not re.fullmatch(r"\+?[0-9]+", text) or int(text) > MAX_ID:
        raise InvalidId
    return int(text)


def filename_timestamp(filename: Column) -> Column:
    """The part before the first hyphen as a long, 0 if it isn't one."""
    head = F.substring_index(filename, "-", 1)
    return F.coalesce(F.when(F.regexp_like(head, F.lit(r"^[+-]?[0-9]+$")), head.try_cast("long")), F.lit(0).cast("long"))
