"""Integer expressions about fixed-stride records on pages."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 4096


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b).cast("long")


def align_up(x: Column, to: int) -> Column:
    return _div(x + (to - 1), to) * to


def page_span(id_col: Column, stride: int, length: int, page: int = PAGE, start: int = 0) -> tuple[Column, Column]:
    """(first page, last page) of a record, as page numbers."""
    offset = id_col * stride + start
    return _div(offset, page), _div(offset + (length - 1), page)


def spans_meet(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return ~((a[1] < b[0]) | (b[1] < a[0]))


def page_charge(length: Column, page: int = PAGE) -> Column:
    """Bytes charged for a record: whole pages, and two where it is over half a page."""
    length = F.when(length == 0, F.lit(page)).otherwise(length)
    pages = F.when((length <= page) & (length > page // 2), F.lit(2)).otherwise(_div(length + (page - 1), page))
    return F.greatest(pages, F.lit(1)) * page


def bin_capacity(packed: int, page: int = PAGE) -> int:
    return max(2, math.ceil(2 * page / packed))


def stride_of(section_bytes: Column, n: Column, packed: Column) -> Column:
    """Bytes from record to record: the section's share if that holds a packed record."""
    share = F.call_function("div", section_bytes, n)
    return F.when(share >= packed, share).otherwise(packed).cast("long")


def stripe_place(logical: Column, stripe: int, ram: int, full: int, size: int) -> dict[str, Column]:
    """tier (0 fast, 1 slow), tier_offset and contiguous bytes of a logical offset below ``size``.

    Of ``full`` stripes ``ram`` lie in the fast tier, spread evenly; the rest of the range is slow.
    """
    number, within = _div(logical, stripe), logical % stripe
    before, after = _div(number * ram, full), _div((number + 1) * ram, full)
    fast, tail = after != before, logical >= full * stripe
    return {
        "tier": F.when(tail, 1).when(fast, 0).otherwise(1),
        "tier_offset": F.when(tail, F.lit((full - ram) * stripe) + (logical - full * stripe)).when(fast, before * stripe + within).otherwise((number - before) * stripe + within),
        "contiguous": F.when(tail, F.lit(size) - logical).otherwise(F.lit(stripe) - within),
    }


def score_weight(dist: Column, place: Column, boosted: int) -> Column:
    """1 / (1 + distance), plus 1000 - place for the next ``boosted`` candidates (place counts from 0)."""
    base = F.lit(1.0) / (F.lit(1.0) + F.greatest(dist, F.lit(0.0)))
    return base + F.when(place < boosted, F.lit(1000.0) - place).otherwise(F.lit(0.0))


def pin_rounds(utility: Column) -> Column:
    """How many rounds a page of that utility stays pinned."""
    return F.when(utility >= 500, 64).when(utility >= 1, 32).otherwise(16)
