"""Pages and their description."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE, MAX_SIZE = 50, 100
WINDOW_FACTOR, WINDOW_CAP = 3, 500
_INT = (1 << 31) - 1
_U64 = (1 << 64) - 1


class BadPage(ValueError):
    pass


def _positive(raw: str, name: str) -> int:
    text = raw.strip()
    digits = text.removeprefix("+")
    if not (digits.isascii() and digits.isdigit()) or int(digits) > _U64:
        raise BadPage(f"'{name}' must be a positive integer.")
    if int(digits) == 0:
        raise BadPage(f"'{name}' must be at least 1.")
    return int(digits)


@dataclass(frozen=True)
class Pagination:
    page: int = 1
    size: int = DEFAULT_SIZE

    @classmethod
    def parse(cls, page: str | None = None, size: str | None = None) -> Pagination:
        """From request values, None where absent."""
        number = 1 if page is None else _positive(page, "page")
        length = DEFAULT_SIZE if size is None else _positive(size, "pageSize")
        if length > MAX_SIZE:
            raise BadPage(f"'pageSize' must not exceed {MAX_SIZE}.")
        return cls(number, length)

    @property
    def offset(self) -> int:
        return min((self.page - 1) * self.size, _U64)

    def slice(self, ordered: DataFrame) -> DataFrame:
        """The page of an ordered frame; Spark plans sort, offset and limit as one top-k."""
        if self.offset > _INT - self.size:
            return ordered.limit(0)
        return ordered.offset(self.offset).limit(self.size)

    def info(self, total: int) -> dict:
        pages = -(-total // self.size)
        return {"page": self.page, "pageSize": self.size, "total": total, "totalPages": pages, "hasMore": self.page < pages}

    def info_frame(self, hits: DataFrame) -> DataFrame:
        """:meth:`info` as one row, counted where the data is."""
        total, pages = F.count(F.lit(1)), F.ceil(F.col("total") / F.lit(self.size)).cast("long")
        return hits.agg(total.alias("total")).select(
            F.lit(self.page).cast("long").alias("page"), F.lit(self.size).cast("long").alias("page_size"), "total",
            pages.alias("total_pages"), (F.lit(self.page) < pages).alias("has_more"),
        )

    @property
    def lyric_window(self) -> int:
        """Lyric hits that a hybrid search takes for this page."""
        return min(self.page * self.size * WINDOW_FACTOR, WINDOW_CAP)
