"""Sections of an answer and the rows of its Evidence table, parsed by array functions within the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SECTIONS, let

_LABELS = "|".join(SECTIONS)


def section(c: Column, name: str) -> Column:
    """What follows the first `name:` up to the next label at the start of a line; "" without the label."""
    rest = F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?is)\b{name}\s*:(.*)\z", 1)
    return F.regexp_extract(rest, rf"(?ims)\A(.*?)(?=^\s*(?:{_LABELS})\s*:|\z)", 1)


def cells(line: Column) -> Column:
    """Cells of a table line without its outer bars."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))


def is_separator(row: Column) -> Column:
    filled = F.filter(row, lambda x: x != "")
    return (F.size(filled) > 0) & F.forall(filled, lambda x: x.rlike(r"^:?-{2,}:?$"))


def clean_company(cell: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(cell, r"\*+|`+", ""), r"^[ .,:;|]+|[ .,:;|]+$", "")


def _first(array: Column, test) -> Column:
    """Position of the first element that passes, or null."""
    at = F.filter(F.transform(array, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
    return F.get(at, F.lit(0))


def evidence_rows(c: Column, digits: int = 4) -> Column:
    """Array of (row_id, company) of the Evidence table; a row id is read from up to `digits` digits.

    The first line with a cell that names a company or row-id column is the header; if a line whose first cell has a
    digit comes before, the columns are taken by position. Rows without a company are left out."""
    row_id_names, company_names = ("row id", "rowid", "id"), ("supplier", "name")

    def parsed(rows: Column) -> Column:
        plain = lambda row: F.transform(row, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9 ]+", " ")))
        header = lambda row: F.exists(plain(row), lambda h: h.contains("company") | h.isin(*row_id_names))
        start = _first(rows, lambda row: header(row) | F.get(row, F.lit(0)).rlike(r"\d"))

        def from_start(at: Column) -> Column:
            head = F.get(rows, at)
            named = header(head)
            names = plain(head)
            id_at = F.when(named, F.coalesce(_first(names, lambda h: h.isin(*row_id_names) | h.contains("row id")), F.lit(0))).otherwise(F.lit(0))
            other = F.when(F.size(names) > 1, F.lit(1)).otherwise(F.lit(0))
            company_at = F.when(named, F.coalesce(_first(names, lambda h: h.contains("company") | h.isin(*company_names)), other)).otherwise(F.lit(1))
            body = F.filter(rows, lambda _, i: i >= at + F.when(named, F.lit(1)).otherwise(F.lit(0)))

            def picked(spot: Column) -> Column:
                return F.transform(
                    body,
                    lambda row: F.struct(
                        F.nullif(F.regexp_extract(F.coalesce(F.get(row, spot["id_at"]), F.lit("")), rf"\d{{1,{digits}}}", 0), F.lit("")).try_cast("int").alias("row_id"),
                        clean_company(F.coalesce(F.get(row, spot["company_at"]), F.lit(""))).alias("company"),
                    ),
                )

            return let(F.struct(id_at.alias("id_at"), company_at.alias("company_at")), picked)

        found = F.filter(let(start, from_start), lambda r: r["company"] != "")
        return F.coalesce(found, F.array().cast("array<struct<row_id:int,company:string>>"))

    lines = F.filter(F.split(section(c, "Evidence"), r"\R"), lambda x: x.contains("|"))
    return let(F.filter(F.transform(lines, cells), lambda row: ~is_separator(row)), parsed)
