"""Journals: step tables and single cells of any number of books, each read by the task that holds it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from benchloom.operators import grids
from benchloom.sources import files


def steps_of_books(books: DataFrame, mapping: grids.Mapping, sheet: str | None = None) -> DataFrame:
    """path and the derived steps (``grids.step_rows``) of a sheet of each book in ``books`` (path, content).

    The header row is found in each book by itself, by text, without units or by clean names. A book that has no such row, is
    damaged or lacks the sheet gives one row: status ``problem``, the reason, and nothing else. Step ids are unique in a book.
    """

    def derive(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["row", "status", "reason", "step_id", "label", "start", "end", "params", "cells"]
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows = grids.step_rows(files.read_grid(bytes(content), sheet), mapping)
                except Exception as e:  # any damage of one book is that book's problem
                    rows = [(None, "problem", str(e.args[0]) if e.args else type(e).__name__, None, None, None, None, None, None)]
                out = pd.DataFrame(rows, columns=names, dtype=object)
                out.insert(0, "path", path)
                yield out

    return books.select("path", "content").mapInPandas(derive, f"path string, {grids.STEPS}")


def located(books: DataFrame, places: dict[str, dict], sheet: str | None = None) -> DataFrame:
    """path, name, value, problem: cells of each book by the arguments of ``files.locate`` under their names; null and why where there is none."""

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                grid, damage = None, None
                try:
                    grid = files.read_grid(bytes(content), sheet)
                except Exception as e:  # as above
                    damage = str(e.args[0]) if e.args else type(e).__name__
                rows = []
                for name, place in places.items():
                    try:
                        rows.append((path, name, files.locate(grid, **place), None) if grid is not None else (path, name, None, damage))
                    except LookupError as e:
                        rows.append((path, name, None, e.args[0]))
                yield pd.DataFrame(rows, columns=["path", "name", "value", "problem"], dtype=object)

    return books.select("path", "content").mapInPandas(find, "path string, name string, value string, problem string")
