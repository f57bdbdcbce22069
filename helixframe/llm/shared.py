"""The shared folder and its tables, under the names that the operators use."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import _WRITTEN, rows_of, scratch_path, scratch_root, tables, written

__all__ = ["_WRITTEN", "row_key", "rows_of", "scratch_path", "scratch_root", "tables", "text_key", "written"]


def text_key(text_col: str = "text") -> Column:
    """A 128-bit hash of the text, by which rows are told apart; zero for a null."""
    return F.coalesce(F.unhex(F.md5(text_col)), F.lit(bytes(16)))


def row_key(docs: DataFrame, text_col: str = "text") -> Column:
    """A key of a row's own, never null, that only rows equal in all columns share."""
    rest = [c for c in docs.columns if c != text_col]
    return F.unhex(F.md5(F.concat(text_key(text_col), F.to_json(F.struct(*rest)).cast("binary"))))
