"""Line and markup operators on a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.text import line_array, strip
from .rows import numbered_rows


def split_lines(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, line_no, line)``, numbered from 0."""
    return numbered_rows(df, [id], line_array(F.col(text)), "line_no", "line")


def classify_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``blank``, ``label`` and ``table_row``; a blank line counts as a label."""
    body = strip(F.col(line))
    return lines.withColumns(
        {
            "blank": body == "",
            "label": (body == "") | L.is_label(body),
            "table_row": L.is_table_row(body),
        }
    )


def _mapped(fn):
    def operator(df: DataFrame, text: str = "text") -> DataFrame:
        return df.withColumn(text, fn(F.col(text)))

    operator.__doc__ = fn.__doc__
    return operator


join_wrapped_lines = _mapped(L.join_wrapped_lines)
field_group_breaks = _mapped(L.field_group_breaks)
clean_markup = _mapped(L.clean_markup)
break_before_labels = _mapped(L.break_before_labels)
break_value_label = _mapped(L.break_value_label)
normalize_document = _mapped(L.normalize_text)
