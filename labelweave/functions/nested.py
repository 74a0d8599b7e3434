"""Expressions over the nested ``sections`` column.

The shape of a section is read once from the schema, so each expression is a
single plan and no row is inspected for its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.functions.text import word_count

_NO_TEXT = "array<string>"


def _shape(df: DataFrame, col: str) -> tuple[str, bool, bool]:
    """(kind, has paragraphs, has text); kind is struct, string or scalar."""
    dtype = df.schema[col].dataType
    if not isinstance(dtype, T.ArrayType):
        return "scalar", False, False
    element = dtype.elementType
    if isinstance(element, T.StructType):
        names = set(element.names)
        return "struct", "paragraphs" in names, "text" in names
    return "string", False, False


def pieces(df: DataFrame, col: str = "sections", fallback_text: bool = True) -> Column:
    """All text pieces of a document in order.

    Paragraphs win over ``text``; ``text`` is used only where a section has no
    paragraphs and ``fallback_text`` is set. Null pieces are skipped.
    """
    kind, has_paragraphs, has_text = _shape(df, col)
    value = F.col(col)
    empty = F.array().cast(_NO_TEXT)
    if kind == "scalar":
        return F.when(value.isNull(), empty).otherwise(F.array(value.cast("string")))
    if kind == "string":
        return F.array_compact(F.coalesce(value.cast(_NO_TEXT), empty))

    def of_section(section: Column) -> Column:
        alternatives = []
        if has_paragraphs:
            alternatives.append(section["paragraphs"].cast(_NO_TEXT))
        if has_text and fallback_text:
            text = section["text"].cast("string")
            alternatives.append(F.when(text.isNotNull(), F.array(text)))
        return F.coalesce(*alternatives, empty)

    return F.array_compact(F.flatten(F.transform(F.coalesce(value, F.array()), of_section)))


def extract_text(df: DataFrame, col: str = "sections", fallback_text: bool = True) -> Column:
    """The document as one string, pieces joined by a single space."""
    return F.array_join(pieces(df, col, fallback_text), " ")


def document_words(df: DataFrame, col: str = "sections") -> Column:
    """Words in the paragraphs; a section that has only ``text`` adds none."""
    return word_count(extract_text(df, col, fallback_text=False))


def section_count(df: DataFrame, col: str = "sections", scalar_value: int = 0) -> Column:
    """Number of sections; ``scalar_value`` where the column is no list."""
    kind, _, _ = _shape(df, col)
    if kind == "scalar":
        return F.lit(scalar_value).cast("bigint")
    return F.coalesce(F.size(F.col(col)), F.lit(scalar_value)).cast("bigint")


def paragraph_count(df: DataFrame, col: str = "sections") -> Column:
    """Paragraphs in all sections, or the section count where there are none; 1 without sections."""
    kind, has_paragraphs, _ = _shape(df, col)
    if kind == "scalar":
        return F.lit(1).cast("bigint")
    sections = F.col(col)
    if kind == "string" or not has_paragraphs:
        return F.when(sections.isNull(), F.lit(1)).otherwise(F.size(sections)).cast("bigint")
    lists = F.transform(sections, lambda s: F.coalesce(s["paragraphs"].cast(_NO_TEXT), F.array().cast(_NO_TEXT)))
    total = F.size(F.flatten(lists))
    return F.when(sections.isNull(), F.lit(1)).when(total > 0, total).otherwise(F.size(sections)).cast("bigint")


def all_sections_empty(df: DataFrame, col: str = "sections") -> Column:
    """True for a list whose every section lacks paragraphs."""
    kind, has_paragraphs, _ = _shape(df, col)
    if kind == "scalar":
        return F.lit(False)
    if kind == "string":
        return F.size(F.col(col)) == 0
    if not has_paragraphs:
        return F.col(col).isNotNull()
    bare = lambda s: F.coalesce(F.size(s["paragraphs"]), F.lit(0)) <= 0
    return F.coalesce(F.forall(F.col(col), bare), F.lit(False))
