"""Reading a corpus: JSON Lines or parquet in, canonical columns out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The layout of one corpus line and the column names that mark a
# role, in order of preference.
CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("documentId", T.StringType()),
        T.StructField("postures", T.ArrayType(T.StringType())),
        T.StructField(
            "sections",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("headtext", T.StringType()),
                        T.StructField("paragraphs", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)
LABEL_COLUMNS = ("postures", "posture", "labels", "label", "category", "procedural_posture")
TEXT_COLUMNS = ("sections", "paragraphs", "paras", "text")
ID_COLUMNS = ("documentid", "doc_id", "id")


REJECT = "_corrupt_record"
# An element that is an object among plain strings, as the reader hands it over.
OBJECT = "headtext string, paragraphs array<string>, text string"


def load_corpus(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "json"
) -> DataFrame:
    """Scan a corpus. A missing path fails here, before any job runs.

    Without ``schema`` every column of the files is found by one pass over
    them, whatever its name and shape; a schema saves that pass and reads its
    own columns only. Where no single type fits the lists and scalars of the
    label or text column, it is a VARIANT, and ``standardize`` looks at each
    row's own shape. JSON always carries ``_corrupt_record``, null for a line
    that parsed; ``without_rejects`` takes the broken lines out.
    ``load_documents`` goes to canonical columns in one pass.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "json":
        raise ValueError(f"unknown corpus format: {fmt}")
    lines = spark.read.text(path)
    if schema is None:
        found = spark.read.option("columnNameOfCorruptRecord", REJECT).json(path).schema
        schema = T.StructType([f for f in found.fields if f.name != REJECT])
        by_name = {f.name: f.dataType for f in schema.fields}
        roles = (_first_match(schema.names, c) for c in (LABEL_COLUMNS, TEXT_COLUMNS))
        # Strings are what inference falls back to where lists and scalars meet.
        mixed = [r for r in roles if r is not None and isinstance(by_name[r], T.StringType)]
        return parse_lines(lines, schema, mixed)
    return parse_lines(lines, schema)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Canonical columns and ``_corrupt_record`` from JSON lines in one pass, each line by its own shape.

    Nothing is inferred for the file: every line is a VARIANT, its columns are
    found by name as in ``detect_roles``, and labels and sections may be
    lists, scalars, null or missing from one line to the next. A line that
    is no JSON object is kept aside as a reject.
    """
    lines = spark.read.text(path).select(
        "value", F.try_parse_json(F.trim("value")).alias("line"), F.json_object_keys(F.trim("value")).alias("keys")
    )

    def role(names: tuple[str, ...]) -> Column:
        def called(name: str) -> Column:
            return F.get(F.filter("keys", lambda k: F.lower(k) == name), F.lit(0))

        return F.try_variant_get("line", F.concat(F.lit("$."), F.coalesce(*map(called, names))), "variant")

    parsed = F.col("line").isNotNull() & F.col("keys").isNotNull()
    read = lines.select(
        F.try_variant_get(role(ID_COLUMNS), "$", "string").alias("doc_id"), variant_list(role(LABEL_COLUMNS)).alias("raw"),
        variant_sections(role(TEXT_COLUMNS)).alias("sections"), F.when(~parsed, F.coalesce("value", F.lit(""))).alias(REJECT),
    )
    return _distinct_labels(read, REJECT)


def without_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): lines that parsed, and the text of those that didn't."""
    broken = F.col(REJECT).isNotNull()
    return df.where(~broken).drop(REJECT), df.where(broken).select(REJECT)


def parse_lines(lines: DataFrame, schema: T.StructType = CORPUS_SCHEMA, mixed: Sequence[str] = ()) -> DataFrame:
    """Parse a ``value`` column of JSON lines, keeping broken lines aside.

    The result has the schema's fields and ``_corrupt_record``, null for a
    line that parsed. Columns called ``mixed`` come as VARIANT, whatever shape
    they have in a line. An empty or blank line is no document and is kept
    aside too.
    """
    wide = T.StructType([*schema.fields, T.StructField(REJECT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT}
    parsed = F.from_json(F.trim("value"), wide, options)
    blank = F.when(~F.coalesce(F.col("value"), F.lit("")).rlike(r"\S"), F.coalesce(F.col("value"), F.lit("")))
    held = [parsed.alias("r"), blank.alias("blank"), *([F.try_parse_json(F.trim("value")).alias("line")] if mixed else [])]
    own = [F.try_variant_get("line", F.lit(f"$['{f}']"), "variant").alias(f) if f in mixed else F.col(f"r.{f}") for f in schema.names]
    return lines.select(*held).select(*own, F.coalesce("blank", f"r.{REJECT}").alias(REJECT))


def variant_list(value: Column) -> Column:
    """Strings of a VARIANT: a list's elements, a scalar alone, nothing for null; null elements go."""
    many, one = F.try_variant_get(value, "$", "array<string>"), F.try_variant_get(value, "$", "string")
    empty = F.array().cast("array<string>")
    return F.array_compact(F.when(many.isNotNull(), many).when(one.isNotNull(), F.array(one)).otherwise(empty))


def _plain_section(s: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("headtext"), F.array(s).alias("paragraphs"), F.lit(None).cast("string").alias("text"))


def variant_sections(value: Column) -> Column:
    """Sections of a VARIANT in one shape; null stays null.

    An object gives its own parts; any other element, and a scalar instead of
    a list, is a section of one paragraph.
    """

    def section(v: Column) -> Column:
        head, text = (F.try_variant_get(v, f"$.{n}", "string") for n in ("headtext", "text"))
        paragraphs = F.try_variant_get(v, "$.paragraphs", "variant")
        own = F.struct(head.alias("headtext"), F.when(paragraphs.isNotNull(), variant_list(paragraphs)).alias("paragraphs"), text.alias("text"))
        known = F.coalesce(head, text, F.when(paragraphs.isNotNull(), F.lit(""))).isNotNull()
        return F.when(F.schema_of_variant(v).startswith("OBJECT") & known, own).otherwise(_plain_section(F.try_variant_get(v, "$", "string")))

    many, one = F.try_variant_get(value, "$", "array<variant>"), F.try_variant_get(value, "$", "string")
    filled = F.filter(many, lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")) != "VOID")
    return F.when(many.isNotNull(), F.transform(filled, section)).when(one.isNotNull(), F.array(_plain_section(one)))


def resolved_sections(df: DataFrame, col: str) -> Column:
    """``col`` with objects among plain strings told apart.

    Where a corpus mixes plain strings and objects in one list, the reader
    hands the objects over as JSON text. A plain string counts as one
    paragraph. Other shapes stay as they are.
    """
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.VariantType):
        return variant_sections(F.col(col))
    if not isinstance(dtype, T.ArrayType) or not isinstance(dtype.elementType, T.StringType):
        return F.col(col)

    def section(s: Column) -> Column:
        parsed = F.from_json(s, OBJECT)
        known = F.coalesce(parsed["headtext"], parsed["text"], parsed["paragraphs"].cast("string")).isNotNull()
        return F.when(s.startswith("{") & F.coalesce(known, F.lit(False)), parsed).otherwise(_plain_section(s))

    return F.transform(F.array_compact(F.col(col)), section)


def cached(df: DataFrame) -> DataFrame:
    """Keep a frame for reuse; lost blocks are recomputed from the source."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def peek(df: DataFrame, n: int = 5, by: str = "doc_id") -> DataFrame:
    return df.orderBy(by).limit(n)


def get_schema(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def get_column_names(df: DataFrame) -> list[str]:
    return df.columns


def _first_match(columns: Sequence[str], candidates: tuple[str, ...]) -> str | None:
    by_lower: dict[str, str] = {}
    for name in columns:
        by_lower.setdefault(name.lower(), name)
    return next((by_lower[c] for c in candidates if c in by_lower), None)


def detect_roles(df: DataFrame) -> dict[str, str | None]:
    """Which column holds labels, text and the id, by name and preference."""
    return {
        "labels": _first_match(df.columns, LABEL_COLUMNS),
        "text": _first_match(df.columns, TEXT_COLUMNS),
        "id": _first_match(df.columns, ID_COLUMNS),
    }


def label_list(df: DataFrame, col: str) -> Column:
    """Labels as an array: null becomes empty, a scalar becomes one label."""
    empty = F.array().cast("array<string>")
    if isinstance(df.schema[col].dataType, T.VariantType):
        return variant_list(F.col(col))
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.coalesce(F.array_compact(F.col(col).cast("array<string>")), empty)
    return F.when(F.col(col).isNull(), empty).otherwise(F.array(F.col(col).cast("string")))


def standardize(df: DataFrame) -> DataFrame:
    """Canonical columns doc_id, labels, sections and n_repeated_labels.

    A label repeated inside one document is kept once; how many repeats went
    is reported per document.
    """
    roles = detect_roles(df)
    if roles["id"] is None:
        raise ValueError(f"no id column among {df.columns}")
    labels = (
        label_list(df, roles["labels"]) if roles["labels"] else F.array().cast("array<string>")
    )
    sections = resolved_sections(df, roles["text"]) if roles["text"] else F.lit(None).cast("string")
    return _distinct_labels(df.select(F.col(roles["id"]).alias("doc_id"), labels.alias("raw"), sections.alias("sections")))


def _distinct_labels(read: DataFrame, *others: str) -> DataFrame:
    distinct = F.array_distinct("raw")
    repeated = (F.size("raw") - F.size(distinct)).cast("bigint").alias("n_repeated_labels")
    return read.select("doc_id", distinct.alias("labels"), "sections", repeated, *others)
