"""Readers and writers for inputs and outputs.

Readers accept either a path (parquet, csv with header, json) or an existing
DataFrame, and return DataFrames with canonical column names.  Header
matching is done on the driver over ``df.columns`` only (schema metadata,
never data); all row work is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header synonyms of a mapping table (lower-cased header ->
# canonical column), as the reference's viewer accepts them.
MAPPING_HEADER_SYNONYMS = {
    "source table": "source_table",
    "source_table": "source_table",
    "sourcetable": "source_table",
    "source field": "source_field",
    "source_field": "source_field",
    "sourcefield": "source_field",
    "dest table": "dest_table",
    "dest_table": "dest_table",
    "desttable": "dest_table",
    "destination table": "dest_table",
    "destination_table": "dest_table",
    "target table": "dest_table",
    "target_table": "dest_table",
    "dest field": "dest_field",
    "dest_field": "dest_field",
    "destfield": "dest_field",
    "destination field": "dest_field",
    "destination_field": "dest_field",
    "target field": "dest_field",
    "target_field": "dest_field",
    "rules": "rules",
    "rule": "rules",
    "transformation": "rules",
    "derived_expression": "rules",
    "derived expression": "rules",
    "derivedexpression": "rules",
    "mapping type": "mapping_type",
    "mapping_type": "mapping_type",
    "mappingtype": "mapping_type",
    "type": "mapping_type",
    "usage_type": "mapping_type",
    "usage type": "mapping_type",
    "usagetype": "mapping_type",
    "object name": "object_name",
    "object_name": "object_name",
    "objectname": "object_name",
    "object": "object_name",
    "etl object": "object_name",
    "etl_object": "object_name",
    "usage_role": "usage_role",
    "usage role": "usage_role",
    "source_type": "source_type",
    "source type": "source_type",
    "constant_value": "constant_value",
    "constant value": "constant_value",
    "derived_output": "derived_output",
    "derived output": "derived_output",
    "join_alias": "join_alias",
    "join alias": "join_alias",
    "join_keys": "join_keys",
    "join keys": "join_keys",
    "join_filters": "join_filters",
    "join filters": "join_filters",
    "dm_match": "dm_match",
    "dm match": "dm_match",
    "trace_path": "trace_path",
    "trace path": "trace_path",
    "notes": "notes",
}

# Column catalog headers.
CATALOG_HEADERS = {
    "Table Name": "table_name",
    "Column Name": "column_name",
    "Data Type": "data_type",
    "Is PK": "is_pk",
    "Is FK": "is_fk",
    "Description": "description",
}

# Texts that a sheet reader writes for a false or missing cell.
FALSE_WORDS = ["false", "no", "n", "f", "0", "0.0", "nan", "none", "null"]

MAPPING_KEYS = ["source_table", "source_field", "dest_table", "dest_field"]


def _load(spark: SparkSession, src, fmt: str | None = None) -> DataFrame:
    if isinstance(src, DataFrame):
        return src
    path = str(src)
    fmt = fmt or ("csv" if path.endswith(".csv") else "json" if path.endswith(".json") else "parquet")
    reader = spark.read
    if fmt == "csv":
        # rules may hold line breaks and doubled quotes
        reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"')
    return reader.format(fmt).load(path)


def strip_headers(df: DataFrame) -> DataFrame:
    """Trim outer blanks of every header."""
    return df.toDF(*[c.strip() for c in df.columns])


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> None:
    """Fail with the list of missing columns (headers compared trimmed)."""
    have = {c.strip() for c in df.columns}
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")


def resolve_column_name(df: DataFrame, name: str) -> str | None:
    """The actual header matching ``name`` ignoring case and outer blanks."""
    want = name.strip().lower()
    for c in df.columns:
        if c.strip().lower() == want:
            return c
    return None


def canonical_mappings(df: DataFrame, order_col: str | None = "row_ord") -> DataFrame:
    """S1 on a DataFrame: synonym headers -> canonical names, defaults, upper keys.

    Missing ``object_name`` / ``rules`` default to '', a missing
    ``mapping_type`` to 'MAP'; NULL text becomes '' (the reference's text
    'nan' quirk is not kept) and the four key columns are upper-cased.
    A row order column is kept when present (later rows win duplicates), and
    otherwise one is made from the scan order.
    """
    df = strip_headers(df)
    renames = {}
    taken = set()
    for c in df.columns:
        target = MAPPING_HEADER_SYNONYMS.get(c.lower())
        if target and target not in taken:
            renames[c] = target
            taken.add(target)
    out = df.withColumnsRenamed(renames) if renames else df
    require_columns(out, MAPPING_KEYS, "mapping table")
    cols = set(out.columns)
    extra = {}
    if "object_name" not in cols:
        extra["object_name"] = F.lit("")
    if "rules" not in cols:
        extra["rules"] = F.lit("")
    if "mapping_type" not in cols:
        extra["mapping_type"] = F.lit("MAP")
    if order_col and order_col not in cols:
        extra[order_col] = F.monotonically_increasing_id()
    if extra:
        out = out.withColumns(extra)
    fixes = {k: F.upper(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in MAPPING_KEYS}
    for k in ("rules", "mapping_type", "object_name"):
        fixes[k] = F.coalesce(F.col(k).cast("string"), F.lit(""))
    return out.withColumns(fixes)


def read_mappings(spark: SparkSession, src, fmt: str | None = None) -> DataFrame:
    """Read a mapping table from a path or DataFrame."""
    return canonical_mappings(_load(spark, src, fmt))


def _flag(c: Column, kind: str) -> Column:
    """A sheet's yes/no cell: booleans and numbers by value; of texts, blank
    ones and the words in ``FALSE_WORDS`` are false and all others true."""
    if kind == "string":
        text = F.lower(F.trim(c))
        return F.coalesce((text != "") & ~text.isin(*FALSE_WORDS), F.lit(False))
    return F.coalesce(c.try_cast("boolean"), F.lit(False))


def read_column_catalog(spark: SparkSession, src, fmt: str | None = None) -> DataFrame:
    """Column catalog with canonical names and boolean PK/FK flags."""
    df = strip_headers(_load(spark, src, fmt))
    renames = {c: CATALOG_HEADERS[c] for c in df.columns if c in CATALOG_HEADERS}
    df = df.withColumnsRenamed(renames) if renames else df
    fixes = {}
    for flag in ("is_pk", "is_fk"):
        if flag in df.columns:
            fixes[flag] = _flag(F.col(flag), dict(df.dtypes)[flag])
    return df.withColumns(fixes) if fixes else df


def read_data_model(spark: SparkSession, src, fmt: str | None = None,
                    table_header: str = "Table Physical Name",
                    column_header: str = "Column Physical Name") -> DataFrame:
    """S3: distinct normalized (table_name, column_name) pairs with an ordinal.

    Identifiers are normalized (blanks collapsed, one pair of double quotes
    removed, upper case); rows with a blank table or column are dropped.
    ``ordinal`` numbers columns within a table by first appearance so star
    expansion has a stable column order.
    """
    from columbine.functions.text import normalize_identifier
    from columbine.operators.closure import ordered_index

    df = strip_headers(_load(spark, src, fmt))
    t = resolve_column_name(df, table_header) or "table_name"
    c = resolve_column_name(df, column_header) or "column_name"
    require_columns(df, [t, c], "data model")
    if "ordinal" in df.columns:
        pos = F.col("ordinal").cast("long")
    else:
        pos = F.monotonically_increasing_id()
    pairs = df.select(
        normalize_identifier(F.col(t)).alias("table_name"),
        normalize_identifier(F.col(c)).alias("column_name"),
        pos.alias("_pos"),
    ).where((F.col("table_name") != "") & (F.col("column_name") != ""))
    # first appearance per pair: partial aggregation, skew-safe
    firsts = pairs.groupBy("table_name", "column_name").agg(F.min("_pos").alias("_pos"))
    numbered = ordered_index(firsts, ["table_name"], ["_pos", "column_name"], index_col="ordinal", size_col=None)
    return numbered.withColumn("ordinal", F.col("ordinal") + 1).drop("_pos")


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


# Required columns of a v1 mapping spec sheet.
SPEC_REQUIRED = ["Type", "Name", "Target Table", "Target Column"]
SPEC_OPTIONAL = ["Source Table", "Source Column", "Expression"]


def read_mapping_spec(spark: SparkSession, src, fmt: str | None = None) -> DataFrame:
    """v1 spec sheet: required headers checked (case-insensitive, trimmed),
    ``Type``/``Name`` upper-cased and trimmed, target and source identifiers
    normalized, expressions normalized outside literals; missing optional
    columns are ''."""
    from columbine.functions.text import clean_text, normalize_expression, normalize_identifier

    df = strip_headers(_load(spark, src, fmt))
    found = {n: resolve_column_name(df, n) for n in SPEC_REQUIRED + SPEC_OPTIONAL}
    missing = [n for n in SPEC_REQUIRED if found[n] is None]
    if missing:
        raise ValueError(f"mapping spec is missing required columns: {', '.join(missing)}")
    col = lambda n: F.col(found[n]) if found[n] else F.lit("")
    return df.select(
        F.upper(clean_text(col("Type"))).alias("type"), F.upper(clean_text(col("Name"))).alias("name"),
        normalize_identifier(col("Target Table")).alias("target_table"),
        normalize_identifier(col("Target Column")).alias("target_column"),
        normalize_identifier(col("Source Table")).alias("source_table"),
        normalize_identifier(col("Source Column")).alias("source_column"),
        normalize_expression(col("Expression")).alias("expression"))
