"""JSON documents to typed rows, with what is wrong with each: one projection, no Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.functions import text
from loamdex.schema import Field, Schema

_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"


def date_column(value: Column) -> Column:
    """Epoch milliseconds of a date or RFC 3339 time, else null."""
    day = F.unix_date(F.try_to_date(value, "yyyy-M-d")).cast("long") * 86_400_000
    time = F.unix_millis(F.try_to_timestamp(F.upper(F.regexp_replace(value, r"^(\d{4}-\d{2}-\d{2}).", r"$1T"))))
    return F.when(value.rlike(_DATE), day).when(value.rlike(_TIME), time)


def number_column(value: Column) -> Column:
    return F.when(F.lower(F.trim(value)).rlike(_NUMBER), value.try_cast("double"))


def number_text(value: Column) -> Column:
    """A JSON number as a keyword: whole doubles without a fraction."""
    as_double = value.try_cast("double")
    whole = (as_double == F.floor(as_double)) & (F.abs(as_double) < 1e15)
    return F.when(whole, as_double.cast("long").cast("string")).otherwise(as_double.cast("string"))


def _kind(v: Column) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL.., BOOLEAN, ARRAY.., OBJECT.. or VOID of a variant."""
    return F.schema_of_variant(v)


def _parts(v: Column) -> Column:
    """The elements of an array, or the value by itself."""
    return F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))


def _numeric(kind: Column) -> Column:
    return kind.startswith("BIGINT") | kind.startswith("DOUBLE") | kind.startswith("DECIMAL") | kind.startswith("FLOAT")


def field_column(name: str, field: Field, doc: Column) -> tuple[Column, Column]:
    """(value, error) of one field; a null error means that the value stands. An absent key gives nulls."""
    v = F.try_variant_get(doc, f"$['{name}']", "variant")
    absent = v.isNull()
    kind = _kind(v)
    string = F.try_variant_get(v, "$", "string")
    is_string, is_array = kind == "STRING", kind.startswith("ARRAY")
    mismatch = F.lit(f"{name}: expected {field.kind}")
    if field.kind == "text":
        return F.when(is_string, string), F.when(~absent & ~is_string, mismatch)
    if field.kind == "bool":
        flag = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(is_string & string.isin("true", "false"), string == "true")
        return flag, F.when(~absent & flag.isNull(), mismatch)
    parts = _parts(v)
    kinds = F.transform(parts, _kind)
    texts = F.transform(parts, lambda p: F.try_variant_get(p, "$", "string"))
    if field.kind == "keyword":
        values = F.when(is_array, texts).when(is_string, F.array(string)).when(kind == "BOOLEAN", F.array(string)).when(_numeric(kind), F.array(number_text(string)))
        # inside an array only strings count
        bad = (is_array & F.exists(kinds, lambda k: k != "STRING")) | ~(is_array | is_string | (kind == "BOOLEAN") | _numeric(kind))
    else:
        convert = number_column if field.kind == "number" else date_column
        values = F.transform(texts, convert)
        allowed = (lambda k: (k == "STRING") | _numeric(k)) if field.kind == "number" else (lambda k: k == "STRING")
        bad = F.exists(kinds, lambda k: ~allowed(k)) | F.exists(values, lambda x: x.isNull())
    distinct = F.array_distinct(values)
    # an empty array is kept in the document but is no presence
    held = F.when(~absent & (F.size(distinct) > 0), distinct)
    error = F.when(~absent & F.coalesce(bad, F.lit(True)), mismatch)
    if not field.multi:
        error = F.coalesce(error, F.when(~absent & is_array & (F.size(texts) > 1), F.lit(f"{name}: holds one value")))
        return F.get(held, F.lit(0)), error
    return held, error


def typed(raw: DataFrame, schema: Schema) -> DataFrame:
    """raw (data_json and any other columns but those made here) with path, the schema's columns and errors array<string>.

    Keys that the schema does not know stay in data_json only. A document that is no JSON object or has no path has an error.
    """
    doc = F.try_parse_json("data_json")
    rows = raw.withColumn("_doc", F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc))
    path = F.try_variant_get(F.col("_doc"), "$.path", "variant")
    path_ok = (_kind(path) == "STRING") & (F.length(F.try_variant_get(path, "$", "string")) > 0)
    columns, errors = {"path": F.when(path_ok, F.try_variant_get(path, "$", "string"))}, [F.when(F.col("_doc").isNull(), F.lit("not a JSON object")).when(~F.coalesce(path_ok, F.lit(False)), F.lit("path: a non-empty string is required"))]
    for name, field in schema.fields.items():
        value, error = field_column(name, field, F.col("_doc"))
        columns[schema.column(name)] = value.cast(field.spark_type)
        errors.append(error)
    columns["errors"] = F.array_compact(F.array(*errors))
    rows = rows.withColumns(columns)
    rows = rows.withColumns({schema.tokens(n): text.tokens(F.col(schema.column(n))) for n, _ in schema.text_fields})
    return rows.withColumn("length", text.length(schema)).drop("_doc")
