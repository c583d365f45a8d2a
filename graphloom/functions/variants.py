"""Column functions over VARIANT values that follow the coercions of the documents' own language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind_of(value: Column) -> Column:
    """absent, null, array, object or scalar."""
    schema = F.schema_of_variant(value)
    return F.when(value.isNull(), "absent").when(schema == "VOID", "null").when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").otherwise("scalar")


def member(value: Column, *names: str) -> Column:
    """The first member of these names that is neither absent nor null; absent if the value is no object."""
    found = [F.variant_get(value, f"$['{name}']", "variant") for name in names]
    return F.coalesce(*(F.when(~F.is_variant_null(x), x) for x in found))


def raw_member(value: Column, name: str) -> Column:
    """A member as it is: a null stays apart from an absent one."""
    return F.variant_get(value, f"$['{name}']", "variant")


def text_of(value: Column) -> Column:
    """The value as text: an object has a fixed one, an array's members are joined by commas, nulls in it are empty."""
    kind, schema = kind_of(value), F.schema_of_variant(value)
    members = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(F.when(kind_of(x) == "object", F.lit("[object Object]")).when(F.is_variant_null(x), F.lit("")).otherwise(F.try_variant_get(x, "$", "string")), F.lit("")))
    number = F.regexp_replace(F.try_variant_get(value, "$", "string"), r"\.0+$", "")
    return F.when(kind == "object", "[object Object]").when(kind == "array", F.array_join(members, ",")).when(schema.isin("DOUBLE", "FLOAT") | schema.startswith("DECIMAL"), number).otherwise(F.try_variant_get(value, "$", "string"))


def is_true(value: Column) -> Column:
    """Whether the value is the boolean true, and nothing that only looks like it."""
    return F.coalesce((F.schema_of_variant(value) == "BOOLEAN") & F.try_variant_get(value, "$", "boolean"), F.lit(False))


def script_type(value: Column) -> Column:
    """null, array, object, string, number or boolean."""
    kind, schema = kind_of(value), F.schema_of_variant(value)
    return F.when(kind != "scalar", kind).when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").otherwise("number")
