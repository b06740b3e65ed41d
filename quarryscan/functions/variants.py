"""Properties of JSON texts without a schema: each field is read by itself, and a text that can't be read is kept with a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNREADABLE, NO_OBJECT = "could not be read", "not an object"


def kind(value: Column) -> Column:
    """number, text, truth, nothing, list, object or other, of a variant."""
    schema = F.schema_of_variant(value)
    is_one = lambda *names: F.substring_index(F.substring_index(schema, "(", 1), "<", 1).isin(*names)
    return (
        F.when(is_one("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "number").when(is_one("STRING"), "text").when(is_one("BOOLEAN"), "truth")
        .when(is_one("VOID"), "nothing").when(is_one("ARRAY"), "list").when(is_one("OBJECT"), "object").otherwise("other")
    )


def properties(rows: DataFrame, text: Column) -> DataFrame:
    """The columns of rows with name, value (a variant), kind and note: a row for each property of each text.

    A text that is no JSON, or no object, gives one row with a note instead; a null text and an object without properties give none. Names appear once in
    an object; texts with a repeated name can't be read.
    """
    parsed = rows.select(F.struct("*").alias("_row"), text.alias("_text"), F.try_parse_json(text).alias("_v")).where("_text IS NOT NULL")
    entries = F.try_variant_get("_v", "$", "map<string,variant>")
    note = F.when(F.col("_v").isNull(), F.lit(UNREADABLE)).when(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(None).cast("string")).otherwise(F.lit(NO_OBJECT))
    noted = parsed.withColumns({"note": note, "_m": entries})
    each = noted.where("note IS NULL").select("_row", F.explode("_m").alias("name", "value"), "note")
    bad = noted.where("note IS NOT NULL").select("_row", F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("value"), "note")
    both = each.unionByName(bad).withColumn("kind", F.when(F.col("name").isNotNull(), kind(F.col("value"))))
    return both.select(*[F.col("_row")[c].alias(c) for c in rows.columns], "name", "value", "kind", "note")
