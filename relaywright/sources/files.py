"""CSV and JSON with declared schemas: rows that break the rules are told apart, the rest goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with `errors`: the names of the rules they break, 'malformed' for lines that don't parse."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    broken = [F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed"))] + [F.when(F.col("_corrupt_record").isNull() & ~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    checked = rows.withColumn("errors", F.array_compact(F.array(*broken)))
    return checked.filter(F.size("errors") == 0).drop("errors", "_corrupt_record"), checked.filter(F.size("errors") > 0)


def checked_lines(lines: DataFrame, text: str, schema: str, rules: dict[str, Column]) -> DataFrame:
    """`lines` with `row`, what `text` says as CSV, and `errors`, the names of the rules that it breaks; a line that doesn't parse is 'malformed'. Rules are on `row`."""
    parsed = lines.withColumn("row", F.from_csv(F.col(text), F.lit(f"{schema}, _corrupt_record string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return parsed.withColumn("errors", F.when(F.col("row._corrupt_record").isNotNull(), F.array(F.lit("malformed"))).otherwise(broken))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def conforms(document: Column, schema: str, required: list[str]) -> Column:
    """Whether a JSON text parses to the schema's types and has the required fields."""
    parsed = F.from_json(document, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    ok = parsed.isNotNull() & parsed["_corrupt_record"].isNull()
    for field in required:
        ok = ok & parsed[field].isNotNull()
    return ok
