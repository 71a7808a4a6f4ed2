"""The three retail tables: schemas, readers and the CSV form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _schema(fields: tuple[tuple[str, T.DataType], ...]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_STRING, _LONG, _DOUBLE, _DATE = T.StringType(), T.LongType(), T.DoubleType(), T.DateType()

# The columns of the public retail data set, in file order. Identifiers
# are text, since inferring their type would drop leading zeros.
TRANSACTIONS = _schema(
    (
        ("t_dat", _DATE),
        ("customer_id", _STRING),
        ("article_id", _STRING),
        ("price", _DOUBLE),
        ("sales_channel_id", _LONG),
    )
)
CUSTOMERS = _schema(
    (
        ("customer_id", _STRING),
        ("FN", _DOUBLE),
        ("Active", _DOUBLE),
        ("club_member_status", _STRING),
        ("fashion_news_frequency", _STRING),
        ("age", _LONG),
        ("postal_code", _STRING),
    )
)
ARTICLES = _schema(
    (
        ("article_id", _STRING),
        ("product_code", _STRING),
        ("prod_name", _STRING),
        ("product_type_no", _LONG),
        ("product_type_name", _STRING),
        ("product_group_name", _STRING),
        ("graphical_appearance_no", _LONG),
        ("graphical_appearance_name", _STRING),
        ("colour_group_code", _STRING),
        ("colour_group_name", _STRING),
        ("perceived_colour_value_id", _LONG),
        ("perceived_colour_value_name", _STRING),
        ("perceived_colour_master_id", _LONG),
        ("perceived_colour_master_name", _STRING),
        ("department_no", _LONG),
        ("department_name", _STRING),
        ("index_code", _STRING),
        ("index_name", _STRING),
        ("index_group_no", _LONG),
        ("index_group_name", _STRING),
        ("section_no", _LONG),
        ("section_name", _STRING),
        ("garment_group_no", _LONG),
        ("garment_group_name", _STRING),
        ("detail_desc", _STRING),
    )
)
SCHEMAS = {"transactions": TRANSACTIONS, "customers": CUSTOMERS, "articles": ARTICLES}
# File names of the CSV delivery.
CSV_FILES = {
    "transactions": "transactions_train.csv",
    "customers": "customers.csv",
    "articles": "articles.csv",
}


def read_tables(
    spark: SparkSession,
    path: str,
    schemas: Mapping[str, T.StructType] = SCHEMAS,
    fmt: str = "csv",
) -> dict[str, DataFrame]:
    """Read every table in ``schemas`` from ``path``; a missing file is an error.

    CSV files need a header that matches the schema. ``fmt="parquet"`` reads
    ``<path>/<table>.parquet``, the layout that the ingest stage writes.
    """
    if fmt == "parquet":
        return {name: spark.read.parquet(f"{path}/{name}.parquet") for name in schemas}
    if fmt != "csv":
        raise ValueError(f"unknown table format: {fmt}")
    reader = spark.read.option("header", True).option("enforceSchema", False)
    reader = reader.option("multiLine", False).option("mode", "FAILFAST").option("escape", '"')
    return {
        name: reader.schema(schema).csv(f"{path}/{CSV_FILES.get(name, name + '.csv')}")
        for name, schema in schemas.items()
    }


def export_csv(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write tables in the CSV layout that ``read_tables`` reads."""
    for name, df in tables.items():
        target = f"{path}/{CSV_FILES.get(name, name + '.csv')}"
        df.write.option("header", True).option("escape", '"').mode("overwrite").csv(target)
