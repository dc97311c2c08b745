"""Readers. Schemas are always given, never inferred from the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fieldgauge.operators.quality import require_columns
from fieldgauge.sources.checked import load_csv_checked
from fieldgauge.sources.lines import numbered_lines

# Column names and types of the input files.
MARKETPLACE_SCHEMAS = {
    "orders": "order_id string, customer_id string, order_status string, "
              "order_purchase_timestamp timestamp, order_approved_at timestamp, "
              "order_delivered_carrier_date timestamp, order_delivered_customer_date timestamp, "
              "order_estimated_delivery_date timestamp",
    "order_items": "order_id string, order_item_id int, product_id string, seller_id string, "
                   "shipping_limit_date timestamp, price decimal(18,2), "
                   "freight_value decimal(18,2)",
    "payments": "order_id string, payment_sequential int, payment_type string, "
                "payment_installments int, payment_value decimal(18,2)",
    "reviews": "review_id string, order_id string, review_score int, "
               "review_comment_title string, review_comment_message string, "
               "review_creation_date timestamp, review_answer_timestamp timestamp",
    "customers": "customer_id string, customer_unique_id string, "
                 "customer_zip_code_prefix string, customer_city string, customer_state string",
    "products": "product_id string, product_category_name string, product_name_lenght int, "
                "product_description_lenght int, product_photos_qty int, product_weight_g int, "
                "product_length_cm int, product_height_cm int, product_width_cm int",
    "sellers": "seller_id string, seller_zip_code_prefix string, seller_city string, "
               "seller_state string",
    "category_translation": "product_category_name string, "
                            "product_category_name_english string",
}
FREE_TEXT_TABLES = ("reviews",)  # comments there may hold line breaks
CHURN_SCHEMA = (
    "customerID string, gender string, SeniorCitizen int, Partner string, Dependents string, "
    "tenure int, PhoneService string, MultipleLines string, InternetService string, "
    "OnlineSecurity string, OnlineBackup string, DeviceProtection string, TechSupport string, "
    "StreamingTV string, StreamingMovies string, Contract string, PaperlessBilling string, "
    "PaymentMethod string, MonthlyCharges double, TotalCharges string, Churn string")
EXPERIMENT_SCHEMA = ("user_id long, timestamp timestamp, group string, landing_page string, "
                     "converted int")
SCORES_SCHEMA = ("unit_nr int, RUL int, predicted_RUL double, failure_probability double, "
                 "actual_failure_soon int")
TURBOFAN_COLUMNS = {
    "unit_nr": "int", "time_cycles": "int",
    **{f"setting_{i}": "double" for i in range(1, 4)},
    **{f"s_{i}": "double" for i in range(1, 22)},
}


def load_csv(spark: SparkSession, path: str, schema: str | T.StructType, *,
             required: Sequence[str] = (), **options: str) -> DataFrame:
    """A headed CSV. Columns are matched by position, and the header is checked against them.

    Files with line breaks inside fields need ``checked.load_csv_checked``, which splits them.
    """
    settings = {"escape": '"', "enforceSchema": "false", **options}
    df = spark.read.options(header="true", **settings).schema(schema).csv(path)
    return require_columns(df, required, path)


def register_marketplace(spark: SparkSession, paths: Mapping[str, str],
                         **options: str) -> dict[str, DataFrame]:
    """Load the named marketplace tables and register each as a temporary view."""
    tables = {}
    for name, path in paths.items():
        schema = MARKETPLACE_SCHEMAS[name]
        tables[name] = (load_csv_checked(spark, path, schema).rows if name in FREE_TEXT_TABLES
                        else load_csv(spark, path, schema, **options))
        tables[name].createOrReplaceTempView(name)
    return tables


def load_whitespace(spark: SparkSession, path: str,
                    columns: Mapping[str, str] = TURBOFAN_COLUMNS) -> DataFrame:
    """Header-less text whose fields are separated by any run of blanks."""
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "").select(fields.alias("f"))
    return lines.select(*[F.get("f", F.lit(i)).cast(kind).alias(name)
                          for i, (name, kind) in enumerate(columns.items())])


def load_positional(spark: SparkSession, path: str, value: str = "RUL",
                    key: str = "unit_nr", kind: str = "int") -> DataFrame:
    """One value per line; the line number, from 1, is the key. Blank lines have a number but
    no row.

    Line numbers only mean something inside one file, so several files are refused. Prefer a
    file with an explicit key.
    """
    lines = numbered_lines(spark, path, one_file=True).where(F.trim("value") != "")
    return lines.select(F.col("line").cast("int").alias(key),
                        F.trim("value").cast(kind).alias(value))


def load_dimension(spark: SparkSession, path: str,
                   schema: str = MARKETPLACE_SCHEMAS["category_translation"]) -> DataFrame:
    """A small lookup table; a byte-order mark before the header is skipped."""
    return load_csv(spark, path, schema)


# Input columns under the names the reports use.
MARKETPLACE_NAMES = {
    "orders": {"order_id": "order_id", "customer_id": "customer_id", "order_status": "status",
               "order_purchase_timestamp": "purchased",
               "order_delivered_customer_date": "delivered",
               "order_estimated_delivery_date": "estimated"},
    "order_items": {"order_id": "order_id", "product_id": "product_id", "price": "price",
                    "freight_value": "freight"},
    "payments": {"payment_type": "payment_type", "payment_installments": "installments",
                 "payment_value": "payment_value"},
    "reviews": {"order_id": "order_id", "review_score": "score"},
    "customers": {"customer_id": "customer_id", "customer_state": "state"},
    "products": {"product_id": "product_id", "product_category_name": "category_name"},
    "category_translation": {"product_category_name": "category_name",
                             "product_category_name_english": "category_english"},
}


def report_inputs(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The loaded tables with the columns the marketplace reports read, under their names."""
    out = {}
    for table, names in MARKETPLACE_NAMES.items():
        loaded = require_columns(tables[table], list(names), table)
        out[table] = loaded.select(*[F.col(c).alias(n) for c, n in names.items()])
    return out


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """The documents that ``write_report`` wrote."""
    return spark.read.schema("value string, report string").text(path).select(
        "report", F.col("value").alias("document"))


def document_fields(document: DataFrame) -> DataFrame:
    """The figures of report documents, one row each: report, section, position, field, number
    and text.

    ``position`` counts the entries of a section from 1; a section that is one object has a
    single entry. A JSON number stands in ``number``, text and booleans in ``text``, and a JSON
    null leaves both NULL. A text that looks like a number stays text. Nested values keep
    their JSON in ``text``. A section with no entries gives no row, a broken document an error.
    """
    sections = document.select("report", F.explode(F.expr(
        "CAST(parse_json(document) AS MAP<STRING, VARIANT>)")).alias("section", "content"))
    entries = sections.select("report", "section", F.posexplode(F.expr(
        "CASE WHEN startswith(schema_of_variant(content), 'ARRAY') "
        "THEN CAST(content AS ARRAY<VARIANT>) ELSE array(content) END")).alias("at", "entry"))
    fields = entries.select("report", "section", (F.col("at") + 1).alias("position"), F.explode(
        F.expr("CAST(entry AS MAP<STRING, VARIANT>)")).alias("field", "value"))
    kind = F.schema_of_variant("value")
    numeric = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    return fields.select(
        "report", "section", "position", "field",
        F.when(numeric, F.expr("try_variant_get(value, '$', 'double')")).alias("number"),
        F.when(~numeric, F.expr("try_variant_get(value, '$', 'string')")).alias("text"))
