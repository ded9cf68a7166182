"""Typed CSV / Parquet sources and sinks, and the table sink.

Reads always pass an explicit schema (no inference pass over the data). Lines of
one's own CSV files that can't be read are set apart (``rejected_lines``); in the
files that this package wrote itself they are an error. The
registered round trips write to the cluster-shared folder, once for each
version of the input; they are the re-aimed form of the original's
spreadsheet and CSV hand-offs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from svcops.functions import columns as C
from svcops.operators import clean as CL
from svcops.sources.layouts import database
from svcops.sources.publish import Publication

S, D, I = T_.StringType(), T_.DoubleType(), T_.IntegerType()
DAY, B = T_.DateType(), T_.BooleanType()


def _schema(*fields) -> T_.StructType:
    return T_.StructType([T_.StructField(n, t) for n, t in fields])


TRANSACTIONS_RAW_SCHEMA = _schema(
    ("invoice", S), ("stock_code", S), ("description", S), ("quantity", I), ("invoice_date", T_.TimestampNTZType()),
    ("price", D), ("customer_id", S), ("country", S), ("revenue", D))
CUSTOMERS_RAW_SCHEMA = _schema(
    ("customer_id", S), ("segment", S), ("clv", D), ("acquisition_channel", S), ("region", S), ("acquisition_date", DAY))
TICKETS_RAW_SCHEMA = _schema(
    ("ticket_id", S), ("customer_id", S), ("location_id", S), ("ticket_date", DAY), ("issue_category", S),
    ("priority", S), ("resolution_days", D), ("csat_score", D), ("status", S))
OPERATIONS_RAW_SCHEMA = _schema(
    ("location_id", S), ("quarter", S), ("region", S), ("staff_count", D), ("sla_target_days", D),
    ("sla_achievement_rate", D), ("inventory_level", D), ("ticket_volume_handled", I))
RAW_SCHEMAS = {"transactions": TRANSACTIONS_RAW_SCHEMA, "customers": CUSTOMERS_RAW_SCHEMA,
               "tickets": TICKETS_RAW_SCHEMA, "operations": OPERATIONS_RAW_SCHEMA}

CLEAN_SCHEMAS = {
    "transactions": _schema(*((f.name, f.dataType) for f in TRANSACTIONS_RAW_SCHEMA), ("is_guest", B)),
    "customers": _schema(*((f.name, f.dataType) for f in CUSTOMERS_RAW_SCHEMA), ("clv_imputed", B)),
    "tickets": _schema(
        ("ticket_id", S), ("customer_id", S), ("location_id", S), ("ticket_date", DAY), ("issue_category", S),
        ("priority", S), ("resolution_days", D), ("sla_breached", I), ("csat_score", D), ("status", S),
        ("is_abandoned", B), ("csat_responded", B)),
    "operations": _schema(*((f.name, f.dataType) for f in OPERATIONS_RAW_SCHEMA),
                          ("sla_imputed", B), ("staff_imputed", B), ("sla_status", S)),
}

#: Text that stands for a missing value in the CSV files this package writes for itself.
NULL_TEXT = "\\N"

# Column headers of the original retail export, in file order (fixed values).
SOURCE_HEADERS = ("Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price",
                  "Customer ID", "Country", "Revenue")
SNAKE_NAMES = ("invoice", "stock_code", "description", "quantity", "invoice_date", "price",
               "customer_id", "country", "revenue")


def _csv_options(null_text: str) -> dict[str, str]:
    """Ordinary CSV: quotes are doubled inside quoted fields, blanks are data."""
    return {"header": "true", "quote": '"', "escape": '"', "nullValue": null_text,
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str | list[str], schema: T_.StructType, null_text: str = "",
             multi_line: bool = False) -> DataFrame:
    """CSV with a header, every column of the schema present. ``null_text``: the
    text of a missing value (by default an empty field). ``multi_line``: fields
    may hold line breaks; such a file is read by one task, so leave it off for
    large files that have none."""
    return (spark.read.schema(schema).options(**_csv_options(null_text), emptyValue="")
            .option("multiLine", multi_line).option("mode", "FAILFAST").csv(path))


#: Name of the column that holds the text of an unreadable line.
REJECTED = "_rejected_line"


def read_csv_lines(spark: SparkSession, path: str | list[str], schema: T_.StructType, null_text: str = "",
                   multi_line: bool = False) -> DataFrame:
    """Like ``read_csv``, but a line that can't be read (a field too many or too
    few, text in a number's place) is a row too, its text in ``REJECTED``; what
    reads it must read all columns (``_parsed``)."""
    return (spark.read.schema(_schema(*((f.name, f.dataType) for f in schema), (REJECTED, S)))
            .options(**_csv_options(null_text), emptyValue="").option("multiLine", multi_line)
            .option("columnPruning", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED).csv(path))


def write_csv(df: DataFrame, path: str, null_text: str = "") -> None:
    df.write.options(**_csv_options(null_text), emptyValue='""').csv(path)


def read_raw(spark: SparkSession, name: str, path: str, files: tuple[str, ...] | None = None) -> DataFrame:
    """One of the four raw tables from a Parquet or CSV path, or only the given
    files of it."""
    if files is not None and not files:
        return spark.createDataFrame([], RAW_SCHEMAS[name])
    paths = [path] if files is None else list(files)
    if not _is_csv(path):
        return spark.read.schema(RAW_SCHEMAS[name]).parquet(*paths)
    lines = _lines(spark, name, paths)
    return lines.where(F.col(REJECTED).isNull() & _parsed(lines)).drop(REJECTED)


def _parsed(lines: DataFrame) -> Column:
    """Always true, and needs every column: Spark checks only fields that the
    query reads, and a line must be judged alike whatever is selected."""
    return F.pmod(F.hash(*[c for c in lines.columns if c != REJECTED]), F.lit(2)) >= 0


def _is_csv(path: str) -> bool:
    return not path.rstrip("/").endswith(".parquet")


def _lines(spark: SparkSession, name: str, paths: list[str]) -> DataFrame:
    return read_csv_lines(spark, paths, RAW_SCHEMAS[name], multi_line=name == "transactions")


def rejected_lines(T) -> DataFrame:
    """``table, file, line``: the lines of one's own CSV files that can't be read
    and are in no table. Other sources have none."""
    parts = [T.spark.createDataFrame([], "table string, file string, line string")]
    for name, path in sorted(T.files.items()):
        if _is_csv(path):
            lines = _lines(T.spark, name, [path])
            bad = lines.where(F.col(REJECTED).isNotNull() & _parsed(lines))
            parts.append(bad.select(F.lit(name).alias("table"), F.input_file_name().alias("file"), F.col(REJECTED).alias("line")))
    return reduce(DataFrame.unionByName, parts)


def write_outputs(T, base: str) -> None:
    """The analysis' three CSV outputs (risk profile, critical list, quality
    report) and the lines that couldn't be read."""
    from svcops.operators import experience, quality
    write_csv(experience.cx_risk_profile(T), f"{base}/customer_risk_profile")
    write_csv(experience.cx_critical_top20(T), f"{base}/critical_risk_customers")
    write_csv(quality.dq_report(T), f"{base}/data_quality_report")
    write_csv(rejected_lines(T), f"{base}/rejected_lines")


def rename_snake(df: DataFrame) -> DataFrame:
    """Positional rename to snake_case, guarded by the expected headers."""
    if tuple(df.columns) != SOURCE_HEADERS:
        raise ValueError(f"unexpected source columns {df.columns}")
    return df.toDF(*SNAKE_NAMES)


def add_revenue(df: DataFrame) -> DataFrame:
    """Revenue on raw lines: quantity x price, negatives kept."""
    return df.withColumn("revenue", F.col("quantity") * F.col("price"))


def customer_spine(raw_transactions: DataFrame) -> DataFrame:
    """Distinct non-null customer ids as integers."""
    return (raw_transactions.where(F.col("customer_id").isNotNull())
            .select(C.norm_customer_id("customer_id").try_cast("bigint").alias("customer_id"))
            .distinct())


# ------------------------------------------------------------------ registered jobs

def src_sheets_union(T, boundary_year: int = 1998) -> DataFrame:
    """Yearly 'sheets' (CSV folders of one write) read with a schema and appended.
    Lines before the boundary year are one sheet, lines from it on another, and
    lines without a date a third, so none is lost."""
    year = F.year("invoice_date")
    sheet = F.when(year < boundary_year, "a").when(year >= boundary_year, "b").otherwise("undated")

    def write(path: str) -> None:
        raw = T.raw("transactions").withColumn("sheet", sheet)
        raw.write.options(**_csv_options(NULL_TEXT), emptyValue='""').partitionBy("sheet").csv(path)

    path = T.stage_path(f"sheets-{boundary_year}", write)
    # the folder names carry the sheet; one read appends them
    return read_csv(T.spark, path, _schema(*((f.name, f.dataType) for f in TRANSACTIONS_RAW_SCHEMA), ("sheet", S)),
                    NULL_TEXT).drop("sheet")


def src_csv(T) -> DataFrame:
    path = T.stage_path("tickets_raw_csv", lambda p: write_csv(T.raw("tickets"), p, NULL_TEXT))
    return read_csv(T.spark, path, TICKETS_RAW_SCHEMA, NULL_TEXT)


def published_csv(spark: SparkSession, location: str) -> Publication:
    """Clean tables as CSV, published at ``location``."""
    return Publication(spark, location, schemas=CLEAN_SCHEMAS, csv=_csv_options(NULL_TEXT))


def published_tables(spark: SparkSession, location: str, database: str | None = None) -> Publication:
    """Clean tables as Parquet, published at ``location``, with views in a database."""
    return Publication(spark, location, database)


def publish_clean(T, publication: Publication, names: tuple[str, ...] = tuple(CL.CLEANERS)) -> None:
    """Make the clean tables the publication's current version."""
    publication.publish({name: T.clean(name) for name in names})


def sink_csv(T) -> DataFrame:
    """Clean customers read back from their published CSV."""
    path = T.stage_path("customers_clean_csv", lambda p: publish_clean(T, published_csv(T.spark, p), ("customers",)))
    return published_csv(T.spark, path).tables()["customers"]


def sink_tables(T) -> DataFrame:
    """Row counts read back from the views of the published tables; they are
    written once for each version of the input, and ``unstage`` drops their
    database."""
    path = T.stage_path("tables", lambda p: publish_clean(T, published_tables(T.spark, p, database(p))))
    counts = [T.spark.table(f"{database(path)}.{name}").agg(F.count(F.lit(1)).alias("rows"))
              .select(F.lit(name).alias("table"), "rows") for name in CL.CLEANERS]
    return reduce(DataFrame.unionByName, counts)


def src_rename_snake(T) -> DataFrame:
    raw = T.raw("transactions")
    as_exported = raw.select(*[F.col(s).alias(h) for s, h in zip(SNAKE_NAMES, SOURCE_HEADERS)])
    return rename_snake(as_exported)


def src_revenue(T) -> DataFrame:
    return add_revenue(T.raw("transactions").drop("revenue")).select(
        "invoice", "stock_code", "quantity", "price", "revenue")


def src_customer_spine(T) -> DataFrame:
    return customer_spine(T.raw("transactions"))


QUERIES = {
    "src_sheets_union": src_sheets_union,
    "src_csv": src_csv,
    "sink_csv": sink_csv,
    "sink_tables": sink_tables,
    "src_rename_snake": src_rename_snake,
    "src_revenue": src_revenue,
    "src_customer_spine": src_customer_spine,
}
