"""CSV / Parquet / JDBC edges of the catalog.

Inside the engine nested values are arrays, maps and structs; JSON text exists
only at the CSV edge.  A CSV file is cut into splits, also where quoted values hold
line breaks, and the row number of a row inside its file is exact: the header is row 1, data rows count from 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import strip_ws
from sitelens.sources.csv_split import records

ENRICHED_CSV_COLUMNS = ["website_url", "platform", "industry", "tags", "platforms", "industries",
                        "colors", "tag_confidence", "enrichment_signals", "last_enriched_at"]
ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, plus ``source_file``, ``source_bytes`` (file size) and
    ``row_no`` (2 = first data row, blank lines not counted).

    An explicit ``row_no`` column in the file is kept as is.  A large file is read by many tasks (``csv_split``).
    """
    form = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    names = spark.read.options(header=True, multiLine=True, **form).csv(path).columns  # of the first file's header
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = records(spark, path).filter("record > 1").withColumn("_row", F.from_csv("text", ddl, {**form, "multiLine": "true"}))
    number = F.col("_row").getField("row_no").cast("long") if "row_no" in names else F.col("record")
    return rows.select(*[number.alias(n) if n == "row_no" else F.col("_row").getField(n).alias(n) for n in names], F.col("file").alias("source_file"),
                       F.col("bytes").alias("source_bytes"), *([] if "row_no" in names else [number.alias("row_no")]))


def read_raw_sites(spark: SparkSession, path: str) -> DataFrame:
    """Raw URL list (S1): rows with a non-blank ``website_url``; other columns kept."""
    df = read_csv_rows(spark, path)
    return df.withColumn("website_url", strip_ws(F.col("website_url"))) \
        .filter(F.length(F.coalesce(F.col("website_url"), F.lit(""))) > 0)


def read_enriched_csv(spark: SparkSession, path: str) -> DataFrame:
    """Enriched CSV (S3) as text columns with row numbers; decode with ``import_enriched``."""
    return read_csv_rows(spark, path)


def to_enriched_text(records: DataFrame) -> DataFrame:
    """Enrichment records -> the 10 CSV columns (nested values as JSON text)."""
    def js(c):
        return F.when(F.col(c).isNotNull(), F.to_json(F.col(c), {"ignoreNullFields": "false"}))
    return records.select(
        "website_url", "platform", "industry", "tags",
        js("platforms").alias("platforms"), js("industries").alias("industries"),
        js("colors").alias("colors"), js("tag_confidence").alias("tag_confidence"),
        js("enrichment_signals").alias("enrichment_signals"),
        F.date_format("last_enriched_at", ISO_Z).alias("last_enriched_at"))


def write_enriched_csv(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Enriched CSV sink (S2): header + 10 columns, JSON text for nested values."""
    (to_enriched_text(records).write.mode(mode).option("header", True)
     .option("quote", '"').option("escape", '"').csv(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages (S7, re-aimed fetch): page_id, url, html; NULL/empty html = failed."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Catalog table from a database (S6): a parallel JDBC read when bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", num_partitions or 8))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None,
               mode: str = "append") -> None:
    """Write a frame to a database table (S6)."""
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).mode(mode)
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.save()
