"""CSV sources and sinks: typed rows by column name, bad rows kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.functions import parsing as p
from seriesmill.operators.features import enrich_sales, first_per_key
from seriesmill.schema import SALES, STORE, column, resolve

# File-name parts that mark a sales or store file.
STORE_FILE_MARKS = ("rossmann", "store", "train")
# Files a sales folder must hold.
TRAIN_FILE, STORE_FILE, TEST_FILE = "train.csv", "store.csv", "test.csv"


MAX_HEADERS = 100


def read_text_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Quoted, comma-separated text with a header; every column as string.

    All files must have the same columns in the same order, otherwise reading fails; see ``read_mixed_tables``.
    """
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_mixed_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``read_text_table`` for files that differ in their columns: each line is read by the header of its file.

    The header is the first line of a file.  Columns are matched by name, ignoring case; a file without one has nulls
    there.  Fields must not hold line breaks.  More than ``MAX_HEADERS`` different headers are an error.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"))
    # A file's first line is in its first block and has the lowest id there.
    first = lines.where("_block = 0").groupBy("_file").agg(F.min_by("value", "_at").alias("_header"))
    found = first.groupBy("_header").agg(F.collect_list("_file").alias("files")).limit(MAX_HEADERS + 1).collect()
    if len(found) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers below {path}")
    if not found:
        raise ValueError(f"no header below {path}")
    headers = [r["_header"] for r in found]
    # The names of the files are a small table, which lines are looked up in where they are.
    files = spark.createDataFrame([(file, r["_header"]) for r in found for file in r["files"]], "_file string, _header string")
    layouts = [[name.strip().strip('"').lower() for name in header.split(",")] for header in headers]
    # All files are read in one pass: a line's fields by place, and the place of each column by the line's header.
    width = max(map(len, layouts))
    options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "escape": '"'}
    fields = F.from_csv("value", ", ".join(f"_c{k} string" for k in range(width)), options)
    named = lines.join(F.broadcast(files), "_file").where("value <> _header AND trim(value) <> ''")
    rows = named.select("_header", fields.alias("row")).select("_header", F.array(*[F.col(f"row._c{k}") for k in range(width)]).alias("row"))

    def field(name: str) -> Column:
        place = F.lit(None).cast("int")
        for header, names in zip(headers, layouts):
            if name in names:
                place = F.when(F.col("_header") == header, names.index(name)).otherwise(place)
        return F.get("row", place)

    return rows.select(*[field(name).alias(name) for name in dict.fromkeys(n for names in layouts for n in names)])


def require_paths(spark: SparkSession, *paths: str) -> None:
    """Fail early when an input is missing, whatever file system it is on."""
    for path in paths:
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = location.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.globStatus(location):
            raise FileNotFoundError(f"no input at {path}")


def is_store_file(name: Column) -> Column:
    """Does the file name mark a sales or store file?"""
    base = F.lower(F.element_at(F.split(name, "[/\\\\]"), -1))
    return p.any_of([F.contains(base, F.lit(mark)) for mark in STORE_FILE_MARKS])


def route_files(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of sales and store files, rows of other demand files)."""
    marked = is_store_file(F.col("_metadata.file_name"))
    return text.where(marked), text.where(~marked)


def with_reasons(raw: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds ``reason``: the first check that holds, null for a good row."""
    reason = F.coalesce(*[F.when(test, F.lit(name)) for name, test in checks.items()])
    return raw.withColumn("reason", reason)


def parse_demand(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted ``ds, sales, state_holiday``, rejected rows with their reason).

    Columns are found by name, any case: Date, Sales, and Holiday or StateHoliday.
    """
    date, sales = column(raw, "Date"), column(raw, "Sales")
    holiday = column(raw, "Holiday", "StateHoliday", default=F.lit(None).cast("string"))
    typed = raw.select(
        date.alias("raw_date"), sales.alias("raw_sales"),
        p.parse_date(date).alias("ds"), F.trim(sales).try_cast("double").alias("sales"),
        p.blank_to_default(holiday, p.BLANK_HOLIDAY).alias("state_holiday"),
    )
    judged = with_reasons(typed, {
        "missing_fields": F.col("raw_date").isNull() | F.col("raw_sales").isNull(),
        "bad_date": F.col("ds").isNull(),
        "bad_number": F.col("sales").isNull(),
    })
    good = judged.where(F.col("reason").isNull()).select("ds", p.nan_to_null(F.col("sales")).alias("sales"), "state_holiday")
    return good, judged.where(F.col("reason").isNotNull()).select("raw_date", "raw_sales", "reason")


def load_demand(spark: SparkSession, path: str) -> DataFrame:
    """Accepted rows of a demand file or folder; see ``parse_demand`` for the rejects."""
    require_paths(spark, path)
    return parse_demand(read_text_table(spark, path))[0]


def _split_off(judged: DataFrame, raw: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, the raw fields and reason of the others)."""
    good = F.col("reason").isNull()
    return judged.where(good).select(*columns), judged.where(~good).select(*raw, "reason")


def parse_store(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store dimension, rejected ``raw_store, reason``): a row needs a numeric store id."""
    def i(name: str) -> Column:
        return p.parse_int(column(raw, name))

    store = column(raw, "Store")
    typed = raw.select(
        store.alias("raw_store"),
        i("Store").alias("store_id"),
        p.blank_to_default(column(raw, "StoreType"), p.BLANK_CATEGORY).alias("store_type"),
        p.blank_to_default(column(raw, "Assortment"), p.BLANK_CATEGORY).alias("assortment"),
        p.parse_double(column(raw, "CompetitionDistance")).cast("int").alias("competition_distance"),
        i("CompetitionOpenSinceMonth").alias("competition_open_since_month"),
        i("CompetitionOpenSinceYear").alias("competition_open_since_year"),
        p.parse_flag(column(raw, "Promo2")).alias("promo2"),
        i("Promo2SinceWeek").alias("promo2_since_week"),
        i("Promo2SinceYear").alias("promo2_since_year"),
        p.blank_to_default(column(raw, "PromoInterval"), p.BLANK_INTERVAL).alias("promo_interval"),
    )
    judged = with_reasons(typed, {"bad_store": F.col("store_id").isNull()})
    return _split_off(judged, ["raw_store"], STORE.names)


def parse_sales(raw: DataFrame, scoring: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sales facts by column name, rejected ``raw_store, raw_date, reason``).

    A row needs a store and a date.  Flags are 1 for the text "1" and else 0; sales and customers that are blank or no
    number are null.  Scoring files have neither; both become 0.
    """
    store, date = column(raw, "Store"), column(raw, "Date")
    sales = F.lit(0.0) if scoring else p.parse_double(column(raw, "Sales"))
    customers = F.lit(0) if scoring else p.parse_int(column(raw, "Customers"))
    typed = raw.select(
        store.alias("raw_store"), date.alias("raw_date"),
        p.parse_int(store).alias("store_id"),
        p.parse_date(date).alias("ds"),
        sales.alias("sales"),
        customers.alias("customers"),
        p.parse_flag(column(raw, "Open")).alias("open"),
        p.parse_flag(column(raw, "Promo")).alias("promo"),
        p.blank_to_default(column(raw, "StateHoliday"), p.BLANK_HOLIDAY).alias("state_holiday"),
        p.parse_flag(column(raw, "SchoolHoliday")).alias("school_holiday"),
    )
    judged = with_reasons(typed, {"bad_store": F.col("store_id").isNull(), "bad_date": F.col("ds").isNull()})
    return _split_off(judged, ["raw_store", "raw_date"], SALES.names)


def parse_split_lines(lines: DataFrame, names: list[str], min_fields: int, value: str = "value") -> DataFrame:
    """Plain comma split of text lines; lines with too few fields are dropped."""
    parts = F.split(F.col(value), ",")
    return lines.where(F.size(parts) >= min_fields).select(
        *[F.get(parts, at).alias(name) for at, name in enumerate(names)]
    )


def split_lines(lines: DataFrame, names: list[str], min_fields: int, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows of the fields, rejected ``line, reason``) of a plain comma split."""
    parts = F.split(F.col(value), ",")
    short = lines.where(F.size(parts) < min_fields).select(F.col(value).alias("line"), F.lit("few_fields").alias("reason"))
    rows = lines.where(F.size(parts) >= min_fields).select(F.col(value).alias("line"), *[F.get(parts, at).alias(name) for at, name in enumerate(names)])
    return rows, short


# Columns of the plain files in order, by kind; all must be present.
SPLIT_LAYOUTS = {
    "store": (
        "Store", "StoreType", "Assortment", "CompetitionDistance", "CompetitionOpenSinceMonth",
        "CompetitionOpenSinceYear", "Promo2", "Promo2SinceWeek", "Promo2SinceYear", "PromoInterval",
    ),
    "sales": ("Store", "DayOfWeek", "Date", "Sales", "Customers", "Open", "Promo", "StateHoliday", "SchoolHoliday"),
    "scoring": ("Id", "Store", "DayOfWeek", "Date", "Open", "Promo", "StateHoliday", "SchoolHoliday"),
}


def parse_split_table(lines: DataFrame, kind: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected ``line, reason``) of unquoted lines of a store, sales or scoring file without its header."""
    layout = SPLIT_LAYOUTS[kind]
    parts = F.split(F.col(value), ",")
    raw = lines.select(F.col(value).alias("line"), *[F.get(parts, at).alias(name) for at, name in enumerate(layout)])
    enough = F.size(F.split("line", ",")) >= len(layout)
    good = raw.where(enough)
    accepted, _ = parse_store(good) if kind == "store" else parse_sales(good, scoring=kind == "scoring")
    bad = {"few_fields": ~enough, "bad_store": p.parse_int(F.col("Store")).isNull()}
    if kind != "store":
        bad["bad_date"] = p.parse_date(F.col("Date")).isNull()
    return accepted, with_reasons(raw, bad).where("reason IS NOT NULL").select("line", "reason")


def load_sales_folder(spark: SparkSession, folder: str, scoring: bool = False) -> DataFrame:
    """Sales (or scoring) rows of a folder with their store columns."""
    fact = f"{folder.rstrip('/')}/{TEST_FILE if scoring else TRAIN_FILE}"
    store = f"{folder.rstrip('/')}/{STORE_FILE}"
    require_paths(spark, fact, store)
    stores, _ = parse_store(read_text_table(spark, store))
    stores = first_per_key(stores, "store_id", F.struct(*[c for c in stores.columns if c != "store_id"]))
    return enrich_sales(parse_sales(read_text_table(spark, fact), scoring)[0], stores)


def archive_import(raw: DataFrame, path: str, imported_at: str) -> None:
    """Append accepted input below ``imported_at=…``."""
    raw.withColumn("imported_at", F.lit(imported_at)).write.mode("append").partitionBy("imported_at").parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def export_forecast(forecast: DataFrame, path: str, mode: str = "errorifexists") -> None:
    missing = [c for c in ("series_key", "ds", "yhat", "lo", "hi") if resolve(forecast, c, required=False) is None]
    if missing:
        raise ValueError(f"not a forecast table, missing: {', '.join(missing)}")
    export_csv(forecast, path, mode)
