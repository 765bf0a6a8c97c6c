"""Scans: raw CSV feeds, landed payloads, silver and gold tables, the security list."""

from __future__ import annotations

import csv
import json
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.headers import LANDING_ORDER, quoted
from marketloom.session import shared_folder

# Marks of a landed body that is an error page and no table.
ERROR_PAGE = r"(?i)<html"
ERROR_TEXT = "PAGE CANNOT BE ACCESSED"
BYTE_ORDER_MARK = "\ufeff"
PAYLOAD_OK = "OK"

SLOTS = 16  # keys that the rows of one file spread over


# --- paths ---------------------------------------------------------------------


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, or anything under the glob, exists on the session's file system."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def empty(spark: SparkSession, schema: T.StructType | str = "stock_id string") -> DataFrame:
    return spark.createDataFrame([], schema)


def with_landing_order(df: DataFrame, whole: bool = False) -> DataFrame:
    """Adds a struct that orders the rows of a file scan: by the name of the file, the start of the part of it that
    a task reads, and the row in this part.

    Tasks read their parts in an order that depends on the sizes, so a running number alone would not do. The struct
    depends on the files only, not on which executor reads them, in which order or how often. Files of one folder are known by
    what stands after it, as every row carries the name through sorts and exchanges; ``whole`` keeps their paths.
    """
    file = F.col("_metadata.file_path")
    if not whole and len({name.rpartition("/")[0] for name in df.inputFiles()}) == 1:
        file = F.substring_index(file, "/", -1)
    place = F.struct(
        file.alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.withColumn(LANDING_ORDER, place)


# --- raw CSV -------------------------------------------------------------------


def _csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All columns as text. Without inference Spark reads one header line and no rows here."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
    df = reader.csv(paths)
    if any(kind != "string" for _, kind in df.dtypes):  # of folders like stock_id=0050, whose value is text as well
        schema = T.StructType([T.StructField(name, T.StringType()) for name in df.columns])
        df = reader.schema(schema).csv(paths)
    return df


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """One raw dataset whose files share a header; an absent or empty one is an empty table."""
    if not path_exists(spark, path):
        return empty(spark)
    df = _csv(spark, path)
    return with_landing_order(df) if df.columns else empty(spark)


def header_layouts(spark: SparkSession, path: str, tabular: bool = False) -> DataFrame:
    """(file, header): the first line of every file that has one, in one pass over the text. Only the first line of a file's first part
    leaves a task. With ``tabular``, files with a line of an error page are left out, in the same pass."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.translate("value", BYTE_ORDER_MARK, "").alias("value"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("row"),
    )
    if tabular:  # the set of faults, unlike a flag, also lets Spark hash-aggregate the header, which is text
        faults = F.collect_set(F.when((F.col("value") != "") & ~is_tabular(F.col("value")), F.lit(True)))
        headers = lines.groupBy("file").agg(F.min_by("value", "row").alias("header"), faults.alias("faults"))
        headers = headers.where(F.size("faults") == 0).drop("faults")
    else:
        headers = lines.where(F.col("row").isNotNull()).groupBy("file").agg(F.min_by("value", "row").alias("header"))
    return headers.where(F.trim("header") != "")


def _stored(index: DataFrame) -> DataFrame:
    """The index, computed once, in the shared folder: what reads it sees how small it is. Without such a folder, the index as it is."""
    try:
        path = f"{shared_folder(index.sparkSession)}/index-{uuid.uuid4().hex}"
    except RuntimeError:
        return index
    index.write.parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def _without_files(df: DataFrame, file: str, unwanted: DataFrame | None) -> DataFrame:
    """Rows whose file is not among the unwanted ones, of which there is one row per file."""
    return df if unwanted is None else df.join(unwanted.select(F.col("file").alias(file)), file, "left_anti")


def read_raw_files(
    spark: SparkSession, path: str, lineage: str | None = None, multiline: bool = False, unwanted: DataFrame | None = None,
    tabular: bool = False,
) -> DataFrame:
    """The union of raw files whose headers may differ, each column by its name; of equal names in a header the first counts.

    A header index leads the rows: one pass over the text finds the header of every file, and one read parses all files, whose
    rows take their layout from the index by their file. The driver gets the distinct headers, whose number does not grow
    with the rows or files. A large file's rows spread over SLOTS keys of that join. ``lineage`` names a column for the source
    file. ``multiline`` reads records with quoted line breaks; a file is then read by one task. ``unwanted`` holds files to leave
    out, ``tabular`` those with a line of an error page. Landing order is one order over all layouts: by file name, then place in the file.
    """
    if not path_exists(spark, path):
        return empty(spark)
    if tabular:
        layouts = _stored(_without_files(header_layouts(spark, path, tabular=True), "file", unwanted))
    else:
        layouts = _without_files(header_layouts(spark, path), "file", unwanted)
    found = sorted(row.header for row in layouts.select("header").distinct().collect())
    if not found:
        return empty(spark)
    names = [next(csv.reader([header])) for header in found]
    cells = [f"_cell{i}" for i in range(max(map(len, names)))]
    reader = spark.read.option("header", False).option("escape", '"').option("multiLine", multiline)
    records = with_landing_order(reader.schema(", ".join(f"{cell} string" for cell in cells)).csv(path), whole=True).select(
        *cells, LANDING_ORDER, F.pmod(F.monotonically_increasing_id(), F.lit(SLOTS)).alias("_slot")
    )
    numbers = F.create_map(*[part for number, header in enumerate(found) for part in (F.lit(header), F.lit(number))])
    index = layouts.select("file", numbers[F.col("header")].alias("_layout")).withColumn(
        "_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long")))
    )
    placed = records.withColumn("file", F.col(LANDING_ORDER)["file"]).join(index, ["file", "_slot"])

    def value(name: str) -> Column:
        at = [(number, row.index(name)) for number, row in enumerate(names) if name in row]
        if len(at) == len(names) and len({place for _, place in at}) == 1:
            return F.col(cells[at[0][1]])
        return F.coalesce(*[F.when(F.col("_layout") == number, F.col(cells[place])) for number, place in at])

    def is_header() -> Column:
        first = F.translate(cells[0], BYTE_ORDER_MARK, "")
        same = [
            (F.col("_layout") == number) & F.array(first, *cells[1 : len(row)]).eqNullSafe(F.array(*[F.lit(name or None) for name in row]))
            for number, row in enumerate(names)
        ]
        return (F.col(LANDING_ORDER)["start"] == 0) & reduce(Column.__or__, same)

    united = list(dict.fromkeys(name for row in names for name in row if name))
    rows = placed.where(~is_header())
    sources = [F.col("file").alias(lineage)] if lineage else []
    return rows.select(*[value(name).alias(name) for name in united], *sources, LANDING_ORDER)


def entity_id(dataset: str, file: Column) -> Column:
    """The id in the file name ``{dataset}_{id}.csv``."""
    return F.regexp_extract(file, rf"{dataset}_([^/]+)\.csv", 1)


# --- landed payloads -------------------------------------------------------------


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one row per file: (path, body)."""
    if not path_exists(spark, path):
        return empty(spark, "path string, body string")
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")
    )


def is_tabular(body: Column) -> Column:
    """False for empty bodies, HTML and error pages."""
    text = F.translate(body, BYTE_ORDER_MARK, "")
    return F.coalesce((text != "") & ~text.rlike(ERROR_PAGE) & ~text.contains(ERROR_TEXT), F.lit(False))


def accepted_bodies(bodies: DataFrame) -> DataFrame:
    """Tabular bodies without their byte order mark."""
    return bodies.where(is_tabular(F.col("body"))).withColumn(
        "body", F.regexp_replace(F.col("body"), f"^{BYTE_ORDER_MARK}", "")
    )


def rejected_bodies(bodies: DataFrame) -> DataFrame:
    return bodies.where(~is_tabular(F.col("body")))


def read_landed_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the landed CSV files that are tables, with the wanted columns by header name; absent ones are null. Quoted line
    breaks stay in their field. Error pages and empty files, found by their text, are left out by their name."""
    if not path_exists(spark, path):
        return empty(spark, ", ".join(f"`{name}` string" for name in columns))
    rows = read_raw_files(spark, path, multiline=True, tabular=True)
    return rows.select(*[quoted(name) if name in rows.columns else F.lit(None).cast("string").alias(name) for name in columns])


OBJECTS = "array<map<string,string>>"


def _parsed(bodies: DataFrame) -> DataFrame:
    """Adds what a JSON body holds, each in a column of its own, so that a body is parsed once however often the parts are used.

    ``_shape`` is list, fields, matrix, data or answer; null for any other text. An answer is a status without rows, such as the
    one for a month without trading.
    """
    body = F.col("body")
    parts = bodies.withColumns({
        "_list": F.when(F.ltrim(body).startswith("["), F.from_json(body, OBJECTS)),
        "_fields": F.get_json_object(body, "$.fields"),
        "_data": F.get_json_object(body, "$.data"),
    })
    fields, data = F.col("_fields"), F.col("_data")
    shape = (
        F.when(F.col("_list").isNotNull(), "list")
        .when(data.isNull() & F.get_json_object(body, "$.fields[0]").startswith("{"), "fields")
        .when(fields.startswith("[") & data.startswith("["), "matrix")
        .when(data.startswith("["), "data")
        .when(F.get_json_object(body, "$.stat").isNotNull(), "answer")
    )
    return parts.withColumn("_shape", shape)


def payload_rows(bodies: DataFrame, columns: Sequence[str], keep_rejected: bool = False) -> DataFrame:
    """Rows of landed JSON bodies with the wanted columns by name.

    Four shapes have rows: a list of objects, ``{"data": [objects]}``, ``{"fields": [objects]}``, and a matrix
    ``{"stat": "OK", "fields": [names], "data": [[values]]}``. A matrix with another status gives no rows. The first
    of equal names in a matrix counts, values beyond the names are left out, and absent values are null.
    With ``keep_rejected`` each of the ``rejected_payloads`` gives one row without values, in the same pass.
    """
    passed = [name for name in bodies.columns if name != "body"]
    body, shape, matrix = F.col("body"), F.col("_shape"), F.col("_matrix")
    table = F.from_json(body, "struct<stat:string,fields:array<string>,data:array<array<string>>>")
    parsed = _parsed(bodies).withColumn("_matrix", F.when(shape == "matrix", table))
    names = F.array(*[F.lit(name) for name in columns])

    def picked(row: Column) -> Column:
        places = [F.nullif(F.array_position(matrix["fields"], name), F.lit(0)).cast("int") for name in columns]
        return F.map_from_arrays(names, F.array(*[F.try_element_at(row, place) for place in places]))

    rows = (
        F.when(shape == "list", F.col("_list"))
        .when(shape == "fields", F.from_json(body, f"struct<fields:{OBJECTS}>")["fields"])
        .when((shape == "matrix") & (matrix["stat"] == PAYLOAD_OK), F.transform(matrix["data"], picked))
        .when(shape == "data", F.from_json(body, f"struct<data:{OBJECTS}>")["data"])
    )
    if keep_rejected:
        rows = F.when(shape.isNull(), F.array(F.lit(None).cast("map<string,string>"))).otherwise(rows)
    exploded = parsed.select(*passed, F.explode(rows).alias("_row"))
    return exploded.select(*passed, *[F.try_element_at("_row", F.lit(name)).alias(name) for name in columns])


def rejected_payloads(bodies: DataFrame) -> DataFrame:
    """Bodies that are no JSON, or JSON of no known shape."""
    return _parsed(bodies).where("_shape IS NULL").select(*bodies.columns)


# --- tables ----------------------------------------------------------------------


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A silver or gold table: Parquet if present, else CSV, else empty with the same columns."""
    parquet, csv = f"{folder}/{name}.parquet", f"{folder}/{name}.csv"
    if path_exists(spark, parquet):
        return spark.read.schema(schema).parquet(parquet).select(*schema.names)
    if path_exists(spark, csv):
        return spark.read.schema(schema).option("header", True).csv(csv)
    return empty(spark, schema)


def read_bucketed(
    spark: SparkSession, name: str, folder: str, schema: T.StructType, buckets: int, key: str = "stock_id", sort: Sequence[str] = ()
) -> DataFrame:
    """A table as ``write_bucketed`` stored it, with the same buckets; an absent one is empty. The catalog entry that tells Spark of the
    buckets is only needed until the frame is resolved."""
    path = f"{folder}/{name}.parquet"
    if not path_exists(spark, path):
        return empty(spark, schema)
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)
    order = ", ".join(f"`{column}`" for column in dict.fromkeys([key, *sort]))
    stage = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {stage} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({order}) INTO {buckets} BUCKETS"
        f" LOCATION '{path}'"
    )
    try:
        table = spark.table(stage)
        table.schema  # resolves it
        return table
    finally:
        spark.sql(f"DROP TABLE {stage}")


def missing_tables(spark: SparkSession, names: Iterable[str], folder: str | None = None) -> list[str]:
    """Required tables that are neither in the folder nor, without one, in the catalog."""
    if folder is None:
        return [name for name in names if not spark.catalog.tableExists(name)]
    return [
        name
        for name in names
        if not any(path_exists(spark, f"{folder}/{name}.{suffix}") for suffix in ("parquet", "csv"))
    ]


# --- securities -------------------------------------------------------------------

SECURITY_FIELDS = ("stock_id", "stock_name", "industry_group", "market_type", "focus_flag")
SECURITY_SCHEMA = "stock_id string, stock_name string, industry_group string, market_type string, focus_flag boolean, place int"

# The configured securities.
DEFAULT_SECURITIES = (
    ("2330", "台積電", "Semiconductor"),
    ("2308", "台達電", "Electronic Components"),
    ("2454", "聯發科", "Semiconductor"),
    ("2317", "鴻海", "Electronics Manufacturing"),
    ("3711", "日月光投控", "Semiconductor"),
    ("2383", "台光電", "Electronic Components"),
    ("3037", "欣興", "Electronic Components"),
    ("2345", "智邦", "Communications and Internet"),
    ("2881", "富邦金", "Financial"),
    ("2382", "廣達", "Computer and Peripheral Equipment"),
    ("2303", "聯電", "Semiconductor"),
    ("6669", "緯穎", "Computer and Peripheral Equipment"),
    ("3231", "緯創", "Computer and Peripheral Equipment"),
    ("8299", "群聯", "Semiconductor"),
    ("2344", "華邦電", "Semiconductor"),
    ("2337", "旺宏", "Semiconductor"),
)
DEFAULT_MARKET = "Listed"


def securities(spark: SparkSession, entries: Iterable[dict] | None = None) -> DataFrame:
    """The configured securities as a small table; ``place`` is the list position."""
    if entries is None:
        entries = [
            dict(stock_id=item, stock_name=name, industry_group=industry, market_type=DEFAULT_MARKET)
            for item, name, industry in DEFAULT_SECURITIES
        ]

    def text(value: object) -> str | None:
        return None if value is None else str(value).strip()

    rows = [
        (*[text(entry.get(name)) for name in SECURITY_FIELDS[:-1]], bool(entry.get("focus_flag", False)), place)
        for place, entry in enumerate(entries)
        if entry.get("stock_id")
    ]
    return spark.createDataFrame(rows, SECURITY_SCHEMA)


def load_securities(spark: SparkSession, path: str) -> DataFrame:
    """Securities from a YAML or JSON file with a ``stocks`` list."""
    content = spark.read.text(path, wholetext=True).first().value
    if path.endswith((".yml", ".yaml")):
        import yaml

        payload = yaml.safe_load(content) or {}
    else:
        payload = json.loads(content)
    return securities(spark, payload.get("stocks", []))
