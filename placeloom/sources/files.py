"""Reading and writing the register's files: delimited text, JSON, GeoJSON, reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeloom.functions import text as T

BOM = "﻿"
# Header names of query lists, Russian and English.
QUERY_HEADERS = {
    "district": ("district", "район", "округ"),
    "group_name": ("group", "группа"),
    "category": ("category", "категория", "подкатегория", "category / subcategory"),
    "query_text": ("query", "запрос", "search", "search_query", "source_query", "поисковый запрос"),
}
#: Queries that a list may have: it is a worklist written by people, numbered in one place.
MAX_QUERIES = 1_000_000
NUMERIC = {"rating": "double", "latitude": "double", "longitude": "double", "review_count": "int", "photos": "int", "source_queries_count": "int"}


def sniff_delimiter(line: str) -> str:
    """The most frequent of comma, semicolon and tab outside quotes; ties in that order, comma if there is none."""
    bare = re.sub(r'"(?:[^"]|"")*"', "", line)
    return max(",;\t", key=lambda c: (bare.count(c), -",;\t".index(c)))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file with a header, all columns text, cells trimmed, rows without any value dropped.

    Handles a byte-order mark, doubled quotes, line breaks in quotes and any line ends. The
    separator is found from the first line that is not blank.
    """
    if sep is None:
        first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
        if not first:
            raise ValueError(f"{path} is empty")
        sep = sniff_delimiter(first[0]["value"].lstrip(BOM))
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False)
    names = [c.lstrip(BOM).strip().strip('"') for c in df.columns]
    df = df.toDF(*names).select(*[F.regexp_replace(F.col(f"`{c}`"), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "").alias(c) for c in names])
    return df.filter(F.coalesce(*[T.filled(F.trim(F.col(f"`{c}`"))) for c in names]).isNotNull())


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself; an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def query_list(df: DataFrame) -> DataFrame:
    """(id, position, district, group_name, category, query_text, status) of a query list, blank and repeated queries dropped.

    The id names the line of the file and the place among the queries kept. A raw export (it has place_id or
    maps_url) and a list of sources (primary_source or selection_rule) are refused, as is a list without queries.
    """
    lower = {c.lower(): c for c in df.columns}
    if {"place_id", "maps_url"} & set(lower):
        raise ValueError("this is an export of places, not a list of queries")
    cols = []
    for name, aliases in QUERY_HEADERS.items():
        found = next((lower[a] for a in aliases if a in lower), None)
        cols.append((F.coalesce(F.trim(F.col(f"`{found}`")), F.lit("")) if found else F.lit("")).alias(name))
    if not any(a in lower for a in QUERY_HEADERS["query_text"]):
        raise ValueError("this is a list of sources, not of queries" if {"primary_source", "selection_rule"} & set(lower) else "the list has no column of queries")
    rows = df.select(F.monotonically_increasing_id().alias("at"), *cols)
    n = rows.limit(MAX_QUERIES + 1).count()
    if n > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries")
    line = F.row_number().over(Window.orderBy("at"))  # bounded above
    keys = [T.normalize(F.col(c)).alias(f"k{i}") for i, c in enumerate(QUERY_HEADERS)]
    first = rows.withColumn("line", line).filter("query_text <> ''").groupBy(*keys).agg(F.min_by(F.struct("line", *QUERY_HEADERS), "line").alias("r")).select("r.*")
    numbered = first.withColumn("position", F.row_number().over(Window.orderBy("line")))
    return numbered.select(F.format_string("q-%d-%d", F.col("line") + 1, "position").alias("id"), "position", *QUERY_HEADERS, F.lit("PENDING").alias("status"))


def raw_export(df: DataFrame) -> DataFrame:
    """A raw export with its numbers cast (decimal commas allowed), coordinates repaired, and rows without id, link and title dropped.

    Columns that are not known stay text; a blank number is null.
    """
    if not {"place_id", "maps_url", "title"} & set(df.columns):
        raise ValueError("an export needs place_id, maps_url or title")
    for c, kind in NUMERIC.items():
        if c in df.columns:
            df = df.withColumn(c, T.number(F.col(c).cast("string"), kind))
    if {"latitude", "longitude"} <= set(df.columns):
        w = F.coalesce(F.col("latitude").between(36.0, 39.5) & F.col("longitude").between(54.5, 57.0), F.lit(False))
        lat, lon = F.when(w, F.col("longitude")).otherwise(F.col("latitude")), F.when(w, F.col("latitude")).otherwise(F.col("longitude"))
        df = df.withColumns({"latitude": lat, "longitude": lon})
    known = [T.filled(F.col(c)) for c in ("place_id", "maps_url", "title") if c in df.columns]
    return df.filter(F.coalesce(*known).isNotNull())


def read_features(spark: SparkSession, path: str, names: Sequence[str] = ("NAME", "name", "name:ru", "district")) -> DataFrame:
    """(pos, name, geojson) of a GeoJSON FeatureCollection; the name is the first of the given properties that is not blank."""
    doc = spark.read.text(path, wholetext=True)
    feature = F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("pos", "f")
    named = F.coalesce(*[T.filled(F.get_json_object("f", f"$.properties['{n}']")) for n in names])
    return doc.select(feature).select("pos", named.alias("name"), F.get_json_object("f", "$.geometry").alias("geojson"))


def features_of(features: DataFrame, names: DataFrame) -> DataFrame:
    """(name, geojson): for each known name, by lower case with ё as е, the first feature that has it and a geometry."""
    fold = lambda c: T.normalize(F.col(c)).alias("k")
    first = features.filter("name is not null and geojson is not null").groupBy(fold("name")).agg(F.min_by("geojson", "pos").alias("geojson"))
    return names.select("name", fold("name")).join(first, "k").select("name", "geojson")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(osm_id, elem_type, lat, lon, tags) of a document of mapped elements; ways at their centre."""
    schema = "array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
    doc = spark.read.text(path, wholetext=True)
    e = doc.select(F.explode(F.from_json(F.get_json_object("value", "$.elements"), schema)).alias("e"))
    return e.select(F.col("e.id").alias("osm_id"), F.col("e.type").alias("elem_type"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.col("e.tags").alias("tags"))


def attached_names(df: DataFrame, name: str, others: str) -> DataFrame:
    """(row fields, pos, one_name): the main name and the attached ones, each once."""
    return df.select("*", F.posexplode(F.array_distinct(F.concat(F.array(F.col(name)), F.coalesce(F.col(others), F.array().cast("array<string>"))))).alias("pos", "one_name"))


def script_state(html):
    """The JSON embedded in a page's ``state-view`` script."""
    return F.regexp_extract(html, r'(?s)<script[^>]*class="[^"]*state-view[^"]*"[^>]*>(.*?)</script>', 1)


def write_export(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A folder of delimited files: every cell quoted, quotes doubled, CRLF, nulls as empty cells.

    With ``single_file`` one file at ``path`` begins with a byte-order mark and an unquoted header; the
    parts are appended to it one after another, none being held in memory.
    """
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    lines = df.select(F.concat(F.concat_ws(",", *quoted), F.lit("\r")).alias("line"))
    folder = f"{path}.parts" if single_file else path
    lines.write.mode("overwrite").text(folder)
    if not single_file:
        return
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    out = fs.create(target, True)
    out.write(bytearray((BOM + ",".join(df.columns) + "\r\n").encode()))
    parts = sorted(str(x.getPath()) for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if x.getPath().getName().startswith("part-"))
    for name in parts:
        part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
        part.close()
    out.close()


def write_books(df: DataFrame, path: str, by: str) -> None:
    """One folder of files per value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).option("header", True).option("escape", '"').csv(path)


def books(df: DataFrame, by: str, common: DataFrame | None = None) -> DataFrame:
    """Rows with ``book``, 'NN name', by the sorted names of ``by``; rows of ``common`` go to every book.

    Names are those of districts, numbered in one place; more than ``MAX_QUERIES`` of them are an error.
    """
    name = F.coalesce(T.filled(F.trim(F.col(by))), F.lit("—"))
    names = df.select(name.alias("_name")).distinct()
    if names.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} books")
    numbered = names.withColumn("book", F.format_string("%02d %s", F.row_number().over(Window.orderBy("_name")), "_name"))
    out = df.withColumn("_name", name).join(numbered, "_name").drop("_name")
    if common is not None:
        out = out.unionByName(common.withColumn("_one", F.lit(1)).join(numbered.select("book", F.lit(1).alias("_one")), "_one").drop("_one"), allowMissingColumns=True)
    return out


def write_plain(df: DataFrame, path: str) -> None:
    """A folder of delimited files without the columns whose names begin with _, cells quoted only where they must be, CRLF."""
    mark = F.col
    cell = lambda c: F.coalesce(mark(f"`{c}`").cast("string"), F.lit(""))
    quoted = lambda c: F.when(cell(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell(c))
    kept = [c for c in df.columns if not c.startswith("_")]
    df.select(F.concat(F.concat_ws(",", *[quoted(c) for c in kept]), F.lit("\r")).alias("line")).write.mode("overwrite").text(path)


def read_exported(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A folder that ``write_export`` or ``write_plain`` wrote, which has no header: all columns text, empty cells null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, schema=schema, quote='"', escape='"', multiLine=True, lineSep="\r\n", emptyValue=None, nullValue="")


def with_run(df: DataFrame, status: str, total: int, completed: int, low: int, warnings: Sequence[str]) -> DataFrame:
    """Rows with what is known of the run that made them."""
    return df.withColumns(
        {
            "export_batch_status": F.lit(status),
            "export_queries_total": F.lit(total),
            "export_queries_completed": F.lit(completed),
            "export_queries_low_yield": F.lit(low),
            "export_warnings": F.lit(" | ".join(dict.fromkeys(w for w in warnings if w))),
        }
    )


def write_as(df: DataFrame, path: str, kind: str, fields: Sequence[str]) -> None:
    """A folder of files of the chosen fields, as csv or json; other kinds need a writer that is not installed."""
    if kind not in ("csv", "json"):
        raise ValueError(f"no writer for {kind}")
    rows = df.select(*fields)
    if kind == "csv":
        write_export(rows, path)
    else:
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def union_sheets(sheets: Sequence[DataFrame], required: str) -> DataFrame:
    """Sheets of one book below one another by column name; each must have ``required``, and rows blank throughout are dropped."""
    out = None
    for i, sheet in enumerate(sheets):
        rows = require_columns(sheet, [required]).filter(F.coalesce(*[T.filled(F.trim(F.col(f"`{c}`").cast("string"))) for c in sheet.columns]).isNotNull()).withColumn("sheet", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
