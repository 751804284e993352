"""Bars from CSV exports: headers under many names, cells that may not parse, one file a symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.sources.schema import SYMBOLS
from barwright.sources.shared import small_join, stored

#: Cells of a line that are read, different headers that one folder may hold, and files of which one broadcast may hold the headers.
WIDTH, HEADERS, FILES = 40, 500, 100_000
#: Header names, after normalising, that stand for another column, and the columns of a bar: fixed values of the file contract.
ALIASES = {"date": "timestamp", "datetime": "timestamp", "date_time": "timestamp", "time": "timestamp", "timestamp": "timestamp", "last": "close", "vol": "volume"}
REQUIRED = ["timestamp", "open", "high", "low", "close", "volume"]
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyyMMdd HHmmss", "yyyy-MM-dd"]


def normalised(header: list[str]) -> list[str]:
    """Column names for a header; raises where a required one is missing or two columns claim it."""
    names = [h.strip().lower().replace(" ", "_").replace("/", "_") for h in header]
    names = [ALIASES.get(n, n) for n in names]
    missing = [r for r in REQUIRED if r not in names]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    twice = sorted({n for n in names if n in REQUIRED and names.count(n) > 1})
    if twice:
        raise ValueError(f"several columns stand for: {', '.join(twice)}")
    return names


def parsed_time(text: Column) -> Column:
    """A UTC timestamp in one of the known formats, or null."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in FORMATS))


def coerced(raw: DataFrame) -> DataFrame:
    """Text columns as bars: what does not parse is null."""
    numbers = {c: F.expr(f"try_cast(trim({c}) AS DOUBLE)") for c in REQUIRED[1:]}
    return raw.withColumns({"ts": parsed_time(F.col("timestamp")), **numbers})


def cleaned(bars: DataFrame) -> DataFrame:
    """Rows with a time and all four prices; a missing volume is 0."""
    return bars.dropna(subset=["ts", "open", "high", "low", "close"]).fillna({"volume": 0.0})


def dropped_rows(bars: DataFrame) -> DataFrame:
    """symbol, dropped: how many rows cleaned() leaves out."""
    bad = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in ("ts", "open", "high", "low", "close")))
    return bars.groupBy("symbol").agg(F.count_if(bad).alias("dropped"))


def symbol_of(file_name: Column, symbols: list[str] = SYMBOLS) -> Column:
    """The first symbol that the upper-cased file name contains, else null."""
    return F.coalesce(*(F.when(F.upper(file_name).contains(s), F.lit(s)) for s in symbols))


def read_bars_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of one CSV file or of files with one header; symbol from the argument or from the file names, null if neither tells."""
    header = spark.read.option("header", False).csv(path).limit(1).collect()
    names = normalised([x or "" for x in header[0]]) if header else normalised([])
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    located = raw.select("*", F.col("_metadata.file_path").alias("__file"))
    named = located.toDF(*names, "__file")
    owner = F.lit(symbol) if symbol else symbol_of(F.element_at(F.split("__file", "/"), -1))
    seq = F.monotonically_increasing_id()
    return coerced(named).select(owner.alias("symbol"), "ts", seq.alias("seq"), "open", "high", "low", "close", "volume")


def cells_of(reader, path: str) -> DataFrame:
    """Every line of the CSV files as text cells by place (c0 ...), headers too, with the file, its time, and where its block begins; for
    batch and stream readers. Cells beyond WIDTH are left out."""
    lines = reader.schema(", ".join(f"c{i} string" for i in range(WIDTH))).option("header", False).csv(path)
    meta = {"__path": "file_path", "__file": "file_name", "__time": "file_modification_time", "__start": "file_block_start"}
    return lines.select("*", *(F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()))


def by_header(cells: DataFrame) -> DataFrame:
    """The data lines of cells_of() with the required columns by name, each file by its own header, and a seq in the order of lines.

    A file's header is its first line: all of a block's lines pass one task in order, so a partial aggregate finds it. One row a
    file is joined back (broadcast behind a count); only the different headers reach the driver. A header that lacks a
    required column is an error.
    """
    whole = F.array(*(F.coalesce(F.col(f"c{i}"), F.lit("")) for i in range(WIDTH)))
    headers = stored(cells.where("__start = 0").groupBy("__path").agg(F.first(whole).alias("__header")), "headers")
    kinds = [row[0] for row in headers.select("__header").distinct().limit(HEADERS + 1).collect()]
    if len(kinds) > HEADERS:
        raise ValueError(f"more than {HEADERS} different headers")
    places = [normalised(h) for h in kinds]
    kind = F.coalesce(*(F.when(F.col("__header") == F.array(*map(F.lit, h)), F.lit(i)) for i, h in enumerate(kinds)), F.lit(-1))
    rows = small_join(cells.withColumn("seq", F.monotonically_increasing_id()), headers.withColumn("__kind", kind), ["__path"], limit=FILES)
    pick = lambda c: F.coalesce(*(F.when(F.col("__kind") == i, F.col(f"c{names.index(c)}")) for i, names in enumerate(places)), F.lit(None).cast("string"))
    data = rows.where(~((F.col("__start") == 0) & (whole == F.col("__header"))))
    return data.select("seq", "__file", "__time", *(pick(c).alias(c) for c in REQUIRED))


def read_directory(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Clean bars of every CSV file of a directory whose name tells its symbol; files may differ in their headers.

    start and end bound the time, start inclusive. One pass finds the headers and one scan reads the bars, however many files and
    headers there are. A line that repeats its file's header is no bar.
    """
    cells = cells_of(spark.read.option("pathGlobFilter", "*.csv"), path)
    if not cells.limit(1).count():
        raise ValueError(f"no CSV file with any line in {path}")
    bars = coerced(by_header(cells)).select(symbol_of(F.col("__file")).alias("symbol"), "ts", "seq", "open", "high", "low", "close", "volume")
    bars = cleaned(bars).where("symbol is not null")
    if start:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return bars.where(F.col("ts") < F.lit(end).cast("timestamp")) if end else bars


def numbered(bars: DataFrame, by: str = "symbol", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """bars with bar_no, from 0 in the given order (time first) within each symbol, without bringing a symbol into one task.

    Rows are counted by symbol and day, the small counts are summed up, and rows are numbered within their day.
    """
    dated = bars.withColumn("__day", F.to_date(order[0]))
    days = dated.groupBy(by, "__day").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(by, "__day", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(by, "__day").orderBy(*order))
    return dated.withColumn("__row", within).join(days, [by, "__day"]).withColumn("bar_no", F.col("__before") + F.col("__row") - 1).drop("__day", "__row", "__before")
