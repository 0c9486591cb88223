"""Q1, Q2, M1, M2: free SQL, rows as JSON records, catalog inventory, column profile."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_sql(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """Q1: any Spark SQL text. Values go in as named parameters (``:name``), never pasted."""
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def as_records(df: DataFrame) -> DataFrame:
    """Q2: one JSON object per row in column ``record`` (nested values kept nested, NULLs as null).

    Duplicate column names would make keys collide, so they are rejected.
    """
    dup = [c for c, n in Counter(df.columns).items() if n > 1]
    if dup:
        raise ValueError(f"duplicate column names cannot become JSON keys: {dup}")
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("record"))


def describe_table(spark: SparkSession, name: str) -> str:
    """Schema of a table as JSON text (driver-side metadata only)."""
    return spark.table(name).schema.json()


#: Tables that one counting job takes on, so that no plan grows with the catalog.
TABLES_PER_JOB = 64


def _quoted(*names: str) -> str:
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)


#: Providers whose file footers hold row counts, and the switch that lets a scan take them from there.
FOOTER_COUNTS = {"parquet": "spark.sql.parquet.aggregatePushdown", "orc": "spark.sql.orc.aggregatePushdown"}


@contextmanager
def _aggregates_pushed(spark: SparkSession) -> Iterator[None]:
    """Files are read by the sources that take aggregates, for as long as this lasts."""
    sources = "spark.sql.sources.useV1SourceList"
    kept = {k: spark.conf.get(k) for k in (sources, *FOOTER_COUNTS.values())}
    try:
        spark.conf.set(sources, ",".join(x for x in kept[sources].split(",") if x not in FOOTER_COUNTS))
        for switch in FOOTER_COUNTS.values():
            spark.conf.set(switch, "true")
        yield
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def _stored_at(spark: SparkSession, name: str) -> tuple[str, str] | None:
    """``(provider, location)`` of a table whose files are all its rows; None for views, partitioned
    tables (a folder may hold more than the catalog's partitions) and other providers."""
    rows = [(r["col_name"], r["data_type"]) for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()]
    told = dict(rows)
    provider = (told.get("Provider") or "").lower()
    if provider not in FOOTER_COUNTS or "# Partition Information" in told or not told.get("Location"):
        return None
    return provider, told["Location"]


def row_count(spark: SparkSession, name: str) -> DataFrame:
    """``n_rows`` of a table: from its files' footers where the provider has them, by a scan that reads
    no column otherwise; NULL if there is no file. Plan and run it within ``_aggregates_pushed``."""
    stored = _stored_at(spark, name)
    rows = spark.table(name)
    if stored is not None:
        try:
            rows = spark.read.format(stored[0]).schema(rows.schema).load(stored[1])
        except PySparkException:  # nothing there, or not readable as files
            pass
    return rows.agg(F.count(F.lit(1)).alias("n_rows"))


def catalog_inventory(spark: SparkSession, dbs: list[str] | None = None) -> DataFrame:
    """M1: ``database, table, n_columns, n_rows`` for every catalog table (temp views skipped).

    Listing is catalog metadata on the driver. Tables are counted ``TABLES_PER_JOB`` at a
    time, from file footers where the provider has them (``row_count``). Only the counts come
    back to the driver, one row per table, like the listing.
    """
    cat = spark.catalog
    databases = dbs if dbs is not None else [d.name for d in cat.listDatabases()]
    meta = []
    for db in databases:
        for t in cat.listTables(_quoted(db)):
            if not t.isTemporary:
                meta.append((db, t.name, len(spark.table(_quoted(db, t.name)).columns)))
    counted = []
    with _aggregates_pushed(spark):
        for lo in range(0, len(meta), TABLES_PER_JOB):
            part = meta[lo : lo + TABLES_PER_JOB]
            counts = [row_count(spark, _quoted(db, name)).select(F.lit(i).alias("i"), "n_rows") for i, (db, name, _) in enumerate(part)]
            # a count that no file adds to comes back as None
            counted += [(*part[r["i"]], r["n_rows"] or 0) for r in reduce(DataFrame.unionByName, counts).collect()]
    return spark.createDataFrame(counted, "database string, table string, n_columns int, n_rows long")


#: Strings and binaries longer than this many bytes are told apart by their SHA-256.
LONG_BYTES = 32
#: Values of one bitmap, and how many bytes a value may cost in it before plain values are fewer.
BITMAP_VALUES, BITMAP_COST = 32_768, 12


def _whole(f: T.StructField) -> Column | None:
    """A column as a bigint that is equal where the values are, or None if its type has none."""
    c, kind = F.col(f"`{f.name}`"), f.dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (c.cast("decimal(38,18)") * F.lit(10**kind.scale).cast("decimal(20,0)")).cast("bigint")
    return None


def _bytes(f: T.StructField) -> Column:
    """A column as bytes that are equal where the values are, at most LONG_BYTES + 1 of them."""
    c = F.col(f"`{f.name}`")
    raw = c if isinstance(f.dataType, T.BinaryType) else c.cast("string").cast("binary")
    digest = F.concat(F.lit(b"\x01"), F.unhex(F.sha2(raw, 256)))
    return F.when(F.octet_length(raw) <= LONG_BYTES, F.concat(F.lit(b"\x00"), raw)).otherwise(digest)


def _pairs(df: DataFrame, values: dict[int, Column]) -> DataFrame:
    """``i, value`` of every value that isn't NULL of the columns numbered ``i``."""
    cells = F.array(*[F.struct(F.lit(i).cast("smallint").alias("i"), v.alias("value")) for i, v in values.items()])
    return df.select(F.inline(cells)).where("value is not null")


def distinct_counts(df: DataFrame, ranges: dict[int, tuple[int, int, int]]) -> DataFrame:
    """``i, n_distinct`` of each column by number, exact; a column of NULLs has no row.

    Values move by their types, each distinct one once for each task that has it: numbers, dates and times as
    bigints, floating point numbers as doubles, all else as at most 33 bytes. ``ranges`` has
    ``(least, greatest, about how many distinct)`` of the columns that are whole numbers: dense ones move as bitmaps.
    """
    whole, dense, real, other = {}, {}, {}, {}
    for i, f in enumerate(df.schema.fields):
        value = _whole(f)
        if value is not None and i in ranges:
            low, high, about = ranges[i]
            (dense if ((high - low) / BITMAP_VALUES + 2) * BITMAP_VALUES / 8 < about * BITMAP_COST else whole)[i] = value
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            real[i] = F.col(f"`{f.name}`").cast("double")
        elif value is None:
            other[i] = _bytes(f)
    out = [_pairs(df, part).distinct().groupBy("i").agg(F.count("value").alias("n_distinct")) for part in (whole, real, other) if part]
    if dense:
        bits = _pairs(df, dense).groupBy("i", F.bitmap_bucket_number("value").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("value")).alias("bits"))
        out.append(bits.groupBy("i").agg(F.sum(F.bitmap_count("bits")).alias("n_distinct")))
    return reduce(DataFrame.unionByName, out) if out else df.sparkSession.createDataFrame([], "i smallint, n_distinct bigint")


def schema_profile(df: DataFrame, exact: bool = True, rsd: float = 0.05) -> DataFrame:
    """M2: ``column, type, nullable, n_rows, n_null, n_distinct`` per column.

    One aggregate gives rows, NULLs and, of whole numbers, the range: a row on the driver. ``exact=True`` then counts
    distinct values by type (``distinct_counts``); -0.0 counts as 0.0 and NaN as one value. ``exact=False``: the same
    aggregate with ``approx_count_distinct`` per column (HLL++, relative std. dev. ``rsd``) alone, for
    very wide or very large tables. An empty table gives a row per column in both modes.
    """
    fields, aggs = df.schema.fields, [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        c, value = F.col(f"`{f.name}`"), _whole(f)
        aggs.append(F.count_if(c.isNull()).alias(f"null{i}"))
        if not exact:
            aggs.append(F.approx_count_distinct(c, rsd).alias(f"about{i}"))
        elif value is not None:
            aggs += [F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}"), F.approx_count_distinct(value, 0.2).alias(f"about{i}")]
    told = df.agg(*aggs).first().asDict()
    ranges = {i: (told[f"low{i}"], told[f"high{i}"], told[f"about{i}"]) for i in range(len(fields)) if told.get(f"low{i}") is not None}
    columns = [(i, f.name, f.dataType.simpleString(), f.nullable, told["n"], told[f"null{i}"], told.get(f"about{i}")) for i, f in enumerate(fields)]
    spark = df.sparkSession
    base = spark.createDataFrame(columns, "i smallint, column string, type string, nullable boolean, n_rows bigint, n_null bigint, about bigint")
    if not exact:
        return base.drop("i").withColumnRenamed("about", "n_distinct")
    found = base.drop("about").join(distinct_counts(df, ranges), "i", "left")
    return found.select("column", "type", "nullable", "n_rows", "n_null", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"))
