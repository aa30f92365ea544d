"""A stored table of bars by year, kept up to date by appends that touch the last years alone.

Under ``root``: ``data/<version>/year=…`` has the rows of the years that a version wrote, ``tails/<version>`` each symbol's last times, and
``versions/v=…`` the list of the years' folders; the list is written last, so a version exists whole or not at all, and folders once
written are never changed. A run that fails, or is repeated, leaves the versions before it as they were.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAIL = 200  # times that are kept of each symbol: what cleaning borrows at most


@dataclass(frozen=True)
class Version:
    """One version of a stored table: its number, the folder of each year, and that of the symbols' last times."""

    number: int
    years: dict[int, str]
    tails: str


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def latest(spark: SparkSession, root: str) -> Version | None:
    """The last complete version; none if nothing is stored."""
    if not _there(spark, f"{root}/versions"):
        return None
    listed = spark.read.schema("year int, path string, tails string, v int").parquet(f"{root}/versions")
    last = listed.agg(F.max("v")).first()[0]
    if last is None:
        return None
    rows = listed.where(F.col("v") == last).collect()  # one for each year
    return Version(last, {r["year"]: r["path"] for r in rows if r["year"] is not None}, rows[0]["tails"])


def read(spark: SparkSession, version: Version, schema: str, since: int | None = None) -> DataFrame:
    """The rows of a version, from the year ``since`` on; folders of other years are not opened."""
    paths = [p for y, p in sorted(version.years.items()) if since is None or y >= since]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def tails(spark: SparkSession, version: Version) -> DataFrame:
    """``(symbol, times)``: each symbol's last times in order, at most ``TAIL``."""
    return spark.read.schema("symbol string, times array<timestamp>").parquet(version.tails)


def _last(times: Column, n: int) -> Column:
    """The n-th last of an array of times; null if there are fewer."""
    return F.try_element_at(times, F.lit(-n))


def append(spark: SparkSession, root: str, new: DataFrame, overwrite_last: int = 2) -> Version:
    """Stores ``new`` bars as the next version: of its symbols the last ``overwrite_last`` stored rows go, as far as ``new`` begins before them, and what
    is later than the kept rows comes.

    Symbols that ``new`` does not name stay as they are; of equal (symbol, ts) in ``new`` any one row counts. Only years that lose or gain a row are
    read and written again; the others' folders are listed as before. What is gathered on the driver is a year each.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in new.dtypes)
    before = latest(spark, root)
    number, folder = (before.number + 1 if before else 0), f"{root}/data/{uuid4().hex}"
    old = tails(spark, before) if before else spark.createDataFrame([], "symbol string, times array<timestamp>")
    landed = f"{root}/landed/{uuid4().hex}"  # the new rows are looked at three times
    new.dropDuplicates(["symbol", "ts"]).write.parquet(landed)
    new = spark.read.schema(schema).parquet(landed)
    named = new.groupBy("symbol").agg(F.min("ts").alias("first"))
    gone = F.filter(F.slice("times", F.greatest(F.size("times") - overwrite_last, F.lit(0)) + 1, overwrite_last), lambda t: t >= F.col("first"))
    edges = old.join(named, "symbol").select("symbol", F.slice("times", 1, F.size("times") - F.size(gone)).alias("kept"), gone.alias("gone"))
    edges = edges.withColumn("upto", F.try_element_at("kept", F.lit(-1)))
    later = new.join(edges.select("symbol", "upto"), "symbol", "left").where("upto is null or ts > upto").drop("upto")
    touched = {r[0] for r in later.select(F.year("ts")).union(edges.select(F.explode("gone").alias("ts")).select(F.year("ts"))).distinct().collect()}
    stored = {y: p for y, p in (before.years if before else {}).items() if y in touched}
    gone = edges.select("symbol", F.explode("gone").alias("ts"))
    rest = spark.read.schema(schema).parquet(*stored.values()).join(gone, ["symbol", "ts"], "left_anti") if stored else None
    rows = later.select(*new.columns) if rest is None else rest.select(*new.columns).unionByName(later.select(*new.columns))
    dealt = rows.withColumn("year", F.year("ts")).repartition("year", F.pmod(F.xxhash64("symbol"), F.lit(32))).sortWithinPartitions("year", "symbol", "ts")
    dealt.write.partitionBy("year").parquet(folder)

    added = later.groupBy("symbol").agg(F.sort_array(F.collect_list("ts")).alias("added"))  # a run's new times
    grown = edges.select("symbol", "kept").join(added, "symbol", "full")
    both = F.concat(*(F.coalesce(c, F.array().cast("array<timestamp>")) for c in ("kept", "added")))
    grown = grown.select("symbol", both.alias("times")).select("symbol", F.slice("times", F.greatest(F.size("times") - TAIL, F.lit(0)) + 1, TAIL).alias("times"))
    own = f"{root}/tails/{uuid4().hex}"
    old.join(named, "symbol", "left_anti").unionByName(grown).write.parquet(own)

    written = {y for y in touched if _there(spark, f"{folder}/year={y}")}
    years = {y: p for y, p in (before.years if before else {}).items() if y not in touched} | {y: f"{folder}/year={y}" for y in written}
    listed = [(y, p, own) for y, p in sorted(years.items())] or [(None, None, own)]
    spark.createDataFrame(listed, "year int, path string, tails string").coalesce(1).write.parquet(f"{root}/versions/v={number}")
    return Version(number, years, own)


def lent(spark: SparkSession, version: Version, symbols: DataFrame, schema: str, rows: int = TAIL) -> DataFrame:
    """The last ``rows`` stored rows of ``symbols``, from the years that hold them alone."""
    wanted = tails(spark, version).join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("symbol", F.coalesce(_last(F.col("times"), rows), F.try_element_at("times", F.lit(1))).alias("from_"))
    since = wanted.agg(F.min(F.year("from_"))).first()[0]
    own = read(spark, version, schema, since if since is not None else 9999)
    return own.join(wanted, "symbol").where("ts >= from_").drop("from_").select(*own.columns)


def changed(spark: SparkSession, before: Version, after: Version, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of two versions in the years whose folders differ: what an audit has to compare."""
    differ = {y for y in {*before.years, *after.years} if before.years.get(y) != after.years.get(y)}
    sides = [Version(v.number, {y: p for y, p in v.years.items() if y in differ}, v.tails) for v in (before, after)]
    return read(spark, sides[0], schema), read(spark, sides[1], schema)
