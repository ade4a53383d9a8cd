"""A store of one-minute bars: Parquet by pair, side and month, upserted by timestamp, committed by manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.sources.files import as_json, create_text, delete, listing, read_json

BARS = "timestamp timestamp_ntz, open double, high double, low double, close double, volume double"
_TIME_NAMES = ("timestamp", "time", "datetime", "date")


def empty_bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BARS)


def normalize(frame: DataFrame) -> DataFrame:
    """The six columns in their types; a missing column or a value that is not of its type raises."""
    wanted = [c.split() for c in BARS.split(", ")]
    if missing := [name for name, _ in wanted if name not in frame.columns]:
        raise KeyError(f"missing columns: {missing}")
    return frame.select(*[F.col(name).cast(kind).alias(name) for name, kind in wanted])


def keep_newest(frame: DataFrame, keys: list[str], age: list[str]) -> DataFrame:
    """Of rows with equal keys, the one that comes last in the order of ``age``."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(a).desc() for a in age])
    return frame.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def _utc(column: str, kind: str, zone: str) -> Column:
    """The column as UTC without a zone: what states its zone is converted by that, the rest is wall time in ``zone``."""
    instant = lambda x: F.convert_timezone(F.current_timezone(), F.lit("UTC"), x.cast("timestamp").cast("timestamp_ntz"))
    naive = lambda x: F.convert_timezone(F.lit(zone), F.lit("UTC"), x.cast("timestamp_ntz"))
    if kind == "timestamp":
        return instant(F.col(column))
    if kind != "string":
        return naive(F.col(column))
    text = F.trim(column)
    return F.when(text.rlike(r"(?i)(z|utc|[+-]\d{2}(:?\d{2})?)$") & text.rlike(r"\d:\d"), instant(text)).otherwise(naive(text))


def import_bars(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """Bars of a CSV or Parquet file: any case, several names for the time, a zone for naive times, checked prices."""
    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    named = next((n for n in _TIME_NAMES if n in raw.columns), None)
    if named is None:
        raise KeyError(f"none of {_TIME_NAMES} in {raw.columns}")
    bars = raw.withColumn("timestamp", _utc(named, dict(raw.dtypes)[named], zone))
    bars = normalize(bars if "volume" in raw.columns else bars.withColumn("volume", F.lit(-1.0)))
    wrong = bars.where("high < greatest(open, close) or low > least(open, close)").limit(1).count()
    if wrong:
        raise ValueError("a high below or a low above its open or close")
    return bars


class BarStore:
    """The bars of one pair and side under ``root``/pair=/side=: a folder for each month and version, and manifests.

    The newest manifest names the current folder and row count of each month. An
    append writes the months that it touches into new folders and then a new
    manifest: readers see all of an append or nothing, also when it dies in between. A manifest has
    the number after the one that its writer read, and is created only if nobody has: of
    several writers at once, one commits, and the others put their months on top of its manifest, after
    merging those again that it has changed.
    """

    def __init__(self, spark: SparkSession, root: str, pair: str, side: str):
        self.spark, self.root = spark, f"{root}/pair={pair.upper()}/side={side.lower()}"

    def _manifests(self) -> list[str]:
        return [n for n in listing(self.spark, f"{self.root}/manifest") if n.endswith(".json")]

    def _newest(self) -> tuple[int, dict[str, dict]]:
        """Number and months of the newest manifest; (-1, none) of an empty store."""
        names = self._manifests()
        if not names:
            return -1, {}
        return int(names[-1].split(".")[0]), dict(sorted(read_json(self.spark, f"{self.root}/manifest/{names[-1]}").items()))

    def months(self) -> dict[str, dict]:
        """Month -> its folder and rows, in order."""
        return self._newest()[1]

    def _read(self, months: list[dict]) -> DataFrame:
        if not months:
            return empty_bars(self.spark)
        return self.spark.read.schema(BARS).parquet(*(f"{self.root}/{m['folder']}" for m in months))

    def read_all(self) -> DataFrame:
        return self._read(list(self.months().values()))

    def overwrite(self, bars: DataFrame) -> None:
        """The bars in the place of all that is held; later rows win over earlier ones of their time."""
        numbered = normalize(bars).withColumn("_at", F.monotonically_increasing_id())
        written = self._write(keep_newest(numbered, ["timestamp"], ["_at"]).drop("_at"))
        while not self._commit(self._newest()[0], written):
            pass  # another writer was first: once more, on top of that

    def append(self, new: DataFrame) -> int:
        """Upsert by timestamp: new rows win, later rows of one batch too. Returns how many timestamps are new."""
        new = normalize(new).withColumn("_at", F.monotonically_increasing_id())
        names = [r.month for r in new.select(F.date_format("timestamp", "yyyy-MM").alias("month")).distinct().collect()]
        read, written = {}, {}
        while True:
            number, before = self._newest()
            changed = [m for m in names if m not in written or before.get(m) != read.get(m)]
            if changed:
                held = self._read([before[m] for m in changed if m in before]).withColumn("_batch", F.lit(0)).withColumn("_at", F.lit(0).cast("long"))
                own = new.where(F.coalesce(F.date_format("timestamp", "yyyy-MM").isin(changed), F.lit(None in changed)))
                merged = keep_newest(held.unionByName(own.withColumn("_batch", F.lit(1))), ["timestamp"], ["_batch", "_at"]).drop("_batch", "_at")
                written |= self._write(merged)
                read |= {m: before.get(m) for m in changed}
            after = before | written
            if self._commit(number, after):
                return sum(m["rows"] for m in after.values()) - sum(m["rows"] for m in before.values())

    def _write(self, merged: DataFrame) -> dict[str, dict]:
        """Month -> folder and rows of bars in a new folder, which no manifest names yet."""
        version = uuid.uuid4().hex[:12]
        dated = merged.withColumn("month", F.date_format("timestamp", "yyyy-MM"))
        dated.write.partitionBy("month").parquet(f"{self.root}/data/{version}")
        written = self.spark.read.schema(BARS + ", month string").parquet(f"{self.root}/data/{version}")
        counts = {r["month"]: r["count"] for r in written.groupBy("month").count().collect()}
        return {m: {"folder": f"data/{version}/month={m}", "rows": n} for m, n in counts.items()}

    def _commit(self, read: int, months: dict[str, dict]) -> bool:
        """The manifest after number ``read``; False where another writer has made it."""
        return create_text(self.spark, f"{self.root}/manifest/{read + 1:012d}.json", as_json(months))

    def vacuum(self) -> None:
        """Remove manifests but the newest, and folders that it does not name. For when no reader holds older ones."""
        named = {m["folder"].split("/")[1] for m in self.months().values()}
        for name in self._manifests()[:-1]:
            delete(self.spark, f"{self.root}/manifest/{name}")
        for name in listing(self.spark, f"{self.root}/data"):
            if name not in named:
                delete(self.spark, f"{self.root}/data/{name}")

    def timestamp_range(self) -> tuple:
        """First and last time, from the first and the last month alone; (None, None) of an empty store."""
        months = list(self.months().values())
        return tuple(self._read(months[:1] + months[1:][-1:]).agg(F.min("timestamp"), F.max("timestamp")).first())

    def row_count(self) -> int:
        return sum(m["rows"] for m in self.months().values())


def stored_pairs(spark: SparkSession, root: str) -> list[str]:
    """Pairs under ``root`` that have both sides."""
    pairs = [n.removeprefix("pair=") for n in listing(spark, root) if n.startswith("pair=")]
    return [p for p in pairs if all(BarStore(spark, root, p, s).months() for s in ("bid", "ask"))]


def discover_pairs(store: DataFrame) -> DataFrame:
    """Pairs that have both sides, of a frame (pair, side, ...)."""
    return store.groupBy("pair").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("pair")


def common_window(bars: DataFrame, years: int = 5, full_history: bool = False) -> DataFrame:
    """One row (start, end) that every pair and side of (pair, side, ts) covers: the last start, or ``years`` before the first end."""
    edges = bars.groupBy("pair", "side").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    both = edges.groupBy("pair").agg(F.max("first").alias("first"), F.min("last").alias("last")).agg(F.max("first").alias("first"), F.min("last").alias("end"))
    start = F.col("first") if full_history else F.greatest(F.col("first"), F.col("end") - F.make_ym_interval(F.lit(years)))
    return both.select(start.alias("start"), "end")
