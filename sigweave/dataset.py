"""An immutable data set: records, their channels, files and annotation tables as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .functions.query import to_sql
from .operators import catalogue, intervals, pipeline, signals


@dataclass(frozen=True)
class Dataset:
    """records (record_id, datetime), channels (record_id, channel, file, delay), files, samples and annotations by name."""

    records: DataFrame
    channels: DataFrame | None = None
    files: DataFrame | None = None
    samples: DataFrame | None = None
    annotations: dict[str, DataFrame] = field(default_factory=dict)

    def _tables(self) -> dict[str, DataFrame]:
        own = {"records": self.records, "channels": self.channels, "samples": self.samples}
        return {k: v for k, v in own.items() if v is not None} | self.annotations

    def channel_names(self) -> DataFrame:
        return self.channels.select("channel").distinct()

    def subset(self, select: str | Column | None, by: str = "records", **variables) -> "Dataset":
        """Records whose row in table by matches; every other table follows. select: query string, Column or None (all)."""
        if select is None:
            return self
        where = to_sql(select, variables) if isinstance(select, str) else select
        t = catalogue.subset(self._tables(), by, where)
        return replace(self, records=t["records"], channels=t.get("channels"), samples=t.get("samples"), annotations={n: t[n] for n in self.annotations})

    def sample(self, n: int, seed: int = 0) -> "Dataset":
        """n random records, by seed."""
        keys = self.records.select("record_id").orderBy(F.xxhash64(F.lit(seed), "record_id"), "record_id").limit(n)
        keep = lambda t: t.join(keys, "record_id", "left_semi") if t is not None else None
        return replace(self, records=keep(self.records), channels=keep(self.channels), samples=keep(self.samples), annotations={k: keep(v) for k, v in self.annotations.items()})

    def transform(self, table: str, by: Sequence[str] = (), **columns) -> "Dataset":
        """Columns added one after the other, later ones may use earlier ones.

        A column is a Spark SQL string, a Column, or a pair of a function of the row (a dict) and its SQL type. With by,
        strings are aggregates of the rows that agree in these columns.
        """
        df = self._tables()[table]
        for name, c in columns.items():
            if by and isinstance(c, str):
                df = pipeline.transform_by(df, by, **{name: c})
            elif isinstance(c, tuple):
                df = pipeline.transform_rows(df, name, *c)
            else:
                df = df.withColumn(name, F.expr(c) if isinstance(c, str) else c)
        return replace(self, **{table: df}) if table in ("records", "channels", "samples") else self.annotate(table, df, False)

    def annotate(self, name: str, annots: DataFrame, register: bool = True) -> "Dataset":
        """Registers an annotation table; duplicates of (record_id, annot_id) raise."""
        if register:
            if intervals.duplicate_annotations(annots.where("annot_id is not null")).limit(1).collect():
                raise ValueError(f"{name}: (record_id, annot_id) is not unique")
            annots = intervals.register(annots, self.records)
        return replace(self, annotations=self.annotations | {name: annots})

    def record(self, record_id: int) -> "Dataset":
        return self.subset(F.col("record_id") == record_id)

    def get_annotation(self, name: str, record_id: int | None = None, annot_id: int | None = None, flanking: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
        """One interval, the first by (record_id, annot_id), extended by flanking."""
        a = self.annotations[name]
        if annot_id is not None and record_id is None:
            raise ValueError("annot_id needs record_id")
        if record_id is not None:
            a = a.where(F.col("record_id") == record_id)
        if annot_id is not None:
            a = a.where(F.col("annot_id") == annot_id)
        return intervals.flanking(a.orderBy("record_id", "annot_id").limit(1), *flanking)

    def annotation_signals(self, name: str, record_id: int | None = None, annot_id: int | None = None, flanking: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
        """All channels cut to the interval of get_annotation: record_id, channel, i, v, with the channels' delays.

        samples need the columns channel and rate; a channel without delay begins at 0, one that has nothing there no row.
        """
        one = self.get_annotation(name, record_id, annot_id, flanking).select("record_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
        delays = self.channels.select("record_id", "channel", F.coalesce("delay", F.lit(0.0)).alias("_d"))
        j = self.samples.join(one, "record_id").join(delays, ["record_id", "channel"], "left").withColumn("_d", F.coalesce("_d", F.lit(0.0)))
        i0, i1 = (F.floor((F.col(t) - F.col("_d")) * F.col("rate")) for t in ("_s", "_e"))
        return j.where((F.col("i") >= F.greatest(F.lit(0), i0)) & (F.col("i") < i1)).select("record_id", "channel", "i", "v", F.col("_d").alias("delay"), "rate")

    def iterate(self, name: str, rate: float = 1.0, flanking: tuple[float, float] = (0.0, 0.0)) -> Iterator[Row]:
        """Annotations one after the other by (record_id, annot_id), each with its samples (an array, empty if it has none).

        They come partition by partition, so a loop over them needs memory for one partition only.
        """
        a = intervals.flanking(self.annotations[name], *flanking)
        cells = signals.annotation_samples(self.samples, a, "record_id", rate)
        g = cells.groupBy("record_id", "annot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("samples"))
        rows = a.join(g, ["record_id", "annot_id"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<double>")))
        return rows.orderBy("record_id", "annot_id").toLocalIterator()

    def intersect(self, x: str, y: str, name: str, x_cols: Sequence[str] = (), y_cols: Sequence[str] = ()) -> "Dataset":
        return self.annotate(name, intervals.intersect(self.annotations[x], self.annotations[y], "record_id", x, y, x_cols, y_cols))

    def difference(self, x: str, y: str, name: str) -> "Dataset":
        return self.annotate(name, intervals.difference(self.annotations[x], self.annotations[y], "record_id", x))

    def consolidate(self, x: str, when: str | Callable[[dict], bool], name: str, additive: Sequence[str] = ()) -> "Dataset":
        return self.annotate(name, intervals.consolidate(self.annotations[x], when, additive, "record_id"))

    def remaining(self, name: str) -> DataFrame:
        return intervals.remaining_records(self.records, self.annotations[name])
