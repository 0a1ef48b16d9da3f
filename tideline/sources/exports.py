"""Ingest of CSV and ZIP exports, and their storage as Parquet."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import headers as H
from .scratch import materialize

_SLEEP = ["sleepPerformance", "respiratoryRate", "asleep", "inBed", "light", "deep", "rem", "awake", "sleepNeed", "sleepDebt", "sleepEfficiency", "sleepConsistency"]
_CYCLE = ["recovery", "rhr", "hrv", "skinTemp", "spo2", "strain", "calories", "maxHr", "avgHr", *_SLEEP]
SCHEMAS = {
    "cycles": "day date, start timestamp_ntz, end timestamp_ntz, sleepOnset timestamp_ntz, wakeOnset timestamp_ntz, " + ", ".join(f"{c} double" for c in _CYCLE) + ", ord long",
    "sleeps": "day date, isNap boolean, sleepOnset timestamp_ntz, wakeOnset timestamp_ntz, " + ", ".join(f"{c} double" for c in _SLEEP) + ", ord long",
    "workouts": "day date, start timestamp_ntz, end timestamp_ntz, duration double, activity string, strain double, calories double, maxHr double, avgHr double, "
    "zones array<double>, distance double, altitudeGain double, ord long",
    "journal": "day date, question string, yes boolean, notes string, ord long",
}


@dataclass(frozen=True)
class Export:
    """The four tables of an export; ``ord`` keeps the order of the file."""

    cycles: DataFrame
    sleeps: DataFrame
    workouts: DataFrame
    journal: DataFrame


def empty_export(spark: SparkSession) -> Export:
    return Export(**{kind: spark.createDataFrame([], schema) for kind, schema in SCHEMAS.items()})


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as strings; quotes are doubled and may hold line breaks, so a file is one task; rows without any value go."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False)
    present = F.greatest(*[F.length(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))) for c in raw.columns], F.lit(0), F.lit(0))
    return raw.where(present > 0)


def typed(raw: DataFrame, kind: str) -> DataFrame:
    """A raw table of strings to the schema of its kind; rows without a day (or question) go."""
    fields = H.map_headers(raw.columns)
    text = lambda f: F.col(f"`{fields[f]}`") if f in fields else F.lit(None).cast("string")
    return _typed(raw.withColumn("ord", F.monotonically_increasing_id()), kind, text)


def _typed(ordered: DataFrame, kind: str, text: Callable[[str], Column]) -> DataFrame:
    """Rows with ``ord`` to the schema of a kind; ``text`` gives a field's string."""
    at = lambda f: S.parse_timestamp(text(f))
    number = lambda f, name=None: S.parse_number(text(f)).alias(name or f)
    day = S.cycle_day(at("wakeOnset"), at("cycleStart"))
    if kind == "cycles":
        out = ordered.select(
            day.alias("day"), at("cycleStart").alias("start"), at("cycleEnd").alias("end"), at("sleepOnset").alias("sleepOnset"), at("wakeOnset").alias("wakeOnset"), *[number(c) for c in _CYCLE], "ord"
        )
    elif kind == "sleeps":
        out = ordered.select(day.alias("day"), S.parse_boolean(text("nap")).alias("isNap"), at("sleepOnset").alias("sleepOnset"), at("wakeOnset").alias("wakeOnset"), *[number(c) for c in _SLEEP], "ord")
    elif kind == "workouts":
        out = ordered.select(
            S.workout_day(at("workoutStart"), at("wakeOnset"), at("cycleStart")).alias("day"), at("workoutStart").alias("start"), at("workoutEnd").alias("end"), number("duration"),
            S.activity_name(text("activity")).alias("activity"), number("activityStrain", "strain"), number("calories"), number("maxHr"), number("avgHr"),
            F.array(*[S.parse_number(text(f"zone{z}")) for z in range(1, 6)]).alias("zones"), number("distance"), number("altitudeGain"), "ord",
        )
    else:
        question = F.trim(text("question"))
        out = ordered.select(day.alias("day"), F.when(question != "", question).alias("question"), S.parse_boolean(text("answeredYes")).alias("yes"), F.coalesce(text("notes"), F.lit("")).alias("notes"), "ord")
        out = out.where(F.col("question").isNotNull())
    return out.where(F.col("day").isNotNull())


def ingest_csv(spark: SparkSession, path: str, into: Export) -> tuple[Export, str | None]:
    """Read one CSV; its table replaces the one of its kind.  An unknown file changes nothing."""
    raw = read_raw(spark, path)
    kind = H.detect_kind(path, raw.columns)
    return (replace(into, **{kind: typed(raw, kind)}), kind) if kind else (into, None)


def ingest_text(spark: SparkSession, name: str, text: str, into: Export) -> tuple[Export, str | None]:
    """The same for a CSV that is at hand as text."""
    rows = [r for r in csv.reader(io.StringIO(text.lstrip("﻿"))) if any(v.strip() for v in r)]
    if not rows:
        return into, None
    head, body = rows[0], rows[1:]
    kind = H.detect_kind(name, head)
    if not kind:
        return into, None
    padded = [tuple((r + [None] * len(head))[: len(head)]) for r in body]
    unique = [h if head.index(h) == i else f"{h}#{i}" for i, h in enumerate(head)]
    raw = spark.createDataFrame(padded, ", ".join(f"`{h}` string" for h in unique)).coalesce(1)
    return replace(into, **{kind: typed(raw, kind)}), kind


MEMBER = "archive string, kind string, nth long, line long, fields map<string,string>"
LINES = 4096


def unpack(archives: DataFrame) -> DataFrame:
    """``MEMBER`` rows of the CSV files in the archives ``path, content``: the canonical fields of each line as strings.

    Tasks unpack and stream the members line by line, an archive being a row and
    so at most 2 GB; folders, junk, unknown files and blank lines are left out.
    """

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for nth, name in enumerate(archive.namelist()):
                        if not name.endswith("/") and name.lower().endswith(".csv") and not H.is_junk(name):
                            with archive.open(name) as member:
                                yield from _lines(path, nth, name, csv.reader(io.TextIOWrapper(member, "utf-8-sig", newline="")))

    return archives.select("path", "content").mapInPandas(run_task, MEMBER)


def _lines(path: str, nth: int, name: str, reader: Iterator[list[str]]) -> Iterator[pd.DataFrame]:
    filled = (row for row in reader if any(v.strip() for v in row))
    head = next(filled, None)
    kind = head and H.detect_kind(name, head)
    if not kind:
        return
    places = {field: head.index(header) for field, header in H.map_headers(head).items()}
    line = 0
    while rows := list(islice(filled, LINES)):
        fields = [{f: row[i] for f, i in places.items() if i < len(row)} for row in rows]
        yield pd.DataFrame({"archive": path, "kind": kind, "nth": nth, "line": range(line, line + len(rows)), "fields": fields})
        line += len(rows)


def ingest_archives(archives: DataFrame, into: Export, last_only: bool = False) -> Export:
    """The tables of all archives ``path, content``; with ``last_only`` of a kind's members in an archive the last alone.

    A kind that no member has keeps the table of ``into``.
    """
    lines = materialize(unpack(archives), "members")
    kinds = [r[0] for r in lines.select("kind").distinct().collect()]  # four at most
    if last_only:
        last = lines.groupBy(F.col("archive").alias("a"), F.col("kind").alias("k")).agg(F.max("nth").alias("n"))
        lines = lines.join(last, (F.col("archive") == F.col("a")) & (F.col("kind") == F.col("k")) & (F.col("nth") == F.col("n")), "left_semi")
    ordered = lines.withColumn("ord", F.shiftleft("nth", 40) + F.col("line"))
    return replace(into, **{kind: _typed(ordered.where(F.col("kind") == kind), kind, lambda f: F.try_element_at("fields", F.lit(f))) for kind in kinds})


def ingest_zip(spark: SparkSession, blob: bytes, into: Export) -> tuple[Export, list[str]]:
    """Every CSV of an archive that is at hand as bytes, in its order; folders and junk are left out."""
    archives = spark.createDataFrame([("archive.zip", bytearray(blob))], "path string, content binary")
    return _ingested(archives, into)


def _ingested(archives: DataFrame, into: Export) -> tuple[Export, list[str]]:
    with_kinds = unpack(archives).groupBy("nth").agg(F.first("kind").alias("kind")).orderBy("nth")
    found = [r["kind"] for r in with_kinds.collect()]  # a row for each member
    return ingest_archives(archives, into, True), found


def read_export_files(spark: SparkSession, paths: Iterable[str]) -> tuple[Export, list[str]]:
    """CSV files and ZIP archives of them, in order."""
    into, found = empty_export(spark), []
    for path in paths:
        if path.lower().endswith(".zip"):
            into, kinds = _ingested(spark.read.format("binaryFile").load(path), into)
            found += kinds
        elif path.lower().endswith(".csv") and not H.is_junk(path):
            into, kind = ingest_csv(spark, path, into)
            found += [kind] if kind else []
    return into, found


def read_archives(spark: SparkSession, path: str) -> Export:
    """The exports of all archives that a path or glob names, together: a task an archive."""
    return ingest_archives(spark.read.format("binaryFile").load(path), empty_export(spark))


def read_folder(spark: SparkSession, folder: str) -> Export | None:
    """Every CSV below a folder of any file system, in the order of the paths; None where none is recognised."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files, paths = at.getFileSystem(conf).listFiles(at, True), []
    while files.hasNext():
        paths.append(files.next().getPath().toString())
    into, found = read_export_files(spark, sorted(p for p in paths if p.lower().endswith(".csv")))
    return into if found else None


read_local = read_folder


def save_export(export: Export, path: str) -> None:
    for kind in SCHEMAS:
        getattr(export, kind).write.mode("overwrite").parquet(f"{path}/{kind}")


def load_export(spark: SparkSession, path: str) -> Export:
    return Export(**{kind: spark.read.schema(schema).parquet(f"{path}/{kind}") for kind, schema in SCHEMAS.items()})


def clear_export(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


TSV_COLUMNS = ["recovery", "hrv", "rhr", "strain", "sleepHours", "sleepEfficiency", "sleepPerformance", "sleepDebt", "rem", "deep", "light", "awake", "respiratoryRate", "skinTemp", "spo2", "workoutMinutes"]


def write_tsv(days: DataFrame, path: str) -> None:
    """Day and metrics, raw numbers, nulls empty."""
    days.select("day", *TSV_COLUMNS).write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
