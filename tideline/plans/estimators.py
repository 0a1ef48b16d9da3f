"""Queries whose results SQL can't express: sequential, iterative or linear-algebraic estimators."""

from __future__ import annotations

import csv
import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import breaks, density, layout, regression
from ..operators.days import build_days, rolling_mean
from ..sources import exports, scratch
from ..sources.anonymise import anonymise
from ..sources.bindings import daily, event_export, journal, sessions, table
from . import explorer, metrics
from .queries import r

QUERIES = {}


def query(f):
    QUERIES[f.__name__.removeprefix("q_")] = f
    return f


def _scaled(spark, sf):
    """The daily panel in moderate units with a full weekday set and a copy of one of its columns."""
    d = daily(spark, sf).select("d", (F.col("y") / 1e4).alias("y"), (F.col("x") / 1e3).alias("x"), (F.col("disc") * 100).alias("disc"), F.col("n_orders").cast("double").alias("n_orders"))
    return d.withColumn("twice", 2 * F.col("x"))


@query
def q_ols_full(spark, sf):
    d, dow = regression.weekday_dummies(_scaled(spark, sf))
    return regression.ols(d, "y", ["x", "disc", "n_orders", "twice", *dow], "hac", effects=[dow])


def _items(spark, sf):
    """Line items in moderate units with their days."""
    l = table(spark, sf, "lineitem")
    return l.select(F.to_date("l_shipdate").alias("d"), "l_returnflag", (F.col("l_extendedprice") / 1e4).alias("y"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"))


def _slopes(fit, kind):
    return fit.where("term <> 'const'").select(F.lit(kind).alias("kind"), *[c for c in ("l_returnflag",) if c in fit.columns], "term", r("coef", 8), r("se", 8), "n", "bandwidth")


@query
def q_ols_lineitems(spark, sf):
    """All line items in one fit, with either error."""
    hc1, hac = (regression.ols(_items(spark, sf), "y", ["a", "b"], kind) for kind in ("hc1", "hac"))
    return _slopes(hc1, "hc1").unionByName(_slopes(hac, "hac"))


@query
def q_ols_lineitems_keyed(spark, sf):
    """A fit for each return flag, whose rows are a third of all."""
    hc1, hac = (regression.ols(_items(spark, sf), "y", ["a", "b"], kind, keys=["l_returnflag"]) for kind in ("hc1", "hac"))
    return _slopes(hc1, "hc1").unionByName(_slopes(hac, "hac"))


@query
def q_ols_panel(spark, sf):
    """One fit for each weekday as an entity."""
    d = _scaled(spark, sf).withColumn("entity", S.weekday(F.col("d")))
    return regression.ols(d, "y", ["x", "disc"], keys=["entity"])


@query
def q_distributed_lag(spark, sf):
    return regression.distributed_lag(_scaled(spark, sf), "y", "x", 5, controls=["n_orders"])


@query
def q_delta_ratio(spark, sf):
    return regression.delta_ratio(_scaled(spark, sf), "y", ["x", "disc", "n_orders"], "disc", "n_orders", True)


@query
def q_linear_combination(spark, sf):
    return regression.linear_combination(_scaled(spark, sf), "y", ["x", "disc"], {"x": 1.0, "disc": 0.5})


@query
def q_irf(spark, sf):
    return metrics.impulse_response(_scaled(spark, sf), "y", "x", ("n_orders",), day="d")


@query
def q_adjusted_habits(spark, sf):
    return metrics.adjusted_habits(_scaled(spark, sf), journal(spark, sf), "y", ("x", "n_orders"), day="d", min_coverage=0.3)


@query
def q_elasticities(spark, sf):
    return metrics.elasticities(_scaled(spark, sf), "y", "n_orders", "x", ("disc",), day="d")


@query
def q_explorer_fit(spark, sf):
    spec = explorer.Specification("y", (explorer.Term("x", 1), explorer.Term("x", 2)), (explorer.Term("n_orders", 0),), weekday_effects=True)
    return explorer.run_specification(_scaled(spark, sf), spec, [("other", "a", 0.001), ("other", "b", 0.2)], "d")


@query
def q_changepoints(spark, sf):
    d = _scaled(spark, sf).withColumn("v", F.col("x") + F.when(F.col("d") >= F.lit("1997-01-01").cast("date"), 1.0).otherwise(0.0))
    return breaks.change_points(d, "v")


@query
def q_modality(spark, sf):
    return density.modality(_scaled(spark, sf), "x")


@query
def q_strain_distribution(spark, sf):
    return metrics.strain_distribution(_scaled(spark, sf), "x", day="d")


@query
def q_regimes(spark, sf):
    """Regimes of the four-week mean of shipments."""
    d = _scaled(spark, sf).withColumn("x28", rolling_mean(F.col("x"), 28))
    return metrics.regime_breaks(d, "x28", day="d")


@query
def q_regimes_by_entity(spark, sf):
    """Regimes of the daily order value of each priority, with a step of its own."""
    o = table(spark, sf, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("y"))
    o = o.withColumn("y", F.col("y") + F.when(F.year("d") >= F.lit(1996) + F.substring("o_orderpriority", 1, 1).cast("int") % 4, 200_000).otherwise(0))
    return metrics.regime_breaks(o, "y", day="d", keys=["o_orderpriority"])


@query
def q_anonymise(spark, sf):
    """The latest purchases as cycles, with noise and moved days."""
    return anonymise(event_export(spark, sf), ["signup", "error"]).cycles.select("day", "recovery", "strain", "asleep", "sleepOnset")


@query
def q_pack_rows(spark, sf):
    """A page for each user and day: a user's events have no bound, those of one day do."""
    items = sessions(spark, sf).select("user_id", F.col("d").alias("day"), F.col("id").alias("ord"), (F.lit(3) + F.col("id") % 3 * 3).cast("int").alias("span"), (F.col("id") % 4 != 0).alias("is_on"))
    return layout.pack_rows(items, ["user_id", "day"])


def _written(df, label):
    """A CSV folder of a table of strings, every value in quotes and quotes doubled, as exports have them."""
    path = scratch.new_path(df.sparkSession, label)
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    return path


@query
def q_csv_cycles(spark, sf):
    """Orders as a cycle file in English, written and read through Spark."""
    o = table(spark, sf, "orders")
    text = o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Cycle start time"), F.date_format(F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(7)), "M/d/yyyy h:mm:ss a").alias("Wake onset"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(" %")).alias("Recovery score %"), F.col("o_orderkey").cast("string").alias("Max HR (bpm)"), F.lit("UTC").alias("Cycle timezone"),
    )
    into, _ = exports.ingest_csv(spark, _written(text, "physiological_cycles"), exports.empty_export(spark))
    return into.cycles.select("day", "start", "wakeOnset", "recovery", "maxHr")


@query
def q_csv_journal(spark, sf):
    """Orders as a journal in Spanish, with quotes and line breaks in its notes."""
    notes = F.concat(F.lit('a "note",\nline '), F.col("o_orderkey").cast("string"))
    text = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'20:mm:ss").alias("Hora de inicio del ciclo"), F.concat(F.lit(" "), F.col("o_orderpriority")).alias("Texto de la pregunta"),
        F.when(F.col("o_orderstatus") == "F", "Sí").otherwise("no").alias('Respondió "Sí"'), notes.alias("Notas"),
    )
    into, _ = exports.ingest_csv(spark, _written(text, "diario"), exports.empty_export(spark))
    return into.journal.select("day", "question", "yes", "notes")


def _zipped(batches):
    """An archive for each batch of ``start, wake, recovery, key`` strings, with junk and an unknown file beside its cycles."""
    for n, batch in enumerate(batches):
        blob, lines = io.BytesIO(), io.StringIO()
        out = csv.writer(lines)
        out.writerow(["Cycle start time", "Wake onset", "Recovery score %", "Max HR (bpm)"])
        out.writerows(batch.itertuples(index=False))
        with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("__MACOSX/d/._physiological_cycles.csv", "junk")
            z.writestr("d/other.csv", "a,b\n1,2\n")
            z.writestr("d/physiological_cycles.csv", lines.getvalue())
        yield pd.DataFrame({"path": [f"{n}.zip"], "content": [blob.getvalue()]})


@query
def q_src_zip_csv(spark, sf):
    """Orders as archives of cycle files, made and unpacked in tasks."""
    o = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("start"), F.date_format(F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(7)), "yyyy-MM-dd HH:mm:ss").alias("wake"),
        F.col("o_custkey").cast("string").alias("recovery"), F.col("o_orderkey").cast("string").alias("key"),
    )
    archives = o.mapInPandas(_zipped, "path string, content binary")
    return exports.ingest_archives(archives, exports.empty_export(spark)).cycles.select("day", "start", "wakeOnset", "recovery", "maxHr")


@query
def q_tsv(spark, sf):
    """The events' day panel through the TSV sink and back."""
    path = scratch.new_path(spark, "tsv")
    exports.write_tsv(build_days(event_export(spark, sf), ["user_id"]), path)
    return spark.read.option("sep", "\t").option("header", True).csv(path)


@query
def q_csv_workouts(spark, sf):
    """Events as a workout file, written and read through Spark."""
    e = sessions(spark, sf)
    text = e.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Cycle start time"), F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(1)), "yyyy-MM-dd HH:mm:ss").alias("Workout start time"), (F.col("id") % 90).cast("string").alias("Duration (min)"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit(" "), F.col("activity"))).otherwise("").alias("Activity name"), F.col("id").cast("string").alias("Max HR (bpm)"), F.lit("40").alias("HR Zone 1 %"), F.lit("n/a").alias("HR Zone 2 %"),
    )
    into, _ = exports.ingest_csv(spark, _written(text, "workouts"), exports.empty_export(spark))
    return into.workouts.select("day", "start", "duration", "activity", "maxHr", F.get("zones", F.lit(0)).alias("zone1"), F.get("zones", F.lit(1)).alias("zone2"))


@query
def q_csv_sleeps(spark, sf):
    """Events as a file of nights and naps."""
    e = sessions(spark, sf)
    text = e.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Cycle start time"), F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(8)), "yyyy-MM-dd HH:mm:ss").alias("Wake onset"), F.concat(F.col("id").cast("string"), F.lit(" min")).alias("Asleep duration (min)"),
        F.when(F.col("id") % 3 == 0, "TRUE").otherwise("false").alias("Nap"),
    )
    into, _ = exports.ingest_csv(spark, _written(text, "sleeps"), exports.empty_export(spark))
    return into.sleeps.select("day", "wakeOnset", "asleep", "isNap")


@query
def q_tree_qr(spark, sf):
    """The triangle of all line items' columns by a tree of local factorisations, made positive on its diagonal."""
    l = table(spark, sf, "lineitem").select(F.lit(1.0).alias("one"), F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1e4).alias("b"), (F.col("l_discount") * 100).alias("c"))
    t = regression.qr_of_partitions(l, ["one", "a", "b", "c"])
    t = t * np.where(np.diag(t) < 0, -1.0, 1.0)[:, None]
    rows = [(i + 1, j + 1, float(t[i, j])) for i in range(4) for j in range(i, 4)]
    return spark.createDataFrame(rows, "i long, j long, v double").select("i", "j", r("v", 4))


