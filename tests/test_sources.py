"""Headers, parsing, ingest of CSV and ZIP, storage, the day model and the anonymiser."""

from __future__ import annotations

import csv
import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.operators.days import bedtime_variability, build_days
from tideline.plans import extras, metrics
from tideline.sources import anonymise, demo, exports
from tideline.sources import headers as H


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2026-03-02 07:05:09", dt.datetime(2026, 3, 2, 7, 5, 9)), ("2026-03-02T07:05:09Z", dt.datetime(2026, 3, 2, 7, 5, 9)), (" 2026-03-02 7:05 ", dt.datetime(2026, 3, 2, 7, 5)),
        ("3/2/2026 1:05 PM", dt.datetime(2026, 3, 2, 13, 5)), ("3/2/2026 12:05:01 AM", dt.datetime(2026, 3, 2, 0, 5, 1)), ("3/2/2026 12:05 PM", dt.datetime(2026, 3, 2, 12, 5)),
        ("2026-03-02", dt.datetime(2026, 3, 2)), ("2024-02-30 10:00", dt.datetime(2024, 3, 1, 10)), ("2026-13-08 25:61", dt.datetime(2027, 1, 9, 2, 1)), ("2023-02-29", dt.datetime(2023, 3, 1)), ("3/2/2026, ,1:05pm", dt.datetime(2026, 3, 2, 13, 5)),
        ("March 5, 2024 10:00", dt.datetime(2024, 3, 5, 10)), ("Tue Mar 05 2024 10:00:30", dt.datetime(2024, 3, 5, 10, 0, 30)), ("5 sept. 2024", dt.datetime(2024, 9, 5)), ("2024/3/5 7:08", dt.datetime(2024, 3, 5, 7, 8)), ("\u00a03/5/2024\n", dt.datetime(2024, 3, 5)), ("May 45, 2024", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_timestamps(spark, raw, want):
    assert one(spark, S.parse_timestamp(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [("12.5", 12.5), ("12,5", 125.0), (" 7 % ", 7.0), ("-", None), ("n/a", None), ("", None), (None, None), ("abc", 0.0), ("1-2", None), ("-3", -3.0), ("na", None), ("NA", None), ("N/a", None), ("9" * 400, None), (" .5", 0.5)])
def test_numbers(spark, raw, want):
    assert one(spark, S.parse_number(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [("Sí", True), ("si", True), (" YES", True), ("1", True), ("no", False), (None, False)])
def test_booleans(spark, raw, want):
    assert one(spark, S.parse_boolean(F.lit(raw).cast("string"))) is want


def test_evening_starts_belong_to_the_next_day(spark):
    at = lambda s: S.parse_timestamp(F.lit(s))
    none = F.lit(None).cast("timestamp_ntz")
    assert one(spark, S.cycle_day(none, at("2026-03-01 18:00"))) == dt.date(2026, 3, 2)
    assert one(spark, S.cycle_day(none, at("2026-03-01 17:59"))) == dt.date(2026, 3, 1)
    assert one(spark, S.cycle_day(at("2026-03-05 06:00"), at("2026-03-01 18:00"))) == dt.date(2026, 3, 5)


def test_headers():
    assert H.normalize_header('Respondió "Sí"') == "respondiosi"
    m = H.map_headers(["Asleep duration (min)", "Duration (min)", "Deep (SWS) duration (min)", "Activity Strain", "Day Strain"])
    assert m == {"asleep": "Asleep duration (min)", "duration": "Duration (min)", "deep": "Deep (SWS) duration (min)", "activityStrain": "Activity Strain", "strain": "Day Strain"}
    assert H.detect_kind("x.csv", ["Pregunta", "Texto de la pregunta"]) == "journal"
    assert H.detect_kind("sueño.csv", ["a"]) == "sleeps"
    assert H.detect_kind("x.csv", ["a", "b"]) is None
    assert H.is_junk("__MACOSX/a.csv") and H.is_junk("d/._a.csv") and not H.is_junk("a.csv")
    for pack in H.HEADERS.values():
        assert set(pack) == set(H.FIELD_ORDER)


# The header lines of the export format, with rows of our own.
_CYCLES = """Cycle start time,Cycle end time,Cycle timezone,Recovery score %,Resting heart rate (bpm),Heart rate variability (ms),Day Strain,Sleep onset,Wake onset,Asleep duration (min),REM duration (min)
2026-03-01 23:10:00,2026-03-02 23:00:00,UTC+01:00,71,50,80,12.4,2026-03-01 23:10:00,2026-03-02 07:00:00,432,90
2026-03-02 23:00:00,2026-03-03 22:50:00,UTC+01:00,48,55,61,9.1,2026-03-02 23:00:00,2026-03-03 06:30:00,400,80
"""
_SLEEPS = """Cycle start time,Sleep onset,Wake onset,Sleep performance %,Asleep duration (min),Nap
2026-03-02 23:00:00,2026-03-03 14:00:00,2026-03-03 14:40:00,,35,true
2026-03-03 23:00:00,2026-03-03 23:05:00,2026-03-04 06:30:00,88,410,false
"""
_WORKOUTS = """Cycle start time,Workout start time,Duration (min),Activity name,Activity Strain,HR Zone 1 %,HR Zone 2 %
2026-03-01 23:10:00,2026-03-02 18:00:00,85,Tennis,11.2,40,60
"""
_JOURNAL = '''Cycle start time,Texto de la pregunta,"Respondió ""Sí""",Notas
2026-03-01 23:10:00,¿Alcohol?,false,
2026-03-02 23:00:00,¿Alcohol?,true,"late, two glasses"
'''


def inline_export(spark):
    into = exports.empty_export(spark)
    for name, text in (("physiological_cycles.csv", _CYCLES), ("sleeps.csv", _SLEEPS), ("workouts.csv", _WORKOUTS), ("journal_entries.csv", _JOURNAL)):
        into, _ = exports.ingest_text(spark, name, text, into)
    return into


def test_inline_tables(spark):
    into = inline_export(spark)
    assert [(str(r["day"]), r["recovery"], r["rhr"], r["hrv"], r["strain"], r["asleep"], r["rem"], str(r["wakeOnset"])) for r in into.cycles.orderBy("day").collect()] == [
        ("2026-03-02", 71, 50, 80, 12.4, 432, 90, "2026-03-02 07:00:00"), ("2026-03-03", 48, 55, 61, 9.1, 400, 80, "2026-03-03 06:30:00"),
    ]
    assert [(str(r["day"]), r["isNap"], r["asleep"], r["sleepPerformance"]) for r in into.sleeps.orderBy("day").collect()] == [("2026-03-03", True, 35, None), ("2026-03-04", False, 410, 88)]
    assert [(str(r["day"]), r["activity"], r["duration"], r["strain"], r["zones"][:3]) for r in into.workouts.collect()] == [("2026-03-02", "Tennis", 85, 11.2, [40, 60, None])]
    assert [(str(r["day"]), r["question"], r["yes"], r["notes"]) for r in into.journal.orderBy("day").collect()] == [("2026-03-02", "¿Alcohol?", False, ""), ("2026-03-03", "¿Alcohol?", True, "late, two glasses")]


def test_inline_headers():
    for name, text, kind, fields in (
        ("physiological_cycles.csv", _CYCLES, "cycles", {"cycleStart", "cycleEnd", "recovery", "rhr", "hrv", "strain", "sleepOnset", "wakeOnset", "asleep", "rem"}),
        ("sleeps.csv", _SLEEPS, "sleeps", {"cycleStart", "sleepOnset", "wakeOnset", "sleepPerformance", "asleep", "nap"}),
        ("workouts.csv", _WORKOUTS, "workouts", {"cycleStart", "workoutStart", "duration", "activity", "activityStrain", "zone1", "zone2"}),
        ("journal_entries.csv", _JOURNAL, "journal", {"cycleStart", "question", "answeredYes", "notes"}),
    ):
        heads = next(csv.reader([text.split("\n", 1)[0]]))
        assert H.detect_kind(name, heads) == kind and set(H.map_headers(heads)) == fields


def test_inline_days(spark):
    d = build_days(inline_export(spark)).withColumn("answers", F.map_values("journal")).orderBy("day").collect()
    assert d[0]["day"] == dt.date(2026, 3, 2) and d[0]["recovery"] == 71 and d[0]["sleepHours"] == 7.2 and d[0]["workoutMinutes"] == 85 and d[0]["recoveryNext"] == 48 and d[0]["answers"] == [False]
    assert d[1]["strainPrev"] == 12.4 and d[1]["answers"] == [True] and d[1]["napMinutes"] == 35 and d[1]["workoutCount"] == 0
    assert d[2]["recovery"] is None and d[2]["asleep"] == 410


def test_zip_csv_and_storage(spark, tmp_path):
    path = tmp_path / "export.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("data/physiological_cycles.csv", _CYCLES)
        z.writestr("data/journal_entries.csv", _JOURNAL)
        z.writestr("__MACOSX/data/._physiological_cycles.csv", "junk")
        z.writestr("data/unknown.csv", "a,b\n1,2\n")
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "workouts.csv").write_text(_WORKOUTS + ",,,,,,\n")
    export, found = exports.read_export_files(spark, [str(path), str(tmp_path / "csv" / "workouts.csv")])
    assert found == ["cycles", "journal", "workouts"]
    assert (export.cycles.count(), export.sleeps.count(), export.workouts.count(), export.journal.count()) == (2, 0, 1, 2)
    assert export.journal.orderBy("day").collect()[1]["notes"] == "late, two glasses"
    exports.save_export(export, f"file://{tmp_path}/kept")
    assert build_days(exports.load_export(spark, f"file://{tmp_path}/kept")).count() == 2
    exports.clear_export(spark, f"file://{tmp_path}/kept")
    assert not (tmp_path / "kept").exists()
    assert exports.read_local(spark, str(tmp_path / "csv")).workouts.count() == 1
    (tmp_path / "none").mkdir()
    assert exports.read_local(spark, str(tmp_path / "none")) is None


def test_last_duplicate_wins_with_its_nulls(spark):
    head, first, _ = _CYCLES.strip().split("\n")
    again = first.replace(",71,", ",,")
    export, _ = exports.ingest_text(spark, "cycles.csv", "\n".join([head, first, again]), exports.empty_export(spark))
    row = build_days(export).first()
    assert row["recovery"] is None and row["hrv"] == 80


def test_tsv(spark, tmp_path):
    exports.write_tsv(build_days(demo.demo_export(spark, 10)), f"file://{tmp_path}/t")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*"))).splitlines()
    assert lines[0].startswith("day\trecovery\thrv") and len({x.count("\t") for x in lines}) == 1


def test_demo_is_fixed_and_its_panel_contiguous(spark):
    one, two = (sorted(map(str, demo.demo_export(spark, 30).cycles.repartition(n).collect())) for n in (1, 3))
    assert one == two
    d = build_days(demo.demo_export(spark, 60)).orderBy("day").collect()
    assert len(d) == 60 and all((b["day"] - a["day"]).days == 1 for a, b in zip(d, d[1:], strict=False))
    assert all(a["recoveryNext"] == b["recovery"] for a, b in zip(d, d[1:], strict=False))
    assert d[40]["strain28"] is not None and d[40]["acwr"] is not None


def test_demo_effects_are_recovered(spark):
    """What the generator plants, the composite metrics find with their default columns."""
    export = demo.demo_export(spark, 720)
    days = build_days(export)
    habits = {r["question"]: r for r in metrics.adjusted_habits(days, export.journal).where("kind = 'habit'").collect()}
    planted = demo.EFFECTS["recovery"]
    for question, name in demo.QUESTIONS.items():
        r = habits[question]
        assert r["ok"] and r["ci_low"] - 0.5 < planted.get(name, 0.0) < r["ci_high"] + 0.5
    assert habits["Drink any alcohol?"]["q"] < 0.01 and habits["Read before sleep?"]["q"] > 0.01
    found = {r["term"]: r for r in metrics.elasticities(days).collect()}
    assert found["strainPrev"]["ci_low"] - 0.2 < planted["strainPrev"] < found["strainPrev"]["ci_high"] + 0.2
    assert found["bedtimeHours"]["p"] is not None and found["substitution"]["ok"]
    wave = metrics.rhythms(days, ["hrv"]).first()
    assert abs(wave["period"] - demo.WAVE_DAYS) < 1 and wave["q"] < 0.01
    shift = metrics.regime_breaks(days, "rhr").orderBy("d").collect()
    first = days.agg(F.min("day")).first()[0]
    assert any(abs((s["d"] - first).days - demo.SHIFT_AT * 720) < 15 for s in shift if s["d"])
    nights = days.select("day", "bedtime", "wakeAdjusted")
    assert -100 <= extras.regularity_index(nights).first()["sri"] <= 100 and extras.social_jet_lag(nights).first()["lag_minutes"] > 20
    spread = bedtime_variability(days).first()
    assert spread["n"] == 720 and 30 < spread["sd"] < 90


def test_every_field_is_anonymised(spark):
    """No field of the anonymised export keeps its source's values, but for some that round back."""
    source = demo.demo_export(spark, 90)
    main = source.cycles.select([F.lit(False).alias(c) if c == "isNap" else (F.col(c) + 1000).alias(c) if c == "ord" else F.col(c) for c in source.sleeps.columns])
    source = exports.Export(source.cycles, source.sleeps.unionByName(main), source.workouts, source.journal)
    out = anonymise.anonymise(source, ["alcohol", "breathe"], 60)
    for table in ("cycles", "sleeps", "workouts"):
        a, b = ({r["ord"]: r for r in getattr(x, table).where("ord is not null").collect()} for x in (source, out))
        assert b
        for field in set(exports._CYCLE) | {"duration", "distance", "altitudeGain"} | set(anonymise.SLEEP_BLOCK) | {"zones", "start", "end", "sleepOnset", "wakeOnset"}:
            pairs = [(a[k][field], b[k][field]) for k in b if field in getattr(source, table).columns and a[k][field] not in (None, 0.0)]
            assert sum(x == y for x, y in pairs) <= 0.25 * len(pairs) + 1, (table, field)
        assert all((b[k]["day"] - a[k]["day"]).days % 7 == 0 for k in b)
    both = out.sleeps.where("not isNap").select("day", F.col("asleep").alias("x")).join(out.cycles.select("day", F.col("asleep").alias("y")), "day").collect()
    assert len(both) == 60 and all(r["x"] == r["y"] for r in both)
    total = out.cycles.select((F.col("light") + F.col("deep") + F.col("rem")).alias("a"), "asleep").collect()
    assert all(abs(r["a"] - r["asleep"]) < 0.01 for r in total)
    assert {r["notes"] for r in out.journal.collect()} == {""}


def test_decimals_follow_the_source(spark):
    df = spark.createDataFrame([(1.23456, 71.0), (1.23456, 71.5), (1.23456, 0.25), (-1.5, 3.0), (12345.678, 1.125)], "v double, source double")
    assert [r[0] for r in df.coalesce(1).select(anonymise.rounded_like(F.col("v"), F.col("source"))).collect()] == [1.0, 1.2, 1.23, -1.0, 12345.678]


def test_local_times_have_no_zone(spark):
    """An hour that daylight saving leaves out is a time like any other."""
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for raw in ("2026-03-08 02:30:00", "3/8/2026 2:30 AM"):
            assert one(spark, S.parse_timestamp(F.lit(raw)).cast("string")) == "2026-03-08 02:30:00"
        assert one(spark, S.parse_timestamp(F.lit("2026-02-36 02:30")).cast("string")) == "2026-03-08 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_anonymise_is_keyed_and_keeps_days(spark):
    source = demo.demo_export(spark, 80)
    a, b = (anonymise.anonymise(x, ["alcohol"]) for x in (source, exports.Export(source.cycles.repartition(5), source.sleeps, source.workouts, source.journal)))
    rows = lambda e: sorted((str(r["day"]), r["recovery"], r["hrv"]) for r in e.cycles.collect())
    assert rows(a) == rows(b) and len(rows(a)) == 60
    assert {r["question"] for r in a.journal.collect()} == {"Drink any alcohol?"}
    shifted = a.cycles.agg(F.min("day")).first()[0]
    assert abs((shifted - anonymise.TARGET).days) <= 3
    assert a.workouts.join(a.cycles.select("day").distinct(), "day", "left_anti").count() == 0
