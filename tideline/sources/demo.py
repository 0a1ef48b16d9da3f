"""A synthetic export with planted effects, for demonstrations and planted-answer tests.

Every value is a function of the seed, a day's number and a name (``draw``), so
Spark makes the rows where it wants them and yesterday's value is the same
function of the day before: no recursion, no order, nothing made on the driver.
``EFFECTS`` is what the tests recover.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exports import SCHEMAS, Export

SEED = 7
LAST = dt.date(2025, 6, 29)
#: What is planted: changes of recovery (points), of heart-rate variability (ms) and of resting heart rate (beats).
EFFECTS = {
    "recovery": {"sleepHours": 4.5, "strainPrev": -1.4, "alcohol": -8.0, "meditation": 4.0},
    "hrv": {"sleepHours": 3.0, "strainPrev": -0.9, "alcohol": -5.5, "wave": 7.0},
    "rhr": {"alcohol": 2.5, "shift": -4.0},
}
#: Days of the wave in heart-rate variability, and the share of the days before the shift of the resting heart rate.
WAVE_DAYS, SHIFT_AT = 24, 0.6
QUESTIONS = {"Drink any alcohol?": "alcohol", "Meditate or breathe slowly?": "meditation", "Read before sleep?": "reading", "Eat close to bedtime?": "late_food", "Share the bed?": "shared_bed"}
#: Sport by weekday (Sunday is 0): name, minutes, strain, mean heart rate, shares of the five zones.
TRAINING = {
    2: ("Rowing", 50, 11.0, 138, (10, 25, 35, 22, 8)), 4: ("Climbing", 75, 8.5, 118, (35, 35, 20, 8, 2)), 6: ("Cycling", 110, 13.5, 131, (20, 40, 25, 12, 3)),
}


def draw(name: str, i: Column, seed: int = SEED) -> Column:
    """Uniform in (0, 1) for a day's number and a name."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), i.cast("long")), F.lit(1 << 50)) + 0.5) / float(1 << 50)


def normal(name: str, i: Column, seed: int = SEED) -> Column:
    return F.sqrt(-2 * F.ln(draw(name + "/length", i, seed))) * F.cos(2 * math.pi * draw(name + "/turn", i, seed))


def between(v: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v))


def demo_days(spark: SparkSession, days: int = 420, last: dt.date = LAST, seed: int = SEED) -> DataFrame:
    """A row for each day with its habits (0 or 1), sleep, strain and body values."""
    n = lambda name, i=F.col("i"): normal(name, i, seed)
    first = last - dt.timedelta(days=days - 1)
    weekday = lambda i: F.dayofweek(F.date_add(F.lit(first), i.cast("int"))) - 1
    habit = lambda name, chance: (draw(name, F.col("i"), seed) < chance).cast("double")

    def strain(i: Column) -> Column:
        sport = F.coalesce(*[F.when((weekday(i) == d) & (draw("trains", i, seed) < 0.85), s) for d, (_, _, s, _, _) in TRAINING.items()], F.lit(0.0))
        return between(7.5 + 0.55 * sport + 1.6 * n("strain", i), 1.0, 20.8)

    free = weekday(F.col("i")).isin(5, 6)
    base = spark.range(days).select(F.col("id").alias("i"), F.date_add(F.lit(first), F.col("id").cast("int")).alias("day")).withColumns({
        "alcohol": habit("alcohol", F.when(free, 0.5).otherwise(0.12)), "meditation": habit("meditation", F.lit(0.4)), "reading": habit("reading", F.lit(0.6)),
        "late_food": habit("late_food", F.when(free, 0.4).otherwise(0.2)), "shared_bed": habit("shared_bed", F.lit(0.5)), "strain": strain(F.col("i")), "before": strain(F.col("i") - 1),
    }).withColumn("sleepHours", between(7.3 + 0.4 * free.cast("double") - 0.3 * F.col("late_food") + 0.7 * n("sleep"), 3.5, 10.5))
    parts = {
        "sleepHours": F.col("sleepHours") - 7.3, "strainPrev": F.col("before") - 10, "alcohol": F.col("alcohol"), "meditation": F.col("meditation"),
        "wave": F.sin(2 * math.pi * F.col("i") / WAVE_DAYS), "shift": (F.col("i") >= int(SHIFT_AT * days)).cast("double"),
    }

    def planted(outcome: str, level: float, noise: float, low: float, high: float) -> Column:
        total = F.lit(level) + noise * n(outcome)
        for name, size in EFFECTS[outcome].items():
            total = total + size * parts[name]
        return between(total, low, high)

    asleep = 60 * F.col("sleepHours")
    rem, deep = asleep * between(0.22 - 0.04 * F.col("alcohol") + 0.02 * n("rem"), 0.08, 0.35), asleep * between(0.18 + 0.02 * n("deep"), 0.06, 0.3)
    in_bed, need = asleep * (1.06 + 0.05 * draw("awake", F.col("i"), seed)), 450 + 5 * F.greatest(F.lit(0.0), F.col("before") - 8)
    return base.withColumns({
        "recovery": planted("recovery", 61, 6, 1, 100), "hrv": planted("hrv", 66, 5, 15, 160), "rhr": planted("rhr", 54, 1.8, 35, 90),
        "skinTemp": 33.1 + 0.3 * n("skin"), "spo2": between(96 + 0.8 * n("oxygen"), 88, 100), "calories": 1950 + 80 * F.col("strain") + 120 * n("energy"),
        "maxHr": 140 + 25 * draw("peak", F.col("i"), seed), "avgHr": 66 + 1.1 * F.col("strain"), "sleepPerformance": between(100 * asleep / need, 20, 100), "respiratoryRate": 15 + 0.5 * n("breath"),
        "asleep": asleep, "inBed": in_bed, "light": asleep - rem - deep, "deep": deep, "rem": rem, "awake": in_bed - asleep, "sleepNeed": need, "sleepDebt": F.greatest(F.lit(0.0), need - asleep),
        "sleepEfficiency": 100 * asleep / in_bed, "sleepConsistency": between(78 + 8 * n("regular"), 10, 100),
        "bed": F.round(45 * n("bed") + F.when(free, 40).otherwise(-50)).cast("int"),
    })


def demo_export(spark: SparkSession, days: int = 420, last: dt.date = LAST, seed: int = SEED) -> Export:
    """The four tables of ``days`` days up to ``last``, the same each time."""
    d = demo_days(spark, days, last, seed).withColumn("midnight", F.col("day").cast("timestamp_ntz"))
    at = lambda minutes: (F.col("midnight") + F.make_dt_interval(mins=minutes.cast("int"))).cast("timestamp_ntz")
    fit = lambda df, kind: df.select(*[F.col(name).cast(of) for name, of in (f.strip().split(" ") for f in SCHEMAS[kind].split(","))])
    onset, wake = at(F.col("bed")), at(F.col("bed") + F.round("inBed"))
    cycles = d.withColumns({"start": onset, "end": at(F.col("bed") + 1440), "sleepOnset": onset, "wakeOnset": wake, "ord": F.col("i")})
    naps = d.where(draw("nap", F.col("i"), seed) < 0.08).withColumns({"isNap": F.lit(True), "length": 15 + 45 * draw("nap length", F.col("i"), seed), "ord": F.col("i")})
    empty = {c: F.lit(None).cast("double") for c in ("sleepPerformance", "respiratoryRate", "inBed", "light", "deep", "rem", "awake", "sleepNeed", "sleepDebt", "sleepEfficiency", "sleepConsistency")}
    sleeps = naps.withColumns(empty | {"sleepOnset": at(F.lit(14 * 60)), "wakeOnset": at(14 * 60 + F.col("length")), "asleep": F.col("length")})
    sport = F.coalesce(*[
        F.when(F.dayofweek("day") - 1 == w, F.struct(F.lit(name).alias("activity"), F.lit(float(minutes)).alias("minutes"), F.lit(s).alias("load"), F.lit(float(rate)).alias("rate"), F.array(*[F.lit(float(z)) for z in zones]).alias("zones")))
        for w, (name, minutes, s, rate, zones) in TRAINING.items()
    ])
    trained = d.withColumn("sport", sport).where(F.col("sport").isNotNull() & (draw("trains", F.col("i"), seed) < 0.85)).withColumn("duration", F.round(F.col("sport.minutes") * (0.8 + 0.4 * draw("length", F.col("i"), seed))))
    none = F.lit(None).cast("double")
    begin = F.lit(17 * 60) + 120 * draw("begin", F.col("i"), seed)
    workouts = trained.withColumns({
        "start": at(begin), "end": at(begin + F.col("duration")), "activity": F.col("sport.activity"), "strain": between(F.col("sport.load") + normal("load", F.col("i"), seed), 1, 20.8),
        "calories": F.round(F.col("duration") * 9), "maxHr": F.col("sport.rate") + 30, "avgHr": F.col("sport.rate"), "zones": F.col("sport.zones"),
        "distance": F.when(F.col("sport.activity") == "Cycling", F.round(F.col("duration") * 420)).otherwise(none), "altitudeGain": F.when(F.col("sport.activity") == "Cycling", F.round(F.col("duration") * 5)).otherwise(none),
        "ord": F.col("i"),
    })
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("question"), (F.col(name) == 1).alias("yes"), F.lit(k).alias("k")) for k, (q, name) in enumerate(QUESTIONS.items())]))
    answers = d.select("day", "i", asked.alias("a")).select("day", "a.question", "a.yes", F.lit("").alias("notes"), (F.col("i") * len(QUESTIONS) + F.col("a.k")).alias("ord"))
    return Export(fit(cycles, "cycles"), fit(sleeps, "sleeps"), fit(workouts, "workouts"), fit(answers, "journal"))
