"""Free-form model specifications and the ledger of tests that corrects for the search."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import scalars as S
from ..operators import density, regression
from ..operators.days import lagged
from ..operators.multiplicity import bh_values
from ..operators.treefit import fit_models

MAX_LAG = 7
ROWS_PER_TERM, LEAST_ROWS = 12, 40

# The fields a model may use, by group, with the factor to their display unit.
FIELDS = {
    "recovery": {"recovery": 1.0, "hrv": 1.0, "hrvZ": 1.0, "rhr": 1.0, "skinTemp": 1.0, "spo2": 1.0, "respiratoryRate": 1.0},
    "sleep": {
        "sleepHours": 1.0, "sleepEfficiency": 1.0, "sleepConsistency": 1.0, "sleepPerformance": 1.0, "sleepDebt": 1.0, "sleepNeed": 1.0, "deep": 1.0, "rem": 1.0, "light": 1.0, "awake": 1.0,
        "remShare": 1.0, "deepShare": 1.0, "bedtime": 1 / 60, "wakeTime": 1 / 60, "napMinutes": 1.0,
    },
    "training": {"strain": 1.0, "acwr": 1.0, "workoutMinutes": 1.0, "workoutCount": 1.0, "calories": 1.0, "maxHr": 1.0, "avgHr": 1.0},
}
SCALES = {name: scale for group in FIELDS.values() for name, scale in group.items()}


@dataclass(frozen=True)
class Term:
    field: str
    lag: int = 0

    def __str__(self) -> str:
        return f"{self.field}@{self.lag}"


@dataclass(frozen=True)
class Specification:
    dependent: str
    regressors: tuple[Term, ...]
    controls: tuple[Term, ...] = ()
    weekday_effects: bool = False
    month_effects: bool = False

    def normalized(self) -> Specification:
        """Without the dependent itself, impossible lags and repeated terms (regressors come first)."""
        seen: set[Term] = set()
        parts = []
        for terms in (self.regressors, self.controls):
            kept = []
            for t in terms:
                if 0 <= t.lag <= MAX_LAG and t not in seen and not (t.field == self.dependent and t.lag == 0):
                    seen.add(t)
                    kept.append(t)
            parts.append(tuple(kept))
        return Specification(self.dependent, parts[0], parts[1], self.weekday_effects, self.month_effects)

    def key(self) -> str:
        """The same for the same model, in whatever order its terms are named."""
        s = self.normalized()
        names = lambda terms: ",".join(sorted(map(str, terms)))
        return f"{s.dependent}~{names(s.regressors)}|{names(s.controls)}|{int(s.weekday_effects)}{int(s.month_effects)}"

    def runnable(self) -> bool:
        return bool(self.normalized().regressors)

    def describe(self) -> str:
        s = self.normalized()
        shown = [f"{t.field}(t-{t.lag})" if t.lag else t.field for t in (*s.regressors, *s.controls)]
        shown += ["weekday"] * s.weekday_effects + ["month"] * s.month_effects
        return f"{s.dependent} ~ {' + '.join(shown)}"


LEDGER = "spec string, term string, p double"
FITTED = "ok boolean, n long, min_n long, missing long, k long, r2 double, density double, dropped array<string>, term string, role string, coef double, se double, t double, p double, ci_low double, ci_high double, q double, family_specs long, family_tests long"


def design_of(days: DataFrame, s: Specification, day: str) -> tuple[DataFrame, dict[Term, str], list[str], list[list[str]]]:
    """The days with ``__y`` and the columns of a normalised model; the columns of its terms, all columns, and the groups of fixed effects."""
    name = {t: f"{t.field}_lag{t.lag}" for t in (*s.regressors, *s.controls)}
    d = days.withColumns({n: lagged(F.col(t.field), t.lag, SCALES.get(t.field, 1.0), (), day) for t, n in name.items()} | {"__y": lagged(F.col(s.dependent), 0, SCALES.get(s.dependent, 1.0), (), day)})
    effects: list[list[str]] = []
    for wanted, make_dummies in ((s.weekday_effects, regression.weekday_dummies), (s.month_effects, regression.month_dummies)):
        if wanted:
            d, names = make_dummies(d, day)
            effects.append(names)
    return d, name, [*name.values(), *[n for group in effects for n in group]], effects


def scatter(days: DataFrame, spec: Specification, day: str = "day", least_share: float = 0.1) -> DataFrame:
    """The first regressor against the dependent over exactly the rows that the model uses, and the gaps of that regressor: ``kind, x, x_high, y, share``."""
    s = spec.normalized()
    d, name, columns, _ = design_of(days, s, day)
    whole = F.lit(True)
    for c in ("__y", *columns):
        whole = whole & S.is_num(F.col(c))
    points = d.where(whole).select(F.col(name[s.regressors[0]]).cast("double").alias("x"), F.col("__y").cast("double").alias("y"))
    none = F.lit(None).cast("double")
    gaps = density.support_gaps(points, "x", least_share)
    return points.select(F.lit("point").alias("kind"), "x", none.alias("x_high"), "y", none.alias("share")).unionByName(
        gaps.select(F.lit("gap").alias("kind"), F.col("lo").alias("x"), F.col("hi").alias("x_high"), none.alias("y"), "share")
    )


def run_specification(days: DataFrame, spec: Specification, ledger: list[tuple[str, str, float]] = (), day: str = "day") -> DataFrame:
    """A HAC fit with the q-values of its regressors within all tests of the ledger: rows of ``FITTED``.

    The least number of rows counts the columns asked for, before any drops out.
    """
    s = spec.normalized()
    d, name, columns, effects = design_of(days, s, day)
    roles = {name[t]: "regressor" for t in s.regressors} | {name[t]: "control" for t in s.controls}
    key, history = s.key(), [x for x in ledger if x[0] != s.key()]

    def make(fit: L.Fit) -> pd.DataFrame:
        own = [t for t in fit.terms if roles.get(t["term"]) == "regressor"]
        q = bh_values([x[2] for x in history] + [t["p"] for t in own])[len(history) :]
        by = dict(zip((t["term"] for t in own), q, strict=True))
        base = {
            "ok": fit.ok, "n": fit.n, "min_n": fit.min_n, "missing": fit.missing, "k": fit.k if fit.ok else None, "r2": fit.r2, "density": fit.n / fit.k if fit.ok else None, "dropped": fit.dropped,
            "family_specs": len({x[0] for x in history} | ({key} if own else set())), "family_tests": len(history) + len(own),
        }
        rows = [base | {"role": roles.get(t["term"], "fixed"), "q": by.get(t["term"])} | {c: t[c] for c in ("term", "coef", "se", "t", "p", "ci_low", "ci_high")} for t in fit.terms]
        return pd.DataFrame(rows or [base], columns=[c.split(" ")[0] for c in FITTED.split(", ")])

    return fit_models(d, (), "__y", columns, make, FITTED, L.HAC, None, day, True, lambda asked: max(LEAST_ROWS, ROWS_PER_TERM * (asked + 1)), effects=effects)


def record_run(ledger: DataFrame, spec: Specification, fitted: DataFrame) -> DataFrame:
    """The ledger with this model's tests in place of earlier ones of its own."""
    key = spec.key()
    tests = fitted.where("role = 'regressor'").select(F.lit(key).alias("spec"), "term", "p")
    return ledger.where(F.col("spec") != key).unionByName(tests)


def clear_family(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def parse_preset(raw: object) -> dict | None:
    """A stored model that can be trusted, or None: known fields, lags in range, a short name, at least one regressor."""
    if not isinstance(raw, dict) or raw.get("dependent") not in SCALES or not isinstance(raw.get("name"), str):
        return None
    name = raw["name"].strip()[:60]

    def terms(value) -> tuple[Term, ...]:
        held = value if isinstance(value, list) else []
        return tuple(Term(t["field"], t["lag"]) for t in held if isinstance(t, dict) and t.get("field") in SCALES and isinstance(t.get("lag"), int) and 0 <= t["lag"] <= MAX_LAG)

    spec = Specification(raw["dependent"], terms(raw.get("regressors")), terms(raw.get("controls")), bool(raw.get("weekday_effects")), bool(raw.get("month_effects"))).normalized()
    if not name or not spec.runnable():
        return None
    at = raw.get("saved_at")
    return {"id": raw.get("id") or preset_id(name, spec), "name": name, "spec": spec, "saved_at": at if isinstance(at, (int, float)) else 0}


def preset_id(name: str, spec: Specification) -> str:
    return f"{name.strip().lower()}#{spec.key()}"


def save_presets(spark: SparkSession, presets: list[dict], path: str) -> None:
    rows = []
    for p in presets:
        s: Specification = p["spec"]
        body = {"id": p["id"], "name": p["name"], "saved_at": p.get("saved_at", time.time()), "dependent": s.dependent, "weekday_effects": s.weekday_effects, "month_effects": s.month_effects}
        body |= {k: [{"field": t.field, "lag": t.lag} for t in terms] for k, terms in (("regressors", s.regressors), ("controls", s.controls))}
        rows.append((json.dumps(body),))
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def load_presets(spark: SparkSession, path: str) -> list[dict]:
    """The valid ones, the latest first."""
    found = []
    for (line,) in spark.read.text(path).collect():  # what a user has saved
        try:
            found.append(parse_preset(json.loads(line)))
        except ValueError:
            continue
    return sorted((p for p in found if p), key=lambda p: -p["saved_at"])
