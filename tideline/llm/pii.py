"""Operator 5: personal data by candidate gradient boosting, in DataFrame operations only.

1. The base kinds (email, ip, card, phone) are found and validated; they stay.
2. High-recall generators propose further, overlapping spans: national phone
   numbers, social security numbers, account numbers, obfuscated addresses and
   bare long numbers.
3. Every candidate that no base span covers gets binned format and context
   features; boosted trees of depth two, written out as CASE expressions, score
   it; and each kind's calibrated threshold selects the redactions.

The trees are fitted on ``TRAIN_ROWS`` generated snippets, which pass through
the same generators and features as the corpus.  What reaches the driver is a
count for each distinct feature vector, of which the bins allow a fixed number.

Positions come from two scans with one expression: the matches, and the gaps
that ``split`` leaves between them, whose lengths add up to starts and ends in
code points.  No expression loops over a group, so long texts can't exhaust the
matcher's stack.  Sums, coverage and the choice among overlapping spans are
sweeps in order of position (``sweep``), so work stays in proportion to the
matches of a text, times their logarithm.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text

TRAIN_ROWS = 1200
ROUNDS = 24
RATE = 0.4
PRECISION = 0.95
CONTEXT_CHARS = 32

# The base kinds, equal in matches to the contract's expressions.
# A match of email can start where the last one ended, or at the start of a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Blocks of digits with single separators; those of other lengths would be dropped.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

# Generators of further candidates, with a cheap test that any text with one passes.
GENERATORS = {
    "national": (r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", "[0-9]{3}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    "address": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{1,63}){1,8}", r"[\[(]at[\])]"),
    "number": (r"(?<![0-9A-Za-z])[0-9]{7,19}(?![0-9A-Za-z])", "[0-9]{7}"),
}
MORE_KINDS = tuple(GENERATORS)
KINDS = BASE_KINDS + MORE_KINDS

# Words before a candidate that speak for a kind.
CONTEXT = {
    "national": r"(?:phone|tel|call|fax|mobile|cell|ring|text)\W",
    "ssn": r"(?:ssn|social|security|taxpayer)\W",
    "iban": r"(?:iban|account|bank|transfer|konto)\W",
    "address": r"(?:mail|contact|write|reach)\W",
    "number": r"(?:passport|licen[cs]e|account|customer|member|patient|social)\W",
}
#: The binned features of a candidate, small integers all.
FEATURES = ("kind", "digits", "separators", "glued", "context", "other", "checksum", "bracketed")

SPAN = "struct<start:bigint,end:bigint,match:string,before:string,after:string>"
#: Outputs that a sweep appends to one array before it starts the next.
CHUNK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sweep(items: Column, state: Column, step, out_type: str) -> Column:
    """``struct<state, outs>`` of a fold over an array: ``step`` takes a state and an item and gives the next state and an output.

    Appending copies an array, so outputs are gathered in chunks that are joined once.
    """
    empty = F.array().cast(f"array<{out_type}>")

    def one(acc, x):
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["outs"], F.array(out)).alias("outs"))

    def over(held: Column) -> Column:
        def chunk(acc, i):
            inner = F.aggregate(F.slice(held, i, CHUNK), F.struct(acc["state"].alias("state"), empty.alias("outs")), one)
            return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["outs"])).alias("outs")))

        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(held)), F.lit(CHUNK))
        begin = F.struct(state.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("outs"))
        return F.aggregate(starts, begin, chunk, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["outs"]).alias("outs")))

    return let(items, over)


def located(text: Column, pattern: str, gate: str | None = None) -> Column:
    """All leftmost, non-overlapping matches with their places in code points, the text before and the character after."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def pairs(parts: Column) -> Column:
        # The last gap has no match after it.
        m, g = parts["m"], parts["g"]
        after = lambda i: F.left(F.concat(g[i + 1], F.coalesce(F.get(m, i + 1), F.lit(""))), F.lit(1))
        return F.transform(m, lambda match, i: F.struct(match.alias("match"), F.length(g[i]).cast("long").alias("gap"), F.right(g[i], F.lit(CONTEXT_CHARS)).alias("lead"), after(i).alias("after")))

    def step(state, x):
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["match"])
        before = F.right(F.concat(state["tail"], x["lead"]), F.lit(CONTEXT_CHARS))
        state = F.struct(end.alias("at"), F.right(F.concat(before, x["match"]), F.lit(CONTEXT_CHARS)).alias("tail"))
        return state, F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"), before.alias("before"), x["after"].alias("after"))

    held = text.rlike(pattern) if gate is None else text.rlike(gate) & text.rlike(pattern)
    found = let(F.struct(matches.alias("m"), gaps.alias("g")), pairs)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"))
    return F.when(held, sweep(found, begin, step, SPAN)["outs"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def uncovered(candidates: Column, spans: Column) -> Column:
    """The candidates that overlap none of the spans: one sweep each way tells how far spans from before reach, and where the next one starts."""
    event = lambda kind, x, at: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), at.cast("int").alias("at"))
    events = F.sort_array(F.concat(F.transform(spans, lambda x: event(0, x, F.lit(-1))), F.transform(candidates, lambda x, i: event(1, x, i))))

    def reached(reach, x):
        return F.when(x["kind"] == 0, F.greatest(reach, x["end"])).otherwise(reach), F.struct(x["at"].alias("at"), (reach > x["start"]).alias("hit"))

    def ahead(following, x):
        return F.when(x["kind"] == 0, x["start"]).otherwise(following), F.struct(x["at"].alias("at"), (following < x["end"]).alias("hit"))

    hits = lambda outs: F.sort_array(F.filter(outs, lambda x: x["at"] >= 0))
    flag = "struct<at:int,hit:boolean>"
    swept = let(events, lambda e: F.struct(
        hits(sweep(e, F.lit(0).cast("long"), reached, flag)["outs"]).alias("a"), hits(sweep(F.reverse(e), F.lit((1 << 63) - 1), ahead, flag)["outs"]).alias("b"),
    ))
    free = let(swept, lambda s: F.zip_with(s["a"], s["b"], lambda a, b: ~(a["hit"] | b["hit"])))
    marked = F.zip_with(candidates, free, lambda x, f: F.struct(x.alias("x"), f.alias("free")))
    return F.when((F.size(spans) == 0) | (F.size(candidates) == 0), candidates).otherwise(F.transform(F.filter(marked, lambda m: m["free"]), lambda m: m["x"]))


RANKED = "struct<loss:double,start:bigint,back:bigint,kind:int>"


def best_apart(spans: Column) -> Column:
    """Of ``RANKED`` spans those chosen greedily by score, then earlier start, later end and kind, so that none overlap.

    A sweep cuts the spans where no span lies across; a stretch holds at most a
    few of each kind, and the choice is made stretch by stretch.
    """
    none = F.array().cast(f"array<{RANKED}>")
    ends = lambda x: -x["back"]

    def chosen(held: Column) -> Column:
        apart = lambda kept, x: ~F.exists(kept, lambda k: (x["start"] < ends(k)) & (k["start"] < ends(x)))
        return F.aggregate(F.sort_array(held), none, lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))

    def step(state, x):
        cut = x["start"] >= state["reach"]
        after = F.struct(F.when(cut, ends(x)).otherwise(F.greatest(state["reach"], ends(x))).alias("reach"), F.when(cut, F.array(x)).otherwise(F.concat(state["held"], F.array(x))).alias("held"))
        return after, F.when(cut, chosen(state["held"])).otherwise(none)

    in_order = F.transform(F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x.alias("x")))), lambda e: e["x"])
    swept = sweep(in_order, F.struct(F.lit(0).cast("long").alias("reach"), none.alias("held")), step, f"array<{RANKED}>")
    return F.when(F.size(spans) < 2, spans).otherwise(let(swept, lambda s: F.concat(F.flatten(s["outs"]), chosen(s["state"]["held"]))))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def passes_mod97(account: Column) -> Column:
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))

    def step(acc, i):
        code = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def base_spans(text: Column) -> dict[str, Column]:
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    phone_digits = lambda x: F.length(digits_of(x["match"])).between(9, 15)
    return {
        "email": located(text, EMAIL, "@"),
        "ip": F.filter(located(text, IP, r"[0-9]\.[0-9]"), lambda x: x["match"].rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")),
        "card": F.filter(located(text, CARD, r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), lambda x: passes_luhn(digits_of(x["match"]))),
        "phone": F.filter(located(text, PHONE, r"\+[0-9]"), phone_digits),
    }


def candidates(text: Column) -> Column:
    """The proposals of all generators, overlapping as they are, with their kind's number."""

    def proposed(k: int, pattern: str, gate: str) -> Column:
        return F.transform(located(text, pattern, gate), lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after")))

    return F.concat(*[proposed(k, pattern, gate) for k, (pattern, gate) in enumerate(GENERATORS.values())])


def with_features(x: Column) -> Column:
    """A candidate with its binned features."""
    before = F.lower(x["before"])
    around = F.concat(F.right(x["before"], F.lit(1)), F.lit("|"), x["after"])
    digits = F.length(digits_of(x["match"]))
    own = F.coalesce(*[F.when(x["kind"] == k, before.rlike(CONTEXT[name])) for k, name in enumerate(MORE_KINDS)])
    other = before.rlike("|".join(CONTEXT.values()))
    checked = F.when(x["kind"] == MORE_KINDS.index("iban"), passes_mod97(x["match"])).when(
        x["kind"] == MORE_KINDS.index("ssn"), x["match"].rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")
    ).otherwise(F.lit(False))
    return F.struct(
        x["start"].alias("start"),
        x["end"].alias("end"),
        x["kind"].alias("kind"),
        F.least(F.lit(20), digits).cast("int").alias("digits"),
        F.least(F.lit(3), F.length(F.regexp_replace(x["match"], r"[^\x20().-]", ""))).cast("int").alias("separators"),
        around.rlike("^[A-Za-z0-9_/=#]|[A-Za-z0-9_/=]$").cast("int").alias("glued"),
        own.cast("int").alias("context"),
        other.cast("int").alias("other"),
        checked.cast("int").alias("checksum"),
        x["match"].startswith("(").cast("int").alias("bracketed"),
    )


def snippets(rows: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[str, int, int]]:
    """Generated training rows ``(text, kind, label)``: true and false instances of each further kind."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["er", "th", "on", "la", "de", "ung", "re", "st", "ment", "os"]) for _ in range(r.randint(1, 4)))

    def iban(good: bool) -> str:
        country, body = r.choice(["DE", "FR", "ES", "GB"]), n(18)
        value = int("".join(str(int(c, 36)) for c in body + country) + "00")
        check = (98 - value % 97 + (0 if good else r.randint(1, 90))) % 97
        return f"{country}{check + (97 if check < 2 else 0):02d}" + body

    told = {
        0: ["phone: ", "tel. ", "call ", "my mobile, "], 1: ["ssn: ", "social security "], 2: ["iban: ", "bank account "], 3: ["mail: ", "contact ", "write to "],
        4: ["passport: ", "license ", "customer ", "patient "],
    }
    neutral = ["order ", "lot ", "item ", "isbn ", "total ", "version ", "page ", "", "", ""]
    out = []
    for i in range(rows):
        kind, label = i % len(MORE_KINDS), i // len(MORE_KINDS) % 2
        good = [f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)} {n(4)} {n(4)}"], [f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"], [iban(True)], [
            f"{word()} [at] {word()}.example", f"{word()}(at){word()}(dot)example", f"{word()}.{word()} [at] {word()} [dot] example"], [n(9), n(8), n(10)]
        bad = [f"{n(4)}-{n(4)}{n(4)}", f"{n(2)}.{n(3)}.{n(3)}", f"{n(3)} {n(3)} {n(4)}"], [f"000-{n(2)}-{n(4)}", f"9{n(2)}-00-{n(4)}"], [iban(False)], [f"{word()} (at) {n(2)}.{n(2)}"], [n(16), n(12), n(7), n(19)]
        lead = r.choice(told[kind] if label or kind in (1, 2) and r.random() < 0.3 else neutral)
        own = r.choice((good if label else bad)[kind])
        # Numbers of a telling form are true without a word that says so.
        if label and (kind in (1, 2) or own.startswith("(")) and r.random() < 0.4:
            lead = r.choice(neutral)
        out.append((f"{word()} {word()} {lead}{own} {word()}", kind, label))
    return out


def _leaf(w: np.ndarray, g: np.ndarray, h: np.ndarray) -> float:
    return float((w * g).sum() / ((w * h).sum() + 1.0)) * RATE


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = ROUNDS) -> list[tuple]:
    """Newton boosting of depth-two trees on weighted distinct rows: ``(feature, cut, left, right)`` with leaves as numbers."""

    def grow(rows: np.ndarray, g, h, depth: int):
        best = (1e-6, None)
        total = (w[rows] * g[rows]).sum(), (w[rows] * h[rows]).sum() + 1.0
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= cut]
                gl, hl = (w[left] * g[left]).sum(), (w[left] * h[left]).sum()
                gain = gl**2 / (hl + 1.0) + (total[0] - gl) ** 2 / (total[1] - hl) - total[0] ** 2 / total[1]
                if gain > best[0]:
                    best = (gain, (f, int(cut)))
        if depth == 0 or best[1] is None:
            return _leaf(w[rows], g[rows], h[rows])
        f, cut = best[1]
        side = x[rows, f] <= cut
        return (f, cut, grow(rows[side], g, h, depth - 1), grow(rows[~side], g, h, depth - 1))

    trees, score = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), 2)
        trees.append(tree)
        score += np.array([tree_value(tree, row) for row in x])
    return trees


def tree_value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def tree_expression(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(x[FEATURES[tree[0]]] <= tree[1], tree_expression(tree[2], x)).otherwise(tree_expression(tree[3], x))


def calibrate(scores: np.ndarray, kinds: np.ndarray, y: np.ndarray, w: np.ndarray, precision: float = PRECISION) -> list[float]:
    """For each kind the lowest score from which on its held-out precision is enough; infinity where none is."""
    out = []
    for k in range(len(MORE_KINDS)):
        of = np.flatnonzero(kinds == k)
        best = math.inf
        for t in np.unique(scores[of]):
            on = of[scores[of] >= t]
            if (w[on] * y[on]).sum() >= precision * w[on].sum():
                # A hair below, as sums may be added up in another order there.
                best = min(best, float(t) - 1e-9)
        out.append(best)
    return out


@lru_cache(maxsize=4)
def _fitted(session_id: str, rows: int) -> tuple[list[tuple], list[float]]:
    spark = SparkSession.active()
    values = ", ".join(f"('{text}', {kind}, {label}, {i // (2 * len(MORE_KINDS)) % 2})" for i, (text, kind, label) in enumerate(snippets(rows)))
    made = spark.sql(f"SELECT * FROM VALUES {values} AS t(text, of, label, fold)")
    found = made.withColumn("c", F.explode(candidates(F.col("text")))).select("of", "label", "fold", with_features(F.col("c")).alias("x"))
    truth = ((F.col("x.kind") == F.col("of")) & (F.col("label") == 1)).cast("int")
    counted = found.groupBy("fold", truth.alias("y"), *[F.col(f"x.{f}").alias(f) for f in FEATURES]).count().orderBy("fold", "y", *FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in counted])
    fold, y, w = (np.array([r[c] for r in counted], float) for c in ("fold", "y", "count"))
    fit = fold == 0
    trees = boost(x[fit], y[fit], w[fit])
    scores = np.array([sum(tree_value(t, row) for t in trees) for row in x[~fit]])
    return trees, calibrate(scores, x[~fit][:, 0], y[~fit], w[~fit])


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``, a row for each row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind as
    listed in ``KINDS`` and then start.  Counts and digest are of the base kinds.
    Of overlapping added spans the one with the highest score stays, then of those
    that don't overlap it the one with the highest, and so on; ties go to the
    earlier start, then to the later end.  A null text counts as empty: no spans and the digest of nothing.
    Other columns are not read.
    """
    spark = docs.sparkSession
    trees, least = _fitted(spark.sparkContext.applicationId, train_rows)
    text = F.col("__text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("__text"))
    based = rows.select("doc_id", "__text", *[s.alias(k) for k, s in base_spans(text).items()])
    proposed = based.select("doc_id", *BASE_KINDS, "__text", candidates(text).alias("__all")).select(
        "doc_id", *BASE_KINDS, "__text", uncovered(F.col("__all"), F.concat(*[F.col(k) for k in BASE_KINDS])).alias("__open")
    )
    featured = proposed.select("doc_id", *BASE_KINDS, F.transform("__open", with_features).alias("__x"))

    def scored(x):
        total = F.lit(0.0)
        for tree in trees:
            total = total + tree_expression(tree, x)
        return F.struct((-total).alias("loss"), x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].cast("int").alias("kind"))

    threshold = lambda x: F.coalesce(*[F.when(x["kind"] == k, F.lit(t)) for k, t in enumerate(least)])
    judged = featured.select("doc_id", *BASE_KINDS, F.filter(F.transform("__x", scored), lambda x: -x["loss"] >= threshold(x)).alias("__in"))
    chosen = judged.select("doc_id", *BASE_KINDS, best_apart(F.col("__in")).alias("__more"))
    written = lambda spans, kind: F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))

    def added(k: int, name: str) -> Column:
        own = F.transform(F.filter("__more", lambda x: x["kind"] == k), lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end")))
        return written(F.sort_array(own), name)

    base = F.concat(*[written(F.col(k), k) for k in BASE_KINDS])
    more = F.concat(*[added(k, name) for k, name in enumerate(MORE_KINDS)])
    texts = chosen.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS], base.alias("__base"), more.alias("__added"))
    return texts.select("doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2(F.concat_ws(",", "__base"), 256).alias("base_sha256"), F.concat_ws(",", F.concat("__base", "__added")).alias("spans"))


def op5_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))
