"""The near-copy stage of the pipeline: five-word shingles, Jaccard of at least 0.8.

Two texts of Jaccard 0.8 have SimHashes that differ in about ten of 64 bits,
which may touch all eight bytes, so operator 7's minimum of shared positional
bytes guarantees nothing for them.  This stage keeps its inverted index over
positions, its components and its verification, and fills the positions with
minima: a document is the set of the 64-bit hashes of its five-word shingles,
documents of one set are one node, and every position holds the minimum of the
set under another mapping, equal for two documents with the probability of
their Jaccard.  A posting holds the nodes that agree in a set of positions.

Level 0 posts 28 sets of five positions: a pair of Jaccard 0.8 shares none with
probability (1 - 0.8**5)**28 = 1.5e-5.  First every member of a posting is
compared with its leader, the member with the fewest shingles of its own; that
joins most copies to their group.  Then members of a posting of up to ``FEW`` that are
still in different components are compared in pairs.

In larger postings a reference text says where to look, the leader of a family's
largest posting.  Let c(x) be what x shares with the reference.  Two members that
have no shingle in common outside the reference share at most the lesser of
their c, so they are near copies only if 9 min(c(x), c(y)) >= 4 (|x| + |y|).  All
other pairs of near copies have a shingle in common that the reference lacks:
members are posted by those (``residual_postings``), which are the rare ones, and
compared in pairs.  The exceptions need a member that is smaller than the
reference (else the other one would be a near copy of it, or fall short), so few
members can take part in one; those, and the members of residual postings of more
than ``FEW``, go on to the next level, whose postings agree in more positions (100
sets of 10, then 1,000 sets of 20).  The last level compares all
members that are in different components, whatever a posting's size.  So no pair
is left out by the size of a posting.

Shingles that a node has alone among all that are compared can't be shared, so
they bound a pair's Jaccard from above.  Pairs, and members of a posting for
which no partner in another component is possible, are left out by that bound;
in a cluster of edited copies it leaves few.

Before two sets are compared, the pair is tallied as in operator 7: how many of
level 0's 140 positions hold the same byte of their minimum in both.  A pair of
Jaccard 0.8 has 112 in common on average, and fewer than ``LEAST`` = 70 with
probability 6e-16, which takes the place of operator 7's guaranteed minimum.

Which pairs are near copies is decided on their whole sets, and copies of
copies are one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_text
from .simhash import _LOWER, _WORD, components

WORDS = 5
#: Jaccard of at least this many in this many.
LIKE, OF = 4, 5
#: Positions that a key takes, and keys, at each level.
LEVELS = ((5, 28), (10, 100), (20, 1000))
#: Minima that a level's keys choose from; as many as the keys take where they fit.
POOL = 2000
FEW = 16
#: Positional bytes, of the 140 at level 0, that a pair must share.
LEAST = 70
CHUNK = 1024
_RANDOM = np.random.default_rng(5)
_TIMES = _RANDOM.integers(0, 1 << 64, (POOL, 1), np.uint64, endpoint=False) | np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 64, (POOL, 1), np.uint64, endpoint=False)
_PLACE = [np.uint64(int(x) | 1) for x in _RANDOM.integers(0, 1 << 64, WORDS, np.uint64, endpoint=False)]
#: The positions of each key, (keys, positions).
_CHOSEN = [
    np.arange(size * keys).reshape(keys, size) if size * keys <= POOL else np.array([_RANDOM.choice(POOL, size, replace=False) for _ in range(keys)]) for size, keys in LEVELS
]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, sorted; a shorter text is one shingle, one without words has none."""
    w = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(w))):
        out += h[k : k + n] * _PLACE[k]
    return np.unique(_mix(out))


def node_of(held: np.ndarray) -> int:
    """One number for a set of shingles."""
    return xxhash.xxh64_intdigest(held.tobytes())


def positions(held: np.ndarray, level: int = 0) -> np.ndarray:
    """The minima of a set that is not empty, as many as a level's keys choose from."""
    used = int(_CHOSEN[level].max()) + 1
    low = np.full(used, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(held), CHUNK):
        # The high bits of a multiplied hash depend on all of it.
        np.minimum(low, (_TIMES[:used] * held[None, a : a + CHUNK] + _PLUS[:used]).min(axis=1), out=low)
    return _mix(low)


def keys_of(minima: np.ndarray, level: int = 0) -> np.ndarray:
    """A level's keys: each of its sets of minima, with its number."""
    chosen = _CHOSEN[level]
    key = np.arange(1, len(chosen) + 1, dtype=np.uint64)
    for k in range(chosen.shape[1]):
        key = _mix(key ^ minima[chosen[:, k]]) + np.uint64(k)
    return key


def position_keys(held: np.ndarray, level: int = 0) -> np.ndarray:
    """A level's keys of a set that is not empty."""
    return keys_of(positions(held, level), level)


def signed(x) -> int:
    return int(x) - (1 << 64) if int(x) >> 63 else int(x)


def signatures(rows: DataFrame) -> DataFrame:
    """``doc_id, node, n, keys, bytes`` of ``doc_id, text``: the postings of level 0 and a byte of each of its positions."""

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            minima = [positions(s) if len(s) else None for s in sets]
            keys = [keys_of(m).view(np.int64) if m is not None else np.zeros(0, np.int64) for m in minima]
            held = [m.astype(np.uint8).tobytes() if m is not None else b"" for m in minima]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "node": [signed(node_of(s)) for s in sets], "n": [len(s) for s in sets], "keys": keys, "bytes": held})

    return rows.mapInPandas(run_task, "doc_id long, node long, n int, keys array<long>, bytes binary")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """``node, held`` of ``doc_id, text``."""

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                sets = [shingles(t) for t in batch["text"].iloc[a : a + 256]]
                yield pd.DataFrame({"node": [signed(node_of(s)) for s in sets], "held": [s.view(np.int64) for s in sets]})

    return rows.mapInPandas(run_task, "node long, held array<long>")


def postings(nodes: DataFrame) -> DataFrame:
    """``key, node, n, own, root, members`` of nodes ``node, n, own, keys, root``: the postings whose members are in more than one component."""
    cells = nodes.select(F.explode("keys").alias("key"), "node", "n", "own", "root")
    met = cells.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key", "members")
    return cells.join(met, "key")


def own_shingles(sets: DataFrame) -> DataFrame:
    """``node, alone``: the shingles that a node of ``node, held`` has alone among them, where it has any."""
    cells = sets.select("node", F.explode("held").alias("s"))
    return cells.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.collect_list("s").alias("alone"))


def _side(df: DataFrame, x: str) -> DataFrame:
    return df.select("key", F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("own").alias(f"{x}o"), F.col("root").alias(f"{x}r"))


def _possible(pairs: DataFrame) -> DataFrame:
    """``u, v`` with u above v: the distinct pairs of different components whose sizes and own shingles allow the likeness."""
    shared = F.least(F.col("un") - F.col("uo"), F.col("vn") - F.col("vo"))
    alike = pairs.where((F.col("ur") != F.col("vr")) & (OF * shared >= LIKE * (F.col("un") + F.col("vn") - shared)))
    return alike.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def led_pairs(shared: DataFrame) -> DataFrame:
    """Every member of a posting with its leader."""
    lead = shared.groupBy("key").agg(F.min(F.struct("own", "node", "n", "root")).alias("l"))
    return _possible(_side(shared, "u").join(lead.select("key", F.col("l.node").alias("v"), F.col("l.n").alias("vn"), F.col("l.own").alias("vo"), F.col("l.root").alias("vr")), "key"))


def met_pairs(shared: DataFrame) -> DataFrame:
    """Every pair of members of a posting."""
    return _possible(_side(shared, "u").join(_side(shared, "v"), "key").where("u > v"))


def still_apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings that hold several components by the ``roots``, ``node, root``, found by now, and of their members those that may have a partner.

    The best partner has all that a member may share and the fewest own shingles
    of the other components.
    """
    again = rooted(shared, roots).select("key", "node", "n", "own", "root", "members")
    best = again.groupBy("key").agg(F.min(F.struct("own", "root")).alias("best"))
    beside = again.join(best, "key")
    second = beside.where("root <> best.root").groupBy("key").agg(F.min("own").alias("second"))
    fewest = F.when(F.col("root") == F.col("best.root"), F.col("second")).otherwise(F.col("best.own"))
    able = beside.join(second, "key").where(OF * (F.col("n") - F.col("own")) >= LIKE * (F.col("n") + fewest)).drop("best", "second")
    apart = able.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    return able.join(apart, "key", "left_semi")


def beside_leaders(large: DataFrame, sets: DataFrame, own: DataFrame) -> DataFrame:
    """``lead, ln, node, n, own, common, rest`` for every member of a posting and the posting's reference: what both share, and what else the member shares with any other.

    Any text may be the reference of a posting; one that most members resemble
    leaves the least.  So a member names the leader of its largest posting, and a
    posting takes the one of the largest posting that its members name: postings
    of one family have one reference.
    """
    lead = large.groupBy("key").agg(F.min(F.struct("own", "node", "n")).alias("l"))
    led = large.join(lead, "key").select("key", "node", "n", "own", F.struct("members", F.col("l.node").alias("node"), F.col("l.n").alias("n")).alias("l"))
    named = led.groupBy("node").agg(F.max("l").alias("l")).withColumnRenamed("node", "by")
    chosen = led.select("key", "node").join(named, F.col("node") == F.col("by")).groupBy("key").agg(F.max("l").alias("to"))
    pairs = led.join(chosen, "key").where("node <> to.node").select(F.col("to.node").alias("lead"), F.col("to.n").alias("ln"), "node", "n", "own").distinct()
    whole = pairs.join(sets.select(F.col("node").alias("of"), F.col("held").alias("b")), F.col("lead") == F.col("of")).drop("of")
    whole = whole.join(sets.join(own.select(F.col("node").alias("of"), "alone"), F.col("node") == F.col("of")).select("of", F.col("held").alias("a"), "alone"), F.col("node") == F.col("of"))
    return whole.select("lead", "ln", "node", "n", "own", F.size(F.array_intersect("a", "b")).alias("common"), F.array_except(F.array_except("a", "b"), "alone").alias("rest"))


def rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with their ``root`` by ``roots``; a node that nothing links is its own."""
    named = roots.select(F.col("node").alias("of"), F.col("root").alias("now"))
    return nodes.join(named, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("now", "node")).drop("of", "now")


def residual_postings(beside: DataFrame) -> DataFrame:
    """Postings like those of ``postings``, a key for each reference and shingle that it lacks, of ``beside_leaders`` with roots.

    A member needs ``need`` such shingles in common with a near copy that is no
    exception, at least what its size and the least size of the family ask for
    beyond its share of the reference.  So it is posted by its rarest ones only,
    all but ``need - 1`` of those that any other member has, and not at all where
    there are fewer.
    """
    least = beside.groupBy("lead").agg(F.min("n").alias("least")).withColumnRenamed("lead", "by")
    need = F.greatest(F.lit(1), F.ceil(LIKE * (F.col("n") + F.col("least")) / (OF + LIKE)) - F.col("common")).cast("int")
    able = beside.join(least, F.col("lead") == F.col("by")).withColumn("need", need).where(F.size("rest") >= F.col("need"))
    cells = able.select(F.explode("rest").alias("s"), "lead", "node", "n", "own", "root", "need")
    count = cells.groupBy("lead", "s").agg(F.count(F.lit(1)).alias("many")).where("many > 1").withColumnsRenamed({"lead": "by", "s": "of"})
    ranked = cells.join(count, (F.col("lead") == F.col("by")) & (F.col("s") == F.col("of"))).groupBy("lead", "node", "n", "own", "root", "need").agg(F.array_sort(F.collect_list(F.struct("many", "s"))).alias("held"))
    rare = ranked.where(F.size("held") >= F.col("need")).withColumn("h", F.explode(F.slice("held", F.lit(1), F.size("held") - F.col("need") + 1)))
    posted = rare.select(F.xxhash64("lead", "h.s").alias("key"), "node", "n", "own", "root")
    met = posted.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key", "members")
    return posted.join(met, "key")


def exceptions(beside: DataFrame) -> DataFrame:
    """``node, root`` of those who may be near copies without a common shingle outside their reference, of ``beside_leaders`` with roots.

    A member's partner has at most ``cap`` shingles, and of two in different
    components one is not in the reference's.
    """
    inside = beside.select("lead", "root", (OF + LIKE) * F.col("common") >= LIKE * (F.col("n") + F.col("ln")))
    home = inside.toDF("lead", "root", "joined").where("joined").groupBy("lead").agg(F.min("root").alias("home"))
    capped = beside.join(home.withColumnRenamed("lead", "by"), F.col("lead") == F.col("by"), "left").select(
        "lead", "node", "n", "root", (F.floor((OF + LIKE) * F.col("common") / LIKE) - F.col("n")).alias("cap"), (~F.col("root").eqNullSafe(F.col("home"))).alias("apart")
    )
    each = capped.groupBy("lead").agg(
        F.min("n").alias("least"), F.max("cap").alias("most"), F.min(F.when(F.col("apart"), F.col("n"))).alias("least_apart"), F.max(F.when(F.col("apart"), F.col("cap"))).alias("most_apart")
    ).withColumnRenamed("lead", "by")
    any_ = F.col("apart") & (F.col("cap") >= F.col("least")) & (F.col("n") <= F.col("most"))
    outer = ~F.col("apart") & (F.col("cap") >= F.col("least_apart")) & (F.col("n") <= F.col("most_apart"))
    return capped.join(each, F.col("lead") == F.col("by")).where(any_ | outer).select("node", "root").distinct()


def finer_keys(sets: DataFrame, level: int) -> DataFrame:
    """``node, n, own, root, keys`` of ``node, own, root, held``."""

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [np.asarray(h, np.int64).view(np.uint64) for h in batch["held"]]
            yield pd.DataFrame({"node": batch["node"], "n": [len(h) for h in held], "own": batch["own"], "root": batch["root"], "keys": [position_keys(h, level).view(np.int64) for h in held]})

    return sets.select("node", "own", "root", "held").mapInPandas(run_task, "node long, n int, own int, root long, keys array<long>")


def tallied(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The count filter: the pairs ``u, v`` that have at least ``LEAST`` of level 0's positional bytes in common, by ``node, bytes``."""
    beside = pairs.select("u", "v").join(nodes.select(F.col("node").alias("u"), F.col("bytes").alias("a")), "u").join(nodes.select(F.col("node").alias("v"), F.col("bytes").alias("b")), "v")
    wide = LEVELS[0][0] * LEVELS[0][1]

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, wide) for c in "ab")
            yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= LEAST))

    return beside.select("u", "v", "a", "b").mapInArrow(run_task, "u long, v long")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose whole sets ``node, held`` have a Jaccard of at least 0.8."""
    whole = pairs.join(sets.select(F.col("node").alias("u"), F.col("held").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("held").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return whole.where(OF * common >= LIKE * (F.size("a") + F.size("b") - common)).select("u", "v")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id``, a row for each row of ``docs``.

    Texts of one shingle set (those without words too) are one node.  A null id
    joins its component, but is never the smallest id; an empty table gives no
    rows.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    printed = materialize(signatures(rows), "near-signatures")
    nodes = materialize(printed.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes")), "near-nodes")
    shared = materialize(postings(nodes.withColumns({"root": F.col("node"), "own": F.lit(0)})), "near-postings")
    # The sets of all nodes that meet any other; a node of null ids alone is looked for among the rows without an id.
    members = materialize(shared.select("node").distinct().join(nodes.select("node", "least", "bytes"), "node"), "near-members")
    ids = members.where("least is not null").select(F.col("least").alias("__id")).hint("shuffle_hash")
    texts = rows.join(ids, rows["doc_id"] == ids["__id"], "left_semi").unionByName(rows.where("doc_id is null"))
    sets = materialize(shingle_sets(texts).join(members.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")
    alone = members.select("node").join(own_shingles(sets), "node", "left").select("node", F.coalesce("alone", F.array().cast("array<long>")).alias("alone"))
    own = materialize(alone.withColumn("own", F.size("alone")), "near-own")
    shared = shared.drop("own").join(own.select("node", "own"), "node")
    roots = docs.sparkSession.createDataFrame([], "node long, root long")

    def link(found: DataFrame) -> None:
        """The components by what is known and the links found."""
        nonlocal roots
        found = materialize(found, "near-links")
        if not found.isEmpty():
            roots = materialize(components(found.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))), "near-roots")

    for level in range(len(LEVELS)):
        last = level == len(LEVELS) - 1
        led = materialize(led_pairs(shared), "near-led")
        link(alike(tallied(led, members), sets))
        apart = materialize(still_apart(shared, roots), "near-apart")
        met = materialize(met_pairs(apart if last else apart.where(F.col("members") <= FEW)).join(led, ["u", "v"], "left_anti"), "near-met")
        large = apart.where(F.col("members") > FEW)
        if last or large.isEmpty():
            link(alike(tallied(met, members), sets))
            break
        beside = materialize(beside_leaders(large, sets, own), "near-beside")
        same = beside.where((OF + LIKE) * F.col("common") >= LIKE * (F.col("n") + F.col("ln"))).select(F.greatest("node", "lead").alias("u"), F.least("node", "lead").alias("v"))
        link(alike(tallied(met, members), sets).unionByName(same).distinct())
        named = materialize(rooted(beside, roots), "near-beside-rooted")
        cells = materialize(residual_postings(named), "near-residuals")
        link(alike(tallied(materialize(met_pairs(cells.where(F.col("members") <= FEW)), "near-close"), members), sets))
        left = still_apart(cells.where(F.col("members") > FEW), roots)
        rest = materialize(rooted(exceptions(named).unionByName(left.select("node", "root")).select("node").distinct(), roots), "near-undecided")
        if rest.isEmpty():
            break
        # Members of large postings that may still have partners are posted again, finer.
        finer = materialize(finer_keys(sets.join(rest, "node").join(own.select("node", "own"), "node"), level + 1), "near-finer")
        shared = materialize(postings(finer), "near-postings")
    named = roots.withColumnRenamed("node", "of")
    placed = nodes.select("node", "least").join(named, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    least = materialize(placed.join(smallest, "root").select(F.col("node").alias("of"), "component_id"), "near-components")
    return printed.join(least, F.col("node") == F.col("of")).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id isn't their component's smallest, with their columns.

    Null texts count as empty; rows without an id stay; rows of one id go
    together; an empty table stays empty.
    """
    gone = materialize(near_copies(docs).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct(), "near-gone")
    # By a shuffle at every size: what goes grows with the documents.
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["__id"], "left_anti")
