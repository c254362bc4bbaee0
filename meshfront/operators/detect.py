"""Shock centers, walks out of the shock zone, and Mach numbers."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from meshfront.functions.physics import mach_from_temperature_jump, norm
from meshfront.operators import within
from meshfront.plans.settings import Settings
from meshfront.plans.ship import ship
from meshfront.plans.storage import materialize, materialize_by, release, together

#: The diagnostics in order.
COUNTERS = ("center_step_limit", "upstream_missing_neighbor", "upstream_step_limit", "downstream_missing_neighbor", "downstream_step_limit", "candidate_exit", "thermodynamic_exit", "nonconverging_exit", "invalid_jump", "mach_rejected")
#: Walks that a round by row may broadcast, about 200 bytes each, and the steps it then makes; steps that a walk makes in its block before the next round.
FEW, HOPS, HERE = 100_000, 8, 64
_STATE = ("x", "y", "z", "temp", "rho", "divv", "candidate", "nx", "ny", "nz")
#: What a walk needs of a neighbour.
_WALKED = ("face", "slot", "nbr_id", *_STATE[:7])
#: What is kept of the cell in which a walk ended.
_MET = ("nbr_id", "x", "y", "z", "temp", "rho")
#: Why a walk ended.
_REASONS = ("missing", "step_limit", "nonconverging", "thermodynamic", "candidate")


def probes(stencil: DataFrame, links: DataFrame) -> DataFrame:
    """A row for each candidate with all it needs for a step: its own state and ``faces``, an array of at most 24 neighbours with theirs.

    Walks and center searches only stand on candidates, so the other cells' links are dropped before the join that fetches neighbours.
    """
    blocks = getattr(links, "blocks", None)
    if blocks is None:
        candidates = stencil.where("candidate")
        near = links.join(candidates.select("row_id"), "row_id", "left_semi")
        packed = near.join(stencil.select(F.col("row_id").alias("nbr_id"), *_STATE), "nbr_id").groupBy("row_id").agg(F.collect_list(F.struct("face", "slot", "nbr_id", *_STATE)).alias("faces"))
        return candidates.select("row_id", "dx", *_STATE).join(packed, "row_id", "left")
    # Only guests move, to the blocks that they touch; a neighbour is one of the block's own cells or a guest.
    at = ["block", "nbr_id"]
    guests = materialize_by(stencil.select(F.explode("also").alias("block"), F.col("row_id").alias("nbr_id"), F.struct(*_STATE, F.col("block").alias("home")).alias("guest")), "guests", "block", blocks.buckets)
    own = stencil.select("block", F.col("row_id").alias("nbr_id"), F.struct(*_STATE, F.col("block").alias("home")).alias("own"))
    candidates = stencil.where("candidate").select("block", "row_id", "dx", *_STATE)
    near = links.join(candidates.select("block", "row_id").hint("shuffle_hash"), ["block", "row_id"], "left_semi")
    met = near.join(own.hint("shuffle_hash"), at, "left").join(guests.hint("shuffle_hash"), at, "left").withColumn("s", F.coalesce("own", "guest"))
    packed = met.groupBy("block", "row_id").agg(F.collect_list(F.struct("face", "slot", "nbr_id", (F.col("kind") == "fine").alias("fine"), *(F.col(f"s.{c}").alias(c) for c in (*_STATE, "home")))).alias("faces"))
    return candidates.join(packed, ["block", "row_id"], "left")


def stepped(stencil: DataFrame, links: DataFrame, settings: Settings) -> DataFrame:
    """The written probes with next_centers(): bucketed by block if the links know their blocks, else by row_id."""
    blocks = getattr(links, "blocks", None)
    if blocks is None:
        return materialize_by(next_centers(probes(stencil, links), settings), "stepped", "row_id")
    ship(stencil.sparkSession)
    state = ("row_id", "dx", *_STATE)
    guests = materialize_by(stencil.select(F.explode("also").alias("lies"), *state, F.col("block").alias("home")), "guests", "lies", blocks.buckets)
    cells = stencil.select(F.col("block").alias("lies"), *state, F.lit(True).alias("own"), F.lit(0).cast("long").alias("home")).unionAll(guests.select("lies", *state, F.lit(False), "home"))  # in the same buckets, as is their union
    near = links.select(F.col("block").alias("lies"), "row_id", "face", "slot", "kind", "nbr_id")
    step = within.stepped(settings.center_plateau_tolerance, settings.center_normal_cosine, tuple(_REASONS.index(r) + 1 for r in ("nonconverging", "thermodynamic", "candidate")))
    with together(stencil.sparkSession):
        made = cells.groupBy("lies").cogroup(near.groupBy("lies")).applyInArrow(step, within.STEPPED)
    return materialize_by(made, "stepped", "block", blocks.buckets, lies=True)


def _exit(start: list[Column], way: list[Column]) -> Column:
    """``struct(t, face)`` where a ray leaves the cell; the lowest axis wins a tie; null if it never does."""
    hits = []
    for a, (c, p, d) in enumerate(zip("xyz", start, way, strict=True)):
        t = F.when(d > 1e-14, (F.col(c) + F.col("dx") / 2 - p) / d).when(d < -1e-14, (F.col(c) - F.col("dx") / 2 - p) / d)
        hits.append(F.when(t > 1e-14, F.struct(t.alias("t"), (F.lit(2 * a) + (d > 0).cast("int")).alias("face"))))
    return F.array_min(F.array(*hits))


def _across(face: Column, point: list[Column]) -> Column:
    """The neighbour beyond a face: the nearest to the point, the lowest slot of equals. A face with a direct link has only that."""

    def ranked(f: Column) -> Column:
        far = sum((f[c] - p) * (f[c] - p) for c, p in zip("xyz", point, strict=True))
        return F.struct(far.alias("far"), f["slot"].alias("slot"), f.alias("cell"))

    return F.array_min(F.transform(F.filter("faces", lambda f: f["face"] == face), ranked))["cell"]


def _step(df: DataFrame, start: list[Column], way: list[Column], prefix: str) -> DataFrame:
    """Adds the point just past the face, as ``<prefix>p*``, and the neighbour there, ``<prefix>``."""
    df = df.withColumn(f"{prefix}_exit", _exit(start, way))
    reach = F.col(f"{prefix}_exit.t") + F.greatest("dx", F.lit(1.0)) * 1e-10
    df = df.withColumns({f"{prefix}p{c}": p + d * reach for c, p, d in zip("xyz", start, way, strict=True)})
    return df.withColumn(prefix, _across(F.col(f"{prefix}_exit.face"), [F.col(f"{prefix}p{c}") for c in "xyz"])).drop(f"{prefix}_exit")


def next_centers(probe: DataFrame, settings: Settings) -> DataFrame:
    """Each candidate with ``next_id``, the better of itself and the aligned candidates up and down its normal. No join: the neighbours are in the row. What is left of ``faces`` is what walks need."""
    here, way = [F.col(c) for c in "xyz"], [F.col(f"n{c}") for c in "xyz"]
    df = _step(_step(probe, here, way, "up"), here, [-d for d in way], "down")
    df = df.withColumns({"best": F.struct(F.col("divv").alias("divv"), F.col("row_id").alias("id"))})
    for side in ("up", "down"):
        t, b = F.col(side), F.col("best")
        slack = F.greatest(F.lit(1.0), F.abs(b["divv"]), F.abs(t["divv"])) * settings.center_plateau_tolerance
        turned = sum(t[f"n{c}"] * d for c, d in zip("xyz", way, strict=True))
        aligned = (norm(t["nx"], t["ny"], t["nz"]) > 0) & (F.abs(turned) >= settings.center_normal_cosine)
        lower = (t["divv"] < b["divv"] - slack) | ((F.abs(t["divv"] - b["divv"]) <= slack) & (t["nbr_id"] < b["id"]))
        df = df.withColumn("best", F.when(t.isNotNull() & t["candidate"] & aligned & lower, F.struct(t["divv"].alias("divv"), t["nbr_id"].alias("id"))).otherwise(b))
    if "block" in probe.columns:
        return df.select("block", "row_id", *"xyz", "dx", *(f"n{c}" for c in "xyz"), _walked().alias("faces"), F.col("best.id").alias("next_id"))
    walked = F.transform("faces", lambda f: F.struct(*(f[c].alias(c) for c in _WALKED)))
    return df.select(*(walked.alias(c) if c == "faces" else c for c in probe.columns), F.col("best.id").alias("next_id"))


def _walked() -> Column:
    """``faces`` with ``why`` a walk that steps onto the neighbour ends there, as its place in _REASONS from 1, or null if it goes on. A neighbour's place is kept where a walk may end or has to choose among finer cells, its temperature and density where it may end."""

    def judged(f: Column) -> Column:
        against = (f["temp"] - F.col("temp")) * (f["rho"] - F.col("rho")) <= 0
        why = F.when(f["divv"] >= 0, _REASONS.index("nonconverging") + 1).when(against, _REASONS.index("thermodynamic") + 1).when(~f["candidate"], _REASONS.index("candidate") + 1)
        return F.struct(f.alias("f"), why.alias("why"))

    def slim(j: Column) -> Column:
        f, ends = j["f"], j["why"].isNotNull()
        state = [*(F.when(ends | f["fine"], f[c]).alias(c) for c in "xyz"), *(F.when(ends, f[c]).alias(c) for c in ("temp", "rho"))]
        return F.struct(*(f[c].alias(c) for c in ("face", "slot", "nbr_id", "home")), j["why"].alias("why"), *state)

    return F.transform(F.transform("faces", judged), slim)


def centers(stepped: DataFrame) -> DataFrame:
    """A candidate with a direction is a center if and only if no step leads away from it; whatever path arrives there, it resolves to itself."""
    return stepped.where((F.col("next_id") == F.col("row_id")) & (norm("nx", "ny", "nz") > 0))


def long_paths(stepped: DataFrame, limit: int) -> int:
    """How many starts, in row order, need more than ``limit`` moves to a center or to a row that an earlier start has resolved.

    A start resolves its whole path, so what is resolved includes all that lies ahead of it: a start finds a resolved row within ``limit`` moves if and only if the row just ``limit`` moves
    ahead is resolved by then. ``first`` of a row is the earliest start that resolves it. Starts no farther than ``limit`` from their center are known at once; each round then
    adds those whose mark has an earlier ``first``, until none is added. Jumps double their length, so depths, marks and the way of ``first`` ahead take a logarithm of the longest path in joins.
    """
    # Centers stay where they are and are nobody's mark, so the tables hold the rows that move alone.
    hops = [materialize(stepped.where("row_id <> next_id").select("row_id", F.col("next_id").alias("to"), F.lit(1).cast("long").alias("span")), "jumps")]  # hops[k]: 2**k moves ahead, or the center
    while True:
        now, seen = hops[-1], Observation()
        then = now.select(F.col("row_id").alias("mid"), F.col("to").alias("then"), F.col("span").alias("more"))
        met = now.join(then, F.col("to") == F.col("mid"), "left").observe(seen, F.count("mid").alias("moved"))
        hops.append(materialize(met.select("row_id", F.coalesce("then", "to").alias("to"), (F.col("span") + F.coalesce("more", F.lit(0))).alias("span")), "jumps"))
        if not seen.get["moved"]:
            break
    deep = hops[-1].where(F.col("span") > limit).select("to").distinct()
    if deep.isEmpty():
        for h in hops:
            release(h)
        return 0
    # A row is resolved from behind, along ways to its own center, so the other centers' rows are left out.
    rows = materialize(hops[-1].join(deep, "to", "left_semi").select("row_id", F.col("span").alias("depth")), "deep")
    ways = [materialize(h.join(rows.select("row_id"), "row_id", "left_semi"), "jumps") for h in hops]
    for h in hops:
        release(h)
    mark = rows.where(F.col("depth") > limit).select("row_id", F.col("row_id").alias("mark"))
    for k in range(limit.bit_length()):
        if limit >> k & 1:
            step = ways[min(k, len(ways) - 1)].select(F.col("row_id").alias("mid"), F.col("to").alias("then"))
            mark = mark.join(step, F.col("mark") == F.col("mid")).select("row_id", F.col("then").alias("mark"))
    marks = materialize(mark, "marks")

    def spread(first: DataFrame) -> DataFrame:
        """The least ``first`` of each row and of all rows behind it. Each step is written, since it reads the one before twice."""
        for k, h in enumerate(ways):
            onward = first.join(h.select("row_id", "to"), "row_id").select(F.col("to").alias("row_id"), "first")
            further = materialize(first.unionAll(onward).groupBy("row_id").agg(F.min("first").alias("first")), "firsts")
            if k:
                release(first)
            first = further
        return first

    near = rows.where(F.col("depth") <= limit).select("row_id", F.col("row_id").alias("first"))
    done, known = 0, materialize(near, "known")
    while True:
        first = spread(known)
        release(known)
        seen = Observation()
        late = materialize(marks.join(first.select(F.col("row_id").alias("mark"), "first"), "mark").where("first < row_id").select("row_id", F.col("row_id").alias("first")).observe(seen, F.count(F.lit(1)).alias("n")), "late")
        release(first)
        if seen.get["n"] == done:
            break
        done, known = seen.get["n"], materialize(near.unionAll(late), "known")
        release(late)
    failed = marks.count() - done
    for df in (*ways, rows, marks, late):
        release(df)
    return failed


def _wall(c: str, axis: int) -> str:
    """``struct(t, face)`` where a ray meets the walls of its cell along one axis, or null."""
    t = f"CASE WHEN u{c} > 1e-14D THEN ({c} + dx / 2 - p{c}) / u{c} WHEN u{c} < -1e-14D THEN ({c} - dx / 2 - p{c}) / u{c} END"
    return f"CASE WHEN ({t}) > 1e-14D THEN struct(({t}) AS t, {2 * axis} + CAST(u{c} > 0 AS INT) AS face) END"


#: The neighbour nearest to where a walk leaves its cell, in its row's ``faces``.
_TRIAL = f"""array_min(transform(filter(faces, f -> f.face = hit.face), f -> struct({" + ".join(f"(f.{c} - q{c}) * (f.{c} - q{c})" for c in "xyz")} AS far, f.slot AS slot, f AS cell))).cell AS trial"""
#: One move of every walk under way, as _step() makes it. Those that have ended stand on the trap cell -1 and stay as they are. As text it costs one analysis a move.
_HOP = f"""
SELECT row_id, way, {", ".join(f"IF(reason IS NULL, q{c}, p{c}) AS p{c}" for c in "xyz")}, ux, uy, uz, IF(reason IS NULL, trial, end) AS end,
 coalesce(reason, CASE WHEN trial IS NULL THEN 'missing' WHEN trial.divv >= 0 THEN 'nonconverging' WHEN (trial.temp - temp) * (trial.rho - rho) <= 0 THEN 'thermodynamic' WHEN NOT trial.candidate THEN 'candidate' END) AS reason
FROM (SELECT *, {_TRIAL}
 FROM (SELECT *, {", ".join(f"p{c} + u{c} * (hit.t + greatest(dx, 1D) * 1e-10D) AS q{c}" for c in "xyz")}
  FROM (SELECT {{hint}} f.*, s.x, s.y, s.z, s.dx, s.temp, s.rho, s.faces, array_min(array({", ".join(_wall(c, a) for a, c in enumerate("xyz"))})) AS hit
   FROM {{{{front}}}} f JOIN {{{{state}}}} s ON s.at = IF(f.reason IS NULL, f.end.nbr_id, -1L))))"""

def _hop(front: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    return front.sparkSession.sql(_HOP.format(hint="/*+ BROADCAST(f) */" if few else ""), front=front, state=state)


@contextmanager
def _plain_planning(spark: SparkSession):
    """Without inferred constraints: over the moves of a walk they take the optimizer far longer than the moves take to run, and no filter can use them."""
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def walks(probe: DataFrame, starts: DataFrame, max_steps: int, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """``(row_id, way, reason, end)`` of both walks from each of ``starts``, against (-1) and along (1) its normal; ``end`` is the first cell outside the zone, or null. In blocks also ``start``, the block of the walk's start.

    Both go on together, so that they share rounds. A round joins the walks still under way with the probes and is written to the shared folder; its count comes with the write. ``probe`` is best a table bucketed by row_id
    (materialize_by()): then a round shuffles the walks alone, of some 300 bytes each, and never the probes with their neighbours. Walks only stand on candidates, and they thin out fast. Once at most FEW are left, a round makes
    twice the steps of the last, up to HOPS, each of which broadcasts the few walks, so a long tail costs few jobs. Probes bucketed by block: _walks_in_blocks().
    """
    if "block" in probe.columns:
        return _walks_in_blocks(probe, starts, max_steps, report)
    spark, kind = probe.sparkSession, probe.schema["faces"].dataType.elementType
    only = lambda row: F.struct(*((row if f.name == "nbr_id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields))
    going = F.col("reason").isNull()
    met = F.struct(*((F.col(f"end.{f.name}") if f.name in _MET else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields))
    slim = {**{f"{k}{c}": F.when(going, F.col(f"{k}{c}")) for k in "pu" for c in "xyz"}, "end": F.when(going, only(F.col("end.nbr_id"))).when(F.col("end").isNotNull(), met)}
    ways = starts.select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("way"))
    front = ways.select("row_id", "way", *(F.col(c).alias(f"p{c}") for c in "xyz"), *((F.col(f"n{c}") * F.col("way")).alias(f"u{c}") for c in "xyz"), only(F.col("row_id")).alias("end"), F.lit(None).cast("string").alias("reason"))
    state = probe.select(F.col("row_id").alias("at"), "temp", "rho", "x", "y", "z", "dx", "faces")
    trap = spark.range(1).select(*(F.lit(-1).cast("long").alias(f.name) if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema.fields))
    ended, left, done, ahead = [], None, 0, 1
    with _plain_planning(spark), together(spark):
        while done < max_steps and left != 0:
            few = left is not None and left <= FEW
            hops = min(ahead if few else 1, max_steps - done)
            ahead = min(2 * ahead, HOPS) if few else 1
            df, cells = front, state.unionAll(trap) if few else state
            for _ in range(hops):
                df = _hop(df, cells, few)
            seen = Observation()
            df = materialize(df.withColumns(slim).observe(seen, F.count_if(going).alias("left")), "walk")
            left, done = seen.get["left"], done + hops
            if report:
                report(done, left)
            ended.append(df.select("row_id", "way", "reason", "end").where("reason IS NOT NULL"))
            front = df.where("reason IS NULL")
    if left != 0:
        ended.append(front.select("row_id", "way", F.lit("step_limit").alias("reason"), F.lit(None).cast(kind).alias("end")))
    return reduce(DataFrame.unionAll, ended)


def _walks_in_blocks(probe: DataFrame, starts: DataFrame, max_steps: int, report: Callable[[int, int], None] | None) -> DataFrame:
    """Walks go on within their block until they end or leave it, up to HERE moves a round, so a round reads each block once, whatever the number of moves. The first round, in which most walks end, shuffles nothing; those that
    left their block are shuffled to the next, and only the blocks in which walks stand are handed out again."""
    ship(probe.sparkSession)
    spark, at = probe.sparkSession, ["row_id", "way", "start", "block", "moves", *(f"{k}{c}" for k in "pu" for c in "xyz"), "at"]
    cells = probe.select(F.col("block").alias("lies"), F.col("row_id").alias("cell"), "x", "y", "z", "dx", F.coalesce("faces", F.array().cast(probe.schema["faces"].dataType)).alias("faces"))
    ways = starts.select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("way"))
    front = ways.select("row_id", "way", F.col("block").alias("start"), "block", F.lit(0).alias("moves"), *(F.col(c).alias(f"p{c}") for c in "xyz"), *((F.col(f"n{c}") * F.col("way")).alias(f"u{c}") for c in "xyz"), F.col("row_id").alias("at"))
    move = within.moved(max_steps, HERE, _REASONS.index("missing") + 1, _REASONS.index("step_limit") + 1)
    end = F.when((F.col("code") > 0) & (F.col("at") >= 0), F.struct(F.col("at").alias("nbr_id"), *(F.col(f"end_{c}").alias(c) for c in within.MET)))
    going = F.col("code") == 0
    rounds, left = [], None
    with together(spark):
        while left != 0:
            part = cells
            if rounds:
                front = front.repartition(probe.buckets, "block")
                part = cells.join(F.broadcast(front.select(F.col("block").alias("lies")).distinct()), "lies", "left_semi")
            df = part.groupBy("lies").cogroup(front.select(F.col("block").alias("here"), *at).groupBy("here")).applyInArrow(move, within.WALK)
            seen = Observation()
            slim = {f"{k}{c}": F.when(going, F.col(f"{k}{c}")) for k in "pu" for c in "xyz"}
            df = df.select("row_id", "way", "start", "block", "moves", *(v.alias(k) for k, v in slim.items()), F.when(going, F.col("at")).alias("at"), end.alias("end"), F.get(F.array(*(F.lit(r) for r in _REASONS)), F.col("code") - 1).alias("reason"))
            df = df.observe(seen, F.count_if(F.col("reason").isNull()).alias("left"), F.min(F.when(F.col("reason").isNull(), F.col("moves"))).alias("done"))
            df = materialize(df, "walk") if rounds else materialize_by(df, "walk", "start", probe.buckets, lies=True)
            left = seen.get["left"]
            if report:
                report(seen.get["done"] or max_steps, left)
            rounds.append(df.select("row_id", "way", "reason", "end", "start"))
            front = df.where("reason IS NULL")
    ended = [r.where("reason IS NOT NULL") for r in rounds]
    out = reduce(DataFrame.unionAll, ended)
    out.rounds = [rounds[0], *ended[1:]]  # all walks are in the first
    return out


def paired(walked: DataFrame, buckets: int | None = None) -> DataFrame:
    """``(row_id, up_reason, u, down_reason, d)``: both walks of each start, with the cells in which they ended. In blocks its ``block`` as well, and planned with together() only walks that the first round left under way are shuffled."""
    key = ["start"] if "start" in walked.columns else []
    code = F.array_position(F.array(*(F.lit(r) for r in _REASONS)), F.col("reason"))
    # One fold a plain value, so that they are kept in a hash table.
    folds = [F.max(F.when((F.col("way") == way) & F.col("reason").isNotNull(), F.col(c))).alias(f"{k}_{c}") for k, way in (("u", -1), ("d", 1)) for c in ("reason", *_MET)]
    folded = lambda df: df.select(*key, "row_id", "way", code.alias("reason"), *(F.col(f"end.{c}").alias(c) for c in _MET)).groupBy(*key, "row_id").agg(*folds)
    first, *later = getattr(walked, "rounds", [walked]) if key else [walked]
    both = folded(first)
    if later:
        names = [c for c in both.columns if c not in (*key, "row_id")]
        # The first round has a row for every walk, so none of the rest is without it.
        rest = folded(reduce(DataFrame.unionAll, later).repartition(buckets, "start")).withColumnsRenamed({c: f"{c}_later" for c in names})
        met = both.join(rest.hint("shuffle_hash"), [*key, "row_id"], "left")
        both = met.select(*key, "row_id", *(F.coalesce(c, f"{c}_later").alias(c) for c in names))
    out = [F.col("start").alias("block")] if key else []
    for k, side in (("u", "up"), ("d", "down")):
        out += [F.element_at(F.array(*(F.lit(r) for r in _REASONS)), F.col(f"{k}_reason").cast("int")).alias(f"{side}_reason"), F.when(F.col(f"{k}_nbr_id").isNotNull(), F.struct(*(F.col(f"{k}_{c}").alias(c) for c in _MET))).alias(k)]
    return both.select("row_id", *out)


def jumps(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Starts of paired() with both ends, ``mach`` and ``reason`` (null for a shock)."""
    df = pairs.where(F.col("u").isNotNull() & F.col("d").isNotNull())
    before = F.greatest(F.col("u.temp"), F.lit(settings.temperature_floor))
    rises = (F.col("d.temp") > before) & (F.col("d.rho") > F.col("u.rho"))
    mach = F.when(rises, mach_from_temperature_jump(F.col("d.temp") / before, settings.gamma))
    df = df.withColumn("mach", mach)
    return df.withColumn("reason", F.when(F.col("mach").isNull(), "invalid_jump").when(F.col("mach") < settings.min_mach * (1 - 1e-12), "mach_rejected"))


def finalize(cells: DataFrame, judged: DataFrame) -> DataFrame:
    """One row for each retained cell: ``row_id, mach, shock, center_index, upstream_index, downstream_index, x, y, z, dx, nx, ny, nz, level, zone_width``; -1 and 0 where there is no shock. Beside them ``up_temp`` and ``up_rho`` of the upstream cell.

    Cells and jumps that know their ``block`` meet there.
    """
    key = ["block", "row_id"] if "block" in cells.columns and "block" in judged.columns else ["row_id"]
    gap = [F.col(f"d.{c}") - F.col(f"u.{c}") for c in "xyz"]
    found = judged.where("reason IS NULL").select(*key, "mach", F.col("u.nbr_id").alias("up"), F.col("d.nbr_id").alias("down"), F.col("u.temp").alias("up_temp"), F.col("u.rho").alias("up_rho"), norm(*gap).alias("far"), *(g.alias(f"g{c}") for g, c in zip(gap, "xyz", strict=True)))
    df = cells.select(*key, "x", "y", "z", "dx", "level").join(found.hint("shuffle_hash") if len(key) > 1 else found, key, "left")
    unit = [F.when(F.col("far") > 0, F.col(f"g{c}") / F.col("far")).otherwise(0.0).alias(f"n{c}") for c in "xyz"]
    none = F.lit(-1).cast("long")
    return df.select(
        *key, F.coalesce("mach", F.lit(0.0)).alias("mach"), F.col("mach").isNotNull().alias("shock"), F.when(F.col("mach").isNotNull(), F.col("row_id")).otherwise(none).alias("center_index"),
        F.coalesce("up", none).alias("upstream_index"), F.coalesce("down", none).alias("downstream_index"), "x", "y", "z", "dx", *unit, "level", F.coalesce("far", F.lit(0.0)).alias("zone_width"), "up_temp", "up_rho",
    )


def diagnostics(up: DataFrame, down: DataFrame, judged: DataFrame, center_limit: int) -> DataFrame:
    """One row with the ten counters. The exits count for both walks."""
    names = {"missing": "missing_neighbor", "step_limit": "step_limit", "candidate": "candidate_exit", "thermodynamic": "thermodynamic_exit", "nonconverging": "nonconverging_exit"}
    rows = None
    for df, side in ((up, "upstream_"), (down, "downstream_"), (judged, "")):
        own = F.col("reason")
        for k, v in names.items():
            own = F.when(F.col("reason") == k, (side if k in ("missing", "step_limit") else "") + v).otherwise(own)
        part = df.where("reason IS NOT NULL").select(own.alias("reason"))
        rows = part if rows is None else rows.unionAll(part)
    counts = [F.count_if(F.col("reason") == c).alias(c) for c in COUNTERS[1:]]
    return rows.agg(*counts).select(F.lit(center_limit).cast("long").alias(COUNTERS[0]), *COUNTERS[1:])


def retained_rank(result: DataFrame) -> DataFrame:
    """Dense position of each retained row in row order, for exports to arrays."""
    return sequential(result, [F.col("row_id")], "rank")


def sequential(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers from 0 in an order over all rows without one task seeing them all: a range sort, then each partition's count ahead of it."""
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))  # a row for each partition
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("_part", part).join(F.broadcast(ahead), "_part").select(*df.columns, (F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))
