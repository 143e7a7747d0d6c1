"""Mixing sources to target weights as a min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern (the
set of their sources); the flow routes token capacity from patterns to source quotas, where
each further repetition of a pattern costs more than the one before (convex). Documents are
then selected by seeded hash until each pattern's flow is met.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.llm.common import staged, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: Lists of more rows than this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 20_000
BINS = 4096
FILL_PASSES = 4
Pattern = tuple[str | None, ...]


def by_code_point(source: str | None) -> tuple[bool, str]:
    """Sort key: code points, null last."""
    return source is None, source or ""


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Shares ``share`` of all sizes by weight; a target stops at ``most`` times its source."""
    order = sorted(sizes, key=by_code_point)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    fixed: dict[str | None, float] = {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed[s] for s in order if s in fixed)
        whole = sum(weight[s] for s in rest)
        goal = {s: left * weight[s] / whole for s in rest}
        over = [s for s in rest if goal[s] > most * sizes[s]]
        if not over:
            return {s: fixed.get(s, goal.get(s, 0.0)) for s in order}
        fixed |= {s: most * sizes[s] for s in over}


def routed(sizes: dict[Pattern, int], quota: dict[str | None, float], repeats: int = 2) -> dict[tuple[Pattern, str | None], float]:
    """The min-cost flow, for each set of sources that shared patterns connect by itself.

    A pattern of one source that no other pattern has takes its quota as far as its repetitions
    go, which is the flow in closed form; so sources that don't overlap cost a step each.
    """
    root = {s: s for s in quota}

    def find(s: str | None) -> str | None:
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    for p in sizes:
        for s in p[1:]:
            root[find(s)] = find(p[0])
    parts: dict[str | None, list[Pattern]] = {}
    for p in sizes:
        if p:
            parts.setdefault(find(p[0]), []).append(p)
    flow = {}
    for own in parts.values():
        if len(own) == 1 and len(own[0]) == 1:
            flow[own[0], own[0][0]] = min(quota[own[0][0]], float(repeats * sizes[own[0]]))
        else:
            flow |= min_cost_flow({p: sizes[p] for p in own}, {s: quota[s] for p in own for s in p}, repeats)
    return flow


def min_cost_flow(sizes: dict[Pattern, int], quota: dict[str | None, float], repeats: int = 2) -> dict[tuple[Pattern, str | None], float]:
    """Tokens from each pattern to each source: as many as quotas allow, at least cost.

    Arcs: start to pattern once for each repetition r (capacity: the pattern's size, cost r),
    pattern to each of its sources, source to sink (capacity: quota). Successive shortest paths.
    """
    patterns = sorted(sizes, key=lambda p: [by_code_point(s) for s in p])
    sources = sorted(quota, key=by_code_point)
    node = {("p", p): i + 2 for i, p in enumerate(patterns)}
    node |= {("s", s): len(patterns) + 2 + i for i, s in enumerate(sources)}
    to, room, cost, out = [], [], [], [[] for _ in range(len(node) + 2)]

    def arc(a: int, b: int, capacity: float, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0.0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    routes = {}
    for p in patterns:
        for r in range(repeats):
            arc(0, node["p", p], float(sizes[p]), r)
        for s in p:
            routes[p, s] = arc(node["p", p], node["s", s], float("inf"), 0)
    for s in sources:
        arc(node["s", s], 1, quota[s], 0)
    least = 1e-6
    while True:
        far, via, queue, queued = {0: 0}, {}, deque([0]), {0}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in out[a]:
                if room[e] > least and far[a] + cost[e] < far.get(to[e], 1 << 60):
                    far[to[e]], via[to[e]] = far[a] + cost[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if 1 not in far:
            return {k: room[e ^ 1] for k, e in routes.items()}
        path, b = [], 1
        while b:
            path.append(via[b])
            b = to[via[b] ^ 1]
        pushed = min(room[e] for e in path)
        for e in path:
            room[e] -= pushed
            room[e ^ 1] += pushed


def mix(documents: DataFrame, members: Column, seed: int = 17, weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """doc_id and members with ``mix_size`` and ``mix_taken`` (words, repetitions counted).

    ``members`` is an array of source names; null names are a source of their own. Each
    document is taken a whole number of times: every document of a pattern as often as its flow
    fills the pattern, and once more those with the smallest seeded hashes until the rest is
    met. Only the hash bin in which the rest runs out is ordered, so no source meets in one
    task; what is still open there is less than the document at which it ran out, and up to
    FILL_PASSES documents that fit, largest first, make it less. So a pattern's taken words are
    at most its flow (rounded) and miss it by less than its largest document. The driver gets
    one row for each pattern; only patterns that overlap cost more than a step each.
    Texts without words (null, empty) have size 0 and take nothing. Rows equal in id and text
    are taken alike. Other columns are ignored. An empty table gives no rows. Reruns give the
    same rows. Texts are read once.
    """
    rows = documents.select("doc_id", F.col("text"), members.alias("members"))
    return _mixed(rows, F.col("members"), False, seed, weights, share, repeats).select("doc_id", "members", "mix_size", "mix_taken")


def repeated(documents: DataFrame, members: Column, seed: int = 17, weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The mix as a corpus: each document as often as it is taken, none if never.

    Columns are those of ``documents``, whatever their names; the rest is as for mix().
    """
    rows = documents.select("doc_id", "text", members.alias("members"), F.struct(*documents.columns).alias("row"))
    mixed = _mixed(rows, F.col("members"), True, seed, weights, share, repeats)
    often = F.when(F.col("mix_size") > 0, (F.col("mix_taken") / F.col("mix_size")).cast("int")).otherwise(0)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), often))).select("row.*")


def _mixed(documents: DataFrame, members: Column, carry: bool, seed: int, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """The rows with mix_size and mix_taken; without ``carry`` only their narrow columns."""
    spark = documents.sparkSession
    full = documents.withColumns(
        {
            "mix_size": word_count(F.col("text")),
            "mix_members": F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))),
            "mix_draw": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")),
        }
    ).withColumn("mix_bin", F.pmod("mix_draw", F.lit(BINS)).cast("int"))
    rows = staged(full.select("doc_id", "members", "mix_size", "mix_members", "mix_draw", "mix_bin"), "mix-sizes")
    if not carry:
        full = rows
    found = sorted(rows.groupBy("mix_members").agg(F.sum("mix_size").alias("size")).collect(), key=lambda r: [by_code_point(s) for s in r["mix_members"]])
    sizes: dict[Pattern, int] = {tuple(r["mix_members"]): int(r["size"]) for r in found}
    by_name: dict[str | None, int] = {}
    for p, size in sizes.items():
        for s in p:
            by_name[s] = by_name.get(s, 0) + size
    flow = routed(sizes, targets(by_name, weights, share, float(repeats)), repeats) if by_name else {}
    plan: list[tuple[int, list[str | None], int, int]] = []
    for i, (p, size) in enumerate(sizes.items()):
        tokens = round(sum(flow.get((p, s), 0.0) for s in p))
        whole = min(repeats, tokens // size) if size else 0
        plan.append((i, list(p), whole, tokens - whole * size if whole < repeats else 0))

    # every list below has a row or FILL_PASSES rows for each pattern
    def small(data: list, schema: str) -> DataFrame:
        rows = spark.createDataFrame(data, schema)
        return F.broadcast(rows) if len(data) <= BROADCAST_ROWS else rows

    def planned(df: DataFrame, plans: DataFrame) -> DataFrame:
        return df.join(plans, df["mix_members"].eqNullSafe(plans["mix_plan_for"])).drop("mix_plan_for")

    opened = planned(rows, small([(i, p, rest) for i, p, _, rest in plan], "mix_pattern int, mix_plan_for array<string>, mix_open long"))
    upto = Window.partitionBy("mix_pattern").orderBy("mix_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = opened.groupBy("mix_pattern", "mix_bin").agg(F.sum("mix_size").alias("held"), F.first("mix_open").alias("open"))
    bins = bins.withColumn("after", F.sum("held").over(upto)).where("after > open")
    cuts = bins.groupBy("mix_pattern").agg(F.min(F.struct("mix_bin", (F.col("open") - F.col("after") + F.col("held")).alias("rest"))).alias("cut"))
    cut = {r["mix_pattern"]: (r["cut"]["mix_bin"], r["cut"]["rest"]) for r in cuts.collect()}
    plans = small([(i, p, whole, *cut.get(i, (BINS, 0))) for i, p, whole, _ in plan], "mix_pattern int, mix_plan_for array<string>, mix_whole long, mix_cut int, mix_rest long")
    known = planned(rows, plans)
    in_cut = Window.partitionBy("mix_pattern").orderBy("mix_draw").rangeBetween(Window.unboundedPreceding, 0)
    at = known.where("mix_bin = mix_cut").withColumn("upto", F.sum("mix_size").over(in_cut)).where("upto <= mix_rest")
    at = staged(at.groupBy("mix_pattern", "mix_draw").agg(F.sum("mix_size").alias("size")), "mix-cut")

    # what the cut leaves open is smaller than one document: fill it with single ones that fit
    left = {i: rest for i, (_, rest) in cut.items()}
    for r in at.groupBy("mix_pattern").agg(F.sum("size").alias("size")).collect():
        left[r["mix_pattern"]] -= r["size"]
    picked: list[tuple[int, int, bool]] = []
    pick_schema = "mix_pattern int, mix_draw long, mix_pick boolean"
    spare = known.where("mix_bin >= mix_cut and mix_size > 0").join(at, ["mix_pattern", "mix_draw"], "left_anti")
    for _ in range(FILL_PASSES):
        still = [(i, rest) for i, rest in left.items() if rest > 0]
        if not still:
            break
        fits = spare.join(small(still, "mix_pattern int, gap long"), "mix_pattern").where("mix_size <= gap")
        fits = fits.join(small(picked, pick_schema), ["mix_pattern", "mix_draw"], "left_anti")
        best = fits.groupBy("mix_pattern").agg(F.max(F.struct("mix_size", "mix_draw")).alias("best")).collect()
        if not best:
            break
        for r in best:
            picked.append((r["mix_pattern"], r["best"]["mix_draw"], True))
            left[r["mix_pattern"]] -= r["best"]["mix_size"]

    full = planned(full, plans).join(small(picked, pick_schema), ["mix_pattern", "mix_draw"], "left")
    chosen = at.select("mix_pattern", "mix_draw", F.lit(True).alias("mix_at"))
    inside = full.where("mix_bin = mix_cut").join(chosen, ["mix_pattern", "mix_draw"], "left")
    full = full.where("mix_bin <> mix_cut").withColumn("mix_at", F.col("mix_bin") < F.col("mix_cut")).unionByName(inside)
    extra = F.coalesce(F.col("mix_at"), F.lit(False)) | F.coalesce(F.col("mix_pick"), F.lit(False))
    return full.withColumn("mix_taken", (F.col("mix_whole") + extra.cast("long")) * F.col("mix_size"))


def by_source(mixed: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, tuple[int, float]]:
    """Size and target of each source, from rows of mix(): one entry a source.

    A source that only texts without words have is there with size and target 0; rows without
    members have no source; repeated rows count each; an empty table gives no entries.
    """
    found = mixed.select("mix_size", F.explode(F.array_distinct("members")).alias("source")).groupBy("source").agg(F.sum("mix_size").alias("size")).collect()
    sizes = {r["source"]: int(r["size"]) for r in found}
    return {s: (sizes[s], goal) for s, goal in targets(sizes, weights, share, most).items()} if sizes else {}
