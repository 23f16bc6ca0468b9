"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents with the same set of sources are one pattern; only the patterns' word totals meet on the driver. A pattern offers
its words once for cost 1, again for cost 2, and so on (convex repetition costs); a source takes words from any pattern it is
part of until its quota is met. The flow of least cost says how often each pattern is used; documents are then selected in a
seeded order, whole ones only, cutting where the pattern's words are met.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.plans.stage import stage

#: Weights of sources in order of their names, repeating.
CYCLE = (5.0, 2.0, 1.0)
#: Words of the mix as a share of all words; most often that a document is used.
SHARE, REPEATS = 1.5, 2
#: The seeded order is cut into this many equal ranges, of which only the one holding the cut is sorted.
RANGES = 4096


def word_count(text: str | Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def water_fill(sizes: list[float], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is cut off goes to the others by weight."""
    out, left = [0.0] * len(sizes), set(range(len(sizes)))
    rest = min(total, most * sum(sizes))
    for i in sorted(left, key=lambda i: most * sizes[i] / weights[i]):
        level = rest / sum(weights[j] for j in left)
        if level * weights[i] <= most * sizes[i]:
            for j in left:
                out[j] = level * weights[j]
            break
        out[i] = float(most * sizes[i])
        rest -= out[i]
        left.discard(i)
    return out


def min_cost_flow(patterns: list[tuple[list, int]], quotas: dict, repeats: int) -> list[dict]:
    """Words that each pattern (members, words) gives to each source: most words first, then least repetition cost.

    Shortest augmenting paths on the residual network. Patterns that share no source do not meet: each connected part of the
    pattern-source graph is solved alone, so disjoint sources cost one path each.
    """
    flow: list[dict] = [{m: 0.0 for m in members} for members, _ in patterns]
    used = [0.0] * len(patterns)
    need = dict(quotas)
    holders: dict = {}
    for p, (members, _) in enumerate(patterns):
        for m in members:
            holders.setdefault(m, []).append(p)

    def rank(p: int) -> float | None:
        """Cost of the next word of a pattern."""
        words = patterns[p][1]
        epoch = int(used[p] // words) if words else repeats
        return None if epoch >= repeats or repeats * words - used[p] < 1e-6 else epoch + 1.0

    for part in _parts(patterns):
        while True:
            # cheapest way from any pattern with words left to any source with need, through sources that hand words over
            best = {p: (rank(p), p, None) for p in part if rank(p) is not None}
            queue = sorted(best, key=lambda p: (best[p][0], p))
            goal, done = None, set()
            seen_sources: dict = {}
            while queue and goal is None:
                p = queue.pop(0)
                if p in done:
                    continue
                done.add(p)
                for m in patterns[p][0]:
                    if m in seen_sources:
                        continue
                    seen_sources[m] = p
                    if need.get(m, 0) > 1e-6:
                        goal = m
                        break
                    for q in holders[m]:
                        if q not in done and flow[q][m] > 1e-6 and (q not in best or best[p][0] < best[q][0]):
                            best[q] = (best[p][0], best[p][1], m)
                            queue.insert(0, q)
            if goal is None:
                break
            path, m = [], goal
            while m is not None:
                p = seen_sources[m]
                path.append((p, m))
                m = best[p][2]
            first = path[-1][0]
            words = patterns[first][1]
            amount = min(need[goal], words * (int(used[first] // words) + 1) - used[first])
            for (p, _), (_, back) in zip(path, path[1:]):
                amount = min(amount, flow[p][back])
            for at, (p, m) in enumerate(path):
                flow[p][m] += amount
                if at + 1 < len(path):
                    flow[p][path[at + 1][1]] -= amount
            used[first] += amount
            need[goal] -= amount
            if words * (int(used[first] // words) + 1) - used[first] < 1e-6:
                used[first] = float(round(used[first]))
    return flow


def _parts(patterns: list[tuple[list, int]]) -> list[list[int]]:
    """Indexes of patterns that are connected through sources."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, (members, _) in enumerate(patterns):
        for m in members:
            root[find(("s", m))] = find(("p", p))
    groups: dict = {}
    for p in range(len(patterns)):
        groups.setdefault(find(("p", p)), []).append(p)
    return list(groups.values())


def mix(docs: DataFrame, memberships: Column, size: Column, weights: tuple = CYCLE, share: float = SHARE, repeats: int = REPEATS, seed: int = 7,
        id_column: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: a struct ``row`` of ``keep``, size, copies, taken (= size x copies), quota_source, source_size, target.

    ``memberships`` is an array of source names; a null name is a source of its own, after all others; a null or empty array
    belongs to none and is never taken. Sources weigh ``weights`` in order of their names by code point, repeating. Targets
    are ``share`` of all words by weight, none above ``repeats`` times its source. Documents of size 0 are used as often as
    their pattern's whole rounds. The order is the hash of seed and id, then size: reruns agree; repeated rows are told apart
    by their place in the staged table, which does not change what a source takes.
    Only one row per pattern reaches the driver.
    """
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(F.coalesce(memberships, F.array().cast("array<string>"))))
    staged = stage(
        docs.select(
            F.struct(*keep).alias("row"), size.alias("size"), members.alias("pattern"),
            F.xxhash64(F.lit(seed), F.col(id_column)).alias("place"), F.monotonically_increasing_id().alias("nth"),
        ).withColumn("pattern_key", F.to_json("pattern")).withColumn("range", F.shiftrightunsigned("place", 52).cast("int")),
        "sizes",
    )
    found = staged.groupBy("pattern_key").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("words")).orderBy("pattern_key").collect()
    sizes: dict = {}
    for r in found:
        for m in r["pattern"]:
            sizes[m] = sizes.get(m, 0) + r["words"]
    names = sorted(sizes, key=lambda m: (m is None, m or ""))
    weigh = [weights[i % len(weights)] for i in range(len(names))]
    targets = dict(zip(names, water_fill([sizes[m] for m in names], weigh, share * sum(r["words"] for r in found), repeats)))
    flow = min_cost_flow([(list(r["pattern"]), r["words"]) for r in found], targets, repeats)
    plan, routes = [], []
    for r, parts in zip(found, flow):
        total, words = sum(parts.values()), r["words"]
        rounds = min(repeats, int(total // words)) if words else 0
        plan.append((r["pattern_key"], rounds, float(total - rounds * words) if words and rounds < repeats else 0.0))
        upto = 0.0
        order = sorted(r["pattern"], key=lambda m: (m is None, m or ""))
        for at, m in enumerate(order):
            upto = 1.0 if at + 1 == len(order) else upto + (parts[m] / total if total else 1 / len(order))
            routes.append((r["pattern_key"], upto, m, sizes[m], targets[m]))
    plan_df = spark.createDataFrame(plan, "pattern_key string, rounds int, rest double")

    # words before each range of a pattern, then the one range that holds the cut
    sums = staged.groupBy("pattern_key", "range").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("pattern_key").orderBy("range"))
    at_cut = sums.withColumn("upto", running).join(F.broadcast(plan_df), "pattern_key").where("rest > 0 AND upto >= rest AND upto - words < rest")
    cut = at_cut.select("pattern_key", "range", (F.col("rest") - F.col("upto") + F.col("words")).alias("missing"))
    inside = staged.select("pattern_key", "range", "place", "size", "nth").join(F.broadcast(cut), ["pattern_key", "range"])
    ordered = Window.partitionBy("pattern_key").orderBy("place", "size", "nth").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("size").over(ordered)).where("upto <= missing")
    last = inside.groupBy("pattern_key").agg(F.max(F.struct("place", "size", "nth")).alias("last"), F.max("upto").alias("met"))
    ends = {r["pattern_key"]: r for r in cut.join(last, "pattern_key", "left").collect()}
    cuts = []
    for key, rounds, rest in plan:
        end = ends.get(key)
        cuts.append((key, rounds, end and end["range"], end and end["last"], float(end["missing"] - (end["met"] or 0)) if end else 0.0))
    kind = "pattern_key string, rounds int, cut_range int, last struct<place: bigint, size: bigint, nth: bigint>, gap double"
    here = staged.join(F.broadcast(spark.createDataFrame(cuts, kind)), "pattern_key")
    # signed places sort apart from unsigned ranges, so a row is compared by range first
    within = F.struct("place", "size", "nth") <= F.col("last")
    chosen = F.coalesce((F.col("range") < F.col("cut_range")) | ((F.col("range") == F.col("cut_range")) & within), F.lit(False))
    here = here.withColumn("chosen", chosen)

    toggled = _settle(here, {key: gap for key, _, _, _, gap in cuts if gap}, {key: total for key, _, total in plan})
    here = here.join(F.broadcast(spark.createDataFrame(toggled, "pattern_key string, toggled array<bigint>")), "pattern_key", "left")
    moved = F.coalesce(F.array_contains("toggled", F.col("nth")), F.lit(False))
    copies = F.col("rounds") + (F.col("chosen") != moved).cast("int")

    share_at = F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    routed = _route(here.withColumn("copies", copies).withColumn("share_at", share_at), routes, spark)
    return routed.select("row", "size", "copies", (F.col("size") * F.col("copies")).alias("taken"), "quota_source", "source_size", "target")


def _settle(here: DataFrame, gaps: dict[str, float], rests: dict[str, float], rounds: int = 6, near: float = 0.0005) -> list[tuple]:
    """Documents (by ``nth``) to take in or leave out after all, so that each pattern's cut falls nearer to what is missing.

    A round moves one document of each pattern still off: the one that leaves the smallest gap. A pattern keeps the moves up
    to its smallest gap, so a large document may go in and a chosen one out in exchange.
    """
    moves: dict[str, list] = {key: [] for key in gaps}
    best = {key: (abs(gap), 0) for key, gap in gaps.items()}
    now = dict(gaps)
    for _ in range(rounds):
        open_ = [key for key in now if best[key][0] > max(1.0, near * rests[key])]
        if not open_:
            break
        state = here.sparkSession.createDataFrame([(key, now[key], [n for n, _ in moves[key]]) for key in open_], "pattern_key string, gap_now double, gone array<bigint>")
        rows = here.where("size > 0").join(F.broadcast(state), "pattern_key").where(~F.array_contains("gone", F.col("nth")))
        step = F.when(F.col("chosen"), -F.col("size")).otherwise(F.col("size"))
        pick = F.min(F.struct(F.abs(F.col("gap_now") - step).alias("off"), F.col("place"), F.col("nth"), step.alias("step")))
        for r in rows.groupBy("pattern_key").agg(pick.alias("pick")).collect():
            key = r["pattern_key"]
            moves[key].append((r["pick"]["nth"], r["pick"]["step"]))
            now[key] -= r["pick"]["step"]
            if abs(now[key]) < best[key][0]:
                best[key] = (abs(now[key]), len(moves[key]))
    return [(key, [n for n, _ in moves[key][:best[key][1]]]) for key in moves]


def _route(rows: DataFrame, routes: list[tuple], spark) -> DataFrame:
    """The source whose part of the pattern's flow the document's share falls into; one row per pattern and source."""
    kind = "pattern_key string, ways array<struct<upto: double, quota_source: string, source_size: bigint, target: double>>"
    ways: dict[str, list] = {}
    for key, upto, name, size, target in routes:
        ways.setdefault(key, []).append((upto, name, size, target))
    joined = rows.join(F.broadcast(spark.createDataFrame(list(ways.items()), kind)), "pattern_key", "left")
    way = F.filter("ways", lambda w: w["upto"] > F.col("share_at"))[0]
    return joined.withColumn("way", way).select("*", "way.quota_source", "way.source_size", "way.target")


def repeat_rows(docs: DataFrame, memberships: Column, size: Column, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    taken = mix(docs, memberships, size, keep=tuple(docs.columns), **options).where("copies > 0")
    return taken.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
