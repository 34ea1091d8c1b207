"""Filling fixed-capacity containers: length patterns whose counts come from non-negative least squares.

Lengths are binned upwards on a grid of the capacity, so a set of bins that fits always holds its items. Per group one
task sees only the histogram (at most ``GRID`` rows), enumerates shallow combinations of bins that fill a container,
solves how often each is used, and rounds down. Items take the planned places by their exact rank within their bin; what
the plan leaves over is packed greedily in bounded blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sozmill.operators.ranking import spread_rank
from sozmill.session import cut

GRID = 120
DEPTH = 4
#: Most left-over pieces that one task packs.
BLOCK = 20_000
#: Copies of a pattern, and pieces of an item, that one row expands to.
RUN = 50_000


def combinations(grid: int, depth: int, bins: list[int]) -> np.ndarray:
    """Multisets of at most ``depth`` of the given bins that add up to ``grid``, as rows of counts per bin (1..grid)."""
    present = sorted(set(bins), reverse=True)
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int, start: int) -> None:
        if left == 0:
            found.append(chosen)
            return
        room = depth - len(chosen)
        for i in range(start, len(present)):
            b = present[i]
            if b * room < left:
                break
            if b <= left:
                extend((*chosen, b), left - b, i)

    extend((), grid, 0)
    out = np.zeros((len(found), grid + 1))
    for row, chosen in enumerate(found):
        for b in chosen:
            out[row, b] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Least squares ``a @ x ~ b`` with ``x >= 0`` by an active set; the solution has at most as many positive entries as rows."""
    n = a.shape[1]
    x = np.zeros(n)
    active = np.zeros(n, bool)
    eps = 1e-9 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(limit or 3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        j = int(np.argmax(gradient)) if n else 0
        if n == 0 or gradient[j] <= eps:
            break
        active[j] = True
        while True:
            used = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if (z > eps).all():
                x[:] = 0
                x[used] = z
                break
            low = used[z <= eps]
            now = x[low]
            step = (now / np.maximum(now - z[z <= eps], 1e-300)).min() if len(low) else 1.0
            moved = np.zeros(n)
            moved[used] = x[used] + min(max(step, 0.0), 1.0) * (z - x[used])
            x = np.maximum(moved, 0)
            active &= x > eps
            x[~active] = 0
            if not active.any():
                break
    return x


def plan_counts(histogram: dict[int, int], grid: int = GRID, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """Combinations of bins with how often each is used; together they never use more of a bin than there is."""
    bins = [b for b, n in histogram.items() if n > 0]
    patterns = combinations(grid, depth, bins)
    if not len(patterns):
        return []
    have = np.zeros(grid + 1)
    for b, n in histogram.items():
        have[b] = n
    solution = nnls(patterns.T, have)
    left, plan = have.copy(), []
    for j in np.argsort(-solution):
        used = patterns[j] > 0
        times = int(min(np.floor(solution[j] + 0.5), np.floor(left[used] / patterns[j][used]).min()))
        if times > 0:
            left -= times * patterns[j]
            plan.append(({int(b): int(patterns[j][b]) for b in np.flatnonzero(used)}, times))
    return plan


def _slots(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of places of one group: in bin ``bin`` the ranks [first, first + times) go to copies 0.. of pattern ``pattern``."""
    group = pdf["grp"].iloc[0]
    taken: dict[int, int] = {}
    rows = []
    for number, (pattern, times) in enumerate(plan_counts(dict(zip(pdf["bin"].tolist(), pdf["n"].tolist())))):
        for b, k in sorted(pattern.items()):
            for _ in range(k):
                rows.append((group, b, taken.get(b, 1), times, number))
                taken[b] = taken.get(b, 1) + times
    return pd.DataFrame(rows, columns=["grp", "bin", "first", "times", "pattern"])


def _best_fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best fit, longest first, of one bounded block."""
    import bisect

    pdf = pdf.sort_values(["length", "item", "piece"], ascending=[False, True, True], kind="stable")
    capacity = int(pdf["capacity"].iloc[0])
    rooms: list[tuple[int, int]] = []
    placed, opened = [], 0
    for length in pdf["length"].tolist():
        i = bisect.bisect_left(rooms, (length, -1))
        if i < len(rooms):
            room, box = rooms.pop(i)
        else:
            room, box = capacity, opened
            opened += 1
        placed.append(box)
        if room > length:
            bisect.insort(rooms, (room - length, box))
    prefix = f"{pdf['grp'].iloc[0]}:r{pdf['block'].iloc[0]}."
    return pd.DataFrame({"item": pdf["item"], "piece": pdf["piece"], "container": [prefix + str(b) for b in placed]})


def pack(items: DataFrame, limits: DataFrame, item: str = "item", group: str = "grp", length: str = "length", capacity: str = "capacity") -> DataFrame:
    """(item, grp, piece, pieces, length, capacity, container) for every item, with ``pieces`` above 1 only where length > capacity.

    ``items`` has a unique ``item``, a ``group`` and an integer ``length``; ``limits`` one integer ``capacity`` per group
    (the greatest, if repeated). An item longer than its capacity is cut into full containers and a rest, all others stay
    whole. Items with a null, zero or negative length, or of a group without positive capacity, get one row with a null
    container. Null items are dropped; equal lengths are told apart by item; other columns are ignored; an empty table gives
    an empty result.
    """
    caps = limits.select(F.col(group).alias("grp"), F.col(capacity).cast("bigint").alias("capacity")).where("grp is not null and capacity > 0").groupBy("grp").agg(F.max("capacity").alias("capacity"))
    rows = items.select(F.col(item).alias("item"), F.col(group).alias("grp"), F.col(length).cast("bigint").alias("length")).where("item is not null")
    rows = rows.join(caps, "grp", "left")
    usable = F.col("length").isNotNull() & (F.col("length") > 0) & F.col("capacity").isNotNull()
    unusable = rows.where(~usable).select("item", "grp", F.lit(1).cast("bigint").alias("piece"), F.lit(1).cast("bigint").alias("pieces"), "length", "capacity", F.lit(None).cast("string").alias("container"))

    count = F.expr("(length + capacity - 1) div capacity")
    long = F.col("pieces") > RUN
    cuttable = rows.where(usable).withColumn("pieces", count)
    # Items of very many pieces are laid out in bounded runs, which are spread before they are expanded.
    whole_runs = cuttable.where(long).withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(pieces - 1) div {RUN}")))).repartition("item", "run")
    numbers = F.sequence(F.col("run") * RUN + 1, F.least((F.col("run") + 1) * RUN, F.col("pieces")))
    spread = whole_runs.withColumn("piece", F.explode(numbers)).drop("run")
    pieces = cuttable.where(~long).withColumn("piece", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pieces")))).unionByName(spread)
    rest = F.col("length") - (F.col("piece") - 1) * F.col("capacity")
    pieces = pieces.withColumn("length", F.least(rest, F.col("capacity")))
    pieces = pieces.withColumn("bin", F.expr(f"cast((length * {GRID} + capacity - 1) div capacity as int)"))
    pieces = cut(pieces.select("item", "grp", "piece", "pieces", "length", "capacity", "bin"))

    single = F.concat(F.col("grp"), F.lit(":f"), F.col("item"), F.lit("."), F.col("piece"))
    full = pieces.where(F.col("bin") == GRID).withColumn("container", single)
    open_ = pieces.where(F.col("bin") < GRID)
    histogram = open_.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))
    slots = cut(histogram.groupBy("grp").applyInPandas(_slots, "grp string, bin int, first long, times long, pattern int"))
    # Copies are laid out in bounded runs, which are spread before they are expanded.
    runs = slots.select("grp", "bin", "first", "pattern", "times", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("times") - 1) / RUN))).alias("run"))
    runs = runs.repartition("grp", "bin", "pattern", "run")
    copies = F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("times")) - 1)
    places = runs.select("grp", "bin", "first", "pattern", F.explode(copies).alias("copy"))
    places = places.select("grp", "bin", (F.col("first") + F.col("copy")).alias("rank"), F.concat(F.col("grp"), F.lit(":p"), "pattern", F.lit("."), "copy").alias("container"))
    # Longer items of a bin first, so that a container's items come from like ranks.
    ranked = spread_rank(open_, ["grp", "bin"], [F.col("length").desc(), F.col("item").asc(), F.col("piece").asc()])
    # The places grow with the items although they come from few rows; the hint keeps them from being broadcast.
    matched = cut(ranked.join(places.hint("merge"), ["grp", "bin", "rank"], "left").select("item", "grp", "piece", "pieces", "length", "capacity", "container"))
    planned = matched.where("container is not null")
    left = matched.where("container is null").drop("container")
    blocks = left.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    left = left.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.col("blocks")).cast("int"))
    greedy = left.groupBy("grp", "block").applyInPandas(_best_fit, "item string, piece long, container string")
    greedy = left.drop("blocks", "block").join(greedy, ["item", "piece"])
    out = ["item", "grp", "piece", "pieces", "length", "capacity", "container"]
    return unusable.unionByName(full.select(*out)).unionByName(planned.select(*out)).unionByName(greedy.select(*out))
