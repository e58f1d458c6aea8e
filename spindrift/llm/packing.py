"""Filling containers of fixed capacity by a grouping genetic algorithm on islands.

Items are dealt into blocks of bounded size; each block is evolved by several islands, tasks of their own. A chromosome
is a list of bins, and an island starts from items put in random orders where they fit best, so that the packing is the
evolution's work. Crossover injects well-filled bins of one parent into another, removes the bins that hold the same
items, and puts displaced items where they fit best. After each epoch every island sends its best chromosome to the next
island of the block through a shuffle; for the last epoch the packing by falling sizes immigrates as well, so that no
result is worse than that. An island stops where no packing could have fewer bins. Bins that stay poorly filled are
emptied and their items dealt again, together with those of other blocks, so that waste doesn't grow with the number of
blocks.

Only items larger than the capacity are split: into full containers and one remainder, which is packed like any item.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.runtime import cut, shuffle_partitions

#: Items in a block, islands of a block, chromosomes of an island, epochs, generations of an epoch; fill from which a
#: bin is final before the last level, and the greatest number of levels.
BLOCK, ISLANDS, POPULATION, EPOCHS, GENERATIONS, FULL, LEVELS = 2000, 2, 6, 2, 40, 0.985, 4


def best_fit(bins: list[list[int]], free: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Put each item into the bin with the least room that holds it, opening bins where none does. In place."""
    rooms = sorted((room, i) for i, room in enumerate(free))
    for item in items:
        size = sizes[item]
        at = bisect_left(rooms, (size, -1))
        if at == len(rooms):
            bins.append([item])
            free.append(capacity - size)
            insort(rooms, (capacity - size, len(bins) - 1))
        else:
            room, i = rooms.pop(at)
            bins[i].append(item)
            free[i] = room - size
            insort(rooms, (room - size, i))


def fitness(free: list[int], capacity: int) -> float:
    """Mean squared fill; more for fewer bins, and for full ones beside empty ones."""
    return sum((1 - room / capacity) ** 2 for room in free) / len(free) if free else 0.0


def _decode(genes, sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    bins: dict[int, list[int]] = {}
    for item, b in enumerate(genes):
        bins.setdefault(int(b), []).append(item)
    groups = list(bins.values())
    return groups, [capacity - sum(sizes[i] for i in g) for g in groups]


def _encode(bins: list[list[int]], n: int) -> list[int]:
    genes = [0] * n
    for b, group in enumerate(bins):
        for i in group:
            genes[i] = b
    return genes


def crossover(one, other, sizes: list[int], capacity: int, random):
    """A child of ``one`` with some of the better-filled bins of ``other``."""
    bins, free = one
    donors, rooms = other
    k = max(1, len(donors) // random.choice((8, 4, 2)))
    ranked = sorted(range(len(donors)), key=lambda i: rooms[i] + random.random() * capacity / 8)[: 2 * k]
    chosen = random.sample(ranked, min(k, len(ranked)))
    injected = {i for b in chosen for i in donors[b]}
    kept, room, displaced = [list(donors[b]) for b in chosen], [rooms[b] for b in chosen], []
    for group, r in zip(bins, free, strict=True):
        if injected.isdisjoint(group):
            kept.append(list(group))
            room.append(r)
        else:
            displaced.extend(i for i in group if i not in injected)
    # Mutation: the emptiest bins and some others are dissolved as well, so that small items come free to fill gaps.
    by_room = sorted(range(len(kept)), key=room.__getitem__, reverse=True)
    broken = {i for i in by_room[:3] if room[i] > 0} | set(random.sample(by_room, len(by_room) // 16))
    for i in broken:
        displaced.extend(kept[i])
    kept, room = [g for i, g in enumerate(kept) if i not in broken], [r for i, r in enumerate(room) if i not in broken]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    best_fit(kept, room, displaced, sizes, capacity)
    return kept, room


def packed_in_order(order: list[int], sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """A chromosome from one order of the items."""
    bins, free = [], []
    best_fit(bins, free, order, sizes, capacity)
    return bins, free


def evolve(sizes: list[int], capacity: int, genes: list, seed: int, population: int = POPULATION, generations: int = GENERATIONS, immigrant: bool = False):
    """An epoch of an island: its chromosomes, best first, the best's fitness, the fewest bins before it, and its crossovers.

    ``genes`` are what it starts from, filled up with packings in random order; ``immigrant`` adds the packing by falling
    sizes.
    """
    import random as r

    random = r.Random(seed)
    n, least = len(sizes), math.ceil(sum(sizes) / capacity)
    everyone = [_decode(g, sizes, capacity) for g in genes]
    if immigrant:
        everyone.append(packed_in_order(sorted(range(n), key=lambda i: -sizes[i]), sizes, capacity))
    while len(everyone) < population:
        everyone.append(packed_in_order(random.sample(range(n), n), sizes, capacity))
    scored = sorted(((fitness(f, capacity), k, (b, f)) for k, (b, f) in enumerate(everyone)), key=lambda x: (-x[0], x[1]))[:population]
    start, crossed = min(len(x[2][0]) for x in scored), 0
    for k in range(generations * population):
        if len(scored[0][2][0]) <= least:
            break  # no packing has fewer bins
        # Two of three parents that inject come from the better half.
        one = random.choice(scored)
        other = random.choice(scored[: max(1, len(scored) // 2)] if random.random() < 2 / 3 else scored)
        if one is other:
            other = scored[(scored.index(one) + 1) % len(scored)]
        child = crossover(one[2], other[2], sizes, capacity, random)
        crossed += 1
        value = fitness(child[1], capacity)
        if value > scored[-1][0]:
            scored[-1] = (value, population + k, child)
            scored.sort(key=lambda x: (-x[0], x[1]))
    return [_encode(b, n) for _, _, (b, _) in scored], scored[0][0], start, crossed


def _pack_blocks(items: DataFrame, capacity: int, last: bool, how: dict) -> tuple[DataFrame, DataFrame]:
    """``item, size, bin`` (null where the item has to be dealt again) for items that have a ``block``, and a report per block."""
    islands, epochs = how["islands"], how["epochs"]
    rows = items.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("item", "size"))).alias("own"))  # a block is bounded
    state = rows.select("block", "own", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast("array<array<int>>").alias("genes"), F.lit(0).alias("start"), F.lit(0).alias("crossed"))
    schema = "block long, own array<struct<item:string,size:int>>, island int, genes array<array<int>>, start int, crossed int, value double"
    for epoch in range(epochs):

        def island(batches, epoch=epoch):
            import pandas as pd

            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    sizes = [int(x["size"]) for x in row.own]
                    start = [] if row.genes is None else [g for g in row.genes]
                    seed = (int(row.block) * 64 + int(row.island)) * 64 + epoch
                    genes, value, begun, crossed = evolve(sizes, capacity, start, seed, how["population"], how["generations"], immigrant=epoch > 0 and epoch == epochs - 1)
                    out.append((row.block, row.own, row.island, genes, row.start or begun, row.crossed + crossed, value))
                yield pd.DataFrame(out, columns=["block", "own", "island", "genes", "start", "crossed", "value"])

        width = shuffle_partitions(items.sparkSession)
        state = cut(state.repartition(width, "block", "island").mapInPandas(island, schema))
        if epoch + 1 < epochs:
            elite = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.get("genes", F.lit(0)).alias("guest"))
            state = state.join(elite, ["block", "island"]).select("block", "own", "island", F.concat("genes", F.array("guest")).alias("genes"), "start", "crossed")
    ends = F.size(F.array_distinct(F.get("genes", F.lit(0))))
    report = state.groupBy("block").agg(F.min("start").alias("start_bins"), F.min(ends).alias("end_bins"), F.sum("crossed").alias("crossovers"))
    best = state.groupBy("block").agg(F.max_by(F.struct("own", F.get("genes", F.lit(0)).alias("g")), F.struct("value", -F.col("island"))).alias("b"))
    each = best.select("block", F.explode(F.arrays_zip(F.col("b.own").alias("i"), F.col("b.g").alias("g"))).alias("x")).select("block", "x.i.item", "x.i.size", F.col("x.g").alias("g"))
    fill = each.groupBy("block", "g").agg(F.sum("size").alias("fill"), F.min("item").alias("bin"))
    final = F.lit(True) if last else F.col("fill") >= FULL * capacity
    return each.join(fill, ["block", "g"]).select("item", "size", F.when(final, F.col("bin")).alias("bin")), report


def pack(df: DataFrame, key: str, size: str, capacity: int, **how: int) -> DataFrame:
    """The first result of :func:`pack_with_report`."""
    return pack_with_report(df, key, size, capacity, **how)[0]


def pack_with_report(df: DataFrame, key: str, size: str, capacity: int, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS) -> tuple[DataFrame, DataFrame]:
    """``key, part, container, size``: where each item, or each part of an oversize one, goes; and what evolution did.

    The report has ``level, block, start_bins, end_bins, crossovers``: fewest bins of a block's islands before the first
    crossover and in the end.

    Each row of ``df`` is an item, repeated ones too; its parts count from 0. Every container is named after the least
    of its items and holds at most ``capacity``. A null or negative size counts as 0; such items share containers like
    others and take no room. An empty frame gives an empty frame.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    clean = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    numbered = cut(df.select(F.col(key), clean.alias("__size")).withColumn("__row", F.monotonically_increasing_id()))
    whole = F.floor(F.col("__size") / capacity)
    split = numbered.where(F.col("__size") > capacity)
    full = split.select(F.col(key), F.explode(F.sequence(F.lit(0), whole.cast("int") - 1)).alias("part"), "__row")
    full = full.select(key, "part", F.concat_ws("-", "__row", "part").alias("container"), F.lit(capacity).alias("size"))
    rest = numbered.select(key, "__row", F.when(F.col("__size") > capacity, whole).otherwise(0).cast("int").alias("part"), F.when(F.col("__size") > capacity, F.col("__size") % capacity).otherwise(F.col("__size")).cast("int").alias("size"), "__size")
    rest = rest.where((F.col("size") > 0) | (F.col("__size") <= capacity)).select(key, "part", "size", F.concat_ws("-", "__row", "part").alias("item"))
    how = {"islands": islands, "population": population, "epochs": epochs, "generations": generations}
    loose, placed, reports = rest.select("item", "size"), None, None
    n = rest.count()
    for level in range(LEVELS):
        blocks = max(1, math.ceil(n / BLOCK))
        last = level == LEVELS - 1 or blocks == 1
        rows, report = _pack_blocks(loose.withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks))), capacity, last, how)
        done = cut(rows)
        report = report.select(F.lit(level).alias("level"), "block", "start_bins", "end_bins", "crossovers")
        reports = report if reports is None else reports.unionByName(report)
        fixed = done.where("bin IS NOT NULL")
        placed = fixed if placed is None else placed.unionByName(fixed)
        if last:
            break
        loose = done.where("bin IS NULL").select("item", "size")
        n = loose.count()
        if n == 0:
            break
    packed = rest.join(placed.select("item", F.col("bin").alias("container")), "item").select(key, "part", "container", "size")
    return full.unionByName(packed), reports
