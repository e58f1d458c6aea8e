"""Near-duplicate records by sketches from one hash function and inverted lists of their rarest word runs.

One 64-bit hash of word runs serves all steps, and records with equal sets of runs are folded into one representative.
A record retains the beginning of its runs in one global order: rare ones by their hash, then the most common ones, the
commonest last (the prefix principle: two sets that are similar enough must share a run there). How many it retains
follows from its size and the threshold alone, so inverted lists of the retained values meet every similar pair; no list
is capped. A list that is longer than a block is joined block by block, each pair of blocks by a task of its own.

Where two records meet, sizes and places bound what they can have in common, and the sketches of both, joined bin by
bin into that of their union, estimate their similarity: 64 bins by six bits of the hash, each holding six bits of its
least member. Pairs below the estimate's error bound are dropped on the spot, before anything is shuffled; exact Jaccard
over whole sets decides on the rest. A pair at the threshold is dropped with a chance below ``LOST``, one above it with
less; ``exact=True`` leaves the estimate out, and then nothing is estimated at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ordering import lookup
from spindrift.runtime import cut, once, shuffle_partitions

#: Greatest chance of losing a pair at the threshold; most common runs that have a place in the order of their own (12
#: bytes each, sent to the tasks); records in a block of a long list; pairs looked at in one go; what roundings may come to.
LOST, COMMON_RUNS, BLOCK, AT_ONCE, ROUNDING = 1e-6, 1 << 18, 4096, 1 << 18, 1e-6
#: Least threshold (exclusive); below it the beginnings are nearly whole sets.
LEAST_THRESHOLD = 0.3
#: Bins of a sketch, bits that each holds, and the 64-bit words of a sketch: a word of bits for each plane of 64 bins.
BINS, PLANES = 128, 4
WORDS = BINS // 64 * PLANES
#: Bytes of a posting: the sketch, then record, size, runs left and the side of its block.
_POSTING = [("sketch", "<u8", (WORDS,)), ("nid", "<i8"), ("n", "<i4"), ("left", "<i4"), ("side", "<i4")]


def _mixed(x):
    """A 64-bit finaliser, so that sums and products of hashes are spread again."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lists(column):
    """The values of an Arrow list column as one array, and where each row's begin (one more than rows)."""
    import numpy as np

    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _sketches(rows, runs, n_rows):
    """The sketch of each row: bit ``b`` of word ``g * PLANES + p`` is bit ``p`` of what bin ``64 * g + b`` holds; an empty bin holds 0."""
    import numpy as np

    slot = rows * BINS + (runs & np.uint64(BINS - 1)).astype(np.int64)
    order = np.lexsort((runs, slot))
    slot, runs = slot[order], runs[order]
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    slot, held = slot[first], runs[first] // np.uint64(BINS) % np.uint64(2**PLANES - 1) + np.uint64(1)
    out = np.zeros((n_rows, WORDS), np.uint64)
    group, bit = slot // 64, np.uint64(1) << (slot % 64).astype(np.uint64)
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    for p in range(PLANES):
        planes = np.where(held >> np.uint64(p) & np.uint64(1), bit, np.uint64(0))
        if len(begins):
            at = group[begins]
            out[at // (BINS // 64), at % (BINS // 64) * PLANES + p] = np.bitwise_or.reduceat(planes, begins)
    return out


def run_sets(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``key, n, s1, s2, sketch, runs``: the distinct ``n``-word runs of each record that has any, as 64-bit hashes.

    Words are what white space separates, in lower case, punctuation dropped. ``s1`` and ``s2`` are equal for equal sets.
    """
    bare = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{M}\p{N}_\s]+", "")
    words = F.filter(F.split(bare, r"[\s\x{85}\x{A0}\x{2000}-\x{200B}\x{3000}]+", -1), lambda w: w != "")
    hashed = df.where(F.col(key).isNotNull()).select(key, once(words).alias("__w")).where(F.size("__w") >= n).select(key, F.transform("__w", lambda w: F.xxhash64(w)).alias("__w"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            flat, offsets = _lists(batch.column(1))
            flat = flat.view(np.uint64)
            sizes = np.diff(offsets) - n + 1
            rows = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[:-1], sizes)
            runs = flat[at]
            for i in range(1, n):
                runs = _mixed(runs * np.uint64(0x9E3779B97F4A7C15) + flat[at + i])
            order = np.lexsort((runs, rows))
            rows, runs = rows[order], runs[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (runs[1:] != runs[:-1])
            rows, runs = rows[new], runs[new]
            n_rows = batch.num_rows
            sizes = np.bincount(rows, minlength=n_rows)
            starts = np.r_[0, np.cumsum(sizes)]
            sums = [np.add.reduceat(x, starts[:-1]) if n_rows else np.zeros(0, np.uint64) for x in (runs, _mixed(runs + np.uint64(1)))]
            sketch = np.ascontiguousarray(_sketches(rows, runs, n_rows)).astype("<u8").tobytes()
            binary = pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer((np.arange(n_rows + 1) * 8 * WORDS).astype(np.int32)), pa.py_buffer(sketch)])
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(runs.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), *[pa.array(s.view(np.int64)) for s in sums], binary, lists], names=[key, "n", "s1", "s2", "sketch", "runs"])

    return hashed.mapInArrow(run, f"`{key}` {hashed.schema[0].dataType.simpleString()}, n int, s1 bigint, s2 bigint, sketch binary, runs array<bigint>")


def _distinct_sets(sets: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Representatives ``rep, nid, n, sketch, runs`` and members ``key, rep, copies``; a set's representative is its least key."""
    own = cut(sets.withColumn("nid", F.monotonically_increasing_id()))
    groups = own.groupBy("s1", "s2", "n").agg(F.min(key).alias("rep"), F.count("*").alias("copies"))
    copied = groups.where("copies > 1")
    several = cut(lookup(own.select(key, "nid", "s1", "s2", "n"), copied, ["s1", "s2", "n"], "copies").select(key, "nid", "rep", "copies"))
    single = own.select(F.col(key), "nid").join(several.select("nid"), "nid", "left_anti").select(key, F.col(key).alias("rep"), F.lit(1).cast("bigint").alias("copies"))
    reps = own.join(several.where(F.col(key) != F.col("rep")).select("nid"), "nid", "left_anti").select(F.col(key).alias("rep"), "nid", "n", "sketch", "runs")
    return reps, single.unionByName(several.select(key, "rep", "copies"))


def _common_runs(reps: DataFrame, most: int) -> tuple[list, list, int]:
    """The hashes of at most ``most`` runs that most records have, their numbers of records, and the greatest number of any other."""
    seen = cut(reps.select(F.explode("runs").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") > 1))
    steps = sorted(((r["df"], r["count"]) for r in seen.groupBy("df").count().collect()), reverse=True)  # a row per distinct number
    taken, bound = 0, 0
    for df, count in steps:
        if taken + count > most:
            bound = df
            break
        taken += count
    rows = seen.where(F.col("df") > max(bound, 1)).toArrow()
    return rows.column("h").to_numpy(), rows.column("df").to_numpy(), max(bound, 1)


def _retained(reps: DataFrame, threshold: float, most: int, block: int) -> DataFrame:
    """``cell, posting``: each record's retained runs with all that a pair is judged by.

    The smallest set that a record of ``n`` runs may pair with has ``t * n``, and both must have these in common; so a
    run counts only if at least so many are left from it on. A run that more than ``block`` records have is dealt into
    cells, one for each pair of blocks.
    """
    import numpy as np

    common, dfs, other = _common_runs(reps, most)
    rising = np.lexsort((common, dfs))
    place = np.empty(len(common), np.int32)
    place[rising] = np.arange(1, len(common) + 1, dtype=np.int32)
    order = np.argsort(common.view(np.uint64))
    common, place, parts = common.view(np.uint64)[order], place[order], -(-dfs[order] // block)
    rest = -(-other // block)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                runs, offsets = _lists(batch.column(3))
                runs, sizes = runs.view(np.uint64), np.diff(offsets)
                rows = np.repeat(np.arange(len(sizes)), sizes)
                if len(common):
                    at = np.minimum(np.searchsorted(common, runs), len(common) - 1)
                    known = common[at] == runs
                    rank, cells = np.where(known, place[at], 0), np.where(known, parts[at], rest)
                else:
                    rank, cells = np.zeros(len(runs), np.int32), np.full(len(runs), rest)
                order = np.lexsort((runs, rank, rows))
                runs, cells = runs[order], cells[order]
                left = sizes[rows] - (np.arange(len(rows)) - offsets[:-1][rows])
                keep = left >= np.ceil(sizes[rows] * threshold - ROUNDING)
                runs, cells, rows, left = runs[keep], cells[keep], rows[keep], left[keep]
                nids, ns = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, WORDS)
                for some in range(0, max(1, len(rows)), 1 << 16):
                    cut_ = slice(some, some + (1 << 16))
                    r, m = rows[cut_], cells[cut_].astype(np.int64)
                    own = (_mixed(nids[r].view(np.uint64)) % m.astype(np.uint64)).astype(np.int64)
                    copy = np.repeat(np.arange(len(r)), m)
                    other_block = np.arange(len(copy)) - np.repeat(np.cumsum(m) - m, m)
                    mine = own[copy]
                    low, high = np.minimum(mine, other_block), np.maximum(mine, other_block)
                    split = m[copy] > 1
                    h = runs[cut_][copy]
                    cell = np.where(split, _mixed(h + low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mixed(high.astype(np.uint64) + np.uint64(7))), h)
                    out = np.zeros(len(copy), _POSTING)
                    out["sketch"], out["nid"], out["n"], out["left"] = sketch[r[copy]], nids[r[copy]], ns[r[copy]], left[cut_][copy]
                    out["side"] = np.where(low == high, 0, np.where(mine == low, 1, 2))
                    width = out.dtype.itemsize
                    posting = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer((np.arange(len(out) + 1) * width).astype(np.int32)), pa.py_buffer(out.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), posting], names=["cell", "posting"])

    return reps.select("nid", "n", "sketch", "runs").mapInArrow(run, "cell bigint, posting binary")


def asked_bins(threshold: float, lost: float = LOST) -> list[int]:
    """For each number of bins that a union fills, how many must agree: fewer do at the threshold with a chance below ``lost``."""
    out = []
    for m in range(BINS + 1):
        below, q = 0.0, 0
        while q < m:
            below += math.comb(m, q) * threshold**q * (1 - threshold) ** (m - q)
            if below > lost:
                break
            q += 1
        out.append(q)
    return out


def _candidates(retained: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """``a, b``: distinct pairs of records that meet in a cell and pass the bounds and, unless ``exact``, the estimate."""
    asked = [0] * (BINS + 1) if exact else asked_bins(threshold)

    def met(p):
        """Pairs among the rows of ``p``, ordered by cell; chunks of bounded size."""
        import numpy as np

        cell, x = p
        if not len(cell):
            return
        enough = np.array(asked)
        last = np.r_[np.flatnonzero(cell[1:] != cell[:-1]), len(cell) - 1]
        end = np.repeat(last + 1, np.diff(np.r_[-1, last]))
        followers = end - np.arange(len(cell)) - 1
        upto = np.cumsum(followers)
        n, left, side, nid, sketch = x["n"], x["left"], x["side"], x["nid"], x["sketch"]
        begin = 0
        while begin < len(cell):
            done = upto[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(upto, done + AT_ONCE, "right")))
            f = followers[begin:stop]
            a = np.repeat(np.arange(begin, stop), f)
            b = np.arange(len(a)) - np.repeat(np.cumsum(f) - f, f) + a + 1
            begin = stop
            if not len(a):
                continue
            na, nb = n[a], n[b]
            common = np.ceil(threshold / (1 + threshold) * (na + nb) - ROUNDING)
            good = (np.minimum(left[a], left[b]) >= common) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - ROUNDING) & ((side[a] != side[b]) | (side[a] == 0))
            a, b = a[good], b[good]
            if not exact and len(a):
                agree, filled = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
                for g in range(0, WORDS, PLANES):
                    planes = [(sketch[:, p][a], sketch[:, p][b]) for p in range(g, g + PLANES)]
                    apart, some_a, some_b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
                    for u, v in planes:
                        apart |= u ^ v
                        some_a |= u
                        some_b |= v
                    agree += np.bitwise_count(~apart & some_a)
                    filled += np.bitwise_count(some_a | some_b)
                good = agree >= enough[filled]
                a, b = a[good], b[good]
            if len(a):
                yield np.unique(np.stack([np.minimum(nid[a], nid[b]), np.maximum(nid[a], nid[b])]), axis=1)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kind = np.dtype(_POSTING)
        def rows(batch):
            column = batch.column(1)
            start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
            return batch.column(0).to_numpy(), np.frombuffer(column.buffers()[2], np.uint8)[start : start + batch.num_rows * kind.itemsize].view(kind)

        def emit(part):
            for pairs in met(part):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(rows(batch))
            if held[-1][0][0] == held[-1][0][-1] == held[0][0][0]:
                continue  # still the same cell
            cell = np.concatenate([c for c, _ in held])
            posting = np.concatenate([x for _, x in held])
            whole = int(np.searchsorted(cell == cell[-1], True))  # rows of one cell stand together, the last cell may go on
            yield from emit((cell[:whole], posting[:whole]))
            held = [(cell[whole:].copy(), posting[whole:].copy())]
        if held:
            yield from emit((np.concatenate([c for c, _ in held]), np.concatenate([x for _, x in held])))

    width = shuffle_partitions(retained.sparkSession)
    met_rows = retained.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")
    return met_rows.dropDuplicates()


def similar_pairs(reps: DataFrame, threshold: float, exact: bool = False, common_runs: int = COMMON_RUNS, block: int = BLOCK) -> DataFrame:
    """``rep_a, rep_b, jaccard`` with ``rep_a < rep_b`` for all representatives of at least ``threshold``.

    The threshold must be above :data:`LEAST_THRESHOLD`. ``common_runs`` and ``block`` change the work, not the result.
    """
    if not LEAST_THRESHOLD < threshold <= 1:
        raise ValueError(f"the threshold must be above {LEAST_THRESHOLD}")
    pairs = cut(_candidates(_retained(reps, threshold, common_runs, block), threshold, exact))
    side = lambda x: reps.select(F.col("nid").alias(x), F.col("rep").alias(f"r{x}"), F.col("runs").alias(f"s{x}"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b")
    both = whole.withColumn("__i", once(F.size(F.array_intersect("sa", "sb"))))
    match = both.withColumn("jaccard", F.col("__i") / (F.size("sa") + F.size("sb") - F.col("__i"))).where(F.col("jaccard") >= threshold)
    return match.select(F.least("ra", "rb").alias("rep_a"), F.greatest("ra", "rb").alias("rep_b"), "jaccard")


def near_duplicates(df: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, exact: bool = False, common_runs: int = COMMON_RUNS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of representatives (``rep_a, rep_b, jaccard``) and the members (``key, rep, copies``) of each.

    ``key`` must be unique and ordered. Records without an ``n``-word run (short, blank, empty or null texts) are in
    neither, nor are null keys. Extra columns are left out. Records of equal sets share a representative, however many
    they are. Empty frames give empty frames.
    """
    reps, members = _distinct_sets(run_sets(df, key, text, n), key)
    return similar_pairs(reps, threshold, exact, common_runs, block), members


def expand(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """All pairs of records, ``{key}_a < {key}_b``: those of similar representatives and those of equal sets."""
    left = members.select(F.col("rep").alias("rep_a"), F.col(key).alias("x"))
    right = members.select(F.col("rep").alias("rep_b"), F.col(key).alias("y"))
    own = members.where(F.col("copies") > 1).select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")).distinct()
    apart = pairs.select("rep_a", "rep_b").unionByName(own).join(left, "rep_a").join(right, "rep_b")
    apart = apart.where((F.col("rep_a") != F.col("rep_b")) | (F.col("x") < F.col("y")))
    return apart.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def classes(pairs: DataFrame, members: DataFrame, key: str, rounds: int = 50) -> DataFrame:
    """``key, class, links``: the least key reachable over similar pairs, and the record's number of similar records.

    Labels spread along links until none changes, hooking each to the least label around and then to that label's own;
    ``rounds`` only guards against a run without end. Copies of one set link to each other.
    """
    both = pairs.select(F.col("rep_a").alias("x"), F.col("rep_b").alias("y")).unionByName(pairs.select(F.col("rep_b").alias("x"), F.col("rep_a").alias("y")))
    both = cut(both)
    label = cut(members.select(F.col("rep").alias("x"), F.col("copies").alias("c")).distinct().withColumn("l", F.col("x")))
    for _ in range(rounds):
        around = both.join(label.select(F.col("x").alias("y"), F.col("l").alias("o")), "y").groupBy("x").agg(F.min("o").alias("o"))
        hooked = label.join(around, "x", "left").select("x", "c", "l", F.least("l", F.coalesce("o", "l")).alias("m"))
        jumped = hooked.join(label.select(F.col("x").alias("m"), F.col("l").alias("j")), "m", "left").select("x", "c", F.least("m", F.coalesce("j", "m")).alias("l"), (F.least("m", F.coalesce("j", "m")) != F.col("l")).alias("moved"))
        label = cut(jumped)
        if not label.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError("labels still change")
    sizes = label.select(F.col("x").alias("y"), "c")
    linked = both.join(sizes, "y").groupBy("x").agg(F.sum("c").alias("k"))
    each = label.join(linked, "x", "left").select(F.col("x").alias("rep"), F.col("l").alias("class"), (F.coalesce("k", F.lit(0)) + F.col("c") - 1).alias("links"))
    return members.join(each, "rep").select(key, "class", "links")
