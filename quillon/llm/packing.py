"""Best-fit packing by a configuration linear program.

The lengths' histogram has at most ``capacity`` entries whatever the corpus, and
is taken as it is. A
configuration is a set of lengths that fits one bin; the linear program covers
the histogram with as few configurations as possible. It is solved by
multiplicative weights: lengths have prices, a knapsack dynamic program finds
the configuration worth most, and the lengths it covers become cheaper. The
solution is rounded down, what is left over goes into bins by best fit
decreasing, and documents take their places by their rank within a length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

#: Words in a bin; rounds of multiplicative weights; share of a length that a round
#: covers, with the rate of its price; pieces of a length that one task ranks.
CAPACITY, ROUNDS, SHARE, RATE, PART_PIECES = 2048, 1500, 0.25, 1.0, 1_000_000


@dataclass
class Plan:
    """Rows (length, rank0, rank1, per, bin0, slot0): ranks rank0 to rank1 of a length
    go to bins from bin0 on, ``per`` of them to a bin, in slots from slot0 on.

    ``bound`` is a lower bound on the bins that any packing needs.
    """

    rows: list[tuple[int, int, int, int, int, int]]
    bins: int
    bound: float


def priced(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """The configuration {index: count} of greatest price, and that price: knapsack by dynamic programming.

    sizes are sorted. A size that isn't worth more than every smaller one is
    never needed. Of each other size 1, 2, 4, ... pieces are offered at a time,
    which makes up every number of them, for all rooms at once.
    """
    top = np.maximum.accumulate(np.concatenate([[0.0], prices[:-1]]))
    best = np.zeros(capacity + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    for i in np.flatnonzero(prices > top).tolist():
        many, left = 1, capacity // int(sizes[i])
        while left > 0:
            many = min(many, left)
            size = many * int(sizes[i])
            worth = best[: capacity + 1 - size] + many * prices[i]
            better = worth > best[size:]
            best[size:] = np.where(better, worth, best[size:])
            steps.append((i, many, better))
            left -= many
            many *= 2
    out: dict[int, int] = {}
    c = capacity
    for i, many, better in reversed(steps):
        size = many * int(sizes[i])
        if c >= size and better[c - size]:
            out[i] = out.get(i, 0) + many
            c -= size
    return out, float(best[capacity])


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Plan for all pieces of the histogram (length: count), lengths at most capacity."""
    sizes = np.array(sorted(n for n, c in histogram.items() if c > 0), dtype=np.int64)
    if not len(sizes):
        return Plan([], 0, 0.0)
    counts = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    bound = float((sizes * counts).sum() / capacity)
    used: dict[tuple[tuple[int, int], ...], float] = {}
    covered = np.zeros(len(sizes))
    for _ in range(rounds):
        lag = covered / counts
        prices = np.exp(-RATE * np.minimum(lag - lag.min(), 60.0)) / counts
        prices /= prices.dot(counts)
        config, worth = priced(prices, sizes, capacity)
        # prices / worth is a feasible solution of the dual program
        bound = max(bound, 1.0 / worth)
        config = {i: min(n, int(counts[i])) for i, n in config.items()}
        step = min(counts[i] / n for i, n in config.items()) * SHARE
        key = tuple(sorted(config.items()))
        used[key] = used.get(key, 0.0) + step
        for i, n in config.items():
            covered[i] += n * step
    scale = float((sizes * counts).sum() / (sizes * covered).sum())
    rounded, plain = _rounded(used, scale, counts, sizes, capacity), _best_fit([], np.zeros(len(sizes), dtype=np.int64), counts.copy(), sizes, capacity, 0)
    # of a few pieces, rounding can lose more than the program gains
    return Plan(*(rounded if rounded[1] <= plain[1] else plain), bound)


def _rounded(used: dict[tuple[tuple[int, int], ...], float], scale: float, counts: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[list, int]:
    """Each configuration as often as the program says, rounded down; then once more by the
    greatest remainders, and the full ones as often as the rest allows; then best fit."""
    left, rank = counts.copy(), np.zeros(len(sizes), dtype=np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    fill = {k: sum(int(sizes[i]) * n for i, n in k) for k in used}
    typical = sum(fill[k] * x for k, x in used.items()) / sum(used.values())
    whole = sorted(used, key=lambda k: (-fill[k], -used[k], k))
    parts = sorted((k for k in used if fill[k] >= typical), key=lambda k: (-(used[k] * scale % 1), -fill[k], k))
    for step, order in enumerate((whole, parts, [k for k in whole if fill[k] == capacity])):
        for key in order:
            times = int(min(left[i] // n for i, n in key))
            times = min(times, (int(used[key] * scale), 1, times)[step])
            if times <= 0:
                continue
            slot = 0
            for i, n in key:
                rows.append((int(sizes[i]), int(rank[i]), int(rank[i]) + n * times, n, bins, slot))
                rank[i] += n * times
                left[i] -= n * times
                slot += n
            bins += times
    return _best_fit(rows, rank, left, sizes, capacity, bins)


def _best_fit(rows: list, rank: np.ndarray, left: np.ndarray, sizes: np.ndarray, capacity: int, bins: int) -> tuple[list, int]:
    """Best fit decreasing for what is left, many equal pieces and equal bins at a time."""
    rooms: list[tuple[int, int, int, int]] = []  # (room, first bin, bins, slots taken), sorted
    for i in range(len(sizes) - 1, -1, -1):
        size, n = int(sizes[i]), int(left[i])
        while n:
            at = bisect_left(rooms, (size, -1, 0, 0))
            if at < len(rooms):
                room, bin0, many, slot = rooms.pop(at)
            else:
                per = capacity // size
                room, bin0, many, slot = capacity, bins, -(-n // per), 0
                bins += many
            per = room // size
            full = min(many, n // per)
            if full:
                rows.append((size, int(rank[i]), int(rank[i]) + full * per, per, bin0, slot))
                rank[i] += full * per
                n -= full * per
                if room - per * size:
                    insort(rooms, (room - per * size, bin0, full, slot + per))
            if many > full:
                if n and n < per:
                    rows.append((size, int(rank[i]), int(rank[i]) + n, n, bin0 + full, slot))
                    rank[i] += n
                    insort(rooms, (room - n * size, bin0 + full, 1, slot + n))
                    full, n = full + 1, 0
                if many > full:
                    insort(rooms, (room, bin0 + full, many - full, slot))
    return rows, bins


def pack(docs: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, part_pieces: int = PART_PIECES) -> DataFrame:
    """Places for all documents in bins of ``capacity`` words.

    A document longer than a bin is cut into pieces of ``capacity`` words and a
    rest. Returns (doc_id, piece, start_word, n_words, bin, slot): words
    start_word to start_word + n_words of the document are the slot-th piece of
    the bin; the pieces of a bin are at most ``capacity`` words together. Words are
    runs of characters other than white space.

    Null, empty and blank texts have no words and no place; texts of any length
    are placed whole. Repeated rows are packed one by one. Pieces of one length
    are exchangeable: they are ranked by (doc_id, piece), ties and lengths of more
    than ``part_pieces`` pieces in parts, whichever comes first. A null doc_id is
    kept. Columns other than doc_id and text, whatever their names, are ignored.
    An empty table gives no places.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    words = docs.select("doc_id", F.regexp_count("text", F.lit("\\S+")).alias("w")).where("w > 0")
    cut = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), ((F.col("w") - 1) / capacity).cast("int"))).alias("piece"))
    start = F.col("piece") * capacity
    cut = cut.select("doc_id", "piece", start.alias("start_word"), F.least(F.lit(capacity), F.col("w") - start).cast("int").alias("n_words"))
    # the number tells repeated rows apart; it is written, so it stays the same
    cut = scratch.table(cut.withColumn("nr", F.monotonically_increasing_id()), "pieces")
    # at most ``capacity`` rows, whatever the corpus
    histogram = {r["n_words"]: r["count"] for r in cut.groupBy("n_words").count().collect()}
    plan = solve(histogram, capacity, rounds)
    # a length has parts in proportion to its pieces: at most pieces / part_pieces + capacity rows
    parts = spark.createDataFrame([(size, -(-n // part_pieces)) for size, n in sorted(histogram.items())], "n_words int, parts long")
    cut = cut.join(F.broadcast(parts), "n_words").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "nr"), "parts")).drop("parts")
    offsets, before = [], (None, 0)
    for r in sorted(cut.groupBy("n_words", "part").count().collect()):
        first = before[1] if r["n_words"] == before[0] else 0
        offsets.append((r["n_words"], r["part"], first))
        before = (r["n_words"], first + r["count"])
    offset = spark.createDataFrame(offsets, "n_words int, part long, offset long")
    places = spark.createDataFrame(plan.rows, "n_words int, rank0 long, rank1 long, per long, bin0 long, slot0 long")
    ranked = cut.withColumn("nth", F.row_number().over(Window.partitionBy("n_words", "part").orderBy("doc_id", "piece", "nr")) - 1)
    ranked = ranked.join(F.broadcast(offset), ["n_words", "part"]).withColumn("rank", F.col("nth") + F.col("offset"))
    placed = ranked.join(F.broadcast(places), "n_words").where("rank >= rank0 and rank < rank1")
    along = F.col("rank") - F.col("rank0")
    return placed.select("doc_id", "piece", "start_word", "n_words", (F.col("bin0") + F.floor(along / F.col("per"))).alias("bin"), (F.col("slot0") + along % F.col("per")).cast("int").alias("slot"))
