"""A grouping genetic algorithm for bins, on islands with elite migration.

A genome is a set of bins. Documents of equal length are interchangeable, so
equal bins are one entry, ``sizes -> how many`` (sizes in descending order):
a genome has as many entries as there are kinds of bins, however many documents
they hold, and every step below moves whole entries.

* *Crossover* injects well-filled bins of one parent whole into a copy of the
  other, drops the other's bins that hold documents which are now there twice,
  and puts the displaced documents back by best fit.
* *Mutation* dissolves the emptiest bins and some others; displaced documents
  first replace one or two shorter ones in bins that they fill better, the rest
  goes back by best fit, in a disturbed order.

Islands are Spark tasks; after each epoch every island's best genome moves to
the next island (a ring), and the population is written to the shared folder,
so a lost executor costs one epoch of one island. All random choices follow
from (seed, epoch, island), so a repeated task gives the same genomes.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svcops.session import settled

ISLANDS = 8
POPULATION = 6
EPOCHS = 6
GENERATIONS = 12
#: A bin counts as well filled from this share of the capacity on.
WELL_FILLED = 0.99
#: Kinds of bins in which one mutation tries exchanges.
EXCHANGED = 200

Genome = dict[tuple[int, ...], int]

SCHEMA = "island int, place int, bins array<struct<sizes:array<int>,n:bigint>>"


def best_fit(bins: Genome, items: Counter, capacity: int, disturb=None) -> Genome:
    """``bins`` with ``items`` (length -> how many) added, each to the fullest bin
    that takes it; the longest first, or in the order of ``disturb(length)``."""
    rooms: dict[int, Genome] = {}
    for sizes, n in bins.items():
        rooms.setdefault(capacity - sum(sizes), {})[sizes] = n
    order = sorted(rooms)

    def add(sizes: tuple[int, ...], n: int) -> None:
        if n:
            room = capacity - sum(sizes)
            if room not in rooms:
                rooms[room] = {}
                insort(order, room)
            rooms[room][sizes] = rooms[room].get(sizes, 0) + n

    for size in sorted((s for s, n in items.items() if n > 0), key=disturb or (lambda s: -s)):
        left = items[size]
        while left:
            at = bisect_left(order, size)
            if at == len(order):  # no bin takes one: open new ones
                full, rest = divmod(left, capacity // size)
                add((size,) * (capacity // size), full)
                if rest:
                    add((size,) * rest, 1)
                break
            room = order[at]
            sizes, have = rooms[room].popitem()
            if not rooms[room]:
                del rooms[room]
                del order[at]
            each = room // size  # the fullest bin stays the fullest until it takes no more
            full, rest = divmod(left, each)
            used = min(full, have)
            add(_with(sizes, size, each), used)
            left -= used * each
            have -= used
            if have and left:  # fewer are left than one bin takes
                add(_with(sizes, size, left), 1)
                left, have = 0, have - 1
            add(sizes, have)
    return {sizes: n for kinds in rooms.values() for sizes, n in kinds.items()}


def _with(sizes: tuple[int, ...], size: int, times: int) -> tuple[int, ...]:
    return tuple(sorted(sizes + (size,) * times, reverse=True))


def contents(bins: Genome) -> Counter:
    """How many documents of each length the bins hold."""
    out: Counter = Counter()
    for sizes, n in bins.items():
        for s in sizes:
            out[s] += n
    return out


def crossover(a: Genome, b: Genome, capacity: int, rng: random.Random) -> Genome:
    """Whole well-filled bins of ``b`` in a copy of ``a``."""
    least = WELL_FILLED * capacity
    injected = {s: max(1, round(n * rng.uniform(0.2, 1))) for s, n in sorted(b.items()) if sum(s) >= least and rng.random() < 0.5}
    twice = contents(injected)  # each of these documents is in a bin of ``a`` too
    open_ = sum(twice.values())
    child, displaced = dict(injected), Counter()
    for sizes in sorted(a, key=lambda s: (sum(s), s)):  # poorly filled ones go first
        n, gone = a[sizes], 0
        if open_ and any(twice.get(s) for s in sizes):
            held = Counter(sizes)
            gone = min(n, max(-(-twice.get(s, 0) // k) for s, k in held.items()))
            for s, k in held.items():
                dropped = min(twice.get(s, 0), gone * k)
                if dropped:
                    twice[s] -= dropped
                    open_ -= dropped
                displaced[s] += gone * k - dropped
        if n > gone:
            child[sizes] = child.get(sizes, 0) + n - gone
    return best_fit(child, displaced, capacity)


def mutation(a: Genome, capacity: int, rng: random.Random) -> Genome:
    """The emptiest bins and a few others dissolved and filled anew."""
    child, displaced = dict(a), Counter()
    by_fill = sorted(a, key=lambda s: (sum(s), s))
    chosen = by_fill[: rng.randrange(1, 2 + len(by_fill) // 20)] + rng.sample(by_fill, len(by_fill) // 20)
    for sizes in dict.fromkeys(chosen):
        gone = max(1, round(a[sizes] * rng.uniform(0.2, 1)))
        child[sizes] -= gone
        if not child[sizes]:
            del child[sizes]
        for s in sizes:
            displaced[s] += gone
    exchange(child, displaced, capacity, rng)
    return best_fit(child, displaced, capacity, disturbed(rng))


def exchange(bins: Genome, displaced: Counter, capacity: int, rng: random.Random) -> None:
    """In bins that aren't full, one or two documents make place for a displaced
    one that fills the bin better; in place."""
    waiting = sorted(s for s, n in displaced.items() if n > 0)
    open_ = sorted(s for s in bins if sum(s) < capacity)
    for sizes in rng.sample(open_, min(len(open_), EXCHANGED)):
        room, n, best = capacity - sum(sizes), bins[sizes], None
        out = {(a,) for a in sizes} | {(a, b) for i, a in enumerate(sizes) for b in sizes[i + 1:]}
        for old in out:
            at = bisect_left(waiting, sum(old) + room + 1) - 1
            if at >= 0 and waiting[at] > sum(old) and (best is None or waiting[at] - sum(old) > best[0]
                                                        or (waiting[at] - sum(old) == best[0] and old > best[1])):
                best = waiting[at] - sum(old), old, waiting[at]
        if not best:
            continue
        _, old, new = best
        k = min(n, displaced[new])
        rest = Counter(sizes) - Counter(old)
        filled = tuple(sorted([*rest.elements(), new], reverse=True))
        bins[sizes] -= k
        if not bins[sizes]:
            del bins[sizes]
        bins[filled] = bins.get(filled, 0) + k
        displaced[new] -= k
        if not displaced[new]:
            waiting.remove(new)
        for s in old:
            if displaced[s] <= 0:
                insort(waiting, s)
            displaced[s] += k


def disturbed(rng: random.Random):
    share = rng.choice((0.0, 0.05, 0.2))
    return lambda s: -s * (1 + rng.uniform(-share, share))


def cost(bins: Genome) -> tuple:
    """Fewer bins first, then fuller ones beside emptier ones."""
    return sum(bins.values()), -sum(n * sum(s) ** 2 for s, n in bins.items())


def evolve(population: list[Genome], capacity: int, bound: int, rng: random.Random) -> list[Genome]:
    """One epoch of one island, the best genome first; it ends early where a
    genome needs no more bins than ``bound``."""
    ranked = sorted(((cost(g), i, g) for i, g in enumerate(population)), key=lambda x: x[:2])
    for _ in range(GENERATIONS):
        if ranked[0][0][0] <= bound:
            break
        children = []
        for _ in range(POPULATION):
            a, b = (min(rng.sample(ranked, min(2, len(ranked))), key=lambda x: x[0])[2] for _ in range(2))
            child = crossover(a, b, capacity, rng) if a is not b else a
            children.append(mutation(child, capacity, rng) if a is b or rng.random() < 0.5 else child)
        everyone = sorted([*ranked, *((cost(g), len(ranked) + i, g) for i, g in enumerate(children))], key=lambda x: x[:2])
        ranked = [x for i, x in enumerate(everyone) if i == 0 or x[0] != everyone[i - 1][0]][:POPULATION]
    return [g for _, _, g in ranked]


def _pack(genome: Genome) -> list[dict]:
    return [{"sizes": list(s), "n": n} for s, n in sorted(genome.items(), reverse=True)]


def _unpack(bins) -> Genome:
    return {tuple(int(s) for s in b["sizes"]): int(b["n"]) for b in bins}


def packed(spark: SparkSession, lengths: dict[int, int], capacity: int, seed: int = 1, islands: int = ISLANDS,
           epochs: int = EPOCHS) -> Genome:
    """Bins of at most ``capacity`` for ``lengths`` (length -> how many, at most
    ``capacity`` entries, each from 1 to ``capacity``)."""
    if not lengths:
        return {}
    bound = -(-sum(s * n for s, n in lengths.items()) // capacity)
    items = Counter(lengths)

    def founders(batch: pd.DataFrame) -> pd.DataFrame:
        island = int(batch["island"].iloc[0])
        rng = random.Random(f"{seed}-{island}")
        own = [best_fit({}, items, capacity, None if island == i == 0 else disturbed(rng)) for i in range(POPULATION)]
        return pd.DataFrame([(island, i, _pack(g)) for i, g in enumerate(own)], columns=["island", "place", "bins"])

    def epoch(number: int):
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            island = int(batch["island"].iloc[0])
            own = [_unpack(b) for b in batch.sort_values("place")["bins"]]
            ranked = evolve(own, capacity, bound, random.Random(f"{seed}-{island}-{number}"))
            return pd.DataFrame([(island, i, _pack(g)) for i, g in enumerate(ranked)], columns=["island", "place", "bins"])
        return run

    everyone = settled(spark.range(islands).select(F.col("id").cast("int").alias("island")).repartition(islands, "island")
                       .groupBy("island").applyInPandas(founders, SCHEMA))
    best, unchanged = None, 0
    for number in range(epochs + 1):
        now = _state(everyone)
        unchanged = unchanged + 1 if best is not None and now >= best else 0
        best = now
        if now[0] <= bound or number == epochs or unchanged == 2:
            break
        elites = everyone.where("place = 0").select(F.expr(f"int((island + 1) % {islands})").alias("island"),
                                                    F.lit(POPULATION).alias("place"), "bins")
        everyone = settled(everyone.union(elites).repartition(islands, "island").groupBy("island").applyInPandas(epoch(number), SCHEMA))
    sizes = _costed(everyone).orderBy("used", "slack", "island", "place").select("bins").first()
    return _unpack(sizes["bins"])


def _costed(population: DataFrame) -> DataFrame:
    used = F.expr("aggregate(bins, 0L, (a, b) -> a + b.n)")
    full = F.expr("aggregate(bins, 0D, (a, b) -> a - b.n * double(pow(aggregate(b.sizes, 0, (x, y) -> x + y), 2)))")
    return population.select("*", used.alias("used"), full.alias("slack"))


def _state(population: DataFrame) -> tuple:
    """The best genome's cost."""
    r = _costed(population).orderBy("used", "slack").select("used", "slack").first()
    return r["used"], r["slack"]
