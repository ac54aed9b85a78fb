import random
from collections import Counter, defaultdict

from threadloom.llm import packing


def best_fit_decreasing(sizes, capacity):
    """Plain best fit: the room left of every container."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= size]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(capacity - size)
    return rooms


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([10, 37, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 150))]
        used = Counter()
        for size, low, high, first, each in packing.plan_packing(Counter(sizes), capacity):
            for rank in range(low, high):
                used[first + (rank - low) // each] += size
        rooms = sorted(capacity - n for n in used.values())
        assert rooms == sorted(best_fit_decreasing(sizes, capacity))
        assert sum(used.values()) == sum(sizes)


def test_pack_rows(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([3, 3, 3, 17, 50, 99, 100, 250, 0, None, -1]), "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, n int, container string")
    got = packing.pack(df, "id", "n", capacity=100, block=100).collect()
    assert Counter(r["item"] for r in got if r["container"] is not None) == Counter({i: -(-n // 100) for i, n, _ in rows if n and n > 0})
    load, total = defaultdict(int), Counter()
    for r in got:
        total[r["item"]] += r["n_units"]
        if r["container"] is not None:
            load[r["container"]] += r["n_units"]
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    assert all(total[i] == max(n or 0, 0) for i, n, _ in rows)
    pieces = [p for i, n, _ in rows if n and n > 0 for p in [100] * (n // 100) + [n % 100] * (n % 100 > 0)]
    assert sorted(100 - v for v in load.values()) == sorted(best_fit_decreasing(pieces, 100))
    assert packing.pack(df.limit(0), "id", "n").count() == 0
