"""First-fit decreasing over a histogram, and carried values over range partitions, against plain loops."""

import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tessera.operators import encode, packing, ranges
from tessera.plans import encoding

from .compare import differences, duck_rows


def first_fit(items, size):
    """(bin, position, id, length): each item in turn into the first bin with room."""
    room, filled, out = [], [], []
    for key, n in sorted(items, key=lambda x: (-x[1], x[0])):
        k = next((k for k, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(size)
            filled.append(0)
        out.append((k, filled[k], key, n))
        room[k] -= n
        filled[k] += 1
    return sorted(out)


def by_deals(items, size):
    counts, ids = {}, {}
    for key, n in sorted(items):
        counts[n] = counts.get(n, 0) + 1
        ids.setdefault(n, []).append(key)
    return sorted((d.first + i, d.place + j, ids[d.length][d.rank + i * d.each + j], d.length) for d in packing.first_fit_deals(counts, size) for i in range(d.bins) for j in range(d.each))


def test_deals_are_first_fit_decreasing():
    rng = random.Random(6)
    for _ in range(400):
        size = rng.randint(1, 30)
        items = list(enumerate(rng.choices(range(size + 1), k=rng.randrange(80))))
        rng.shuffle(items)
        assert by_deals(items, size) == first_fit(items, size)
    assert packing.first_fit_deals({}, 5) == []
    for length in (9, -1):
        with pytest.raises(ValueError):
            packing.first_fit_deals({length: 1}, 8)


def test_deals_do_not_grow_with_the_items():
    rng = random.Random(7)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 321)}
    deals = packing.first_fit_deals(counts, 320)
    assert len(deals) < 4 * 320 * 8
    assert {n: sum(d.bins * d.each for d in deals if d.length == n) for n in counts} == counts


def test_packing_over_partitions(spark):
    rng = random.Random(8)
    items = [(i, rng.choice([0, 0, 3, 7, 7, 11, 20])) for i in range(2000)]
    rng.shuffle(items)
    df = spark.createDataFrame([(*x, "kept out") for x in items], "key long, n int, bin string")
    for parts in (1, 7):
        assert sorted(map(tuple, packing.pack_first_fit(df.repartition(parts), "key", "n", 20).collect())) == first_fit(items, 20)
    assert packing.pack_first_fit(df.limit(0), "key", "n", 20).count() == 0
    with pytest.raises(SparkRuntimeException, match="does not fit"):
        packing.pack_first_fit(df, "key", "n", 19).collect()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_packing_query_at_larger_sizes(spark, sf):
    sql = {name: duck_rows(encoding.ORACLE_SQL[name], f"/root/testdata/{sf}") for name in ("pack_ffd",)}
    assert differences([r.asDict() for r in encoding.pack_ffd(spark, f"/root/testdata/{sf}").collect()], sql["pack_ffd"]) is None


def history(rng, n):
    """One key with 90 % of the rows, null keys, values with gaps; times that tie are told apart by id."""
    return [(rng.choice(["hot"] * 18 + ["a", None]), rng.randint(0, 50), i, rng.choice([None, rng.randint(-5, 5)])) for i in range(n)]


def test_ranks(spark):
    rng = random.Random(9)
    rows = history(rng, 700)
    df = spark.createDataFrame(rows, "k string, t int, i int, x int").repartition(5)
    got = {r["i"]: r["rank"] for r in ranges.ranked(df, [F.col("t").desc(), F.col("i")]).collect()}
    assert got == {r[2]: at for at, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    assert ranges.ranked(df.limit(0), [F.col("t")]).count() == 0
    assert [r["batch"] for r in encode.batches(df, [F.col("i")], 100).orderBy("i").collect()] == [i // 100 for i in range(700)]


def test_carried_values(spark):
    rng = random.Random(10)
    for n in (0, 1, 40, 900):
        rows = history(rng, n)
        df = spark.createDataFrame(rows, "k string, t int, i int, x int").repartition(3)
        placed = ranges.ranged(df, ["k"], ["t", "i"])
        got = ranges.carried(placed, ["k"], ["t", "i"], previous={"p": F.col("x")}, latest={"b": F.col("x")}, total={"s": F.col("x"), "c": F.lit(1)}).collect()
        seen, want = {}, {}
        for k, _t, i, x in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
            mine = seen.setdefault(k, [])
            known = [v for v in mine if v is not None]
            after = [v for v in [*mine, x] if v is not None]
            want[i] = (mine[-1] if mine else None, known[-1] if known else None, sum(after) if after else None, len(mine) + 1)
            mine.append(x)
        assert {r["i"]: (r["p"], r["b"], r["s"], r["c"]) for r in got} == want
        if n == 900:
            assert max(r["count"] for r in placed.groupBy(ranges.PART).count().collect()) < 500  # of 810 rows of one key


def test_what_is_carried_is_one_row_a_partition(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("t"))
    placed = ranges.ranged(df, ["k"], ["t"])
    out = ranges.carried(placed, ["k"], ["t"], total={"n": F.lit(1)})
    assert out.agg(F.max("n"), F.sum("n")).first() == (5, 15_000)
