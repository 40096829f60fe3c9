import numpy as np
import pytest

from tessera.llm import embedding_dedup as E
from tessera.llm import queries
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"


def plain(rows, threshold=0.9):
    """rows: (id, vector or None) -> sorted (id, n_links, component_id, kept)."""
    n = len(rows)
    ok = [k is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for k, v in rows]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if good else None for (k, v), good in zip(rows, ok, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for dim in {len(u) for u in unit if u is not None}:
        at = [i for i in range(n) if ok[i] and len(unit[i]) == dim]
        x = np.array([unit[i] for i in at])
        for a, b in np.argwhere(np.triu(x @ x.T >= threshold, 1)):
            i, j = at[a], at[b]
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(rows[i][0], low.get(find(i), rows[i][0]))
    return sorted(((rows[i][0], links[i], low.get(find(i)), rows[i][0] is not None and rows[i][0] == low.get(find(i))) for i in range(n)), key=str)


def got(df, **options):
    return sorted((tuple(r) for r in E.embedding_components(df, **options).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, item long, component_id string")


def test_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    assert sorted((tuple(r) for r in queries.op8_embedding_dedup(spark, SF).collect()), key=str) == plain(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.1]), (10, [-1.0, 0.0]), (11, [1.0]), (12, [1.0, 0.0, 0.0]), (13, [1e-30, 1e-31]), (14, [-0.0, 1.0]), (15, [0.0, 1.0])]
    assert got(frame(spark, rows)) == plain(rows)
    assert got(frame(spark, rows).limit(0)) == []


@pytest.mark.parametrize("noise", [0.02, 0.035, 0.05])
def test_crowds_are_whole(spark, noise, monkeypatch):
    """Crowds larger than a window, tight (balls), loose (compared member by member) and in between, and copies."""
    rng = np.random.default_rng(int(noise * 1000))
    monkeypatch.setattr(E, "WINDOW", 64)
    base = rng.normal(0, 1, (400, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    crowd = base[:1] + rng.normal(0, noise, (500, 64))
    pairs = base[1:150] + rng.normal(0, noise, (149, 64))
    x = np.concatenate([base, crowd, pairs, crowd[:40]]).astype(np.float32)
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(x)), x.tolist(), strict=True)]
    want, found = plain(rows), got(frame(spark, rows))
    assert [r[0] for r in want] == [r[0] for r in found]
    n_want, n_found = sum(r[1] for r in want), sum(r[1] for r in found)
    assert all(f[1] <= w[1] for f, w in zip(found, want, strict=True))  # none below the threshold
    assert n_found >= (1 if noise < 0.03 else 0.98) * n_want, n_found / n_want


def test_passes_grow_slowly():
    assert E.passes_needed(100, 0.9, 256, 0.01) == 6
    assert 6 < E.passes_needed(50_000, 0.9, 256, 0.01) < 20 < E.passes_needed(10**7, 0.9, 256, 0.01) < 120


@pytest.mark.parametrize(("window", "path"), [(256, "_all_candidates"), (16, "_candidates")])
def test_pairs_within_a_topic(spark, window, path, monkeypatch):
    """A third of the rows at mutual cosines around 0.7 that do not link, with planted pairs at 0.9 to 0.95."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    topic = unit(np.sqrt(0.7) * unit(rng.normal(0, 1, (1, 64))) + np.sqrt(0.3) * unit(rng.normal(0, 1, (2000, 64))))
    first, away = topic[:300], rng.normal(0, 1, (300, 64))
    away = unit(away - (away * first).sum(axis=1)[:, None] * first)
    cosine = rng.uniform(0.901, 0.95, (300, 1))
    x = np.concatenate([topic, unit(rng.normal(0, 1, (3700, 64))), cosine * first + np.sqrt(1 - cosine**2) * away]).astype(np.float32)
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(x)), x.tolist(), strict=True)]
    monkeypatch.setattr(E, "WINDOW", window)
    used = []
    for name in ("_all_candidates", "_candidates"):
        monkeypatch.setattr(E, name, lambda *a, f=getattr(E, name, None), name=name: used.append(name) or f(*a), raising=False)
    want, found = plain(rows), got(frame(spark, rows))
    n_want, n_found = sum(r[1] for r in want), sum(r[1] for r in found)
    assert n_want >= 600 and all(f[1] <= w[1] for f, w in zip(found, want, strict=True))
    assert n_found >= (1 if window == 256 else 0.98) * n_want, n_found / n_want
    assert used == [path]


@pytest.mark.parametrize("common", [0.0, 0.74])
def test_recall_over_many_vectors(spark, tmp_path, common):
    """30,000 vectors, also with a direction that all share, and 3,000 planted at 0.90 to 0.93; all links by brute force."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    mean, own = unit(rng.normal(0, 1, (1, 64))), rng.normal(0, 1, (30_000, 64))
    own = unit(own - (own @ mean.T) * mean)
    base = np.sqrt(common) * mean + np.sqrt(1 - common) * own
    first, away = base[:3000], rng.normal(0, 1, (3000, 64))
    away = unit(away - (away * first).sum(axis=1)[:, None] * first)
    cosine = rng.uniform(0.9, 0.93, (3000, 1))
    x = rng.permutation(np.concatenate([base, cosine * first + np.sqrt(1 - cosine**2) * away])).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "x.parquet", row_group_size=4096)
    y = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = np.concatenate([(y[k : k + 2000] @ y.T >= 0.9).sum(axis=1) - 1 for k in range(0, len(y), 2000)])
    found = np.zeros(len(x), int)
    for r in E.embedding_components(spark.read.parquet(str(tmp_path / "x.parquet"))).collect():
        found[r["vec_id"]] = r["n_links"]
    assert want.sum() >= 5900 and (found <= want).all()
    assert found.sum() >= 0.99 * want.sum(), found.sum() / want.sum()


def test_sketches_are_off_by_what_they_say():
    rng = np.random.default_rng(2)
    for dim in (1, 2, 3, 64, 1000):
        x = E.exact_unit(rng.normal(0, 1, (200, dim)) ** 3)
        q, rho = E.sketch(x)
        y = q / np.linalg.norm(q.astype(float), axis=1)[:, None]
        assert (np.linalg.norm(x - y, axis=1) <= rho).all() and rho.max() < 0.2


@pytest.mark.parametrize("common", [0.0, 0.5])
def test_links_do_not_depend_on_the_path(spark, common, monkeypatch):
    """Pairs at the threshold itself, where passes miss most: passes and all pairs at once give the links of brute force, both."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    base = unit(np.sqrt(common) * unit(rng.normal(0, 1, (1, 64))) + np.sqrt(1 - common) * unit(rng.normal(0, 1, (3500, 64))))
    first, away = base[:1500], rng.normal(0, 1, (1500, 64))
    away = unit(away - (away * first).sum(axis=1)[:, None] * first)
    cosine = rng.uniform(0.9001, 0.903, (1500, 1))
    crowd = base[-1:] + rng.normal(0, 0.04, (60, 64))
    x = rng.permutation(np.concatenate([base, cosine * first + np.sqrt(1 - cosine**2) * away, crowd])).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(9000 + i, v) for i, v in enumerate(rng.normal(0, 1, (40, 3)).tolist())]
    want = plain(rows)
    for window in (16, 256):
        monkeypatch.setattr(E, "WINDOW", window)
        assert got(frame(spark, rows)) == want, window
