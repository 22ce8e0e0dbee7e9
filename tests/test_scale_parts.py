"""Walks, exact cells and their upkeep, tiles, blocks of queries, versions, buckets,
fits of many models, ranks, slices and the blocked collapse, against plain Python."""

import os
import random
import threading
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from photocat.lineage import cut, shared_dir
from photocat.operators import catalog, cell_upkeep, duplicates, inference, ranking, ranks, stats, taste, taste_fits, tiles, vectors
from photocat.sources import files, versions, walk

VECTORS = "image_id string, embedding array<float>"


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def clustered(rng, n, dim, clusters, noise=0.05):
    centres = rng.normal(size=(clusters, dim))
    return unit(centres[rng.integers(0, clusters, n)] + noise * rng.normal(size=(n, dim)))


def table(spark, x, prefix="v", parts=5):
    return spark.createDataFrame([(f"{prefix}{i:05d}", v.tolist()) for i, v in enumerate(x)], VECTORS).repartition(parts)


def nearest(rows, q, k):
    """rows: id -> vector; ids of the k best, ties to the smaller id."""
    q = np.asarray(q, np.float64)
    return sorted(rows, key=lambda i: (-float(np.asarray(rows[i], np.float64) @ q), i))[:k]


# A walk of the tree --------------------------------------------------------------


def test_walk_lists_what_the_listing_does(spark, tmp_path):
    rng = random.Random(1)
    for d in range(40):
        folder = tmp_path / "lib" / f"y{d % 3}" / f"m {d % 7}" / f"d%{d}"
        folder.mkdir(parents=True)
        for i in range(rng.randrange(6)):
            (folder / f"p{i}{rng.choice(['.jpg', '.JPG', '.Jpg', '.png', '.txt'])}").write_bytes(b"x" * rng.randrange(1, 50))
    (tmp_path / "lib" / "empty").mkdir()
    os.symlink(tmp_path / "lib", tmp_path / "lib" / "circle")
    os.symlink(tmp_path / "lib" / "none.jpg", tmp_path / "lib" / "broken.jpg")
    got = {tuple(r) for r in walk.walk_files(spark, str(tmp_path / "lib")).collect()}
    os.unlink(tmp_path / "lib" / "circle")
    os.unlink(tmp_path / "lib" / "broken.jpg")
    assert got and got == {tuple(r) for r in files.list_files(spark, str(tmp_path / "lib")).collect()}
    (tmp_path / "lib" / "_hidden.jpg").write_bytes(b"1")
    (tmp_path / "lib" / "empty.jpg").write_bytes(b"")
    assert walk.walk_files(spark, f"file:{tmp_path}/lib").count() == len(got) + 2
    assert walk.walk_files(spark, str(tmp_path / "lib" / "empty")).count() == 0


def test_the_driver_holds_no_listing(spark, sf_dir, tmp_path):
    from photocat.plans.catalogue_queries import ORACLE_SQL, QUERIES
    from tools.compare import TABLES, rows_of

    rows = [(i, None if i % 5 == 0 else "" if i % 5 == 1 else "ä" * i, f"s{i % 3}" if i else None) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    mine, theirs = rows_of(spark, QUERIES["listed_files"], ORACLE_SQL["listed_files"], str(tmp_path))
    assert mine == theirs and any(r[0] == "0" for r in mine)  # empty files too
    for d in range(70):
        (tmp_path / "lib" / f"d{d}").mkdir(parents=True)
        (tmp_path / "lib" / f"d{d}" / "a.jpg").write_bytes(b"xy")
    whole = files.list_files(spark, str(tmp_path / "lib"))
    assert whole.count() == 70 and "binaryfile" not in whole._jdf.queryExecution().toString().lower()
    assert files.list_files(spark, str(tmp_path / "lib" / "d[1-3]")).count() == 3  # a pattern: Spark's listing
    assert [r["file_size"] for r in files.list_files(spark, str(tmp_path / "lib" / "d7" / "a.jpg")).collect()] == [2]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.list_files(spark, str(tmp_path / "none"))


def test_a_wide_folder_comes_in_batches(spark, tmp_path, monkeypatch):
    for i in range(50):
        (tmp_path / f"{i}.jpg").write_bytes(b"")
    monkeypatch.setattr(walk, "ROWS", 7)
    assert walk.walk_files(spark, str(tmp_path)).count() == 50


# Exact search over cells ---------------------------------------------------------


@pytest.mark.parametrize("kind", ["clusters", "random", "copies"])
def test_cells_are_exact_by_bounds(spark, kind):
    rng = np.random.default_rng(3)
    x = clustered(rng, 400, 12, 20) if kind != "random" else unit(rng.normal(size=(400, 12)))
    if kind == "copies":
        x[:150] = x[0]
    e = table(spark, x)
    index = vectors.build_index(e, f"{shared_dir(spark)}/exact-{kind}", cells=15, probes=2, approximate_from=1)
    asks = spark.createDataFrame([(i, x[i * 7].tolist()) for i in range(30)] + [(99, [0.0] * 12)], "query_id long, query_vec array<float>")
    got = index.nearest(asks, 6, exact=True).collect()
    rows = {f"v{i:05d}": v for i, v in enumerate(x)}
    for q in range(30):
        assert [r["image_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == nearest(rows, x[q * 7], 6)
    read = {r["query_id"]: r["cells_read"] for r in got}
    assert all(2 <= n <= 15 for n in read.values())
    if kind == "clusters":
        assert np.mean([read[q] for q in range(30)]) < 8  # most cells are ruled out
    assert all(r["cells_read"] == 2 for r in index.nearest(asks, 6).collect())


def test_only_cells_that_are_asked_for_are_read(spark):
    x = clustered(np.random.default_rng(4), 300, 8, 10)
    index = vectors.build_index(table(spark, x), f"{shared_dir(spark)}/pruned", cells=10, probes=1, approximate_from=1)
    asks = spark.createDataFrame([(1, x[0].tolist())], "query_id long, query_vec array<float>")
    plan = index.nearest(asks, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan or "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("cells", [False, True])
def test_many_queries_go_in_blocks(spark, monkeypatch, cells):
    for name, value in (("FEW", 4), ("QUERIES", 10), ("SCORES", 300)):
        monkeypatch.setattr(vectors, name, value)
    x = clustered(np.random.default_rng(5), 200, 6, 8)
    e, rows = table(spark, x), {f"v{i:05d}": v for i, v in enumerate(x)}
    asks = spark.createDataFrame([(i, x[i].tolist()) for i in range(35)], "query_id long, query_vec array<float>")
    if cells:
        got = vectors.build_index(e, f"{shared_dir(spark)}/blocks", cells=6, probes=2, approximate_from=1).nearest(asks, 4, exact=True).collect()
    else:
        got = vectors.knn_batch(e, asks, 4).collect()
    for q in range(35):
        assert [r["image_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == nearest(rows, x[q], 4)
    none = asks.limit(0)
    assert vectors.knn_batch(e, none, 4).count() == 0


# Upkeep --------------------------------------------------------------------------


def sizes(index):
    return {r["cell"]: r["count"] for r in index.dealt.groupBy("cell").count().collect()}


def test_an_index_follows_its_table(spark):
    rng = np.random.default_rng(6)
    x = clustered(rng, 300, 8, 9)
    want = {f"v{i:05d}": v for i, v in enumerate(x[:150])}
    bound = 50 * (6 + 32)  # fifty rows of a cell
    index = cell_upkeep.create_index(table(spark, x[:150], parts=2), f"{shared_dir(spark)}/upkept", cells=3, cell_bytes=bound)
    steps = [
        ({f"v{i:05d}": x[299 - i] for i in range(0, 300, 3)}, [f"v{i:05d}" for i in range(1, 200, 5)]), ({"v00001": None, "v00002": x[0]} | {f"w{i:05d}": x[7] for i in range(70)}, ["v00004", "nobody"])]
    before = index
    for changed, deleted in steps:
        rows = spark.createDataFrame([(i, None if v is None else v.tolist()) for i, v in changed.items()], VECTORS)
        index = cell_upkeep.update_index(index, rows, spark.createDataFrame([(i,) for i in deleted], "image_id string") if deleted else None)
        want = {i: v for i, v in (want | changed).items() if v is not None and (i in changed or i not in deleted)}
        want = {i: v for i, v in want.items() if i not in deleted or i in changed}
        got = sizes(index)
        assert sum(got.values()) == len(want) and max(got.values()) <= 50 and [got.get(i, 0) for i in range(len(index.rows))] == list(index.rows)
    asks = spark.createDataFrame([(i, x[i * 11].tolist()) for i in range(20)], "query_id long, query_vec array<float>")
    small = cell_upkeep.compact(index, f"{shared_dir(spark)}/compact", cells=2)
    assert sum(small.rows) == len(want) and small.generation == 0
    for own in (index,):
        found = own.nearest(asks, 5, exact=True).collect()
        for q in range(20):
            assert [r["image_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == nearest(want, x[q * 11], 5)
    # the generation that a reader began with is as it was
    old = {f"v{i:05d}": v for i, v in enumerate(x[:150])}
    found = before.nearest(asks, 5, exact=True).collect()
    assert [r["image_id"] for r in sorted((r for r in found if r["query_id"] == 3), key=lambda r: r["rank"])] == nearest(old, x[33], 5)
    with pytest.raises(ValueError, match="vector"):
        cell_upkeep.create_index(table(spark, x[:3]).where("false"), f"{shared_dir(spark)}/none")


@pytest.mark.parametrize("few", [4, 256])
def test_many_small_cells_share_files(spark, monkeypatch, few):
    rng = np.random.default_rng(16)
    x = unit(rng.normal(size=(900, 8)))
    path = f"{shared_dir(spark)}/small-cells-{few}"
    index = cell_upkeep.create_index(table(spark, x[:600]), path, cells=3, cell_bytes=12 * (6 + 32))
    index = cell_upkeep.update_index(index, table(spark, x, parts=3).where("image_id >= 'v00500'"), table(spark, x).where("image_id < 'v00050'").select("image_id"))
    assert len(index.rows) > 80 and max(index.rows) <= 12 and sum(index.rows) == 850
    written = [f for _, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet")]
    assert len(written) < len(index.rows)  # the driver lists all files
    plan = index.dealt._jdf.queryExecution().analyzed().toString()
    assert "map(" not in plan and " IN (" not in plan  # nor does it hold an expression for each cell
    asks = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 900, 30)], "query_id long, query_vec array<float>")
    rows = {f"v{i:05d}": v for i, v in enumerate(x) if i >= 50}
    monkeypatch.setattr(cell_upkeep, "FEW", few)
    for r in index.nearest(asks, 4, exact=True).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "image_id"))).alias("r")).collect():
        assert [v["image_id"] for v in r["r"]] == nearest(rows, x[r["query_id"]], 4)


def test_the_driver_holds_bits_for_queries_and_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SCORES", 1 << 14)
    rng = np.random.default_rng(17)
    x, centres = unit(rng.normal(size=(500, 4))), unit(rng.normal(size=(4000, 4))).astype(np.float64)
    cell = (x @ centres.T).argmax(axis=1)
    far = np.full(4000, -1.0)
    np.maximum.at(far, cell, np.linalg.norm(x - centres[cell], axis=1))
    dealt = spark.createDataFrame([(f"v{i:05d}", v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, cell, strict=True))], "image_id string, embedding array<float>, cell int")
    q = unit(rng.normal(size=(2001, 4)))
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, query_vec array<float>")
    tracemalloc.start()
    got = vectors.knn_cells_batch(dealt, list(centres), asks, 1, 30, far).collect()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = (q.astype(np.float64) @ x.T.astype(np.float64)).argmax(axis=1)
    assert {r["query_id"]: r["image_id"] for r in got} == {i: f"v{j:05d}" for i, j in enumerate(want)} and len(got) == 2001
    assert most < 40 << 20  # a number for each query and cell would take 64 MB


# Tiles ---------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["clusters", "random"])
def test_tiles_find_every_pair(spark, monkeypatch, kind):
    for name, value in (("TILE", 20), ("GROUP", 3), ("SCORES", 500), ("REFERENCES", 12)):
        monkeypatch.setattr(tiles, name, value)
    rng = np.random.default_rng(7)
    x = clustered(rng, 300, 10, 40, 0.06) if kind == "clusters" else unit(rng.normal(size=(300, 10)))
    x[50:90] = x[50]  # forty equal ones
    rows = [(f"v{i:05d}", v.tolist()) for i, v in enumerate(x)] + [("none", None), ("short", [1.0, 0.0]), ("shorter", [0.998, 0.0632])]
    got, report = tiles.exact_pairs(spark.createDataFrame(rows, VECTORS).repartition(4), 0.97)
    got = {(r["a"], r["b"]) for r in got.collect()}
    first = {}
    for i, v in rows:
        if v is not None:
            first.setdefault(tuple(v), i)
    want = {(first[tuple(v)], i) for i, v in rows if v is not None and first[tuple(v)] != i}
    ids = sorted(first.values())
    vec = {i: np.asarray(v, np.float64) for v, i in first.items()}
    want |= {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(vec[a]) == len(vec[b]) and float(vec[a] @ vec[b]) >= 0.97}
    assert got == want
    long = next(r for r in report.collect() if r["dimension"] == 10)
    assert long["pairs"] == long["tiles"] * (long["tiles"] + 1) // 2 >= 100
    if kind == "clusters":
        assert long["multiplied"] < 0.5 * long["pairs"]
    near = {(r["a"], r["b"]) for r in duplicates.near_duplicate_pairs(spark.createDataFrame(rows, VECTORS), 0.97).collect()}
    assert near <= want and len(near) > 0.98 * len(want)


# Greedy collapse -------------------------------------------------------------------


@pytest.mark.parametrize("noise", [0.02, 0.2, 1.0])
def test_blocks_collapse_as_one_row_after_the_other(monkeypatch, noise):
    monkeypatch.setattr(ranking, "GREEDY", 17)
    rng = np.random.default_rng(8)
    for turn in range(8):
        x = clustered(rng, 150, 5, 12, noise).astype(np.float64)
        if turn % 2:  # a chain: each is like its neighbours only
            angle = np.arange(150) * 0.2
            x = np.stack([np.cos(angle), np.sin(angle)], axis=1)[rng.permutation(150)]
        x[100] = x[3]
        settled = 0 if turn < 4 else 2
        kept, owner = [], []
        for i, v in enumerate(x):
            like = [float(x[j] @ v) for j in kept]
            if i >= settled and like and max(like) >= 0.97:
                owner.append(kept[int(np.argmax(like))])
            else:
                kept.append(i)
                owner.append(i)
        got = ranking.greedy_owners(x, settled, 0.97)
        assert [g == i for i, g in enumerate(got)] == [o == i for i, o in enumerate(owner)]
        assert all(g == o or abs(float(x[g] @ x[i]) - float(x[o] @ x[i])) < 1e-12 for i, (g, o) in enumerate(zip(got, owner, strict=True)))
    assert ranking.greedy_owners(np.zeros((0, 3)), 0, 0.97).tolist() == []


# Versions and buckets ------------------------------------------------------------


def test_two_writers_lose_nothing(spark, tmp_path):
    base, errors = str(tmp_path / "table"), []
    versions.change(spark, base, lambda _: spark.createDataFrame([("start", 0)], "k string, v int"))
    pinned = versions.read_version(spark, base)

    def write(name):
        try:
            for i in range(3):
                row = spark.createDataFrame([(f"{name}{i}", i)], "k string, v int")
                versions.change(spark, base, lambda now: catalog.upsert(now, row, "k"))
        except Exception as e:
            errors.append(e)

    writers = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors and versions.current(spark, base) == 6
    assert {r["k"] for r in versions.read_version(spark, base).collect()} == {"start", *(f"{n}{i}" for n in "ab" for i in range(3))}
    assert [r["k"] for r in pinned.collect()] == ["start"] and versions.read_version(spark, base, 2).count() == 3


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "table")
    versions.change(spark, base, lambda _: spark.range(5))
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            versions.change(spark, base, lambda now: now.where("id > 2"))
    assert versions.current(spark, base) == 0 and versions.read_version(spark, base).count() == 5
    versions.change(spark, base, lambda now: now.where("id > 3"))
    left = lambda: sum(n.startswith("data-") for n in os.listdir(base))
    assert left() == 3 and versions.clean_up(spark, base, 3600) == [] and left() == 3
    assert versions.clean_up(spark, base, -10) == [0] and left() == 1 and versions.read_version(spark, base).count() == 1
    assert not versions.put_if_absent(spark, f"file:{base}/_log/{1:020d}.json", "{}")
    assert versions.read_version(spark, str(tmp_path / "nothing")) is None


def contents(folder):
    return {os.path.join(d, n): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_buckets_that_do_not_change_stay(spark, tmp_path):
    base = str(tmp_path / "buckets")
    rows = spark.range(2000).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    versions.create_buckets(rows, base, "k", 64)
    before = contents(base)
    new = spark.createDataFrame([(str(i), -1) for i in (3, 5, 5000)], "k string, v long")
    number, touched = versions.upsert_buckets(spark, base, new, "k")
    after = contents(base)
    assert number == 1 and 1 <= len(touched) <= 3 and all(after[f] == c for f, c in before.items())
    got = versions.read_version(spark, base)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in catalog.upsert(rows, new, "k").collect()}
    paths = {p.rsplit("/_bucket=", 1)[0] for p in got.inputFiles()}
    assert len(paths) == 2 and sum("_bucket" in f for f in got.inputFiles()) <= 64
    patched, _ = versions.upsert_buckets(spark, base, spark.createDataFrame([("7", 1)], "k string, v long"), "k", merge=lambda old, now, key: catalog.patch(old, now, key, ["v"]))
    assert patched == 2 and versions.read_version(spark, base).where("k = '7'").first()["v"] == 1 and versions.read_version(spark, base, 0).count() == 2000
    with pytest.raises(versions.Conflict):
        versions.create_buckets(rows, base, "k", 64)


def test_changes_of_other_buckets_are_joined(spark, tmp_path):
    base = str(tmp_path / "buckets")
    rows = spark.range(300).select(F.col("id").cast("string").alias("k"), F.lit(0).cast("long").alias("v"))
    versions.create_buckets(rows, base, "k", 64)
    merged = []

    def slow(value, other):
        def merge(old, new, key):
            if other is not None and len(merged) < 1:  # somebody else commits meanwhile
                merged.append(1)
                versions.upsert_buckets(spark, base, spark.createDataFrame([other], "k string, v long"), key)
            merged.append(value)
            return catalog.upsert(old, new, key)

        return merge

    versions.upsert_buckets(spark, base, spark.createDataFrame([("1", 11)], "k string, v long"), "k", merge=slow(11, ("2", 22)))
    assert merged == [1, 11]  # not made again, as the other's bucket is another
    merged.clear()
    versions.upsert_buckets(spark, base, spark.createDataFrame([("1", 33)], "k string, v long"), "k", merge=slow(33, ("1", 44)))
    assert merged == [1, 33, 33]  # made again
    assert {r["k"]: r["v"] for r in versions.read_version(spark, base).where("v > 0").collect()} == {"1": 33, "2": 22}


# Fits of many models ---------------------------------------------------------------


def test_all_models_of_a_grid_in_the_same_passes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    d = rng.normal(size=(300, 6)) + 0.4
    rows = cut(taste.folds(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "vote_id long, d array<double>")).repartition(3))
    fold = np.array([r["fold"] for r in sorted(rows.collect(), key=lambda r: r["vote_id"])])
    passes = []
    real = taste_fits.loss_sums
    monkeypatch.setattr(taste_fits, "loss_sums", lambda *a: passes.append(len(a[1])) or real(*a))
    models = [taste_fits.Model(l2, f) for l2 in taste.GRID for f in (None, 0, 1, 2, 3, 4)]
    weights = taste_fits.fit_models(rows, models, n_bad=40)
    assert passes[0] == 30 and len(passes) < 60
    for m, w in zip(models, weights, strict=True):
        x = d[fold != m.left_out] if m.left_out is not None else d
        v = np.zeros(6)
        for _ in range(50):  # Newton's method on the same loss
            s = 1 / (1 + np.exp(x @ v))
            v -= np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x / (len(x) + 40) + 2 * m.l2 * np.eye(6), -(x.T @ s) / (len(x) + 40) + 2 * m.l2 * v)
        assert w == pytest.approx(v, abs=1e-5)
    one = taste.fit_taste(rows.select("d"), 0.01, 40)
    assert weights[models.index(taste_fits.Model(0.01))] == pytest.approx(one, abs=1e-4)
    right = taste_fits.left_out_accuracy(rows, models, weights)
    assert right == pytest.approx([np.mean(d[fold == m.left_out] @ w > 0) if m.left_out is not None else 0 for m, w in zip(models, weights, strict=True)])
    best = max((np.mean([right[models.index(taste_fits.Model(l2, f))] for f in range(5)]), -i) for i, l2 in enumerate(taste.GRID))
    assert taste.choose_l2(rows.drop("fold"), 40) == (taste.GRID[-best[1]], pytest.approx(best[0]))
    assert taste.choose_l2(rows.where("false").drop("fold"), 40) == (taste.GRID[0], 0.0)


# Ranks -----------------------------------------------------------------------------


@pytest.mark.parametrize("group", [1000, 2])
def test_positions_are_exact(spark, monkeypatch, group):
    monkeypatch.setattr(ranks, "GROUP", group)
    rng = random.Random(10)
    rows = [(i, rng.choice([None, 1.0, 2.0, rng.random()])) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(9)
    got = {r["k"]: r["position"] for r in ranks.positions(df, [F.asc_nulls_first("v"), F.col("k")]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [k for k, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    assert sorted(got.values()) == list(range(700)) and ranks.positions(df.where("false"), [F.col("k")]).count() == 0
    places = {r["_v"]: (r["_n"], r["_before"]) for r in stats.value_places(df, "v").collect()}
    values = [v for _, v in rows if v is not None]
    assert places == {v: (values.count(v), sum(x < v for x in values)) for v in set(values)}
    folds = taste.balanced_folds(df.select(F.col("k").alias("vote_id"))).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [140] * 5


# Slices ----------------------------------------------------------------------------


def counting(folder):
    """An encoder that leaves a file for each text that it encodes."""

    def make():
        def encode(texts):
            for t in texts:
                with open(os.path.join(folder, t), "a") as f:
                    f.write("x")
            return np.array([[len(t), 1.0, ord(t[-1])] for t in texts])

        return encode

    return make


def test_a_run_goes_on_where_it_was(spark, tmp_path):
    seen, out = tmp_path / "seen", str(tmp_path / "out")
    seen.mkdir()
    df = spark.createDataFrame([(f"i{i}", f"text{i}") for i in range(60)], "image_id string, content string").repartition(3)
    left = iter([True, False])

    def after():
        if not next(left):
            raise RuntimeError("lost the driver")

    with pytest.raises(RuntimeError, match="lost"):
        inference.embed_slices(df, counting(str(seen)), 3, out, "m1", slices=10, at_once=3, after=after)
    assert inference.committed_slices(spark, out, "m1", 10) == [0, 1, 2, 3, 4, 5]
    first = len(os.listdir(seen))
    got = inference.embed_slices(df, counting(str(seen)), 3, out, "m1", slices=10, at_once=3)
    assert 0 < first < 60 and got.count() == 60 and all(os.path.getsize(seen / n) == 1 for n in os.listdir(seen)) and len(os.listdir(seen)) == 60
    want = {r["image_id"]: r["embedding"] for r in inference.embed_batches(df, counting(str(seen)), 3).collect()}
    assert {r["image_id"]: r["embedding"] for r in got.collect()} == want
    # another encoder's version starts anew; slices without rows are committed too
    other = inference.embed_slices(df.limit(2), counting(str(seen)), 3, out, "m2", slices=10, at_once=10)
    assert other.count() == 2 and len(inference.committed_slices(spark, out, "m2", 10)) == 10


def test_a_slice_is_committed_once(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"part-{name}").write_text(name)
    target = f"{tmp_path}/slice=1"
    assert inference._commit(spark, f"{tmp_path}/a", target) and not inference._commit(spark, f"{tmp_path}/b", target)
    assert os.listdir(target) == ["part-a"] and not (tmp_path / "b").exists()
