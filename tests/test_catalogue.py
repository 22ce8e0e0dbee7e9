"""Row functions, maintenance, statistics and search on hand-made edge tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photocat import lineage
from photocat.functions import scalars
from photocat.operators import catalog, duplicates, inference, quality, ranking, rotation, stats, taste, vectors
from photocat.plans.catalogue_queries import ORACLE_SQL, QUERIES, hashing_encoder
from photocat.schema import IMAGES
from photocat.sources import files as sources
from photocat.streaming import ingest


def values(spark, schema, rows, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_paths(spark):
    rows = [("/lib/a/b/x.jpg",), ("/lib/x.jpg",), ("/other/dir/x.jpg",), ("/lib2/x.jpg",)]
    assert values(spark, "p string", rows, scalars.relative_folder(F.col("p"), "/lib")) == ["a/b", ".", "dir", "lib2"]
    assert values(spark, "p string", [("x.JPG",), ("x.Jpg",), ("x.webp",), ("xjpg",)], sources.image_suffix(F.col("p"))) == [True, False, True, False]


def test_file_names(spark):
    rows = [("Big Trip 2024 (22.04.24) -1466.jpg",), ("T(01.02.03)-5",), ("T (01.02.03) 5",), ("T (99.99.99) -7",), ("A (01.01.01) x (02.02.02) -3",), (None,)]
    got = values(spark, "n string", rows, scalars.parse_filename(F.col("n")))
    assert tuple(got[0]) == ("Big Trip 2024", 22, 4, 2024, 1466) and tuple(got[1]) == ("T", 1, 2, 2003, 5) and got[2] is None
    assert tuple(got[3]) == ("T", 99, 99, 2099, 7) and got[4]["sequence"] == 3 and got[5] is None


def test_exif_times(spark):
    rows = [("2020:01:02 03:04:05",), ("2020:1:2 3:4:5",), ("2020:01:02  03:04:05",), ("2020:01:02 03:04:05 PM",), ("0000:00:00 00:00:00",), ("2020:02:30 00:00:00",), ("",), (None,)]
    got = values(spark, "t string", rows, scalars.exif_datetime(F.col("t")))
    assert [x is not None for x in got] == [True, True, True, False, False, False, False, False] and str(got[2]) == "2020-01-02 03:04:05"


def test_rationals_and_places(spark):
    kind = "nums array<struct<num:bigint,den:bigint>>, text string"
    rows = [([(7, 2)], None), ([(7, 0)], "3.5"), ([], "2"), ([], "wide"), (None, None)]
    assert values(spark, kind, rows, scalars.exif_rational(F.col("nums"), F.col("text"))) == [3.5, 3.5, 2.0, None, None]
    place = "a array<struct<num:bigint,den:bigint>>, ar string, b array<struct<num:bigint,den:bigint>>, br string"
    full = [(10, 1), (30, 1), (36, 1)]
    rows = [(full, "N", full, "E"), (full, "S", full, "W"), (full, None, full, None), (full, "N", None, "E"), (full[:2], "N", full, "E"), ([(1, 0)] + full[1:], "N", full, "E")]
    got = values(spark, place, rows, scalars.gps_decimal(F.col("a"), F.col("ar"), F.col("b"), F.col("br")))
    assert got[0]["latitude"] == pytest.approx(10.51) and got[1]["longitude"] == pytest.approx(-10.51) and got[2]["latitude"] == pytest.approx(10.51)
    assert all(x["latitude"] is None and x["longitude"] is None for x in got[3:])


def test_source_classes(spark):
    rules = scalars.SourceRules(("07 Old",), ("A PERSON",))
    rows = [("07 Old/x", "EOS 5D"), ("trips/a person 2020", None), ("x", "\tCanon EOS R5 "), ("x", "NIKON D850"), ("x", "iphone 14"), ("x", "iPhone 12"), ("x", "iPhone 13 Pro"), ("x", "X-T3"), ("x", " "), (None, None), ("1 07 Old", "ILCE-7M3")]
    got = values(spark, "f string, c string", rows, scalars.classify_source(F.col("f"), F.col("c"), rules))
    assert got == ["archive", "pro", "pro", "pro", "amateur", "amateur", "pro", "pro", "unknown", "unknown", "pro"]


def test_sizes_of_long_and_unknown_texts_are_those_of_the_sql(spark, sf_dir, tmp_path):
    from tools.compare import TABLES, rows_of

    rows = [(4, 65_535), (9, 65_536), (14, 70_000), (19, 1 << 40), (23, 1 << 20), (29, None), (None, 5), (514, 0), (1_000_003, 1023)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    mine, theirs = rows_of(spark, QUERIES["human_units"], ORACLE_SQL["human_units"], str(tmp_path))
    assert mine == theirs and len(mine) == 9


def test_units_and_uprightness(spark):
    assert values(spark, "n bigint", [(0,), (1023,), (1024,), (5 << 40,), (3 << 50,)], scalars.human_size(F.col("n"))) == ["0.0 B", "1023.0 B", "1.0 KB", "5.0 TB", "3.0 PB"]
    assert values(spark, "s double", [(1.25,), (59.9,), (61.0,), (7384.0,)], scalars.human_duration(F.col("s"))) == ["1.3s", "59.9s", "1m 1s", "2h 3m"]
    assert values(spark, "o int", [(None,), (0,), (1,), (6,)], scalars.needs_upright(F.col("o"))) == [False, False, False, True]
    assert values(spark, "v array<float>", [([0.0, 0.0],), ([3.0, 4.0],)], scalars.normalize(F.col("v")))[0] is None


def catalogue_of(spark, n=40, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[1] = x[0] + 0.01
    x[3] = x[2] + 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kinds = ["pro", "archive", "amateur", "unknown", None]
    rows = [{"image_id": f"i{i:03}", "filepath": f"/lib/{i}.jpg", "filename": f"{i}.jpg", "folder": ["a_b", "aXb", "c%d", "e\\f"][i % 4], "file_size": i, "source_class": kinds[i % 5], "aesthetic_score": None if i % 3 else 4.0 + i % 4,
             "long_edge_px": i * 100, "taste_score": None if i % 4 else 1.0} for i in range(n)]
    names = ["image_id", "filepath", "filename", "folder", "file_size", "source_class", "aesthetic_score", "long_edge_px", "taste_score"]
    images = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], "image_id string, filepath string, filename string, folder string, file_size bigint, source_class string, aesthetic_score double, long_edge_px int, taste_score double")
    images = images.withColumn("date_taken", F.expr("timestamp_ntz'2024-01-31 10:00:00'"))
    for f in IMAGES:
        if f.name not in images.columns:
            images = images.withColumn(f.name, F.lit(None).cast(f.dataType))
    vecs = spark.createDataFrame([(f"i{i:03}", [float(y) for y in v] if i != 7 else None) for i, v in enumerate(x)], "image_id string, embedding array<float>")
    return images, vecs, x


def found(images, vecs, **params):
    options = params.pop("options", ranking.SearchOptions(similarity_threshold=-1.0))
    return ranking.search(images, vecs, ranking.SearchParams(**params), options=options).collect()


def test_search_filters(spark):
    images, vecs, x = catalogue_of(spark)
    q = tuple(x[0])
    assert found(images, vecs, query_vec=q, limit=0) == [] and len(found(images, vecs, query_vec=q, limit=1000, dedupe=False, archive="include")) == 39
    for bad in ({"limit": -1}, {"sources": ("archive",), "archive": "exclude"}):
        with pytest.raises(ValueError):
            found(images, vecs, query_vec=q, **bad)
    assert found(images, vecs, query_vec=q, date_to="2024-01-31") == []
    whole = ranking.SearchOptions(similarity_threshold=-1.0, date_to_whole_day=True)
    assert len(found(images, vecs, query_vec=q, date_to="2024-01-31", options=whole)) == 10
    for pattern, folders in (("_", {"a_b", "aXb", "c%d", "e\\f"}), ("A_B", {"a_b", "aXb"}), ("%", {"a_b", "aXb", "c%d", "e\\f"}), ("e\\f", {"e\\f"})):
        assert {r["folder"] for r in found(images, vecs, query_vec=q, limit=100, folder_pattern=pattern, archive="include")} == folders
    assert {r["source_class"] for r in found(images, vecs, query_vec=q, limit=100, sources=("pro", "amateur"))} == {"pro", "amateur"}
    assert {r["source_class"] for r in found(images, vecs, query_vec=q, limit=100, archive="exclude")} == {"pro", "amateur", "unknown"}
    assert sum(r["source_class"] == "archive" for r in found(images, vecs, query_vec=q, limit=100)) == 2
    assert all(r["aesthetic_score"] >= 5 for r in found(images, vecs, query_vec=q, limit=100, min_quality=5.0))
    both = [ranking.SearchOptions(mode=m, similarity_threshold=-1.0) for m in ("candidates", "prefilter")]
    one, two = (found(images, vecs, query_vec=q, limit=3, min_long_edge=1000, options=o) for o in both)
    assert [r["image_id"] for r in one] == [r["image_id"] for r in two]


def test_search_collapses_twins(spark):
    images, vecs, x = catalogue_of(spark)
    got = {r["image_id"]: r for r in found(images, vecs, query_vec=tuple(x[0]), limit=100, archive="include")}
    assert ("i000" in got) != ("i001" in got) and (got.get("i000") or got["i001"])["duplicate_ids"] == ["i001" if "i000" in got else "i000"]


def greedy(order, vectors, threshold):
    kept, twin = [], {}
    for i in order:
        v = vectors[i]
        near = [(float(v @ vectors[k]), -n, k) for n, k in enumerate(kept) if v @ vectors[k] >= threshold]
        if near:
            twin[i] = max(near)[2]
        else:
            kept.append(i)
    return set(kept), twin


def test_best_copies_are_the_greedy_ones(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rank = rng.integers(0, 5, 60)
    pairs = [(f"{i:02}", f"{j:02}", float(x[i] @ x[j])) for i in range(60) for j in range(i) if x[i] @ x[j] >= 0.8]
    ranked = spark.createDataFrame([(f"{i:02}", float(r)) for i, r in enumerate(rank)], "image_id string, rank_key double")
    got = duplicates.keep_best_copies(ranked, spark.createDataFrame(pairs, "a string, b string, cosine double")).collect()
    order = sorted(range(60), key=lambda i: (-rank[i], f"{i:02}"))
    kept, twin = greedy(order, x, 0.8)
    assert {int(r["image_id"]) for r in got if r["kept"]} == kept and {int(r["image_id"]): int(r["twin"]) for r in got if r["twin"]} == twin


def test_knn_forms_agree(spark):
    _, vecs, x = catalogue_of(spark, 200)
    asks = spark.createDataFrame([(i, [float(y) for y in x[i]]) for i in range(5)], "query_id bigint, query_vec array<float>")
    many = vectors.knn_batch(vecs.repartition(7), asks, 6).collect()
    for i in range(5):
        one = [(r["image_id"], round(r["similarity"], 9)) for r in vectors.knn(vecs, [float(np.float32(y)) for y in x[i]], 6).collect()]
        assert one == [(r["image_id"], round(r["similarity"], 9)) for r in sorted(many, key=lambda r: r["rank"]) if r["query_id"] == i]


def test_maintenance(spark):
    images, vecs, _ = catalogue_of(spark, 10)
    files = images.select(F.col("filepath").alias("path"), "file_size", "file_modified")
    assert catalog.detect_changes(files, images).count() == 0 and catalog.detect_changes(files, images, force=True).count() == 10
    with pytest.raises(ValueError):
        catalog.prune_orphans(images, spark.createDataFrame([], "image_id string, tag_id long"), files.limit(0))
    odd = images.limit(1).withColumn("filepath", F.lit("")).unionByName(images.limit(1).withColumn("filepath", F.lit(None).cast("string")))
    assert catalog.orphans(images.unionByName(odd), files).count() == 2
    sizes = catalog.folder_sizes(spark.createDataFrame([("a/b/x", 5), ("a/b2/x", 7), ("c", None)], "path string, file_size bigint"), spark.createDataFrame([(0, "a/b"), (1, "a"), (2, "z")], "line_no int, folder string"), 10)
    assert [tuple(r) for r in sizes.collect()] == [(0, "a/b", 5, 1, False, False), (1, "a", 12, 2, False, True), (2, "z", 0, 0, True, False)]
    twice = catalog.upsert(images, images.limit(2).unionByName(images.limit(2)).withColumn("indexed_at", F.expr("timestamp'2024-01-01'")), "image_id", "indexed_at")
    assert twice.count() == 10 and catalog.select_stale_embeddings(vecs, 8).count() == 10


def test_inference_retries_rows(spark):
    rows = spark.createDataFrame([(f"i{i}", "" if i == 3 else f"text {i}") for i in range(10)], "image_id string, content string")
    got = {r["image_id"]: r for r in inference.embed_batches(rows.coalesce(1), hashing_encoder, 16, batch=4).collect()}
    assert len(got) == 10 and got["i3"]["embedding"] is None and "nothing to encode" in got["i3"]["error"]
    assert np.linalg.norm(got["i1"]["embedding"]) == pytest.approx(1, abs=1e-6)
    assert all(r["error"] for r in inference.embed_batches(rows, hashing_encoder, 8).collect())


def test_spearman(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 20, 500), rng.integers(0, 6, 500)
    rank = lambda a: np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    assert stats.spearman(df, "x", "y").first()[0] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert stats.spearman(df.withColumn("y", F.lit(1.0)), "x", "y").first()[0] is None and stats.spearman(df.limit(0), "x", "y").first()[0] is None


def test_taste_fit_is_the_optimum(spark):
    rng = np.random.default_rng(1)
    d = rng.normal(size=(300, 5)) + np.array([0.5, 0, -0.3, 0, 0.1])
    rows = spark.createDataFrame([(i, "a", "b", [float(y) for y in v]) for i, v in enumerate(d)], "vote_id long, winner string, loser string, d array<double>")
    w = taste.fit_taste(rows, 0.01, 40)
    p = 1 / (1 + np.exp(d @ w))
    gradient = -(p[:, None] * d).sum(axis=0) / 340 + 2 * 0.01 * w
    assert np.abs(gradient).max() < 1e-5 and taste.fit_taste(rows.limit(0), 0.01) is None
    l2, accuracy = taste.choose_l2(rows, 40, (1e-3, 1e-1))
    assert l2 in (1e-3, 1e-1) and 0.5 < accuracy <= 1


def test_taste_query_tries_the_whole_grid(spark, sf_dir, monkeypatch):
    tried = []

    def choose(rows, n_bad=0, grid=taste.GRID, seed=0):
        tried.extend(grid)
        return grid[0], 0.5

    monkeypatch.setattr(taste, "choose_l2", choose)
    QUERIES["fit_taste"](spark, sf_dir)
    assert tried == [1e-3, 3e-3, 1e-2, 3e-2, 1e-1]


def test_linear_layers_fold(spark):
    rng = np.random.default_rng(2)
    layers = [(rng.normal(size=(b, a)), rng.normal(size=b)) for a, b in ((6, 8), (8, 3), (3, 1))]
    v = rng.normal(size=6)
    want = v
    for w, b in layers:
        want = w @ want + b
    df = spark.createDataFrame([([float(y) for y in v],), (None,)], "embedding array<double>")
    assert quality.aesthetic_score(df, layers).first()["aesthetic_score"] == pytest.approx(want[0])
    with pytest.raises(Exception, match="expected 6 dimensions"):
        quality.aesthetic_score(spark.createDataFrame([([1.0],)], "embedding array<double>"), layers).collect()


def test_rotation_verdicts(spark):
    rows = [("a", 0.1, 0.13, 0.0, 0.0), ("b", 0.1, 0.1, 0.1, 0.1), ("c", 0.0, 0.01, 0.02, 0.02), ("d", 0.1, 0.105, 0.0, 0.0), ("e", 0.5, 0.1, 0.2, 0.3)]
    got = {r["image_id"]: (r["rotation"], r["action"]) for r in rotation.triage_rotation(spark.createDataFrame(rows, "image_id string, s0 double, s90 double, s180 double, s270 double")).collect()}
    assert got["b"] == (0, "none") and got["c"] == (180, "review") and got["d"] == (90, "none") and got["e"] == (0, "none") and got["a"][0] == 90


def test_files_round_trip(spark, tmp_path):
    for name, size in (("a.jpg", 5), ("sub/b.PNG", 7), ("sub/c.Jpg", 1), ("d.txt", 1)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    files = sources.list_files(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["file_size"]) for r in files.collect()) == [("a.jpg", 5), ("b.PNG", 7)]
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    (tmp_path / "allow.txt").write_text("# list\n b \n\na\n#x\n")
    assert [r["folder"] for r in sources.read_allowlist(spark, str(tmp_path / "allow.txt")).orderBy("line_no").collect()] == ["b", "a"]
    (tmp_path / "votes.json").write_text('[{"choice": "a", "a": "x", "b": "y"}, {"choice": "tie", "a": "x", "b": "z"}]')
    (tmp_path / "labels.json").write_text('{"1": "hero", "7": "reject"}')
    (tmp_path / "key.json").write_text('[{"n": 1, "image_id": "x"}, {"n": 2, "image_id": "y"}]')
    assert [(r["vote_id"], r["choice"]) for r in sources.read_votes(spark, str(tmp_path / "votes.json")).collect()] == [(0, "a"), (1, "tie")]
    assert [(r["n"], r["tier"]) for r in sources.read_tier_labels(spark, str(tmp_path / "labels.json"), str(tmp_path / "key.json")).collect()] == [(1, "hero")]
    images, _, _ = catalogue_of(spark, 5)
    assert sources.read_catalog(spark, sources.write_catalog(images, str(tmp_path / "cat"))).count() == 5


def test_stream_repeats_safely(spark, tmp_path):
    rows = spark.createDataFrame([("/a.jpg", 1), ("/a.jpg", 2), ("/b.jpg", 3)], "path string, file_size bigint").withColumn("file_modified", F.expr("timestamp'2024-01-01'") + F.make_interval(secs=F.col("file_size").cast("decimal(18,6)")))
    for step in range(3):
        if step < 2:
            rows.write.mode("append").parquet(str(tmp_path / "in"))
        at = ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "cat"), str(tmp_path / "check"))
        assert sorted((r["filepath"], r["file_size"]) for r in spark.read.parquet(at).collect()) == [("/a.jpg", 2), ("/b.jpg", 3)]


def test_plans_have_no_cartesian_product(spark):
    images, vecs, x = catalogue_of(spark, 10)
    plan = ranking.search(images, vecs, ranking.SearchParams(query_vec=tuple(x[0])))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bands_bring_together_what_is_near(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 32))
    for i in range(0, 300, 2):
        u = rng.normal(size=32)
        x[i + 1] = x[i] / np.linalg.norm(x[i]) + u / np.linalg.norm(u) * rng.uniform(0.15, 0.26)
    x = x.astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1400] = x[10]
    vecs = spark.createDataFrame([(f"{i:05}", [float(y) for y in v]) for i, v in enumerate(x)] + [("short", [1.0, 0.0]), ("none", None)], "image_id string, embedding array<float>")
    got = {(r["a"], r["b"]) for r in duplicates.near_duplicate_pairs(vecs).collect()}
    u = x.astype(np.float64)
    firsts = [i for i in range(1500) if i != 1400]
    want = {(f"{i:05}", f"{j:05}") for i in firsts for j in firsts if i < j and u[i] @ u[j] >= 0.97} | {("00010", "01400")}
    assert got == want and len(want) > 80


def test_a_dense_cluster_is_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "KEY_ROWS", 16)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=24) + 0.01 * rng.normal(size=(150, 24)), rng.normal(size=(50, 24))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vecs = spark.createDataFrame([(f"{i:03}", [float(y) for y in v]) for i, v in enumerate(x)], "image_id string, embedding array<float>")
    got = duplicates.near_duplicate_pairs(vecs).collect()
    u = x.astype(np.float64)
    want = {(f"{i:03}", f"{j:03}") for i in range(200) for j in range(i + 1, 200) if u[i] @ u[j] >= 0.97}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) >= 150 * 149 // 2
    keys = lineage.cut(spark.createDataFrame([(i, i % 2, i // 100) for i in range(150)], "row long, band int, key long"))
    pairs = duplicates.met_in_bands(keys).collect()
    by_key = [[i for i in range(150) if (i % 2, i // 100) == k] for k in ((0, 0), (1, 0), (0, 1), (1, 1))]
    assert sorted(map(tuple, pairs)) == sorted((a, b) for k in by_key for a in k for b in k if a < b)
    assert duplicates.near_duplicate_pairs(vecs.limit(0)).count() == 0


def test_cells_grow_with_the_table(spark, monkeypatch, tmp_path):
    assert [vectors.cell_count(n) for n in (0, 250, 200_000, 10_000_000, 1_000_000_000)] == [1, 2, 100, 100, 10_000]
    monkeypatch.setattr(vectors, "FIT_ROWS", 200)
    monkeypatch.setattr(vectors, "FIT_FOR_CELL", 10)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 8))
    x[:500] = x[0] + 1e-3 * x[:500]  # one cell holds nearly half of the rows
    vecs = spark.createDataFrame([(f"{i:04}", [float(y) for y in v]) for i, v in enumerate(x)], "image_id string, embedding array<float>")
    index = vectors.build_index(vecs, str(tmp_path / "grown"), cells=6, approximate_from=100)
    ids = [r["image_id"] for r in index.dealt.collect()]
    assert sorted(ids) == [f"{i:04}" for i in range(1200)]
    asked = spark.createDataFrame([(i, [float(y) for y in x[i]]) for i in (3, 700)], "query_id long, query_vec array<double>")
    exact = sorted((r["query_id"], r["rank"], r["image_id"]) for r in vectors.knn_batch(vecs, asked, 5).collect())
    assert sorted((r["query_id"], r["rank"], r["image_id"]) for r in index.nearest(asked, 5, exact=True).collect()) == exact


def test_bands_keep_candidates_in_proportion():
    per_vector = []
    for n in (1_000, 100_000, 10_000_000, 1_000_000_000):
        bits, bands = duplicates.band_plan(n, 0.97)
        per_vector.append(bands * n / 2**bits)
        meet = (1 - np.arccos(0.97) / np.pi) ** bits
        assert (1 - meet) ** bands <= duplicates.MISSED
    assert max(per_vector) < 150  # strangers that a vector meets


def test_prefiltered_search_goes_on_until_it_is_full(spark, monkeypatch):
    images, vecs, x = catalogue_of(spark, 40, seed=3)
    copies = vecs.where("image_id < 'i020'").select("image_id", F.array(*[F.lit(float(y)) for y in x[0].astype(np.float32)]).alias("embedding"))
    vecs = copies.union(vecs.where("image_id >= 'i020'"))
    options = ranking.SearchOptions(mode="prefilter", similarity_threshold=-1.0)
    want = [(r["image_id"], r["duplicate_ids"]) for r in found(images, vecs, query_vec=tuple(x[0]), limit=6, options=options)]
    monkeypatch.setattr(ranking, "BLOCK", 5)
    monkeypatch.setattr(ranking, "QUERIES", 1)
    got = found(images, vecs, query_vec=tuple(x[0]), limit=6, options=options)
    assert [r["image_id"] for r in got] == [i for i, _ in want] and len(got) == 6
    assert len(got[0]["duplicate_ids"]) == len(want[0][1]) == 19


def test_knn_blocks_agree(spark, monkeypatch):
    images, vecs, x = catalogue_of(spark, 40)
    asked = spark.createDataFrame([(i, [float(y) for y in x[i]], 1 + i % 7) for i in range(25)], "query_id long, query_vec array<double>, k int")
    rows = lambda: sorted((r["query_id"], r["image_id"], round(r["similarity"], 9), r["rank"]) for r in vectors.knn_batch(vecs, asked, F.col("k")).collect())
    want = rows()
    for name, value in (("QUERIES", 4), ("SCORES", 12), ("FEW", 2)):
        monkeypatch.setattr(vectors, name, value)
    assert rows() == want and len(want) == sum(1 + i % 7 for i in range(25))


def test_cells_find_most(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.25 * rng.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vecs = spark.createDataFrame([(f"{i:04}", [float(y) for y in v]) for i, v in enumerate(x)], "image_id string, embedding array<float>")
    assert vectors.build_index(vecs, str(tmp_path / "none")) is None  # exact search serves
    index = vectors.build_index(vecs, str(tmp_path / "cells"), cells=12, probes=4, approximate_from=100)
    asked = spark.createDataFrame([(i, [float(y) for y in x[i]]) for i in range(0, 900, 30)], "query_id long, query_vec array<double>")
    some = {(r["query_id"], r["image_id"]) for r in index.nearest(asked, 10).collect()}
    exact = {(r["query_id"], r["image_id"]) for r in vectors.knn_batch(vecs, asked, 10).collect()}
    assert len(some) == 300 and len(some & exact) >= 0.9 * len(exact)


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=501).tolist(), [1.0, 2.0], [5.0], [2.0] * 9 + [3.0]):
        df = spark.createDataFrame([(v,) for v in [*x, None]], "v double")
        for q in (0.0, 0.95, 1.0):
            assert stats.quantile(df, "v", q, "q").first()["q"] == pytest.approx(np.quantile(x, q))
    assert stats.quantile(df.limit(0), "v", 0.5, "q").first()["q"] is None
