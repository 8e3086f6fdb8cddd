import numpy as np

from crossrank.sources import files


def test_archives(spark, tmp_path):
    rng = np.random.default_rng(1)
    mean, most = rng.normal(size=(3, 4)).astype(np.float32), rng.normal(size=(3, 4)).astype(np.float32)
    np.savez(tmp_path / "pool.npz", case_ids=np.array(["a", "b", "c"]), mean_pool=mean, max_pool=most)
    got = {r.slide_id: r for r in files.read_pool_npz(spark, f"{tmp_path}/pool.npz").collect()}
    assert np.allclose(got["b"].mean_pool, mean[1]) and np.allclose(got["c"].max_pool, most[2])
    cases = spark.createDataFrame([("a",), ("c",)], "slide_id string")
    unit = {r.slide_id: r.emb for r in files.read_pool_cache(spark, f"{tmp_path}/pool.npz", cases).collect()}
    assert set(unit) == {"a", "c"} and np.allclose(unit["a"], mean[0] / np.linalg.norm(mean[0]))
    (tmp_path / "banks").mkdir()
    x = rng.normal(size=(2, 4)).astype(np.float32)
    np.savez(tmp_path / "banks" / "a_prototype.npz", prototypes=x, K_star=np.array([2]), coverage=np.array([np.nan]), support=np.array([0.5]), utility=np.array([0.1]), q_proto=np.array([0.1]), n_patches=np.array([9]))
    rows = files.read_bank_npz(spark, f"{tmp_path}/banks").orderBy("h").collect()
    assert [r.slide_id for r in rows] == ["a", "a"] and np.allclose([r.emb for r in rows], x) and rows[0].coverage is None and rows[0].n_patches == 9


def test_arrays_reports_and_tables(spark, tmp_path):
    (tmp_path / "npy").mkdir()
    np.save(tmp_path / "npy" / "one.npy", np.arange(4.0))
    np.save(tmp_path / "npy" / "two.npy", np.zeros((5000, 2)))
    got = {r.slide_id: r["count"] for r in files.read_arrays(spark, f"{tmp_path}/npy").groupBy("slide_id").count().collect()}
    assert got == {"one": 1, "two": 5000}
    assert np.allclose(files.read_text_vectors(spark, f"{tmp_path}/npy").filter("slide_id = 'one'").first().emb, np.arange(4) / np.sqrt(14))
    (tmp_path / "m.csv").write_text('slide_id;slide_reports;Unnamed: 0\na;"line one\nline ""two""; end";1\nb;NA;2\n')
    rows = {r.slide_id: r.slide_reports for r in files.read_reports(spark, f"{tmp_path}/m.csv").collect()}
    assert rows == {"a": 'line one\nline "two"; end', "b": None}
    (tmp_path / "c.yaml").write_text("a: {b: [1, 2]}\n")
    assert files.read_config(f"{tmp_path}/c.yaml") == {"a": {"b": [1, 2]}}
    assert files.result_name("grid", "A", "x") == "grid_A_x.csv"


def test_reports_keep_their_blanks(spark, tmp_path):
    rows = [("a", " both ends \n"), ("b", 'a "quoted" ; part'), ("c", "\ttab"), ("d", None)]
    files.write_reports(spark.createDataFrame(rows, "slide_id string, slide_reports string"), f"{tmp_path}/m")
    assert sorted(map(tuple, files.read_reports(spark, f"{tmp_path}/m").collect())) == rows


def test_arrays_come_back(spark, tmp_path):
    rows = [("x", k, [float(k), 0.5]) for k in (2, 0, 1)] + [("y", 0, [9.0, 8.0])]
    files.write_arrays(spark.createDataFrame(rows, "slide_id string, patch_idx int, emb array<double>"), f"{tmp_path}/n")
    assert sorted(map(tuple, files.read_arrays(spark, f"{tmp_path}/n").collect())) == sorted(rows)
