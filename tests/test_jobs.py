import json

import numpy as np
import pytest

from crossrank.__main__ import main
from crossrank.operators import rewriting
from crossrank.plans import jobs
from crossrank.sources import files

RNG = np.random.default_rng(5)
N = 12


@pytest.fixture(scope="module")
def layout(tmp_path_factory):
    """Files of two small backbones of different dimensions, twelve cases, and a label table."""
    top = tmp_path_factory.mktemp("layout")
    names, cfg = [f"s{k:02d}" for k in range(N)], {"backbones": {}, "output_dir": str(top / "out")}
    data = {}
    for b, d in (("A", 8), ("B", 6)):
        for kind in ("patches", *jobs.SCENARIOS):
            (top / b / kind).mkdir(parents=True)
        for k, n in enumerate(names):
            data[b, "patches", n] = RNG.normal(size=(14 + 3 * k, d)).astype(np.float32)
            np.save(top / b / "patches" / f"{n}.npy", data[b, "patches", n])
            for s in jobs.SCENARIOS:
                data[b, s, n] = RNG.normal(size=d).astype(np.float32)
                np.save(top / b / s / f"{n}.npy", data[b, s, n])
        cfg["backbones"][b] = {"image_embeddings_dir": str(top / b / "patches"), "pool_cache_path": str(top / b / "pool"), "prototypes_dir": str(top / b / "banks"), "text_embeddings": {s: str(top / b / s) for s in jobs.SCENARIOS}}
    order = RNG.permutation(N)
    (top / "splits.csv").write_text("slide_id,case_id,split\n" + "".join(f"{names[k]},c{k // 2},{'test' if k < 8 else 'train'}\n" for k in order))
    (top / "labels.csv").write_text("slide_id,OncotreeCode,project_id\n" + "".join(f"{n},L{k // 4},P{k // 8}\n" for k, n in enumerate(names)))
    cfg["cohort"] = {"split_csv": str(top / "splits.csv"), "labels_csv": str(top / "labels.csv")}
    (top / "cfg.json").write_text(json.dumps(cfg))
    return top, cfg, data, [names[k] for k in order if k < 8]


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def log_softmax(x, axis):
    y = x / np.clip(x.std(axis=axis, keepdims=True), 1e-8, None)
    return y - y.max(axis=axis, keepdims=True) - np.log(np.exp(y - y.max(axis=axis, keepdims=True)).sum(axis=axis, keepdims=True))


def macro_map(s, labels):
    out = {}
    for q in range(len(s)):
        rel = np.array([labels[c] == labels[q] for c in np.argsort(-s[q], kind="stable")[:10]])
        hits = [rel[: k + 1].sum() / (k + 1) for k in np.flatnonzero(rel)]
        out.setdefault(labels[q], []).append(sum(hits) / min(labels.count(labels[q]), len(rel)))
    return np.mean([np.mean(v) for v in out.values()])


def test_whole_benchmark_equals_numpy(spark, layout):
    top, cfg, data, ids = layout
    for b in ("A", "B"):
        for job in ("build-pool-cache", "build-prototypes", "build-prototypes"):  # the second adds nothing
            main([job, "--config", str(top / "cfg.json"), "--backbone", b], spark)
    assert files.read_banks(spark, cfg["backbones"]["A"]["prototypes_dir"]).select("slide_id").distinct().count() == N
    main(["heldout", "--config", str(top / "cfg.json"), "--backbone", "A"], spark)
    got = {r.direction: r for r in files.read_table(spark, f"{top}/out/heldout_A_strict_OncotreeCode_test_stable.csv").collect()}
    v = unit(np.stack([unit(unit(data["A", "patches", n]).mean(0)) for n in ids]).astype(np.float32).astype(float))
    t = unit(np.stack([data["A", "strict", n] for n in ids]).astype(float))
    banks = {}
    for r in files.read_banks(spark, cfg["backbones"]["A"]["prototypes_dir"]).collect():
        banks.setdefault(r.slide_id, []).append(r.emb)
    g, p = v @ t.T, np.stack([(np.array(banks[n]) @ t.T).max(0) for n in ids])
    labels = [f"L{int(n[1:]) // 4}" for n in ids]
    for way, a, b in (("I2T", g, p), ("T2I", g.T, p.T)):
        want = macro_map(log_softmax(a, 0) + 0.5 * (log_softmax(b, 1) + log_softmax(b, 0)), labels)
        assert float(got[way]["mAP@10"]) == pytest.approx(want, abs=1e-9) and got[way].n_cases == "8"
    free = {r.direction: r["mAP@10"] for r in jobs.run_heldout(spark, cfg, "A", tie_break="neutral", n_tie_seeds=3).collect()}
    assert free == pytest.approx({k: float(r["mAP@10"]) for k, r in got.items()})


def test_grid_stress_and_ablation(spark, layout):
    top, cfg, _, _ = layout
    for b in ("A", "B"):
        jobs.build_pool_cache(spark, cfg, b)
        jobs.build_prototypes(spark, cfg, b)
    grid, stress = jobs.run_grid(spark, cfg).collect(), jobs.run_stress_test(spark, cfg).collect()
    assert len(grid) == len(stress) == 2 * 3 * 2 * 2
    base = {r[:4]: r["base_mAP@10"] for r in grid}
    assert all(abs(base[r[:4]] - r["mAP@10"]) < 1e-6 for r in stress)  # all cases are in train or test
    rows = jobs.run_score_ablation(spark, cfg, "A", n_boot=50).collect()
    assert len(rows) == 2 * 7 * 2 and all((r["diff"] is None) == (r.variant == "rerank") for r in rows)


def test_report_jobs(spark, tmp_path):
    csv = tmp_path / "m.csv"
    text = "Sheets of cells with round nuclei and clear cytoplasm; many mitoses"
    csv.write_text("slide_id;case_id;project_id;slide_reports;cancer_type_detailed;site_of_resection_or_biopsy;Unnamed: 6\n" + "".join(f'r{k};c{k};p{k % 2};"{text} {k}";Glioma;NA;x\n' for k in range(6)) + "r9;c9;p1;;Glioma;Brain;x\n")
    ids = tmp_path / "ids.csv"
    ids.write_text("slide_id\nr0\nr1\nr2\nr3\nr9\n")
    audit, out = str(tmp_path / "audit"), str(tmp_path / "out")
    first = jobs.rewrite_reports(spark, str(csv), audit, rewriting.stub, out, str(ids), pilot=2).count()
    assert first in (1, 2)  # the report without a text may be drawn
    assert jobs.rewrite_reports(spark, str(csv), audit, rewriting.stub, out, str(ids)).count() == 4 - first and jobs.rewrite_reports(spark, str(csv), audit, rewriting.stub, out, str(ids)).count() == 0
    table = {r.slide_id: r for r in files.read_reports(spark, out).collect()}
    assert len(table) == 7 and table["r0"].slide_reports_no_diagnosis_strict.startswith("Sheets") and table["r5"].slide_reports_no_diagnosis_strict is None
    again = jobs.rewrite_reports(spark, str(csv), audit, rewriting.stub, out, str(ids), overwrite=True).count()
    assert again == 4 and spark.read.json(audit).count() == 4
    main(["diagnosis-only", "--csv", str(csv), "--out", str(tmp_path / "d"), "--ids", str(ids)], spark)
    assert files.read_reports(spark, str(tmp_path / "d")).count() == 5


def test_a_rewriter_must_be_named(spark, tmp_path):
    with pytest.raises(SystemExit):
        main(["rewrite-reports", "--csv", "x", "--audit", "y"], spark)


def test_a_run_that_dies_goes_on_without_a_second_call(spark, tmp_path, monkeypatch):
    """The service fails at one report in the second wave; the next run calls only for those without a record."""
    text = "Sheets of cells with round nuclei and clear cytoplasm; many mitoses"
    csv, audit, out, calls = tmp_path / "m.csv", str(tmp_path / "audit"), str(tmp_path / "out"), tmp_path / "calls"
    csv.write_text("slide_id;case_id;project_id;slide_reports;cancer_type_detailed;site_of_resection_or_biopsy\n" + "".join(f'r{k};c{k};p;"{text} number {k} of all";Glioma;NA\n' for k in range(40)))
    calls.mkdir()
    monkeypatch.setattr(jobs, "CHECKPOINT_ROWS", 2)

    def service(broken):
        def call(instructions, payload):
            k = payload.split("number ")[1].split()[0]
            if k == broken:
                raise RuntimeError("out of credit")
            with open(calls / k, "a") as f:
                f.write("x")
            return rewriting.stub(instructions, payload)

        return call

    wave = {r.slide_id: r.wave for r in spark.createDataFrame([(f"r{k}",) for k in range(40)], "slide_id string").selectExpr("slide_id", "pmod(xxhash64(slide_id), 5) as wave").collect()}
    broken = next(k for k in range(40) if wave[f"r{k}"] == 2)
    with pytest.raises(Exception, match="out of credit"):
        jobs.rewrite_reports(spark, str(csv), audit, service(str(broken)), out)
    done = {r.slide_id for r in spark.read.json(audit).collect()}
    assert done == {i for i, w in wave.items() if w < 2} and not (tmp_path / "out").exists()
    before = {k: len((calls / k[1:]).read_text()) for k in done}
    assert jobs.rewrite_reports(spark, str(csv), audit, service("none"), out).count() == 40 - len(done)
    assert {k: len((calls / k[1:]).read_text()) for k in done} == before == dict.fromkeys(done, 1)
    assert spark.read.json(audit).count() == 40 and files.read_reports(spark, out).count() == 40


def test_replacement_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_reports(spark.range(3).selectExpr("cast(id as string) slide_id"), path)
    with pytest.raises(Exception, match="no good"):
        files.write_reports(spark.range(3).selectExpr("cast(raise_error('no good') as string) slide_id"), path)
    assert files.read_reports(spark, path).count() == 3
    (tmp_path / "t").rename(tmp_path / "t._old")  # cut short between the two renames
    files.recover(spark, path)
    assert files.read_reports(spark, path).count() == 3
    files.write_reports(files.read_reports(spark, path).limit(1), path)  # reads what it replaces
    assert files.read_reports(spark, path).count() == 1 and not (tmp_path / "t._old").exists()


def test_archives_in_every_job(spark, layout):
    """Pool caches and banks as archives give what Parquet gives."""
    top, cfg, _, ids = layout
    for b in ("A", "B"):
        jobs.build_pool_cache(spark, cfg, b)
        jobs.build_prototypes(spark, cfg, b)
    other = {**cfg, "output_dir": str(top / "out2"), "backbones": {b: {**c, "pool_cache_path": str(top / f"{b}.npz"), "prototypes_dir": str(top / f"{b}-archives")} for b, c in cfg["backbones"].items()}}
    for b in ("A", "B"):
        jobs.build_pool_cache(spark, other, b)
        for _ in range(2):  # the second adds nothing
            jobs.build_prototypes(spark, other, b, npz=True)
    z = np.load(top / "A.npz")
    assert sorted(z["case_ids"].tolist()) == z["case_ids"].tolist() and z["mean_pool"].dtype == np.float32 and len(list((top / "A-archives").glob("*_prototype.npz"))) == N
    key = lambda rows: sorted((r.backbone, r.scenario, r.direction, r.granularity, round(r[-1], 9)) for r in rows)
    assert key(jobs.run_stress_test(spark, cfg).collect()) == key(jobs.run_stress_test(spark, other).collect())
    one, two = (jobs.run_heldout(spark, c, "A").orderBy("direction").collect() for c in (cfg, other))
    assert [r["mAP@10"] for r in one] == pytest.approx([r["mAP@10"] for r in two])


def test_gallery_order_is_that_of_the_files(spark, layout, tmp_path):
    top, cfg, _, _ = layout
    (tmp_path / "splits").mkdir()
    names = [f"n{k}" for k in RNG.permutation(60)]
    for part in range(3):  # the first by name is the smallest
        rows = names[[0, 5, 25][part] : [5, 25, 60][part]]
        (tmp_path / "splits" / f"part-{part}.csv").write_text("slide_id,case_id,split\n" + "".join(f"{n},c,test\n" for n in rows))
    got = jobs.cases_in_file_order(spark, {"cohort": {"split_csv": str(tmp_path / "splits")}}, ("test",)).orderBy("gallery_pos").collect()
    assert [r.slide_id for r in got] == names
