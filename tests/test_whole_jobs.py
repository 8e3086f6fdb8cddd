"""Queries take every row of their tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossrank.functions import text as tx
from crossrank.operators import rewriting
from crossrank.plans import catalogue, fixtures

DATA = "/root/testdata/sf0.001"


def test_audit_takes_all_documents(spark):
    got = catalogue.q_audit_roundtrip(spark, DATA)
    assert sorted(r.slide_id for r in got.select("slide_id").collect()) == sorted(r.doc_id for r in fixtures.read(spark, DATA, "documents").select("doc_id").collect())


def test_each_vector_is_a_pixel(spark, tmp_path):
    rows = fixtures.read(spark, DATA, "embeddings").filter("vec_id <> 100")  # a gap where a row of pixels begins
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue._pixels(spark, str(tmp_path)).select("y", "x").collect()
    assert sorted(100 * r.y + r.x for r in got) == sorted(r.vec_id for r in rows.select("vec_id").collect())


def test_sentences_are_whole_texts(spark):
    texts = {r.doc_id: re.sub(r"\s+", "", r.text) for r in fixtures.read(spark, DATA, "documents").select("doc_id", "text").collect()}
    got = {r.slide_id: re.sub(r"\s+", "", r.sentence) for r in catalogue.QUERIES["q_ensure_period_whole"](spark, DATA).collect()}
    assert got == {i: t if not t or t[-1] in ".!?" else t + "." for i, t in texts.items()}
    assert sum(len(t) > 50 for t in got.values()) > len(got) / 2


@pytest.mark.parametrize(("text", "end"), [("a b", "b."), ("a b. ", "b."), ("a b?\n", "b?"), ("a b!\t\r\n", "b!"), ("a b,", "b,."), ("a b.)", "b.)."), (" \n ", "")])
def test_endings(spark, text, end):
    got = spark.createDataFrame([(text,)], "t string").select(tx.ensure_period(tx.one_paragraph(F.col("t")))).first()[0]
    assert got == ("a " + end if end else "")


def test_all_sizes_are_refined(spark):
    got = {tuple(r)[:4]: r.value for r in catalogue.QUERIES["q_refine_prototypes_all"](spark, DATA).collect()}
    slides, want = {}, {}
    for r in fixtures.read(spark, DATA, "embeddings").orderBy("vec_id").collect():
        slides.setdefault(r.label, []).append((r.vec_id, np.array(r.embedding, float)))
    for label, rows in slides.items():
        ids, x = np.array([i for i, _ in rows]), np.stack([v / np.linalg.norm(v) for _, v in rows])
        for k in (k for k in (2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 160, 200) if len(x) / k >= 6):
            for h in np.unique(ids % k):
                own = x[ids % k == h]
                mean = own.mean(0)
                w = np.exp(own @ mean / np.linalg.norm(mean) / 0.05)
                p = w @ own
                want |= {(label, k, h, d + 1): v for d, v in enumerate(p / np.linalg.norm(p))}
    assert set(got) == set(want) and max(k for _, k, _, _ in got) > 4
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_empty_clusters_have_no_prototype():
    import pandas as pd

    rows = pd.DataFrame({"slide_id": 1, "k": 6, "vec_id": [6, 8, 12], "h": [0, 2, 0], "emb": [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]})
    got = catalogue._refined(rows)
    assert got.h.to_list() == [0, 2] and np.stack(got.emb.to_list()).tolist() == [[1.0, 0.0], [0.0, 1.0]]


def test_ablation_takes_all_replicates(spark):
    rows = [r for r in catalogue.QUERIES["q_score_ablation_full"](spark, DATA).collect() if r.variant != "rerank"]
    steps = [r.p * 20_000 for r in rows]
    assert all(abs(x - round(x)) < 0.02 for x in steps) and any(round(x) % 200 for x in steps)  # not all multiples of 1/100


def test_bootstrap_multi_takes_all_replicates(spark):
    rows = catalogue.QUERIES["q_bootstrap_multi"](spark, DATA).filter("method <> 'a'").collect()
    steps = [r.p * 20_000 for r in rows]
    assert all(abs(x - round(x)) < 1e-6 for x in steps) and any(round(x) % 10 for x in steps)  # not all multiples of 1/2000


def test_a_late_leak_is_met(spark):
    text = "Sheets of cells with round nuclei and clear cytoplasm. " * 12 + "Seen in breast."
    df = spark.createDataFrame([(1, "c", "p", text, "Ductal Carcinoma", "Breast")], "slide_id long, case_id string, project_id string, slide_reports string, cancer_type_detailed string, site_of_resection_or_biopsy string")
    r = rewriting.rewrite(df).first()
    assert r.attempts_used == 2 and len(r.rewritten_text) > 600 and "breast" not in r.rewritten_text.lower()
