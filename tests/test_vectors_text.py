import random

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossrank.functions import text as tx
from crossrank.functions import vectors as vx


def test_vector_functions_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 7)), rng.normal(size=(20, 7))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "i int, a array<double>, b array<double>")
    got = df.select("i", vx.unit(F.col("a")).alias("u"), vx.dot(F.col("a"), F.col("b")).alias("d"), vx.population_scale(F.col("a")).alias("s"), vx.logsumexp(F.col("a")).alias("l"), vx.softmax(F.col("a"), 0.05).alias("w"), vx.argmax_first(F.col("a")).alias("m")).orderBy("i").collect()
    assert np.allclose([r.u for r in got], x / np.linalg.norm(x, axis=1, keepdims=True))
    assert np.allclose([r.d for r in got], (x * y).sum(1)) and np.allclose([r.s for r in got], x.std(1))
    assert np.allclose([r.l for r in got], np.log(np.exp(x).sum(1))) and [r.m for r in got] == x.argmax(1).tolist()
    e = np.exp(x / 0.05 - (x / 0.05).max(1, keepdims=True))
    assert np.allclose([r.w for r in got], e / e.sum(1, keepdims=True))


def test_zero_vectors_constant_strips_and_bad_numbers(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0] * 5)], "z array<double>, c array<double>")
    r = df.select(vx.unit(F.col("z")).alias("z"), vx.scaled_log_softmax(F.col("c")).alias("s")).first()
    assert r.z == [0.0, 0.0] and all(math.isfinite(v) for v in r.s)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-1.0,), (0.25,), (7.0,)], "x double")
    assert [r[0] for r in odd.select(vx.clip01(F.col("x"))).collect()] == [0.0, 0.0, 0.0, 0.0, 0.25, 1.0]


def test_ties_take_the_first(spark):
    assert spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>").select(vx.argmax_first(F.col("x"))).first()[0] == 1


@pytest.mark.parametrize(
    ("text", "line", "sentence"),
    [(None, "", ""), ("", "", ""), ("  a \t b\r\nc\n\n d ", "a b c d", "a b c d."), ("Done!", "Done!", "Done!"), (" x  y ", "x y", "x y.")],
)
def test_normalising(spark, text, line, sentence):
    df = spark.createDataFrame([(text,)], "t string").select(tx.one_paragraph(F.col("t")).alias("l"))
    assert tuple(df.select("l", tx.ensure_period(F.col("l"))).first()) == (line, sentence)


def test_useful_and_retry(spark):
    df = spark.createDataFrame([("x" * 15,), ("x  " * 5,), (None,)], "t string")
    assert [r[0] for r in df.select(tx.useful(F.col("t"))).collect()] == [True, False, False]
    df = spark.createDataFrame([("Try AGAIN in 12s please",), ("later",)], "t string")
    assert [r[0] for r in df.select(tx.retry_seconds(F.col("t"))).collect()] == [12, None]


#: A positive text for each kind of pattern.
POSITIVE = (
    "Adenocarcinoma with metastasis at the primary tumor, compatible with a germ cell neoplasia. WHO grade II, high-grade, Gleason 7, grade 3. "
    "pT2 stage iii TNM confined to the lobe. Surgical margin free; entire specimen. Immunohistochemistry: ER, PR, HER2, Ki-67, MIB 1, CK 7, TTF-1, CD20, "
    "melan-a, p53, hbme1. A firm 5.0 cm mass, cut surfaces gross. This has been removed to avoid revealing; must be omitted by these instructions. favors"
)


def test_static_patterns_equal_python(spark):
    texts = [POSITIVE, POSITIVE.upper(), "\u017fite of or\u0131gin, \u212ai-67, GRO\u017f\u017f, S\u0130TE of origin", "Quiet text about cells.", "Überer Befund", "er", "therapy", "high grade", "5 mm"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.h for r in df.select("i", tx.static_hits(F.col("t")).alias("h")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [p for p in tx.STATIC_PATTERNS if re.search(p, t, re.I)]
    assert len(got[0]) > 35 and got[1] == got[0] and len(got[2]) > 2 and len(tx.STATIC_PATTERNS) == 92 and len(tx.STOPWORDS) == 35


def test_dynamic_terms_are_prefixes(spark):
    df = spark.createDataFrame([("Breast Invasive Ductal Carcinoma, NOS", None, "A ductally shaped, carcinomatous breast; conductal")], "a string, b string, t string")
    r = df.select(tx.dynamic_terms(F.col("a"), F.col("b")).alias("d"), "t").select("d", tx.dynamic_hits(F.col("t"), F.col("d")).alias("h"), tx.retry_prompt(F.concat("d", "d")).alias("p")).first()
    assert r.d == ["breast", "carcinoma", "ductal"] == r.h
    assert "breast, carcinoma, ductal." in r.p


def test_plain_parts_of_patterns():
    assert [tx.literal(p) for p in (r"\bfavor(s|ing)?\b", r"\bhbme1?\b", r"\bcd\d{1,3}\b", r"\bsite of origin\b", r"\bki[\s-]?67\b", r"\b\d+(\.\d+)?\s*(cm|mm)\b")] == ["favor", "hbme", "cd", "site of origin", "ki", ""]


def test_leaks_equal_plain_searches_without_case(spark):
    """Folded texts give what the patterns give on the texts themselves when case does not count."""
    rnd = random.Random(1)
    parts = ["er", "ER", "Gleason", "gleaſon", "MARGINS", "Ki-67", "ki 67", "CK 7", "cd20", "CD 3", "P53x", "5.0 cm", "İt", "fırm", "FIRM", "Grade IV", "grade 3", "high-grade", "her2é", "éer", "er_", "ther", "\n", "-", ".", "ſ100", "melan-a", "immunohistochemistry", "pT2", "stage iii", "٠ cm", "BREAST", "breasts", "xbreast", "ASSİSE", "ſkin"]
    terms = ["breast", "Assise", "skin", "glio"]
    rows = [(i, rnd.choice([" ", ""]).join(rnd.choices(parts, k=rnd.randrange(0, 9))), terms) for i in range(1500)] + [(9000, None, terms)]
    text = F.coalesce("t", F.lit(""))
    plain = F.array_compact(F.array(*[F.when(text.rlike("(?iuU)" + p), F.lit(p)) for p in tx.STATIC_PATTERNS]))
    named = F.filter("w", lambda w: F.regexp_like(text, F.concat(F.lit(r"(?iuU)\b"), w, F.lit(r"\w*\b"))))
    df = spark.createDataFrame(rows, "i long, t string, w array<string>")
    got = df.select(tx.static_hits(F.col("t")).alias("a"), plain.alias("b"), tx.dynamic_hits(F.col("t"), F.col("w")).alias("c"), named.alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got) and sum(len(r.a) for r in got) > 1500 and sum(len(r.c) for r in got) > 100


def test_one_pass_over_white_space_equals_the_steps_one_by_one(spark):
    """Column and Python form against the plain steps: line ends, runs of blanks and tabs, line ends to blanks, runs of any white space."""
    from crossrank.operators.rewriting import _line

    def steps(s):
        s = re.sub(r"[ \t]+", " ", s.replace("\r", "\n")).replace("\n", " ")
        return re.sub(r"\s{2,}", " ", s).strip()

    rng = random.Random(3)
    odd = "  \t\r\n\x0b\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u3000" + "aZ.!~\u00e9\u200b\U0001f600"
    texts = ["", " ", "\u3000", "\t", "a\tb", "a \xa0b", "\xa0a\xa0"] + ["".join(rng.choices(odd, k=rng.randrange(1, 30))) for _ in range(2000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.one_paragraph(F.col("t"))).collect()
    assert dict(map(tuple, got)) == {i: steps(t) for i, t in enumerate(texts)}
    assert [_line(t) for t in texts] == [steps(t) for t in texts]


def test_python_and_column_find_the_same_leaks(spark):
    from crossrank.operators.rewriting import _leaks

    texts = ["", "High-Grade FIRM mass, 3.5 CM; Ki 67", "\u0130n keep\u0131ng with \u017farcoma", "CYTO\u212aERATIN breasts abreast", "cd20 CD 20 her2neu HER2", "STAGE II pT2 tnm grade iv"]
    terms = ["breast", "keratin", "mass"]
    patterns = [(tx.literal(p), re.compile(p)) for p in tx.STATIC_PATTERNS]
    whole = [[p for p in tx.STATIC_PATTERNS if re.search(p, t.translate(str.maketrans(*tx.FOLDED)), re.I)] + [x for x in terms if re.search(rf"\b{x}\w*\b", t.translate(str.maketrans(*tx.FOLDED)), re.I)] for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.leakage(F.col("t"), F.array(*map(F.lit, terms)))).collect()
    assert [_leaks(t, terms, patterns) for t in texts] == whole and dict(map(tuple, got)) == dict(enumerate(whole))
