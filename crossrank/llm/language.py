"""Language identification: multinomial naive Bayes over hashed character n-grams.

A language's log-probabilities are one row of a table, of a fixed size. Up to ``PASS_LANGUAGES`` of them go to the
executors as one broadcast matrix; if there are more, texts pass by one matrix after another and keep the best label
and the sum so far, so no language is left out. Whole texts are scored, many at once, by gathers and segment sums
in numpy. A language's share is that of all rows that may be learned from, not of the sample.

Cases: a null text, or one without a letter (Unicode category L: no digits, fractions or numeral signs), is ``und``
with score 0; rows whose language, text or id is null are never learned from; without any row to learn from, all
texts are ``und``. Of equally likely languages the first by name is taken. Rows that repeat id and text are learned
from once; each gives a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossrank.llm.common import fold, fresh, table, written

#: Hash buckets for each n-gram order, and the orders.
BUCKETS, ORDERS = 1 << 14, (1, 2, 3)
#: Rows learned from for each language, about (those with the least hash of id and text), and groups they are dealt into.
LEARN_ROWS, DEALT = 3000, 16
#: Languages of a pass (their matrix has 200 KB each), and those whose gathers are held at once.
PASS_LANGUAGES, HELD = 256, 16
SMOOTH = 0.5
#: Characters handled at once; longer texts go in slices that overlap by the longest n-gram.
SLICE = 1 << 18

_LETTER = regex.compile(r"\p{L}").search


def grams(codes: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each character, a row for each order; ``codes`` has 2 characters more."""
    n = len(codes) - 2
    a, b, c = (codes[k : k + n].astype(np.uint32) for k in range(3))
    m, shift = np.uint32(0x9E3779B1), np.uint32(32 - (BUCKETS.bit_length() - 1))
    with np.errstate(over="ignore"):
        h1 = a * m
        h2 = (h1 ^ (b * np.uint32(0x85EBCA77))) * m
        h3 = (h2 ^ (c * np.uint32(0xC2B2AE3D))) * m
    return np.stack([(h >> shift).astype(np.int32) + k * BUCKETS for k, h in enumerate((h1, h2, h3))])


def slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of many texts, in slices: buckets by order, starts of segments, text of each segment.

    Two blanks follow a text. The two places at the end of a segment start no n-gram of their own: there the next
    text begins, or the overlap with the text's next slice. They have bucket -1.
    """
    parts, starts, owner, size = [], [], [], 0
    for k, t in enumerate(texts):
        codes = np.frombuffer((t.lower() + "  ").encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(codes) - 2
        for s in range(0, n, SLICE):
            piece = codes[s : min(n, s + SLICE) + 2]
            parts.append(piece)
            starts.append(size)
            owner.append(k)
            size += len(piece)
            if size >= SLICE:
                yield _segment_grams(parts, starts), np.array(starts), np.array(owner)
                parts, starts, owner, size = [], [], [], 0
    if parts:
        yield _segment_grams(parts, starts), np.array(starts), np.array(owner)


def _segment_grams(parts: list[np.ndarray], starts: list[int]) -> np.ndarray:
    g = grams(np.concatenate([*parts, np.full(2, 32, parts[0].dtype)]))
    ends = np.array([*starts[1:], g.shape[1]], np.int64)
    g[:, np.concatenate([ends - 1, ends - 2])] = -1
    return g


def scores(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """Sums of the log-probabilities of all n-grams: texts by languages."""
    out = np.zeros((len(texts), logs.shape[1]))
    logs = np.concatenate([logs, np.zeros((1, logs.shape[1]), logs.dtype)])  # what bucket -1 adds
    held = [np.ascontiguousarray(logs[:, k : k + HELD]) for k in range(0, logs.shape[1], HELD)]
    for g, starts, owner in slices(texts):
        for k, part in enumerate(held):
            each = part[g[0]] + part[g[1]] + part[g[2]]
            np.add.at(out[:, k * HELD : (k + 1) * HELD], owner, np.add.reduceat(each, starts, axis=0, dtype=float))
    return out


def learn(df: DataFrame, seed_col: str = "doc_id", rows: int = LEARN_ROWS) -> DataFrame:
    """A written table ``lang, n, logs``: a language, its rows, and its log-probabilities, from ``doc_id, text, lang``.

    A language is learned from its rows below a bound on their hash, which its count of different rows sets so that
    about ``rows`` lie there (within some hundredths, as the count is); nothing is ranked or gathered for that.
    """
    named = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col(seed_col).isNotNull())
    named = named.select("lang", "text", (F.xxhash64(seed_col, "text").cast("double") / 2.0**64 + 0.5).alias("draw"))
    sizes = named.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("draw", 0.02).alias("d"))
    last = written(df.sparkSession, sizes.select("lang", "n", F.least(F.lit(1.0), F.lit(float(rows)) / F.col("d")).alias("last")), "languages")
    sample = named.join(last.select("lang", "last"), "lang").filter("draw <= last").dropDuplicates(["lang", "draw"])
    size = BUCKETS * len(ORDERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def so_far() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["lang", "counts"])
            total.clear()
            return out

        for b in batches:
            langs = b.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                here = total.setdefault(lang, np.zeros(size))
                for g, _, _ in slices([t.as_py() for t, k in zip(b.column(1), langs, strict=True) if k == lang]):
                    here += np.bincount(g.ravel() + 1, minlength=size + 1)[1:]
                if len(total) >= PASS_LANGUAGES:
                    yield so_far()
        yield so_far()

    def add(group: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x.as_py()) for x in group.column("counts")).reshape(len(ORDERS), BUCKETS) + SMOOTH
        logs = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
        return pa.table({"lang": [group.column("lang")[0].as_py()], "logs": pa.array([logs.tobytes()], pa.binary())})

    dealt = sample.select("lang", "text", F.pmod(F.hash("draw"), F.lit(DEALT)).alias("deal")).repartition("lang", "deal").select("lang", "text")
    logs = dealt.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, logs binary")
    return written(df.sparkSession, logs.join(last.select("lang", "n"), "lang").select("lang", "n", "logs"), "language-model")


def annotate(df: DataFrame, model: DataFrame, text_col: str = "text", label_to: str = "lang_pred", score_to: str = "score") -> DataFrame:
    """``df`` with the language and its posterior in columns ``label_to`` and ``score_to``, in place of such columns."""
    context = df.sparkSession.sparkContext
    df = df.drop(label_to, score_to)
    sizes = {r.lang: r.n for r in model.select("lang", "n").collect()}
    names, total, columns = sorted(sizes), sum(sizes.values()), df.columns
    passes = [names[k : k + PASS_LANGUAGES] for k in range(0, len(names), PASS_LANGUAGES)] or [[]]
    top, mass = fresh(df, "top"), fresh(df, "mass")  # the best log-probability, and the logarithm of the sum of all
    state = [T.StructField(label_to, T.StringType()), T.StructField(top, T.DoubleType()), T.StructField(mass, T.DoubleType())]
    at_text, n = columns.index(text_col), len(columns)

    def one(known: list[str], first: bool):
        """A step that weighs the given languages."""
        got = {r.lang: r.logs for r in model.filter(F.col("lang").isin(known)).collect()} if known else {}
        logs = np.stack([np.frombuffer(got[x], np.float32) for x in known], 1) if known else np.zeros((0, 0), np.float32)
        shared = context.broadcast((known, np.log([sizes[x] / total for x in known]), logs))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, prior, matrix = shared.value
            for b in batches:
                size = b.num_rows
                label = ["und"] * size if first else b.column(n).to_pylist()
                best = np.full(size, -np.inf) if first else b.column(n + 1).to_numpy().copy()
                sums = np.full(size, -np.inf) if first else b.column(n + 2).to_numpy().copy()
                texts = b.column(at_text).to_pylist()
                at = [i for i, t in enumerate(texts) if here and t and _LETTER(t)]
                if at:
                    s = scores([texts[i] for i in at], matrix) + prior
                    most = s.argmax(1)
                    for k, i in enumerate(at):
                        sums[i] = np.logaddexp(sums[i], np.logaddexp.reduce(s[k]))
                        if s[k, most[k]] > best[i]:
                            best[i], label[i] = s[k, most[k]], here[most[k]]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(label, pa.string()), pa.array(best), pa.array(sums)], [*columns, label_to, top, mass])

        return run

    schema = T.StructType([*df.schema.fields, *state])
    for k, known in enumerate(passes):
        df = df.mapInArrow(one(known, k == 0), schema)
    score = F.when(F.col(top) > float("-inf"), F.least(F.lit(1.0), F.exp(F.col(top) - F.col(mass)))).otherwise(0.0)
    return df.select(*[F.col(f"`{c}`") for c in columns], label_to, score.alias(score_to))


#: Learned from the folds of crc32(doc_id) mod 3 other than this one.
FOLDS, HELD_OUT = 3, 1


def identify(docs: DataFrame, label_to: str = "lang_pred", score_to: str = "score") -> DataFrame:
    """Languages of all documents, learned from the named languages outside the held-out fold."""
    model = learn(docs.select("doc_id", "text", "lang").filter(fold("doc_id", FOLDS) != HELD_OUT))
    return annotate(docs, model, "text", label_to, score_to)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = identify(docs)
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
