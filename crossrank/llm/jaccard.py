"""N-gram Jaccard join: documents whose shingle sets are near-equal, and the groups that these links make.

The product of the document-by-shingle matrix with its transpose would hold every pair's overlap. It is blocked
and pruned so that only pairs that can reach the bound are multiplied:

1. Documents of one word sequence fold into the one with the least id.
2. Columns are counted over all documents through a block exchange. A document can only have a partner if the
   share of its shingles that other documents hold reaches the bound; most documents end here.
3. Of those left, shingles are ordered by how many blocks hold them, and any pair within the bound shares one
   of the first ``n - ceil(0.8 n) + 1`` of both (rarest) columns. Only these columns list their documents.
4. Within a column the document with the least share of shingles of its own is the hub, and is multiplied with
   the others; documents that come together this way need no product with each other.
5. Columns whose documents are still apart chain these documents into clusters. A cluster is cut into tiles of
   documents, those with the same columns together, and each pair of tiles that some column reaches is one task: a
   dense product over blocks of the columns that two of its documents share adds up overlaps; pairs below the bound
   that follows from their sizes are discarded, and of the links only those that bring components together leave
   the task.

No step caps a list: each pair within the bound is either multiplied or already connected. Products with hubs drop
a pair as soon as what remains of the columns cannot reach the bound.

A shingle is a 64-bit hash made from words hashed under a key of the run, so no text can be written to collide; two
different shingles are taken for one with a probability of 2^-57 at most, whatever the texts.

Cases: a null text, or one without words, has an empty set and no links; with fewer words than a shingle the
whole sequence is one; repeated rows fold; a null id takes no part in links and has a null component; rows with
equal ids and different texts count as one document for reachability; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossrank.llm.blocks import MESSAGE, NO_ID, Dealt, answers, ask, cuts, deal, documents, message_table, messages
from crossrank.llm.common import Words, digest, table, written
from crossrank.llm.components import components

SHINGLE = 5
#: The bound, in hundredths.
BOUND = 80
#: Blocks of columns in a product with a hub.
COLUMN_BLOCKS = 4
#: Documents of a tile, fewer (but so many at least) where sets are so large that a tile would hold more shingles;
#: columns of a block.
TILE_DOCS, LEAST_DOCS, TILE_SHINGLES, TILE_COLUMNS = 128, 16, 4 << 20, 4096


def _blocks_with(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """For each value that a block sent: how many blocks sent it (255 at most)."""
    whole = np.concatenate(arrays)
    _, of, n = np.unique(whole, return_inverse=True, return_counts=True)
    return np.split(np.minimum(n, 255)[of], np.cumsum([len(a) for a in arrays])[:-1])


CLASS = "digest binary, block long, least long"
DOC = "doc_id long, rep long, n long, own long, shingles array<long>, prefix array<long>"


def _first_of_class(texts: list[bytes], keys: np.ndarray, hash_key: bytes) -> tuple[Words, list[bytes], dict[bytes, int]]:
    """Words and digest of each text; the least id of each digest in this block."""
    w = Words([t.lower() for t in texts], hash_key)
    digests = [digest(w.joined(s, e), hash_key) for s, e in zip(w.first.tolist(), w.first[1:].tolist())]
    least: dict[bytes, int] = {}
    for d, k in zip(digests, keys.tolist(), strict=True):
        least[d] = min(k, least.get(d, NO_ID))
    return w, digests, least


def _heads(w: Words, digests: list[bytes], keys: np.ndarray, rep: dict[bytes, int]) -> list[int]:
    """Texts that stand for their class and are long enough for a link with another class."""
    seen: set[bytes] = set()
    out = []
    for k, d in enumerate(digests):
        if keys[k] == rep[d] != NO_ID and w.first[k + 1] - w.first[k] >= SHINGLE and d not in seen:
            seen.add(d)
            out.append(k)
    return out


def _sets(w: Words, texts: list[int]) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of the given texts; a shorter text is one shingle."""
    h = w.runs(SHINGLE)
    out = []
    for k in texts:
        s, e = int(w.first[k]), int(w.first[k + 1])
        out.append(np.unique(h[s : e - SHINGLE + 1]) if e - s >= SHINGLE else w.hash[s : min(e, s + 1)])
    return out


def _columns(w: Words, heads: list[int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each head, the distinct ones of all, each head's places among them, and heads that hold each."""
    sets = _sets(w, heads)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    h, of, n = np.unique(flat, return_inverse=True, return_counts=True)
    return sets, h, of, n


def documents_with_sets(dealt: Dealt) -> DataFrame:
    """``DOC``: each document's class and set size; for candidates also their sets and their rarest shared columns."""
    docs, n, hash_key = dealt.docs, dealt.buckets, dealt.key

    def classes(group: pa.Table) -> pa.Table:
        _, keys, texts = documents(group)
        _, _, least = _first_of_class(texts, keys, hash_key)
        return pa.table({"digest": pa.array(list(least), pa.binary()), "block": pa.array([group.column("block")[0].as_py()] * len(least), pa.int64()), "least": pa.array(list(least.values()), pa.int64())})

    def elsewhere(got: pa.Table) -> dict[bytes, int]:
        return dict(zip(got.column("digest").to_pylist(), got.column("first").to_pylist(), strict=True))

    def count(key, group: pa.Table, got: pa.Table) -> pa.Table:
        if not group.num_rows:
            return message_table([])
        block = key[0].as_py()
        _, keys, texts = documents(group)
        w, digests, least = _first_of_class(texts, keys, hash_key)
        least |= elsewhere(got)
        heads = _heads(w, digests, keys, least)
        h = _columns(w, heads)[1]
        moved = [(d, v) for d, v in elsewhere(got).items()]
        state = b"".join(d + v.to_bytes(8, "little", signed=True) for d, v in moved)
        return message_table([(-1 - block, block, state), *messages(block, cuts(h, n), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32))])

    def choose(key, group: pa.Table, got: pa.Table) -> pa.Table:
        ids, keys, texts = documents(group)
        w, digests, least = _first_of_class(texts, keys, hash_key)
        state = next((d for b, d in zip(got.column("bucket").to_pylist(), got.column("data").to_pylist(), strict=True) if b < 0), b"")
        least |= {state[s : s + 16]: int.from_bytes(state[s + 16 : s + 24], "little", signed=True) for s in range(0, len(state), 24)}
        heads = _heads(w, digests, keys, least)
        sets, h, of, here = _columns(w, heads)
        blocks = answers(got, len(h)) if group.num_rows else np.empty(0, np.uint8)
        shared = (blocks > 1) | (here > 1)
        size = [-1] * len(texts)
        own, full, prefix = [None] * len(texts), [None] * len(texts), [None] * len(texts)
        at = 0
        for k, s in zip(heads, sets, strict=True):
            place = of[at : at + len(s)]
            at += len(s)
            size[k] = len(s)
            mine = shared[place]
            held = int(mine.sum())
            if 100 * held >= BOUND * len(s):
                order = np.lexsort((s, blocks[place]))[: len(s) - -(-BOUND * len(s) // 100) + 1]
                order = order[mine[order]]
                if len(order):
                    own[k], full[k], prefix[k] = len(s) - held, s.view(np.int64), s[order].view(np.int64)
        rest = [k for k, z in enumerate(size) if z < 0]
        for k, x in zip(rest, _sets(w, rest), strict=True):
            size[k] = len(x)
        filled = np.diff(w.first) > 0
        rep = [None if keys[k] == NO_ID else least[d] if filled[k] else int(keys[k]) for k, d in enumerate(digests)]
        kind = pa.list_(pa.int64())
        return pa.table([ids, pa.array(rep, pa.int64()), pa.array(size, pa.int64()), pa.array(own, pa.int64()), pa.array(full, kind), pa.array(prefix, kind)], ["doc_id", "rep", "n", "own", "shingles", "prefix"])

    by_block = docs.groupBy("block")
    held = by_block.applyInArrow(classes, CLASS)
    first = held.withColumn("first", F.min("least").over(Window.partitionBy("digest")))  # a row for each block at most
    moved = first.filter("first < least").select("block", "digest", "first")
    counted = ask(by_block.cogroup(moved.groupBy("block")).applyInArrow(count, MESSAGE), _blocks_with, "<u4")
    return by_block.cogroup(counted.groupBy("block")).applyInArrow(choose, DOC)


def overlap_reaches(a: np.ndarray, b: np.ndarray, bound: int = BOUND) -> bool:
    """Whether the overlap of two sorted sets reaches the bound; adds up over blocks of columns, stops early."""
    need = -(-bound * (len(a) + len(b)) // (100 + bound))  # least overlap with 100 * overlap >= bound * union
    if min(len(a), len(b)) < need:
        return False
    edges = (np.arange(1, COLUMN_BLOCKS, dtype=np.uint64) << np.uint64(62)).view(np.int64)
    ca, cb = (np.concatenate([[0], np.searchsorted(x, np.sort(edges)), [len(x)]]) for x in (a, b))
    have = 0
    for k in range(COLUMN_BLOCKS):
        both = np.concatenate([a[ca[k] : ca[k + 1]], b[cb[k] : cb[k + 1]]])
        both.sort()
        have += int((both[1:] == both[:-1]).sum())
        if have + min(len(a) - ca[k + 1], len(b) - cb[k + 1]) < need:
            return False
    return have >= need


def multiply(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose overlap reaches the bound."""

    def run(batches):
        for t in batches:
            x, y = t.column("x"), t.column("y")
            ok = [overlap_reaches(np.sort(x[i].values.to_numpy()), np.sort(y[i].values.to_numpy())) for i in range(t.num_rows)]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def product(group: pa.Table) -> pa.Table:
    """Links of one pair of tiles that bring different components together."""
    t, u = group.column("t")[0].as_py(), group.column("u")[0].as_py()
    group = group.sort_by("doc_id")
    tile, ids, comp = (group.column(c).to_numpy() for c in ("tile", "doc_id", "component"))
    sets = [x.values.to_numpy() for x in group.column("shingles")]
    rows, cols = np.flatnonzero(tile == t), np.flatnonzero(tile == u)
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held[column] > 1  # a column of one document adds to no overlap
    column = np.unique(column[shared], return_inverse=True)[1]
    owner, count = owner[shared], int(column.max()) + 1 if shared.any() else 0
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    overlap = np.zeros((len(rows), len(cols)), np.float32)
    for start in range(0, count, TILE_COLUMNS):
        s, e = np.searchsorted(column, [start, start + TILE_COLUMNS])
        block = np.zeros((len(sets), min(TILE_COLUMNS, count - start)), np.float32)
        block[owner[s:e], column[s:e] - start] = 1
        overlap += block[rows] @ block[cols].T
    overlap = overlap.astype(np.int64)
    ok = (100 * overlap >= BOUND * (size[rows][:, None] + size[cols][None] - overlap)) & (comp[rows][:, None] != comp[cols][None])
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while (p := top.get(c, c)) != c:
            top[c] = top.get(p, p)
            c = p
        return c

    a, b = [], []
    for i, j in zip(*np.nonzero(ok)):
        x, y = root(int(comp[rows[i]])), root(int(comp[cols[j]]))
        if x != y:
            top[max(x, y)] = min(x, y)
            a.append(int(ids[rows[i]]))
            b.append(int(ids[cols[j]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links(docs: DataFrame) -> DataFrame:
    """Links ``a, b`` between representatives that suffice for all components, from a written ``DOC`` table."""
    spark = docs.sparkSession
    sets = docs.filter(F.col("prefix").isNotNull()).select("doc_id", "shingles")
    lists = docs.filter(F.col("prefix").isNotNull()).select(F.explode("prefix").alias("column"), "doc_id", "n", (F.col("own") / F.col("n")).alias("alone"))
    hubs = lists.groupBy("column").agg(F.min(F.struct("alone", "doc_id", "n")).alias("hub"), F.count("*").alias("c")).filter("c > 1")
    # Written, so that the join below is between two exchanges and Spark can split a column with many documents.
    hubs = written(spark, hubs.select("column", F.col("hub.doc_id").alias("a"), F.col("hub.n").alias("m")), "hubs")
    fits = (F.col("doc_id") != F.col("a")) & (100 * F.least("n", "m") >= BOUND * F.greatest("n", "m"))
    pairs = written(spark, lists.join(hubs, "column").filter(fits).select("a", F.col("doc_id").alias("b")).distinct(), "pairs")
    near = written(spark, multiply(pairs, sets), "links")

    comp = components(near)
    here = lists.join(comp, lists.doc_id == comp.node, "left").select("column", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    apart = here.groupBy("column").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("doc_id").alias("first")).filter("c0 < c1")
    apart = written(spark, apart.select("column", "first"), "columns")
    left = written(spark, here.join(apart, "column").select("doc_id", "n", "component", "first").distinct(), "apart")
    cluster = components(left.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    nodes = left.groupBy("doc_id", "n", "component").agg(F.min("first").alias("lump")).join(cluster, "doc_id")
    # Documents of one lump share a tile as far as it holds them, so that columns reach few tiles.
    fit = F.greatest(F.lit(LEAST_DOCS), F.least(F.lit(TILE_DOCS), F.floor(TILE_SHINGLES / F.max("n"))))
    tiles = nodes.groupBy("cluster").agg(fit.alias("fit"), F.ceil(F.count("*") / fit).alias("tiles"))
    lumps = nodes.groupBy("cluster", "lump").agg(F.count("*").alias("c")).join(tiles, "cluster")
    spread = F.xxhash64("lump") + F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("c") / F.col("fit")))
    placed = nodes.join(lumps, ["cluster", "lump"]).select("cluster", "doc_id", "component", "tiles", F.pmod(spread, F.col("tiles")).alias("tile"))
    placed = written(spark, placed, "tiles")
    # Only tiles that a column reaches together meet.
    reached = left.select("doc_id", "first").join(placed.filter("tiles > 1"), "doc_id").select("cluster", "first", "tile").distinct()
    other = reached.select("cluster", "first", F.col("tile").alias("u"))
    meet = reached.withColumnRenamed("tile", "t").join(other, ["cluster", "first"]).filter("t <= u").select("cluster", "t", "u").distinct()
    alone = placed.filter("tiles = 1").select("cluster", F.col("tile").alias("t"), F.col("tile").alias("u")).distinct()
    each = meet.union(alone).select("*", F.explode(F.array_distinct(F.array("t", "u"))).alias("tile"))
    dealt = each.join(placed.drop("tiles"), ["cluster", "tile"])
    more = dealt.join(sets, "doc_id").groupBy("cluster", "t", "u").applyInArrow(product, "a long, b long")
    return near.union(written(spark, more, "links"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``."""
    spark = df.sparkSession
    docs = written(spark, documents_with_sets(deal(df, id_col, text_col)), "sets")
    comp = components(links(docs))
    out = docs.select("doc_id", "rep", F.col("n").alias("n_shingles")).join(comp, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
