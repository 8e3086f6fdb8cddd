"""Removal of repeated word windows by compaction of a De Bruijn graph of words.

A window of ``WINDOW`` words is an edge between the nodes of its first and last ``WINDOW - 1`` words.

1. Edges are filed by minimizer: of the 8-word runs in a window, the one with the least hash. Only windows
   whose minimizer occurs in two documents can repeat; they make a document's candidate walks.
2. Walks send each node with its edge before and after to the node's bucket. A node is a break if it has two
   different edges on a side, one of which may be the end of a walk. Between breaks a path does not branch,
   and each document on a part of it is on all of it. Hashes of nodes and anchors may be short: two that are taken
   for one only add a break or a candidate. Two edges that are taken for one would hide a break and keep words, so
   these have 63 bits, made from words hashed under a key of the run.
3. Walks are cut at breaks. The paths so compacted are joined over all blocks by the digest of their exact
   words, which verifies what the hashes proposed, and take the least document that holds them.
4. Paths go back to their source coordinates: a document loses the words of each path that a smaller id holds.

Words are removed by exact text alone; two different edges of one node are taken for one with a probability of 2^-56 at
most, whatever the texts.

Cases: a null text has no words; texts shorter than a window keep all words; a null id counts as the largest;
rows with equal ids never remove from each other and gather nowhere; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossrank.llm.blocks import MESSAGE, Dealt, answers, ask, cuts, deal, documents, in_order, kept_state, message_table, messages
from crossrank.llm.common import Words, digest, shuffles_removed, table, written

WINDOW, ANCHOR = 13, 8


def _anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word at which each window starts, and the window's minimizer."""
    whole = len(w.hash) - WINDOW + 1
    if whole <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    a = w.runs(ANCHOR)
    low = a[:whole].copy()
    for i in range(1, WINDOW - ANCHOR + 1):
        np.minimum(low, a[i : i + whole], out=low)
    at = np.flatnonzero(w.text[:whole] == w.text[WINDOW - 1 :])
    return at, low[at]


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _elsewhere(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """For each value that a block sent: whether another one was equal."""
    whole = np.concatenate(arrays)
    order = np.argsort(whole, kind="stable")
    s = whole[order]
    same = np.zeros(len(s), bool)
    eq = s[1:] == s[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    out = np.empty(len(s), bool)
    out[order] = same
    return np.split(out, np.cumsum([len(a) for a in arrays])[:-1])


def _breaks(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """For each (node, edge before, edge after): whether the node has two different edges on a side."""
    whole = np.concatenate(arrays)
    order = np.argsort(whole["node"], kind="stable")
    s = whole[order]
    start = np.flatnonzero(np.concatenate([[True], s["node"][1:] != s["node"][:-1]]))
    group = np.cumsum(np.concatenate([[0], (s["node"][1:] != s["node"][:-1]).astype(np.int64)]))
    split = np.zeros(len(start), bool)
    for side in ("before", "after"):
        split |= np.minimum.reduceat(s[side], start) != np.maximum.reduceat(s[side], start)
    out = np.empty(len(s), bool)
    out[order] = split[group]
    return np.split(out, np.cumsum([len(a) for a in arrays])[:-1])


NODE = np.dtype([("before", "<u8"), ("after", "<u8"), ("node", "<u4")])
#: A candidate walk: the words (within its block) at which its first and last window start.
WALK = np.dtype([("first", "<i4"), ("last", "<i4")])


def _walks(at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Maximal runs of candidate windows of one text; ``at``: words at which candidates start."""
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]])
    out = np.empty(int(new.sum()), WALK)
    out["first"], out["last"] = at[new], at[np.append(new[1:], True)[: len(at)]]
    return out


def _nodes(w: Words, walks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, edge before and edge after (0: none) of each node of each walk, walk after walk."""
    if not len(walks):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    edges = np.append(w.runs(WINDOW) | np.uint64(1), np.uint64(0))
    size = (walks["last"] - walks["first"] + 2).astype(np.int64)
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) + np.repeat(walks["first"] - (ends - size), size)
    before, after = edges[at - 1], edges[np.minimum(at, len(edges) - 1)]
    before[ends - size] = 0
    after[ends - 1] = 0
    return w.runs(WINDOW - 1)[at], before, after


def _entries(w: Words, walks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries of a block sorted by node, the nodes' hashes, and the entry of each node of each walk."""
    node, before, after = _nodes(w, walks)
    order = np.lexsort((after, before, node))
    n, b, a = node[order], before[order], after[order]
    new = np.ones(len(n), bool)
    new[1:] = (n[1:] != n[:-1]) | (b[1:] != b[:-1]) | (a[1:] != a[:-1])
    entry = np.empty(len(n), np.int64)
    entry[order] = np.cumsum(new) - 1
    data = np.empty(int(new.sum()), NODE)
    data["node"], data["before"], data["after"] = _low(n[new]), b[new], a[new]
    return data, n[new], entry


PATH = "digest binary, block long, least long, places binary"
#: A place of a path: sort key of the id, text within the block, first word, words.
PLACE = np.dtype([("id", "<i8"), ("text", "<i4"), ("first", "<i4"), ("words", "<i4")])


def repeats(dealt: Dealt) -> DataFrame:
    """Paths of each block that lose words: ``block, digest, first, places``, with the least id that holds the path.

    A path with several places in a block has a row with them and the block's own least id, and, where another
    block has a smaller one, a row with that and no places.
    """

    docs, n, hash_key = dealt.docs, dealt.buckets, dealt.key

    def anchors(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        h = np.unique(_anchors(Words(documents(group)[2], hash_key))[1])
        return message_table(messages(block, cuts(h, n), _low(h)))

    def nodes(key, group: pa.Table, got: pa.Table) -> pa.Table:
        if not group.num_rows:
            return message_table([])
        w = Words(documents(group)[2], hash_key)
        at, low = _anchors(w)
        h, of = np.unique(low, return_inverse=True)
        # An anchor in two documents of this block is a candidate whatever the other blocks hold.
        text = w.text[at]
        least, most = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), -1)
        np.minimum.at(least, of, text)
        np.maximum.at(most, of, text)
        shared = (answers(got, len(h)) > 0) | (least != most)
        walks = _walks(at[shared[of]], w.text)
        data, full, _ = _entries(w, walks)
        return message_table([(-1 - key[0].as_py(), key[0].as_py(), walks.tobytes()), *messages(key[0].as_py(), cuts(full, n), data)])

    def paths(key, group: pa.Table, got: pa.Table) -> pa.Table:
        out: dict[bytes, list] = {}
        if group.num_rows:
            _, keys, texts = documents(group)
            w = Words(texts, hash_key)
            walks = np.frombuffer(kept_state(got), WALK)
            data, _, entry = _entries(w, walks)
            cut = answers(got, len(data))[entry] > 0
            at = 0
            for first, last in walks.tolist():
                edges = last - first + 1
                inner = np.flatnonzero(cut[at + 1 : at + edges]) + 1
                ends = [0, *inner.tolist(), edges]
                at += edges + 1
                text = int(w.text[first])
                words = w.raw[w.start[first] : w.end[last + WINDOW - 1]].split()
                begin, key_of = first - int(w.first[text]), int(keys[text])
                for s, e in zip(ends, ends[1:]):
                    path = words[s : e + WINDOW - 1]
                    out.setdefault(digest(b" ".join(path), hash_key), []).append((key_of, text, begin + s, len(path)))
        places = [np.array(p, PLACE) for p in out.values()]
        return pa.table({"digest": pa.array(list(out), pa.binary()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "least": pa.array([int(p["id"].min()) for p in places], pa.int64()), "places": pa.array([p.tobytes() for p in places], pa.binary())})

    by_block = docs.groupBy("block")
    marked = ask(by_block.applyInArrow(anchors, MESSAGE), _elsewhere, "<u4")
    broken = ask(by_block.cogroup(marked.groupBy("block")).applyInArrow(nodes, MESSAGE), _breaks, NODE.descr)
    found = by_block.cogroup(broken.groupBy("block")).applyInArrow(paths, PATH)
    with shuffles_removed(docs.sparkSession):
        found = written(docs.sparkSession, found, "paths")
    # Paths are ranked with one place at most: a row for each block that holds one, however many documents do.
    # Paths with more places in a block stay with it, and get back a smaller id only where another block has one.
    single = F.octet_length("places") == PLACE.itemsize
    slim = found.select("digest", "block", "least", F.when(single, F.col("places")).alias("places"))
    first = slim.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    moved = first.filter("first < least").select("block", "digest", "first", "places")
    return found.filter(~single).select("block", "digest", F.col("least").alias("first"), "places").unionByName(moved)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the words that stay, joined by one space.

    With ``carry`` also ``rest`` (all columns but the text) and ``text`` (an empty text where it was null).
    """
    dealt = deal(df, id_col, text_col, carry)
    docs = dealt.docs

    def keep(key, group: pa.Table, got: pa.Table) -> pa.Table:
        ids, keys, texts = documents(group)
        lost: dict[int, list[tuple[int, int]]] = {}
        rows = list(zip(got.column("digest").to_pylist(), got.column("first").to_pylist(), got.column("places").to_pylist(), strict=True))
        smaller = {d: f for d, f, raw in rows if raw is None}
        for digest, first, raw in rows:
            first = smaller.get(digest, first)
            for i, text, at, words in np.frombuffer(raw or b"", PLACE).tolist():
                if i > first:
                    lost.setdefault(text, []).append((at, at + words))
        total, removed, kept = [], [], []
        for k, t in enumerate(texts):
            words = t.split()
            total.append(len(words))
            if k in lost:
                gone = np.zeros(len(words) + 1, np.int32)
                for s, e in lost[k]:
                    gone[s] += 1
                    gone[e] -= 1
                stay = np.cumsum(gone[:-1]) == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        out = pa.table({"doc_id": ids, "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})
        if carry:
            whole = in_order(group)
            out = out.append_column("text", whole.column("text")).append_column("rest", whole.column("rest"))
        return out

    longs = [T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_removed")]
    schema = T.StructType([*longs, T.StructField("kept", T.StringType())])
    if carry:
        schema = schema.add("text", T.StringType()).add("rest", docs.schema["rest"].dataType)
    return docs.groupBy("block").cogroup(repeats(dealt).groupBy("block")).applyInArrow(keep, schema)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeated windows taken out of its texts; texts that lose nothing stay as they are."""
    found = deduplicate(df, id_col, text_col, carry=True)
    new = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.select(*[new.alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in df.columns])


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
