import base64
import dataclasses
import functools
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crossrank.llm import common, jaccard, labelled, language, packing, pii, quality, substrings, tokens, toxicity

DATA = "/root/testdata/sf0.001"
#: A null, empty texts, only blanks, one word, a very long text with and without blanks, odd characters, repeats.
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, LONG), (6, "a" * 200_000), (7, "\U0001f600 \x1c é\x00ß  tail"), (8, "same text twice over"), (8, "same text twice over"), (None, "no id here at all"), (9, "same text twice over")]
CLASH = ("block", "rest", "score", "lang_pred", "n", "component", "_pii", "s", "kept", "shard", "bucket", "y", "row")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def words(text):
    return (text or "").encode().split()


# --- substring dedup


def brute_windows(rows, n=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for p in range(k, k + n)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out)


def test_substrings_equal_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(4)]  # few words: windows branch, repeat within a text, and overlap
    rows = [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(0, 60)))) for i in range(60)]
    passage = [f"p{i}" for i in range(40)]
    rows += [(100 + i, " ".join([*rnd.choices(vocab, k=5), *passage[rnd.randrange(10) : 40 - rnd.randrange(10)], *rnd.choices(vocab, k=5)])) for i in range(30)]
    rows += [(200 + i, " ".join(passage[: 12 + i])) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, substrings.deduplicate(df).collect()))
    assert got == brute_windows(rows)
    many = dataclasses.replace(dealt := substrings.deal(df, "doc_id", "text"), docs=dealt.docs.withColumn("block", F.pmod("doc_id", F.lit(7))))
    assert substrings.repeats(many).count() > 0  # the same over several blocks


def test_words_that_collide_in_a_short_hash(spark):
    """These two words made edges alike in 31 bits of an unkeyed hash, which hid the branch between them."""
    shared = " ".join(f"p0x{k}" for k in range(20))
    rows = [(1, shared + " w0y109094 tail one"), (2, shared + " w0y125704 tail two")]
    got = sorted(map(tuple, substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_windows(rows) and got[1][2] == 20


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(k).count("1") + swap) % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_in_a_polynomial(spark, n):
    """A Thue-Morse word and its complement are equal under each polynomial hash modulo 2^64."""
    key = common.new_key()
    h = common.word_hashes(f"{thue_morse(n)} {thue_morse(n, True)} ab ab".encode(), key)[2]
    assert len(set(h.tolist())) == 3 and h[2] == h[3]
    rest = [f"w{k}" for k in range(13)]
    rows = [(i, " ".join([*rest[:7], thue_morse(n, i == 2), *rest[7:]])) for i in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(df).collect()} == brute_groups(rows) == {1: (10, 1), 2: (10, 2)}
    assert sorted(map(tuple, substrings.deduplicate(df).collect())) == brute_windows(rows)


def test_runs_of_two_words_hash_apart():
    """All runs of 13 words over two words, so also those that a polynomial takes nearest together."""
    key = common.new_key()
    h = common.word_hashes(b"a b", key)[2]
    odd = common.multipliers(key, 13)
    got = {int(common.windows(h[[k >> j & 1 for j in range(13)]], odd)[0]) for k in range(1 << 13)}
    assert len(got) == 1 << 13


@given(st.lists(st.binary(min_size=1, max_size=80).map(lambda b: bytes(x + 33 if x < 33 else x for x in b)), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_word_hashes_are_polynomials_at_a_secret_point(words_):
    """Against Python's own integers; a piece boundary changes nothing."""
    key, prime = b"k" * 16, (1 << 61) - 1
    point = int.from_bytes(common.digest(b"point", key, 8), "little") % prime
    raw = b" \n".join(words_)
    start, end, h = common.word_hashes(raw, key)
    assert [raw[s:e] for s, e in zip(start, end)] == words_
    for w, x in zip(words_, h.tolist()):
        if len(w) > common.LONGEST:
            assert x == int.from_bytes(common.digest(w, key, 8), "little")
            continue
        y = len(w)
        for k in range(0, len(w), 7):
            y = (y * point + int.from_bytes(w[k : k + 7], "little")) % prime
        assert x == int(common.mix(np.array([y + 1], np.uint64))[0])
    old = common.PIECE
    try:
        common.PIECE = 16
        assert all((a == b).all() for a, b in zip(common.word_hashes(raw, key), (start, end, h)))
    finally:
        common.PIECE = old


@pytest.mark.parametrize("i", [7, None])
def test_one_id_on_very_many_rows(spark, monkeypatch, i):
    import crossrank.llm.blocks as blocks

    monkeypatch.setattr(blocks, "LEAST_BYTES", 256)
    rows = [(i if k % 3 == 0 else 100 + k, " ".join(f"x{k % 5}y{j}" for j in range(20 + k % 4))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = blocks.deal(df, "doc_id", "text")
    assert dealt.blocks > 40 and dealt.docs.filter(F.col("doc_id").eqNullSafe(F.lit(i))).select("block").distinct().count() >= 15
    order = lambda got: sorted(map(str, got))
    want = [(None if r[0] == 10**9 else r[0], *r[1:]) for r in brute_windows([(10**9 if x is None else x, t) for x, t in rows])]
    assert order(map(tuple, substrings.deduplicate(df).collect())) == order(want)
    assert jaccard.groups(df).count() == 300


def test_substrings_over_many_blocks(spark, monkeypatch):
    import crossrank.llm.blocks as blocks

    rnd = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(base[s : s + rnd.randrange(20, 200)])) for i in range(80) for s in [rnd.randrange(200)]]
    monkeypatch.setattr(blocks, "LEAST_BYTES", 256)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert blocks.deal(df, "doc_id", "text").blocks > 20
    assert sorted(map(tuple, substrings.deduplicate(df).collect())) == brute_windows(rows)


def test_substrings_leave_no_shuffle_of_the_paths(spark, docs):
    """The messages of blocks and buckets are gone once the paths are stored, before the texts are dealt again."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    lying = lambda: {n for n in re.findall(r"shuffle_\d+_\d+_\d+\.data", manager.getAllFiles().mkString("\n"))}
    dealt = substrings.deal(docs, "doc_id", "text")
    was = lying()
    paths = substrings.repeats(dealt)
    for _ in range(50):
        if not (left := lying() - was):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert sorted(paths.collect(), key=repr) == sorted(paths.collect(), key=repr)


def test_substrings_odd_rows(spark, odd):
    got = {r.doc_id: r for r in substrings.deduplicate(odd).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].kept == ""
    assert got[5].n_removed == 0 and got[6].n_words == 1 and got[7].n_words == 4
    copy = odd.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")).union(odd.filter("doc_id = 5"))
    got = {r.doc_id: r for r in substrings.deduplicate(copy).collect()}
    assert got[5].n_removed == 0 and got[None].n_removed == got[None].n_words == 60_000
    whole = substrings.without_repeats(odd)
    assert whole.columns == odd.columns and whole.count() == len(ODD) and {r.block for r in whole.collect()} == {7}
    assert substrings.deduplicate(odd.limit(0)).count() == 0


# --- n-gram Jaccard join


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y) and root(a) != root(b):
                top[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed):
    """Chains and stars of near copies around the bound, exact copies, common passages, short texts."""
    rnd = random.Random(seed)
    rows, i = [], 1000
    for size in (8, 30, 120):
        base = [f"g{size}w{k}" for k in range(size)]
        now = base
        for _ in range(25):
            now = list(now if rnd.random() < 0.5 else base)
            for _ in range(rnd.randrange(0, max(2, size // 12))):
                now[rnd.randrange(size)] = f"r{rnd.randrange(10**6)}"
            rows.append((i := i - 7, " ".join(now)))
    common = [f"c{k}" for k in range(60)]
    rows += [(2000 + k, " ".join([*common, *(f"u{k}x{j}" for j in range(10 + k))])) for k in range(15)]
    return rows + [(3000, "One two three"), (2999, "one TWO  three"), (3001, ""), (3002, None), (3003, "a b c d e")]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, seed, monkeypatch):
    import crossrank.llm.blocks as blocks

    rows = near_copies(seed)
    monkeypatch.setattr(blocks, "LEAST_BYTES", 4096)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("least", [2, 16])
def test_jaccard_small_tiles(spark, monkeypatch, least):
    """Tiles are smaller than a group (its sets are held to few shingles), so links cross tiles."""
    rows = near_copies(3)
    for name, value in (("TILE_SHINGLES", 1), ("TILE_COLUMNS", 64), ("LEAST_DOCS", least)):
        monkeypatch.setattr(jaccard, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=40), st.sets(st.integers(-(2**63), 2**63 - 1), max_size=8), st.sets(st.integers(-(2**63), 2**63 - 1), max_size=8))
@settings(max_examples=200, deadline=None)
def test_products_with_early_stop(common, only_a, only_b):
    a, b = common | only_a, common | only_b
    want = 100 * len(a & b) >= 80 * len(a | b)
    assert jaccard.overlap_reaches(np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)) == want or not (a | b)


def test_jaccard_odd_rows(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(odd).collect()]
    assert Counter(got)[(8, 1, 8)] == 2 and (9, 1, 8) in got and (1, 0, 1) in got and (4, 1, 4) in got and (None, 1, None) in got
    assert jaccard.groups(odd.limit(0)).count() == 0


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


@functools.cache
def brute_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def check_pii(df, rows):
    want = sorted((str(i), hashlib.sha256(",".join(brute_spans(t)).encode()).hexdigest(), *[sum(s.startswith(k + ":") for s in brute_spans(t)) for k in BASE]) for i, t in rows)
    got = sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.detect(df).collect())
    assert got == want


def test_pii_equals_python(spark, docs, odd):
    check_pii(docs, [(r.doc_id, r.text) for r in docs.collect()])
    check_pii(odd, ODD)
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice(["a", "Z", "@", ".", "-", "+", " ", "4", "0", "(", ")", "_", "\U0001f600", "255", "111", "b.c"]) for _ in range(rnd.randrange(80)))) for i in range(400)]
    rows += [(1000, "9" * 30_000), (1001, "a" * 30_000 + "@"), (1002, "+1" + " 2" * 3000), (1003, "1." * 5000), (1004, "4111 1111 1111 1111, 4111-1111-1111-1112")]
    check_pii(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_pii_added_spans_scores_and_redaction(spark, odd):
    text = "IBAN GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33; mail a@b.co, ip 1.2.3.4"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.detect(df).first()
    assert r.spans == "iban:5:32,email:70:76,ip:81:88" and r.scores == "1.00,0.65,1.00"
    assert pii.redact(df).first().text == "IBAN <IBAN> or GB82 WEST 1234 5698 7654 33; mail <EMAIL>, ip <IP>"
    out = pii.redact(odd)
    assert out.columns == odd.columns and sorted(map(str, out.select("doc_id", "text", "_pii", "s").collect())) == sorted(map(str, odd.select("doc_id", "text", "_pii", "s").collect()))
    assert pii.detect(odd.limit(0)).count() == 0


def brute_masked(text, spans):
    out, at, stretch = [], 0, None
    for kind, s, e in spans:
        if stretch and s < stretch[2]:
            stretch[2] = max(stretch[2], e)
            continue
        if stretch:
            out += [text[at : stretch[1]], f"<{stretch[0].upper()}>"]
            at = stretch[2]
        stretch = [kind, s, e]
    if stretch:
        out += [text[at : stretch[1]], f"<{stretch[0].upper()}>"]
        at = stretch[2]
    return "".join([*out, text[at:]])


def test_masking_equals_python_on_overlaps_and_piece_borders(spark, docs):
    rnd = random.Random(9)
    parts = ["+49 171 23 45 678", "4111 1111 1111 1111", "1.2.3.4", "a@b.co", "+1.2.3.4@5.6.7.8", "\U0001f600\U0001f600", "x" * 1000, "é\n", " ", "GB82 WEST 1234 5698 7654 32", "1.2.3.4.5.6.7.8"]
    rows = [(k, "".join(rnd.choices(parts, k=rnd.randrange(0, 40)))) for k in range(120)]
    rows += [(200 + k, "z" * k + "a@b.co" + "y" * (2048 - k - 6)) for k in (0, 1017, 1018, 1019, 1023, 1024, 1025, 2042)] + [(300, "a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))
    listed = {(r.doc_id, r.text): r.s for r in pii.spans(df, to="s").collect()}
    want = sorted((i, brute_masked(t, [(x.kind, x.start, x.end) for x in s])) for (i, t), s in listed.items())
    assert sorted(map(tuple, pii.redact(df).distinct().collect())) == want


def test_context_words_on_both_sides(spark):
    texts = ["a@b.co is my mail", "mail a@b.co c@d.co", "a@b.co" + " -" * 30 + " mail", "mail" + " -" * 30 + " a@b.co", "a@b.co c@d.co, e@f.co write", "a@b.co"]
    got = [r.scores for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["0.65", "0.65,0.65", "0.50", "0.50", "0.50,0.65,0.65", "0.50"]


def test_very_many_spans_in_one_text(spark):
    rows = [(1, " ".join(f"u{k}@x.co" for k in range(20_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_pii(df, rows)
    assert pii.redact(df).first().text == " ".join(["<EMAIL>"] * 20_000)


def test_a_column_named_as_the_spans(spark):
    df = spark.createDataFrame([(1, "a@b.co", 5)], "doc_id long, text string, pii_spans int")
    assert tuple(pii.redact(df).first()) == (1, "<EMAIL>", 5) and pii.spans(df).columns[-1] == "_pii_spans"


# --- tokens and packing


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


CODEC = tokens.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@given(st.text(max_size=60) | st.text("ab \n'stÀ字\U0001f600", max_size=60))
@settings(max_examples=400, deadline=None)
def test_encoding_equals_the_library(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert CODEC.encode(text) == reference.encode_ordinary(text) and CODEC.decode(CODEC.encode(text)).decode() == text
    ids, raw = CODEC.round_trip(text)
    assert ids == ",".join(map(str, CODEC.encode(text))) and raw.decode() == text


@pytest.mark.parametrize("text", ["ab" * 20_000, "a" * 50_000, "abcdefghij" * 5_000, "é" * 9_999, " " * 30_000])
def test_very_long_pretokens(reference, text):
    assert CODEC.encode(text) == reference.encode_ordinary(text)


def test_bpe_odd_rows(odd, reference):
    got = sorted(map(str, tokens.digests(odd).collect()))
    want = []
    for i, t in ODD:
        ids = reference.encode_ordinary(t or "")
        want.append(f"Row(doc_id={i}, n_tokens={len(ids)}, ids_sha256='{hashlib.sha256(','.join(map(str, ids)).encode()).hexdigest()}', decoded_sha256='{hashlib.sha256((t or '').encode()).hexdigest()}')")
    assert got == sorted(want)
    whole = {r.doc_id: r for r in tokens.encode(odd).collect()}
    assert whole[1].ids is None and whole[2].ids == [] and bytes(whole[4].decoded) == b"word" and tokens.digests(odd.limit(0)).count() == 0


def check_packing(rows, pieces, window=2048):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows)
    sizes, at = {}, {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sizes.get(r.sequence_id, 0) and r.length > 0
        sizes[r.sequence_id] = r.offset + r.length
        at.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert max(sizes.values(), default=0) <= window
    for (i, t), n in want.items():
        have = sorted(at[(i, len(t) // 4)], key=lambda r: r.start)
        covered = Counter(p for r in have for p in range(r.start, r.start + r.length))
        assert set(covered.values()) == {n} and len(covered) == len(t) // 4
        assert all(zlib.crc32(t[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in have)
    assert sum(sizes.values()) == sum(len(t) // 4 * n for (_, t), n in want.items())
    return sizes


def test_packing_is_a_round_trip_with_little_padding(docs):
    sizes = check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pieces(docs).collect())
    assert sum(s < 2048 for s in sizes.values()) <= 1


def test_packing_odd_rows(odd):
    check_packing(ODD, packing.pieces(odd).collect())
    assert packing.pieces(odd.limit(0)).count() == 0


END = "<|endoftext|>"
#: The added token at the start, in the middle, at the end, doubled, within words, between blanks, and nearly.
SPECIAL = [END, f"{END} after", f"before {END} after", f"before {END}", f"a{END}{END}b", f"wo{END}rd", f"two  {END}  blanks \n{END}\n", "<|endoftext|", "<|endof<|endoftext|>text|>", "<|ENDOFTEXT|>"]


def test_added_tokens_are_what_the_library_makes_of_them(spark):
    rows = list(enumerate(SPECIAL))
    pieces = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_packing(rows, pieces)
    assert sum(r.length for r in pieces if r.doc_id == 0) == 2


@given(st.lists(st.sampled_from([END, "<|", "endoftext", "|>", " ", "  ", "\n", "a", "'s", "7", "é", "\U0001f600"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_packed_ids_equal_the_library(text):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder("byte_bpe_50k.json").encode(text, allowed_special="all") == lib.encode(text, add_special_tokens=False).ids


def test_packing_over_many_shards_and_partitions(spark, docs, monkeypatch):
    """Shards smaller than a partition, several partitions, one id for a third of all rows."""
    rows = [(1 if k % 3 == 0 else r.doc_id, r.text) for k, r in enumerate(docs.collect())]
    monkeypatch.setattr(packing, "SHARD_CHARS", 20_000)
    got = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in got) == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    sizes = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sizes.get(r.sequence_id, 0)
        sizes[r.sequence_id] = r.offset + r.length
    assert max(sizes.values()) <= 2048 and len({s >> 40 for s in sizes}) == 5


@given(st.lists(st.integers(1, 200), max_size=60))
@settings(max_examples=100, deadline=None)
def test_plan_uses_each_token_once(lengths):
    seen, ends = set(), Counter()
    for d, start, n, seq, at in packing.plan(np.array(lengths, np.int64), 64):
        for k in range(n):
            assert (d, start + k) not in seen
            seen.add((d, start + k))
        ends[seq] = max(ends[seq], at + n)
    assert len(seen) == sum(lengths) and sum(v < 64 for v in ends.values()) <= 1 and max(ends.values(), default=0) <= 64


def test_least_squares_fits_the_histogram():
    hist = np.zeros(64, int)
    hist[[10, 54, 20, 24]] = [5, 5, 8, 4]
    combos = packing.combinations(hist)
    x = packing.repeats(hist, combos, 2000)
    fit = np.bincount(combos.ravel(), np.repeat(x, 3), 64)
    fit[0] = 0
    assert (x >= 0).all() and np.abs(fit - hist).max() < 0.05


# --- classifiers


def test_language_held_out(docs):
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def plain_buckets(text):
    """Buckets of all 1- to 3-grams of a text, from Python's own integers; two blanks follow a text."""
    m, low, size = 0x9E3779B1, 0xFFFFFFFF, language.BUCKETS
    codes, out = [ord(c) for c in text.lower()] + [32, 32], []
    for k in range(len(codes) - 2):
        h = codes[k] * m & low
        for order, odd in enumerate((None, 0x85EBCA77, 0xC2B2AE3D)):
            if odd:
                h = (h ^ (codes[k + order] * odd & low)) * m & low
            out.append(order * size + (h * size >> 32))
    return out


def test_language_scores_equal_plain_sums(monkeypatch):
    rng = np.random.default_rng(0)
    logs = rng.normal(size=(language.BUCKETS * 3, 37)).astype(np.float32)
    texts = ["abc", "", "Ä\U0001f600 b", "x" * 500, "Ünter den Linden"]
    monkeypatch.setattr(language, "SLICE", 64)
    for t, s in zip(texts, language.scores(texts, logs)):
        want = logs[plain_buckets(t)].astype(float).sum(0) if t else np.zeros(37)
        assert np.allclose(s, want, rtol=1e-4, atol=1e-4)


def test_language_model_equals_plain_counts(spark, docs, monkeypatch):
    """Labels and posteriors from counts in a plain loop; shares are of all rows, though only 40 a language are learned from."""
    few = docs.filter("doc_id < 150 and length(text) < 3000")
    rows = few.collect()
    for passes in (256, 1):
        monkeypatch.setattr(language, "PASS_LANGUAGES", passes)
        model = language.learn(few, rows=10**6)
        got = {r.doc_id: r for r in language.annotate(few, model).collect()}
        counts, share = {}, Counter(r.lang for r in rows)
        for r in rows:
            counts.setdefault(r.lang, Counter()).update(plain_buckets(r.text))
        logs = {}
        for lang, c in counts.items():
            full = np.array([c[k] + language.SMOOTH for k in range(3 * language.BUCKETS)]).reshape(3, -1)
            logs[lang] = np.log(full / full.sum(1, keepdims=True)).ravel()
        for r in rows[::7]:
            s = {lang: logs[lang][plain_buckets(r.text)].sum() + np.log(share[lang] / len(rows)) for lang in logs}
            best = min(s, key=lambda x: (-s[x], x))
            assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(1 / sum(np.exp(v - s[best]) for v in s.values()), abs=1e-2)
    small = language.learn(few, rows=5)
    assert {r.lang: r.n for r in small.collect()} == share


def test_many_languages_are_all_learned(spark):
    """300 languages, each with letters of its own; in two passes."""
    rows = [(1000 * k + j, "".join(chr(0x4E00 + 7 * k + x) for x in (j % 7, 3, 5)) * 3, f"l{k:03}") for k in range(300) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    assert model.count() == 300
    got = {r.doc_id: r for r in language.annotate(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang in rows)


def test_signs_that_are_no_letters(spark, docs):
    signs = ["²", "½", "Ⅷ", "①", "12 ٣", "_ - !", "\U0001f600", "ª", "ß", "中", "ʰ"]
    df = spark.createDataFrame(list(enumerate(signs)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.annotate(df, language.learn(docs.filter("doc_id < 60"))).collect()}
    assert [got[k] == "und" for k in range(len(signs))] == [True] * 7 + [False] * 4


def test_repeated_rows_are_learned_from_once(spark):
    """A thousand copies of one row among 30 others: a sample of 20 still has 20 different rows."""
    rows = [(1, "copy of a text", "aa")] * 1000 + [(2 + k, f"text number {k}", "aa") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = language.learn(df, rows=20)
    assert [(r.lang, r.n) for r in seen.collect()] == [("aa", 1030)]


def test_language_odd_rows(odd, docs):
    got = language.identify(odd).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got} == {"und"} and {r.score for r in got} == {0.0}  # nothing to learn from
    model = language.learn(docs.filter("doc_id < 60"))
    some = {r.doc_id: r for r in language.annotate(odd, model).collect()}
    assert some[1].lang_pred == some[2].lang_pred == some[3].lang_pred == "und" and some[4].lang_pred != "und" and some[4].block == 7
    assert language.identify(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, label, odd):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = module.learn(docs, labels)
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % module.MODULUS == module.HELD_OUT]
    hit = np.mean([(got[r.doc_id] >= 0.3) == r[label] for r in held])
    assert hit > 0.9 and len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    scored = module.score(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    none = module.learn(docs, labels.limit(0))
    assert [r.score for r in module.score(odd, none).collect()] == pytest.approx([0.5] * len(ODD))
    one = module.learn(docs, labels.withColumn(label, F.lit(None).cast("int")))
    assert module.score(odd.limit(0), one).count() == 0


def test_classifiers_never_learn_from_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(200)], "doc_id long, text string, y string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"), F.lit("z").alias("text")).union(docs.limit(3).select("doc_id", F.lit(0), F.lit("z")))
    got = labelled.labelled(docs, labels, "toxic", 4, 2, 50).collect()
    assert len(got) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.y == 1 for r in got)


def test_an_id_on_very_many_rows_is_learned_from_once(spark):
    docs = spark.createDataFrame([(7 if k % 3 else 100 + k, f"text {k}") for k in range(3000)], "doc_id int, text string").repartition(3)
    labels = docs.select("doc_id", F.lit(1).alias("toxic")).distinct()
    got = labelled.labelled(docs, labels, "toxic", 1, 5, 50).collect()
    assert len(got) == 50 == len({r.doc_id for r in got})


@pytest.fixture(scope="module")
def big(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def test_quality_scores_equal_a_plain_walk_of_the_tables(spark, big, odd):
    """Each feature's bin by counting edges, each table entry added one by one."""
    model = quality.learn(*big)
    for frame in (big[0].filter("doc_id < 60"), odd):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        want = []
        for i, t in rows:
            x, total = quality.features(t or ""), model.base
            for f, value in enumerate(x):
                total += model.tables[f][sum(e <= value for e in model.edges[f].tolist())]
            for k, (a, b) in enumerate(model.pairs):
                total += model.pair_tables[k][sum(e <= x[a] for e in model.coarse[a].tolist())][sum(e <= x[b] for e in model.coarse[b].tolist())]
            want.append((str(i), round(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), 9)))
        assert sorted((str(r.doc_id), round(r.score, 9)) for r in quality.score(frame, model).collect()) == sorted(want)


def test_quality_features_equal_plain_counts():
    text = "Two words here,\nTwo  lines | ok! 42\n\n"
    x = dict(zip(quality.FEATURES, quality.features(text)))
    raw = text.encode()
    assert x["log_bytes"] == pytest.approx(math.log1p(len(raw))) and x["digit"] == pytest.approx(2 / len(raw)) and x["upper"] == pytest.approx(2 / len(raw))
    assert x["newlines"] == pytest.approx(3 / len(raw)) and x["bars"] == pytest.approx(1 / len(text.split())) and x["top_word"] == pytest.approx(2 / len(text.split()))
    assert x["word_bytes"] == pytest.approx(np.mean([len(w) for w in raw.split()]))


def test_boosting_steps_equal_a_plain_search():
    """The best cut of a tree of depth 1, and the best cross of two cuts, against all of them in a loop."""
    rng = np.random.default_rng(3)
    damp = quality.DAMP
    gain = lambda g, h: g * g / (h + damp)
    for _ in range(20):
        g, h, n = rng.normal(size=12), rng.random(12) + 0.1, rng.integers(8, 30, 12)
        best = max(range(1, 12), key=lambda k: gain(g[:k].sum(), h[:k].sum()) + gain(g[k:].sum(), h[k:].sum()))
        want = [g[:best].sum() / (h[:best].sum() + damp)] * best + [g[best:].sum() / (h[best:].sum() + damp)] * (12 - best)
        if min(n[:best].sum(), n[best:].sum()) >= quality.LEAF_ROWS:
            assert np.allclose(quality._tree(g, h, n, 1), want)
        g, h, n = rng.normal(size=(6, 6)), rng.random((6, 6)) + 0.1, rng.integers(8, 30, (6, 6))
        cells = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 6)), (slice(i, 6), slice(0, j)), (slice(i, 6), slice(j, 6))]
        i, j = max(((i, j) for i in range(1, 6) for j in range(1, 6)), key=lambda c: sum(gain(g[q].sum(), h[q].sum()) for q in cells(*c)))
        out = np.empty((6, 6))
        for q in cells(i, j):
            out[q] = g[q].sum() / (h[q].sum() + damp)
        assert np.allclose(quality._cross(g, h, n)[1], out)


def test_toxicity_scores_equal_a_plain_sum_over_pairs(spark, big, odd):
    """Bias, weights, and the inner product of each pair of a text's terms, in a loop."""
    model = toxicity.learn(*big)
    at = {int(b): k for k, b in enumerate(model.buckets)}
    for frame in (big[0].filter("doc_id < 40"), odd):
        want = []
        for r in frame.collect():
            found = set()
            for w in (r.text or "").lower().encode().split():
                w = w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
                for part in [w, *(w[:k] + b"*" for k in (4, 5, 6, 7, 8) if len(w) >= k)] if w else []:
                    if (b := xxhash.xxh3_64_intdigest(part) % (1 << 20)) in at:
                        found.add(at[b])
            terms = sorted(found)
            z = model.bias + sum(model.weights[k] for k in terms)
            for a in range(len(terms)):
                for b in range(a):
                    z += float(model.factors[terms[a]] @ model.factors[terms[b]])
            want.append((str(r.doc_id), round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 8)))
        assert sorted((str(r.doc_id), round(r.score, 8)) for r in toxicity.score(frame, model).collect()) == sorted(want)


def test_memory_of_pretokens_is_bounded_in_bytes():
    known = tokens.Remembered(lambda w: (w * 3, w.encode()), most=40_000)
    for k in range(5000):
        known[f"word{k % 700}" if k % 2 else f"other{k}"]
        known["x" * 5000 + str(k)]
        assert sum(tokens.ENTRY + 5 * len(w) for w in [*known, *known.old]) <= 2 * 40_000 + 2000 and max(map(len, known)) <= tokens.LONGEST
    assert known["word1"] == ("word1" * 3, b"word1")


def test_factors_learn_what_weights_cannot():
    """Label 1 only where both terms occur: pairwise products find it."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted({*([11] if a else []), *([22] if b else []), 1000 + int(rng.integers(500))}), np.int32))
        y.append(float(a and b))
    m = toxicity.fit(rows, np.array(y))
    at = {int(b): k for k, b in enumerate(m.buckets)}
    z = lambda *t: float(m.raw(np.array([at[x] for x in t]), np.array([len(t)]))[0])
    assert z(11, 22) > 1 and z(11) < -1 and z(22) < -1 and m.factors[at[11]] @ m.factors[at[22]] > 0.5


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95 and tuple(sorted(m.pairs[0])) == (0, 1)
