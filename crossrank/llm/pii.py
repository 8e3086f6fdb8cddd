"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

DataFrame functions only. For each kind the text is split at the pattern's matches; running sums of the lengths of
gaps and matches give every span's place in code points. Sums double their stride in each round, so n spans take n log n
steps and no list is copied for each span. Masking cuts the text into pieces of equal length first, so that no span
is sought from the start of the text. Context words count on both sides of a span: within ``CONTEXT_CHARS`` of it, as
far as the match of the same kind after the next one.

Cases: a null text counts as empty; a text without spans gives zero counts and empty strings; a row with
a null id is kept; repeated rows each give a row; of extra columns only id and text are read. Of spans that start
together the kind listed first comes first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.llm.common import fresh, table

#: The four base kinds in the order in which equal starts are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
#: The kinds this method adds.
ADDED_KINDS = ("iban",)
KINDS = BASE_KINDS + ADDED_KINDS

_LOCAL = "[A-Za-z0-9._%+-]"
#: Each pattern finds what the plain base pattern finds. Possessive runs and the guard in front (a run is
#: tried from its first character or from the end of the last match) keep the search linear in long runs.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: Words near a span that make its kind likelier.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)",
    "ip": r"(?i)\b(?:ip|host|server|address)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment)",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax)",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)",
}
#: Score of a span whose pattern alone speaks for it, and what a checksum and a context word add.
PATTERN_SCORE, CHECK_SCORE, CONTEXT_SCORE = 0.5, 0.35, 0.15
#: Characters before and after a span in which context words count; characters of a piece of text.
CONTEXT_CHARS, PIECE = 40, 1024


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    odd = F.transform(
        _chars(F.reverse(digits)),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")),
    )
    return F.aggregate(odd, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether a bank number (letters and digits) leaves 1 modulo 97, its first four characters moved to its end."""
    turned = F.concat(F.substring(iban, 5, 1000), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(_chars(turned), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("00"), p), F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


def _worth(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike({"ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "iban": "[A-Z]{2}[0-9]{2}"}[kind])


_SPAN = "array<struct<start:int,ord:int,kind:string,end:int,score:double>>"


def _once(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of the values, each of which is computed once a row."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What ``add`` makes of each value and all before it; ``values`` should be a field or variable."""
    strides = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(values))
    return F.aggregate(strides, values, lambda acc, s: F.transform(acc, lambda x, i: F.when(i >= s, add(x, F.get(acc, i - s))).otherwise(x)))


def _from(a: Column, k: int) -> Column:
    """An array without its first ``k`` elements."""
    return F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))


def find(kind: str, text: Column) -> Column:
    """Spans of one kind: ``array<struct<start,ord,kind,end,score>>``."""
    checked = CHECK_SCORE if kind in ("ip", "card", "phone", "iban") else 0.0
    near = F.lit(CONTEXT_CHARS)

    def span(p: Column) -> Column:
        before = F.right(F.concat_ws("", F.right(p["gap0"], near), F.right(p["hit0"], near), F.right(p["gap"], near)), near)
        after = F.left(F.concat_ws("", F.left(p["gap1"], near), F.left(p["hit1"], near), F.left(p["gap2"], near)), near)
        score = F.lit(PATTERN_SCORE + checked) + F.when(before.rlike(CONTEXT[kind]) | after.rlike(CONTEXT[kind]), CONTEXT_SCORE).otherwise(0.0)
        start = p["end"] - F.length(p["hit"])
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), p["end"].alias("end"), score.alias("score"))
        return F.when(p["hit"].isNotNull() & _valid(kind, p["hit"]), one)

    def placed(r: Column) -> Column:
        none = F.array(F.lit(""))
        gaps, hits = r["gaps"], r["hits"]
        around = {"gap": gaps, "hit": hits, "end": _running(r["sizes"], lambda a, b: a + b), "gap0": F.concat(none, gaps), "hit0": F.concat(none, hits), "gap1": _from(gaps, 1), "hit1": _from(hits, 1), "gap2": _from(gaps, 2)}
        return F.filter(F.transform(F.arrays_zip(*[c.alias(k) for k, c in around.items()]), span), lambda s: s.isNotNull())

    def sized(r: Column) -> Column:
        sizes = F.zip_with(r["gaps"], r["hits"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
        return _once(placed, gaps=r["gaps"], hits=r["hits"], sizes=sizes)

    found = _once(sized, gaps=F.split(text, PATTERNS[kind], -1), hits=F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)))
    return F.when(_worth(kind, text), found).otherwise(F.array()).cast(_SPAN)


def _listed(spans: Column) -> Column:
    """Spans by start, then by kind as listed: ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(df: DataFrame, text_col: str = "text", to: str = "pii_spans") -> DataFrame:
    """``df`` with all spans of all kinds, sorted, in a last column ``to``, under another name if that is taken."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumn(fresh(df, to), F.array_sort(F.concat(*[find(k, text) for k in KINDS])))


def _masked(text: Column, found: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by its first kind in angle brackets."""

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """Characters ``a`` to ``b`` of the text."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        across = F.concat(piece(first).substr(a % PIECE + 1, F.lit(PIECE)), inner, piece(last).substr(F.lit(1), b % PIECE))
        return F.when(first == last, piece(first).substr(a % PIECE + 1, b - a)).otherwise(across)

    def join(r: Column) -> Column:
        """``heads``: spans that begin a stretch, with the end of all before them."""
        heads, pieces = r["heads"], r["pieces"]
        mask = lambda h: F.concat(cut(pieces, h["upto"], h["start"]), F.lit("<"), F.upper(h["kind"]), F.lit(">"))
        return F.concat(F.array_join(F.transform(heads, mask), ""), cut(pieces, r["last"], r["length"]))

    def stretches(r: Column) -> Column:
        upto = F.concat(F.array(F.lit(0)), r["reach"])
        each = F.arrays_zip(r["start"].alias("start"), r["kind"].alias("kind"), F.slice(upto, 1, F.size(r["start"])).alias("upto"))
        heads = F.filter(each, lambda s: s["start"] >= s["upto"])
        return _once(join, heads=heads, last=F.element_at(r["reach"], -1), pieces=r["pieces"], length=r["length"])

    def reached(r: Column) -> Column:
        return _once(stretches, reach=_running(r["end"], F.greatest), start=r["start"], kind=r["kind"], pieces=r["pieces"], length=r["length"])

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    field = lambda k: F.transform(found, lambda s: s[k])
    return _once(reached, start=field("start"), end=field("end"), kind=field("kind"), pieces=pieces, length=F.length(text))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with each stretch of overlapping spans replaced by its first kind in angle brackets.

    A null text stays null.
    """
    marked = spans(df, text_col)
    own = marked.columns[-1]
    return marked.withColumn(text_col, F.when(F.size(own) > 0, _masked(F.col(text_col), F.col(own))).otherwise(F.col(text_col))).select(*[F.col(f"`{c}`") for c in df.columns])


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, a digest of the base spans, all spans, and the scores in the order of the spans."""
    found = spans(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "s").drop("text")
    base = F.filter("s", lambda x: x["ord"] < len(BASE_KINDS))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("s")).alias("spans"),
        F.array_join(F.transform("s", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
