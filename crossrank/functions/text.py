"""Column expressions that normalise reports and find words that give a label away."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossrank.functions.vectors import bind

#: White space by Unicode, with the four separators that Python also strips; spelled out, as engines differ.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters one by one.
SPACES = "".join(filter(str.isspace, map(chr, range(0x3001))))
#: Least length of a useful text, of a useful rewrite, of a dynamic term; terms named in a retry.
USEFUL_CHARS, REWRITE_CHARS, TERM_CHARS, RETRY_TERMS = 15, 20, 4, 20

#: Patterns that must not match (case does not count), in the order in which hits are reported.
STATIC_PATTERNS = (
    # entities
    r"\bcarcinoma\b", r"\badenocarcinoma\b", r"\bsarcoma\b", r"\blymphoma\b", r"\bmelanoma\b", r"\bglioma\b",
    r"\bglioblastoma\b", r"\bastrocytoma\b", r"\boligodendroglioma\b", r"\bependymoma\b", r"\bmedulloblastoma\b",
    r"\bmesothelioma\b", r"\bthymoma\b", r"\bseminoma\b", r"\bchordoma\b", r"\bmeningioma\b", r"\bschwannoma\b",
    r"\bneurofibroma\b", r"\bpheochromocytoma\b", r"\bparaganglioma\b", r"\bteratoma\b", r"\bgerm cell (tumor|neoplasia)\b",
    # origin
    r"\bmetastasis\b", r"\bmetastatic\b", r"\bsecondary\b", r"\bprimary tumor\b", r"\bsite of origin\b",
    # interpretation
    r"\bcompatible with\b", r"\bconsistent with\b", r"\bsuggestive of\b", r"\bin keeping with\b", r"\bfavor(s|ing)?\b",
    r"\bdiagnostic of\b",
    # talk about the rewriting
    r"\bdiagnostic leakage\b", r"\bmust be omitted\b", r"\bhas been (removed|omitted)\b", r"\bthese instructions\b",
    r"\bto (avoid|prevent) (revealing|disclosing|leaking)\b",
    # grade
    r"\bwho grade\b", r"\bgleason\b", r"\bgrade\s*[ivx1-4]+\b", r"\bhigh[\s-]grade\b", r"\blow[\s-]grade\b",
    # stage
    r"\bp[tnm][0-4x]\b", r"\bstage [i1]+[iv]*\b", r"\btnm\b", r"\bconfined to\b",
    # margins and extent
    r"\bmargin(s)?\b", r"\bresection margin\b", r"\bsurgical margin\b", r"\bentire specimen\b", r"\bwhole specimen\b",
    r"\bentire sample\b",
    # markers
    r"\bimmunohistochem\w*\b", r"\bmolecular\b", r"\bmutation\b", r"\bamplification\b", r"\btranslocation\b",
    r"\breceptor status\b", r"\bher2\b", r"\ber\b(?!\w)", r"\bpr\b(?!\w)", r"\bki[\s-]?67\b", r"\bmib[\s-]?1\b", r"\bpten\b",
    r"\begfr\b", r"\bp53\b", r"\bp63\b", r"\bvimentin\b", r"\bck\s*7\b", r"\bck\s*20\b", r"\bttf[\s-]?1\b", r"\bcdx2\b",
    r"\bgata3\b", r"\bpax8\b", r"\bs100\b", r"\bmelan[\s-]?a\b", r"\bcd\d{1,3}\b", r"\bsynaptophysin\b", r"\bchromogranin\b",
    r"\bdesmin\b", r"\bcalretinin\b", r"\bhbme1?\b",
    # the specimen to the naked eye
    r"\b\d+(\.\d+)?\s*(cm|mm)\b", r"\bfleshy\b", r"\brubbery\b", r"\bfriable\b", r"\bspongy\b", r"\bgritty\b", r"\bfirm\b",
    r"\bcut surface(s)?\b", r"\bgross\b",
)

#: Words of the metadata that give nothing away.
STOPWORDS = (
    "gland", "glands", "tissue", "site", "type", "cell", "cells", "duct", "ducts", "nos", "other", "unclassified",
    "specified", "otherwise", "not", "and", "with", "invasive", "high", "low", "grade", "spindle", "pleomorphic",
    "pleomorphism", "clear", "giant", "small", "large", "papillary", "serous", "mucinous", "soft", "subcutaneous",
    "malignant", "nerve",
)


def _strip(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACES))


#: What becomes one blank: any run of white space, and a lone tab or line end. Other lone white space stays, as does a
#: lone blank, which most are; so one pass matches little. Signs of ASCII are ruled out first, by a test of one range.
BLANKED = f"(?![!-~])(?:{SPACE}{{2,}}|[\\t\\r\\n])"


def one_paragraph(s: Column) -> Column:
    """One line with single blanks; empty for null."""
    return _strip(F.regexp_replace(F.coalesce(s.cast("string"), F.lit("")), BLANKED, " "))


def ensure_period(s: Column) -> Column:
    """Stripped, with a full stop unless it ends a sentence already; an empty text stays empty."""
    s = _strip(F.coalesce(s, F.lit("")))
    return F.when((s == "") | F.right(s, F.lit(1)).isin(".", "!", "?"), s).otherwise(F.concat(s, F.lit(".")))


def retry_seconds(message: Column) -> Column:
    """Seconds named by a rate-limit message; null without any."""
    return F.regexp_extract(message, r"(?i)try again in (\d+)s", 1).try_cast("int")


def useful(s: Column) -> Column:
    return s.isNotNull() & (F.length(one_paragraph(s)) >= USEFUL_CHARS)


def dynamic_terms(*metadata: Column) -> Column:
    """Sorted distinct words of a row's metadata that its text must not hold (as beginnings of words)."""
    words = F.concat(*[F.transform(F.split(F.coalesce(c, F.lit("")), "[^A-Za-z]+"), F.lower) for c in metadata])
    kept = F.filter(F.array_distinct(words), lambda w: F.length(w) >= TERM_CHARS)
    return F.array_sort(F.array_except(kept, F.array(*map(F.lit, STOPWORDS))))


#: Characters that match an ASCII letter when case does not count, and these letters.
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")


def literal(pattern: str) -> str:
    """The longest plain text that every match of a static pattern holds, whatever its case."""
    plain = re.sub(r"\([^()]*\)[?*+]?|\[[^\]]*\][?*+]?|\\\w(\{[^}]*\}|[?*+])?", "\0", pattern)
    return max(re.sub(r".[?*]", "\0", plain).split("\0"), key=len)


def _searched(pattern: str) -> str:
    """A static pattern for lower-case, folded texts. Its first letter is looked for before the border in front of it,
    which costs far more a character."""
    first = re.match(r"\\b([a-z])", pattern)
    return f"(?U)(?={first[1]}){pattern}" if first else f"(?U){pattern}"


def _folded(text: Column) -> Column:
    """Lower case, with ``FOLDED`` replaced; each is absent from most texts, so a search for it costs less than a mapping."""
    for letter, plain in zip(*FOLDED, strict=True):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def _static(low: Column) -> Column:
    hit = lambda p: F.when(low.contains(literal(p)) & low.rlike(_searched(p)), F.lit(p))
    return F.array_compact(F.array(*map(hit, STATIC_PATTERNS)))


def _dynamic(low: Column, terms: Column) -> Column:
    begins = lambda t: low.contains(t) & F.regexp_like(low, F.concat(F.lit(r"(?U)\b"), t))
    return F.filter(terms, lambda t: begins(_folded(t)))


def static_hits(text: Column) -> Column:
    """Static patterns that match, in their order; a pattern is tried where its plain part occurs."""
    return bind(_folded(F.coalesce(text, F.lit(""))), _static)


def dynamic_hits(text: Column, terms: Column) -> Column:
    """Terms that begin a word of the text, in their order; a term is tried where it occurs at all."""
    return bind(_folded(F.coalesce(text, F.lit(""))), lambda low: _dynamic(low, terms))


def leakage(text: Column, terms: Column) -> Column:
    """All that a text gives away: static patterns, then the row's own terms. The text is made and folded once."""
    return bind(_folded(F.coalesce(text, F.lit(""))), lambda low: F.concat(_static(low), _dynamic(low, terms)))


#: The instructions that a rewriter gets; a caller may pass others.
INSTRUCTIONS = (
    "Summarise only the microscopic morphology that the source states, in one paragraph of fluent prose. "
    "Leave out diagnoses, origin, grade, stage, margins, markers and gross findings. Invent nothing."
)


def retry_prompt(matched: Column, instructions: str = INSTRUCTIONS) -> Column:
    """The instructions with the terms that leaked: distinct, sorted, at most ``RETRY_TERMS``."""
    listed = F.array_join(F.slice(F.array_sort(F.array_distinct(matched)), 1, RETRY_TERMS), ", ")
    return F.concat(F.lit(instructions + "\nThe last answer still gave away: "), listed, F.lit(".\nLeave these out, even if the summary gets shorter."))


def payload(source: Column) -> Column:
    return F.concat(F.lit("Rewrite this report as morphology only.\nSOURCE:\n"), one_paragraph(source), F.lit("\n"))
