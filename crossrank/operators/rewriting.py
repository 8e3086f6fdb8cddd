"""Rewriting of reports by an outside service, with checks for leaks and retries.

The service is a ``Rewriter``: anything that takes instructions and a payload and gives back the reply's JSON text.
It runs on the executors, a report at a time, inside ``mapInPandas``; the checks are those of ``functions.text``.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.functions.text import FOLDED, INSTRUCTIONS, RETRY_TERMS, REWRITE_CHARS, STATIC_PATTERNS, dynamic_terms, leakage, literal, one_paragraph, payload
from crossrank.operators.cohort import REWRITE, SOURCE

Rewriter = Callable[[str, str], str]
AUDIT = (
    "slide_id {}, case_id string, project_id string, original_slide_reports string, removed_terms array<string>, "
    "excluded_insufficient_source boolean, rewritten_text string, leakage_flag_after_retries boolean, "
    "remaining_matched_terms array<string>, attempts_used int"
)
#: Fields of a reply.
REPLY = f"has_sufficient_morphology boolean, {REWRITE} string"
#: Seconds to wait after a rate limit that names none, beyond a named time, and after other failures.
RATE_WAIT, RATE_EXTRA, OTHER_WAIT = 30, 2, 10


class RateLimited(Exception):
    """The service asks to wait; its message may name seconds."""


def stub(instructions: str, text: str) -> str:
    """An offline rewriter, for tests: the first time it repeats the source, on a retry it drops the named terms."""
    source = text.partition("SOURCE:\n")[2].strip()
    named = instructions.partition("gave away: ")[2].partition(".\n")[0]
    for term in filter(None, named.split(", ")):
        source = re.sub(term if "\\" in term else rf"\b{re.escape(term)}\w*\b", " ", source, flags=re.I)
    return json.dumps({"has_sufficient_morphology": len(source) >= 60, REWRITE: source})


def with_backoff(call: Rewriter, tries: int | None = None, sleep: Callable[[float], None] = time.sleep) -> Rewriter:
    """Waits and calls again after failures, for as long as it takes, or ``tries`` times before the failure goes on."""

    def run(instructions: str, text: str) -> str:
        made = 0
        while True:
            try:
                return call(instructions, text)
            except (RateLimited, TimeoutError, ConnectionError) as e:
                made += 1
                if made == tries:
                    raise
                named = re.search(r"try again in (\d+)s", str(e), re.I) if isinstance(e, RateLimited) else None
                sleep(int(named[1]) + RATE_EXTRA if named else RATE_WAIT if isinstance(e, RateLimited) else OTHER_WAIT)

    return run


def load(name: str) -> Rewriter:
    """The rewriter named ``module:function``; the module must be importable on the executors."""
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"{name!r}: expected module:function")
    return getattr(importlib.import_module(module), function)


_SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


_BLANKED = re.compile(f"[{_SPACE}]{{2,}}|[\t\r\n]")


def _line(s: str) -> str:
    return _BLANKED.sub(" ", s or "").strip()


def _sentence(s: str) -> str:
    s = s.strip()
    return s if not s or s[-1] in ".!?" else s + "."


_FOLD = str.maketrans(*FOLDED)


def _leaks(text: str, terms: list[str], patterns: list[tuple[str, re.Pattern]]) -> list[str]:
    low = text.translate(_FOLD).lower()
    hit = [p.pattern for plain, p in patterns if plain in low and p.search(low)]
    return hit + [t for t in terms if t in low and re.search(rf"\b{re.escape(t)}", low)]


def rewrite(reports: DataFrame, rewriter: Rewriter = stub, attempts: int = 3, instructions: str = INSTRUCTIONS) -> DataFrame:
    """An audit record for each report: at most ``attempts`` rewrites, until one gives nothing away.

    A reply that calls the source insufficient, or that is too short, excludes the report.
    """
    terms = dynamic_terms(F.col("cancer_type_detailed"), F.col("site_of_resection_or_biopsy"))
    ready = reports.withColumn("_terms", terms)
    ready = ready.withColumn("removed_terms", F.array_sort(F.array_distinct(leakage(one_paragraph(F.col(SOURCE)), F.col("_terms")))))
    ready = ready.select("slide_id", F.col("case_id").cast("string"), F.col("project_id").cast("string"), F.col(SOURCE).alias("original_slide_reports"), "removed_terms", "_terms", payload(F.col(SOURCE)).alias("_payload"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = [(literal(p), re.compile(p)) for p in STATIC_PATTERNS]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                text, hits, own = "", [], list(row[5])
                for turn in range(1, attempts + 1):
                    ask = instructions
                    if turn > 1:
                        ask += "\nThe last answer still gave away: " + ", ".join(sorted(set(hits))[:RETRY_TERMS]) + ".\nLeave these out, even if the summary gets shorter."
                    reply = json.loads(rewriter(ask, row[6]))
                    text = _sentence(_line(reply.get(REWRITE) or ""))
                    enough = bool(reply.get("has_sufficient_morphology")) and len(text) >= REWRITE_CHARS
                    hits = _leaks(text, own, patterns) if enough else []
                    if not enough or not hits:
                        break
                out.append((*row[:5], not enough, text if enough else "", bool(hits), sorted(set(hits)), turn))
            yield pd.DataFrame(out, columns=["slide_id", "case_id", "project_id", "original_slide_reports", "removed_terms", "excluded_insufficient_source", "rewritten_text", "leakage_flag_after_retries", "remaining_matched_terms", "attempts_used"])

    return ready.mapInPandas(run, AUDIT.format(reports.schema["slide_id"].dataType.simpleString()))


def parsed_reply(reply):
    """A reply's fields from its JSON text (null where it does not fit)."""
    return F.from_json(reply, REPLY)
