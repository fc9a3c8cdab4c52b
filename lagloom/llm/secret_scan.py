"""Secrets in documents: all rules compiled into one minimal automaton that
reads every byte of a text once. Only texts in which it accepts are looked at
again, rule by rule, for the exact spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from lagloom.llm.automaton import Dfa
from lagloom.llm.shared import with_replaced


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and longest, do not overlap; those whose
    `tail` (the part after the last match of `lead`) is shorter than `least`
    are dropped, though what they cover is used up."""

    kind: str
    pattern: str
    either_case: bool = False
    lead: str = ""
    least: int = 0


# The base kinds. The long hexadecimal run is asked for in the
# pattern, since every such digit would be a match otherwise; a match takes the
# whole run, so this finds the same spans as a filter by length.
_LEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", _LEAD + r"[A-Za-z0-9+/_.=-]+", True, _LEAD, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Published shapes of other credentials. Tails are left open and
# filtered by length: counted repeats multiply the automaton's states.
# A key block goes on over its headers and base64 lines (also with breaks written
# as backslash and letter) to the END line; without one, to the end of the base64.
_PEM = (
    r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----"
    r"(\x0d?\x0a([A-Z][A-Za-z-]*:\x20[A-Za-z0-9,-]+\x0d?\x0a)+)?"
    r"[A-Za-z0-9+/=\x0a\x0d\x5c]*(\x20*-----END ([A-Z]+ )?PRIVATE KEY-----)?"
)
MORE = (
    Rule("github", r"gh[opusr]_[A-Za-z0-9]+", lead=r"gh[opusr]_", least=20),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", lead=r"xox[abprs]-", least=10),
    Rule("pem", _PEM),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        shapes = [(r.pattern, r.either_case) for r in rules]
        self.all = Dfa(shapes, search=True)
        self.search = [Dfa([s], search=True) for s in shapes]
        self.exact = [Dfa([s], search=False) for s in shapes]
        self.lead = [Dfa([(r.lead, r.either_case)], search=False) if r.lead else None for r in rules]

    def seen(self, data: bytes) -> list[int]:
        """Rules that match somewhere, after one pass over the bytes."""
        table, accepting, s = self.all.table, self.all.accepting, self.all.start
        states = set()
        for b in data:
            s = table[s + b]
            if s < accepting:
                states.add(s)
        return sorted({r for s in states for r in self.all.rules[s]})

    def _spans(self, rule: int, data: bytes) -> list[tuple[int, int]]:
        """Leftmost, longest, not overlapping matches of one rule, in bytes."""
        search, exact, lead = self.search[rule], self.exact[rule], self.lead[rule]
        table, accepting, start = search.table, search.accepting, search.start
        out = []
        s, clear, i, n = start, 0, 0, len(data)
        while i < n:
            s = table[s + data[i]]
            i += 1
            if s == start:
                # No match is under way: the next one begins here or later.
                clear = i
            elif s < accepting:
                begin = clear
                while (end := exact.longest(data, begin)) < 0:
                    begin += 1
                tail = end - (lead.longest(data, begin) if lead else begin)
                if tail >= self.rules[rule].least:
                    out.append((begin, end))
                s, i, clear = start, max(end, i), max(end, i)
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, ordered; null has none."""
        data = (text or "").encode("utf-8", "surrogatepass")
        hits = self.seen(data)
        if not hits:
            return []
        found = [(a, r, b) for r in hits for a, b in self._spans(r, data)]
        if len(data) != len(text):

            # Code points up to each byte: all bytes but those that continue one.
            points = np.cumsum(np.frombuffer(data, np.int8) >= -64).tolist()
            found = [(points[a - 1] if a else 0, r, points[b - 1]) for a, r, b in found]
        return sorted(found)


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once per worker."""
    return Scanner(rules)


_SPANS = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()))


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(rules: tuple[Rule, ...]):
    """The spans of each text; the texts themselves do not come back."""

    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = scanner(rules)
        for texts in batches:
            found = [
                [{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in scan.spans(t.as_py())] for t in texts
            ]
            yield pa.array(found, _KIND)

    # Called once per row: Spark must not repeat it where spans are used.
    return F.arrow_udf(spans, _SPANS).asNondeterministic()


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of `docs` (with `text` last) and spans: an array of (kind,
    start, end) in code points, end exclusive, by start and then rule.

    Matches of different kinds may overlap. A null or empty text has an empty
    array; repeated rows are scanned like any others. A column named spans is
    replaced."""
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "spans")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"))
    return rows.withColumn("spans", _scan(rules)(F.col(f"`{text}`")))


def masked(found: DataFrame, text: str = "text") -> DataFrame:
    """`found` with every span in `text` replaced by <kind>; of overlapping
    spans the first keeps its name and all of their union goes."""

    # Going over the spans in order: the text so far and how far it has come.
    def step(state, span):
        begins_after = span["start"] >= state["at"]
        gap = F.when(
            begins_after,
            F.concat(
                F.col(f"`{text}`").substr(state["at"] + 1, span["start"] - state["at"]),
                F.concat(F.lit("<"), span["kind"], F.lit(">")),
            ),
        ).otherwise("")
        return F.struct(
            F.concat(state["done"], gap).alias("done"), F.greatest(state["at"], span["end"]).alias("at")
        )

    zero = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    rest = F.length(F.col(f"`{text}`"))
    done = F.aggregate(
        "spans",
        zero,
        step,
        lambda s: F.concat(s["done"], F.col(f"`{text}`").substr(s["at"] + 1, rest - s["at"])),
    )
    clean = F.when(F.size("spans") == 0, F.col(f"`{text}`")).otherwise(done)
    return with_replaced(found, {text: clean})
