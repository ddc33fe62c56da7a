"""Removal of case citations, with counts by group.

A citation is a year, a volume, a reporter and a page; what may be missing
depends on where the reporter stands. Patterns are put together from a table of
reporters; a pair of parties counts as a citation if a year follows it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups of reporters that follow a year, and the parts of their names.
REPORTERS = {
    "SCC": (("S", "C", "C"),),
    "SCR": (("S", "C", "R"),),
    "SCALE": (("SCALE",),),
    "other_reporter": (("J", "T"), ("I", "L", "R"), ("Cri", "L", "J"), ("CrLJ",), ("MANU",), ("ITR",), ("SCJ",)),
}
#: Words that a party's name may hold beside capitalised ones, and their greatest number on either side.
SMALL_WORDS = ("of", "and", "&", "the", "for")
WORDS_BEFORE, WORDS_AFTER = 6, 8


def one_of(*patterns: str) -> str:
    return f"(?:{'|'.join(patterns)})"


def maybe(pattern: str) -> str:
    return f"(?:{pattern})?"


def enclosed(pattern: str, left: str = r"\(", right: str = r"\)") -> str:
    return rf"{left}\s*{pattern}\s*{right}"


def spelt(parts: tuple[str, ...]) -> str:
    """A name with or without dots and blanks between its parts."""
    return r"\.?\s?".join(parts) + (r"\.?" if len(parts) > 1 else "")


YEAR = r"(?:1[6-9]\d\d|20\d\d)"
ANY_BRACKET_YEAR = enclosed(YEAR, r"[(\[]", r"[)\]]")
SUPPLEMENT = rf"Supp\.?\s*{maybe(enclosed('[0-9]+'))}"
VOLUME = one_of(enclosed("[0-9]+"), r"[0-9]+(?=\s)", SUPPLEMENT)
BENCH = enclosed("[A-Za-z]+")
PAGE = one_of(r"\d+[A-Za-z]?", enclosed(r"\d+[A-Za-z]?"))
COURT = r"[A-Z][A-Za-z.]{0,12}"


def after_a_year(names: tuple[tuple[str, ...], ...]) -> str:
    return rf"{one_of(ANY_BRACKET_YEAR, rf'\b{YEAR}')}\s*{maybe(VOLUME + r'\s*')}{one_of(*map(spelt, names))}\s*{maybe(BENCH + r'\s*')}{maybe('Supp\\.?\\s*')}\d*"


def party(most: int) -> str:
    name = r"[A-Z][\w.&'’-]*"
    return rf"{name}(?:\s+{one_of(name, *SMALL_WORDS)}){{0,{most}}}"


def patterns() -> list[tuple[str, str]]:
    """(group, pattern) in the order of application."""
    # The name of this reporter is a word too: it asks for a year or a page.
    air = rf"\b{spelt(('A', 'I', 'R'))}\s*{one_of(rf'{one_of(YEAR, enclosed(YEAR))}\s*{maybe(COURT + r'\s*')}{maybe(PAGE)}', rf'{maybe(COURT + r'\s*')}{PAGE}')}"
    out = [("placeholder", r"(?iU)<\s*CITATION\s*>"), ("AIR", f"(?iU){air}")]
    for group, names in REPORTERS.items():
        found = after_a_year(names)
        if group == "SCC":
            found = one_of(found, rf"\b{spelt(names[0])}\s*{maybe(BENCH + r'\s*')}\d+{maybe(r'\s*' + enclosed(YEAR))}")
        out.append((group, f"(?iU){found}"))
    pair = rf"\b{party(WORDS_BEFORE)}\s+{one_of('v', 'vs', 'versus')}\.?\s+{party(WORDS_AFTER)}"
    out.append(("party_pair_year", rf"(?U){pair}\s*{one_of(rf',?\s*{ANY_BRACKET_YEAR}', rf',\s*{YEAR}\b')}"))
    return out


PATTERNS = tuple(patterns())
GROUPS = tuple(group for group, _ in PATTERNS)


def scrub(text: Column) -> Column:
    """Struct of the text without citations and of the number removed from each group."""
    state = F.struct(text.alias("text"), *[F.lit(0).alias(g) for g in GROUPS])
    for group, pattern in PATTERNS:

        def removed(x: Column, group=group, pattern=pattern) -> Column:
            return x.withField(group, F.regexp_count(x["text"], F.lit(pattern))).withField("text", F.regexp_replace(x["text"], pattern, " "))

        state = bound(state, removed)
    return bound(state, lambda x: x.withField("text", F.trim(F.regexp_replace(x["text"], "[ \t]{2,}", " "))))


def bound(value: Column, step) -> Column:
    """``step(value)`` with ``value`` computed once: an array of one element names it."""
    return F.element_at(F.transform(F.array(value), lambda x: step(x)), 1)
