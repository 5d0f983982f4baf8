"""Other forms of words by suffix rules, as spelling dictionaries give them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Suffix:
    """Words with ``flag`` that end as ``condition`` lose ``strip`` and get ``add``."""

    flag: str
    condition: str
    strip: str
    add: str


def read_suffixes(text: str) -> list[Suffix]:
    """The suffix rules of an affix file: ``flag *X:`` lines, then ``COND > -STRIP,ADD``. Prefixes and rules with ``'`` are skipped."""
    out, flag, suffixes = [], "", False
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if line.lower() in ("prefixes", "suffixes"):
            suffixes = line.lower() == "suffixes"
        elif m := re.match(r"flag\s+[*~]?(\w):", line):
            flag = m.group(1)
        elif suffixes and flag and ">" in line and "'" not in line:
            condition, change = (x.replace(" ", "").lower() for x in line.split(">", 1))
            strip, add = change[1:].split(",", 1) if change.startswith("-") else ("", change)
            out.append(Suffix(flag, "" if condition == "." else condition, strip, "" if add == "-" else add))
    return out


def read_dictionary(text: str) -> list[tuple[str, str]]:
    """(word, flags) of lines ``word/FLAGS``."""
    return [(w.lower(), flags) for w, _, flags in (line.strip().partition("/") for line in text.splitlines()) if w]


def expand(words: DataFrame, rules: list[Suffix]) -> DataFrame:
    """root, form of ``words`` (word, flags), each root also as its own form. Rules are few and stand in the plan."""
    forms = [F.col("word")]
    for r in rules:
        fits = F.contains("flags", F.lit(r.flag)) & F.col("word").rlike(f"{r.condition}$") & F.col("word").endswith(r.strip)
        forms.append(F.when(fits, F.concat(F.substring("word", F.lit(1), F.length("word") - len(r.strip)), F.lit(r.add))))
    return words.select(F.col("word").alias("root"), F.explode(F.array_distinct(F.filter(F.array(*forms), lambda f: f.isNotNull()))).alias("form"))


def forms_of(expanded: DataFrame, asked: list[str]) -> dict[str, tuple[str, ...]]:
    """All forms that share a root with each asked word: what the query parser needs."""
    roots = expanded.where(F.col("form").isin(asked)).select("root", F.col("form").alias("asked"))
    rows = roots.join(expanded, "root").select("asked", "form").distinct().collect()
    return {w: tuple(sorted(r["form"] for r in rows if r["asked"] == w)) for w in asked}
