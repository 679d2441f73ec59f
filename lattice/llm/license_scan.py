"""10. License scans: ordered signature rules behind a keyword prefilter.

An Aho-Corasick automaton finds, in one pass over a lower-cased text, the keywords that it holds; only rules of a found
keyword run their regex, over the whole text. Detections are then taken in the order of priority, length (longer
first), place and rule, and one that lies within a detection already taken is suppressed. Detections that merely
overlap both stay.

Defined results: null and empty texts give no rows, nor do texts without a license. Repeated rows, and null doc_ids,
give the detections of each row. Other columns are ignored. Offsets count characters from 0, the end not included.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm._shared import table
from lattice.llm.license_rules import RULES


@dataclass(frozen=True)
class Rule:
    number: int
    license_id: str
    keyword: str
    pattern: str
    priority: int


def rules(text: str = RULES) -> list[Rule]:
    out: list[Rule] = []
    priority = 0
    for line in filter(None, text.splitlines()):
        if line.startswith("# "):
            priority = int(line.split()[1])
            continue
        name, keyword, pattern = line.split(" | ", 2)
        out.append(Rule(len(out) + 1, name, keyword, re.sub(r"(?<!\\) (?![?*+])", r"\\s+", re.sub(r" \?", r"\\s*", pattern)), priority))
    return out


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) without those within one that comes first, in the order of their places."""
    taken: list[tuple[int, int, Rule]] = []
    starts: list[int] = []  # of the detections taken that lie in no other taken one: both ends ascend
    ends: list[int] = []
    for start, end, rule in sorted(found, key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].number)):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        taken.append((start, end, rule))
        low, high = bisect_left(starts, start), bisect_right(ends, end)  # those within this one
        starts[low : max(low, high)], ends[low : max(low, high)] = [start], [end]
    return sorted(taken, key=lambda d: (d[0], d[1], d[2].number))


class Scanner:
    def __init__(self, which: list[Rule]):
        import ahocorasick

        self.patterns = [(rule, re.compile(rule.pattern, re.IGNORECASE)) for rule in which]
        self.automaton = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(which):
            by_keyword.setdefault(rule.keyword, []).append(i)
        for keyword, numbers in by_keyword.items():
            self.automaton.add_word(keyword, numbers)
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, Rule]]:
        gates = {i for _, numbers in self.automaton.iter(text.lower()) for i in numbers}
        found = [(m.start(), m.end(), self.patterns[i][0]) for i in sorted(gates) for m in self.patterns[i][1].finditer(text)]
        return suppress(found) if found else []


def licenses(docs: DataFrame, text_rules: str = RULES) -> DataFrame:
    """(doc_id, start, end, license_id, rule, matched) of every detection that is not suppressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules(text_rules))
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids = batch.column(0)
            for i, text in enumerate(batch.column(1)):
                value = text.as_py()
                for start, end, rule in scanner.scan(value) if value else ():
                    for column, cell in zip(out, (ids[i].as_py(), start, end, rule.license_id, rule.number, value[start:end])):
                        column.append(cell)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "start", "end", "license_id", "rule", "matched"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, start int, end int, license_id string, rule int, matched string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
