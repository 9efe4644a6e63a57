"""Short licence notices, exact and with a bounded number of edits.

A notice of up to `edits` edits is cut into `edits + 1` parts. Edits cannot touch all of them, so one part stands
unchanged in every match: the parts of all notices go into one automaton, which runs over a text once. Around each part
found, the few characters that a match could cover are handed to the regex library, whose bounded-error matching checks
the edits and gives the span. A text is searched as its words joined by single spaces, so marks, line breaks and comment
signs between words do not count as edits; matches begin and end between words.

Phrases with no edits allowed are the base: every place where their words stand one after the other counts, overlaps
included. Numbers must agree (version 2 is not version 3). Of overlapping matches for different licences only those with
the fewest edits stay; base matches always stay.

Defined results: null and empty texts hold no words and no notice, their score is 0; repeated rows are judged alike; a
null id stays null; extra columns stay in `scan` (columns named like its own are replaced); an empty table gives no rows.
Whole texts are searched, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

from limnoscope.llm.rows import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NUMBER = re.compile(r"[0-9]+")
#: Verified stretches a task remembers; copies of one line are checked once.
REMEMBERED = 20_000


@dataclass(frozen=True)
class Notice:
    """Words that point to a licence, and how many characters may differ; 0 makes it a base phrase."""

    label: str
    words: str
    edits: int = 0


#: One character in fifteen may differ.
def _notice(label: str, words: str) -> Notice:
    return Notice(label, words, max(1, len(words) // 15))


BASE = (
    Notice("mit", "under the mit license"),
    Notice("apache-2", "apache license version 2"),
    Notice("cc-by-nc", "cc by nc"),
)
NOTICES = BASE + (
    _notice("mit", "released under the mit license"),
    _notice("mit", "licensed under the mit license"),
    _notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    _notice("apache-2", "licensed under the apache license version 2 0"),
    _notice("cc-by-nc", "licensed under cc by nc 4 0"),
    _notice("cc-by-nc", "creative commons attribution noncommercial"),
    _notice("cc-by", "licensed under cc by 4 0"),
    _notice("cc-by-sa", "licensed under cc by sa 4 0"),
    _notice("gpl-3", "licensed under the gnu general public license version 3"),
    _notice("gpl-2", "licensed under the gnu general public license version 2"),
    _notice("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    _notice("agpl-3", "licensed under the gnu affero general public license version 3"),
    _notice("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    _notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    _notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    _notice("unlicense", "this is free and unencumbered software released into the public domain"),
)

MATCH = "label string, words string, edits int, begin long, end long, first_word long, last_word long"


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """(offset, part) of the `edits + 1` parts of a notice; a base phrase is one part with its outer spaces."""
    if not notice.edits:
        return [(0, f" {notice.words} ")]
    n, size = notice.edits + 1, len(notice.words)
    edges = [k * size // n for k in range(n + 1)]
    return [(a, notice.words[a:b]) for a, b in zip(edges, edges[1:])]


class Scanner:
    """The automaton of all parts and one bounded-error pattern per notice."""

    def __init__(self, notices: Sequence[Notice]):
        self.notices = notices
        self.memory: dict[tuple[int, str], list[tuple[int, int, int]]] = {}
        self.patterns = [
            regex.compile(rf"(?b)(?<= )(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.edits}}}(?= )") if n.edits else None for n in notices
        ]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            for offset, part in seeds(n):
                found.setdefault(part, []).append((k, offset))
        self.parts = ahocorasick.Automaton()
        for part, where in found.items():
            self.parts.add_word(part, (len(part), where))
        if found:
            self.parts.make_automaton()

    def _verified(self, k: int, stretch: str) -> list[tuple[int, int, int]]:
        """(begin, end, edits) of the notice in a stretch, best match first found, without overlaps."""
        key = (k, stretch)
        if key not in self.memory:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            numbers = NUMBER.findall(self.notices[k].words)
            got = self.patterns[k].finditer(stretch)
            self.memory[key] = [(m.start(), m.end(), sum(m.fuzzy_counts)) for m in got if NUMBER.findall(m.group()) == numbers]
        return self.memory[key]

    def matches(self, joined: str) -> list[tuple[int, int, int, int]]:
        """(notice, begin, end, edits) in words joined by single spaces, with a space at either end."""
        if not len(self.parts):
            return []
        out, tried = set(), set()
        for stop, (size, where) in self.parts.iter(joined):
            begin = stop - size + 1
            for k, offset in where:
                n = self.notices[k]
                if not n.edits:
                    out.add((k, begin + 1, stop, 0))
                    continue
                # Wherever the match begins, it lies within as many characters around as there may be edits.
                lo = max(0, begin - offset - n.edits - 1)
                hi = min(len(joined), begin - offset + len(n.words) + n.edits + 1)
                if (k, lo) not in tried:
                    tried.add((k, lo))
                    out.update((k, lo + a, lo + b, e) for a, b, e in self._verified(k, joined[lo:hi]))
        return self._fewest_edits(sorted(out, key=lambda m: (m[1], m[2], m[0])))

    def _fewest_edits(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Matches that no overlapping match beats: fewer edits for another licence, or for the same notice."""
        reach = max((e - b for _, b, e, _ in found), default=0)
        kept = []
        for i, (k, begin, end, edits) in enumerate(found):
            beaten = False
            for step in (-1, 1):
                j = i + step
                while not beaten and 0 <= j < len(found) and abs(found[j][1] - begin) <= reach:
                    other, b, e, fewer = found[j]
                    rival = self.notices[other].label != self.notices[k].label or other == k
                    beaten = edits > 0 and rival and b < end and begin < e and fewer < edits
                    j += step
            if not beaten:
                kept.append((k, begin, end, edits))
        return kept

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """Number of words, and the matches with their words and code points in the text."""
        lowered = (text or "").translate(LOWERED)
        words = WORD.findall(lowered)
        joined = " " + " ".join(words) + " "
        found = self.matches(joined)
        if not found:
            return len(words), []
        spans = [m.span() for m in WORD.finditer(lowered)]
        out, at, seen = [], 0, 0
        for k, begin, end, edits in found:
            # Matches come in the order of their begin, so spaces are counted once along the text.
            seen += joined.count(" ", at, begin)
            at, first = begin, seen - 1
            last = first + joined.count(" ", begin, end)
            n = self.notices[k]
            out.append(
                {"label": n.label, "words": n.words, "edits": edits, "begin": spans[first][0], "end": spans[last][1], "first_word": first, "last_word": last}
            )
        return len(words), out


@lru_cache(maxsize=4)
def _scanner(notices: tuple[Notice, ...]) -> Scanner:
    """One per worker process."""
    return Scanner(notices)


def scan(docs: DataFrame, notices: Sequence[Notice] = NOTICES, column: str = "text") -> DataFrame:
    """Adds n_words and notices, an array of (label, words, edits, begin, end, first_word, last_word) in text order.

    `begin` and `end` are code points of the text, end exclusive.
    """
    listed = tuple(notices)
    key = free_name(docs, "text")
    rows = docs.withColumn(key, F.coalesce(F.col(column).cast("string"), F.lit(""))).drop("n_words", "notices")
    match = _parse_datatype_string(MATCH)
    added = [StructField("n_words", _parse_datatype_string("long")), StructField("notices", ArrayType(match))]
    schema = StructType([*(f for f in rows.schema.fields if f.name != key), *added])
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    arrow = pa.list_(pa.struct(list(zip(match.names, kinds))))

    def run(batches):
        scanner = _scanner(listed)
        for batch in batches:
            got = [scanner.scan(text.as_py()) for text in batch.column(key)]
            kept = [c for c in batch.schema.names if c != key]
            arrays = [pa.array([n for n, _ in got], pa.int64()), pa.array([m for _, m in got], arrow)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, "n_words", "notices"])

    return rows.mapInArrow(run, schema)


def licences(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices) per document.

    `score` is the share of unchanged characters of the best match, 0 without one.
    """
    found = scan(docs.select("doc_id", "text"), notices)
    base = F.expr("filter(notices, m -> m.edits = 0 and array_contains(base, m.words))")
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(f"{c}.label"))), ",")
    with_base = found.withColumn("base", F.array(*(F.lit(n.words) for n in notices if not n.edits)).cast("array<string>")).withColumn("base", base)
    return with_base.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first_word").alias("first_word"),
        F.array_max("base.first_word").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("notices").alias("labels"),
        F.coalesce(F.array_max(F.expr("transform(notices, m -> 1.0d - m.edits / length(m.words))")), F.lit(0.0)).alias("score"),
        "notices",
    )
