"""Spelling variants by reduced-alphabet generation.

Every letter is hashed to one of a few symbols, so a word of a large alphabet has a short list of reduced one-edit
neighbours: with four symbols a word of ten letters has 85 instead of some 1,800. The whole one-edit neighbourhood of
each reduced word is generated and joined with the reduced vocabulary; candidates are verified on the original strings.

Every generated neighbour remembers where its edit lies. One half of the neighbour is untouched by it, so that half's
original letters are joined too: a neighbour edited in its second half must begin with the word's own letters, one edited
in its first half must end with them. Words that only look alike reduced hence never meet by the thousand.

A word's form is its near word of largest count, where that is `ratio` times its own; forms are followed to the last one
by joins that double their reach, so chains take a logarithm of their length in rounds.

Defined results: null and empty texts hold no runs; a null doc_id counts as an empty one in the hash; repeated rows count
again; of equally frequent near words the smallest is the form; extra columns are not looked at; an empty table gives no
words. Whole texts are read and every word of the vocabulary is returned.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.llm.rows import settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of words after A-Z are lower-cased: a-z and everything from U+00C0 to U+00FF.
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: Symbols that letters are hashed to; at most ten.
SYMBOLS = 4


@dataclass(frozen=True)
class Vocabulary:
    fewest_letters: int = 6
    fewest_seen: int = 5
    ratio: int = 5
    symbols: int = SYMBOLS


def symbol(letter: str, symbols: int = SYMBOLS) -> str:
    """The symbol that a letter is hashed to."""
    return str(zlib.crc32(letter.encode()) % symbols)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    return F.translate(word, LETTERS, "".join(symbol(c, symbols) for c in LETTERS))


def _lower_ascii(run: Column) -> Column:
    """Lower-cases A-Z only; `lower` alone does so for runs of ASCII letters."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def words(docs: DataFrame, limits: Vocabulary = Vocabulary()) -> DataFrame:
    """(word, n) for every word of the texts that is long and frequent enough.

    One letter of every 199th run is left out: the one that the run's hash with its document names.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[^A-Za-zÀ-ÿ]+")).alias("run"),
    ).where(F.length("run") >= limits.fewest_letters)
    lowered = runs.select("doc", _lower_ascii(F.col("run")).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("cast(h % length(run) as int)")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % 199 == 0, shorter).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.length("word") >= limits.fewest_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= limits.fewest_seen)


def _halves(at: str, size: str) -> str:
    """The end that an edit at `at` leaves alone in a neighbour of `size` letters, with its original letters."""
    half = f"({size}) div 2"
    return f"if({at} >= {half}, concat('<', substring(word, 1, {half})), concat('>', substring(word, n_letters - ({size} - {half}) + 1)))"


def neighbourhoods(vocabulary: DataFrame, limits: Vocabulary = Vocabulary()) -> DataFrame:
    """(key, word): the hashes of every reduced one-edit neighbour of each word with its untouched half."""
    key = lambda neighbour, at, size: f"xxhash64({neighbour}, {_halves(at, size)})"
    before, here, after = "substring(r, 1, i)", "substring(r, i + 1, 1)", "substring(r, i + 2)"
    each = "sequence(0, n_letters - 1)"
    edits = [
        # A shorter neighbour below the least length is no word.
        f"if(n_letters > {limits.fewest_letters}, transform({each}, i -> {key(f'concat({before}, {after})', 'i', 'n_letters - 1')}), array())",
        # Letters of one symbol may stand for each other at either end.
        f"array({key('r', '0', 'n_letters')}, {key('r', 'n_letters', 'n_letters')})",
    ]
    for s in map(str, range(limits.symbols)):
        swapped = key(f"concat({before}, '{s}', {after})", "i", "n_letters")
        edits.append(f"transform(filter({each}, i -> {here} <> '{s}'), i -> {swapped})")
        inserted = key(f"concat({before}, '{s}', substring(r, i + 1))", "i", "n_letters + 1")
        edits.append(f"transform(sequence(0, n_letters), i -> {inserted})")
    with_r = vocabulary.select("word", F.length("word").alias("n_letters"), reduced(F.col("word"), limits.symbols).alias("r"))
    return with_r.select("word", F.explode(F.expr(f"array_distinct(flatten(array({', '.join(edits)})))")).alias("key"))


def own_keys(vocabulary: DataFrame, limits: Vocabulary = Vocabulary()) -> DataFrame:
    """(key, near, near_n): each word by its own reduced form with its first and with its second half."""
    with_r = vocabulary.select("word", "n", F.length("word").alias("n_letters"), reduced(F.col("word"), limits.symbols).alias("r"))
    both = ", ".join(f"xxhash64(r, {_halves(at, 'n_letters')})" for at in ("0", "n_letters"))
    return with_r.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.explode(F.expr(f"array({both})")).alias("key"))


def near_words(vocabulary: DataFrame, limits: Vocabulary = Vocabulary()) -> DataFrame:
    """(word, near, near_n): all pairs of words that differ by exactly one letter, both ways round."""
    met = neighbourhoods(vocabulary, limits).hint("merge").join(own_keys(vocabulary, limits), "key")
    verified = met.where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    return verified.select("word", "near", "near_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of the forms that follow. Every round doubles the reach."""
    reached = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge")
        after = settled(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        reached = after.select("word", "root")
        if after.where("next is not null").isEmpty():
            return reached


def variants(docs: DataFrame, limits: Vocabulary = Vocabulary()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `docs` (doc_id, text)."""
    vocabulary = settled(words(docs, limits))
    best = near_words(vocabulary, limits).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b")
    )
    known = vocabulary.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n")
    )
    frequent = F.col("near_n") >= limits.ratio * F.col("n")
    formed = settled(known.select("word", "n", "n_near", F.when(frequent, F.col("near")).alias("form"), F.when(frequent, F.col("near_n")).alias("form_n")))
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
