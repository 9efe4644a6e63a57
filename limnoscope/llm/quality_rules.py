"""Quality rules by distribution divergence, in column expressions only.

A document's character classes and common words are histograms. Each is compared with references of several languages
by Jensen-Shannon distance (base 2, 0 to 1); the nearest language counts. Documents with fewer than `min_words` words
are too short for a histogram: the base rules alone decide them (and reject them, as the base needs 50 words).

Defined results: a null text counts as empty; an empty text has all counts 0 and fails the base; repeated rows are
judged one by one; extra columns stay and working columns never clash with them; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.llm.rows import free_name, words

# The most frequent function words of each language, in order of frequency.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as by be this are at from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que pour est dans qui par sur pas au avec",
    "es": "de la que el en y los se las del un por con no una su para al es lo",
}
# Shares of lower-case letters, capitals, digits, white space, punctuation and other symbols in prose.
CLASS_SHARES = {"en": (0.795, 0.014, 0.001, 0.166, 0.024, 0.0001), "de": (0.810, 0.013, 0.001, 0.154, 0.022, 0.0001),
                "fr": (0.794, 0.014, 0.001, 0.167, 0.024, 0.0001), "es": (0.801, 0.014, 0.001, 0.161, 0.023, 0.0001)}
# Shares of common words fall with their rank as a power law.
TOP_SHARE, RANK_POWER = 0.063, 0.80


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_class_distance: float = 0.28
    max_word_distance: float = 0.345
    common_words: dict[str, str] = field(default_factory=lambda: COMMON_WORDS)
    class_shares: dict[str, tuple] = field(default_factory=lambda: CLASS_SHARES)


def word_reference(listed: str) -> list[float]:
    """Expected shares of the listed words, then of all other words."""
    shares = [TOP_SHARE / rank**RANK_POWER for rank, _ in enumerate(listed.split(), 1)]
    return [*shares, 1 - sum(shares)]


def js_distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram (array of counts) to fixed shares; 1 when the total is 0."""
    whole = sum(reference)
    shares = F.array(*[F.lit(float(x / whole)) for x in reference])

    def part(count: Column, p: Column) -> Column:
        q = count / total
        m = (p + q) / 2
        side = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (side(p) + side(q)) / 2

    divergence = F.aggregate(F.zip_with(counts, shares, part), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(1.0)


def _chars(text: Column, pattern: str) -> Column:
    """Code points of the text that the character class holds."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{pattern}]+", ""))


def verdicts(docs: DataFrame, column: str = "text", limits: Limits = Limits(), prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed, kept.

    The names get the prefix; columns of those names in the input are replaced. `base_failed`: fewer than 50 words, or over half of the words in
    3-word windows that the text holds twice or more. `kept`: the base passed and both distances to the nearest
    language are within limits.

    Each working column is read more than once, so the optimiser computes it once and does not inline it into lambdas.
    """
    listed = sorted({w for ws in limits.common_words.values() for w in ws.split()})
    work = ("text", "tokens", "grams", "order", "at", "common", "rest", "chars", "classes", "hist", "lines")
    text, tokens, grams, order, at, common, rest, chars, classes, hist, lines = (free_name(docs, x) for x in work)
    c = F.col
    d = docs.withColumn(text, F.coalesce(c(column).cast("string"), F.lit(""))).withColumn(tokens, words(c(text)))
    # 64-bit hashes of the 3-word windows.
    d = d.withColumn(
        grams,
        F.when(
            F.size(tokens) >= 3,
            F.transform(
                F.slice(c(tokens), F.lit(1), F.size(tokens) - 2),
                lambda w, i: F.xxhash64(w, F.get(c(tokens), i + 1), F.get(c(tokens), i + 2)),
            ),
        ).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    # Most texts repeat no window and need the distinct count only. Otherwise the windows are ordered by hash, and
    # equal neighbours give the positions of repeated windows.
    d = d.withColumn(
        order,
        F.when(
            F.size(F.array_distinct(grams)) < F.size(grams),
            F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda x, k: F.coalesce(F.get(c(order), k)["h"] == x["h"], F.lit(False))
    d = d.withColumn(
        at,
        F.sort_array(
            F.filter(
                F.transform(order, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull()
            )
        ),
    )
    # Each window adds the words up to the next repeated window, three at most: the union of [p, p + 3).
    covered = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(c(at), k + 1) - p, F.lit(3))))
    d = d.withColumn(common, F.filter(F.split(F.lower(c(text)), r"[^\p{L}]+"), lambda w: w.isin(listed)))
    # Lower-case letters are most of a text; the other classes are counted in what is left.
    d = d.withColumns({chars: F.length(text), rest: F.regexp_replace(c(text), r"\p{Ll}+", "")})
    kinds = (r"\p{Lu}", "0-9", r"\x20\x09-\x0D", r".,;:!?'\"()\-")
    d = d.withColumn(classes, F.array(c(chars) - F.length(rest), *[_chars(c(rest), k) for k in kinds]))
    d = d.withColumn(hist, F.array(*[(F.size(common) - F.size(F.array_remove(common, w))).cast("double") for w in listed]))
    d = d.withColumn(lines, F.filter(F.split(c(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumns(
        {
            f"{prefix}n_words": F.size(tokens).cast("long"),
            f"{prefix}word_chars": F.length(F.array_join(tokens, "")).cast("long"),
            f"{prefix}n_symbols": _chars(c(rest), "#*$%&|<>").cast("long"),
            f"{prefix}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            f"{prefix}n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        }
    )
    n, total = c(f"{prefix}n_words"), c(chars)
    shares = F.concat(classes, F.array(total - F.aggregate(classes, F.lit(0), lambda a, x: a + x))).cast("array<double>")

    def histogram(words_of: str) -> Column:
        ours = F.array(*[F.get(c(hist), listed.index(w)) for w in words_of.split()])
        held = F.aggregate(ours, F.lit(0.0), lambda a, x: a + x)
        return F.concat(ours, F.array(F.greatest(n - held, F.lit(0.0))))

    def nearest(options: list[Column]) -> Column:
        return F.when(n >= limits.min_words, F.array_min(F.array(*options)))

    d = d.withColumns(
        {
            f"{prefix}class_distance": nearest([js_distance(shares, total, list(x)) for x in limits.class_shares.values()]),
            f"{prefix}word_distance": nearest([js_distance(histogram(x), n, word_reference(x)) for x in limits.common_words.values()]),
            f"{prefix}base_failed": (n < 50) | (100 * c(f"{prefix}n_repeat_words") > 50 * n),
        }
    )
    divergent = (c(f"{prefix}class_distance") > limits.max_class_distance) | (c(f"{prefix}word_distance") > limits.max_word_distance)
    # Always true, but not deterministic to the optimiser: a filter on the verdict stays above these projections instead
    # of being pushed to the scan with all their expressions written out in it, over and over.
    settled_here = F.monotonically_increasing_id() >= 0
    d = d.withColumn(f"{prefix}kept", settled_here & ~c(f"{prefix}base_failed") & ~F.coalesce(divergent, F.lit(False)))
    return d.drop(text, tokens, grams, order, at, common, rest, chars, classes, hist, lines)
