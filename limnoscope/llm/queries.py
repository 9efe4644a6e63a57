"""One query per operator over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from limnoscope.llm import (
    chat_collapse,
    collocations,
    decontaminate,
    html_density,
    license_notices,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    sharding,
    spelling_variants,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the rule ensemble."""
    return quality_classifier.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by sparse FTRL weights."""
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


@query()
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that a document holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def public_model(name: str = "piece_bpe_32k.model") -> str:
    """A public vocabulary file; it stays where its package put it."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.digests(docs, public_model())


@query()
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and kept document of every group of near copies."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes over all documents."""
    return sharding.shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)


def _sql_distance(counts: list[str], total: str, reference: list[float]) -> str:
    """Jensen-Shannon distance of counts to fixed shares, written out term by term."""
    whole = sum(reference)
    terms = []
    for count, share in zip(counts, reference):
        p, q = repr(share / whole), f"(({count})::double / ({total}))"
        side = lambda x: f"case when {x} > 0 then {x} * log2({x} / (({p} + {q}) / 2)) else 0 end"  # noqa: E731, B023
        terms.append(f"({side(p)} + {side(q)}) / 2")
    return f"sqrt(greatest({' + '.join(terms)}, 0.0))"


def _rules_sql(limits: quality_rules.Limits = quality_rules.Limits()) -> str:
    """The quality rules in SQL: windows of words by unnesting, histograms by counting in lists."""
    listed = sorted({w for ws in limits.common_words.values() for w in ws.split()})
    column = {w: f"w{k}" for k, w in enumerate(listed)}
    gone = lambda text, kind: f"length({text}) - length(regexp_replace({text}, '[{kind}]+', '', 'g'))"
    kinds = {"upper_": r"\p{Lu}", "digits": "0-9", "blank": r"\x20\x09-\x0D", "marks": r".,;:!?''\"()\-"}
    by_class = ["chars - length(rest)", *kinds, "length(rest) - upper_ - digits - blank - marks"]
    class_ = [_sql_distance(by_class, "chars", list(x)) for x in limits.class_shares.values()]
    word_ = []
    for listing in limits.common_words.values():
        ours = [column[w] for w in listing.split()]
        word_.append(_sql_distance([*ours, f"greatest(n_words - ({' + '.join(ours)}), 0)"], "n_words", quality_rules.word_reference(listing)))
    return f"""
    with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    split as (
        select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls,
               list_filter(string_split_regex(lower(t), '[^\\p{{L}}]+'), lambda x: x in ({", ".join(f"'{w}'" for w in listed)})) as cs,
               regexp_replace(t, '\\p{{Ll}}+', '', 'g') as rest
        from texts
    ),
    starts as (select r, ws, unnest(range(1, len(ws) - 1)) as i from split where len(ws) >= 3),
    grams as (select r, i, count(*) over (partition by r, ws[i], ws[i + 1], ws[i + 2]) as n from starts),
    covered as (select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from grams where n > 1) group by r),
    counted as (
        select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, {gone("t", "#*$%&|<>")} as n_symbols,
               len(ls) - list_unique(ls) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, length(t) as chars, rest,
               {", ".join(f"{gone('rest', kind)} as {name}" for name, kind in kinds.items())},
               {", ".join(f"len(list_filter(cs, lambda x: x = '{w}')) as {c}" for w, c in column.items())}
        from split left join covered using (r)
    ),
    judged as (
        select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
               case when n_words >= {limits.min_words} then least({", ".join(class_)}) end as class_distance,
               case when n_words >= {limits.min_words} then least({", ".join(word_)}) end as word_distance
        from counted
    )
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and not coalesce(class_distance > {limits.max_class_distance} or word_distance > {limits.max_word_distance}, false) as kept
    from judged
    """


@query(_rules_sql())
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the divergence rules for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query(
    """
    with turns as (select distinct conv_id, turn, role, text from conversations),
    ordered as (
        select *, row_number() over w as turn_no, count(*) over (partition by conv_id) as n_turns,
               string_agg(coalesce(turn, -1) || chr(1) || coalesce(role, chr(3)) || chr(1) || coalesce(text, chr(3)), chr(2)) over w as prefix
        from turns
        window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first rows unbounded preceding)
    ),
    wholes as (select prefix, min(conv_id) as conv_id from ordered where turn_no = n_turns group by prefix),
    kept as (select conv_id from wholes where prefix not in (select prefix from ordered where turn_no < n_turns))
    select conv_id, n_turns, turn_no, role, text, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as rendered
    from ordered where conv_id in (select conv_id from kept)
    """
)
def op8_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of every conversation that no longer conversation begins with."""
    return chat_collapse.maximal_turns(table(spark, sf_dir, "conversations"))


@query()
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(docs, pii.fit(docs))


@query()
def op10_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_density.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _phrases_sql(mining: collocations.Mining = collocations.Mining()) -> str:
    """Collocations in SQL: all phrases of all pieces are listed and counted."""
    return f"""
    with texts as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
    pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from texts),
    lists as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as ws from pieces),
    totals as (select lang, sum(len(ws))::bigint as n from lists group by lang),
    places as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from lists),
    sized as (select lang, ws, i, unnest(range(1, {mining.most_words + 1})) as k from places),
    counted as (
        select lang, list_aggregate(ws[i:i + k - 1], 'string_agg', ' ') as phrase, k as size, count(*) as f
        from sized where i + k - 1 <= len(ws) group by all having count(*) >= {mining.fewest}
    ),
    longer as (
        select lang, f, size, unnest([array_to_string(string_split(phrase, ' ')[:size - 1], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) as phrase
        from counted where size > 2
    ),
    candidates as (
        select lang, phrase, f as a, string_split(phrase, ' ') as ws, size from counted
        where size > 1 and (lang, phrase) not in (select (l.lang, l.phrase) from longer l join counted c on c.lang = l.lang and c.phrase = l.phrase where l.f >= c.f)
    ),
    cuts as (select *, unnest(range(1, size)) as k from candidates),
    scored as (
        select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, t.n, (1000::hugeint * c.a * t.n // (x.f::hugeint * y.f))::bigint as score
        from cuts c join totals t using (lang)
        join counted x on x.lang = c.lang and x.phrase = array_to_string(c.ws[:c.k], ' ')
        join counted y on y.lang = c.lang and y.phrase = array_to_string(c.ws[c.k + 1:], ' ')
    ),
    best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best)
    select * from ranked where rank <= {mining.top}
    """


@query(_phrases_sql())
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


@query()
def op12_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    found = license_notices.licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents."""
    return spelling_variants.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
