"""Collocations, licence notices and spelling variants against plain Python, and on odd rows."""

import collections
import random
import re
import zlib

import pytest

from limnoscope.llm import collocations, license_notices, spelling_variants
from limnoscope.llm.license_notices import Notice

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_words string, word string, phrase int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, ties, a very long text and columns with the operators' own names."""
    long = "Released under the MIT-License; colour colours " * 20_000
    rows = [
        (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "a b c. A b c", "en"), (4, "a b c. A b c", "en"), (None, "a b\tc", None),
        (None, None, None), (5, "x", ""), (6, "é日本 ünï 😀 \x00 x", "fr"), (7, long, "de"), (8, "apache license version 2 apache license version 2", "en"),
    ]
    return spark.createDataFrame([(i, t, g, "k", "k", 1) for i, t, g in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_collocations(rows, mining):
    """(lang, rank, phrase, a, l, r, n, score) by listing every phrase."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, mining.most_words + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, seen in f.items():
        often = {p: c for p, c in seen.items() if c >= mining.fewest}
        held = set()
        for p, c in often.items():
            for k in range(2, len(p)):
                held.update(p[i : i + k] for i in range(len(p) - k + 1) if c >= seen[p[i : i + k]])
        listed = []
        for p, a in often.items():
            if len(p) > 1 and p not in held:
                score, k = min((1000 * a * n[lang] // (seen[p[:k]] * seen[p[k:]]), k) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), seen[p[:k]], seen[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[: mining.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("modulus, bits", [(16, 26), (1, 6), (3, 12)])
def test_collocations_equal_all_phrases(spark, odd, modulus, bits):
    """Any cut of the parse and any size of the filters, full ones too, give the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    mining = collocations.Mining(fewest=20, modulus=modulus, filter_bits=bits, top=400)
    for frame, limits in ((docs, mining), (odd, collocations.Mining(fewest=2, modulus=modulus, filter_bits=bits, top=50))):
        got = sorted(tuple(r) for r in collocations.collocations(frame, limits).collect())
        assert got == brute_collocations([(r.text, r.lang) for r in frame.collect()], limits)


def test_chunks_join_to_the_pieces(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))) + rng.choice([".", "\n", "; x"]) for _ in range(60)]
    import pyarrow as pa

    for modulus in (1, 2, 5):
        pieces = collections.defaultdict(list)
        for row, chunks, owned in collocations.chunks_of(pa.array(texts), 4, modulus):
            for r, c, o in zip(row, chunks.to_pylist(), owned):
                ws = c.split(" ")
                assert o == len(ws) or o == len(ws) - 4
                pieces[r] += ws[:o]
        for r, text in enumerate(texts):
            assert pieces[r] == re.findall(r"[^ .;\n]+", text)


def test_scores_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a b", 10**13), ("en", "a", 10**13 + 7), ("en", "b", 3 * 10**13)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 10**17)], "lang string, n long")
    row = collocations.ranked(found, totals).first()
    assert row.score == 1000 * 10**13 * 10**17 // ((10**13 + 7) * 3 * 10**13)


def test_no_collocations(spark, empty):
    assert collocations.collocations(empty).count() == 0


def brute_words(rows, limits):
    seen = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= limits.fewest_letters and n >= limits.fewest_seen}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, limits):
    n = brute_words(rows, limits)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= limits.ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


@pytest.mark.parametrize("symbols", [1, 4, 10])
def test_variants_equal_brute_force(spark, odd, symbols):
    """Words of few letters, accents and chains of forms; however few symbols letters are hashed to."""
    rng = random.Random(symbols)
    roots = ["colours", "analyse", "straße", "élèves", "banana", "aaaaaa", "bananas"] + ["".join(rng.choice("abcdé") for _ in range(7)) for _ in range(20)]
    texts = []
    for r in roots:
        for k, size in enumerate((600, 90, 14, 2)):
            w = list(r + "x" * (k % 2))
            if k:
                w[rng.randrange(len(w))] = rng.choice("abcdéÉZ")
            texts.append((rng.choice([None, 3, 11, 12]), ("".join(w) + rng.choice([" ", "×", ", ", "7"])) * size))
    texts += [(9, "Abcdefg " * 400 + "abcdefgh " * 70 + "abcdefghi " * 12), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, None, "k", "k", 1) for i, t in texts], SCHEMA)
    limits = spelling_variants.Vocabulary(fewest_seen=2, symbols=symbols)
    for frame in (docs, odd):
        got = spelling_variants.variants(frame, limits).collect()
        want = brute_variants([(r.doc_id, r.text) for r in frame.collect()], limits)
        assert len(got) == len(want) and {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert any(len({w[1] for w in want}) for w in want)


def test_variants_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    limits = spelling_variants.Vocabulary()
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.variants(docs, limits).collect()}
    assert got == brute_variants([tuple(r) for r in docs.collect()], limits)


def test_no_variants(empty):
    assert spelling_variants.variants(empty).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def base_places(text, notices=license_notices.BASE):
    ws = words_of(text)
    return sorted((i, n.label) for n in notices for i in range(len(ws)) if ws[i : i + len(n.words.split())] == n.words.split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_base_phrases_equal_word_search(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = docs.unionByName(odd.select("doc_id", "text")).where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    texts = texts.unionByName(spark.createDataFrame([(-1, "CC-BY-NC cc by nc by nc, under the MIT\n# License"), (-2, "cc by ncé"), (-3, "xcc by nc")], texts.schema))
    wanted = collections.Counter()
    for r in texts.collect():
        p = base_places(r.text)
        starts = [i for i, _ in p]
        wanted[(r.doc_id, len(words_of(r.text)), len(p), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in p})))] += 1
    got = license_notices.licences(texts).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == wanted
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_every_notice_within_its_edits_is_found():
    """Against edit distances of all runs of words: a notice with up to its edits is reported, with more it is not."""
    rng = random.Random(7)
    scanner = license_notices.Scanner(license_notices.NOTICES)
    for notice in license_notices.NOTICES:
        for edits in range(0, notice.edits + 3):
            w = list(notice.words)
            for _ in range(edits):
                at = rng.randrange(1, len(w) - 1)
                w[at : at + 1] = rng.choice([[], ["q"], [w[at], "z"]])
            changed = re.sub(" +", " ", "".join(w)).strip()
            if re.findall("[0-9]+", changed) != re.findall("[0-9]+", notice.words):
                continue
            joined = f" so {changed} it "
            hits = [m for m in scanner.matches(joined) if scanner.notices[m[0]] == notice]
            others = [m for m in scanner.matches(joined) if scanner.notices[m[0]].label != notice.label]
            real = distance(changed, notice.words)
            if real <= notice.edits and not others:
                assert hits, (notice, changed)
            for k, begin, end, e in hits:
                assert distance(joined[begin:end], notice.words) == e <= notice.edits


def test_spans_point_into_the_text():
    text = "# Ünder\n// Relesed under the MIT\n// Licence, and: Apache License, Version 2.0"
    n_words, found = license_notices.Scanner(license_notices.NOTICES).scan(text)
    fuzzy = [m for m in found if m["edits"]]
    assert n_words == len(words_of(text)) and {m["label"] for m in found} == {"mit", "apache-2"}
    assert [(text[m["begin"] : m["end"]], m["edits"]) for m in fuzzy] == [("Relesed under the MIT\n// Licence", 2)]
    for m in found:
        assert m["first_word"] <= m["last_word"] < n_words
        assert words_of(text)[m["first_word"] : m["last_word"] + 1] == words_of(text[m["begin"] : m["end"]])


def test_versions_are_not_edits():
    scanner = license_notices.Scanner(license_notices.NOTICES)
    labels = lambda t: {m["label"] for m in scanner.scan(t)[1]}
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl-3"}
    assert labels("This work is licensed under the GNU General Public Licence, version 2.") == {"gpl-2"}
    assert labels("Licensed under CC BY 4.0.") == {"cc-by"} and labels("Licensed under CC BY-NC 4.0.") == {"cc-by-nc"}
    assert labels("the committee met under the exit sign") == set()


def test_notices_of_ones_own(spark, odd, empty):
    found = license_notices.scan(odd, [Notice("abc", "a b c"), Notice("colour", "colour colours", 1)])
    assert found.columns == ["doc_id", "text", "lang", "word", "phrase", "n_words", "notices"]
    by_id = {r.doc_id: r for r in found.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    assert len(by_id[4].notices) == 2 and len(by_id[7].notices) == 20_000 and by_id[1].n_words == 0
    assert license_notices.scan(odd, []).where("size(notices) > 0").count() == 0
    assert license_notices.licences(empty).count() == 0
