"""Every text operator against plain Python, and on nulls, empty and long texts, ties, empty tables and clashing names."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from limnoscope.llm import (
    bilstm_crf,
    decontaminate,
    html_density,
    labelled,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    sharding,
    toxicity,
    wordhash,
)
from limnoscope.llm.queries import ORACLES, QUERIES, public_model
from compare import connect, differences

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, leaks int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, ties, a very long text and columns with the operators' own names."""
    prose = "The and of to in is that it was for on with as by be this are at from the end. " * 8
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, prose), (4, prose), (5, prose), (None, "lonely words"), (None, None),
        (6, "one"), (7, "a b c a b c"), (8, "é日本 ünï 😀 \x00 x"), (9, "word " * 30_000 + "mail a.b@c.de and +1 (212) 555-0187"),
    ]
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_do_not_depend_on_place():
    texts = ["Alpha beta", None, "", "beta  ALPHA\nbeta", "alpha-beta"]
    for _, _, data, offsets in wordhash.slices(pa.array(texts)):
        h, start, end, first = wordhash.word_hashes(data, offsets, wordhash.SPACED)
        seen = [data[a:b].tobytes().decode().lower() for a, b in zip(start, end)]
        assert seen == ["alpha", "beta", "beta", "alpha", "beta", "alpha-beta"]
        assert list(first) == [0, 2, 2, 2, 5, 6]
        assert len(set(h.tolist())) == 3 and h[0] == h[3] == wordhash.word_hash("alpha")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for frame in (docs, odd.select("doc_id", "text")):
        rows = quality_rules.verdicts(frame).collect()
        assert len(rows) == frame.count()
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(r.text)
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.base_failed is False or r.kept is False
    assert quality_rules.verdicts(empty).count() == 0
    # A filter on the verdict keeps the other columns, named like the rules' own or not.
    assert quality_rules.verdicts(odd, prefix="x_").where("x_kept").select("kept").distinct().count() <= 1


def test_js_distance_in_plain_numpy(spark):
    from pyspark.sql import functions as F

    p, q = np.array([5.0, 0.0, 15.0]), np.array([0.2, 0.3, 0.5])
    got = spark.range(1).select(quality_rules.js_distance(F.array(*map(F.lit, p.tolist())), F.lit(20.0), q.tolist()).alias("d")).first().d
    a = p / p.sum()
    m = (a + q) / 2
    side = lambda x: np.sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / m), 0))
    assert got == pytest.approx(np.sqrt((side(a) + side(q)) / 2))


def shingle_set(text, size=2):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    rng = np.random.default_rng(3)
    chain = []
    for k in range(30):  # a chain in which neighbours are alike and the ends are not
        text = [f"w{(k * 2 + j)}" for j in range(60)]
        chain.append((10_000 + k, " ".join(text)))
    noisy = [(20_000 + k, " ".join(words[:18] if rng.random() < 0.5 else words)) for k in range(20)]
    frame = docs.unionByName(spark.createDataFrame(chain + noisy, "doc_id long, text string"))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame).collect()}
    expected, sizes = brute_components([(r.doc_id, r.text) for r in frame.collect()])
    assert {i: r.component_id for i, r in got.items()} == expected
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def template_pages(n, seed):
    """Pages of one form: most are merely similar, a few reach 0.8, and their buckets begin with others."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        kinds = np.where(rng.random(30) < 0.83, 0, rng.integers(1, 3, 30))
        rows.append((k, " ".join(f"f{j}k{v}w{i}" for j, v in enumerate(kinds) for i in range(6))))
    return rows


def test_near_duplicates_of_small_sets(spark):
    """Sets of 5 to 20 shingles, whose bins are copies of each other: components equal brute force."""
    rng = np.random.default_rng(11)
    rows = []
    for family in range(25):
        base = [f"f{family}w{i}" for i in range(rng.integers(6, 22))]
        for k in range(8):
            words = list(base)
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(len(words))] = f"x{rng.integers(4)}"
            rows.append((len(rows), " ".join(words[: len(words) - rng.integers(0, 2)])))
    expected, _ = brute_components(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame).collect()} == expected


def test_signatures_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 700, 5_000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for share in (0.0, 0.05, 0.1, 0.2, 0.4):
            changed = np.where(rng.random(n) < share, rng.integers(0, 2**63, n).astype(np.uint64), base)
            a, b = np.unique(base), np.unique(changed)
            bits = np.bitwise_count(np.bitwise_xor(*near_dedup.signatures([a, b])).view(np.uint64)).sum()
            differ = len(np.setxor1d(a, b))
            assert bits <= differ
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                assert bits * 180 <= (len(a) + len(b)) * 20


def test_near_duplicates_of_one_template(spark):
    rows = template_pages(60, 5)
    expected, _ = brute_components(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame).collect()} == expected


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    found = collections.defaultdict(set)
    for r in rows:
        found[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert found[1] == {(0, 1, True)} and found[2] == {(0, 2, True)} and found[3] == {(0, 3, True)}
    assert {x[1] for x in found[5]} == {4} and {x[2] for x in found[5]} == {False}
    assert {x[1:] for x in found[None]} == {(None, True)}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_densified_bins_come_from_the_same_set():
    sets = [np.sort(wordhash.mix(np.arange(n, dtype=np.uint64) + np.uint64(9))) for n in (1, 3, 200)]
    keys = near_dedup.band_keys(sets, near_dedup.Sketch())
    assert keys.shape == (3, 32) and len(set(keys[0].tolist())) == 32
    least = np.array([[0, 7, 0, 9]], dtype=np.uint64)
    out = near_dedup.densified(least, least > 0)
    assert set(out[0].tolist()) <= {7, 9} and out[0, 1] == 7 and out[0, 3] == 9


@pytest.mark.parametrize("range_bytes", [20_000, 4_000_000])
def test_shards(spark, range_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    copies = spark.range(100_000, 100_400).selectExpr("id as doc_id", "'one and the same text in very many copies' as text")
    frame = docs.unionByName(copies).unionByName(spark.createDataFrame([(None, "x"), (5, None)], "doc_id long, text string"))
    rows = sharding.shards(frame, 8, range_bytes=range_bytes).collect()
    texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in frame.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == list(range(8))
    largest = max(r.size for r in rows)
    target = sum(r.size for r in rows) / 8
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r.size for r in part) - target) <= 2 * largest + 0.02 * target
    # Equal texts lie in neighbouring shards only.
    places = collections.defaultdict(set)
    for r in rows:
        places[(r.size, r.text_crc32)].add(r.shard)
    assert all(max(p) - min(p) + 1 == len(p) for p in places.values())


def test_shards_split_rows_that_are_alike_in_everything(spark):
    """One text under one id, and rows without an id: ranges are cut between them, shards come out even."""
    rows = [(7, "same text " * 20, "k", 1)] * 900 + [(None, "same text " * 20, "k", 1)] * 900 + [(k, f"other {k}", "k", 1) for k in range(300)]
    got = sharding.shards(spark.createDataFrame(rows, SCHEMA), 8, range_bytes=4_000).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == len(rows) and len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * 201
    for k in sizes:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_few_ranges_give_even_shards_too(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_RANGES", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sizes = [r.bytes for r in sharding.shards(docs, 8, range_bytes=1_000).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "bytes").collect()]
    longest = max(len((r.text or "").encode()) + 1 for r in docs.collect())
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * longest + 0.02 * sum(sizes) / 8


def test_shards_of_nothing(empty):
    assert sharding.shards(empty).count() == 0


ODD_TEXTS = ["", " ", "  Hello  wörld\n\tx ", "ﬁ Ａ ​\x00a b\x00", "▁a ▁ b<s></s><unk><0x41>", "日本語 テスト 😀😀", "a" * 3000, "\n\n", "..,,!!  ??", "é́ � 12345 67,890.12"]


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece_codec.Model.read(public_model())
    library = sentencepiece.SentencePieceProcessor(model_file=public_model())
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in texts:
        ids, begins, ends = model.encode(text)
        assert ids == library.encode(text) and model.decode(ids) == library.decode(ids)
        raw = text.encode()
        assert (ends[-1] if len(ends) else 0) == len(raw) and (begins[1:] == ends[:-1]).all()
        for k, b, e in zip(ids, begins, ends):
            if not model.is_byte[k] and "▁" not in text:
                piece = model.pieces[k].replace("▁", " ")
                assert raw[b:e].decode() in (piece, piece[1:] if b == 0 else piece)


def darts(pairs):
    """A compiled character map with the given prefixes, laid out as a double-array trie."""
    texts, offset = b"", {}
    for key, value in pairs.items():
        offset[key] = len(texts)
        texts += value + b"\0"
    units, used, bases = [0] * 4096, {0}, {0}

    def place(prefix, at):
        nexts = sorted({k[len(prefix)] for k in pairs if k.startswith(prefix) and len(k) > len(prefix)})
        labels = ([0] if prefix in pairs else []) + nexts
        if not labels:
            return
        base = next(b for b in range(1, 4096) if b not in bases and all((b ^ x) not in used and (b ^ x) < 4096 for x in labels))
        units[at] |= ((at ^ base) << 10) | ((1 << 8) if prefix in pairs else 0)
        used.update(base ^ x for x in labels)
        bases.add(base)
        if prefix in pairs:
            units[base] = (1 << 31) | offset[prefix]
        for x in nexts:
            units[base ^ x] |= x
        for x in nexts:
            place(prefix + bytes([x]), base ^ x)

    place(b"", 0)
    import struct

    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts


def test_longest_prefix_normalisation_keeps_byte_spans():
    pairs = {"ﬁ".encode(): b"fi", "Ａ".encode(): b"A", b"ab": b"x", b"abc": b"yz", b"\t": b" "}
    assert sentencepiece_codec.character_map(darts(pairs)) == pairs
    model = sentencepiece_codec.Model.read(public_model())
    model.mapped = pairs
    text = "ﬁ abcd ab\tＡ"
    norm, owned = model.normalise(text)
    assert norm == "▁fi▁yzd▁x▁A" and sum(owned) == len(text.encode())
    ids, begins, ends = model.encode(text)
    assert ends[-1] == len(text.encode()) and (begins[1:] == ends[:-1]).all() and (ends >= begins).all()


def test_codec_frames(spark, odd, empty):
    rows = sentencepiece_codec.digests(odd, public_model(), with_ids=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    coded = sentencepiece_codec.encode(odd.withColumnRenamed("leaks", "ids"), public_model())
    back = sentencepiece_codec.decode(coded, public_model(), out="again").collect()
    assert all(r.again == (r.text or "") and r.kept == "k" for r in back)
    assert sentencepiece_codec.digests(empty, public_model()).count() == 0


def test_crf_gradient_is_the_slope():
    p = bilstm_crf.fresh(5, 4, 3)
    rng = np.random.default_rng(0)
    codes, tags = rng.integers(0, 100, (3, 7)), rng.integers(0, 5, (3, 7))
    p["moves"] = rng.normal(size=(5, 5)) * 0.3
    _, g = bilstm_crf.gradients(p, codes, tags)
    for name in p:
        at = (codes[0, 0], 1) if name == "embed" else tuple(rng.integers(0, s) for s in p[name].shape)
        kept = p[name][at]
        p[name][at] = kept + 1e-5
        up = bilstm_crf.gradients(p, codes, tags)[0]
        p[name][at] = kept - 1e-5
        down = bilstm_crf.gradients(p, codes, tags)[0]
        p[name][at] = kept
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], abs=1e-6)


def test_best_paths_equal_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    p = {"moves": rng.normal(size=(3, 3)), "start": rng.normal(size=3)}
    scores = rng.normal(size=(4, 5, 3))
    lengths = np.array([5, 3, 1, 4])
    got = bilstm_crf.best_paths(p, scores, lengths)
    for k, n in enumerate(lengths):
        value = lambda path: p["start"][path[0]] + sum(scores[k, t, s] for t, s in enumerate(path)) + sum(p["moves"][a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
        assert tuple(got[k, :n]) == max(itertools.product(range(3), repeat=int(n)), key=value)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), m.end(), 2) for m in pii.CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), 3) for m in pii.PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns():
    import random

    random.seed(1)
    texts = ["a@b.c_x@y.z", "1.2.3.4.5.6.7.8.9", "1.2.3.256 1.2.3.4.", "00012.1.1.1", "a@@b.c", "x@y..z", "a@b.c@d.e"]
    texts += ["".join(random.choice("1.2+ -a@b()3") for _ in range(40)) for _ in range(4000)]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_frames(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = pii.fit(docs)
    text = "Call me at (415) 555-2671 today. Version 3.0 of 2020-01-02."
    (added,) = pii.added_spans(model, [text], [pii.base_spans(text)])
    assert [text[a:b] for a, b, k in added] == ["(415) 555-2671"]
    rows = {r.doc_id: r for r in pii.digests(odd, model).collect()}
    assert rows[1].spans == rows[2].spans == "" and rows[9].n_email == 1 and rows[9].n_phone == 1
    masked = {r.doc_id: r for r in pii.redact(odd, model).collect()}
    assert masked[1].text is None and masked[9].text.endswith("mail <email> and <phone>") and masked[9].kept == "k"
    assert pii.digests(empty, pii.fit(empty)).count() == 0


PAGE = """<!doctype html><html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><a>a</a></nav>
<div id="cookie-notice">We use cookies.</div><div class=wrap><main><article><header><h1>Title &amp; more</h1></header>
<p>One <a href=x>two</a>\n three.<p>Four<br>five<ul><li>i1<li>i2</ul><form><label>Mail</label></form><aside>rel</aside></article>
<section id=comments><p>A very long reader comment that goes on and on with lots of text.</p></section></main></div><footer>f</footer>"""


@pytest.fixture(scope="module")
def network():
    """Trained on the fixed examples alone."""
    codes, tags = pii._labelled(list(pii.EXAMPLES) * 12, pii.Settings().window)
    return {k: v.astype(np.float32) for k, v in bilstm_crf.train(codes, tags, 1 + 2 * len(pii.KINDS), 120).items()}


def test_added_spans_equal_one_stretch_at_a_time(network):
    """Grouping, padding and merging change nothing: every stretch scored and decoded by itself, spans checked pair by pair."""
    rng = np.random.default_rng(4)
    bits = ["call (212) 555-0187 now", "a@b.de and jan (at) mail dot example dot org", 'token = "9f86d081884c7d659a2feaa0c55ad015"', "on 2024-03-05", "paid 4111.1111.1111.1111", "plain words"]
    texts = ["  ".join(bits[k] for k in rng.integers(0, len(bits), n)) for n in (1, 2, 3, 9, 40)] + ["", "7" * 300]
    base = [pii.base_spans(t) for t in texts]
    settings = pii.Settings(cells=700)
    want = []
    for text, known in zip(texts, base):
        found = set()
        for a, b in pii.stretches(text, settings):
            (scores,) = pii._scores(network, [text[a:b]], settings.window)
            tags = [int(x) for x in bilstm_crf.best_paths(network, scores[None], np.array([b - a]))[0]] + [0]
            at = 0
            while at < b - a:
                end = at + 1
                if tags[at]:
                    kind = (tags[at] - 1) // 2
                    while tags[end] == 2 + 2 * kind:
                        end += 1
                    s, e = pii._settled_span(text, a + at, a + end, kind)
                    if s < e and pii._plausible(text[s:e], kind) and all(e <= x or y <= s for x, y, _ in known):
                        found.add((s, e, kind))
                at = end
        want.append(sorted(found, key=lambda s: (s[0], s[2])))
    assert pii.added_spans(network, texts, base, settings) == want and any(want)


def test_a_long_run_of_numbers_takes_bounded_memory(network):
    import tracemalloc

    text = " ".join(str(k * 7919 % 1000003) for k in range(30_000))
    tracemalloc.start()
    pii.added_spans(network, [text, *["ring 030 1234567 soon"] * 511], [[]] * 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 200_000 and peak < 250e6


def test_windows_without_spans_hold_what_might_be_one():
    settings = pii.Settings()
    (near,) = pii._near("x" * 100 + " on 2024 " + "y" * 100, settings)
    codes, tags = pii._labelled([near], settings.window)
    assert not tags.any() and any(c - 0 == bilstm_crf.char_codes("2")[0] for c in codes[0])
    table = " ".join(f"{k:04d}" for k in range(400))
    assert len(pii._near(table, settings)) > 20  # one for every window of a long run


def test_secrets_of_unseen_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    assigned = {r.doc_id for r in rows if pii.ASSIGNED.search(r.text or "")}
    model = pii.fit(docs.where(~docs.doc_id.isin(list(assigned)[::2])))
    found = {r.doc_id for r in pii.digests(docs, model).collect() if "secret:" in r.spans}
    assert len(found & assigned) >= 0.9 * len(assigned) and len(found - assigned) <= 1


def test_written_out_addresses_are_followed_to_their_end():
    text = "ask jan.meier (at) mail dot example dot org now"
    start = text.index("(at)")
    s, e = pii._settled_span(text, start, start + 14, 0)
    assert text[s:e] == "jan.meier (at) mail dot example dot org"
    text = 'password="Tr0ub4dor3xYz89qLm"'
    s, e = pii._settled_span(text, 12, 20, pii.SECRET)
    assert text[s:e] == "Tr0ub4dor3xYz89qLm"


def test_main_text():
    assert html_density.main_text(PAGE) == "Title & more\nOne two three.\nFour five\ni1\ni2"
    assert html_density.main_text("<p>just <b>bold</b> &lt; text") == "just bold < text"
    assert html_density.main_text("") == html_density.main_text(None) == ""


def section(char, n):
    return f"<section>{f'<p>{char * n}</p>' * 3}</section>"


def lengths(html):
    return [len(x) for x in html_density.main_text(html).split("\n")]


def test_wrappers_named_like_boilerplate_keep_their_text():
    comments = f"<div class=comments><p>{'c' * 900}</p></div>"
    for name in ("content-sidebar-wrap", "has-sidebar", "ad-free", "related-work", "side-effects"):
        assert lengths(f'<body><div class="{name}"><article><h1>Title</h1>{section("a", 100)}</article></div>{comments}</body>') == [5, 100, 100, 100]
        assert lengths(f'<body><div class="{name}"><h1>Title</h1>{section("a", 100)}</div>{comments}</body>') == [5, 100, 100, 100]
    inside = f"<section class=related-work>{section('b', 90)}</section><div class=related-posts><ul><li><a>one</a><li><a>two</a></ul></div>"
    assert lengths(f"<body><article><h1>T</h1>{section('a', 100)}{inside}</article></body>") == [1, 100, 100, 100, 90, 90, 90]


def test_dense_neighbours_and_their_headings_are_kept():
    assert lengths(f"<body><div><h1>Ten letter</h1>{section('a', 400)}{section('b', 300)}</div></body>") == [10, 400, 400, 400, 300, 300, 300]


def test_forms_and_names_around_all_text_keep_it():
    prose, menu = section("a", 100), "<div class=menu><ul><li><a>one</a><li><a>two</a></ul></div>"
    whole = [100, 100, 100]
    assert lengths(f"<body><form id=aspnetForm>{menu}<label>Search</label><input><article>{prose}</article></form></body>") == whole
    for name in ("class=social", "id=side", "class='page comments'"):
        assert lengths(f"<body>{menu}<div {name}>{prose}</div><p>by us</p></body>") == whole
    assert lengths(f"<body>{prose}<form><label>Mail</label><p>{'f' * 90}</p></form><div class=comments><p>{'c' * 200}</p></div></body>") == whole
    assert lengths(f"<body><article>{prose}</article><article>{section('b', 80)}</article><div><p>{'x' * 60}</p></div></body>") == [*whole, 80, 80, 80]


def test_zero_width_space_is_no_space():
    assert html_density.main_text("<p>foo\u200bbar  baz\u00a0x</p>") == "foo\u200bbar baz x"


def test_long_and_deep_pages_take_linear_time():
    import time

    took = {}
    for n in (4_000, 16_000):
        begin = time.perf_counter()
        assert html_density.main_text("<b>" * n + "<p>x</p>" * n).count("x") == n
        assert "deep" in html_density.main_text("<div class=a-side>" * n + "<header>h</header><article>deep</article>")
        took[n] = time.perf_counter() - begin
    assert took[16_000] < 10 * took[4_000] + 1


def test_densities_equal_plain_arithmetic():
    import math
    from xml.etree import ElementTree

    page = f"<body><div><h1>Title here</h1><p>{'a' * 80} <a>link text</a> {'b' * 30}</p><p>{'c' * 50}</p></div><ul><li><a>one</a></li><li><a>two</a></li></ul></body>"
    size = lambda text: len(re.sub(r"\s+", "", text or ""))

    def plain(e):
        chars = size("".join(e.itertext()))
        below = [x for x in e.iter() if x is not e]
        links = [x for x in e.iter() if x.tag == "a"]
        return chars, max(len(below), 1), max(sum(size("".join(x.itertext())) for x in links), 1), max(sum(x is not e for x in links), 1)

    tree = ElementTree.fromstring(page)
    body_chars, _, body_links, _ = plain(tree)
    expected = []
    for e in tree.iter():
        c, t, lc, lt = plain(e)
        linked = sum(size("".join(x.itertext())) for x in e.iter("a"))
        base = max(math.log(c * lc / max(c - linked, 1) + body_links / body_chars * c + math.e), 1.0001)
        expected.append((e.tag, c / t * math.log(c * t / (lc * lt) + 1, base)))
    builder = html_density.Builder()
    builder.feed(page)
    body = builder.root.children[0]
    html_density._measure(body)
    got = [(n.tag, n.density) for n in html_density._below(body)]
    assert [t for t, _ in sorted(got)] == [t for t, _ in sorted(expected)]
    assert [d for _, d in sorted(got)] == pytest.approx([d for _, d in sorted(expected)])
    sums = {id(n): n.total for n in html_density._below(body)}
    own = sum(c.density for c in body.children if not isinstance(c, str))
    assert sums[id(body)] == pytest.approx(own)


def test_page_frames(spark, empty):
    pages = spark.createDataFrame([(1, "u", f"<p>{'w ' * 100_000}</p>", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    (row,) = html_density.extract(pages).collect()
    assert row.asDict().keys() == {"page_id", "url", "text", "n_chars"} and row.n_chars == 199_999
    assert html_density.extract(pages.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = html_density.extract(pages).join(pages.select("page_id", "html"), "page_id").collect()
    import html

    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", x).replace("<br>", " "))).strip() for x in re.split("</?p>|</?h1>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    nothing = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_density.extract(nothing).collect()) == [(0, "x"), (1, ""), (1, "")]


def test_block_max_wand_equals_all_scores(spark):
    items = [(r.item_id, r.text, *decontaminate.split_item(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Index(items, decontaminate.Bm25(threshold=0.25))
    step, seen = index.longest, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        h, _, _, first = wordhash.word_hashes(data, np.array([0, len(data)]), wordhash.ALPHANUMERIC)
        got = {(a, item): score for _, item, score, a, _ in index.search(h, first)}
        expected = {}
        for k in range(max(1, -(-(len(h) - step) // step)) if len(h) else 0):
            scores = np.zeros(len(index.ids))
            for term in set(index.lookup(h[k * step : k * step + 2 * step])[1].tolist()):
                for item, weight in index.postings[term]:
                    scores[item] += weight
            expected |= {(k * step, int(i)): scores[i] for i in np.flatnonzero(scores >= 0.25)}
        close = {k for k, s in expected.items() if s > 0.25 + 1e-5}
        assert close <= set(got) <= set(expected)
        seen += len(expected)
    assert seen > 5


def test_leaks(spark, odd, empty):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text} <= got
    split = decontaminate.leaks(docs, benchmark, decontaminate.Bm25(index_items=7, threshold=0.5))
    assert {(r.doc_id, r.item_id) for r in split.collect()} >= got
    # The same rows, scores included, at every block size.
    whole = sorted(map(tuple, decontaminate.leaks(docs, benchmark).collect()))
    for cut in ({"index_items": 1}, {"index_items": 9}, {"index_chars": 3_000}):
        assert sorted(map(tuple, decontaminate.leaks(docs, benchmark, decontaminate.Bm25(**cut)).collect())) == whole
    # No false ones: of every leak, the text holds 0.8 of the item's shingles or of both its parts.
    texts, by_id = {r.doc_id: r.text for r in docs.collect()}, dict(items)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    for doc_id, item_id in got:
        ours = words(texts[doc_id])
        shares = []
        for part in (by_id[item_id], *decontaminate.split_item(by_id[item_id])):
            n = min(5, len(words(part)))
            wanted = {tuple(words(part)[i : i + n]) for i in range(len(words(part)) - n + 1)} if n else set()
            held = {tuple(ours[i : i + n]) for i in range(len(ours) - n + 1)}
            shares.append(len(wanted & held) / len(wanted) if wanted else 1.0)
        assert shares[0] >= 0.8 or min(shares[1:]) >= 0.8
    assert decontaminate.leaks(odd, benchmark).count() == 0 and decontaminate.leaks(empty, benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_classifiers_on_held_out_rows(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    for made, label in ((quality_classifier.quality, "quality"), (toxicity.toxicity, "toxic")):
        rows = made(docs, labels).join(labels, "doc_id").where("held_out").collect()
        pos = np.array([r.score for r in rows if r[label] == 1])
        neg = np.array([r.score for r in rows if r[label] == 0])
        assert (pos[:, None] > neg[None]).mean() > 0.95
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        few = made(odd, labels).collect()
        assert len(few) == odd.count() and all(0 <= r.score <= 1 for r in few)
        assert made(empty, labels).count() == 0
        assert max(r.score for r in made(odd, labels.limit(0)).collect()) < 1e-9


def test_sample_is_bounded_and_repeatable(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    a = {r.doc_id for r in labelled.sample(labels, "toxic", 50).collect()}
    assert len(a) == 50 and a == {r.doc_id for r in labelled.sample(labels.repartition(7), "toxic", 50).collect()}
    assert all(zlib.crc32(str(i).encode()) % 5 for i in a)


def test_snapshots(spark):
    from limnoscope.llm import chat_collapse

    def talk(conv, *texts):
        return [(conv, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]

    rows = talk(1, "a", "b") + talk(2, "a", "b", "c") + talk(3, "a", "b", "c") + talk(4, "a", "x") + talk(5, "a") + talk(6, None, "b") + talk(6, None, "b")
    rows += talk(None, "n") + talk(8, *[f"t{k}" for k in range(600)]) + talk(9, *[f"t{k}" for k in range(599)]) + [(10, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = collections.defaultdict(list)
    for r in chat_collapse.maximal_turns(frame).collect():
        got[r.conv_id].append(r)
    assert set(got) == {2, 4, 6, None, 8, 10}
    assert [r.turn_no for r in sorted(got[8], key=lambda r: r.turn_no)] == list(range(1, 601))
    assert len(got[6]) == 2 and sorted(r.rendered for r in got[6])[0] == "<|assistant|>\nb<|end|>\n"
    assert chat_collapse.maximal_turns(frame.limit(0)).count() == 0
    # Columns with the operator's own names are not looked at.
    wide = frame.selectExpr("*", "'x' as part", "1 as n_turns", "2 as block", "3 as id")
    assert sorted(map(str, chat_collapse.maximal_turns(wide).collect())) == sorted(map(str, chat_collapse.maximal_turns(frame).collect()))


def test_crowded_blocks_of_turns_are_cut(spark):
    """Rows without an id and a conversation with few turn numbers: cut or not, every turn keeps its place."""
    from limnoscope.llm import chat_collapse

    rng = np.random.default_rng(8)
    rows = [(None, int(k % 3) if k % 7 else None, "user" if k % 2 else None, f"text {k}" if k % 11 else None) for k in range(900)]
    rows += [(1, 5, "user", f"{'same start ' * 30}{k}") for k in range(300)] + [(2, 5, "user", f"{'same start ' * 30}{k}") for k in range(299)]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(str, chat_collapse.maximal_turns(frame).collect()))
    assert sorted(map(str, chat_collapse.maximal_turns(frame, crowded=50).collect())) == whole
    turns, blocks = chat_collapse.hashed_turns(frame, 50)
    sizes = turns.where("conv_id is null").groupBy("block", "part").count().collect()
    assert blocks.where("conv_id is null").count() == len(sizes) > 30 and max(r["count"] for r in sizes) <= 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert differences(got, connect(SF).sql(ORACLES[name]).df()) is None
