"""Personal data and secrets: base patterns, and spans added by a character-level BiLSTM with CRF transitions.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers by their written form, in time linear in
the text. The network is trained from labelled spans: a bounded sample of windows whose labels are the base's spans and
the values assigned to names of secrets (tokens, keys, passwords), and the same spans rewritten in forms that the labels do
not know (numbers without a plus, other separators, "(at)", other assignments). Windows are drawn by hash over all places
of all documents, so numbers that are nothing personal are learned as well. It reads overlapping windows around every
character that any kind needs (a digit, "@" or a written-out at or dot); overlapping scores are averaged, the middle of a
window weighing most, and one best path is taken over the whole stretch. A decoded span counts if it touches no base span
and is plausible: as many digits as its kind needs, cards with their checksum, secrets as one long word of letters and
digits. A written-out address is followed to its end.

Memory: stretches are decoded in groups of a bounded number of characters; a longer one is a group of its own, with one
byte a tag for its way back.

Defined results: a null text counts as empty and has no spans; repeated rows have the same spans; extra columns stay in
`redact` and are not returned by `digests`; an empty table gives no rows and trains on the rewritten forms of fixed
examples. Whole texts are read, whatever their length. Positions are code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from limnoscope.llm import bilstm_crf as net
from limnoscope.llm.rows import free_name

#: Kinds of the base, and after them those that only the network finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SECRET = KINDS.index("secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[({]at[\])}]| dot ")
#: Labels of secrets to learn from; what is found in a text is the network's.
ASSIGNED = re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|bearer)[\"']?[ \t]{0,3}[:=]?[ \t]{0,3}[\"']?([A-Za-z0-9+/_-]{16,})")
SECRET_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=")
WRITTEN_ON = re.compile(r"(?: ?[\[({]dot[\])}] ?| dot |\.)[A-Za-z0-9-]+")
ANY_TRIGGER = re.compile(r"[0-9@]|[\[({]at[\])}]")


@dataclass(frozen=True)
class Settings:
    window: int = 48
    context: int = 14
    #: Labelled windows to learn from, at most; one per bucket of their hashes.
    max_windows: int = 1_500
    steps: int = 320
    #: Characters decoded at a time.
    cells: int = 40_000


Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _ips(text: str) -> list[Span]:
    """Four numbers joined by dots, taken from the left of each dotted run; runs of fewer match nothing."""
    out = []
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - len(parts) % 4, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in four):
                out.append((at, end, 1))
            at = end + 1
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by start, then kind."""
    if not text:
        return []
    out = _emails(text) if "@" in text else []
    if re.search("[0-9]", text):
        out += _ips(text)
        out += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


# Forms in which training examples are rewritten. d stands for the digits in turn.
PHONE_FORMS = ("(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "00d ddd ddd dddd", "0ddd ddddddd", "tel: ddd ddd dddd")
CARD_FORMS = ("dddd.dddd.dddd.dddd", "dddd/dddd/dddd/dddd", "dddd  dddd  dddd  dddd", "dddd_dddd_dddd_dddd")
AT_FORMS = (" (at) ", " [at] ", "(at)", "[at]", " {at} ", " @ ")
DOT_FORMS = (" dot ", " (dot) ", "[dot]", ".")
SECRET_FORMS = ('token = "{}"', "api_key: {}", "password={}", "secret: '{}'", "Authorization: Bearer {}", "ACCESS_KEY={}", 'key "{}"')
SECRET_LETTERS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
# Examples for a corpus without any.
EXAMPLES = ('set token = "9f86d081884c7d659a2feaa0c55ad015" there', "write to jan.meier@mail.example.org soon", "from 192.0.2.41 again", "card 4111111111111111 paid", "call +1 (212) 555-0187 now")


def _filled(form: str, digits: str) -> str:
    it = iter(digits * 3)
    return "".join(next(it) if c == "d" else c for c in form.replace("tel: ", ""))


def label_spans(text: str) -> list[Span]:
    """Spans to learn from: the base's and the values assigned to names of secrets."""
    base = base_spans(text)
    secrets = [(m.start(1), m.end(1), SECRET) for m in ASSIGNED.finditer(text) if _plausible(m.group(1), SECRET)]
    return sorted([*(s for s in base if all(s[1] <= x[0] or x[1] <= s[0] for x in secrets)), *secrets])


def _rewritten(text: str, span: Span, rng: np.random.Generator) -> tuple[str, Span] | None:
    """The window with one span in a form that the labels do not know."""
    start, end, kind = span
    found = text[start:end]
    if kind == SECRET:
        letters = SECRET_LETTERS[rng.integers(len(SECRET_LETTERS))]
        value = "".join(letters[k] for k in rng.integers(0, len(letters), int(rng.integers(20, 41))))
        before, _, after = SECRET_FORMS[rng.integers(len(SECRET_FORMS))].partition("{}")
        # The old name goes with its value.
        head = re.sub(r"[A-Za-z_-]+[\"']?[ \t]{0,3}[:=]?[ \t]{0,3}[\"']?$", "", text[:start]) + before
        return head + value + after + text[end:].lstrip("\"'"), (len(head), len(head) + len(value), SECRET)
    if kind == 0 and "@" in found:
        local, _, domain = found.partition("@")
        new = local + AT_FORMS[rng.integers(len(AT_FORMS))] + domain.replace(".", DOT_FORMS[rng.integers(len(DOT_FORMS))])
    elif kind == 2:
        new = _filled(CARD_FORMS[rng.integers(len(CARD_FORMS))], _digits(found))
    elif kind == 3:
        new = _filled(PHONE_FORMS[rng.integers(len(PHONE_FORMS))], _digits(found)[1:])
    else:
        return None
    return text[:start] + new + text[end:], (start, start + len(new), kind)


def _labelled(windows: list[str], size: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags (0, then begin and inside of each kind) of windows and their rewritten forms."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[str, list[Span]]] = []
    for text in windows:
        spans = label_spans(text)
        rows.append((text, spans))
        for span in spans:
            for _ in range(2):
                if (new := _rewritten(text, span, rng)) is not None:
                    others = [x for x in label_spans(new[0]) if x[1] <= new[1][0] or new[1][1] <= x[0]]
                    rows.append((new[0], sorted([*others, new[1]])))
    codes = np.zeros((len(rows), size), dtype=np.int64)
    tags = np.zeros((len(rows), size), dtype=np.int64)
    for k, (text, spans) in enumerate(rows):
        # A window without a span is placed around what might look like one.
        trigger = TRIGGER.search(text)
        first = min((s[0] for s in spans), default=trigger.start() if trigger else 0)
        longest = max((s[1] - s[0] for s in spans), default=0)
        skip = max(0, first - int(rng.integers(0, max(1, size - min(longest, size - 1)))))
        c = net.char_codes(text[skip : skip + size])
        codes[k, : len(c)] = c
        for start, end, kind in spans:
            a, b = max(0, start - skip), min(size, end - skip)
            if a < b:
                tags[k, a:b] = 2 + 2 * kind
                if start >= skip:
                    tags[k, a] = 1 + 2 * kind
    return codes, tags


def _near(text: str, settings: Settings) -> list[str]:
    """Stretches of three windows around all places with triggers, one for every window of a long run."""
    out = []
    for a, b in stretches(text, settings):
        for at in range(a + settings.context, b - settings.context + 1, settings.window):
            out.append(text[max(0, at - settings.window) : at + 2 * settings.window])
    return out


def windows_of(docs: DataFrame, settings: Settings = Settings(), column: str = "text") -> list[str]:
    """At most `max_windows` stretches around triggers: of all documents' stretches, the least hash in each bucket.

    Buckets are folded in every batch and before the shuffle, so a task sends `max_windows` stretches at most.
    """

    def run(batches):
        for batch in batches:
            least: dict[int, tuple[int, str]] = {}
            for text in batch.column("text"):
                for near in _near(text.as_py() or "", settings):
                    raw = near.encode()
                    bucket, rank = zlib.crc32(raw) % settings.max_windows, zlib.adler32(raw)
                    if bucket not in least or (rank, near) < least[bucket]:
                        least[bucket] = (rank, near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(least), pa.int32()), pa.array([r for r, _ in least.values()], pa.int64()), pa.array([t for _, t in least.values()], pa.string())],
                names=["bucket", "rank", "near"],
            )

    found = docs.select(F.col(column).cast("string").alias("text")).mapInArrow(run, "bucket int, rank long, near string")
    picked = found.groupBy("bucket").agg(F.min(F.struct("rank", "near")).alias("first"))
    return [r.near for r in sorted(picked.select("bucket", "first.near").collect(), key=lambda r: r.bucket)]


def fit(docs: DataFrame, settings: Settings = Settings(), column: str = "text") -> dict[str, np.ndarray]:
    """Network trained on a bounded sample of the documents' own windows."""
    windows = windows_of(docs, settings, column) + list(EXAMPLES)
    codes, tags = _labelled(windows, settings.window)
    return {k: v.astype(np.float32) for k, v in net.train(codes, tags, 1 + 2 * len(KINDS), settings.steps).items()}


def stretches(text: str, settings: Settings) -> list[tuple[int, int]]:
    """Merged neighbourhoods of all triggers."""
    out: list[list[int]] = []
    if not ANY_TRIGGER.search(text):
        return []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - settings.context), min(len(text), m.end() + settings.context)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scores(model: dict, texts: list[str], size: int) -> list[np.ndarray]:
    """Tag scores of whole stretches: overlapping windows, averaged with the middle weighing most."""
    step = size // 2
    places, codes = [], []
    for k, text in enumerate(texts):
        c = net.char_codes(text).astype(np.uint8)
        for at in range(0, max(1, len(c) - step), step):
            part = np.zeros(size, dtype=np.uint8)
            part[: len(c[at : at + size])] = c[at : at + size]
            places.append((k, at))
            codes.append(part)
    weight = (1.0 + np.minimum(np.arange(size), np.arange(size)[::-1])[:, None]).astype(np.float32)
    out = [np.zeros((len(t), 1 + 2 * len(KINDS)), dtype=np.float32) for t in texts]
    held = [np.zeros((len(t), 1), dtype=np.float32) for t in texts]
    for first in range(0, len(codes), 1024):
        for (k, at), e in zip(places[first : first + 1024], net.emissions(model, np.stack(codes[first : first + 1024]))):
            n = min(size, len(out[k]) - at)
            out[k][at : at + n] += (e * weight)[:n]
            held[k][at : at + n] += weight[:n]
    return [o / h for o, h in zip(out, held)]


def _plausible(text: str, kind: int) -> bool:
    digits = _digits(text)
    if kind == SECRET:
        varied = len(set(text)) >= 8 and digits and any(c.isalpha() for c in text)
        return len(text) >= 16 and bool(varied) and SECRET_SIGNS.issuperset(text)
    if kind == 0:
        return bool(re.search(r"@|[\[({]at[\])}]", text)) and bool(re.search(r"[A-Za-z0-9](\.|\W+dot\W+)[A-Za-z]", text))
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if any(c.isalpha() for c in text):
        return False
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def _settled_span(text: str, s: int, e: int, kind: int) -> tuple[int, int]:
    """A decoded span trimmed to its outer letters, digits and opening signs, then widened to whole words and numbers."""
    while s < e and not (text[s].isalnum() or text[s] in "+("):
        s += 1
    while e > s and not text[e - 1].isalnum():
        e -= 1
    belongs = SECRET_SIGNS.__contains__ if kind == SECRET else str.isalnum
    # A sign of equality may end a secret; before one it assigns it.
    while s < e and s > 0 and belongs(text[s]) and belongs(text[s - 1]) and text[s - 1] != "=":
        s -= 1
    if kind == SECRET and "=" in text[s:e].rstrip("="):
        s += text[s:e].rstrip("=").rindex("=") + 1
    while s < e < len(text) and belongs(text[e]):
        e += 1
    if kind == 0:
        if text[s : s + 1] in ("(", "[", "{") and text[s - 1 : s] == " " and s > 1 and text[s - 2] in LOCAL:
            s -= 1
        while s < e and s > 0 and text[s - 1] in LOCAL:
            s -= 1
        if m := re.search(r" [\[({]?dot$", text[s:e]):
            e = s + m.start()
        while m := WRITTEN_ON.match(text, e):
            e = m.end()
    return s, e


def _groups(where: list[tuple[int, int, int]], cells: int) -> list[list[tuple[int, int, int]]]:
    """Stretches of like length, as many together as padded to the longest fit into `cells` characters."""
    out: list[list[tuple[int, int, int]]] = []
    for w in sorted(where, key=lambda w: w[2] - w[1]):
        if out and (len(out[-1]) + 1) * (w[2] - w[1]) <= cells:
            out[-1].append(w)
        else:
            out.append([w])
    return out


def added_spans(model: dict, texts: list[str], base: list[list[Span]], settings: Settings = Settings()) -> list[list[Span]]:
    """Spans of the network that touch no base span, for each text."""
    out: list[list[Span]] = [[] for _ in texts]
    starts = [[x[0] for x in sorted(b)] for b in base]
    ends = [list(accumulate((x[1] for x in sorted(b)), max)) for b in base]
    where = [(k, a, b) for k, t in enumerate(texts) for a, b in stretches(t, settings)]
    for group in _groups(where, settings.cells):
        parts = [texts[k][a:b] for k, a, b in group]
        scores = _scores(model, parts, settings.window)
        lengths = np.array([len(p) for p in parts])
        padded = np.zeros((len(parts), lengths.max(), scores[0].shape[1]), dtype=np.float32)
        for k, s in enumerate(scores):
            padded[k, : len(s)] = s
        del scores
        for (k, a, _), tags, n in zip(group, net.best_paths(model, padded, lengths), lengths):
            live = np.flatnonzero(tags[:n])
            at = 0
            while at < len(live):
                first = int(live[at])
                kind, end = (int(tags[first]) - 1) // 2, first + 1
                while end < n and tags[end] == 2 + 2 * kind:
                    end += 1
                at = int(np.searchsorted(live, end))
                s, e = _settled_span(texts[k], a + first, a + end, kind)
                # Base spans that begin before the end reach no further than the start.
                before = bisect_left(starts[k], e)
                if s < e and (before == 0 or ends[k][before - 1] <= s) and _plausible(texts[k][s:e], kind):
                    out[k].append((s, e, kind))
    return [sorted(set(x), key=lambda s: (s[0], s[2])) for x in out]


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def digests(docs: DataFrame, model: dict, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) per row of `docs` (doc_id, text).

    Counts and digest are the base's; `spans` holds all spans and `n_added` is the number of the network's.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(sent.value, texts, base, settings)
            every = [sorted(a + b, key=lambda s: (s[0], s[2])) for a, b in zip(base, more)]
            counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in range(len(BASE_KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *counts, pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b in base]),
                    pa.array([_written(e) for e in every], pa.string()), pa.array([len(m) for m in more], pa.int64()),
                ],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return rows.mapInArrow(run, f"doc_id long, {kinds}, base_sha256 string, spans string, n_added long")


def _masked(text: str, spans: list[Span]) -> str:
    """Every span, overlapping ones merged, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: dict, column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """`docs` with personal data in the column replaced by its kind in angle brackets; nulls stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = free_name(docs, "masked")

    def run(batches):
        for batch in batches:
            given = batch.column(column).to_pylist()
            texts = [t or "" for t in given]
            base = [base_spans(t) for t in texts]
            more = added_spans(sent.value, texts, base, settings)
            done = [None if g is None else _masked(t, sorted(a + b, key=lambda s: (s[0], s[2]))) for g, t, a, b in zip(given, texts, base, more)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string())], names=[*batch.schema.names, key])

    schema = StructType([*docs.schema.fields, StructField(key, StringType())])
    order = [F.col(key).alias(c) if c == column else F.col(f"`{c}`") for c in docs.columns]
    return docs.mapInArrow(run, schema).select(*order)
