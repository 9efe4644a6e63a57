"""Offset-preserving encoding and decoding with a public BPE SentencePiece model.

The text is normalised by the longest prefix in the model's compiled character map while every normalised character
keeps the original bytes it came from; spaces become U+2581 and a prefix space is added. Pieces are merged by score,
leftmost first, and each piece is projected to the original byte span. Characters without a piece fall back to bytes.

A merge never crosses two neighbouring characters that no piece holds side by side, so a text falls into chunks that
are encoded alone and remembered per task. The memory is emptied when full; results do not depend on it.

Defined results: a null text counts as empty and has no ids; repeated rows encode alike; extra columns stay in
`encode` and are not returned by `digests`; an empty table gives no rows. Whole texts are encoded, whatever their
length. Byte pieces that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from limnoscope.llm.rows import free_name

SPACE = "▁"
#: Characters of chunks that a worker remembers: some 130 MB with their ids.
REMEMBERED = 4_000_000
#: Ids in a batch of results.
BATCH_IDS = 200_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """Prefix to replacement, read out of a compiled map: a double-array trie, then the replacements ending in 0."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    texts = blob[4 + size :]
    out: dict[bytes, bytes] = {}
    step = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
    todo = [(step(units[0]), b"")]
    while todo:
        base, prefix = todo.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at >= len(units) or units[at] & ((1 << 31) | 255) != byte:
                continue
            unit = units[at]
            below = at ^ step(unit)
            if unit & (1 << 8):
                start = units[below] & ((1 << 31) - 1)
                out[prefix + bytes([byte])] = texts[start : texts.index(b"\0", start)]
            todo.append((below, prefix + bytes([byte])))
    return out


@dataclass
class Model:
    """Pieces, scores and normaliser of a model file; only BPE models without user-defined pieces."""

    ids: dict[str, int]
    scores: dict[str, float]
    pieces: list[str]
    kinds: list[int]
    mapped: dict[bytes, bytes]
    prefix_space: bool
    squeeze: bool
    chunk: re.Pattern = field(init=False)
    memory: dict = field(default_factory=dict)
    remembered: int = 0

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, kinds, norm, trainer = [], [], [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                d = dict(_fields(value))
                pieces.append(d[1].decode())
                scores.append(struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0])
                kinds.append(d.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2 or {4, 5} & set(kinds):
            raise ValueError("only BPE models without user-defined or unused pieces can be read")
        normal = [k for k, kind in enumerate(kinds) if kind == 1]
        return cls(
            {pieces[k]: k for k in normal}, {pieces[k]: scores[k] for k in normal}, pieces, kinds,
            character_map(norm.get(2, b"")), bool(norm.get(3, 1)), bool(norm.get(4, 1)),
        )

    def __post_init__(self) -> None:
        several = [p for p in self.ids if len(p) > 1]
        joined = set(chain.from_iterable(several))
        crossing = any(b == SPACE != a for p in several for a, b in zip(p, p[1:]))
        bytes_ = [k for k, kind in enumerate(self.kinds) if kind == 6]
        self.byte_ids = {int(self.pieces[k][3:5], 16): k for k in bytes_}
        self.unknown = self.kinds.index(2)
        self.names = [str(k) for k in range(len(self.pieces))]
        # A run of spaces starts a chunk; characters that stand in no longer piece are chunks of their own.
        alone = re.escape("".join(chr(c) for c in range(9, 127) if chr(c) != " " and chr(c) not in joined))
        lone = f"[{alone}]|" if alone else ""
        # Unknown characters merge with nothing, so each is a piece of its own.
        self.chunk = re.compile(r"[\s\S]+" if crossing else f"{lone}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")
        # Text of each id where it does not hang on its neighbours; the others are decoded one by one.
        self.plain = [chr(int(p[3:5], 16)) if k == 6 else p.replace(SPACE, " ") for p, k in zip(self.pieces, self.kinds)]
        self.special = {k for k, kind in enumerate(self.kinds) if kind in (2, 3) or kind == 6 and int(self.pieces[k][3:5], 16) > 127}
        byte = [int(p[3:5], 16) if k == 6 else 0 for p, k in zip(self.pieces, self.kinds)]
        self.is_byte = np.array([k == 6 for k in self.kinds])
        self.continues = np.array([128 <= b < 192 for b in byte])
        self.lengths = np.array([len(p) for p in self.pieces])
        self.sizes = np.where(self.is_byte, 1, [len(p.replace(SPACE, " ").encode()) for p in self.pieces])

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """Normalised text and the original byte length of every character; None where it is the plain length."""
        if not text:
            return "", None
        if not self.mapped and not self.squeeze and SPACE not in text:
            return (SPACE if self.prefix_space else "") + text.replace(" ", SPACE), None
        out, lengths, raw, at = [], [], text.encode(), 0
        longest = max(map(len, self.mapped), default=0)
        while at < len(raw):
            size = next((n for n in range(min(longest, len(raw) - at), 0, -1) if raw[at : at + n] in self.mapped), 0)
            if size:
                new = self.mapped[raw[at : at + size]].decode()
            else:
                size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                new = raw[at : at + size].decode()
            # The first character of a replacement owns the replaced bytes; bytes mapped to nothing go to the next one.
            out.append(new)
            lengths.append((size, len(new)))
            at += size
        chars, owned, carried = [], [], 0
        for new, (size, n) in zip(out, lengths):
            carried += size
            for k, c in enumerate(new):
                c = SPACE if c == " " else c
                if self.squeeze and c == SPACE and (not chars or chars[-1] == SPACE):
                    continue
                chars.append(c)
                owned.append(carried)
                carried = 0
        if self.squeeze:
            while chars and chars[-1] == SPACE:
                chars.pop()
                owned.pop()
        if chars and self.prefix_space:
            chars.insert(0, SPACE)
            owned.insert(0, 0)
        return "".join(chars), owned

    def merge(self, chunk: str) -> list[str]:
        """Pieces of one chunk: the best-scored pair first, the leftmost among equals."""
        if len(chunk) > 64:
            return self._merge_long(chunk)
        get, none = self.scores.get, float("-inf")
        parts = list(chunk)
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def _merge_long(self, chunk: str) -> list[str]:
        """The same for long chunks: pairs wait in a heap, so time stays near the length."""
        scores = self.scores
        parts = list(chunk)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-scores[parts[k] + parts[k + 1]], k, parts[k] + parts[k + 1]) for k in range(n - 1) if parts[k] + parts[k + 1] in scores]
        heapq.heapify(heap)
        while heap:
            _, k, piece = heapq.heappop(heap)
            r = right[k]
            if not parts[k] or r >= n or parts[k] + parts[r] != piece:
                continue
            parts[k], parts[r] = piece, ""
            right[k] = right[r]
            if right[k] < n:
                left[right[k]] = k
                after = piece + parts[right[k]]
                if after in scores:
                    heapq.heappush(heap, (-scores[after], k, after))
            if left[k] >= 0:
                before = parts[left[k]] + piece
                if before in scores:
                    heapq.heappush(heap, (-scores[before], left[k], before))
        return [p for p in parts if p]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of one chunk; a character without a piece gives its bytes."""
        out = []
        for piece in self.merge(chunk):
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode_ids(self, norm: str) -> list[int]:
        """Ids of a normalised text. Chunks met before are remembered; the memory is emptied when full."""
        memory = self.memory
        if self.remembered > REMEMBERED:
            memory.clear()
            self.remembered = 0
        chunks = self.chunk.findall(norm)
        for c in set(chunks).difference(memory):
            memory[c] = self._chunk(c)
            self.remembered += len(c)
        out = list(chain.from_iterable(map(memory.__getitem__, chunks)))
        for c in self.long_chunks(chunks):
            if memory.pop(c, None) is not None:
                self.remembered -= len(c)
        return out

    @staticmethod
    def long_chunks(chunks: list[str]) -> list[str]:
        """Chunks too long to be worth remembering."""
        return [c for c in chunks if len(c) > 100]

    def spans(self, ids: list[int], norm: str, owned: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end byte of each id in the original text.

        A piece's characters are summed up along the text and projected by the bytes each of them owns. Of the bytes
        that stand for one character, the last one's piece covers it; those before it are empty spans at its start.
        """
        at = np.array(ids, dtype=np.int64)
        if not len(at):
            return at, at
        if owned is None and self.unknown not in ids:
            # Without a character map a piece covers its own bytes, a space one, the added space none.
            ends = np.cumsum(self.sizes[at]) - int(self.prefix_space)
        else:
            follows = np.append(self.continues[at[1:]], False)
            chars = np.where(self.is_byte[at], ~follows, self.lengths[at])
            if self.unknown in ids:  # each unknown piece is one character of the text
                chars = np.where(at == self.unknown, 1, chars)
            bytes_ = owned or [0 if self.prefix_space and k == 0 else 1 if c == SPACE else len(c.encode()) for k, c in enumerate(norm)]
            ends = np.concatenate([[0], np.cumsum(bytes_)])[np.cumsum(chars)]
        return np.maximum(np.concatenate([[0], ends[:-1]]), 0), ends

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids and each id's begin and end byte in the original text."""
        norm, owned = self.normalise(text or "")
        ids = self.encode_ids(norm) if norm else []
        return ids, *self.spans(ids, norm, owned)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: spaces restored, the added one removed, byte pieces joined to characters."""
        if ids and not self.squeeze and self.kinds[ids[0]] == 1 and self.special.isdisjoint(ids):
            text = "".join(map(self.plain.__getitem__, ids))
            return text[1:] if self.prefix_space and text.startswith(" ") else text
        out, run, first = [], bytearray(), True
        for k in ids:
            if self.kinds[k] == 6:
                run.append(int(self.pieces[k][3:5], 16))
                continue
            if run:
                out.append(_from_bytes(run))
                run, first = bytearray(), False
            if self.kinds[k] == 3:
                continue
            piece = " ⁇ " if self.kinds[k] == 2 else self.pieces[k].replace(SPACE, " ")
            if first and self.prefix_space and piece.startswith(" "):
                piece = piece.lstrip(" ") if self.squeeze else piece[1:]
            first = False
            out.append(piece)
        if run:
            out.append(_from_bytes(run))
        return "".join(out)


def _from_bytes(run: bytearray) -> str:
    """Whole characters of a run of bytes; each byte that starts none becomes U+FFFD."""
    out, at, raw = [], 0, bytes(run)
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def _loaded(data: bytes) -> Model:
    """One model per worker process, with what it remembers."""
    return Model.parse(data)


def encode(docs: DataFrame, model_path: str, column: str = "text") -> DataFrame:
    """Adds ids, begins and ends (arrays) for the column's text; columns of those names are replaced."""
    data = _model_bytes(docs, model_path)
    key = free_name(docs, "codec")
    rows = docs.withColumn(key, F.coalesce(F.col(column).cast("string"), F.lit(""))).drop("ids", "begins", "ends")
    added = [StructField(n, ArrayType(kind)) for n, kind in (("ids", IntegerType()), ("begins", LongType()), ("ends", LongType()))]
    schema = StructType([*(f for f in rows.schema.fields if f.name != key), *added])

    def run(batches):
        model = _loaded(data.value)
        for batch in batches:
            got = [model.encode(t) for t in batch.column(key).to_pylist()]
            kept = [c for c in batch.schema.names if c != key]
            arrays = [pa.array([g[k] for g in got], pa.list_(pa.int64() if k else pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, "ids", "begins", "ends"])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, column: str = "ids", out: str = "text") -> DataFrame:
    """(out) replaced by the text of the ids in `column`; null ids decode to the empty text."""
    data = _model_bytes(rows, model_path)

    @F.pandas_udf("string")
    def to_text(ids):
        model = _loaded(data.value)
        return ids.map(lambda x: "" if x is None else model.decode(list(x)))

    return rows.withColumn(out, to_text(F.col(column)))


def digests(docs: DataFrame, model_path: str, column: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, last_end): ids and decoded text as digests, the last span's end.

    With `with_ids`, the ids follow as an array.
    """
    data = _model_bytes(docs, model_path)

    def run(batches):
        model = _loaded(data.value)
        names, kinds = model.names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        titles = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "last_end", *(["ids"] if with_ids else [])]
        for batch in batches:
            # One text at a time and one flat buffer of ids; a batch of results ends when that is full.
            rows, flat = [], array("i")

            def results():
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([r[1] for r in rows])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, dtype=np.int32))))
                return pa.RecordBatch.from_arrays(columns, names=titles)

            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids, _, end = model.encode(text.as_py())
                coded = hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest()
                rows.append((doc_id.as_py(), len(ids), coded, hashlib.sha256(model.decode(ids).encode()).hexdigest(), int(end[-1]) if len(end) else 0))
                if with_ids:
                    flat.extend(ids)
                if len(flat) >= BATCH_IDS:
                    yield results()
                    rows, flat = [], array("i")
            if rows:
                yield results()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, last_end long" + (", ids array<int>" if with_ids else ""))


def _model_bytes(df: DataFrame, path: str):
    """The model file, sent once to every executor; vocabularies are half a megabyte."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())
