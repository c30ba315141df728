"""Byte-level BPE over content-defined chunks: shared chunks are encoded once, joins are repaired.

A rolling hash over the last bytes cuts every text into chunks, so that equal passages give equal
chunks wherever they stand.  A chunk's inside, from its first to its last safe break, is encoded on
its own and kept in a bounded memory of the worker process, which outlives tasks; documents that
share the chunk take its ids from there.  At a join of two chunks, the stretch from the last safe
break of the left one to the first of the right one is encoded again; where a chunk has no safe break
the stretch takes in the whole chunk and goes on, until both ends agree with what stands beside them.

A safe break is a byte position that every context tokenizes alike: before white space that follows
anything else (no token of the pattern holds white space after other characters, and none looks
back), and around special tokens, which the tokenizer takes out first.
"""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import arrow_map

CHUNK_BITS = 8  # chunks of 2**8 bytes on average
CHUNK_MEMORY = 16 << 20  # bytes of chunks and their ids kept per worker process, in two generations
WORD_MEMORY = 16 << 20  # the same for the stretches between two safe breaks, of which chunks are made
_WINDOW_STEPS = 5  # the rolling hash covers 2**5 bytes
#: The split pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_symbol() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Memo:
    """Bounded map in two generations: what is asked for again stays, the rest goes."""

    def __init__(self, bound: int) -> None:
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.half, self.held = bound // 2, 0

    def get(self, key: bytes) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: bytes, value: bytes) -> None:
        self.new[key] = value
        self.held += len(key) + len(value) + 170  # with the objects that hold them

    def turn(self) -> None:
        if self.held >= self.half:
            self.new, self.old, self.held = {}, self.new, 0


class Vocabulary:
    """What a tokenizer file says: bytes of every id, ranks and special tokens.  Enough to decode."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level tokenizer without prefix space or normalizer is needed")
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in their neighbours are not supported")
        self.special = {t["content"].encode(): int(t["id"]) for t in added}
        alphabet = byte_of_symbol()
        symbols = spec["model"]["vocab"]
        self.ranks = {bytes(alphabet[c] for c in symbol): i for symbol, i in symbols.items() if symbol.encode() not in self.special}
        self.bytes_of = {i: piece for piece, i in self.ranks.items()} | {i: s for s, i in self.special.items()}
        joined = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"])
        ids = [symbols[j] for j in joined]
        self.in_order = ids == sorted(set(ids))  # ids rise in the order of merges, so they are ranks

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included; ids out of the vocabulary give nothing."""
        known = self.bytes_of
        return b"".join([known.get(i, b"") for i in ids]).decode("utf-8", "replace")


class ChunkCoder(Vocabulary):
    """Encodes with one tokenizer file; one per worker process."""

    def __init__(self, path: str, chunk_bits: int = CHUNK_BITS) -> None:
        super().__init__(path)
        self.path = path
        self.special_pattern = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.ranked = None
        if self.in_order:
            import tiktoken

            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.mask = np.uint32((1 << chunk_bits) - 1) << np.uint32(32 - chunk_bits)
        self.gear = np.random.default_rng(1).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.before = np.ones(256, bool)  # bytes that never end a white-space character
        self.before[[*range(33), *range(0x80, 0x8B), 0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F]] = False
        self.latin = regex.compile(rb"(?:[\x21-\x7e]|[\xc3-\xc8][\x80-\xbf])+")
        self.length = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        self.length[list(self.bytes_of)] = [len(v) for v in self.bytes_of.values()]
        self.chunks = Memo(CHUNK_MEMORY)
        self.words = Memo(WORD_MEMORY)

    @cached_property
    def library(self):
        """The tokenizer itself, loaded when a text needs it."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    # -- encoding -------------------------------------------------------------------------------

    def _encode(self, piece: bytes) -> bytes:
        """Ids of a stretch between safe breaks, as little-endian 32-bit integers."""
        if (i := self.special.get(piece)) is not None:
            return np.int32(i).tobytes()
        text = piece.decode()
        if self.ranked is not None and (piece.isascii() or max(text) < "ɐ"):
            return self.ranked.encode_to_numpy(text, disallowed_special=()).tobytes()
        # beyond Latin letters, Unicode classes may differ between libraries: ask the tokenizer itself
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Content-defined cut positions: the hash of the bytes before them has its top bits clear."""
        h = self.gear[data]
        for k in range(_WINDOW_STEPS):
            step = 1 << k
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        return np.flatnonzero((h & self.mask) == 0) + 1

    def _breaks(self, raw: bytes, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Safe breaks, and those at which pieces must end (texts and special tokens)."""
        n = len(data)
        safe = np.zeros(n + 1, bool)
        safe[1:n] = self.space[data[1:]] & self.before[data[:-1]]
        forced = [ends]
        if self.special_pattern is not None:
            spans = [m.span() for m in self.special_pattern.finditer(raw)]
            for a, b in spans:
                safe[a + 1 : b] = False
            forced.append(np.array(spans, np.int64).ravel())
        must = np.concatenate(forced)
        safe[must] = True
        return np.flatnonzero(safe), must

    def encode(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie side by side in `raw`; `ends` has their n + 1 limits, as has the answer."""
        ends = np.asarray(ends, np.int64)
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        safe, must = self._breaks(raw, data, ends)
        cuts = self._cuts(data)
        cuts = cuts[cuts < len(data)]
        left = safe[np.searchsorted(safe, cuts, "right") - 1]
        right = safe[np.searchsorted(safe, cuts, "left")]
        limit = np.zeros(len(data) + 1, bool)
        limit[left] = limit[right] = limit[must] = True
        limits = np.flatnonzero(limit)
        at, inner, stops = limits.tolist(), np.searchsorted(safe, limits).tolist(), safe.tolist()
        out: list[bytes | None] = []
        words: list[bytes] = []  # of joins and of chunks that no text had before
        todo: list[tuple[int, int]] = []  # which piece they make up, and where its words end
        seen: dict[bytes, int] = {}
        again: list[tuple[int, int]] = []
        for k in range(len(at) - 1):
            piece, i, j = raw[at[k] : at[k + 1]], inner[k], inner[k + 1]
            ids = self.chunks.get(piece) if j - i > 1 else None
            if ids is None and j - i > 1 and piece in seen:
                again.append((k, seen[piece]))
            elif ids is None:
                if j - i > 1:
                    seen[piece] = k
                words += [raw[a:b] for a, b in zip(stops[i:j], stops[i + 1 : j + 1])]
                todo.append((k, len(words)))
            out.append(ids)
        of = self._words(words)
        start = 0
        for k, end in todo:
            out[k] = b"".join(of[start:end]) if end - start > 1 else of[start]
            start = end
        for piece, k in seen.items():
            self.chunks.put(piece, out[k])
        for k, first in again:
            out[k] = out[first]
        self.chunks.turn()
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        before = np.concatenate([[0], np.cumsum(sizes)]) // 4
        return np.frombuffer(b"".join(out), np.int32), before[np.searchsorted(limits, ends)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of stretches between neighbouring safe breaks; those not in memory are encoded together."""
        memo = self.words
        fresh = []
        for w in set(words):
            if w not in memo.new and memo.get(w) is None:
                fresh.append(w)
        plain = [w for w in fresh if self._joinable(w)]
        for w in fresh if len(plain) < 2 else set(fresh).difference(plain):
            memo.put(w, self._encode(w))
        if len(plain) > 1:
            # each starts with a space and ends otherwise, so all breaks between them are safe
            ids = self.ranked.encode_to_numpy(b"".join(plain).decode(), disallowed_special=())
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(w) for w in plain])) + 1
            for w, a, b in zip(plain, [0, *ends.tolist()], ends.tolist()):
                memo.put(w, ids[a:b].tobytes())
        found = list(map(memo.new.__getitem__, words))
        memo.turn()
        return found

    def _joinable(self, w: bytes) -> bool:
        """One space, then no white space at all, and Latin letters at most: no byte from 0xC9 on."""
        return self.ranked is not None and w[0] == 32 and len(w) > 1 and self.latin.fullmatch(w, 1) is not None


_CODERS: dict[tuple[str, int], ChunkCoder] = {}
_VOCABULARIES: dict[str, Vocabulary] = {}


def coder(path: str, chunk_bits: int = CHUNK_BITS) -> ChunkCoder:
    """The process's coder: its memory of chunks serves all tasks that the worker runs."""
    if (path, chunk_bits) not in _CODERS:
        _CODERS[path, chunk_bits] = ChunkCoder(path, chunk_bits)
    return _CODERS[path, chunk_bits]


def flat(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a string column side by side and their limits; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    limits = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = data[limits[0] : limits[-1]].to_pybytes() if data is not None else b""
    return raw, limits - limits[0]


def _encoded(b: pa.RecordBatch, worker: ChunkCoder) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    ids, limits = worker.encode(*flat(b.column(1)))
    return ids, limits, pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, tokenizer: str | None = None, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text.

    Null and empty texts give an empty array; repeated rows and null ids are kept; other columns of
    `docs` are left out, whatever their names.  No shuffle: rows stay where they were read.
    """

    def make():
        worker = coder(tokenizer or default_tokenizer(), chunk_bits)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), _encoded(b, worker)[2]], ["doc_id", "ids"])

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>")


def encode_and_decode(docs: DataFrame, tokenizer: str | None = None, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """decode(encode(docs)) in one pass: a row's ids are decoded by the worker that made them."""

    def make():
        worker = coder(tokenizer or default_tokenizer(), chunk_bits)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, limits, lists = _encoded(b, worker)
            texts = [worker.decode(ids[i:j].tolist()) for i, j in zip(limits.tolist(), limits[1:].tolist())]
            return pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>, text string")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids and text of every row of ids; a null array gives an empty text."""

    def make():
        path = tokenizer or default_tokenizer()
        if path not in _VOCABULARIES:
            _VOCABULARIES[path] = Vocabulary(path)
        worker = _VOCABULARIES[path]

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [worker.decode(ids or []) for ids in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

        return batch

    return arrow_map(encoded.select("doc_id", "ids"), make, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text."""
    joined: Column = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return digests(encode_and_decode(docs, tokenizer))
