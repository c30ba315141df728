"""SentencePiece BPE with source alignment: every piece knows the bytes of the text that it stands for.

A text is normalised first: at each place the longest key of the model's compiled character map (a
double array over bytes) is replaced, else one character stands for itself; spaces become the space
symbol.  Each normalised character records where its source began.  Pieces never hold the space symbol
behind another character, so merges never cross such a place and the normalised text falls into words
there; a word is merged by the model's scores, highest first, leftmost among equals, and kept in a
bounded memory of the worker.  Characters without a piece become byte pieces.  The lengths of the
pieces in characters then lead back through the alignment to byte spans of the text.
"""

from __future__ import annotations

import bisect
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import arrow_map

SPACE = "▁"  # stands for a space in pieces
WORD_MEMORY = 32 << 20  # bytes of words and their ids kept per worker process
LONG_WORD = 64  # longer words are merged one by one
CELLS = 1 << 18  # characters of padded words that are merged at once
TEXT_HELD = 1 << 20  # characters that are encoded together; a longer text is encoded alone, in stretches

# -- the model file ---------------------------------------------------------------------------------

#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer: an integer, or the bytes of anything else."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """Longest-prefix lookup in a compiled character map; an empty map leaves all as it is."""

    def __init__(self, compiled: bytes) -> None:
        self.units: list[int] = []
        self.strings, self.first = b"", frozenset()
        if compiled:
            size = struct.unpack("<I", compiled[:4])[0]
            self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
            self.strings = compiled[4 + size :]
            root = self._offset(self.units[0])
            self.first = frozenset(c for c in range(256) if c ^ root < len(self.units) and self.units[c ^ root] & 0x800000FF == c)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes that the longest key at `at` takes, and what takes their place."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit & 256:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(b"\0", start)]


class Model:
    """What a SentencePiece BPE model says: pieces with scores, kinds, and how texts are normalised."""

    def __init__(self, raw: bytes) -> None:
        pieces, trainer, normalizer = [], {}, {}
        for field, value in message(raw):
            if field == 1:
                parts = dict(message(value))
                pieces.append((parts[1].decode(), struct.unpack("<f", parts.get(2, b"\0\0\0\0"))[0], parts.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(message(value))
            elif field == 3:
                normalizer = dict(message(value))
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("a BPE model with byte fallback and spaces before words is needed")
        if odd := {kind for *_, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"pieces of kinds {sorted(odd)} are not supported")
        self.charmap = CharacterMap(normalizer.get(2, b""))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.less_space = bool(normalizer.get(4, 1))  # no spaces at the ends, one between words
        self.space = SPACE if normalizer.get(5, 1) else " "
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        self.kinds = np.array([kind for *_, kind in pieces], np.int8)
        self.id_of = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = [score for _, score, _ in pieces]
        self.pieces = [piece for piece, *_ in pieces]
        self.byte_id = {int(piece[1:-1], 16): i for i, (piece, _, kind) in enumerate(pieces) if kind == BYTE}
        #: value of byte pieces, -1 for others
        self.byte_of = np.full(len(pieces), -1, np.int16)
        for value, i in self.byte_id.items():
            self.byte_of[i] = value
        self.chars = np.array([len(p) if kind == NORMAL else 0 for p, _, kind in pieces], np.int32)
        #: no piece holds the space symbol behind another character
        self.in_words = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)


# -- normalisation ----------------------------------------------------------------------------------


def starts_of(raw: bytes) -> np.ndarray:
    """Place of the first byte of each character of valid UTF-8."""
    return np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80).astype(np.int32)


def normalize(model: Model, text: str) -> tuple[str, np.ndarray]:
    """Normalised text, and the source byte where each of its characters began, the source's end last."""
    raw = text.encode()
    if not raw:
        return "", np.zeros(1, np.int32)
    if not model.charmap.first and not model.less_space:  # characters stand for themselves
        plain = text.replace(" ", model.space)
        source = starts_of(raw)
        if model.dummy_prefix:
            plain, source = model.space + plain, np.concatenate([np.zeros(1, np.int32), source])
        return plain, np.append(source, np.int32(len(raw)))
    chunks = list(_chunks(model.charmap, raw))
    if model.less_space:
        while chunks and chunks[0][1] == " ":
            chunks.pop(0)
    out, source = [], []
    if chunks and model.dummy_prefix:
        out.append(model.space)
        source.append(chunks[0][0])
    spaced = model.less_space
    for at, part in chunks:
        if spaced:
            part = part.lstrip(" ")
        if part:
            out.append(part.replace(" ", model.space))
            source += [at] * len(part)
            spaced = model.less_space and part.endswith(" ")
    plain = "".join(out)
    end = len(raw)
    if model.less_space:
        while plain.endswith(model.space):
            plain, end = plain[:-1], source.pop()
    return plain, np.array([*source, end if plain else 0], np.int32)


def _chunks(charmap: CharacterMap, raw: bytes) -> Iterator[tuple[int, str]]:
    """(place, normalised text) of each longest key, or character that begins none."""
    bounds = starts_of(raw).tolist()
    ends = dict(zip(bounds, [*bounds[1:], len(raw)]))
    at = 0
    while at < len(raw):
        found = charmap.longest(raw, at) if raw[at] in charmap.first else None
        end = at + found[0] if found else ends[at]
        yield at, (found[1] if found else raw[at:end]).decode()
        at = end


# -- encoding ---------------------------------------------------------------------------------------


def merged(model: Model, word: str) -> list[int]:
    """Ids of one word: the two neighbours whose union scores highest are joined, again and again."""
    left, right = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    part: list[str] = list(word)
    id_of, score = model.id_of, model.score
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < len(part) and (found := id_of.get(part[a] + part[b])) is not None:
            heapq.heappush(heap, (-score[found], a, b, found))

    for i in range(len(word) - 1):
        offer(i, i + 1)
    while heap:
        _, a, b, found = heapq.heappop(heap)
        if not part[a] or not part[b] or right[a] != b or part[a] + part[b] != model.pieces[found]:
            continue
        part[a], part[b] = model.pieces[found], ""
        right[a] = right[b]
        if right[b] < len(part):
            left[right[b]] = a
        offer(left[a], a)
        offer(a, right[a])
    out: list[int] = []
    for piece in part:
        if piece:
            found = id_of.get(piece)
            out.extend([found] if found is not None else [model.byte_id[c] for c in piece.encode()])
    return out


class Merger:
    """Merges many words at once: each step joins the best two neighbours of every word that has any."""

    NONE = np.iinfo(np.int32).max  # the rank of neighbours that don't join

    def __init__(self, model: Model) -> None:
        self.model = model
        n = len(model.pieces)
        extra = sorted({c for p in model.id_of for c in p} - model.id_of.keys())
        self.symbol = model.id_of | {c: n + k for k, c in enumerate(extra)}
        self.code = np.concatenate([np.array([ord(c) for c in extra], np.uint32), np.arange(0x110000, dtype=np.uint32)])  # of symbols from n on
        self.byte_ids = np.array([model.byte_id[c] for c in range(256)], np.int32)
        self.first_unknown = n + len(extra)  # from here on a symbol is a character that no piece holds
        self.end = self.first_unknown + 0x110000
        self.of_char = np.arange(self.first_unknown, self.end, dtype=np.int32)
        for c, k in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        order = {s: k for k, s in enumerate(sorted(set(model.score), reverse=True))}
        #: by piece; the last is that of -1
        self.rank = np.array([*[order[s] for s in model.score], self.NONE], np.int32)
        joins = [(self.symbol[p[:k]], self.symbol[p[k:]], i) for p, i in model.id_of.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        left, right, made = np.array(joins, np.int64).reshape(-1, 3).T
        self._fill((left << 32) | right, made)

    def _fill(self, keys: np.ndarray, made: np.ndarray) -> None:
        """A hash table of the joins, an eighth full at most, open addressing."""
        bits = max(10, int(len(keys) * 8 - 1).bit_length())
        self.shift, self.keys, self.made = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        place, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[place[left]] < 0]
            self.keys[place[free]] = keys[free]  # of those that meet in a slot the last stays
            won = left[self.keys[place[left]] == keys[left]]
            self.made[place[won]] = made[won]
            left = np.setdiff1d(left, won)
            place[left] = (place[left] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = (left.astype(np.int64) << 32) | right
        place = self._slot(key)
        there = self.keys[place]
        out = np.where(there == key, self.made[place], np.int32(-1))
        more = np.flatnonzero((there != key) & (there >= 0))
        while len(more):
            place[more] = (place[more] + 1) % len(self.keys)
            there = self.keys[place[more]]
            hit = there == key[more]
            out[more[hit]] = self.made[place[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out

    def merge(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word; all words are padded to the longest."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(size.max(initial=0))
        real = np.arange(wide) < size[:, None]
        total = real.size  # this place stands beside the first and the last character of every word
        sym = np.full(total + 1, self.end, np.int32)
        sym[:-1][real.ravel()] = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        at = np.arange(total).reshape(real.shape)
        before, after = np.full(total + 1, total), np.full(total + 1, total)
        before[:-1].reshape(real.shape)[:, 1:] = at[:, :-1]
        after[:-1].reshape(real.shape)[:, :-1] = np.where(real[:, 1:], at[:, 1:], total)
        made = self.joined(sym, sym[after])
        rank = self.rank[made]
        alive = real.ravel().copy()
        rows = np.arange(len(words))
        table = rank[:-1].reshape(real.shape)
        while len(rows):
            best = table[rows].argmin(axis=1) if wide else rows
            here = rows * wide + best
            some = rank[here] < self.NONE
            rows, here = rows[some], here[some]
            gone = after[here]
            beyond = after[gone]
            sym[here], alive[gone], rank[gone] = made[here], False, self.NONE
            after[here], before[beyond] = beyond, here
            made[here] = self.joined(sym[here], sym[beyond])
            rank[here] = self.rank[made[here]]
            prior = before[here]
            made[prior] = self.joined(sym[prior], sym[here])
            rank[prior] = self.rank[made[prior]]
        kept = sym[:-1][alive]
        strange = kept >= len(self.model.pieces)
        if strange.any():  # characters without a piece become byte pieces
            chars = self.code[kept[strange] - len(self.model.pieces)]
            each = np.ones(len(kept), np.int64)
            each[strange] = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
            spelt = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)
            kept, strange = np.repeat(kept, each), np.repeat(strange, each)
            kept[strange] = self.byte_ids[spelt]
            taken = np.zeros(total, np.int64)
            taken[alive] = each
        else:
            taken = alive
        limits = np.concatenate([[0], np.cumsum(taken.reshape(real.shape).sum(axis=1))])
        packed, bounds = kept.tobytes(), (4 * limits).tolist()
        return [packed[i:j] for i, j in zip(bounds, bounds[1:])]


class Words(dict):
    """Packed ids by word, made many at a time and kept while there is room."""

    def __init__(self, model: Model, bound: int = WORD_MEMORY) -> None:
        super().__init__()
        self.model, self.merger, self.bound, self.held = model, Merger(model), bound, 0

    def learn(self, words: set[str]) -> None:
        """Make what is not here yet; what was here before goes first where room is short."""
        if self.held > self.bound:
            self.clear()
            self.held = 0
        fresh = sorted(words - self.keys(), key=len)
        while fresh and len(fresh[-1]) > LONG_WORD:
            word = fresh.pop()
            self._keep(word, np.array(merged(self.model, word), np.int32).tobytes())
        start = 0
        for wide in (8, 16, 32, LONG_WORD):
            stop = bisect.bisect_right(fresh, wide, lo=start, key=len)
            for at in range(start, stop, CELLS // wide):
                part = fresh[at : min(stop, at + CELLS // wide)]
                for word, packed in zip(part, self.merger.merge(part)):
                    self._keep(word, packed)
            start = stop

    def _keep(self, word: str, packed: bytes) -> None:
        self[word] = packed
        self.held += 4 * len(word) + len(packed) + 180  # with the objects that hold them


class Coder:
    """Encodes and decodes with one model; one per worker process."""

    def __init__(self, raw: bytes) -> None:
        self.model = Model(raw)
        self.words = Words(self.model)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if self.model.in_words else re.compile("(?s).+")
        self.edge = re.compile(f"[^{SPACE}]{SPACE}") if self.model.in_words else None
        self.surface = [self._bytes(i) for i in range(len(self.model.pieces))]

    def _bytes(self, i: int) -> bytes:
        model = self.model
        if model.kinds[i] == CONTROL:
            return b""
        if model.kinds[i] == UNKNOWN:
            return model.unknown_text
        return bytes([model.byte_of[i]]) if model.kinds[i] == BYTE else model.pieces[i].replace(SPACE, " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first byte and the end of each piece's source in the text's UTF-8."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """encode() of texts whose new words are merged together."""
        return self._spelt([normalize(self.model, text) for text in texts])

    def _spelt(self, normal: list[tuple[str, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids: list[np.ndarray] = [np.frombuffer(b"".join(self._ids(plain)), np.int32) if len(plain) > TEXT_HELD else None for plain, _ in normal]
        short = [k for k, found in enumerate(ids) if found is None]
        words = [self.cut.findall(normal[k][0]) for k in short]
        self.words.learn(set().union(*words))
        for k, mine in zip(short, words):
            ids[k] = np.frombuffer(b"".join([self.words[w] for w in mine]), np.int32)
        out = []
        for found, (_, source) in zip(ids, normal):
            ends = np.cumsum(self.lengths(found))
            starts = np.concatenate([np.zeros(1, ends.dtype), ends])[: len(found)]
            out.append((found, source[starts], source[ends]))
        return out

    def _ids(self, plain: str) -> Iterator[bytes]:
        """Packed ids of a very long text, a stretch of words at a time."""
        at = 0
        while at < len(plain):
            edge = self.edge and self.edge.search(plain, at + TEXT_HELD)
            end = edge.start() + 1 if edge else len(plain)
            words = self.cut.findall(plain, at, end)
            self.words.learn(set(words))
            yield b"".join([self.words[w] for w in words])
            at = end

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        """Normalised characters that each piece takes; of a character's byte pieces the last one has it."""
        value = self.model.byte_of[ids]
        more = np.zeros(len(ids), bool)
        more[:-1] = (value[1:] & 0xC0 == 0x80) & (value[1:] >= 0)
        return np.where(value >= 0, ~more, self.model.chars[ids])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the space before the first word goes, broken byte runs give replacement characters.

        Ids out of the model give nothing.
        """
        model, surface = self.model, self.surface
        known = [i for i in ids if 0 <= i < len(surface)] if ids and not 0 <= min(ids) <= max(ids) < len(surface) else ids
        kinds = model.kinds[known] if len(known) else np.zeros(0, np.int8)
        out = []
        at = 0
        heads = np.flatnonzero(kinds != CONTROL)
        if len(heads) and (model.dummy_prefix or model.less_space) and kinds[heads[0]] == NORMAL:
            at = int(heads[0]) + 1
            piece = model.pieces[known[at - 1]]
            out.append((piece.lstrip(SPACE) if model.less_space else piece.removeprefix(SPACE)).replace(SPACE, " ").encode())
        rest = known[at:]
        if not (kinds == CONTROL).any():  # else they may part bytes of one character
            try:
                return b"".join([*out, *[surface[i] for i in rest]]).decode()
            except UnicodeDecodeError:
                pass
        return "".join([*[p.decode() for p in out], *self._runs(rest)])

    def _runs(self, ids: list[int]) -> Iterator[str]:
        """Texts of pieces and of runs of byte pieces; a byte that begins no character is replaced."""
        value = self.model.byte_of
        run = bytearray()
        for i in [*ids, None]:
            if i is not None and value[i] >= 0:
                run.append(value[i])
                continue
            at = 0
            while at < len(run):
                size = next((n for n in (1, 2, 3, 4) if _is_character(bytes(run[at : at + n]), n)), 0)
                yield run[at : at + size].decode() if size else "�"
                at += size or 1
            run.clear()
            if i is not None:
                yield self.surface[i].decode()


def _is_character(raw: bytes, size: int) -> bool:
    try:
        return len(raw) == size and len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The worker process's coder for a model file, made once."""
    if path not in _CODERS:
        with open(path, "rb") as file:
            _CODERS[path] = Coder(file.read())
    return _CODERS[path]


# -- tables -----------------------------------------------------------------------------------------


def _packed(parts: list[np.ndarray]) -> pa.ListArray:
    limits = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=limits[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(limits), pa.array(flat.astype(np.int32, copy=False)))


def _sized(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about TEXT_HELD bytes of text, a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXT_HELD, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _encoded(docs: DataFrame, model: str | None, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = coder(model or default_model())
        for b in batches:
            for part in _sized(b):
                found = worker.encode_all([t or "" for t in part.column(1).to_pylist()])
                columns = {"doc_id": part.column(0)} | {name: _packed([f[k] for f in found]) for k, name in enumerate(("ids", "starts", "ends"))}
                if with_text:
                    columns["text"] = pa.array([worker.decode(f[0].tolist()) for f in found], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, ids array<int>, starts array<int>, ends array<int>" + ", text string" * with_text
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, starts and ends of every row's whole text: ids of pieces and their source bytes.

    A null text is empty and has no pieces; null and repeated doc_ids are treated like others, other
    columns are left out.  Spans follow each other without gaps in a text whose model does not drop spaces.
    """
    return _encoded(docs, model, with_text=False)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids; a null array gives an empty text."""

    def make():
        worker = coder(model or default_model())

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [worker.decode([i for i in ids or [] if i is not None]) for ids in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return batch

    return arrow_map(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """encode() with the decoded text beside it, decoded from the ids by the worker that made them."""
    return _encoded(docs, model, with_text=True)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the source byte where the last piece ends."""
    both = encode_and_decode(docs, model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("source_bytes"),
    )
