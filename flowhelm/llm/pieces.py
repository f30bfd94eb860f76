"""Encoding by a SentencePiece BPE model without running its merges, and decoding.

For merge-type vocabularies the encoding of a text is fixed by its prefixes: each prefix has one last token, the only
matching piece that may follow the last token of the rest. An automaton lists the pieces that end at a position, a
pair test tells whether two neighbours would stay apart (their merges undone step by step, latest first), and the table
of last tokens read backwards gives the ids. Time and memory are linear in the text.

Merges never reach across two code points that stand side by side in no piece, so texts are cut there and equal parts
(words, mostly) are encoded once per worker as long as its bounded store holds them.

Defined results: null and empty texts have no tokens besides the begin and end ids, null ids decode to an empty text;
repeated rows, null and repeated ids of rows don't matter, as every row stands alone; an empty table gives an empty
one; long texts are encoded whole, in parts that end at such cuts. All other columns stay, one that bears the name of
the new column is replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import sys
from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Code points looked at together, and bounds of the store of encoded parts.
PART_CHARS = 1 << 20
STORE_PARTS, STORE_CHARS, LONGEST_STORED = 800_000, 16_000_000, 256
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_PAIR_SLOTS = 1 << 22
_ENCODERS: dict[str, Encoder] = {}


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        yield key >> 3, message[at : at + size]
        at += size


def packed(ids: Sequence[int]) -> bytes:
    """Little-endian 32-bit words."""
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


class Vocabulary:
    """Pieces, scores and kinds of a model file: merge-type, spaces as U+2581, one put before a text, unknown code points
    as bytes, no other normalisation. Other models are refused."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = file.read()
        self.name = hashlib.sha256(model).hexdigest()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, int | bytes] = {}
        normalizer: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append(part[1].decode())
                self.scores.append(float(np.frombuffer(part.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(part.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        plain = not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or not plain or not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: not a byte-falling merge model without normalisation")
        control = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == CONTROL}
        self.begin, self.end = control["<s>"], control["</s>"]
        self.bytes = [0] * 256
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self._merges()

    def _merges(self) -> None:
        """Rank of every piece of several code points (1: merged first), the two tokens each is merged from, and which
        pieces a text can get at all. Code points that occur only inside pieces become tokens behind the last id."""
        normal = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        long = [p for p in normal if len(p) > 1]
        steps = {s: k + 1 for k, s in enumerate(sorted({self.scores[normal[p]] for p in long}, reverse=True))}
        self.rank_of = {p: steps[self.scores[normal[p]]] for p in long}
        self.token_of = dict(normal)
        self.texts = list(self.pieces)
        for c in sorted({c for p in long for c in p} - normal.keys()):
            self.token_of[c] = len(self.texts)
            self.texts.append(c)
        self.rank = [0] * len(self.texts)
        self.left, self.right = list(range(len(self.texts))), list(range(len(self.texts)))
        self.matched = [i for p, i in self.token_of.items() if len(p) == 1]
        for p in long:
            i = self.token_of[p]
            self.rank[i] = self.rank_of[p]
            tokens, last = self.merge(p)
            if len(tokens) == 1:
                self.left[i], self.right[i] = last
                self.matched.append(i)
        ranks = np.bincount([self.rank_of[p] for p in long], minlength=1)
        self.tied = [r > 0 and ranks[r] > 1 for r in self.rank]

    def merge(self, text: str) -> tuple[list[int], tuple[int, int]]:
        """Tokens of a short text by plain merging, best score and then leftmost first, and the last two merged."""
        parts, last = list(text), (0, 0)
        while True:
            found = [(r, k) for k in range(len(parts) - 1) if (r := self.rank_of.get(parts[k] + parts[k + 1]))]
            if not found:
                return [self.token_of[p] for p in parts], last
            k = min(found)[1]
            last = (self.token_of[parts[k]], self.token_of[parts[k + 1]])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]


class Encoder(dict):
    """Ids, as little-endian 32-bit words, of parts of texts; a part that isn't stored is encoded when asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.chars, self.pairs = vocabulary, 0, {}
        self.length = [len(t) for t in vocabulary.texts]
        self.automaton = ahocorasick.Automaton()
        for i in vocabulary.matched:
            self.automaton.add_word(vocabulary.texts[i], i)
        self.automaton.make_automaton()
        inner = sorted({c for i in vocabulary.matched if self.length[i] > 1 for c in vocabulary.texts[i]})
        self.code = np.zeros(0x110000, dtype=np.uint32)
        self.code[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.joined = np.zeros(_PAIR_SLOTS, dtype=bool)  # a slot that pairs share only keeps two parts together
        for i in vocabulary.matched:
            code = self.code[[ord(c) for c in vocabulary.texts[i]]]
            self.joined[self._slot(code[:-1], code[1:])] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) + b) & np.uint32(_PAIR_SLOTS - 1)

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens side by side stay so: no merge across comes before those that made them."""
        v = self.v
        if v.tied[a] or v.tied[b]:  # pieces of one score grow from the left, not by rank
            return v.merge(v.texts[a] + v.texts[b])[0] == [a, b]
        rank, texts, limit = v.rank, v.texts, len(v.texts) + 1
        while True:
            if v.rank_of.get(texts[a] + texts[b], limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], v.right[a]
            elif rank[b]:
                limit, b = rank[b] + 1, v.left[b]
            else:
                return True

    def tokens(self, part: str) -> list[int]:
        """Tokens of a part without code points that are in no piece."""
        last, pairs, length = [-1] * len(part), self.pairs, self.length
        for end, token in self.automaton.iter(part):
            if last[end] >= 0:
                continue
            before = end - length[token]
            if before >= 0:
                pair = last[before] << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= STORE_PARTS:
                        pairs.clear()
                    fits = pairs[pair] = self.fits(last[before], token)
                if not fits:
                    continue
            last[end] = token
        at, found = len(part) - 1, []
        while at >= 0:
            found.append(last[at])
            at -= length[last[at]]
        return found[::-1]

    def ids(self, part: str) -> bytes:
        if part in self.v.token_of or len(part) > 1:
            ids = self.tokens(part)
        else:
            ids = [len(self.v.pieces)]
        if max(ids) >= len(self.v.pieces):
            texts = (part if len(part) == 1 else self.v.texts[i] for i in ids)
            ids = [j for i, t in zip(ids, texts, strict=True) for j in ([i] if i < len(self.v.pieces) else [self.v.bytes[b] for b in t.encode("utf-8")])]
        return packed(ids)

    def __missing__(self, part: str) -> bytes:
        ids = self.ids(part)
        if len(part) <= LONGEST_STORED:
            if len(self) >= STORE_PARTS or self.chars + len(part) > STORE_CHARS:
                self.clear()
                self.chars = 0
            self[part] = ids
            self.chars += len(part)
        return ids

    def parts(self, text: str) -> Iterator[str]:
        """The text cut where no piece holds both code points."""
        at = 0
        while at < len(text):
            size = PART_CHARS
            while True:
                here = text[at : at + size]
                code = self.code[np.frombuffer(here.encode("utf-32-le"), dtype=np.uint32)]
                cuts = (np.flatnonzero(~self.joined[self._slot(code[:-1], code[1:])]) + 1).tolist()
                if at + size >= len(text):
                    cuts.append(len(here))
                if cuts:
                    break
                size *= 2
            begin = 0
            for cut in cuts:
                yield here[begin:cut]
                begin = cut
            at += begin

    def encode(self, text: str | None, begin: bool = True, end: bool = True) -> bytes:
        ids = [packed([self.v.begin])] if begin else []
        if text:
            ids.extend(map(self.__getitem__, self.parts(SPACE + text.replace(" ", SPACE))))
        if end:
            ids.append(packed([self.v.end]))
        return b"".join(ids)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("flowhelm_each_byte", _each_byte)


class Decoder:
    """Texts of ids: pieces joined, spaces restored, the one put before the text dropped; bytes that are no UTF-8 and ids
    outside the vocabulary become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.kinds, self.surface = vocabulary.kinds, []
        for piece, kind in zip(vocabulary.pieces, vocabulary.kinds, strict=True):
            text = {CONTROL: "", UNKNOWN: " ⁇ "}.get(kind, piece.replace(SPACE, " "))
            self.surface.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else text.encode("utf-8"))
        self.spaced = [k == NORMAL and p.startswith(SPACE) for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]

    def decode(self, ids: bytes | None) -> str:
        ids = np.frombuffer(ids or b"", dtype="<u4").tolist()
        n, strange = len(self.surface), "�".encode()
        if ids and max(ids) >= n:
            data = b"".join(self.surface[i] if i < n else strange for i in ids)
        else:
            data = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if i >= n or self.kinds[i] != CONTROL), n)
        if first < n and self.spaced[first]:
            data = data[1:]
        return data.decode("utf-8", "flowhelm_each_byte")


def _mapped(df: DataFrame, field: T.StructField, drop: Sequence[str], work) -> DataFrame:
    """``df`` without ``drop`` and with the column that ``work`` makes of each Arrow batch."""
    keep = [f for f in df.schema.fields if f.name != field.name and f.name not in drop]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = work()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], make(batch)], names=[*names, field.name])

    return df.mapInArrow(run, T.StructType([*keep, field]))


def encode(
    docs: DataFrame, model: str, text: str = "text", name: str = "ids", begin: bool = True, end: bool = True, as_array: bool = False, drop: Sequence[str] = ()
) -> DataFrame:
    """Add the ids of ``text`` under the model file ``model`` (read on the driver, its tables are broadcast: their size is the
    vocabulary's): little-endian 32-bit words, the way token files hold them, or an array (``as_array``)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def work():
        v = shared.value
        encoder = _ENCODERS.get(v.name)
        if encoder is None:
            encoder = _ENCODERS[v.name] = Encoder(v)

        def make(batch: pa.RecordBatch) -> pa.Array:
            ids = [encoder.encode(t, begin, end) for t in batch.column(text).to_pylist()]
            if not as_array:
                return pa.array(ids, pa.binary())
            ends = np.cumsum([0, *[len(i) // 4 for i in ids]], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)))

        return make

    return _mapped(docs, T.StructField(name, T.ArrayType(T.IntegerType()) if as_array else T.BinaryType()), drop, work)


def decode(tokens: DataFrame, model: str, ids: str = "ids", name: str = "decoded", drop: Sequence[str] = ()) -> DataFrame:
    """Add the text of ``ids`` (packed or an array)."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(model))
    arrays = isinstance(tokens.schema[ids].dataType, T.ArrayType)

    def work():
        decoder = Decoder(shared.value)

        def make(batch: pa.RecordBatch) -> pa.Array:
            values = batch.column(ids).to_pylist()
            words = ([packed([i for i in v or [] if i is not None]) for v in values] if arrays else values)
            return pa.array(map(decoder.decode, words), pa.string())

        return make

    return _mapped(tokens, T.StructField(name, T.StringType()), drop, work)
