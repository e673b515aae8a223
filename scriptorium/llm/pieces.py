"""Encoding and decoding with SentencePiece models of the merge type.

Merging by priority visits a text many times.  Here a text is read once: an
Aho-Corasick automaton gives the longest piece at each place, a piece is taken
if merging the text of the last piece and its own would not cross their border, and
where no piece fits, the last one is given up and its end noted as failed.
The ids are those of merging.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

SPACE = "▁"
#: What an id without text decodes to.
UNKNOWN_TEXT = " ⁇ "
#: Units (words with the spaces before) whose ids a task remembers, of at most so many characters, and pairs of pieces; a full table starts anew.
HELD_UNITS, UNIT_CHARS, HELD_PAIRS = 800_000, 64, 1_000_000
NORMAL, UNKNOWN, CONTROL, BYTE = range(4)


def public_model(name: str = "piece_bpe_32k.model") -> str:
    """Path of a model of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces, their kinds, ranks of merging (0 first; -1 for single characters), and the two parts that merging makes each of.

    Some thousands of pieces, whatever the corpus; tasks get it with their code.
    ``left`` is -1 for single characters and -2 for pieces that merging never makes.
    """

    pieces: list[str]
    kinds: list[int]
    ranks: list[int]
    left: list[int]
    right: list[int]
    begin: int
    end: int
    unknown: int
    prefix: bool
    digest: str


def vocabulary(path: str) -> Vocabulary:
    """Read a model of the merge type without normalisation, user-defined or unused pieces; a ValueError for others."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spec = proto.ModelProto()
    spec.ParseFromString(model.serialized_model_proto())
    n, norm = model.vocab_size(), spec.normalizer_spec
    if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("not a model of the merge type that takes texts as they are")
    if any(p.type not in (1, 2, 3, 6) for p in spec.pieces):
        raise ValueError("user-defined and unused pieces aren't supported")
    pieces = [model.id_to_piece(i) for i in range(n)]
    kinds = [{1: NORMAL, 2: UNKNOWN, 3: CONTROL, 6: BYTE}[p.type] for p in spec.pieces]
    if sum(k == BYTE for k in kinds) not in (0, 256):
        raise ValueError("some bytes have no piece")
    scores = sorted({p.score for p, k in zip(spec.pieces, kinds) if k == NORMAL}, reverse=True)
    rank_of = {s: i for i, s in enumerate(scores)}
    ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
    ranks = [-1 if k != NORMAL or len(p) < 2 else rank_of[s.score] for p, k, s in zip(pieces, kinds, spec.pieces)]
    left, right = [-1] * n, [-1] * n
    for piece, i in ids.items():
        if len(piece) > 1:
            left[i], right[i] = _parts(piece, ids, ranks)
    return Vocabulary(pieces, kinds, ranks, left, right, model.bos_id(), model.eos_id(), model.unk_id(), norm.add_dummy_prefix, hashlib.sha256(model.serialized_model_proto()).hexdigest())


def merged(text: str, ids: dict[str, int], ranks: list[int]) -> tuple[list[str], tuple[str, str] | None]:
    """Merging by definition: the first of the best-ranked neighbours, again and again; also the last two merged."""
    parts, last = list(text), None
    while len(parts) > 1:
        best = min(((ranks[ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids), default=None)
        if best is None:
            break
        k = best[1]
        last = parts[k], parts[k + 1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts, last


def _parts(piece: str, ids: dict[str, int], ranks: list[int]) -> tuple[int, int]:
    parts, last = merged(piece, ids, ranks)
    return (ids[last[0]], ids[last[1]]) if len(parts) == 1 and all(x in ids for x in last) else (-2, -2)


class Encoder(dict):
    """Ids of texts. The dictionary itself holds the ids of units as bytes (little-endian, 32 bits), and finds those it lacks."""

    def __init__(self, v: Vocabulary) -> None:
        super().__init__()
        self.v = v
        usable = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == NORMAL and v.left[i] != -2}
        self.usable = usable
        self.single = {p for p in usable if len(p) == 1}
        self.lengths = [len(p) for p in v.pieces]
        self.pair = {(v.left[i], v.right[i]): v.ranks[i] for i in usable.values() if v.left[i] >= 0}
        self.shorter = [-1] * len(v.pieces)
        for p, i in usable.items():
            self.shorter[i] = next((usable[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in usable), -1)
        self.automaton = ahocorasick.Automaton()
        for p, i in usable.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.bytes_ = {int(p[3:5], 16): i for i, p in enumerate(v.pieces) if v.kinds[i] == BYTE}
        self.known: dict[int, bool] = {}
        self.unit = self._units()

    def _units(self) -> re.Pattern | None:
        """Units of a text, at whose borders no piece has its two characters side by side, so that merging never crosses them; None if pieces hold inner spaces.

        Borders are before spaces, between a letter and a mark that follows no letter in any piece, and beside control characters that are no piece.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.usable):
            return None
        letter = r"[^\W\d_]"
        after = {p[i] for p in self.usable for i in range(1, len(p)) if re.match(letter, p[i - 1])}
        marks = "".join(re.escape(chr(c)) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in after)
        strange = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in self.single)
        strange_runs = [f"[{strange}]+"] if strange else []
        return re.compile("|".join([f"{SPACE}*+{letter}++(?=[{SPACE}{strange}{marks}]|\\Z)", f"{SPACE}*[^{SPACE}{strange}]+", f"{SPACE}+", *strange_runs]))

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces side by side gives the two: their merges are undone, last first, and none across the border may have come before."""
        ranks, left, right, pair = self.v.ranks, self.v.left, self.v.right, self.pair
        limit = len(ranks) + 1
        while pair.get((a, b), limit) >= limit:
            if ranks[a] > ranks[b]:
                limit, a = ranks[a], right[a]
            elif ranks[b] < 0:
                return True
            else:  # merges of one rank go from left to right, so the right piece's is the later one
                limit, b = ranks[b] + 1, left[b]
        return False

    def encode_known(self, text: str) -> list[int]:
        """Ids of a text whose characters all are pieces."""
        if text in self.usable:
            return [self.usable[text]]
        n, lengths, shorter, known = len(text), self.lengths, self.shorter, self.known
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(text):
            longest[end - lengths[i] + 1] = i  # a later end is a longer piece
        out: list[int] = []
        failed = bytearray(n // 8 + 1)
        at, last, piece, backed = 0, -1, longest[0], False
        while at < n:
            end = at + lengths[piece]
            fit = not (backed and failed[end >> 3] >> (end & 7) & 1)
            if fit and last >= 0:
                key = last << 32 | piece
                if key not in known:
                    if len(known) >= HELD_PAIRS:
                        known.clear()
                    known[key] = self.fits(last, piece)
                fit = known[key]
            if fit:
                out.append(piece)
                at, last, piece = end, piece, longest[end]
            elif shorter[piece] >= 0:
                piece = shorter[piece]
            else:  # nothing fits here: give up the last piece, and try shorter ones in its place
                failed[at >> 3] |= 1 << (at & 7)
                backed = True
                piece = out.pop()
                at -= lengths[piece]
                last = out[-1] if out else -1
        return out

    def encode_unit(self, text: str) -> list[int]:
        """Ids of a text; characters that are no piece become their bytes, and merging never crosses them."""
        if self.single.issuperset(text):
            return self.encode_known(text)
        out: list[int] = []
        start = 0
        for at, c in enumerate(text):
            if c not in self.single:
                if at > start:
                    out += self.encode_known(text[start:at])
                if self.bytes_:
                    out += [self.bytes_[b] for b in c.encode()]
                elif not (at == start and out and out[-1] == self.v.unknown):
                    out.append(self.v.unknown)
                start = at + 1
        return out + (self.encode_known(text[start:]) if start < len(text) else [])

    def __missing__(self, unit: str) -> bytes:
        found = self.encode_unit(unit)
        found = struct.pack(f"<{len(found)}I", *found)
        if len(unit) <= UNIT_CHARS:
            if len(self) >= HELD_UNITS:
                self.clear()
            self[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text with begin and end, as little-endian 32-bit integers."""
        body = b""
        if text:
            text = (SPACE if self.v.prefix else "") + text.replace(" ", SPACE)
            units = self.unit.findall(text) if self.unit else [text]
            body = b"".join(map(self.__getitem__, units))
        return np.array([self.v.begin], "<u4").tobytes() + body + np.array([self.v.end], "<u4").tobytes()


#: Of the model that this process used last, so that the tasks of a worker share what it remembers.
_LAST: dict[str, Encoder] = {}


def encoder_of(v: Vocabulary) -> Encoder:
    if v.digest not in _LAST:
        _LAST.clear()
        _LAST[v.digest] = Encoder(v)
    return _LAST[v.digest]


class Decoder:
    """Texts of ids."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.controls = {i for i, k in enumerate(v.kinds) if k == CONTROL}
        self.texts = [
            b"" if k == CONTROL else UNKNOWN_TEXT.encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds)
        ]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the space that encoding put first goes, control pieces have no text, each byte that is no UTF-8 becomes U+FFFD."""
        v = self.v
        if self.controls.isdisjoint(ids[1:-1]):
            out = self._joined(ids)
        else:  # bytes on both sides of a control piece make no character
            out = "".join(self._joined(run) for control, run in groupby(ids, self.controls.__contains__) if not control)
        first = next((i for i in ids if i not in self.controls), None)
        return out[1:] if v.prefix and first is not None and v.kinds[first] == NORMAL and v.pieces[first].startswith(SPACE) else out

    def _joined(self, ids) -> str:
        return b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "scriptorium-bytes")


codecs.register_error("scriptorium-bytes", lambda error: ("�" * (error.end - error.start), error.end))


def piece_ids(docs: DataFrame, model: str) -> DataFrame:
    """Add ``ids array<int>``, begin and end included, to ``docs(.., text, ..)``; a column of this name is replaced, a null text is an empty one."""
    docs = docs.drop("ids")
    at, v = docs.columns.index("text"), vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(v)
        for part in slices(batches):
            ids = [np.frombuffer(encoder.encode(t or ""), "<u4").astype(np.int32) for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def piece_texts(rows: DataFrame, model: str) -> DataFrame:
    """Add ``decoded string`` to ``rows(.., ids array<int>, ..)``; a null list or a null in it has no text. An id outside the vocabulary is an error."""
    rows = rows.drop("decoded")
    at, v = rows.columns.index("ids"), vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(v)
        for part in slices(batches):
            texts = [decoder.decode([i for i in ids or [] if i is not None]) for ids in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_tokens, ids_sha256, decoded_sha256``, a row for each row.

    Whole texts are encoded, with begin and end, and the ids decoded again.  A
    null text is an empty one, which has these two ids only.  Long words are
    encoded in time that grows with their length; other columns are ignored; an
    empty table gives an empty one.  Nothing is shuffled.
    """
    v = vocabulary(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = encoder_of(v), Decoder(v)
        for part in slices(batches):
            sizes, ids_sha, text_sha = [], [], []
            for text in part.column(1).to_pylist():
                ids = encoder.encode(text or "")
                sizes.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoder.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
