"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

The model file is compiled once in each worker: its normaliser (blanks to U+2581, a leading blank, the character
rules), an arc for each piece, and byte arcs for characters that no piece has. A text is composed with it and
the path of least weight in the tropical semiring (sums along a path, minimum over paths) is taken, position by
position. For unigram models an arc weighs minus its piece's score. For BPE models a state is the piece last
read, and there is an arc to the next piece only if merging the two pieces' characters gives the two pieces
again; exactly one path then leads to each position, which is the one that merging finds.

Texts are cut where no piece can reach across (before a blank that follows another character), and the paths of
parts are kept for the next time they occur.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K
from sentencepiece import sentencepiece_model_pb2

from urlgauge.llm import _text as T

BLANK = "▁"
#: Parts of texts, and pairs of pieces, whose answers a worker keeps. Of parts the store before is
#: kept too, so frequent ones stay.
KEPT_PARTS = 250_000
KEPT_PAIRS = 300_000
#: A pair of pieces is one number: the left one, or START, and then so many bits of the right one.
PIECE_BITS = 24
START = (1 << PIECE_BITS) - 1
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# Kinds of pieces and of models in the public file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


class Transducer:
    """A compiled model: `encode` a text to ids, `decode` ids to a text."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if model.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("the model is neither a unigram nor a BPE model")
        self.bpe = model.trainer_spec.model_type == BPE
        spec = model.normalizer_spec
        self.rules = sentencepiece.SentencePieceNormalizer(model_file=path, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False).normalize if spec.precompiled_charsmap else None
        self.prefix, self.squeeze = BLANK if spec.add_dummy_prefix else "", spec.remove_extra_whitespaces
        self.ids, self.scores, self.bytes, self.unknown = {}, {}, {}, 0
        self.surface: list[bytes] = []
        for i, piece in enumerate(model.pieces):
            surface = piece.piece.replace(BLANK, " ").encode()
            if piece.type in (NORMAL, USER_DEFINED):
                self.ids[piece.piece], self.scores[piece.piece] = i, piece.score
            elif piece.type == BYTE:
                value = int(piece.piece[3:-1], 16)
                self.bytes[value] = i
                surface = bytes([value])
            elif piece.type == UNKNOWN:
                self.unknown, surface = i, " ⁇ ".encode()
            else:
                surface = b""
            self.surface.append(surface)
        # from each beginning of a piece, by the next character: the piece's id or -1, and where longer ones go on
        self.trie: dict[str, list] = {}
        for p, i in self.ids.items():
            on = self.trie
            for c in p[:-1]:
                on = on.setdefault(c, [-1, {}])[1]
            on.setdefault(p[-1], [-1, {}])[0] = i
        self.longest = max(map(len, self.ids), default=1)
        self.none = len(self.surface)  # a character that no piece has counts as piece `none` + its code point
        self.lengths = [len(piece.piece) for piece in model.pieces]
        self.pieces = [piece.piece for piece in model.pieces]
        self.worst = min(self.scores.values(), default=0.0) - 10
        across = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.parts = re.compile("(?s).+" if across else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.fallback = len(self.bytes) == 256
        self.known = Paths(self)
        self.pairs: dict[int, bool] = {}
        self.packed: np.ndarray | None = None  # pairs of the tasks before, each with its answer as the last bit

    def forget(self) -> None:
        """Give back the memory of what is kept; the answers for pairs of pieces stay, as 8 bytes each."""
        self.known = Paths(self)
        if self.pairs:
            self.packed = np.fromiter((pair << 1 | fits for pair, fits in self.pairs.items()), np.int64, len(self.pairs))
            self.pairs = {}

    def normalise(self, text: str) -> str:
        text = self.rules(text) if self.rules else text
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return self.prefix + text.replace(" ", BLANK) if text else ""

    def encode(self, text: str) -> list[int]:
        found = list(chain.from_iterable(map(self.known.__getitem__, self.parts.findall(self.normalise(text)))))
        if not self.fallback:  # neighbouring unknown characters are one
            found = [x for x, before in zip(found, [-1, *found], strict=False) if x != self.unknown or before != self.unknown]
        return found

    def decode(self, ids: list[int]) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join([self.surface[i] for i in ids])
        return (data[1:] if self.prefix and data[:1] == b" " else data).decode("utf-8", "replace")

    def path(self, part: str) -> tuple[int, ...]:
        """Ids along the path of least weight."""
        found, none = self.merge_path(part) if self.bpe else self.least_path(part), self.none
        if max(found) < none:
            return tuple(found)
        return tuple(chain.from_iterable((p,) if p < none else self.character_ids(chr(p - none)) for p in found))

    def arcs(self, part: str, start: int) -> list[int]:
        """The pieces that can be read from `start`, shortest first; a character that no piece has is one, too."""
        on, out = self.trie, []
        for c in part[start : start + self.longest]:
            node = on.get(c)
            if node is None:
                break
            piece, on = node
            if piece >= 0:
                out.append(piece)
        return out if out and self.lengths[out[0]] == 1 else [self.none + ord(part[start]), *out]

    def least_path(self, part: str) -> list[int]:
        n, scores, pieces, none = len(part), self.scores, self.pieces, self.none
        weight = [0.0] + [np.inf] * n
        last = [-1] * (n + 1)
        for start in range(n):
            for piece in self.arcs(part, start):
                end, score = (start + self.lengths[piece], scores[pieces[piece]]) if piece < none else (start + 1, self.worst)
                total = weight[start] - score
                if total < weight[end]:
                    weight[end], last[end] = total, piece
        found, at = [], n
        while at:
            found.append(last[at])
            at -= self.lengths[last[at]] if last[at] < none else 1
        return found[::-1]

    def merge_path(self, part: str) -> list[int]:
        """The only complete path, all of whose arcs weigh 0: longest arcs first, and back from dead ends.

        One path leads to each place, so a place that cannot be left is never tried again.
        """
        pairs, trie, longest, lengths, none = self.pairs, self.trie, self.longest, self.lengths, self.none
        found, dead, at, before, n = [], set(), 0, START, len(part)
        while at < n:
            on, pieces = trie, []  # as in `arcs`, without a call
            for c in part[at : at + longest]:
                node = on.get(c)
                if node is None:
                    break
                piece, on = node
                if piece >= 0:
                    pieces.append(piece)
            if not pieces or lengths[pieces[0]] > 1:
                pieces.insert(0, none + ord(part[at]))
            while pieces:
                piece = pieces.pop()
                end = at + lengths[piece] if piece < none else at + 1
                if end in dead:
                    continue
                fits = pairs.get(before << PIECE_BITS | piece)
                if fits is None:
                    fits = self.follow(before, piece)
                if fits:
                    found.append(piece)
                    at, before = end, piece
                    break
            else:
                dead.add(at)
                last = found.pop()
                at -= lengths[last] if last < none else 1
                before = found[-1] if found else START
        return found

    def character_ids(self, character: str) -> tuple[int, ...]:
        """Ids of a character that no piece has."""
        return tuple(self.bytes[b] for b in character.encode()) if self.fallback else (self.unknown,)

    def characters(self, piece: int) -> str:
        if piece == START:
            return ""
        return self.pieces[piece] if piece < self.none else chr(piece - self.none)

    def follow(self, left: int, right: int) -> bool:
        """Whether an arc reads `right` after `left` (START at first): merging must not reach across."""
        pair = left << PIECE_BITS | right
        if self.packed is not None:
            packed, self.packed = self.packed, None
            self.pairs.update(zip((packed >> 1).tolist(), (packed & 1).astype(bool).tolist(), strict=True))
            if pair in self.pairs:
                return self.pairs[pair]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        first, second = self.characters(left), self.characters(right)
        symbols = list(first + second)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        self.pairs[pair] = fits = symbols == ([first, second] if first else [second])
        return fits


class Paths(dict):
    """The ids of parts of texts, found when first asked for; of those kept before the last KEPT_PARTS the store is kept, too."""

    def __init__(self, model: Transducer):
        self.model, self.older = model, {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.older.get(part) or self.model.path(part)
        if len(part) <= 64:
            if len(self) >= KEPT_PARTS:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """The transducer of a model file, made once in each worker."""
    return Transducer(path)


def encode_pieces(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """`docs` with all columns and ids (array<int>) and round_trip: whether decoding gives the text again.

    model: path of a model file that every worker can read. A null or empty text has no ids (and comes back).
    Blanks and U+2581 are the same to this format, so a text with U+2581 does not come back as it was. Columns
    of these names are replaced. Repeated rows each give a row; an empty table gives none.
    """
    docs = docs.drop("ids", "round_trip")

    def run(batches):
        for batch in batches:
            for a, b in T.chunks(T.flat(batch.column("text"))[1]):
                part = batch.slice(a, b - a)
                ids, back = _encoded(compiled(model), part.column("text").to_pylist())
                yield pa.record_batch([*part.columns, ids, pa.array(back)], names=[*batch.schema.names, "ids", "round_trip"])
        compiled(model).forget()  # workers live on, with other steps to run

    more = [K.StructField("ids", K.ArrayType(K.IntegerType())), K.StructField("round_trip", K.BooleanType())]
    return docs.mapInArrow(T.giving_back(run), K.StructType([*docs.schema.fields, *more]))


def _encoded(model: Transducer, texts: list) -> tuple[pa.Array, list[bool]]:
    found = [model.encode(t) if t else [] for t in texts]
    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
    ids = pa.array(np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1])))
    return pa.ListArray.from_arrays(pa.array(offsets), ids), [model.decode(i) == (t or "") for i, t in zip(found, texts, strict=True)]


def decode_pieces(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """`encoded` with its `ids` replaced by text; null ids give a null text."""
    rest = [f for f in encoded.schema.fields if f.name not in ("ids", "text")]

    def run(batches):
        for batch in batches:
            texts = [None if i is None else compiled(model).decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([*(batch.column(f.name) for f in rest), pa.array(texts, pa.string())], names=[*(f.name for f in rest), "text"])

    return encoded.mapInArrow(T.giving_back(run), K.StructType([*rest, K.StructField("text", K.StringType())]))


def digest(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as little-endian 32-bit numbers) and round_trip of each row."""

    def run(batches):
        for batch in batches:
            for a, b in T.chunks(T.flat(batch.column("text"))[1]):
                part = batch.slice(a, b - a)
                ids, back = _encoded(compiled(model), part.column("text").to_pylist())
                at, values = ids.offsets.to_pylist(), np.asarray(ids.values)
                sums = [hashlib.sha256(values[x:y].astype("<i4").tobytes()).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([part.column("doc_id"), np.diff(at), pa.array(sums, pa.string()), pa.array(back)], names=["doc_id", "n_ids", "ids_sha256", "round_trip"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(T.giving_back(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_ids bigint, ids_sha256 string, round_trip boolean")


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
