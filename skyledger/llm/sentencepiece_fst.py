"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model stands for three transducers: the normaliser (spaces become the mark, one is put in front),
the pieces (a path costs the negative score) and byte fallback (a character in no piece becomes its
UTF-8 bytes). Their composition with an input is built by hand, as the lattice of the pieces that occur
in the normalised word: an automaton of all pieces finds its arcs, and a character that no piece covers
adds its byte arcs. The shortest path in the tropical semiring gives the pieces.

A byte-pair model is more than its scores: it merges. Its transducer is therefore composed with a
filter over neighbouring pieces, which lets b follow a only if merging the string ab gives back a, b.
A sequence is what merging gives exactly if all its neighbours pass, so for such a model one path is
left at each place, and encodings equal those of the sentencepiece library.

A text is composed word by word, where a word ends between characters that no piece joins (a mark
after another character, a letter and a comma), so paths never cross; what a word gave is kept in a
table of bounded size, which a worker process carries from task to task.

Cases: null and empty texts have no ids; no ids decode to the empty text. Decoding gives the text
back exactly, but for the mark itself (U+2581), which becomes a space. Very long words are walked in
time proportional to their length. Models with a character map, extra-space removal, user-defined
pieces or no byte fallback are refused.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Shared, in_parts

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Byte fallback is dearer than any piece.
BYTE_COST = 1e6
PAIR_BASE = 1 << 24
WORDS_KEPT = 250_000
PAIRS_KEPT = 300_000
_UNIGRAM, _BPE = 1, 2
_NORMAL, _BYTE = 1, 6
_USER_DEFINED = 4


@dataclass(frozen=True)
class Pieces:
    """What a model file says: text, score and kind of each id."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]
    merges: bool


def read_model(path: str = MODEL_PATH) -> Pieces:
    """Read a model on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as messages

    model = messages.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal, trainer = model.normalizer_spec, model.trainer_spec
    kinds = [piece.type for piece in model.pieces]
    plain = normal.add_dummy_prefix and normal.escape_whitespaces
    plain = plain and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap
    if not plain or trainer.model_type not in (_UNIGRAM, _BPE) or kinds.count(_BYTE) != 256 or _USER_DEFINED in kinds:
        raise ValueError(f"{path}: not a model with plain spaces and byte fallback")
    return Pieces(
        [piece.piece for piece in model.pieces],
        [piece.score for piece in model.pieces],
        kinds,
        trainer.model_type == _BPE,
    )


class WordTable(dict):
    """Ids of words as packed integers; filled on demand and emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = np.array(self.encode(word), np.int32).tobytes()
        if len(word) <= 64:
            self[word] = found
        return found


def _word_pattern(texts: list[str]) -> str:
    """Pattern of the parts of a text that no piece crosses: characters that stand next to each
    other in some piece, directly or through others, go together; marks go with what follows."""
    if any(MARK in text.lstrip(MARK) for text in texts):
        return ".+"
    group: dict[str, set[str]] = {}
    for text in texts:
        chars = set(text) - {MARK}
        if len(text.lstrip(MARK)) > 1:
            merged = set().union(chars, *(group[char] for char in chars if char in group))
            group.update(dict.fromkeys(merged, merged))
    groups = sorted({id(chars): chars for chars in group.values()}.values(), key=len, reverse=True)
    runs = "|".join(f"[{''.join(map(re.escape, sorted(chars)))}]+" for chars in groups)
    return f"{MARK}*(?:{runs}|[^{MARK}])|{MARK}+" if runs else f"{MARK}*[^{MARK}]|{MARK}+"


class Transducer:
    """The compiled transducers of a model."""

    def __init__(self, pieces: Pieces):
        normal = [k for k, kind in enumerate(pieces.kinds) if kind == _NORMAL]
        self.cost = {pieces.texts[k]: -pieces.scores[k] for k in normal}
        self.id_of = {pieces.texts[k]: k for k in normal}
        self.texts = pieces.texts
        self.trie = ahocorasick.Automaton()
        for text, number in self.id_of.items():
            self.trie.add_word(text, (number, len(text), self.cost[text]))
        self.trie.make_automaton()
        self.alone = {text for text in self.id_of if len(text) == 1}
        self.byte_ids = {int(t[3:5], 16): k for k, t in enumerate(pieces.texts) if pieces.kinds[k] == _BYTE}
        self.merges = pieces.merges
        self.follows: dict[int, bool] = {}
        self.words = re.compile(_word_pattern(list(self.id_of)), re.S).findall
        self.table = WordTable(self.shortest_path)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging, best score first, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            joined = [self.cost.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            place = min(range(len(joined)), key=joined.__getitem__)
            if joined[place] == np.inf:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def may_follow(self, first: int, second: int) -> bool:
        """Whether merging leaves two pieces as they are; filled on demand, emptied when full."""
        if len(self.follows) >= PAIRS_KEPT:
            self.follows.clear()
        pair = [self.texts[first], self.texts[second]]
        known = self.follows[first * PAIR_BASE + second] = self.merged("".join(pair)) == pair
        return known

    def shortest_path(self, word: str) -> list[int]:
        """Ids of the cheapest path of a normalised word.

        One path is kept per place: for a model of scores the cheapest, for a merging model the only
        one that the filter lets through.
        """
        size, inf = len(word), float("inf")
        cost, before, last = [0.0] + [inf] * size, [0] * (size + 1), [-1] * (size + 1)
        known, merges = self.follows.get, self.merges
        if self.alone.issuperset(word):
            arcs = self.trie.iter(word)
        else:
            fallback = [(k, (-1, 1, BYTE_COST)) for k, char in enumerate(word) if char not in self.alone]
            arcs = heapq.merge(self.trie.iter(word), fallback, key=itemgetter(0))
        # Arcs come in the order of their ends, so the cost of their starts is settled.
        for end, (piece, length, step) in arcs:
            end += 1
            start = end - length
            total = cost[start] + step
            if total < cost[end]:
                first = last[start]
                if merges and first >= 0 and piece >= 0:
                    passes = known(first * PAIR_BASE + piece)
                    if not (self.may_follow(first, piece) if passes is None else passes):
                        continue
                cost[end], before[end], last[end] = total, start, piece
        path, end = [], size
        while end:
            if last[end] >= 0:
                path.append(last[end])
            else:
                path += [self.byte_ids[byte] for byte in reversed(word[before[end] : end].encode("utf-8", "replace"))]
            end = before[end]
        return path[::-1]

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as packed 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self.table.__getitem__, self.words(MARK + text.replace(" ", MARK))))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


class Decoder:
    """The way back: pieces and bytes to text, without the space put in front."""

    def __init__(self, pieces: Pieces):
        self.outputs = [
            bytes([int(text[3:5], 16)]) if kind == _BYTE else text.replace(MARK, " ").encode() if kind == _NORMAL else b""
            for text, kind in zip(pieces.texts, pieces.kinds)
        ]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.outputs.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _with_columns(docs: DataFrame, columns: dict[str, T.DataType], made) -> DataFrame:
    """Append columns that ``made`` builds from each part of a batch; those of that name give way."""
    kept = docs.drop(*columns)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(*column) for column in columns.items())])
    arrow, names = to_arrow_schema(schema), kept.columns

    def run(batches):
        build = made()
        for batch in in_parts(batches):
            arrays = [batch.column(name) for name in names] + build(batch)
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return kept.mapInArrow(run, schema)


def _ids_array(packed: list[bytes]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(part) // 4 for part in packed])]).astype(np.int32)
    values = np.frombuffer(b"".join(packed), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


_IDS = {"ids": T.ArrayType(T.IntegerType())}
_DECODED = {"decoded": T.StringType()}


def encode_documents(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``docs`` with the column ``ids``."""
    shared = Shared(docs.sparkSession, pieces)

    def made():
        packed = shared.built(Transducer).packed
        return lambda batch: [_ids_array([packed(text) for text in batch.column("text").to_pylist()])]

    return _with_columns(docs, _IDS, made)


def decode_documents(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``docs`` with the column ``decoded``, made from ``ids``; null ids decode like none."""
    shared = Shared(docs.sparkSession, pieces)

    def made():
        decode = shared.built(Decoder).decode
        return lambda batch: [pa.array([decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())]

    return _with_columns(docs, _DECODED, made)


def expected_text(text) -> F.Column:
    """What decoding must give back for a text."""
    return F.translate(F.coalesce(text, F.lit("")), MARK, " ")


def round_trip(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``docs`` encoded and decoded in one pass, with ``n_pieces`` and whether the text came back."""
    shared = Shared(docs.sparkSession, pieces)

    def made():
        encoder, decoder = shared.built(lambda pieces: (Transducer(pieces), Decoder(pieces)))

        def build(batch):
            packed = [encoder.packed(text) for text in batch.column("text").to_pylist()]
            texts = [decoder.decode(np.frombuffer(part, np.int32).tolist()) for part in packed]
            return [_ids_array(packed), pa.array(texts, pa.string())]

        return build

    done = _with_columns(docs, _IDS | _DECODED, made)
    return done.withColumn("n_pieces", F.size("ids").cast("long")).withColumn(
        "round_trip", F.col("decoded") == expected_text(F.col("text"))
    )
