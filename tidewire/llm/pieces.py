"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is marked (spaces become the word mark) and cut into marked words; pieces never cross their borders. The
distinct words of a batch are sorted, which is a depth-first walk of their trie: the forward state of every prefix is
kept, and a word starts where it parts from the one before it. For a unigram model the state is the best score and
last piece of a prefix (Viterbi). For a BPE model it is the last piece of the prefix's merge result, found as the
longest piece that the merges leave standing beside the last piece before it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, text_batches, to_python

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_LINE_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_MARKS = "!#$%&*,.:;?|"
#: Words and pairs of pieces that a worker keeps between tasks.
REST_WORDS, REST_PAIRS = 20_000, 50_000
#: Words and pairs of pieces that a worker remembers in a task, and characters of the words; longer words are forgotten after their batch.
CACHE_WORDS, CACHE_PAIRS, CACHE_CHARS, LONGEST_CACHED = 200_000, 230_000, 4_000_000, 100
# Numbers of the model file's fields and of its model types.
_TRAINER, _NORMALIZER, _MODEL_TYPE, _SUFFIX = 2, 3, 3, 24
_CHARSMAP, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 2, 3, 4, 5
_UNIGRAM, _BPE = 1, 2


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message: integers, or the bytes of others."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(tag & 7) or varint(at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class PieceModel:
    """Pieces with their ids and scores, and the ids of the 256 byte pieces (empty: unknown characters become ``unknown``)."""

    pieces: list[str]
    scores: list[float]
    bpe: bool = True
    byte_ids: list[int] = field(default_factory=list)
    special: frozenset[int] = frozenset()
    unknown: int = 0

    def __post_init__(self) -> None:
        self.key = zlib.crc32(repr((self.pieces, self.scores, self.bpe, self.byte_ids)).encode("utf-8", "replace"))

    @staticmethod
    def load(path: str) -> PieceModel:
        """Read a SentencePiece model file (the library only reads the file).

        Unigram and BPE models are told apart by the file. Models that change texts before they are cut (character maps,
        removal of spaces, no mark before the first word or marks behind words) raise an error: nothing here does that.
        """
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        trainer, normalizer = {}, {}
        for k, v in _fields(p.serialized_model_proto()):
            if k in (_TRAINER, _NORMALIZER):
                (trainer if k == _TRAINER else normalizer).update(_fields(v))
        kind = trainer.get(_MODEL_TYPE, _UNIGRAM)
        if kind not in (_UNIGRAM, _BPE):
            raise ValueError(f"{path}: neither a unigram nor a BPE model")
        if normalizer.get(_CHARSMAP) or not normalizer.get(_DUMMY_PREFIX, 1) or normalizer.get(_EXTRA_SPACES, 1) or not normalizer.get(_ESCAPE_SPACES, 1) or trainer.get(_SUFFIX):
            raise ValueError(f"{path}: the model normalises texts or marks words in another way")
        ids = range(p.get_piece_size())
        special = frozenset(i for i in ids if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))
        return PieceModel([p.id_to_piece(i) for i in ids], [p.get_score(i) for i in ids], kind == _BPE, [i for i in ids if p.is_byte(i)], special, p.unk_id())


class Encoder:
    def __init__(self, model: PieceModel):
        self.m = model
        self.ids = {p: i for i, p in enumerate(model.pieces) if i not in model.special}
        self.longest = max(map(len, self.ids), default=1)
        self.words: dict[str, tuple[int, ...]] = {}
        self.chars, self.long = 0, []
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Pieces that the merges make of their own characters.
        self.good = {p: p for p in self.ids if not model.bpe or self.merged(p) == [p]}
        # A line end that no longer piece holds is a border too.
        self.border = _WORD if any("\n" in p and len(p) > 1 for p in self.good) else _LINE_WORD
        # Marks that stand behind no letter or digit in any piece are borders there: no merge crosses them.
        self.ends = "".join(c for c in _MARKS if not any(p[i] == c and p[i - 1].isalnum() for p in self.good for i in range(1, len(p))))
        self.plain = [p.replace(MARK, " ") for p in model.pieces]
        for i in model.special:
            self.plain[i] = ""
        for b, i in enumerate(model.byte_ids):
            self.plain[i] = chr(b) if b < 128 else ""
        self.high = np.zeros(len(model.pieces), bool)
        self.high[model.byte_ids[128:]] = True

    def merged(self, word: str) -> list[str]:
        """Pieces of a word by the merges themselves: the adjacent pair of the best score first, the leftmost of equals."""
        parts, ids, scores = list(word), self.ids, self.m.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def beside(self, a: str, b: str) -> bool:
        """True if the merges of a + b leave the two pieces as they are."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Pieces of sorted distinct words; forward states of common prefixes are kept from word to word."""
        ids, longest, scores, good, pairs, beside = self.ids, self.longest, self.m.scores, self.good, self.pairs, self.beside
        worst = min(scores, default=0.0) - 10.0
        last: list[str] = []  # the last piece of each prefix
        total: list[float] = [0.0]
        before = ""
        for word in words:
            n = min(len(before), len(word))
            k = 0
            while k < n and before[k] == word[k]:
                k += 1
            del last[k:], total[k + 1 :]
            for end in range(k + 1, len(word) + 1):
                start = end - longest if end > longest else 0
                if self.m.bpe:
                    while True:
                        piece = good.get(word[start:end])
                        if piece is None and start == end - 1:
                            piece = word[start:end]
                        if piece is not None:
                            if start == 0:
                                break
                            ok = pairs.get((last[start - 1], piece))
                            if ok or (ok is None and beside(last[start - 1], piece)):
                                break
                        start += 1
                    last.append(piece)
                else:
                    best, which = -np.inf, ""
                    for start in range(start, end):
                        i = ids.get(word[start:end])
                        s = total[start] + (scores[i] if i is not None else worst if end - start == 1 else -np.inf)
                        if s > best:
                            best, which = s, word[start:end]
                    last.append(which)
                    total.append(best)
            before = word
            out, at = [], len(word)
            while at:
                out.append(last[at - 1])
                at -= len(last[at - 1])
            yield word, out[::-1]

    def _ids(self, parts: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.m.byte_ids:
                out.extend(self.m.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.m.unknown)
        return tuple(out)

    def _learn(self, words: set[str] | list[str]) -> None:
        """Make sure that marked words are in the cache."""
        known = self.words
        for word in self.long:
            known.pop(word, None)
        self.long = []
        if len(known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            # The first words met are mostly the common ones.
            self.words = known = {w: known[w] for w in list(known)[: len(known) // 2]}
            self.chars = sum(map(len, known))
        for word, parts in self.walk(sorted(w for w in words if w not in known)):
            known[word] = self._ids(parts)
            if len(word) > LONGEST_CACHED:
                self.long.append(word)
            else:
                self.chars += len(word)

    def rest(self) -> None:
        """Keep the first words and pairs met, which are mostly the common ones, and give the rest of the memory back: idle workers stay beside others of their executor."""
        self.words, self.long = {w: x for w, x in list(self.words.items())[:REST_WORDS] if len(w) <= LONGEST_CACHED}, []
        self.chars = sum(map(len, self.words))
        self.pairs = dict(list(self.pairs.items())[:REST_PAIRS])
        release()

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; null for null, none for an empty text."""
        split = [None if t is None else self.border.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self._learn({w for s in split if s for w in s})
        return [None if s is None else np.fromiter(chain.from_iterable(map(self.words.__getitem__, s)), np.int32) for s in split]

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """As ``encode``; texts without runs of spaces are cut and their distinct words found by Arrow's kernels.

        A line end stands as a word of its own there, and what follows it is a word without a mark, told by a \\x01.
        """
        texts = pa.concat_arrays([texts.slice(0, 0), texts])  # a copy: some kernels misread slices
        odd = pc.or_(pc.match_substring_regex(texts, f"  |\x01|{MARK}"), pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")))
        odd = pc.fill_null(odd, False).to_numpy(zero_copy_only=False)
        if self.border is _WORD:
            odd[:] = True
        plain = pc.if_else(pa.array(odd), pa.scalar(None, pa.string()), texts)
        if self.ends:
            plain = pc.replace_substring_regex(plain, f"([\\pL\\pN])([{re.escape(self.ends)}])", "\\1 \x01\\2")
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n \x01"), " ")
        cut = lists.flatten().dictionary_encode()
        words = [w[1:] if w[:1] == "\x01" else w if w == "\n" else MARK + w for w in cut.dictionary.to_pylist()]
        self._learn(words)
        ids = list(map(self.words.__getitem__, words)) if "" not in words else [self.words[w] if w else () for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(starts[-1]))
        at = cut.indices.to_numpy()
        # Place of every id: the start of its word's ids plus its own number there.
        n = sizes[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if not odd.any():
            valid = texts.is_valid().to_numpy(zero_copy_only=False)
            return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out), mask=pa.array(~valid)) if len(valid) else pa.array([], pa.list_(pa.int32()))
        slow = iter(self.encode([t for t, o in zip(texts.to_pylist(), odd, strict=True) if o]))
        rows = [next(slow) if o else out[a:b] if v else None for o, a, b, v in zip(odd, bounds[:-1], bounds[1:], texts.is_valid().to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.int32()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces joined as UTF-8, word marks turned to spaces, the first one dropped."""
        if not self.high[ids].any():
            return "".join(map(self.plain.__getitem__, ids.tolist()))[1:]
        byte_of = {i: b for b, i in enumerate(self.m.byte_ids)}
        raw = b"".join(bytes([byte_of[i]]) if i in byte_of else self.plain[i].encode("utf-8", "surrogatepass") for i in ids.tolist())
        return raw.decode("utf-8", "replace")[1:]


_ENCODER: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for a worker, with its caches, as long as the worker lives."""
    key = shared.value.key
    if key not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[key] = Encoder(shared.value)
    return _ENCODER[key]


def _broadcast(df: DataFrame, model: PieceModel):
    shared = df.sparkSession.sparkContext.broadcast(model)  # a vocabulary: its size doesn't depend on the data
    return shared


def encode(docs: DataFrame, model: PieceModel, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``out_col``: the piece ids (array<int>) of each text.

    Null texts get null, empty ones an empty array; texts are encoded whole. As in the library, word marks in a text
    are taken for spaces. A column named ``out_col`` is replaced.
    """
    shared = _broadcast(docs, model)
    source = to_python(docs.drop(out_col))
    names = source.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for batch in text_batches((b.rename_columns(["text" if i == at else f"c{i}" for i in range(len(names))]) for b in batches), 2 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, e.encode_array(batch.column("text"))], [*names, out_col])
        e.rest()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{schema}, `{out_col}` array<int>")


def decode(encoded: DataFrame, model: PieceModel, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns and ``out_col``: the text of the piece ids; null for null. A column named ``out_col`` is replaced."""
    shared = _broadcast(encoded, model)
    source = to_python(encoded.drop(out_col))
    names = source.columns
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for batch in batches:
            texts = [None if not x.is_valid else e.decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{schema}, `{out_col}` string")


def round_trip(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc, same) of every row: tokens, CRC-32 of the ids as little-endian int32, and whether decoding gives the text back.

    Null texts have null results. ``same`` is false only where the text itself holds word marks, which decode to spaces.
    """
    shared = _broadcast(docs, model)
    source = to_python(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for batch in text_batches(batches, 4 << 20):
            texts = batch.column("text").to_pylist()
            ids = [x.values.to_numpy() if x.is_valid else None for x in e.encode_array(batch.column("text"))]
            same = [None if t is None else e.decode(i) == t for t, i in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([None if i is None else len(i) for i in ids], pa.int64()), pa.array([None if i is None else zlib.crc32(i.astype("<i4").tobytes()) for i in ids], pa.int64()), pa.array(same, pa.bool_())],
                ["id", "n_tokens", "ids_crc", "same"],
            )
        e.rest()

    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids_crc long, same boolean").withColumnRenamed("id", id_col)
