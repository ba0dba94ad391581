"""SentencePiece coding against the library, against all segmentations, and by round trips."""

import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from odd_texts import ODD

from tidewire.llm import pieces
from tidewire.llm.queries import PIECES

needs_file = pytest.mark.skipif(not os.path.exists(PIECES), reason="no vocabulary file")


@needs_file
def test_equals_the_library():
    import sentencepiece

    sp, e = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Encoder(pieces.PieceModel.load(PIECES))
    rng = random.Random(0)
    alphabet = "abe thing,.!# éß漢▁\n\t\x00😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(1500)] + [t for t in ODD if t is not None] + [" ", "   ", "a" + " " * 30 + "b", "x.y,z", "don't (stop) … “now”."]
    want = sp.encode(texts)
    assert [x.tolist() for x in e.encode(texts)] == want
    assert e.encode_array(pa.array(texts)).to_pylist() == want
    plain = [t for t in texts if pieces.MARK not in t]
    assert [e.decode(i) for i in e.encode(plain)] == plain
    assert e.encode_array(pa.array([None, "", "a"])).to_pylist()[:2] == [None, []]
    many = pa.array(texts)
    assert e.encode_array(many.slice(100, 300)).to_pylist() == want[100:400]


def test_unigram_is_the_best_segmentation():
    rng = random.Random(1)
    vocabulary = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(25)} | {"a", "b", "▁"})
    scores = [-rng.random() * len(p) - 0.5 for p in vocabulary]
    e = pieces.Encoder(pieces.PieceModel(vocabulary, scores, bpe=False))

    def best(word):
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(word)), k) for k in range(len(word)))
        splits = ([word[a:b] for a, b in zip((0, *c), (*c, len(word)), strict=True)] for c in cuts)
        return max(sum(scores[e.ids[p]] for p in s) for s in splits if all(p in e.ids for p in s))

    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    for word, parts in e.walk(words):
        assert "".join(parts) == word and abs(sum(scores[e.ids[p]] for p in parts) - best(word)) < 1e-9


@needs_file
def test_frames(spark, odd, none):
    model = pieces.PieceModel.load(PIECES)
    out = pieces.decode(pieces.encode(odd, model), model)
    assert out.columns == [*odd.columns, "ids", "decoded"]
    for r in out.collect():
        assert (r["ids"] is None) == (r["text"] is None) and (r["decoded"] == r["text"] or "▁" in r["text"])
    trip = pieces.round_trip(odd, model).collect()
    assert len(trip) == odd.count() and sum(r["same"] is False for r in trip) == 1
    assert pieces.encode(none, model).count() == 0 and pieces.round_trip(none, model).count() == 0


@needs_file
def test_small_cache_changes_nothing(monkeypatch):
    model = pieces.PieceModel.load(PIECES)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcde ing") for _ in range(300)) for _ in range(40)]
    want = [x.tolist() for x in pieces.Encoder(model).encode(texts)]
    monkeypatch.setattr(pieces, "CACHE_WORDS", 50)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 30)
    e = pieces.Encoder(model)
    assert [e.encode([t])[0].tolist() for t in texts] == want
    assert np.concatenate([e.encode_array(pa.array([t])).values for t in texts]).tolist() == [i for w in want for i in w]


@needs_file
def test_model_type_is_read_from_the_file(tmp_path):
    with open(PIECES, "rb") as f:
        content = f.read()

    def load(more):
        (tmp_path / "m.model").write_bytes(content + more)
        return pieces.PieceModel.load(str(tmp_path / "m.model"))

    # Later fields of a message win: the trainer's model type, the normaliser's mark before the first word and removal of spaces.
    assert load(b"").bpe and not load(b"\x12\x02\x18\x01").bpe
    for more in (b"\x12\x02\x18\x04", b"\x1a\x02\x18\x00", b"\x1a\x02\x20\x01"):
        with pytest.raises(ValueError):
            load(more)


@needs_file
def test_long_words_are_not_kept(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CHARS", 500)
    model, rng = pieces.PieceModel.load(PIECES), random.Random(3)
    texts = ["".join(rng.choice("abcdé漢") for _ in range(rng.choice([5, 90, 4000]))) + " and so on" for _ in range(60)]
    want = [x.tolist() for x in pieces.Encoder(model).encode(texts)]
    e = pieces.Encoder(model)
    assert [e.encode([t])[0].tolist() for t in texts] == want
    assert sum(len(w) for w in e.words if len(w) <= pieces.LONGEST_CACHED) <= 500 + 200 and sum(len(w) > pieces.LONGEST_CACHED for w in e.words) <= 1
