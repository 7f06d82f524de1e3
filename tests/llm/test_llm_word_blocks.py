"""What the splitting of a block of texts and the scoring of its words hold at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from scriptorium.llm import toxicity, words


def _texts(seed, n):
    letters = np.random.default_rng(seed).integers(97, 123, (n, 12), dtype=np.uint8)
    letters[:, 7] = 32
    return letters.tobytes().decode()


def _peak(work):
    tracemalloc.start()
    out = work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_words_are_hashed_in_little_room():
    texts = pa.array([_texts(1, 350_000)])
    assert _peak(lambda: words.split(texts))[1] < 20 * texts.nbytes


def test_hashes_do_not_depend_on_what_is_hashed_together(monkeypatch):
    texts = pa.array(["", None, "a", "x" * 5000 + " b", "É日本 A-b_c", " ", _texts(2, 900), "end", "", "Q", "q"])
    whole = words.split(texts)
    assert len(whole.hashes) == len(whole.starts) and whole.hashes[-1] == whole.hashes[-2]
    for room in (1, 7, 100, 5001):
        monkeypatch.setattr(words, "HASH_BYTES", room)
        assert (words.split(texts).hashes == whole.hashes).all()
    assert words.split(pa.array([None, ""], pa.string())).hashes.dtype == np.uint64


def _model():
    sides = []
    for seed in (3, 4):
        _, counts, spelt = toxicity.distinct(words.split(pa.array([_texts(seed, 2000)])))
        sides.append(toxicity.adjusted(toxicity.grams(spelt, toxicity.ORDER), spelt, counts, toxicity.ORDER))
    keys = toxicity.grams(spelt, toxicity.SHARED)[-1][spelt.depth >= toxicity.SHARED].tolist()
    return toxicity.Model(toxicity.base_model({k: 1.0 + k % 5 for k in keys}), sides)


def test_evidence_is_looked_up_in_pieces(monkeypatch):
    model = _model()
    _, _, spelt = toxicity.distinct(words.split(pa.array([_texts(3, 80_000), "a", "w" * 3000, _texts(5, 500)])))
    model.evidence(spelt)
    pieced, peak = _peak(lambda: model.evidence(spelt))
    assert peak < 100 * len(spelt.symbols)
    for room in (1 << 40, 500):
        monkeypatch.setattr(toxicity, "PIECE", room)
        other = model.evidence(spelt)
        assert len(other) == len(spelt.begins) and (pieced == other).all()
    assert len(model.evidence(toxicity.distinct(words.split(pa.array(["", None])))[2])) == 0
