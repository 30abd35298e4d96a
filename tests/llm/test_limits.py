"""Counts beyond 32 bits, vocabularies that no pair key could hold, and link tables of long chains."""

import random

import numpy as np
import pytest

from sigloom.llm import jaccard_join, language_model
from sigloom.llm.components import components
from sigloom.llm.language_model import narrowest, unpacked
from sigloom.llm.sketch import MOST_BITS, Sketch


@pytest.mark.parametrize("columns", [1, 4])
@pytest.mark.parametrize("top,size", [(7, 4), (2**32 - 1, 4), (2**32, 8), (2**45, 8)])
def test_counts_of_any_size_survive_packing(columns, top, size):
    values = np.array([[1] * columns, [top] * columns, [0] * columns], np.int64)
    raw = narrowest(values).tobytes()
    assert len(raw) == 3 * columns * size
    assert (unpacked(raw, 3) == values).all()


def test_too_many_words_for_a_pair_key_are_refused(odd_docs, monkeypatch):
    monkeypatch.setattr(language_model, "_MOST_WORDS", 3)
    with pytest.raises(ValueError, match="distinct words"):
        language_model.train(odd_docs)


def test_two_attempts_of_a_shard_do_not_share_a_file(tmp_path, monkeypatch):
    names = []
    monkeypatch.setattr(language_model.os, "replace", lambda part, path: names.append(part))
    for _ in range(2):
        language_model.save(str(tmp_path / "words-0.npy"), np.arange(3))
    assert len(set(names)) == 2


def test_components_of_long_chains(spark):
    chains = [(0, 400), (1000, 1400)]
    links = [(i, i + 1) for low, high in chains for i in range(low, high)]
    random.Random(5).shuffle(links)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == 802
    assert all(r["comp"] == (0 if r["node"] <= 400 else 1000) for r in found)


def test_sketches_grow_with_their_keys():
    sizes = [(0, 20), (1, 20), (2**20, 20), (2**20 + 1, 21), (2**27 + 1, 28), (2**50, MOST_BITS)]
    assert [(cells, Sketch(rows=1, bits=20).grown(cells).bits) for cells, _ in sizes] == sizes


def test_linked_sets_of_different_components_are_compared(spark):
    rng, percent = random.Random(7), 80
    sets = [sorted(rng.sample(range(1, 400), rng.randint(3, 60))) for _ in range(30)]
    for i in range(30):
        edited = set(sets[i]) - set(rng.sample(sets[i], len(sets[i]) // rng.choice([6, 10, 30])))
        sets.append(sorted(edited | set(rng.sample(range(1, 400), rng.randint(0, 2)))))
    rows = [(t, i, len(s), place, i) for i, s in enumerate(sets) for place, t in enumerate(s[: len(s) - -(-percent * len(s) // 100) + 1])]
    entries = spark.createDataFrame(rows, "token long, id long, n long, place long, comp long")
    found = {(r.a, r.probe) for r in jaccard_join.open_pairs(entries, percent).collect()}
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})}
    assert len(linked) > 10 and linked <= found
