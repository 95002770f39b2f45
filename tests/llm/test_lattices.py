"""Lattices of units: what is looked up by hash and sorted by node is what plain searches and sorts give."""

import numpy as np
import public_tokenizers
import pytest

from lamina.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"), 0.5)


def test_steps_looked_up_by_hash_equal_a_search(vocabulary):
    rng = np.random.default_rng(3)
    wrong = rng.integers(0, len(vocabulary.whole), 200_000) << 21 | rng.integers(0, 1 << 16, 200_000)
    keys = np.concatenate((vocabulary.branch, vocabulary.branch + 1, wrong))
    spot, there = vocabulary.following(keys)
    assert vocabulary.crowded.any()  # keys of one hash are among them
    assert np.array_equal(there, np.isin(keys, vocabulary.branch))
    assert np.array_equal(vocabulary.branch[spot[there]], keys[there])


def test_edges_of_a_node_fall_in_chance():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 9, 500)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    chance = rng.integers(1, 6, firsts[-1]) / 6  # many are equal
    node = np.repeat(np.arange(500), counts)
    assert np.array_equal(pieces.falling(chance, firsts), np.lexsort((-chance, node)))
    assert not len(pieces.falling(chance[:0], np.zeros(1, np.int64)))


def test_chances_of_a_node_add_up_and_units_are_built_once(vocabulary):
    lattices = pieces.Lattices(vocabulary)
    units = [" word", " wörter", " 漢字", "\n", " x" * 1, " " + "long" * 40, "\U0001f600"]
    nodes = lattices.add(units)
    assert [lattices.node_of[u] for u in units] == nodes.tolist()
    edges = lattices.edges
    assert np.array_equal(lattices.add(units[::-1]), nodes[::-1]) and lattices.edges == edges
    sums = np.add.reduceat(lattices.chance[:edges], lattices.first[:lattices.nodes])
    assert np.allclose(sums, 1)


def test_arrays_stay_when_units_are_forgotten(vocabulary):
    lattices = pieces.Lattices(vocabulary, room=10)
    lattices.add([" " + "abc" * 3000, *(f" unit{k}" for k in range(4000))])
    held = len(lattices.chance)
    assert held > 1 << 14
    nodes = lattices.add([" other"])
    assert nodes.tolist() == [0] and len(lattices.node_of) == 1 and len(lattices.chance) == held
