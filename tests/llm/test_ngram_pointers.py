"""The trie reads a context's successors through its pointers."""

import numpy as np

from probengine.llm import ngram_lm as lm


def test_a_bigram_is_sought_between_its_contexts_pointers():
    rng = np.random.default_rng(1)
    pairs = np.unique(np.stack([rng.integers(0, 40, 900), rng.integers(0, 50, 900)], axis=1), axis=0).astype(np.uint64)
    codes = rng.integers(1, 255, len(pairs)).astype(np.uint8)
    trie = lm.Trie(lm.Trie.build(pairs[:, 0], pairs[:, 1], codes))
    known = {(int(a), int(b)): int(c) for (a, b), c in zip(pairs, codes)}
    asked = np.array([(a, b) for a in range(42) for b in range(51)], dtype=np.uint64)
    want = [known.get((int(a), int(b)), 0) for a, b in asked]
    assert trie.lookup(asked[:, 0], asked[:, 1]).tolist() == want
    seen, real = [], trie.pointers.at
    trie.pointers.at = lambda i: (seen.append(len(i)), real(i))[1]
    assert trie.lookup(asked[:, 0], asked[:, 1]).tolist() == want and seen
