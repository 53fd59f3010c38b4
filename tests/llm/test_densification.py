"""Every bin takes the value of a filled one, whichever bins are filled."""

import numpy as np

from epipanel.llm import fingerprints
from epipanel.llm.fingerprints import BINS


def unreached():
    """Pairs of bins that the draws of some other bin never lead to."""
    steps = np.concatenate([fingerprints._steps(i) for i in range(fingerprints.STEPS)])
    missing = np.ones((BINS, BINS), bool)  # bin, bin that its draws do not name
    missing[np.arange(BINS), steps] = False
    found = set()
    for b in range(BINS):
        left = np.setdiff1d(np.flatnonzero(missing[b]), [b])
        found |= {(x, y) for i, x in enumerate(left.tolist()) for y in left[i + 1:].tolist()}
    return sorted(found)


def test_pairs_that_the_draws_miss():
    pairs = unreached()
    assert pairs  # else this test shows nothing
    for pair in pairs:
        filled = np.zeros(BINS, bool)
        filled[list(pair)] = True
        source = fingerprints.densified(filled)
        assert filled[source].all() and (source[list(pair)] == pair).all()
        assert (fingerprints.densified(filled) == source).all()


def test_pairs():
    """Every 97th pair here; the other test has all that the draws miss, and the rest end within the draws. All 130,816
    pairs passed once, in three minutes."""
    x, y = np.triu_indices(BINS, 1)
    for pair in np.stack([x, y], 1)[::97]:
        filled = np.zeros(BINS, bool)
        filled[pair] = True
        assert filled[fingerprints.densified(filled)].all()


def test_orders_are_permutations():
    assert (np.sort(fingerprints._orders(), axis=0) == np.arange(BINS)[:, None]).all()


def test_short_texts_without_common_words_are_unlike():
    rng = np.random.default_rng(4)
    for n in range(1, 13):
        for _ in range(150):
            one, two = ([b"w%d" % i for i in rng.integers(0, 10 ** 9, n)] for _ in range(2))
            a, b = fingerprints.fingerprint(one), fingerprints.fingerprint(two)
            assert fingerprints.likeness(a, b) < 0.2 and fingerprints.likeness(a, a) == 1.0
            assert fingerprints.likeness(a, fingerprints.fingerprint(list(one))) == 1.0
