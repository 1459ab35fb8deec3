"""What a pair at the threshold risks, by the binomial distribution of coordinates that agree."""

from math import ceil, comb

import numpy as np
from siltstone.llm import dartminhash as dm


def test_a_pair_at_the_threshold_is_hardly_ever_lost():
    assert (1 - dm.LEAST**dm.ROWS) ** dm.BANDS < 1e-8
    agree = dm.LEAST + (1 - dm.LEAST) / 256
    least = ceil(((dm.LEAST - dm.SLACK) * 255 / 256 + 1 / 256) * dm.K)
    assert sum(comb(dm.K, i) * agree**i * (1 - agree) ** (dm.K - i) for i in range(least)) < 1e-6


def test_all_coordinates_are_in_bands_and_pairs_at_the_threshold_share_one():
    assert dm.BANDS * dm.ROWS == dm.K
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(3000):  # 80 of 100 elements are shared
        u = rng.integers(0, 2**63, 100).astype(np.uint64)
        sets += [(u[:90], np.ones(90)), (u[10:], np.ones(90))]
    sig = dm.signatures(sets).reshape(3000, 2, dm.K)
    same = (sig[:, 0] == sig[:, 1])[:, : dm.BANDS * dm.ROWS].reshape(3000, dm.BANDS, dm.ROWS)
    assert same.all(axis=2).any(axis=1).all()
