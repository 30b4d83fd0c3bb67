"""Rotations are learned from all sampled rows."""

import numpy as np

from schemaloom.llm.ann import learn_codes


def test_rows_beyond_8192_shape_the_rotations():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((9000, 8)) * np.where(np.arange(9000) < 8192, 1, 3)[:, None] * np.linspace(1, 4, 8)
    scale = float(np.linalg.norm(x, axis=1).max())
    assert not np.allclose(learn_codes(x, scale, 5, 0.97).rotations, learn_codes(x[:8192], scale, 5, 0.97).rotations)
