import numpy as np
import pytest

from tierflow.operators import qpolicy


def test_equal_changes_take_no_share():
    """A difference of zero once got a share of 1e139, and the values overflowed."""
    rng = np.random.default_rng(3)
    differences, change = rng.normal(size=(6, 9)), rng.normal(size=9)
    with_none = np.insert(differences, 2, 0.0, axis=0)
    shares = qpolicy._shares(with_none @ with_none.T, with_none @ change)
    alone = qpolicy._shares(differences @ differences.T, differences @ change)
    assert shares[2] == 0
    assert np.delete(shares, 2) == pytest.approx(alone)
    assert (qpolicy._shares(np.zeros((2, 2)), np.zeros(2)) == 0).all()
