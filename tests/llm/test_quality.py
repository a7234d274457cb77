import numpy as np
import pytest

from changetree.llm import quality


@pytest.mark.parametrize("pairs", [1, 99, 100, 101, 5000])
def test_share_of_repeated_lines_does_not_depend_on_their_number(pairs):
    twice = [f"line number {k}" for k in range(pairs)] * 2
    once = [f"other line {k}" for k in range(pairs)]
    got = quality.features(["\n".join(twice), "\n".join(once), "\n\n".join(twice + once)])[:, -1]
    share = sum(map(len, twice)) / sum(map(len, twice + once))
    assert np.allclose(got, [1, 0, share], atol=1e-6)
