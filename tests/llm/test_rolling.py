import numpy as np

from tidebook.llm.rolling import Roller


def test_equal_substrings_have_equal_hashes_and_others_don_t():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    data[3000:3500] = data[100:600]
    roll = Roller(data)
    every = roll.every(9)
    pieces = [data[i : i + 9].tobytes() for i in range(len(every))]
    assert len(set(zip(pieces, every.tolist()))) == len(set(pieces)) == len(set(every.tolist()))
    start = rng.integers(0, 3990, 3000)
    stop = start + rng.integers(0, 10, 3000)
    found = roll.of(start, stop).tolist()
    pieces = [data[a:b].tobytes() for a, b in zip(start, stop)]
    assert len(set(zip(pieces, found))) == len(set(pieces)) == len(set(found))
    assert roll.powers[1] * roll.inverses[1] == 1
