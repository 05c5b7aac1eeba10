from math import comb

import numpy as np
import pyarrow as pa

from tidemark.llm import minhash
from tidemark.llm.superminhash import SLOTS


def test_slots_lose_less_than_bands():
    least = min(n for n in range(SLOTS + 1) if n >= minhash.LEAST_ALIKE * SLOTS)
    lost = sum(comb(SLOTS, n) * 0.8**n * 0.2 ** (SLOTS - n) for n in range(least))
    assert lost < 0.01 * (1 - 0.8 ** (SLOTS // minhash.BANDS)) ** minhash.BANDS


def test_pairs_of_fewer_equal_slots_are_confirmed():
    x = np.arange(SLOTS, dtype=np.uint16)
    y = np.where(np.arange(SLOTS) < 74, x, x + 1000).astype(np.uint16)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([x.tobytes()]), pa.array([y.tobytes()])], names=["a", "b", "sig_a", "sig_b"])
    assert [b.to_pylist() for b in minhash._alike(iter([batch]))] == [[{"a": 1, "b": 2}]]
    pairs = list(minhash._open_pairs(np.stack([x, y]), np.array([1, 2]), np.zeros(2, int), 0, False))
    assert [p.T.tolist() for p in pairs] == [[[0, 1]]]
