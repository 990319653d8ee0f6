"""Ids that the stated width does not hold are an error, never other ids."""

from __future__ import annotations

import numpy as np
import pytest

from wireloom.llm.token_store import pack, unpack


@pytest.mark.parametrize("bits", [3, 8, 15, 16, 17, 31])
def test_pack_holds_or_raises(bits):
    top = (1 << bits) - 1
    ids = np.array([0, 1, top, top - 1], "<u4")
    assert unpack(pack(ids, bits), bits, 0, 4).tolist() == ids.tolist()
    with pytest.raises(ValueError, match="bits"):
        pack(np.array([1, top + 1], "<u4"), bits)


def test_full_width_and_nothing():
    ids = np.array([0, 2**32 - 1], "<u4")
    assert unpack(pack(ids, 32), 32, 0, 2).tolist() == ids.tolist()
    assert pack(np.empty(0, "<u4"), 16) == b""
