"""Settings from dictionaries."""

from __future__ import annotations

import pytest

from tinctura.functions.concepts import Quality
from tinctura.operators.canonical import Cleaning
from tinctura.settings import read


def test_read():
    got = read(Cleaning, {"untrusted": ["a", "b"], "quality": {"max_words": 2}, "train": 0.7, "dev": None})
    assert got == Cleaning(untrusted=("a", "b"), quality=Quality(max_words=2), train=0.7)
    assert read(Quality, None) == Quality()
    with pytest.raises(ValueError, match="max_wrods"):
        read(Quality, {"max_wrods": 2})
