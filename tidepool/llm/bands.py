"""The bands of ``operators.bands``, which the near duplicates use."""

from tidepool.operators.bands import BITS, Block, Like, alike, banded_pairs, coarse, groups, kinds, levels, meeting, numbers, parity, trigram_keys, unit  # noqa: F401
