"""Merging of Burrows-Wheeler transforms of shards by iterative interleave refinement.

Texts are read in blocks of `block` bytes; a block is a symbol. The transform of a shard lists, in the
order of its suffixes, the block before each suffix. To merge shards nothing but their transforms and
an interleave is needed: the shard of each suffix in the common order. It begins as shard after shard.
Each round reads the transforms in the order of the interleave and deals what comes out stably by its
symbol, which is the interleave for prefixes that are a block longer. Neighbours are told apart as soon
as a symbol or the class of what follows differs, so that after r rounds the classes are the intervals
of suffixes with a common prefix of r blocks. No suffix is sorted again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Suffixes:
    """All suffixes of texts, the empty ones too, text after text: symbol (ends below all blocks), and the suffix a block on, or -1."""

    symbol: np.ndarray
    following: np.ndarray


def suffixes(hashes: np.ndarray, sizes: np.ndarray, block: int) -> Suffixes:
    """Suffixes of texts of `sizes` bytes; hashes: of the blocks that start at each of their bytes, as far as there are whole ones."""
    n = int(sizes.sum() + len(sizes))
    at = np.arange(n) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)
    whole = np.repeat(sizes, sizes + 1) - at >= block
    symbol = np.empty(n, np.int64)
    symbol[~whole] = np.arange(n - int(whole.sum()))
    symbol[whole] = np.unique(hashes, return_inverse=True)[1] + n
    return Suffixes(symbol, np.where(whole, np.arange(n) + block, -1))


def order(own: Suffixes) -> np.ndarray:
    """The suffixes in their order, by doubling."""
    n, following = len(own.symbol), own.following
    rank = np.unique(own.symbol, return_inverse=True)[1]
    while n and rank.max() < n - 1:
        rank = np.unique(rank * (n + 1) + np.where(following >= 0, rank[following] + 1, 0), return_inverse=True)[1]
        following = np.where(following >= 0, following[following], -1)
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def transform(own: Suffixes, ordered: np.ndarray) -> np.ndarray:
    """The symbol before each suffix in order; -1: it starts its text."""
    before = np.full(len(ordered), -1, np.int64)
    inner = own.following >= 0
    before[own.following[inner]] = own.symbol[inner]
    return before[ordered]


def _dealt(symbols: np.ndarray) -> np.ndarray:
    """Stable order by symbol, by its halves of 16 bits."""
    low = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if symbols.max(initial=0) < 1 << 16:
        return low
    return low[np.argsort((symbols[low] >> 16).astype(np.uint16), kind="stable")]


def merge(transforms: list[np.ndarray], ends: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, class of each suffix in it) after `rounds`; ends: the number of suffixes below a block in each shard.

    Symbols must be the same numbers in all shards and below 2^32.
    """
    shards = np.arange(len(transforms), dtype=np.uint16)
    interleave = np.repeat(shards, [len(t) for t in transforms])
    classes = np.zeros(len(interleave), np.int64)
    symbols, first = np.concatenate(transforms), np.repeat(shards, ends)
    came = np.empty(len(symbols), np.int64)
    for _ in range(rounds):
        came[np.argsort(interleave, kind="stable")] = symbols
        inner = came >= 0
        symbol, shard, known = came[inner], interleave[inner], classes[inner]
        deal = _dealt(symbol)
        symbol, shard, known = symbol[deal], shard[deal], known[deal]
        new = np.ones(len(symbol), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (known[1:] != known[:-1])
        interleave = np.concatenate([first, shard])
        classes = np.concatenate([np.arange(len(first)), len(first) - 1 + np.cumsum(new)])
    return interleave, classes
