"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits of the lower-cased text, in any script; where
words are not set apart by blanks (Chinese, Japanese kana, Thai, ...) every letter is a
token. Documents and benchmark
items that share a run of ``tile`` tokens (a seed) are joined in each task against an
index of the items; a pair whose seeds cover too little of the item is dropped, since
no tile can lie outside them. For the rest, running Karp-Rabin marks the longest
matches that do not overlap, again and again, down to ``tile`` tokens. An item whose
marked share reaches ``threshold`` leaks into the document, also when its passages
stand there in another order.

The items are handled in blocks of bounded size, each against all documents, so the
index that goes to the tasks never exceeds ``BLOCK_BYTES`` of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .memory import lean
from .names import column, numbered

TILE, THRESHOLD = 5, 0.5
BLOCK_BYTES = 8 << 20
_U = np.uint64

#: Candidate pairs and seeds that are held at once.
HELD = 1 << 20

#: ASCII signs and blanks; texts with others have them made blanks first.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SIGNS = r"[^\p{L}\p{M}\p{N}]+"
_ALONE = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows in order, and where each row starts (n + 1)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.utf8_lower(texts)
    other = pc.invert(pc.fill_null(pc.string_is_ascii(texts), True))
    if pc.any(other).as_py():
        some = pc.replace_substring_regex(texts.filter(other), _SIGNS, " ")
        some = pc.replace_substring_regex(some, _ALONE, r" \1 ")
        texts = pc.replace_with_mask(texts, other, some)
    return words.word_hashes(*words.utf8(texts), blank=_SEPARATOR)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` tokens."""
    n = max(len(hashes) - size + 1, 0)
    out = np.zeros(n, _U)
    for j in range(size):
        out = out * _U(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return words.mix(out)


class Index:
    """Seeds of a block of items."""

    def __init__(self, ids: list[int | None], texts: list[str], tile: int):
        self.ids = ids
        self.hashes, self.start = tokens(pa.array(texts, pa.string()))
        self.sizes = np.diff(self.start)
        self.tile = tile
        #: by seed length (an item shorter than a tile is one seed): hashes sorted, item, place
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        length = np.minimum(self.sizes, tile)
        for k in np.unique(length[length > 0]).tolist():
            runs = run_hashes(self.hashes, k)
            item = np.repeat(np.arange(len(ids)), np.where(length == k, self.sizes - k + 1, 0))
            first = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=len(ids)))])
            place = np.arange(len(item)) - first[item]
            seed = runs[self.start[item] + place]
            order = np.argsort(seed, kind="stable")
            self.seeds[k] = (seed[order], item[order], place[order])


def tile_matches(pattern: np.ndarray, text: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (place in pattern, place in text, length).

    Always the longest match of unmarked tokens is marked, ties by place in the pattern
    and then in the text. The search length starts at the pattern's and is halved down to
    ``tile``: windows of unmarked tokens with equal hashes are verified and extended, and
    taken longest first. What a tile leaves of a match goes back to its place in that
    order if it still has the search length; shorter rests are found by later rounds.
    """
    tiles: list[tuple[int, int, int]] = []
    in_pattern, in_text = np.zeros(len(pattern), bool), np.zeros(len(text), bool)
    search = len(pattern)
    while search >= tile:
        heap = [(-n, p, t) for p, t, n in _windows(pattern, text, in_pattern, in_text, search)]
        heapify(heap)
        while heap:
            n, p, t = heappop(heap)
            taken = in_pattern[p : p - n] | in_text[t : t - n]
            if not taken.any():
                in_pattern[p : p - n] = in_text[t : t - n] = True
                tiles.append((p, t, -n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= search:
                    heappush(heap, (a - b, p + a, t + a))
        if search == tile:
            break
        search = max(tile, search // 2)
    return tiles


def _windows(pattern: np.ndarray, text: np.ndarray, in_pattern: np.ndarray, in_text: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches of ``size`` tokens or more."""

    def free(marked: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marked)])
        return total[size:] == total[:-size]

    if len(text) < size or len(pattern) < size:
        return []
    p_hash, t_hash = run_hashes(pattern, size), run_hashes(text, size)
    p_at, t_at = np.flatnonzero(free(in_pattern)), np.flatnonzero(free(in_text))
    t_at = t_at[np.isin(t_hash[t_at], p_hash[p_at])]
    by: dict[int, list[int]] = {}
    for t in t_at.tolist():
        by.setdefault(int(t_hash[t]), []).append(t)
    out = []
    for p in p_at.tolist():
        for t in by.get(int(p_hash[p]), ()):
            if p and t and not in_pattern[p - 1] and not in_text[t - 1] and pattern[p - 1] == text[t - 1]:
                continue  # part of a match that starts earlier
            n = 0
            while p + n < len(pattern) and t + n < len(text) and not in_pattern[p + n] and not in_text[t + n] and pattern[p + n] == text[t + n]:
                n += 1
            if n >= size:
                out.append((p, t, n))
    return out


def _hits(index: Index, k: int, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each run of ``k`` tokens that is a seed, and its range among the sorted seeds."""
    seed = index.seeds[k][0]
    runs = run_hashes(hashes, k)
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = np.searchsorted(seed, runs, "left"), np.searchsorted(seed, runs, "right")
    hit = np.flatnonzero((hi > lo) & (owner[: len(runs)] == owner[k - 1 :]))
    return owner[hit], lo[hit], hi[hit]


def _spread(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _candidates(index: Index, hashes: np.ndarray, start: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """(row, item) whose seeds cover ``threshold`` of the item.

    Rows are handled in runs that meet ``HELD`` seeds of items at most (or one row alone,
    and then its distinct seeds in such runs), so what is held doesn't grow with a seed that many items
    share. First the distinct seeds of each pair are counted: n of them cover no more
    than n times their length. What remains is covered token by token.
    """
    n_rows, n_items = len(start) - 1, len(index.sizes)
    owner = np.repeat(np.arange(n_rows), np.diff(start))
    for k, (seed, item, place) in index.seeds.items():
        row, lo, hi = _hits(index, k, hashes, owner)
        if not len(row):
            continue
        # a row's repeated seeds count once
        order = np.lexsort((lo, row))
        row, lo, hi = row[order], lo[order], hi[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] != lo[:-1])])
        row, lo, many = row[new], lo[new], (hi - lo)[new]
        total = np.concatenate([[0], np.cumsum(many)])
        ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))  # of the rows
        a = 0
        while a < len(row):
            fits = ends[(ends > a) & (total[ends] - total[a] <= HELD)]
            b = int(fits[-1]) if len(fits) else int(ends[ends > a][0])
            pairs = _counted(index, row[a:b], lo[a:b], many[a:b], item, k, threshold, n_items)
            yield from _covering(index, pairs, row[a:b], lo[a:b], many[a:b], item, place, k, threshold, n_items)
            a = b


def _pieces(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of seeds with ``HELD`` occurrences in items at most, or one seed."""
    total, a = np.concatenate([[0], np.cumsum(many)]), 0
    while a < len(many):
        b = max(a + 1, int(np.searchsorted(total, total[a] + HELD, "right")) - 1)
        yield a, b
        a = b


def _counted(index: Index, row, lo, many, item, k: int, threshold: float, n_items: int) -> np.ndarray:
    """Pairs (row * items + item) with seeds enough, sorted."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a, b in _pieces(many):
        pair = np.repeat(row[a:b], many[a:b]) * n_items + item[_spread(lo[a:b], many[a:b])]
        pair, count = np.unique(pair, return_counts=True)
        merged, at = np.unique(np.concatenate([held[0], pair]), return_inverse=True)
        held = merged, np.bincount(at, np.concatenate([held[1], count])).astype(np.int64)
    return held[0][held[1] * k >= threshold * index.sizes[held[0] % n_items]]


def _covering(index: Index, pairs, row, lo, many, item, place, k: int, threshold: float, n_items: int) -> Iterator[tuple[int, int]]:
    """Those of the pairs whose seeds cover ``threshold`` of the item."""
    for first in range(0, len(pairs), max(1, HELD // 512)):
        some = pairs[first : first + max(1, HELD // 512)]
        size = index.sizes[some % n_items]
        base = np.cumsum(size) - size
        covered = np.zeros(int(size.sum()), bool)
        for a, b in _pieces(many):
            which = _spread(lo[a:b], many[a:b])
            pair = np.repeat(row[a:b], many[a:b]) * n_items + item[which]
            at = np.minimum(np.searchsorted(some, pair), len(some) - 1)
            good = some[at] == pair
            begin = base[at[good]] + place[which[good]]
            for j in range(k):
                covered[begin + j] = True
        share = np.add.reduceat(covered, base) if len(base) else np.zeros(0)
        for p in some[share >= threshold * size].tolist():
            yield p // n_items, p % n_items


def _matches(index: Index, texts: pa.Array, threshold: float, *, first_only: bool = False) -> list[tuple]:
    """Row of ``texts``, item id and measures of each leak."""
    out: list[tuple] = []
    for a, b in words.groups(texts):
        hashes, start = tokens(texts.slice(a, b - a))
        found: set[int] = set()
        for row, item in _candidates(index, hashes, start, threshold):
            if first_only and row in found:
                continue
            pattern = index.hashes[index.start[item] : index.start[item + 1]]
            tiles = tile_matches(pattern, hashes[start[row] : start[row + 1]], min(index.tile, len(pattern)))
            covered = sum(n for _, _, n in tiles)
            if covered >= threshold * len(pattern):
                found.add(row)
                out.append((a + row, index.ids[item], len(pattern), covered, len(tiles), max(n for _, _, n in tiles)))
    return out


def _blocks(benchmark: DataFrame, item: str, item_text: str, tile: int, block_bytes: int) -> Iterator[Index]:
    """Indexes of the benchmark's items, each of about ``block_bytes`` of text."""
    items = benchmark.select(column(item).cast("long").alias("i"), column(item_text).alias("t")).filter("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total * 2 // block_bytes)) if total > block_bytes else 1
    for n in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n)
        rows = sorted(((r["i"], r["t"]) for r in block.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        yield Index([r[0] for r in rows], [r[1] for r in rows], tile)


MATCH = ["item_id", "n_item_tokens", "n_covered", "n_tiles", "longest_tile"]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    tile: int = TILE,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document row and item that leaks into it: key and ``MATCH``, coverage.

    Null and token-less texts and items match nothing; items shorter than a tile need
    all their tokens in a row. A null key or item id stays null. Repeated rows give
    repeated results; an empty table on either side gives none.
    """
    rows = docs.select(column(key).cast("long").alias("key"), column(text).alias("text"))

    def against(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most block_bytes of text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = _matches(shared.value, batch.column(1), threshold)
                if out:
                    at, *rest = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), *[pa.array(c, pa.int64()) for c in rest]], names=["key", *MATCH]
                    )

        return rows.mapInArrow(lean(run), "key long, " + ", ".join(f"{c} long" for c in MATCH))

    found = None
    for index in _blocks(benchmark, item, item_text, tile, block_bytes):
        found = against(index) if found is None else found.unionByName(against(index))
    return found.select(F.col("key").alias(key), *MATCH, (F.col("n_covered") / F.col("n_item_tokens")).alias("coverage"))


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    tile: int = TILE,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, in one pass and without a key; all
    columns, whatever their names, pass through."""
    columns, place = docs.columns, docs.columns.index(text)
    rows = numbered(docs, columns)

    def without(rows: DataFrame, index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most block_bytes of text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[m[0] for m in _matches(shared.value, batch.column(place), threshold, first_only=True)]] = False
                yield batch.filter(pa.array(stays))

        return rows.mapInArrow(lean(run), rows.schema)

    for index in _blocks(benchmark, item, item_text, tile, block_bytes):
        rows = without(rows, index)
    return rows.toDF(*columns)
