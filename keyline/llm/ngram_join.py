"""N-gram Jaccard join with PartEnum signatures; exact.

A document's features are the hashes of its distinct shingles; documents with equal
sets are one class from the start, and only classes are compared. Sets fall into size
bands (powers of two). A pair belongs to the band of its larger set, so a set near the
top of its band takes part in the next one too (its second *side*).

Two sets of sizes a and b with Jaccard similarity 3/4 or more differ in at most
``k = floor((a + b) / 7)`` features. Per band the feature domain is cut into ``3 G``
partitions, dealt into ``G`` groups of three, and in every group the three subsets of
two partitions are enumerated: the features of a set in such a subset are one
signature. A feature in which two sets differ spoils two subsets of its group, a second
one of the same group the third. So ``k`` differences spoil at most ``k + min(k, G)``
of the ``3 G`` subsets (``spoiled``), and G is chosen for the band so that more than
that remain. A subset without features is no signature; a set left with too few others
(*thin*, which the choice of G makes very rare) gets one more that all thin sets of the
band share.

Signatures travel as delta-coded blobs of 64-bit numbers, about five bytes each, sorted
by signature within cells of the signatures' range. Signatures that few sets have
(``CROWD`` at most) yield candidate pairs at once. A signature of more sets - a passage
that many documents share, or a large group of near copies - is *crowded*. A set whose
uncrowded signatures alone outnumber those that a partner can spoil ("safe") meets each
of its partners on an uncrowded one and needs no crowded signature. Only sets that are
not safe look into crowded signatures, and only for each other: all are compared with
one centre, the member with the most crowded signatures. Members that link to it are
one component. Pairs with a member that does not are bounded twice before they are
verified: by the triangle inequality of the Jaccard distance to the centre, and by
parity sketches, where the number of bits that differ never exceeds the number of
features that differ. No pair of linked sets is lost. Only pairs with a member that
does not link to the centre are compared at all, in blocks of bounded size, and never
enumerated.

Candidates that share too few signatures to be partners are dropped (the bound above
again); the rest is verified on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from . import graph, words
from .memory import lean
from .names import column, numbered, unused
from .storage import Scratch, small_batches

SHINGLE = 5
#: A signature of more distinct sets is crowded.
CROWD = 16
#: Sets compared side by side in one task are two blocks of about so many.
BLOCK_SETS = 256
#: A parity sketch has so many bits times the power of two above the centre's size.
SKETCH_BITS = 8
#: A quarter, and room for the rounding of a distance.
SLACK = 0.25 + 1e-7
#: Bits of a signature, and of a set's number among those that travel together.
SIG_BITS, SET_BITS = 50, 14
#: Signatures that a task gathers before it sends them, and those of one cell.
SENT, CELL = 1_500_000, 1_000_000
#: Groups beyond those that the bound asks for, by which crowded signatures can be spared.
SPARE = 0.15
_U = np.uint64


def groups_of(limit: int) -> int:
    """Groups of three partitions for a band whose sets have fewer than ``limit`` features."""
    most = 2 * (limit - 1) // 7
    return max(32, math.ceil(((1 + SPARE) * most + 2 + 0.5 * math.sqrt(limit)) / 2))


#: ``groups_of`` of the bands, by the logarithm of their upper ends.
GROUPS = np.array([groups_of(1 << i) for i in range(48)])


def sides(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the upper end of each size's band, and whether a partner can be in the next."""
    band = np.zeros(len(sizes), np.int64)
    some = sizes > 0
    band[some] = np.floor(np.log2(sizes[some])).astype(np.int64) + 1
    return band, some & (4 * sizes >= 3 * (np.int64(1) << band))


def spoiled(sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Most signatures of a set in a band that a partner need not have."""
    partner = np.minimum((np.int64(1) << band) - 1, 4 * sizes // 3)
    k = (sizes + partner) // 7
    return k + np.minimum(k, GROUPS[band])


def digests(features: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per set; 0 for the empty set."""
    full = np.flatnonzero(np.diff(starts))
    out = []
    for salt in (0x51ED270B, 0x2545F4914F6CDD1D):
        half = np.zeros(len(starts) - 1, _U)
        if len(full):
            total = np.add.reduceat(words.mix(features + _U(salt)), starts[:-1][full])
            half[full] = words.mix(total + np.diff(starts)[full].astype(_U) * _U(0x9E3779B97F4A7C15))
        out.append(half)
    return out[0], out[1]


def signatures(features: np.ndarray, starts: np.ndarray, band: np.ndarray, *, extra: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets in these bands (none where the band is 0); the set of each.

    ``extra``: with the one that thin sets get.
    """
    sizes = np.where(band > 0, np.diff(starts), 0)
    n_groups = np.where(sizes > 0, GROUPS[band], 0)
    owner = np.repeat(np.arange(len(sizes)), np.diff(starts))
    if (sizes != np.diff(starts)).any():
        keep = band[owner] > 0
        features, owner = features[keep], owner[keep]
    if not len(owner):
        return np.zeros(0, _U), owner
    base = np.concatenate([[0], np.cumsum(3 * n_groups)])
    # sorted features: the partitions of the domain are runs
    part = ((features >> _U(32)) * (3 * n_groups[owner]).astype(_U)) >> _U(32)
    slot = base[owner] + part.astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    total = np.zeros(int(base[-1]), _U)
    held = np.zeros(int(base[-1]), bool)
    total[slot[first]] = np.add.reduceat(words.mix(features ^ _U(0xA5A5A5A5A5A5A5A5)), first)
    held[slot[first]] = True
    total, held = total.reshape(-1, 3), held.reshape(-1, 3)
    at = np.repeat(np.arange(len(sizes)), n_groups)
    nth = np.arange(len(at)) - (base[:-1] // 3)[at]
    salt = words.mix(nth.astype(_U) * _U(0xD6E8FEB86659FD93) + band[at].astype(_U) * _U(0xCA5A826395121157))
    found, owners = [], []
    for left, right, mark in ((0, 1, 0x9FB21C651E98DF25), (0, 2, 0x8CB92BA72F3D8DD7), (1, 2, 0xC2B2AE3D27D4EB4F)):
        some = held[:, left] | held[:, right]
        x, y = total[some, left], total[some, right]
        found.append(words.mix(x * _U(0x9E3779B97F4A7C15) + (y ^ (y >> _U(29))) * _U(mark) + salt[some]))
        owners.append(at[some])
    sig, at = np.concatenate(found), np.concatenate(owners)
    if not extra:
        return sig >> _U(64 - SIG_BITS), at
    thin = np.flatnonzero((sizes > 0) & (np.bincount(at, minlength=len(sizes)) <= spoiled(sizes, band)))
    sig = np.concatenate([sig, words.mix(band[thin].astype(_U) * _U(0xFF51AFD7ED558CCD))])
    return sig >> _U(64 - SIG_BITS), np.concatenate([at, thin])


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x.astype(np.int64))


def _sets(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """key, n_shingles, hi, lo: the digest of the set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.groups(batch.column(1)):
                features, starts = words.shingles(batch.column(1).slice(a, b - a), shingle)
                sizes = np.diff(starts)
                half = [pa.array(h.view(np.int64), mask=sizes == 0) for h in digests(features, starts)]
                columns = [batch.column(0).slice(a, b - a), _i64(sizes), *half]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_shingles", "hi", "lo"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), "key long, n_shingles long, hi long, lo long")


CLASS_SCHEMA = "id long, hi long, lo long, size long, parts0 long, parts1 long, text string"


def _classes(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """One row per distinct set: its number, digest, size, signatures per side, and a text.

    Each task names a set once, so copies are combined before the shuffle; its memory
    of digests is bounded by the rows of a split. Numbers ascend within a task.
    """
    from pyspark import TaskContext

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for a, b in words.groups(batch.column(0)):
                texts = batch.column(0).slice(a, b - a)
                hi, lo = digests(*words.shingles(texts, shingle))
                fresh = []
                for i, d in enumerate(zip(hi.tolist(), lo.tolist(), strict=True)):
                    if d != (0, 0) and d not in seen:
                        seen.add(d)
                        fresh.append(i)
                if fresh:
                    columns = [_i64(hi[fresh]), _i64(lo[fresh]), texts.take(pa.array(fresh))]
                    yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "text"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, made = None, TaskContext.get().partitionId() << 33
        for batch in batches:
            hi, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(hi), bool)
            new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            if len(hi):
                new[0] = (hi[0], lo[0]) != last
                last = (hi[-1], lo[-1])
            batch = batch.filter(pa.array(new))
            for a, b in words.groups(batch.column(2)):
                part = batch.slice(a, b - a)
                features, starts = words.shingles(part.column(2), shingle)
                sizes = np.diff(starts)
                band, upper = sides(sizes)
                counts = []
                for at_band in (band, np.where(upper, band + 1, 0)):
                    at = signatures(features, starts, at_band, extra=False)[1]
                    counts.append(np.bincount(at, minlength=len(sizes)))
                columns = [_i64(np.arange(made, made + b - a)), *part.columns[:2], _i64(sizes), *map(_i64, counts), part.column(2)]
                made += b - a
                yield pa.RecordBatch.from_arrays(columns, names=["id", "hi", "lo", "size", "parts0", "parts1", "text"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(lean(once), "hi long, lo long, text string")
    return rows.repartition("hi").sortWithinPartitions("hi", "lo").mapInArrow(lean(number), CLASS_SCHEMA)


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers as the bytes of their differences: all lowest bytes, then the next."""
    step = np.diff(values, prepend=_U(0))
    planes = max(1, -(-int(step.max()).bit_length() // 8))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes() + bytes([planes])


def _unpack(blob: bytes) -> np.ndarray:
    planes = blob[-1]
    n = (len(blob) - 1) // planes
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :planes] = np.frombuffer(blob, np.uint8, n * planes).reshape(planes, n).T
    return np.cumsum(raw.view(_U).ravel(), dtype=_U)


#: Kinds of blobs: signatures of sets, signatures known as crowded, and members of those.
FEW, FLAGS, MEMBERS = 0, 1, 2


def _sent(classes: DataFrame, cells: int, crowd: int, shingle: int) -> DataFrame:
    """(cell, kind, base, blob): signatures shifted by SET_BITS, plus the number of the
    set beyond ``base``, doubled, plus the side.

    What a task sees of a crowded signature it sends to cells of the members, so that no
    cell receives a hot signature's members from everywhere.
    """

    def blobs(value: np.ndarray, base: int) -> Iterator[tuple[int, int, int, bytes]]:
        value = np.sort(value)
        sig = value >> _U(SET_BITS)
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.concatenate([first, [len(sig)]]))
        hot = np.repeat(size > crowd, size)
        flags = sig[first[size > crowd]] << _U(SET_BITS)
        for kind, some in ((FEW, value[~hot]), (FLAGS, flags)):
            cell = ((some >> _U(SET_BITS + SIG_BITS - 32)) * _U(cells)) >> _U(32)
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                yield int(cell[a]), kind, base, _pack(some[a:b])
        if hot.any():
            yield int(words.mix(np.array([base], _U))[0] % _U(cells)), MEMBERS, base, _pack(value[hot])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        base, after, gathered = 0, -1, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if gathered:
                rows = list(zip(*blobs(np.concatenate(held), base), strict=True))
                types = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
                arrays = [pa.array(r, t) for r, t in zip(rows, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["cell", "kind", "base", "blob"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(ids) != 1) + 1  # numbers of one file are consecutive
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                for c, d in words.groups(batch.column(1).slice(a, b - a), most=words.GROUP_BYTES):
                    for e in range(a + c, a + d, 1 << (SET_BITS - 2)):
                        f = min(a + d, e + (1 << (SET_BITS - 2)))
                        if ids[e] != after or gathered >= SENT or ids[f - 1] - base >= 1 << (SET_BITS - 1):
                            yield from flush()
                            held, base, gathered = [], int(ids[e]), 0
                        features, starts = words.shingles(batch.column(1).slice(e, f - e), shingle)
                        band, upper = sides(np.diff(starts))
                        for side, at_band in ((0, band), (1, np.where(upper, band + 1, 0))):
                            sig, at = signatures(features, starts, at_band)
                            number = ((ids[e] - base + at) * 2 + side).astype(_U)
                            held.append((sig << _U(SET_BITS)) | number)
                            gathered += len(sig)
                        after = int(ids[f - 1]) + 1
        yield from flush()

    return classes.select("id", "text").mapInArrow(lean(run), "cell int, kind int, base long, blob binary")


def _meet(sent: DataFrame, crowd: int) -> DataFrame:
    """x, y, n, sig. Sets (numbers doubled, plus the side) that share n uncrowded
    signatures of a cell: x < y and a null sig. A member x of a crowded one: y and n null."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64()), ("sig", pa.int64())])

    def pairs_of(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        low, high = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        n = np.diff(np.concatenate([first, [len(low)]]))
        return pa.RecordBatch.from_arrays([pa.array(low[first]), pa.array(high[first]), pa.array(n), pa.nulls(len(n), pa.int64())], schema=schema)

    def members_of(x: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(x), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x), none, none, _i64(sig)], schema=schema)

    class Cell:
        """The signatures of a cell as they come."""

        def __init__(self):
            self.flags = np.zeros(0, _U)
            self.sigs: list[np.ndarray] = []
            self.sets: list[np.ndarray] = []
            self.held, self.most = 0, 2 * CELL

        def add(self, kind: int, base: int, blob: bytes) -> Iterator[pa.RecordBatch]:
            value = _unpack(blob)
            sig = value >> _U(SET_BITS)
            member = (value & _U((1 << SET_BITS) - 1)).astype(np.int64) + 2 * base
            if kind == FLAGS:
                self.flags = np.union1d(self.flags, sig)
            elif kind == MEMBERS:
                yield members_of(member, sig)
            else:
                self.sigs.append(sig)
                self.sets.append(member)
                self.held += len(sig)
                if self.held > self.most:  # members of crowded signatures can go at once
                    sig, member, size = yield from self.sorted()
                    self.sigs, self.sets, self.held = [sig], [member], len(sig)
                    self.most = max(2 * CELL, 2 * self.held)

        def sorted(self):
            sig, member = np.concatenate(self.sigs), np.concatenate(self.sets)
            order = np.argsort(sig, kind="stable")
            sig, member = sig[order], member[order]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.concatenate([first, [len(sig)]]))
            many = size > crowd
            if len(self.flags):
                many |= np.isin(sig[first], self.flags)
            self.flags = np.union1d(self.flags, sig[first[many]])
            out, each = np.repeat(many, size), np.repeat(size, size)
            if out.any():
                yield members_of(member[out], sig[out])
            return sig[~out], member[~out], each[~out]

        def close(self) -> Iterator[pa.RecordBatch]:
            if not self.sigs:
                return
            sig, member, size = yield from self.sorted()
            sig, member = sig[size > 1], member[size > 1]
            found = []
            for d in range(1, crowd):
                same = np.flatnonzero(sig[d:] == sig[:-d]) if len(sig) > d else np.zeros(0, np.int64)
                if not len(same):
                    break
                x, y = member[same], member[same + d]
                # two sets from below the band meet in their own
                keep = ((x & y & 1) == 0) & (x >> 1 != y >> 1)
                found.append((x[keep], y[keep]))
            if found and sum(len(f[0]) for f in found):
                yield pairs_of(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at = Cell(), -1
        for batch in batches:
            cells, kinds, bases = (batch.column(i).to_numpy() for i in range(3))
            for i in range(batch.num_rows):
                if cells[i] != at:
                    yield from cell.close()
                    cell, at = Cell(), cells[i]
                yield from cell.add(int(kinds[i]), int(bases[i]), batch.column(3)[i].as_buffer().to_pybytes())
        yield from cell.close()

    return sent.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(run), "x long, y long, n long, sig long")


def _features(classes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(rep, features): the sets of the classes that ``wanted(id)`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.groups(batch.column(1)):
                features, starts = words.shingles(batch.column(1).slice(a, b - a), shingle)
                packed = [features[i:j].tobytes() for i, j in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(packed, pa.binary())], names=["rep", "features"]
                )

    return classes.select("id", "text").join(wanted, "id", "left_semi").mapInArrow(lean(run), "rep long, features binary")


def _parity(features: np.ndarray, bits: int) -> bytes:
    """Bit ``h mod bits`` is the parity of the features with that remainder."""
    bits = max(bits, 64)
    odd = np.bincount((features & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _shared(pairs: DataFrame, features: DataFrame, *, sketch: bool = False) -> DataFrame:
    """pairs(x, y) with the sizes of intersection and union: x, y, both, either.

    With ``sketch`` also the size of y's set and its parity sketch, as long as fits x.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            both, either, size = (np.zeros(n, np.int64) for _ in range(3))
            bits = []
            for i in range(n):
                p = np.frombuffer(batch.column(2)[i].as_buffer(), _U)
                q = np.frombuffer(batch.column(3)[i].as_buffer(), _U)
                size[i] = len(q)
                if sketch:
                    bits.append(_parity(q, SKETCH_BITS << int(len(p)).bit_length()))
                if len(p) > len(q):
                    p, q = q, p
                if len(p):
                    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    both[i] = np.count_nonzero(q[at] == p)
                either[i] = len(p) + len(q) - both[i]
            columns = [batch.column(0), batch.column(1), pa.array(both), pa.array(either)]
            if sketch:
                columns += [pa.array(size), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "both", "either", "size", "bits"][: len(columns)])

    left = features.select(F.col("rep").alias("x"), F.col("features").alias("p"))
    right = features.select(F.col("rep").alias("y"), F.col("features").alias("q"))
    joined = pairs.join(left, "x").join(right, "y").select("x", "y", "p", "q")
    schema = "x long, y long, both long, either long" + (", size long, bits binary" if sketch else "")
    return joined.mapInArrow(lean(run), schema)


def _near_in_block(table: pa.Table) -> pa.Table:
    """Pairs of a block pair's members that their bounds leave open: x, y.

    ``near``: one block is of sets that link to the centre, the other of sets that don't;
    else both are of the latter.
    """
    table = table.combine_chunks()
    near, i, j = table["near"][0].as_py(), table["i"][0].as_py(), table["j"][0].as_py()
    block, y, d, size = (table[c].to_numpy() for c in ("block", "y", "d", "size"))
    bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(len(y), -1).view(_U)
    order = np.argsort(d, kind="stable")
    block, y, d, size, bits = block[order], y[order], d[order], size[order], bits[order]
    first_far = int(np.searchsorted(d, 0.25, "right"))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(first_far if near else len(y)):
        # those after a in distance, no more than 1/4 away, and not linked to the centre
        lo = max(a + 1, first_far)
        hi = int(np.searchsorted(d, d[a] + SLACK, "right"))
        if lo >= hi:
            continue
        b = np.arange(lo, hi)
        if not near and i != j:
            b = b[block[b] != block[a]]
        b = b[4 * np.minimum(size[a], size[b]) >= 3 * np.maximum(size[a], size[b])]
        if not len(b):
            continue
        differ = np.bitwise_count(bits[b] ^ bits[a]).sum(axis=1, dtype=np.int64)
        b = b[7 * differ <= size[a] + size[b]]
        found.append((np.full(len(b), y[a]), y[b]))
    x = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    z = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return pa.table({"x": np.minimum(x, z), "y": np.maximum(x, z)})


def _crowded_links(crowded: DataFrame, features: DataFrame, scratch: Scratch) -> DataFrame:
    """Links among members(sig, rep, weight) of crowded signatures, enough for their components."""
    spark = features.sparkSession
    stars = crowded.groupBy("sig").agg(
        F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("centre"), F.count(F.lit(1)).alias("members")
    )
    stars = scratch.save(stars.filter("members > 1").select("sig", "centre"), "stars")
    pairs = crowded.join(stars, "sig").filter("rep <> centre").select(F.col("centre").alias("x"), F.col("rep").alias("y"))
    with small_batches(spark):
        seen = scratch.save(_shared(pairs.distinct(), features, sketch=True), "measured")
    links = seen.filter("100 * both >= 75 * either").select("x", "y")
    # distance d = 1 - both / either; two members may link only if theirs are 1/4 apart at most
    measured = seen.select(F.col("x").alias("c"), "y", (1 - F.col("both") / F.col("either")).alias("d"), "size", "bits")
    # a pair with a member that does not link to the centre is open; the others are linked by it
    far = F.col("d") > 0.25
    groups = measured.groupBy("c").agg(
        F.min(F.when(far, F.col("d"))).alias("nearest"), F.count_if(far).alias("n_far"), F.count_if(~far).alias("n_near")
    )
    groups = scratch.save(groups.filter("nearest is not null"), "groups").withColumnRenamed("c", "_c")
    left = measured.join(groups, F.col("c") == F.col("_c")).filter(F.col("d") >= F.col("nearest") - SLACK)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_SETS).cast("int")
    left = left.withColumn("block", F.pmod(F.xxhash64("y"), F.when(far, blocks("n_far")).otherwise(blocks("n_near"))).cast("int"))
    to = lambda near, i, j: F.struct(F.lit(near).alias("near"), i.alias("i"), j.alias("j"))
    of = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), blocks(n) - 1)).otherwise(F.array().cast("array<int>"))
    own = F.col("block")
    from_far = F.concat(
        F.transform(of("n_near"), lambda o: to(True, o, own)), F.transform(of("n_far"), lambda o: to(False, F.least(own, o), F.greatest(own, o)))
    )
    sent = left.select("c", "y", "d", "size", "bits", "block", F.explode(F.when(far, from_far).otherwise(F.transform(of("n_far"), lambda o: to(True, own, o)))).alias("to"))
    sent = sent.select("c", "y", "d", "size", "bits", "block", "to.near", "to.i", "to.j")
    near = sent.groupBy("c", "near", "i", "j").applyInArrow(_near_in_block, "x long, y long").distinct()
    with small_batches(spark):
        more = scratch.save(_shared(near, features).filter("100 * both >= 75 * either").select("x", "y"), "more-links")
    return links.unionByName(more)


def _by_band(values: np.ndarray, band: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), (band + 1).cast("int"))


def _may_spoil(differ: Column, band: Column) -> Column:
    """Signatures of the band that so many differences can spoil."""
    return differ + F.least(differ, _by_band(GROUPS, band))


def class_links(classes: DataFrame, scratch: Scratch, *, signatures_sent: int, crowd: int, shingle: int) -> DataFrame:
    """Links (x, y) between the classes of :func:`_classes`: all pairs, but in crowded
    groups only enough for their components."""
    cells = max(1, -(-signatures_sent // CELL))
    met = scratch.save(_meet(_sent(classes, cells, crowd, shingle), crowd), "met")
    scratch.free()

    log_band = F.floor(F.log2(F.col("size"))).cast("int") + 1
    sided = classes.select("id", "size", "parts0", "parts1", log_band.alias("band"))
    sided = sided.select(
        "id", "size", F.explode(F.array(
            F.struct((2 * F.col("id")).alias("node"), F.col("band").alias("band"), F.col("parts0").alias("parts")),
            F.struct((2 * F.col("id") + 1).alias("node"), (F.col("band") + 1).alias("band"), F.col("parts1").alias("parts")),
        )).alias("s"),
    ).select("id", "size", "s.node", "s.band", "s.parts").filter("parts > 0")
    crowds = met.filter("sig is not null").groupBy(F.col("x").alias("node")).agg(F.count(F.lit(1)).alias("crowded"))
    spare = sided.join(crowds, "node", "left").select(
        "node", "id", "size", "band", F.coalesce("crowded", F.lit(0)).alias("crowded"),
        (F.col("parts") - F.coalesce("crowded", F.lit(0))).alias("free"),
    )
    spare = scratch.save(spare, "spare")  # free: uncrowded signatures

    shared = met.filter("sig is null").groupBy("x", "y").agg(F.sum("n").alias("shared"))
    one = spare.select(*[F.col(c).alias(f"{c}_x") for c in ("node", "id", "size", "band", "free")])
    two = spare.select(*[F.col(c).alias(f"{c}_y") for c in ("node", "id", "size", "free")])
    pairs = shared.join(one, F.col("x") == F.col("node_x")).join(two, F.col("y") == F.col("node_y"))
    differ = F.floor((F.col("size_x") + F.col("size_y")) / 7)
    pairs = pairs.filter(
        (F.col("shared") >= F.greatest("free_x", "free_y") - _may_spoil(differ, F.col("band_x")))
        & (4 * F.least("size_x", "size_y") >= 3 * F.greatest("size_x", "size_y"))
    )
    pairs = pairs.select(F.least("id_x", "id_y").alias("x"), F.greatest("id_x", "id_y").alias("y")).distinct()
    pairs = scratch.save(pairs, "pairs")

    partner = F.least(F.expr("shiftleft(1L, band)") - 1, F.floor(4 * F.col("size") / 3))
    unsafe = spare.filter(F.col("free") <= _may_spoil(F.floor((F.col("size") + partner) / 7), F.col("band")))
    crowded = met.filter("sig is not null").select(F.col("x").alias("node"), "sig").join(unsafe, "node")
    crowded = crowded.select("sig", F.col("id").alias("rep"), F.col("crowded").alias("weight"))
    crowded = scratch.save(crowded, "crowded")
    wanted = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id")))
    wanted = scratch.save(wanted.unionByName(crowded.select(F.col("rep").alias("id"))).distinct(), "wanted")
    scratch.drop("met")
    features = scratch.save(_features(classes, wanted, shingle), "features")
    scratch.free()

    with small_batches(classes.sparkSession):
        links = scratch.save(_shared(pairs, features).filter("100 * both >= 75 * either").select("x", "y"), "links")
    return links.unionByName(_crowded_links(crowded, features, scratch))


class Components:
    """The sets of ``docs``, their classes and their components, in the shared folder.

    ``sets``: per row key, n_shingles and the set's digest (hi, lo; null if it is empty).
    ``named``: per class hi, lo, class_id and component_id.
    """

    def __init__(self, docs: DataFrame, *, key: str, text: str, shingle: int, crowd: int, scratch: Scratch):
        self.docs, self.key, self.text, self.shingle = docs, key, text, shingle
        self.sets = sets = scratch.save(_sets(docs, key, text, shingle), "sets")
        classes = scratch.save(_classes(docs, text, shingle), "classes")
        scratch.free()
        total = classes.agg(F.sum(F.col("parts0") + F.col("parts1"))).first()[0] or 0
        links = class_links(classes, scratch, signatures_sent=total, crowd=crowd, shingle=shingle)
        parts = graph.components(links.select(F.col("x").alias("u"), F.col("y").alias("v")), scratch)
        parts = scratch.save(parts, "parts")
        scratch.drop("features", "pairs", "crowded", "spare", "wanted")
        scratch.free()
        least = sets.filter("hi is not null").groupBy("hi", "lo").agg(F.min("key").alias("class_id"))
        named = scratch.save(classes.select("id", "hi", "lo").join(least, ["hi", "lo"]), "classed")
        scratch.drop("classes")
        linked = parts.join(named, F.col("node") == F.col("id"))
        # the class that stands for a component: of least key, if it has one, then of least digest
        first = F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "hi", "lo")).alias("first")
        labels = linked.groupBy("component").agg(F.min("class_id").alias("part"), first)
        labels = parts.join(labels, "component").select("node", "part", F.col("first.hi").alias("f_hi"), F.col("first.lo").alias("f_lo"))
        labels = scratch.save(labels, "labels")
        named = named.join(labels, F.col("id") == F.col("node"), "left").select(
            "hi", "lo", "class_id",
            F.when(F.col("node").isNull(), F.col("class_id")).otherwise(F.col("part")).alias("component_id"),
            (F.col("node").isNull() | ((F.col("hi") == F.col("f_hi")) & (F.col("lo") == F.col("f_lo")))).alias("stands"),
        )
        self.named = scratch.save(named, "components")

    def per_row(self) -> DataFrame:
        named = self.named.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "class_id", "component_id")
        rows = self.sets.join(named, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")), "left")
        own = lambda c: F.when(F.col("hi").isNull(), F.col("key")).otherwise(F.col(c))
        return rows.select(
            F.col("key").alias(self.key), "n_shingles", own("component_id").alias("component_id"), own("class_id").alias("class_id")
        )

    def one_each(self) -> DataFrame:
        """The rows of ``docs`` that stand for their components; those with empty sets all stay."""
        key, text = self.key, self.text
        columns = self.docs.columns
        hi, lo, place = unused(columns, "hi", "lo", "place")
        rows = _with_digest(self.docs, text, self.shingle, hi, lo)
        stay = self.named.filter("stands").select(F.col("hi").alias("_h"), F.col("lo").alias("_l"), F.col("class_id").alias("_k"))
        same = (F.col(hi) == F.col("_h")) & (F.col(lo) == F.col("_l")) & column(key).cast("long").eqNullSafe(F.col("_k"))
        near = rows.filter(F.col(hi).isNotNull()).join(stay, same)
        # of rows that repeat both key and set, the first by their other columns
        orderable = [f.name for f in self.docs.schema.fields if isinstance(f.dataType, AtomicType)]
        first = Window.partitionBy("_h", "_l", "_k").orderBy(*map(column, orderable))
        near = near.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1)
        keep = [column(c) for c in columns]
        return near.select(*keep).unionByName(rows.filter(F.col(hi).isNull()).select(*keep))


def _with_digest(docs: DataFrame, text: str, shingle: int, hi: str, lo: str) -> DataFrame:
    """``docs`` with the digest of each row's set, null if it is empty."""
    rows, place = numbered(docs, docs.columns), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.groups(batch.column(place)):
                part = batch.slice(a, b - a)
                features, starts = words.shingles(part.column(place), shingle)
                half = [pa.array(h.view(np.int64), mask=np.diff(starts) == 0) for h in digests(features, starts)]
                yield pa.RecordBatch.from_arrays([*part.columns, *half], names=[*names, "hi", "lo"])

    names = rows.columns
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields)
    return rows.mapInArrow(lean(run), f"{schema}hi long, lo long").toDF(*docs.columns, hi, lo)


def jaccard_components(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    crowd: int = CROWD,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Per row: key, n_shingles, component_id, class_id.

    Two rows link if the Jaccard similarity of their shingle sets is 3/4 or more.
    component_id: the least key of the rows reachable by links, itself included.
    class_id: the least key with an equal set. A text that is null or has no word has an
    empty set, links with nothing and is its own component and class. Rows are told
    apart by their sets, so rows that repeat a key each get their own result, whatever
    their texts; a null key counts only where no linked (or equal) row has another.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram")
    return Components(docs, key=key, text=text, shingle=shingle, crowd=crowd, scratch=scratch).per_row()


def drop_linked(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    crowd: int = CROWD,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``docs`` with one row of each component of linked rows: of the class with the least
    key (any key before none, then by digest), and of its rows with that key the first by
    all their columns. Rows with empty sets stay. Different texts that repeat a key, or
    have none, are told apart.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram")
    return Components(docs, key=key, text=text, shingle=shingle, crowd=crowd, scratch=scratch).one_each()
