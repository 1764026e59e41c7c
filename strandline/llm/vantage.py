"""Exact links within a Hamming radius by vantage-point trees over groups of bits.

Fingerprints have `words` words of 64 bits. The bits are parted into groups; within a group the number of differing bits
is a pseudo-metric, and two fingerprints are candidates if in some group they differ in at most `inner` bits. For each
group a tree of vantage points deals the fingerprints out: those nearer than a node's threshold go to its inner shard,
those farther to the outer, and those on the boundary, whose neighbours within `inner` may lie on either side, to both.
So all pairs that a group can vouch for meet in a shard, where the same splitting goes on in memory and the full
distance decides: `radius` or less. Where radius // groups <= inner, no pair within the radius is lost (of `groups`
shares of radius bits one has radius // groups at most). A leaf that its group cannot split any more, as too many
fingerprints agree in it, is then split by the other groups, among which the same holds for what is left of the radius.
Elsewhere the other groups would lose pairs, and such a leaf is split by all bits, with the radius as the margin; which
pairs are found depends on the two fingerprints alone, not on how many others there are.

A shard tells for each fingerprint the first of its cluster only, never all pairs; in a dense leaf those near a few
pivots are linked first, and only pairs that are not yet linked are compared. The upper tree is made on the driver from a
bounded sample (SAMPLE); all fingerprints pass through it.

Nodes are (id, fp) without nulls, one row an id; equal fingerprints are at distance zero and linked; an empty table
gives no links; columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import settled

SHARD = 1 << 17
SAMPLE = 20000
BRUTE = 256
#: A leaf that its group cannot split is split by the other groups, or by all bits, from this size on; that loses no pair.
WIDE = 4096
PIVOTS = 8
#: A split must leave less than this share of the pairs, so that splitting on never costs more than comparing all.
FEWER = 0.95


@dataclass(frozen=True)
class Space:
    """Fingerprints of `words` words, linked within `radius` bits; groups of bits as (word, mask)."""

    words: int
    radius: int
    groups: tuple[tuple[int, int], ...]
    inner: int

    @property
    def exact(self) -> bool:
        """Whether the groups together vouch for all pairs within the radius."""
        return self.radius // len(self.groups) <= self.inner

    def apart(self, fps: np.ndarray, group: int | None, vantage: np.ndarray) -> np.ndarray:
        """Differing bits within a group, or (None) within all words."""
        if group is None:
            return np.bitwise_count(fps ^ vantage).sum(1, dtype=np.int64)
        word, mask = self.groups[group]
        return np.bitwise_count((fps[:, word] ^ vantage[word]) & np.uint64(mask)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of a, row of b, distance) of all that are within the radius; half of the words leave few pairs for the rest."""
        half = (self.words + 1) // 2
        total = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
        for w in range(1, half):
            total += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
        i, j = np.nonzero(total <= self.radius)
        d = total[i, j].astype(np.int64)
        if half < self.words:
            d += np.bitwise_count(a[i, half:] ^ b[j, half:]).sum(1, dtype=np.int64)
            i, j, d = (x[d <= self.radius] for x in (i, j, d))
        return i, j, d


def groups_of(words: int, count: int) -> tuple[tuple[int, int], ...]:
    """`count` groups of neighbouring bits a word that cover all 64."""
    edges = [64 * i // count for i in range(count + 1)]
    return tuple((w, ((1 << b) - 1) ^ ((1 << a) - 1)) for w in range(words) for a, b in zip(edges, edges[1:]))


def split(space: Space, fps: np.ndarray, group: int | None, inner: int, vantage: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The threshold whose sides have the fewest pairs together, and all distances; None if these are hardly fewer than before."""
    d = space.apart(fps, group, vantage)
    below = np.cumsum(np.bincount(d, minlength=max(64 * space.words, inner) + 1)).astype(float)
    near, far = below, below[-1] - np.concatenate([np.zeros(inner), below[: len(below) - inner]])
    pairs = near**2 + far**2
    t = int(np.argmin(pairs))
    return (t, d) if pairs[t] < FEWER * below[-1] ** 2 else None


def tried(space: Space, fps: np.ndarray, group: int | None, inner: int, rng: np.random.Generator) -> tuple[np.ndarray, int, np.ndarray] | None:
    """(vantage, threshold, distances) of a split that gains, or None."""
    for at in rng.integers(len(fps), size=8).tolist():
        if found := split(space, fps, group, inner, fps[at]):
            return fps[at], *found
    return None


def upper_tree(space: Space, sample: np.ndarray, group: int, share: float, rng: np.random.Generator) -> list[tuple[np.ndarray, int, int, int]]:
    """Nodes (vantage, threshold, inner, outer), children below zero being shards -1, -2, ...; shards of about `share` of the sample."""
    nodes: list[tuple[np.ndarray, int, int, int]] = []
    shards = 0

    def grow(fps: np.ndarray) -> int:
        nonlocal shards
        found = tried(space, fps, group, space.inner, rng) if len(fps) > max(2, share * len(sample)) else None
        if not found:
            shards += 1
            return -shards
        vantage, t, d = found
        me = len(nodes)
        nodes.append((vantage, t, 0, 0))
        nodes[me] = (vantage, t, grow(fps[d <= t]), grow(fps[d > t - space.inner]))
        return me

    root = grow(sample)
    return nodes if root == 0 else []


def deal(space: Space, fps: np.ndarray, nodes: list[tuple[np.ndarray, int, int, int]], group: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions) of all shards that each fingerprint must be in."""
    todo = [(0 if nodes else -1, np.arange(len(fps)))]
    while todo:
        node, at = todo.pop()
        if node < 0:
            yield -node, at
        elif len(at):
            vantage, t, inner, outer = nodes[node]
            d = space.apart(fps[at], group, vantage)
            todo += [(inner, at[d <= t]), (outer, at[d > t - space.inner])]


def leaf_links(space: Space, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the clusters of a leaf: all pairs are compared, but those linked by pivots already."""
    n = len(fps)
    if n <= BRUTE:
        return space.pairs(fps, fps)[:2]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    alone = np.arange(n)
    for _ in range(PIVOTS):
        if len(alone) < 2:
            break
        some = fps[alone[:: max(1, len(alone) // 512)]]
        bits = np.unpackbits(np.ascontiguousarray(some).view(np.uint8), axis=1, bitorder="little")
        middle = np.packbits(2 * bits.sum(0) > len(some), bitorder="little").view(np.uint64)
        pivot = int(alone[np.argmin(np.bitwise_count(fps[alone] ^ middle).sum(1, dtype=np.int64))])
        hit = space.pairs(fps[pivot : pivot + 1], fps)[1]
        links.append((np.full(len(hit), pivot), hit))
        alone = np.setdiff1d(alone, hit, assume_unique=True)
    label = settled(n, *(np.concatenate(x) for x in zip(*links)))
    rest = np.flatnonzero(label != np.bincount(label).argmax())  # any pair that is not linked yet has one of these
    step = max(1, (1 << 20) // n)
    for at in range(0, len(rest), step):
        mine = rest[at : at + step]
        a, b, _ = space.pairs(fps[mine], fps)
        apart = label[mine[a]] != label[b]
        links.append((mine[a[apart]], b[apart]))
    return tuple(np.concatenate(x) for x in zip(*links))


def leaves(space: Space, group: int, fps: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Positions of the leaves of one shard, which hold together all pairs that the group vouches for."""
    todo = [(np.arange(len(fps)), group, space.inner, tuple(g for g in range(len(space.groups)) if g != group))]
    while todo:
        part, g, inner, others = todo.pop()
        found = tried(space, fps[part], g, inner, rng) if len(part) > BRUTE else None
        if found:
            _, t, d = found
            todo += [(part[d <= t], g, inner, others), (part[d > t - inner], g, inner, others)]
            continue
        if not space.exact and g is not None and len(part) >= WIDE:
            todo.append((part, None, space.radius, ()))
            continue
        rest = space.radius // len(others) if others else 0
        if space.exact and others and rest <= space.inner and len(part) >= WIDE:
            values = [len(np.unique(fps[part, space.groups[h][0]] & np.uint64(space.groups[h][1]))) for h in others]
            if min(values) >= len(part) // 16:  # the others tell them apart
                todo += [(part, h, rest, tuple(x for x in others if x != h)) for h in others]
                continue
        if len(part) > 1:
            yield part


def cluster(space: Space, group: int, fps: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each fingerprint of one shard the first of its cluster."""
    n = len(fps)
    links, many = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for part in leaves(space, group, fps, rng):
        a, b = leaf_links(space, fps[part])
        links.append((part[a], part[b]))
        many += len(a)
        if many > 4 << 20:
            label = settled(n, *(np.concatenate(x) for x in zip(*links)))
            links, many = [(np.arange(n), label)], 0
    return settled(n, *(np.concatenate(x) for x in zip(*links)))


def nearest_few(a: np.ndarray, b: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each a's distinct b the `most` nearest, ties by position; and the a that have more."""
    by = np.lexsort((b, d, a))
    a, b, d = a[by], b[by], d[by]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    a, b, d = a[fresh], b[fresh], d[fresh]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return a[rank < most], b[rank < most], d[rank < most], a[rank == most]


def strangers(space: Space, group: int, fps: np.ndarray, root: np.ndarray, most: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(a, b, distance) of one shard: for each a the `most` nearest b of another root, and the a that have more.

    Pairs that an earlier group vouches for are left to it; so are, where the groups don't vouch for all pairs, those
    that this group does not vouch for, which meet or not as the other fingerprints have it.
    Of two roots that meet in a leaf the one with fewer fingerprints there asks (ties: the larger root).
    """
    none = np.zeros(0, np.int64)
    a, b, d, more = none, none, none, [none]
    for part in leaves(space, group, fps, rng):
        _, kind, size = np.unique(root[part], return_inverse=True, return_counts=True)
        step = max(1, (1 << 20) // len(part)) if len(size) > 1 else len(part) + 1
        for at in range(0, len(part) if len(size) > 1 else 0, step):
            i, j, near = space.pairs(fps[part[at : at + step]], fps[part])
            i += at
            asks = (kind[i] != kind[j]) & ((size[kind[i]] < size[kind[j]]) | (size[kind[i]] == size[kind[j]]) & (kind[i] > kind[j]))
            i, j, near = part[i[asks]], part[j[asks]], near[asks]
            if not space.exact:
                word, mask = space.groups[group]
                own = np.bitwise_count((fps[i, word] ^ fps[j, word]) & np.uint64(mask)) <= space.inner
                i, j, near = i[own], j[own], near[own]
            for earlier in range(group):  # a pair that an earlier group vouches for meets there as well
                word, mask = space.groups[earlier]
                own = np.bitwise_count((fps[i, word] ^ fps[j, word]) & np.uint64(mask)) > space.inner
                i, j, near = i[own], j[own], near[own]
            a, b, d = (np.concatenate(x) for x in zip((a, b, d), (i, j, near)))
            if len(a) > 1 << 22:
                a, b, d, left = nearest_few(a, b, d, most)
                more.append(left)
    a, b, d, left = nearest_few(a, b, d, most)
    return a, b, d, np.unique(np.concatenate([*more, left]))


def unpacked(column: pa.Array, words: int) -> np.ndarray:
    """Fingerprints of a column of longs (one word) or of binary values of equal size, one row each."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def met(nodes: DataFrame, space: Space, schema: str, work: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """What `work` makes of each shard's (group, ids, fingerprints, other columns, random numbers); nodes: (id, fp, ...), ids in order."""
    spark = nodes.sparkSession
    kinds, names = dict(nodes.dtypes), nodes.columns
    total = nodes.count()
    sample = [r.fp for r in nodes.orderBy(F.xxhash64("id")).limit(SAMPLE).select("fp").collect()]
    some = np.array(sample, np.int64).view(np.uint64).reshape(-1, 1) if kinds["fp"] == "bigint" else np.frombuffer(b"".join(sample), np.uint64).reshape(-1, space.words)
    share = max(SHARD / max(total, 1), 8 / max(len(some), 1))
    rng = np.random.default_rng(3)
    trees = [upper_tree(space, some, g, share, rng) if len(some) else [] for g in range(len(space.groups))]
    shared = spark.sparkContext.broadcast(trees)  # at most a few thousand nodes: the sample is bounded

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = unpacked(batch.column("fp"), space.words)
            for g in range(len(space.groups)):
                for shard, at in deal(space, fps, shared.value[g], g):
                    if len(at):
                        part = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(np.full(len(at), shard, np.int32)), *part.columns], ["grp", "shard", *names])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(4)
        held: list[pa.RecordBatch] = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).sort_by("id").combine_chunks()
                held.clear()
                fps = unpacked(rows.column("fp").combine_chunks(), space.words)
                rest = {c: rows.column(c).to_numpy() for c in names if c not in ("id", "fp")}
                yield pa.RecordBatch.from_pydict(work(group=int(key[0]), ids=rows.column("id").to_numpy(), fps=fps, rng=rng, **rest))

        for batch in batches:
            g, s = (batch.column(c).to_numpy() for c in ("grp", "shard"))
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(s) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)]):
                if hi > lo:
                    if (g[lo], s[lo]) != key:
                        yield from close()
                        key = (g[lo], s[lo])
                    held.append(batch.slice(lo, hi - lo).select(names))
        yield from close()

    routed = nodes.mapInArrow(route, ", ".join(["grp int", "shard int", *(f"{c} {kinds[c]}" for c in names)]))
    return routed.repartition("grp", "shard").sortWithinPartitions("grp", "shard").mapInArrow(meet, schema)


def links(nodes: DataFrame, space: Space) -> DataFrame:
    """Edges (a, b) that span all clusters of nodes (id, fp): of each shard's clusters a star around the least id."""

    def work(group: int, ids: np.ndarray, fps: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        label = cluster(space, group, fps, rng)
        linked = label != np.arange(len(ids))
        return {"a": ids[linked], "b": ids[label[linked]]}

    return met(nodes.select("id", "fp"), space, "a long, b long", work).distinct()


def nearest_strangers(nodes: DataFrame, space: Space, most: int) -> DataFrame:
    """(a, b) for each node (id, fp, root) the `most` nearest of another root in each shard; b is null where there are more."""

    def work(group: int, ids: np.ndarray, fps: np.ndarray, rng: np.random.Generator, root: np.ndarray) -> dict[str, pa.Array]:
        a, b, _, more = strangers(space, group, fps, root, most, rng)
        return {"a": pa.array(np.concatenate([ids[a], ids[more]])), "b": pa.array([*ids[b].tolist(), *[None] * len(more)], pa.int64())}

    return met(nodes.select("id", "fp", "root"), space, "a long, b long", work).distinct()
