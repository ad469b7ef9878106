"""N-gram Jaccard join by PartEnum signatures.

A document's features are the hashes of its distinct word n-grams. Two sets
with a Jaccard similarity of at least ``gamma`` have sizes within a factor
``gamma``, so they fall in one band of sizes or in two neighbouring ones, and in
a band of largest size ``r`` they differ in at most
``k = 2 r (1 - gamma) / (1 + gamma)`` features. PartEnum splits the feature
domain into ``n1`` partitions of ``n2`` parts each. At most ``k`` features
differ, so in one partition at most ``k2`` parts differ, and the sets agree on
one of the enumerated choices of ``n2 - k2`` parts there: similar sets share a
signature. Every set signs for its own band and for the next one. The lower
``gamma``, the fewer features a signature covers, so ``n2`` and ``k2`` grow until
it covers enough of them for chance to bring few sets together; how many are
enough grows with the logarithm of the number of sets.

* Equal sets are one node, whatever the number of documents that have them, and
  sets that share too little with the rest of the corpus to be similar to any
  other need no signatures (:mod:`matchloom.llm.sharing`).
* Signatures only propose. The sets that have one are joined to the smallest of
  them (never to each other): a star of each set that is the smallest of some
  signature. Any two similar sets are in a common star, so each star is verified
  on its own, and nothing is chained before it is verified. Every signature goes
  to its bucket with its set: combined before, within a block of documents, the
  sets of a block would only meet the smallest of that block.
* Members of a star are first compared by sketches, whose distance is never more
  than that of the sets: those that can be similar to no other leave, and the
  rest is parted by what can be connected. So members by chance, whose number
  grows faster than the input, cost 128 bytes each instead of their text.
* Stars of more than ``GROUP_FEATURES`` features sign again, under another hash
  and within the star, which deals them to smaller stars.
* Each link is verified on the sets themselves, in a task for each star. Within
  it sets are compared through their differences from a common base, so a large
  group of near copies costs about its size, not its square.
* A star that is still larger is cut into blocks. Each set is measured against
  the star's centre; those near enough to be similar to the set that is nearest
  to it are linked at once, and only the rest is compared with every block.
* Links are few for each set; their connected components are the result.

Defined results: a null or blank text has no features and links with nothing,
its component is itself. A text of fewer than ``N`` words has its whole word
sequence as one feature. A row with a null id has a null component and links
with nothing. Repeated rows get one row each. Texts of any length are read
whole. Only the key and the text are read; other columns, whatever their names,
do not matter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm import common, graph, sharing
from matchloom.llm.wordsets import feature_sets, fingerprint
from matchloom.session import release, staged

N = 3
#: Parts of a first-level partition and how many of them may differ: the first pair whose signatures cover enough features is taken.
ENUMERATIONS = ((3, 1), (5, 2), (6, 2), (7, 3), (9, 4))
#: Features that a signature covers at least, in the mean.
LEAST_COVERED = 9.0
#: Features that one task holds at most, about, when links are verified.
GROUP_FEATURES = 500_000
#: Bits of a set's sketch, sets of a star that are compared by their sketches at most, and pairs that are compared at once.
SKETCH_BITS, SKETCHED_SETS, SKETCH_CELLS = 1024, 20_000, 1 << 15
#: How often stars that are too large sign again.
ROUNDS = 2
#: Signatures in a bucket, about, and in a block before the shuffle.
BUCKET_SIGNATURES, BLOCK_SIGNATURES = 500_000, 400_000
#: Keys that are sent to every task at most, 16 bytes each.
BROADCAST_KEYS = 1_000_000
#: A group of copies is looked up in so many tasks.
SALTS = 8
U64 = np.uint64


def enumeration(percent: int, n_sets: int) -> tuple[int, int]:
    """n2 and k2 of signatures at this similarity.

    A partition has about (k2 + 1) (1 + gamma) / (2 (1 - gamma)) features. Two
    sets without anything in common share a signature of c features in the mean
    if both have none there, with a probability of exp(-2 c), so c must grow
    with log(n_sets) / 2.
    """
    covered = max(LEAST_COVERED, log(100 * max(n_sets, 1)) / 2)
    for n2, k2 in ENUMERATIONS:
        if (n2 - k2) * (k2 + 1) * (100 + percent) >= covered * n2 * 2 * (100 - percent):
            break
    return n2, k2


class Bands:
    """Bands of set sizes such that similar sets are in one band or in two neighbouring ones."""

    def __init__(self, percent: int, n2: int, k2: int):
        self.percent, self.n2, self.k2 = percent, n2, k2
        self.choices = [list(c) for c in combinations(range(self.n2), self.n2 - self.k2)]
        self.starts = [1]

    def _grow(self) -> None:
        self.starts.append(self.starts[-1] * 100 // self.percent + 1)

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self._grow()
        return bisect_right(self.starts, size) - 1

    def partitions(self, band: int) -> int:
        """n1 of the band: from the most features in which two similar sets differ, the larger of which is in the band."""
        while len(self.starts) <= band + 1:
            self._grow()
        most = self.starts[band + 1] - 1
        k = 2 * most * (100 - self.percent) // (100 + self.percent)
        return -(-(k + 1) // (self.k2 + 1))


def signatures(features: np.ndarray, bands: Bands, seed: int = 0) -> np.ndarray:
    """The PartEnum signatures of one set, for its own band and for the next one; ``seed`` chooses the hash of the feature domain."""
    out = []
    own = bands.of(len(features))
    for band in (own, own + 1):
        n1 = bands.partitions(band)
        h = common.mix64(features + U64(band + 1 + (seed << 32)))
        part = ((h >> U64(33)) % U64(n1 * bands.n2)).astype(np.int64)
        low = np.bincount(part, (h & U64(0xFFFFFFFF)).astype(np.float64), n1 * bands.n2).astype(np.uint64)
        high = np.bincount(part, (h >> U64(32)).astype(np.float64), n1 * bands.n2).astype(np.uint64)
        sums = (low + (high << U64(32))).reshape(n1, bands.n2)
        tag = np.arange(n1, dtype=np.uint64) * U64(len(bands.choices)) + U64(band << 40)
        for c, chosen in enumerate(bands.choices):
            out.append(common.mix64(sums[:, chosen].sum(1, dtype=np.uint64) ^ common.mix64(tag + U64(c))))
    return np.concatenate(out)


def stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a node of a key and the smallest node of that key."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    head = np.ones(len(key), np.bool_)
    head[1:] = key[1:] != key[:-1]
    least = node[head][np.cumsum(head) - 1]
    differs = node != least
    pairs = np.unique(np.stack([node[differs], least[differs]]), axis=1)
    return pairs[0], pairs[1]


def _planes(values: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, all first ones before all second ones; those that are the same everywhere compress to nothing."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _sliced(bucket: np.ndarray, sigs: np.ndarray, nodes: np.ndarray) -> dict[int, tuple[bytes, bytes]]:
    """The signatures, of which 32 bits tell those of a bucket apart, and the nodes of each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    cuts = np.append(at, len(order))
    sigs, nodes = sigs[order].astype("<u4"), nodes[order]
    return {int(k): (sigs[a:z].tobytes(), _planes(nodes[a:z])) for k, a, z in zip(found, cuts[:-1], cuts[1:], strict=True)}


def candidate_edges(sets: DataFrame, n_sets: int, total: int, percent: int, n: int, seed: int = 0) -> DataFrame:
    """Distinct edges (a, b) between the ids of ``sets`` (id, component, text) that share a signature and a component, to the smallest that has it."""
    n2, k2 = enumeration(percent, n_sets)
    per_feature = 4 * len(list(combinations(range(n2), k2))) * (100 - percent) / ((k2 + 1) * (100 + percent))
    n_buckets = max(64, int(total * per_feature) // BUCKET_SIGNATURES)
    kinds = (pa.int32(), pa.binary(), pa.binary())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, n2, k2)
        sigs, nodes, held = [], [], 0
        for b in batches:
            ids, groups = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for row, features in feature_sets(b.column(2), n):
                s = signatures(features, bands, seed)
                sigs.append(s ^ common.mix64(groups[row : row + 1].astype(np.int64).view(np.uint64)))
                nodes.append(np.full(len(s), ids[row], np.int64))
                held += len(s)
                if held > BLOCK_SIGNATURES:
                    yield packed(np.concatenate(sigs), np.concatenate(nodes))
                    sigs, nodes, held = [], [], 0
        if held:
            yield packed(np.concatenate(sigs), np.concatenate(nodes))
        common.trim()

    def packed(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        rows = [(k, *own) for k, own in _sliced(((sig >> U64(32)) % U64(n_buckets)).astype(np.int64), sig, node).items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "sigs", "nodes"])

    def link(table: pa.Table) -> pa.Table:
        sigs = np.frombuffer(b"".join(table["sigs"].to_pylist()), "<u4")
        a, b = stars(sigs, np.concatenate([_of_planes(d) for d in table["nodes"].to_pylist()]))
        common.trim()
        return pa.table({"a": a, "b": b})

    signed = sets.select("id", "component", "text").mapInArrow(sign, "bucket int, sigs binary, nodes binary")
    return signed.groupBy("bucket").applyInArrow(link, "a long, b long").distinct()


def similar(overlap: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets whose sizes add to ``total`` are similar: 100 * intersection >= percent * union."""
    return 100 * overlap >= percent * (total - overlap)


class Forest:
    """Disjoint sets of the numbers below n."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)


def link_sets(sets: list[np.ndarray], percent: int) -> Forest:
    """The components of similar sets; every pair of similar sets is joined or already connected.

    An index from features to sets gives each pivot its overlap with every other
    set. The sets within Jaccard distance 1/2 of it are its core, and leave with
    it. Similar sets have distances from the pivot that differ by 1 - gamma at
    most, so those similar to a set of the core are within the core's farthest
    distance and 1 - gamma. These are compared through their differences from
    the base, the features that most of them have: without a shared difference
    two sets differ in as many features as their differences together, so the
    set with the least excess over its allowance decides for all; the others
    look up who shares a difference with them.
    """
    forest, n = Forest(len(sets)), len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n < 2 or not sizes.any():
        return forest
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    features, which = np.unique(np.concatenate(sets), return_inverse=True)
    by_feature = np.argsort(which, kind="stable")
    holders = np.repeat(np.arange(n), sizes)[by_feature]
    starts = np.searchsorted(which[by_feature], np.arange(len(features) + 1))
    alive = sizes > 0
    for pivot in range(n):
        if not alive[pivot]:
            continue
        own = which[bounds[pivot] : bounds[pivot + 1]]
        held = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.cumsum(held) + held, held) + np.arange(int(held.sum()))
        both = np.bincount(holders[at], minlength=n)
        union = sizes + sizes[pivot] - both
        core = alive & (2 * both >= union)
        apart = (union - both) / np.maximum(union, 1)
        near = alive & (apart <= apart[core].max() + (100 - percent) / 100 + 1e-9)
        if near.sum() > 1:
            ids = np.flatnonzero(near)
            _link_near([sets[i] for i in ids], ids, forest, percent)
        alive &= ~core
    return forest


def _link_near(sets: list[np.ndarray], ids: np.ndarray, forest: Forest, percent: int) -> None:
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    features, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    in_base = 2 * count > len(sets)
    n_base = int(in_base.sum())
    has = np.bincount(owner[in_base[which]], minlength=len(sets))
    differences = (sizes - has) + (n_base - has)
    # two sets are similar if they differ in at most (100 - percent) / (100 + percent) of their added sizes
    excess = (100 + percent) * differences - (100 - percent) * sizes
    best = int(excess.argmin())
    joined = excess + excess[best] <= 0
    joined[best] = True
    for x in np.flatnonzero(joined):
        forest.join(int(ids[x]), int(ids[best]))
    rest = np.flatnonzero(~joined)
    if not len(rest):
        return
    # a difference is a feature outside the base that a set has, or one of the base that it lacks
    extra = ~in_base[which]
    lacks = np.ones((0, 2), np.int64)
    base_ids = np.flatnonzero(in_base)
    if n_base:
        place = np.full(len(features), -1, np.int64)
        place[base_ids] = np.arange(n_base)
        short = np.flatnonzero(has < n_base)
        chunks = []
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        for x in short:
            held = np.zeros(n_base, np.bool_)
            p = place[which[bounds[x] : bounds[x + 1]]]
            held[p[p >= 0]] = True
            gone = base_ids[~held]
            chunks.append(np.stack([gone, np.full(len(gone), x)], 1))
        lacks = np.concatenate(chunks) if chunks else lacks
    feature = np.concatenate([which[extra], lacks[:, 0]])
    owner = np.concatenate([owner[extra], lacks[:, 1]])
    by_feature = np.argsort(feature, kind="stable")
    feature_sorted, owner_sorted = feature[by_feature], owner[by_feature]
    by_owner = np.argsort(owner, kind="stable")
    own_bounds = np.searchsorted(owner[by_owner], np.arange(len(sets) + 1))
    starts = np.searchsorted(feature_sorted, np.arange(len(features) + 1))
    for x in rest:
        mine = feature[by_owner[own_bounds[x] : own_bounds[x + 1]]]
        shared = np.zeros(len(sets), np.int64)
        for f in mine:
            shared[owner_sorted[starts[f] : starts[f + 1]]] += 1
        apart = differences[x] + differences - 2 * shared
        total = sizes[x] + sizes
        hits = similar((total - apart) // 2, total, percent)
        hits[x] = False
        for y in np.flatnonzero(hits):
            forest.join(int(ids[x]), int(ids[y]))


def _stars(edges: DataFrame) -> DataFrame:
    """(component, id): the members of each star, whose smallest is the component."""
    return edges.select(F.col("b").alias("component"), F.col("a").alias("id")).union(edges.select("b", "b").distinct())


def sketch(features: np.ndarray) -> bytes:
    """The parity of the features in each of ``SKETCH_BITS`` places; two sketches differ in no more bits than their sets in features."""
    place = (common.mix64(features ^ U64(0x3C6EF372FE94F82B)) % U64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=SKETCH_BITS) & 1).astype(np.bool_)).tobytes()


def close_groups(sizes: np.ndarray, sketches: np.ndarray, percent: int) -> np.ndarray:
    """For each set of a star the first set to which chains of sets lead that may be similar by their sizes and sketches; similar sets always may."""
    n = len(sizes)
    first, todo = np.full(n, -1, np.int64), np.arange(n)
    while len(todo):
        pivot, found, todo = todo[0], todo[:1], todo[1:]
        first[pivot] = pivot
        while len(found) and len(todo):
            some, found = found[: max(1, SKETCH_CELLS // len(todo))], found[max(1, SKETCH_CELLS // len(todo)) :]
            apart = np.bitwise_count(sketches[some][:, None] ^ sketches[todo]).sum(2, dtype=np.int64)
            a, b = sizes[some][:, None], sizes[todo]
            may = ((100 + percent) * apart <= (100 - percent) * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
            hit = may.any(0)
            first[todo[hit]] = pivot
            found, todo = np.concatenate([found, todo[hit]]), todo[~hit]
    return first


def narrowed(groups: DataFrame, kept: DataFrame, percent: int, n: int, most: int = SKETCHED_SETS) -> DataFrame:
    """``groups`` (component, id) without the sets that can be similar to no other of their star, the rest by what can be connected.

    Only sketches travel, so chance members cost no text. Stars of more than ``most`` sets stay as they are.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sketch(f) for _, f in feature_sets(b.column(2), n)], pa.binary())], names=["id", "size", "sketch"])
        common.trim()

    def narrow(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("id", "ascending")])
        group, ids, sizes = (table[c].to_numpy() for c in ("component", "id", "size"))
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
        first = np.empty(len(ids), np.int64)
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1), len(ids)]
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            first[a:z] = a + close_groups(sizes[a:z], sketches[a:z], percent)
        keep = np.bincount(first, minlength=len(ids))[first] > 1
        common.trim()
        return pa.table({"component": ids[first[keep]], "id": ids[keep]})

    sketches = staged(kept.select("id", "size", "text").mapInArrow(drawn, "id long, size long, sketch binary"), "jaccard-sketches")
    members = groups.groupBy("component").agg(F.count("*").alias("members"))
    found = groups.join(members, "component")
    n_tasks = max(64, groups.count() // SKETCHED_SETS)
    whole = found.where(F.col("members") <= most).select("component", "id").hint("merge").join(sketches, "id")
    close = whole.withColumn("task", F.pmod(F.xxhash64("component"), F.lit(n_tasks))).groupBy("task").applyInArrow(narrow, "component long, id long")
    return close.union(found.where(F.col("members") > most).select("component", "id")).distinct()


def candidate_groups(kept: DataFrame, percent: int, n: int) -> DataFrame:
    """(component, id): stars, or parts of them, of the sets of ``kept`` (id, size, text); two similar sets are in a star together. A set may be in several."""
    n_sets, total = kept.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    edges = candidate_edges(kept.withColumn("component", F.lit(0).cast("long")), n_sets, total, percent, n)
    found = staged(_stars(edges), "jaccard-stars")
    release(kept.sparkSession)
    groups = staged(narrowed(found, kept, percent, n), "jaccard-stars")
    for seed in range(1, ROUNDS + 1):
        sizes = groups.join(kept.select("id", "size"), "id").groupBy("component").agg(F.sum("size").alias("features"))
        large = staged(sizes.where(F.col("features") > GROUP_FEATURES), "jaccard-large")
        features = large.agg(F.sum("features")).first()[0]
        if not features:
            break
        again = groups.join(large, "component").select("id", "component").hint("merge").join(kept, "id")
        edges = candidate_edges(again, n_sets, features, percent, n, seed)
        groups = staged(groups.join(large, "component", "left_anti").select("component", "id").union(_stars(edges)).distinct(), "jaccard-stars")
    return groups


def _linked(table: pa.Table, percent: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest linked id) of the sets in ``table`` (component, id, text) that are linked to one of their component with a smaller id."""
    table = table.sort_by([("component", "ascending"), ("id", "ascending")])
    group, ids = table["component"].to_numpy(), table["id"].to_numpy()
    new = np.ones(len(ids), np.bool_)
    new[1:] = (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])
    table, group, ids = table.take(np.flatnonzero(new)), group[new], ids[new]
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1), len(ids)]
    out, least = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        forest = link_sets([f for _, f in feature_sets(table["text"].slice(a, z - a), n)], percent)
        roots = a + np.array([forest.root(i) for i in range(z - a)], np.int64)
        moved = roots != np.arange(a, z)
        out.append(ids[a:z][moved])
        least.append(ids[roots[moved]])
    return np.concatenate(out), np.concatenate(least)


def links(kept: DataFrame, groups: DataFrame, percent: int, n: int) -> DataFrame:
    """(id, least): verified links of the sets in each star of ``groups`` (component, id), each to a smaller set of its star that links lead to."""
    found = groups.join(kept.select("id", "size"), "id")
    share = F.lit(GROUP_FEATURES / 2)  # two blocks are compared in a task
    cuts = found.groupBy("component").agg(F.when(F.sum("size") > GROUP_FEATURES, F.ceil(F.sum("size") / share)).otherwise(1).cast("int").alias("cuts"), F.min("id").alias("lead"), F.count("*").alias("n"))
    found = staged(found.join(cuts.where("n > 1"), "component"), "jaccard-groups")
    total, most = found.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("cuts"), F.lit(0))).first()
    n_tasks = max(64, total // GROUP_FEATURES)

    def verify(table: pa.Table) -> pa.Table:
        ids, least = _linked(table, percent, n)
        common.trim()
        return pa.table({"id": ids, "least": least})

    # both sides grow with the input, so neither is broadcast even where it would fit
    whole = found.where("cuts = 1").hint("merge").join(kept.select("id", "text"), "id")
    verified = whole.withColumn("task", F.pmod(F.xxhash64("component"), F.lit(n_tasks))).groupBy("task").applyInArrow(verify, "id long, least long")
    if most > 1:
        verified = verified.union(_links_of_blocks(kept, found.where("cuts > 1").select("component", "id", "size", "cuts", "lead"), share, verify, percent, n))
    return verified


def _links_of_blocks(kept: DataFrame, cut: DataFrame, share: Column, verify: Callable[[pa.Table], pa.Table], percent: int, n: int) -> DataFrame:
    """The same for stars that are cut into blocks."""
    texts = kept.select("id", "text")
    block = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    members = cut.withColumn("block", block).hint("merge").join(texts, "id")
    leads = cut.where("id = lead").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).hint("merge").join(texts, "id")

    def measure(table: pa.Table) -> pa.Table:
        """What each set lacks to be similar to every set within its own allowance of the base (negative: to spare)."""
        base = next(f for _, f in feature_sets(table.filter(table["base"])["text"].slice(0, 1), n))
        own = table.filter(pc.invert(table["base"]))
        sizes, apart = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for row, features in feature_sets(own["text"], n):
            both = np.isin(features, base, assume_unique=True).sum()
            sizes[row], apart[row] = len(features), len(features) + len(base) - 2 * both
        return pa.table({"component": own["component"], "id": own["id"], "excess": (100 + percent) * apart - (100 - percent) * sizes})

    columns = ("component", "block", "id", "text")
    dealt = members.select(*columns, F.lit(False).alias("base")).union(leads.select(*columns, F.lit(True).alias("base")))
    excess = staged(dealt.groupBy("component", "block").applyInArrow(measure, "component long, id long, excess long"), "jaccard-excess")
    best = excess.groupBy("component").agg(F.min(F.struct("excess", "id")).alias("best"))
    judged = excess.join(best, "component").withColumn("near", F.col("excess") + F.col("best.excess") <= 0)
    at_once = judged.where("near").select("id", F.col("best.id").alias("least")).where("id <> least")
    rest = cut.join(judged.where("not near and id <> best.id").select("id"), "id")
    rest_cuts = rest.groupBy("component").agg(F.ceil(F.sum("size") / share).cast("int").alias("rest_cuts"))
    every = cut.join(rest_cuts, "component").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest_cuts") - 1)))
    rest = rest.join(rest_cuts, "component").withColumn("other", F.pmod(F.xxhash64("id"), F.col("rest_cuts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    pairs = every.select("component", "block", "other", "id").union(rest.select("component", "block", "other", "id")).hint("merge").join(texts, "id")
    return at_once.union(pairs.groupBy("component", "block", "other").applyInArrow(verify, "id long, least long"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 90, n: int = N) -> DataFrame:
    """(key, n_features, component) of every row of ``docs``: the component is the smallest key that links lead to."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(f), *fingerprint(f)) for _, f in feature_sets(b.column(1), n)]
            numbers = np.array(found, np.int64).reshape(-1, 3)
            band = np.searchsorted(starts, numbers[:, 0], "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in (*numbers.T, band))], names=["id", "size", "fp", "fp2", "band"])

    starts = sharing.bands(percent)
    measured = staged(rows.mapInArrow(measure, "id long, size long, fp long, fp2 long, band long"), "jaccard-sets")
    # one row for each different set
    named = measured.where("id is not null and size > 0")
    by_band = {r["band"]: r["features"] for r in named.groupBy("band").agg(F.sum("size").alias("features")).collect()}
    sets = named.groupBy("fp", "fp2").agg(F.min("id").alias("id"), F.first("size").alias("size"))
    kept = sharing.candidates(rows.where("id is not null"), sum(by_band.values()), percent, n, by_band=by_band)
    kept = staged(kept.hint("merge").join(sets.select("fp", "fp2", "id"), ["fp", "fp2"]).select("id", "size", "text"), "jaccard-kept")
    release(rows.sparkSession)  # all texts and features have crossed the network, and are on disk until then
    linked = graph.components(links(kept, candidate_groups(kept, percent, n), percent, n), "id", "least", "jaccard-links")
    found = linked.select(F.col("node").alias("id"), F.col("component").alias("least"))

    # all rows of a set get its label; the copies of one set are dealt to several tasks
    of_set = sets.join(found, "id", "left").select("fp", "fp2", F.coalesce("least", "id").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    linked = named.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(of_set, ["fp", "fp2", "salt"]).select("id", "size", "component")
    alone = measured.where("id is null or size = 0").select("id", "size", F.col("id").alias("component"))
    return linked.union(alone).select(F.col("id").alias(key), F.col("size").alias("n_features"), "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 90, n: int = N) -> DataFrame:
    """``docs`` without the rows that are linked to one of a smaller key; of rows that repeat a key all stay or go."""
    found = components(docs, key, text, percent, n)
    gone = staged(found.where(F.col("component") < F.col(key)).select(F.col(key).alias("__gone")).distinct(), "jaccard-gone")
    release(docs.sparkSession)
    # the keys of few go to all tasks, so that no text crosses the network once more; many are joined
    few = gone.count() <= BROADCAST_KEYS
    return docs.join(gone.hint("broadcast" if few else "merge"), docs[key] == gone["__gone"], "left_anti")
