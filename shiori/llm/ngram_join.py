"""N-gram Jaccard join: a blocked sparse product of the document x n-gram incidence.

Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of
distinct word n-grams.  The join is exact.

1. *Classes.* Documents with equal sets are one node.
2. *Blocking without loss.*  From 85 per cent on, by parts: a linked pair differs
   in at most D n-grams, a bound derived from the smaller size; dealt by hash to
   more than D parts that are not empty in both, it agrees on a whole part.  A
   node emits the hash of each part, for its size class and, if a partner may lie
   there, for the class below; a level with more parts follows while too many are
   empty.  Below 85, where parts would hold few n-grams, by prefixes: in any one
   order of all n-grams, two linked sets share one among the first
   |A| - ceil(percent * |A| / 100) + 1 of each.  The order puts n-grams that many
   documents hold last; it decides the work, never the result.  Nodes that
   share an emitted mark are compared by size and by the parities of their
   n-gram counts in about as many bins as they have n-grams: the bins that differ
   are a lower bound of the difference, and pairs beyond the size-derived bound
   are discarded before any text is read.  That comparison, too, is a blocked
   product (of parity bits): no pair is emitted, and a task hands on a forest.
3. *Product.*  The nodes that still hang together form families.  A family is
   cut into blocks of sorted coordinates; the product of two blocks accumulates
   overlap counts as whole numbers, by listing the pairs of columns that few rows
   hold and multiplying slices of the columns that many hold, and pairs below the
   size-derived bound are discarded.  A large family is first multiplied by its
   most central node; nodes linked to that one need no product among each other.
   A block emits at most one link per node, so copies are never expanded into all
   pairs.
4. *Components* of those links by large-star and small-star steps.

Skew: copies collapse to one node before anything is paired; groups of an n-gram
are aggregated map-side and larger ones are tiled; families are tiled.  Nothing is
capped: a document of any group is compared as the bounds demand.  Of a family of
n documents that are nearly, but not quite, similar enough, some n² bits products
remain (a few seconds of one core for 20,000 documents), dealt to tasks by blocks.  Nodes are
named by a 64-bit hash of their set.

Edge cases: null, empty and blank texts have the empty set and link with
nothing; fewer words than n form one n-gram; null ids are never a component's
id unless all its ids are null; repeated rows are repeated in the result; an
empty table gives no rows.  :func:`keep_one` keeps all columns of its input.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiori.llm.common import few, parts, scratch, written
from shiori.llm.graph import components

#: Most n-grams in the list of common ones (8 bytes each): the bound of its broadcast.
COMMON = 1 << 20
#: Of so many documents at a time, n-grams are reported that at least so many hold.
COMMON_DOCS, COMMON_IN_BATCH = 4096, 3
#: A block of a family holds about this many n-grams, and nodes; so many nodes are multiplied at once.
BLOCK_GRAMS, FAMILY_NODES, BLOCK_NODES = 400_000, 2_048, 512
#: Rows of n-gram groups that are compared in one task, and nodes of a group beyond which it is cut into blocks.
GROUP_ROWS, GROUP_NODES = 2_000, 4_096
#: Groups of more nodes are united with those that they share nodes with, if all then cost fewer comparisons.
BIG_GROUP = 512
#: Columns (n-grams, or parity bits) multiplied at once.
SLICE = 4096
#: A column of which a block pair holds one in so many pairs or more is multiplied densely; at most so many pairs are listed at a time.
DENSE, LISTED = 64, 1 << 22
#: From this percentage on, part hashes bring nodes together; below, parts would be too small, and prefixes do.
PARTS_FROM = 85
LEVELS = 12
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of ASCII-lowered words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(ids))
    out = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * _A + ids[k : len(ids) - size + 1 + k])
    return np.unique(out)


def linked(overlap, a, b, percent: int):
    return (100 + percent) * overlap >= percent * (a + b)


def prefix(grams: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The first n-grams of a set, common ones last: what a linked set shares at least one of."""
    n = len(grams)
    size = n - -(-n * percent // 100) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        last = common[at] == grams
        grams = np.concatenate((grams[~last], grams[last]))
    return grams[:size]


@functools.lru_cache(maxsize=4)
def size_classes(percent: int) -> tuple[list[int], list[int]]:
    """Least sizes of the size classes (a partner is in the same or a neighbouring one), and D of each."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, -(-least[-1] * 100 // percent), least[-1] * 5 // 4))
    return least, [(b - 1) * (100 - percent) // percent for b in least[1:]]


def part_hashes(grams: np.ndarray, percent: int) -> np.ndarray:
    """The hashes by which a node finds every possible partner."""
    least, most = size_classes(percent)
    n = len(grams)
    k = int(np.searchsorted(least, n, side="right")) - 1
    schemes = [k]
    if k and -(-n * percent // 100) <= least[k] - 1:
        schemes.append(k - 1)
    tops, mixed, out = grams >> np.uint64(32), mix(grams ^ _B), []
    for s in schemes:
        d = most[s]
        if d == 0:
            continue  # only equal sets link
        spare = 1.5 * np.exp(-0.9 * least[s] / (d + 1))
        for level in range(LEVELS):
            m = d + 1 + int(np.ceil((d + 1) * spare * 1.3**level)) * (level > 0 or spare > 0.002) + level
            part = (tops * np.uint64(m)) >> np.uint64(32)
            start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sums = np.add.reduceat(mixed, start)
            tag = np.uint64(s * 64 + level)
            out.append(mix(sums + part[start] * _C + mix(np.array([m], np.uint64) * _A + tag)))
            if len(start) > d:
                break
        else:
            out.append(mix(np.array([s], np.uint64) * _A + _C))  # too few parts at any level: all such nodes meet
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def marks(grams: np.ndarray, percent: int, common: np.ndarray | None) -> np.ndarray:
    """What a node emits, so that linked nodes have at least one in common."""
    return part_hashes(grams, percent) if common is None else prefix(grams, percent, common)


def parities(grams: np.ndarray) -> bytes:
    """A bit per bin of n-grams (by leading bits of the hash): whether it holds an odd number."""
    bits = max(6, int(len(grams) - 1).bit_length())
    odd = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bins: np.ndarray) -> np.ndarray:
    """Parities in half as many bins."""
    bits = np.unpackbits(bins)
    return np.packbits(bits[::2] ^ bits[1::2])


FACTS = "doc_id long, th long, n_shingles long, node long, bins binary, parts array<long>"


def common_grams(df: DataFrame, *, n: int, text_col: str) -> np.ndarray:
    """Sorted n-grams that many documents hold, counted over all of them, some at a time; at most COMMON."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COMMON_DOCS):
                sets = [shingles(t.as_py(), n) for t in batch.column(0).slice(start, COMMON_DOCS)]
                grams = np.concatenate(sets)
                del sets
                grams, times = np.unique(grams, return_counts=True)
                many = times >= COMMON_IN_BATCH
                yield pa.RecordBatch.from_arrays([pa.array(grams[many].view(np.int64)), pa.array(times[many], pa.int64())], names=["gram", "times"])

    counted = df.select(F.col(text_col).alias("text")).mapInArrow(count, "gram long, times long")
    counted = written(counted.groupBy("gram").agg(F.sum("times").alias("times")), "ngram-common")
    # The least count that leaves at most COMMON n-grams, from counts by eighths of a power of two.
    step = F.floor(8 * F.log2("times")).cast("int")
    room, least = COMMON, 1 << 30
    for s, many in sorted(((r[0], r[1]) for r in counted.groupBy(step).count().collect()), reverse=True):
        room -= many
        if room < 0:
            break
        least = s
    return np.sort(counted.filter(step >= least).select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64))


def facts(df: DataFrame, *, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: size, node, parities and prefix."""
    shared = df.sparkSession.sparkContext.broadcast(None if percent >= PARTS_FROM else common_grams(df, n=n, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sizes, nodes, bins, found = [], [], [], []
                for text in part.column(2):
                    grams = shingles(text.as_py(), n)
                    sizes.append(len(grams))
                    nodes.append(int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) if len(grams) else None)
                    bins.append(parities(grams) if len(grams) else b"")
                    found.append(marks(grams, percent, shared.value).view(np.int64) if len(grams) else np.zeros(0, np.int64))
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bins, pa.binary()), lists], names=["doc_id", "th", "n_shingles", "node", "bins", "parts"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, FACTS), "ngram-facts")


class Sketches:
    """Sizes and parities of some nodes, each at its own number of bins and at half as many."""

    def __init__(self, sizes: np.ndarray, bins: list[bytes]) -> None:
        self.sizes = sizes
        self.width = np.array([len(b) for b in bins], np.int64)
        rows: dict[int, list[np.ndarray]] = {}
        self.place = {}
        for i, raw in enumerate(bins):
            own = np.frombuffer(raw, np.uint8)
            for row in (own, folded(own)) if len(own) > 1 else (own,):
                held = rows.setdefault(len(row), [])
                self.place[i, len(row)] = len(held)
                held.append(row)
        self.rows = {w: np.stack(x) for w, x in rows.items()}
        self.at = {w: np.full(len(bins), -1, np.int64) for w in self.rows}
        for (i, w), k in self.place.items():
            self.at[w][i] = k

    def compatible(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs the sizes and parities do not rule out."""
        a, b = self.sizes[i], self.sizes[j]
        out = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        width = np.minimum(self.width[i], self.width[j])
        for w, rows in self.rows.items():
            here = np.flatnonzero(out & (width == w))
            x, y = self.at[w][i[here]], self.at[w][j[here]]
            both = (x >= 0) & (y >= 0)  # sizes that may link differ by one halving at most
            here, x, y = here[both], x[both], y[both]
            differ = np.bitwise_count(rows[x] ^ rows[y]).sum(axis=1, dtype=np.int64)
            out[here] = (100 + percent) * differ <= (100 - percent) * (a[here] + b[here])
        return out


def _forest(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Root (first in ``order``'s ranks) of each of n nodes under the edges i-j."""
    label = order.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        new = np.minimum(new, new[back[new]])
        if (new == label).all():
            return back[label]
        label = new


def _edges(nodes: np.ndarray, root: np.ndarray) -> pa.Table:
    keep = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"a": pa.array(nodes[keep], pa.int64()), "b": pa.array(nodes[root[keep]], pa.int64())})


def halved(rows: np.ndarray) -> np.ndarray:
    """Parities of many nodes (rows of bytes) in half as many bins."""
    bits = np.unpackbits(rows, axis=1)
    return np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1)


def near_pairs(sizes: np.ndarray, bins: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs that sizes and parities do not rule out, block by block, as a blocked product of the parity bits.

    Bits that differ are those of both less twice the common ones; two nodes are
    compared at the smaller number of bins.  A pair comes once or twice.
    """
    width = np.array([len(b) for b in bins])
    held = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    rows = {w: np.frombuffer(b"".join(bins[k] for k in at), np.uint8).reshape(-1, w) for w, at in held.items()}
    widths = sorted(held)
    for w in widths:
        most = sizes[held[w]].max() * 100 // percent + 1
        others, made = [], []
        for wide in widths[widths.index(w) :]:
            at = held[wide]
            here = sizes[at] <= most
            folded_rows = rows[wide][here]
            k = wide
            while k > w and len(folded_rows):
                folded_rows, k = halved(folded_rows), k // 2
            others.append(at[here])
            made.append(folded_rows.reshape(-1, w))
        other, right = np.concatenate(others), np.concatenate(made)
        for a in range(0, len(held[w]), BLOCK_NODES):
            own, left = held[w][a : a + BLOCK_NODES], rows[w][a : a + BLOCK_NODES]
            for b in range(0, len(other), 2 * BLOCK_NODES):
                to, cols = other[b : b + 2 * BLOCK_NODES], right[b : b + 2 * BLOCK_NODES]
                common = np.zeros((len(own), len(to)), np.int64)
                for at in range(0, w, SLICE // 8):
                    x, y = (np.unpackbits(m[:, at : at + SLICE // 8], axis=1).astype(np.float32) for m in (left, cols))
                    common += (x @ y.T).astype(np.int64)  # whole numbers up to SLICE, so exact
                differ = np.bitwise_count(left).sum(axis=1, dtype=np.int64)[:, None] + np.bitwise_count(cols).sum(axis=1, dtype=np.int64) - 2 * common
                s, t = sizes[own][:, None], sizes[to][None, :]
                ok = (100 * np.minimum(s, t) >= percent * np.maximum(s, t)) & ((100 + percent) * differ <= (100 - percent) * (s + t))
                i, j = np.nonzero(ok)
                i, j = own[i], to[j]
                yield i[i != j], j[i != j]


class Forest:
    """Edges among n nodes, folded into a spanning forest whenever they are many."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append(np.stack((self.root[i], self.root[j])))
        self.size += len(i)
        if self.size > 1 << 20:
            self.roots()

    def roots(self) -> np.ndarray:
        """The least node of each node's tree."""
        if self.held:
            i, j = np.concatenate(self.held, axis=1)
            n = len(self.root)
            self.root = _forest(n, i, j, np.arange(n))[self.root]
            self.held, self.size = [], 0
        return self.root


def group_edges(percent: int):
    """For tiles of n-gram groups (tile, sig, side, node, n, bins): compatible pairs as a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        sig, side, node = (table.column(c).to_numpy() for c in ("sig", "side", "node"))
        sizes, bins = table.column("n").to_numpy(), table.column("bins")
        order = np.argsort(sig, kind="stable")
        names, index = np.unique(node, return_inverse=True)
        forest = Forest(len(names))
        for own in np.split(order, np.flatnonzero(np.diff(sig[order])) + 1):
            for i, j in near_pairs(sizes[own], bins.take(pa.array(own)).to_pylist(), percent):
                i, j = own[i], own[j]
                keep = (side[i] != side[j]) | (side[i] == 0)
                forest.add(index[i[keep]], index[j[keep]])
        return _edges(names, forest.roots())

    return run


def by_size(groups: DataFrame, percent: int) -> DataFrame:
    """Groups (sig, node, n) split by size (adding _class), so that each pair whose sizes may link stays together in one.

    Classes grow by a little more than the largest ratio of linked sizes; a node
    is in the group of its class and of the class below, where smaller partners
    lie.  Groups of one node go, and of groups with the same nodes one stays.
    """
    own = F.floor(F.log("n") / F.log(F.lit(100 / percent * 1.0001))).cast("long")
    rows = written(groups.withColumn("_class", F.explode(F.array(own, own - 1))).select(F.xxhash64("sig", "_class").alias("sig"), "node", "n", "_class"), "ngram-by-size")
    sets = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_m"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("_y"))
    sets = sets.filter("_n > 1").groupBy("_n", "_m", "_x", "_y").agg(F.min("sig").alias("sig"))
    return rows.join(sets.select("sig"), "sig")


def united(groups: DataFrame) -> DataFrame:
    """``groups`` (sig, node, n, _class: a written table) with big ones of a class that share nodes made one, where that is cheaper.

    A family brings the same nodes together in many groups; compared once, as a
    whole, they cost the square of the family, not the sum of the groups' squares.
    The nodes that any group brings together are together in the union as well.
    """
    sizes = groups.groupBy("sig").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_pivot")).filter(F.col("_n") > BIG_GROUP)
    sizes = written(sizes, "ngram-big-sizes")  # so that the join is of two shuffles, which a hot group may be split in
    big = written(groups.join(sizes, "sig").select("sig", "node", "n", "_n", F.xxhash64("node", "_class").alias("_key"), F.xxhash64("_pivot", "_class").alias("_pivot")), "ngram-big")
    if not big.head(1):
        return groups.drop("_class")
    roots = components(big.select(F.col("_key").alias("a"), F.col("_pivot").alias("b")))
    big = big.join(roots.withColumnRenamed("node", "_key"), "_key", "left").select("sig", "node", "n", "_n", F.coalesce("root", "_key").alias("root"))
    big = written(big, "ngram-big-rooted")
    apart = big.groupBy("root", "sig").agg(F.first("_n").alias("_n")).groupBy("root").agg(F.sum(F.col("_n") * F.col("_n")).alias("_apart"))
    members = written(big.groupBy("root", "node").agg(F.first("n").alias("n")), "ngram-united")
    together = members.groupBy("root").agg(F.count(F.lit(1)).alias("_all")).join(apart, "root").filter(F.col("_all") * F.col("_all") <= F.col("_apart"))
    together = written(together.select("root"), "ngram-together")
    gone = written(big.join(together, "root", "left_semi").select("sig").distinct(), "ngram-gone")
    return groups.join(gone, "sig", "left_anti").select("sig", "node", "n").unionByName(members.join(together, "root", "left_semi").select(F.xxhash64(F.lit(2), "root").alias("sig"), "node", "n"))


def candidate_edges(found: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that hold together all nodes that may link, and the nodes' centrality (shared n-grams).

    In the group of an n-gram whose members are all compatible with its least node, that
    node stands for the group; in any other group all pairs are compared.
    """
    # A node once, however many documents are it; its marks differ from each other.
    nodes = found.filter("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bins").alias("bins"), F.first("parts").alias("parts"))
    nodes = written(nodes, "ngram-nodes")
    rows = nodes.select("node", F.explode("parts").alias("sig"))
    groups = rows.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("_top")).filter("pivot < _top").drop("_top")
    groups = written(groups, "ngram-groups")
    members = written(rows.join(groups, "sig"), "ngram-members")
    # N-grams of one shared passage bring the same nodes together: one of them stands for all.
    same = members.groupBy("sig", "pivot").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("_y"))
    same = same.groupBy("pivot", "_n", "_x", "_y").agg(F.min("sig").alias("sig"))
    alike = written(members.join(same.select("sig", "_n"), "sig"), "ngram-alike")
    pairs = alike.filter("node != pivot").select("node", "pivot").distinct()
    other = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("n2"), F.col("bins").alias("bins2"))
    pairs = pairs.join(nodes, "node").join(other, "pivot")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = b.num_rows
                sizes = np.concatenate((b.column(2).to_numpy(), b.column(4).to_numpy()))
                ok = Sketches(sizes, b.column(3).to_pylist() + b.column(5).to_pylist()).compatible(np.arange(n), np.arange(n) + n, percent)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok)], names=["node", "pivot", "ok"])

    judged = written(pairs.select("node", "pivot", "n", "bins", "n2", "bins2").mapInArrow(judge, "node long, pivot long, ok boolean"), "ngram-judged")
    stars = judged.filter("ok").select(F.col("node").alias("a"), F.col("pivot").alias("b"))

    # A group of two has no pair but the one that was judged.
    rest = alike.filter("_n > 2")
    odd = written(rest.join(judged.filter("not ok").select("node", "pivot"), ["node", "pivot"]).select("sig").distinct(), "ngram-odd-groups")
    odd = written(by_size(rest.join(odd, "sig").join(nodes.select("node", "n"), "node").select("sig", "node", "n"), percent), "ngram-sized")
    odd = united(odd)
    odd = written(odd.join(nodes.select("node", "bins"), "node").select("sig", "node", "n", "bins"), "ngram-odd")
    sizes = written(odd.groupBy("sig").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.ceil(F.col("_n") / GROUP_NODES)), "ngram-odd-sizes")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    tiles = odd.join(sizes, "sig").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_b")))
    # A group of one block is a tile with others; of more, a node goes to the tile of its block and each block.
    tiles = tiles.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)))
    pair = F.struct(F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"))
    bins = max(1, total // GROUP_ROWS)
    tiles = tiles.withColumn("tile", F.when(F.col("_b") == 1, F.pmod(F.xxhash64("sig"), F.lit(bins))).otherwise(F.xxhash64("sig", pair)))
    tiles = tiles.withColumn("side", F.when((F.col("_b") == 1) | (F.col("_own") == F.col("_other")), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2))
    inside = tiles.select("tile", "sig", "side", "node", "n", "bins").groupBy("tile").applyInArrow(group_edges(percent), "a long, b long")
    centrality = members.groupBy("node").agg(F.count(F.lit(1)).alias("central"))
    return written(stars.unionByName(inside), "ngram-candidates"), centrality


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The product of two blocks of incidence rows: overlap counts, as whole numbers.

    Both blocks are coordinate lists sorted by column.  Of a column that few rows
    hold, the pairs of its rows are listed and counted; columns that many hold are
    multiplied densely, slice by slice.
    """
    nl, nr = len(left), len(right)
    out = np.zeros((nl, nr), np.int32)
    columns = np.intersect1d(*(np.unique(np.concatenate(x)) for x in (left, right)), assume_unique=True)
    if not len(columns):
        return out

    def coordinates(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
        here = columns[at] == flat
        at, row = at[here], row[here]
        order = np.argsort(at, kind="stable")
        return at[order], row[order], np.bincount(at, minlength=len(columns))

    (lc, lr, ln), (rc, rr, rn) = coordinates(left), coordinates(right)
    pairs = ln * rn
    dense = pairs * DENSE >= nl * nr
    number = np.cumsum(dense) - 1
    sides = []
    for c, r in ((lc, lr), (rc, rr)):
        many = dense[c]
        sides.append((number[c[many]], r[many]))
    for start in range(0, int(dense.sum()), SLICE):
        width = min(SLICE, int(dense.sum()) - start)
        a, b = np.zeros((nl, width), np.float32), np.zeros((nr, width), np.float32)
        for (c, r), m in zip(sides, (a, b), strict=True):
            lo, hi = np.searchsorted(c, (start, start + width))
            m[r[lo:hi], c[lo:hi] - start] = 1
        out += (a @ b.T).astype(np.int32)  # whole numbers up to SLICE, so exact
    few_rows = np.flatnonzero(~dense)
    left_start, right_start = np.cumsum(ln) - ln, np.cumsum(rn) - rn
    upto = np.cumsum(pairs[few_rows])
    at = 0
    while at < len(few_rows):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LISTED, side="right")))
        own = few_rows[at:stop]
        n = pairs[own]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(own, n)
        code = lr[left_start[own] + place // rn[own]] * nr + rr[right_start[own] + place % rn[own]]
        out += np.bincount(code, minlength=nl * nr).reshape(nl, nr).astype(np.int32)
        at = stop
    return out


def product_links(grams: list[np.ndarray], rows: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (row of ``rows``, any other) of a block, or of two, some rows at a time."""
    sizes = np.array([len(g) for g in grams])
    # An n-gram of one row alone is in no overlap.
    flat = np.concatenate(grams)
    _, back, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[back] > 1
    grams = [g[k] for g, k in zip(grams, np.split(shared, np.cumsum(sizes)[:-1]), strict=True)]
    for at in range(0, len(rows), BLOCK_NODES):
        own = rows[at : at + BLOCK_NODES]
        # Only rows of sizes that can reach the bound take part in the product.
        low, high = sizes[own].min() * percent // 100, -(-sizes[own].max() * 100 // percent)
        near = np.flatnonzero((sizes >= low) & (sizes <= high))
        for b in range(0, len(near), 4 * BLOCK_NODES):
            to = near[b : b + 4 * BLOCK_NODES]
            counts = overlaps([grams[i] for i in own], [grams[i] for i in to])
            i, j = np.nonzero(linked(counts.astype(np.int64), sizes[own][:, None], sizes[to][None, :], percent))
            i, j = own[i], to[j]
            keep = i != j
            yield i[keep], j[keep]


def tile_edges(n: int, percent: int):
    """For tiles (tile, family, role, node, text): links as a spanning forest.  Roles: 1 a row, 2 a column, 3 both."""

    def run(table: pa.Table) -> pa.Table:
        family, role, node = (table.column(c).to_numpy() for c in ("family", "role", "node"))
        texts = table.column("text")
        order = np.argsort(family, kind="stable")
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            # Repeated rows of a node (a repeated document, or both roles) are one.
            names, first, back = np.unique(node[own], return_index=True, return_inverse=True)
            if len(names) < 2:
                continue
            is_row = np.zeros(len(names), bool)
            is_row[back[role[own] != 2]] = True
            grams = [shingles(texts[int(own[k])].as_py(), n) for k in first]
            forest = Forest(len(names))
            for i, j in product_links(grams, np.flatnonzero(is_row), percent):
                forest.add(i, j)
            out.append(_edges(names, forest.roots()))
        return pa.concat_tables(out) if out else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return run


def one_each(texts: DataFrame, nodes: int) -> DataFrame:
    """A row of ``texts`` (a written table) for each of its ``nodes``: of repeated documents one lends its text."""
    if texts.count() <= nodes:
        return texts
    again = few(written(texts.groupBy("node").count().filter("count > 1").select("node"), "ngram-lent-again"))
    others = [c for c in texts.columns if c not in ("node", "text")]
    once = texts.join(again, "node", "left_semi").groupBy("node").agg(*(F.first(c).alias(c) for c in others), F.first("text").alias("text"))
    return written(texts.join(again, "node", "left_anti").unionByName(once.select(*texts.columns)), "ngram-texts")


def links(df: DataFrame, found: DataFrame, *, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Verified links (a, b) of nodes: at most one per node and tile, and enough to hold each component together."""
    candidates, centrality = candidate_edges(found, percent)
    family = components(candidates)
    family = written(family.unionByName(family.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("root", "family"), "ngram-families")
    # The document that lends its text to a node.
    lender = found.filter("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("_l"), F.first("n_shingles").alias("n"))
    member = family.join(lender, "node").join(centrality, "node").select("node", "family", "n", "central", F.col("_l.doc_id").alias("_id"), F.col("_l.th").alias("_th"))
    member = written(member, "ngram-lenders")
    size = member.groupBy("family").agg(F.sum("n").alias("_g"), F.count(F.lit(1)).alias("_n"), F.max(F.struct("central", "node"))["node"].alias("hub"))
    blocks = F.greatest(F.ceil(F.col("_g") / BLOCK_GRAMS), F.ceil(F.col("_n") / FAMILY_NODES)).cast("long")
    size = written(size.select("family", "_g", "hub", F.when(F.col("_n") <= FAMILY_NODES, F.greatest(F.lit(1), F.ceil(F.col("_g") / (4 * BLOCK_GRAMS)))).otherwise(blocks).cast("long").alias("_b")), "ngram-family-sizes")
    total = size.agg(F.coalesce(F.sum("_g"), F.lit(0))).first()[0]
    docs = df.select(F.col(id_col).cast("long").alias("_id2"), F.xxhash64(text_col).alias("_th2"), F.col(text_col).alias("text"))
    asked = few(written(member.join(size.drop("_g"), "family"), "ngram-asked"))
    texts = docs.join(asked, (F.col("_th") == F.col("_th2")) & F.col("_id").eqNullSafe(F.col("_id2")))
    texts = written(texts.select("node", "family", "n", "hub", "_b", F.pmod(F.xxhash64("node"), F.col("_b")).alias("_own"), "text"), "ngram-lent")
    texts = one_each(texts, member.count())

    tile = F.pmod(F.xxhash64("family"), F.lit(max(1, total // BLOCK_GRAMS)))
    one = texts.filter("_b = 1").select(tile.alias("tile"), "family", F.lit(3).alias("role"), "node", "text")
    schema = "a long, b long"
    if not size.filter("_b > 1").head(1):
        return one.groupBy("tile").applyInArrow(tile_edges(n, percent), schema)

    # Large families: first against the hub, whose text goes to each block of its family.
    many = texts.filter("_b > 1")
    hubs = many.filter("node = hub").groupBy("family", "hub", "_b").agg(F.min("text").alias("hub_text"))
    hubs = hubs.select(F.col("family").alias("_f"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)).alias("_o"), "hub_text")
    against = many.join(hubs, (F.col("family") == F.col("_f")) & (F.col("_own") == F.col("_o")))

    def hub_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 64):
            got, of_hub = np.zeros(b.num_rows, bool), b.column(2).to_numpy()
            for hub in np.unique(of_hub):
                own = np.flatnonzero(of_hub == hub)
                grams = [shingles(b.column(5)[int(k)].as_py(), n) for k in own]
                center = shingles(b.column(6)[int(own[0])].as_py(), n)
                counts = overlaps(grams, [center])[:, 0].astype(np.int64)
                got[own] = linked(counts, np.array([len(g) for g in grams]), len(center), percent)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(got, pa.bool_())], names=["node", "family", "hub", "_b", "n", "near"])

    near = written(against.select("node", "family", "hub", "_b", "n", "text", "hub_text").mapInArrow(hub_links, "node long, family long, hub long, _b long, n long, near boolean"), "ngram-hubs")
    stars = near.filter("near and node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    # The rest, in blocks of its own, against every block of the family.
    rest = near.filter("not near").groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count(F.lit(1)) / FAMILY_NODES)).cast("long").alias("_r"))
    far = many.join(near.filter("not near").select("node").distinct(), "node").join(rest, "family")
    far = far.withColumn("_row", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("_r"))).withColumn("_col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)))
    cols = many.join(rest, "family").withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_r") - 1))).withColumn("_col", F.col("_own"))
    place = F.xxhash64("family", "_row", "_col").alias("tile")
    tiles = one.unionByName(far.select(place, "family", F.lit(1).alias("role"), "node", "text")).unionByName(cols.select(place, "family", F.lit(2).alias("role"), "node", "text"))
    return tiles.groupBy("tile").applyInArrow(tile_edges(n, percent), schema).unionByName(stars)


def join_components(df: DataFrame, *, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, th (hash of its text), n_shingles, component_id (the least id reachable) and leads.

    ``leads``: whether the row is its component's first by id (null last), then
    th; documents without words lead.
    """
    with scratch() as keep:
        found = keep(facts(df, n=n, percent=percent, id_col=id_col, text_col=text_col))
        roots = components(written(links(df, found, n=n, percent=percent, id_col=id_col, text_col=text_col), "ngram-links"))
        name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
        classes = found.filter("node is not null").groupBy("node").agg(F.min(name).alias("low"))
        classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = classes.groupBy("root").agg(F.min("low").alias("lead"))
        classes = keep(written(classes.join(least, "root").select("node", "lead"), "ngram-classes"))
    out = found.select("doc_id", "th", "n_shingles", "node").join(classes, "node", "left")
    alone = F.col("node").isNull()
    return out.select("doc_id", "th", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("component_id"), (alone | (F.col("lead") == name)).alias("leads"))


def keep_one(df: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document of each group of linked ones, the one with the least id; documents without words stay.

    Of repeated rows (equal id and text, with words) one stays, whichever Spark meets first.
    """
    judged = written(join_components(df, n=n, percent=percent, id_col=id_col, text_col=text_col), "ngram-judged-docs")
    key = [F.col("doc_id").alias("id2"), F.col("th").alias("th2")]
    gone = few(written(judged.filter("not leads").select(*key).distinct(), "ngram-drop"))
    again = few(written(judged.filter("leads and n_shingles > 0").groupBy("doc_id", "th").count().filter("count > 1").select(*key), "ngram-again"))
    # The row stands in a struct, so that none of its columns can clash.
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("input"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"))
    own = F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))
    kept = rows.join(gone, own, "left_anti")
    if again.head(1):
        kept = kept.join(again, own, "left_anti").unionByName(kept.join(again, own, "left_semi").dropDuplicates(["id", "th"]))
    return kept.select("input.*")
