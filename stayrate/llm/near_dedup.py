"""Near duplicates by b-bit MinHash.

Every document keeps the minima of HASHES hash functions over its word shingles. Bands of
minima propose candidates; of each minimum only BITS low bits are kept, in packed words, from
which the similarity is estimated by counting bits and correcting for chance agreement.
Candidates that are clearly apart go; the others are confirmed on their full shingle sets.

Documents with equal shingle sets are one node. A band bucket is searched from a pivot, the
member that meets most others in all its buckets, so a group of copies gives one pair per copy
and not all pairs. Members of buckets that the pivots leave in different components meet once more
where they share one of their rare shingles and what they may share after it suffices; loose
copies of one text share it with many, but their own words soon rule out that they are similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.components import components
from stayrate.llm.kernels import mixed, pieces, shingle_sets, text_bytes
from stayrate.llm.native import stored

#: 50 bands of 6: documents of similarity 0.8 share a band but for a chance of 3e-7.
BANDS, ROWS, BITS = 50, 6, 2
HASHES = BANDS * ROWS
PLANES = BITS * ((HASHES + 63) // 64)
#: Candidates go if their estimate lies so many standard deviations under the threshold.
SIGMAS = 6.0
_CHUNK = 1 << 15
#: Sets meet by size in classes of about 3 percent.
_SIZE_STEP = 0.03


def _functions() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    a = random.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)
    return a.astype(np.uint32), random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def minima(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over every (non-empty) set, as documents x HASHES."""
    a, b = _functions()
    n = len(starts) - 1
    result = np.full((n, HASHES), np.iinfo(np.uint32).max, np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + _CHUNK, "right")) - 1)
        part, cuts = x[starts[first] : starts[last]], starts[first:last] - starts[first]
        hashed = np.empty_like(part)
        for j in range(HASHES):
            np.multiply(part, a[j], out=hashed)
            np.add(hashed, b[j], out=hashed)
            result[first:last, j] = np.minimum.reduceat(hashed, cuts)
        first = last
    return result


def band_keys(lows: np.ndarray) -> np.ndarray:
    """One 64-bit key per document and band."""
    keys = np.zeros((len(lows), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        keys = mixed(keys * np.uint64(3) + lows[:, j::ROWS])
    return keys


def packed_bits(lows: np.ndarray) -> np.ndarray:
    """The low BITS of every (mixed) minimum, one bit plane after the other, as 64-bit words."""
    low = mixed(lows.astype(np.uint64) + np.uint64(1))
    padded = np.zeros((len(lows), BITS, PLANES // BITS * 64), np.uint8)
    for bit in range(BITS):
        padded[:, bit, :HASHES] = (low >> np.uint64(bit)) & np.uint64(1)
    return np.packbits(padded.reshape(len(lows), -1), axis=1).view(">u8").astype(np.int64)


def _digests(sets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Two hashes of every set; 0 for empty ones."""
    some = np.flatnonzero(np.diff(cuts))
    digest = np.zeros((len(cuts) - 1, 2), np.uint64)
    if len(some):
        digest[some, 0] = np.add.reduceat(mixed(sets + np.uint64(7)), cuts[:-1][some])
        digest[some, 1] = np.bitwise_xor.reduceat(mixed(sets ^ np.uint64(0x55)), cuts[:-1][some])
    return digest


def node_names(sizes: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """A number per set that equal sets share, whatever the documents they come from."""
    return mixed(mixed(digest[:, 0] + sizes.astype(np.uint64)) * np.uint64(3) + digest[:, 1]).view(np.int64)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, starts = text_bytes(batch.column("text"))
            for a, b in pieces(starts):
                sets, cuts = shingle_sets(body[starts[a] : starts[b]], starts[a : b + 1] - starts[a], k)
                sizes = np.diff(cuts)
                some = np.flatnonzero(sizes)
                found = cuts[:-1][some]
                low = minima(sets, np.append(found, len(sets)))
                digest = _digests(sets, cuts)
                keys, bits = np.zeros((b - a, BANDS), np.int64), np.zeros((b - a, PLANES), np.int64)
                keys[some], bits[some] = band_keys(low).view(np.int64), packed_bits(low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a),
                        pa.array(node_names(sizes, digest)),
                        pa.array(sizes),
                        pa.array(digest[:, 0].view(np.int64)),
                        pa.array(digest[:, 1].view(np.int64)),
                        _lists(keys),
                        _lists(bits),
                    ],
                    ["id", "node", "n", "digest", "digest2", "keys", "bits"],
                )

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, starts = text_bytes(batch.column("text"))
            for a, b in pieces(starts):
                sets, cuts = shingle_sets(body[starts[a] : starts[b]], starts[a : b + 1] - starts[a], k)
                rows = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(sets.view(np.int64)))
                names = node_names(np.diff(cuts), _digests(sets, cuts))
                wanted = batch.column("node").slice(a, b - a)
                kept = pc.equal(pa.array(names), wanted)  # a repeated id brings other texts too
                yield pa.RecordBatch.from_arrays([wanted.filter(kept), rows.filter(kept)], ["node", "set"])

    return run


def estimate(bits: str, other: str) -> Column:
    """The similarity that the packed bits of two columns suggest, corrected for chance."""
    words = PLANES // BITS
    differing = []
    for word in range(words):
        planes = [f"({bits}[{bit * words + word}] ^ {other}[{bit * words + word}])" for bit in range(BITS)]
        differing.append(f"bit_count({' | '.join(planes)})")
    agree = 1 - F.expr(" + ".join(differing)) / float(HASHES)
    chance = 1 / 2**BITS
    return (agree - chance) / (1 - chance)


def cut_off(threshold: float) -> float:
    """The estimate below which candidates go."""
    chance = 1 / 2**BITS
    agree = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)


class _Search:
    """Confirms candidate pairs of nodes on their full sets."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, k: int, percent: int):
        self.texts, self.nodes, self.k, self.percent = texts, nodes, k, percent

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """The full shingle sets of nodes."""
        found = self.texts.join(wanted.join(self.nodes.select("node", "id"), "node"), "id").select("node", "text")
        return stored(found.mapInArrow(_sets(self.k), "node long, set array<long>").dropDuplicates(["node"]), "sets")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar enough."""
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        near = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        passed = stored(
            sized.where(near & (estimate("bitsa", "bitsb") >= cut_off(self.percent / 100))).select("a", "b", "na", "nb"),
            "passed",
        )
        wanted = passed.select("a").union(passed.select("b")).distinct().withColumnRenamed("a", "node")
        sets = self.sets_of(stored(wanted, "wanted"))
        first = sets.select(F.col("node").alias("a"), F.col("set").alias("seta"))
        second = sets.select(F.col("node").alias("b"), F.col("set").alias("setb"))
        shared = F.size(F.array_intersect("seta", "setb"))
        compared = passed.join(first, "a").join(second, "b").withColumn("shared", shared)
        similar = 100 * F.col("shared") >= self.percent * (F.col("na") + F.col("nb") - F.col("shared"))
        return stored(compared.where(similar).select("a", "b"), "linked")


def _rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """The rare shingles of every set, of which any two sets that are similar enough share one.

    Shingles are in one order for all sets, those of the fewest sets first. If two sets are similar
    enough, the first shingle they share stands at most (1 - percent / 100) into each, and
    what follows it bounds how much they share: ``low`` to ``high`` are the sizes of sets with which
    that may suffice. Shingles of one set only take a place but are shared with nothing.
    """
    each = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    ordered = each.join(common, "shingle").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("common")
    )
    placed = ordered.select(
        "node", "n", F.expr("n - size(common)").alias("alone"), F.posexplode("common").alias("place", "it")
    )
    most = F.expr("n - alone - place")  # shared at most, if this is the first that is shared
    high = F.least(F.floor(most * (100 + percent) / percent) - F.col("n"), F.floor(F.col("n") * 100 / percent))
    low = F.expr(f"({percent} * n + 99) div 100")
    return (
        placed.select("node", "n", F.col("it.shingle").alias("shingle"), low.alias("low"), high.alias("high"))
        .where("low <= high")
    )


def _apart_pairs(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be similar enough."""
    rare = stored(_rare_shingles(sets, percent).join(apart, "node"), "rare")
    parts = rare.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("in_root"))
    largest = parts.groupBy("shingle").agg(
        F.max(F.struct("in_root", "root")).alias("most"), F.count(F.lit(1)).alias("roots")
    )
    largest = largest.where("roots > 1").select("shingle", F.col("most.root").alias("most_root"))
    met = rare.join(largest, "shingle")
    size_class = lambda n: F.floor(F.log(n.cast("double")) / _SIZE_STEP)
    few = met.where("root <> most_root").select(
        "shingle",
        F.explode(F.sequence(size_class(F.col("low")), size_class(F.col("high")))).alias("class"),
        *(F.col(c).alias(f"{c}x") for c in ("node", "root", "n", "low", "high")),
    )
    many = met.select(
        "shingle",
        size_class(F.col("n")).alias("class"),
        "most_root",
        *(F.col(c).alias(f"{c}y") for c in ("node", "root", "n", "low", "high")),
    )
    once = (F.col("rootx") != F.col("rooty")) & ((F.col("rooty") == F.col("most_root")) | (F.col("nodex") < F.col("nodey")))
    fits = F.col("ny").between(F.col("lowx"), F.col("highx")) & F.col("nx").between(F.col("lowy"), F.col("highy"))
    cross = few.join(many, ["shingle", "class"]).where(once & fits)
    return cross.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    A document's set is its different ``k``-word shingles: A-Z lower-cased, words are runs of
    other than ASCII white space, fewer words make one shingle, null or blank texts none.
    Documents are linked if 100 * shared >= ``percent`` * union, and ``component_id`` is the
    smallest id that links reach; without words a document is its own component. Ids are whole
    numbers; rows that repeat an id are one document as far as links go, and a null id is linked
    with nothing. Empty tables give an empty result; other columns are ignored.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    made = texts.mapInArrow(
        _signatures(k), "id long, node long, n long, digest long, digest2 long, keys array<long>, bits array<long>"
    )
    signed = stored(made, "signatures")
    usable = signed.where("n > 0 AND id IS NOT NULL")
    # Of each node the document with the smallest id stands for it.
    smallest = stored(usable.groupBy("node").agg(F.min("id").alias("id")), "nodes")
    own = usable.select("id", "node", "n", "keys", "bits").join(smallest, ["node", "id"], "left_semi")
    nodes = stored(own.dropDuplicates(["node"]).select("node", "id", "n", "keys", "bits"), "own")
    # Different texts of one id are one document: their nodes are linked.
    ids = usable.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most")
    alike = usable.select("id", F.col("node").alias("b")).join(ids, "id").where("a <> b").select("a", "b").distinct()
    alike = stored(alike, "alike")

    banded = nodes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = stored(banded.join(shared, "key"), "buckets")
    met = buckets.groupBy("node").agg(F.sum("size").alias("met"))
    known = buckets.join(met, "node")
    pivots = known.groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("minus"))).alias("best"))
    pivots = pivots.select("key", (-F.col("best.minus")).alias("pivot"))
    stars = buckets.join(pivots, "key").where("node <> pivot")
    pairs = stars.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    search = _Search(texts, nodes, k, percent)
    pairs = stored(pairs, "pairs")
    links = search.linked(pairs).unionByName(alike)

    # Members of buckets that are not yet in one component.
    roots = components(links)
    placed = buckets.join(roots.withColumnRenamed("id", "node"), "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("root")
    )
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    apart = stored(placed.join(split.select("key"), "key", "left_semi").select("node", "root").distinct(), "apart")
    left = _apart_pairs(apart, search.sets_of(apart.select("node")), percent)
    tested = stored(left.join(pairs, ["a", "b"], "left_anti"), "cross")
    more = search.linked(tested)
    if more.limit(1).count():
        roots = components(links.unionByName(more))

    # A component is named by the smallest id in it.
    reached = smallest.join(roots.withColumnRenamed("id", "node"), "node", "left").select(
        "node", "id", F.coalesce("root", "node").alias("root")
    )
    first = reached.groupBy("root").agg(F.min("id").alias("first"))
    named = reached.join(first, "root").select("node", "first")
    known = signed.where("n > 0 AND id IS NOT NULL").select("id", "n", "node").join(named, "node")
    rest = signed.where("NOT (n > 0 AND id IS NOT NULL)").select("id", "n", F.col("id").alias("first"))
    found = known.select("id", "n", "first").unionByName(rest)
    return found.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.col("first").alias("component_id"),
        F.col("id").eqNullSafe(F.col("first")).alias("kept"),
    )
