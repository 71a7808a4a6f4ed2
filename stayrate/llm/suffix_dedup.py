"""Remove long byte strings that also start elsewhere, by sorting suffixes in shards.

Every LENGTH-byte window of a document has an anchor: of its GRAM-byte strings the one with the
smallest hash, the leftmost of equals. The windows of one anchor start next to each other, and
equal windows have equal anchors, so windows can only be equal within the group of an anchor's
hash. Windows whose anchor stands once in the corpus are out. The others go to shards by their
anchor, as contexts: the bytes that the windows of one anchor cover. Equal contexts are sent
once, with a mark. Each shard sorts its suffixes by external induction (``suffix_sort``), and
the windows with a common prefix of LENGTH with a neighbour are repeated. An anchor that stands in
so many different contexts that one shard could not hold them is not sorted: its windows are
hashed whole, 128 bits each, and counted by hash, which deals them out evenly.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions import lookup_join
from stayrate.llm import suffix_sort
from stayrate.llm.kernels import pieces, prefix_hashes, span_hashes, text_bytes
from stayrate.llm.native import stored

LENGTH, GRAM = suffix_sort.LIMIT, 24
#: Bytes of contexts that a shard should have; a frequent anchor may make it larger.
SHARD_BYTES = 6_000_000
#: Anchors with more bytes of contexts are hashed window by window and not sorted.
HEAVY_BYTES = SHARD_BYTES // 4
#: Anchors are chosen in pieces of about so many bytes of texts.
ANCHOR_PIECE = 1 << 18


def anchors(body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of all windows of the texts in ``body``.

    Returns per anchor its text, its hash, the hash of its context, and the first and the number
    of the windows it is the anchor of, counted from the text's start.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    sizes = np.diff(starts)
    if len(body) < LENGTH or sizes.max(initial=0) < LENGTH:
        return none
    sums = prefix_hashes(body)
    grams = np.arange(len(body) - GRAM + 1)
    hashes = span_hashes(sums, grams, grams + GRAM)
    # The same bits whatever the batch, so that equal windows choose alike.
    place = np.uint64((1 << 31) - 1)
    least = (hashes & ~place) | grams.astype(np.uint64)
    reach, width = 1, LENGTH - GRAM + 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))
    counts = np.bincount(text, minlength=len(sizes))
    windows = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[text]
    anchor = (least[windows] & place).astype(np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    number = np.diff(np.append(at, len(text)))
    first, owner = windows[at], text[at]
    context = span_hashes(sums, first, first + number + (LENGTH - 1))
    return owner, hashes[anchor[at]].view(np.int64), context.view(np.int64), first - starts[owner], number


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, starts = text_bytes(batch.column("text"))
        for a, b in pieces(starts, ANCHOR_PIECE):
            owner, gram, context, first, number = anchors(body[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
            rows = pa.array(owner + a)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(rows), batch.column("mark").take(rows), pa.array(gram), pa.array(context),
                    pa.array(first.astype(np.int32)), pa.array(number.astype(np.int32)),
                ],
                ["id", "mark", "gram", "context", "first", "number"],
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pack = zstandard.ZstdCompressor(level=3)
        body, starts = text_bytes(batch.column("text"))
        for a, b in pieces(starts):
            blobs = [pack.compress(body[starts[i] : starts[i + 1]]) for i in range(a, b)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")[a:b], batch.column("mark")[a:b], pa.array(blobs, pa.binary())], ["id", "mark", "packed"]
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["gram", "context", "number", "many", "heavy"]
    for batch in batches:
        unpack = zstandard.ZstdDecompressor()
        packed, (starts, wanted) = batch.column("packed"), _listed(batch.column("wanted"))
        first = wanted.field("first").to_numpy()
        end = first + wanted.field("number").to_numpy() + (LENGTH - 1)
        for a, b in pieces(starts, 20_000):
            bodies: list[bytes] = []
            for i in range(a, b):
                text, own = unpack.decompress(packed[i].as_py()), slice(starts[i], starts[i + 1])
                bodies += [text[x:y] for x, y in zip(first[own].tolist(), end[own].tolist())]
            some = wanted[starts[a] : starts[b]]
            yield pa.RecordBatch.from_arrays([*map(some.field, names), pa.array(bodies, pa.binary())], [*names, "body"])


def _listed(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Where each list of a column begins in all of their items, and these; null is empty."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), column.flatten()


def _hashed_windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All windows of the contexts of a batch, each with its hash."""
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        gram, context, offset, many, digest = (pa.array(c, t) for c, t in zip(zip(*rows), types))
        return pa.RecordBatch.from_arrays([gram, context, offset, pa.array([1] * len(rows), pa.int32()), many, digest], _FOUND)

    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    for x in batch.to_pylist():
        body = x["body"]
        for offset in range(x["number"]):
            digest = hashlib.blake2b(body[offset : offset + LENGTH], digest_size=16).digest()
            rows.append((x["gram"], x["context"], offset, x["many"], digest))
        if len(rows) > 50_000:
            yield made()
            rows = []
    if rows:
        yield made()


_FOUND = ["gram", "context", "offset", "run", "many", "digest"]


def _stretches(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` positions those in stretches that neither meet nor overlap."""
    turns = np.zeros(n, np.int8)
    turns[begin] = 1
    turns[end] = -1
    return np.cumsum(turns, dtype=np.int8, out=turns).view(bool)


def _sorted_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of a shard's contexts that are repeated, as stretches of starts; those of heavy
    anchors one by one, with their hashes and unjudged."""
    with tempfile.TemporaryDirectory() as folder:  # this task's queues; gone with it
        parts, grams, contexts, numbers, many, sizes = [], [], [], [], [], []
        n_bytes, path = 0, f"{folder}/text.bin"
        with open(path, "wb") as file:
            for batch in batches:
                if pc.any(batch.column("heavy")).as_py():
                    yield from _hashed_windows(batch.filter(batch.column("heavy")))
                    batch = batch.filter(pc.invert(batch.column("heavy")))
                if not batch.num_rows:
                    continue
                body, starts = text_bytes(batch.column("body"))
                size = np.diff(starts)
                ended = np.full(len(body) + len(size), suffix_sort.END, np.uint8)
                inside = np.ones(len(ended), bool)
                inside[np.cumsum(size + 1) - 1] = False
                ended[inside] = body
                ended.tofile(file)
                n_bytes += len(ended)
                for held, name in ((grams, "gram"), (contexts, "context"), (numbers, "number"), (many, "many")):
                    # a copy: a view would keep the whole batch
                    held.append(np.array(batch.column(name).to_numpy(zero_copy_only=False)))
                sizes.append(size + 1)
            np.full(suffix_sort.LIMIT + 8, suffix_sort.PAD, np.uint8).tofile(file)
        if not n_bytes:
            return
        padded = np.memmap(path, np.uint8, "r") if n_bytes > suffix_sort.IN_MEMORY else np.fromfile(path, np.uint8)
        repeated = suffix_sort.repeated_starts(padded, suffix_sort.Scratch(folder))
        begin = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))[:-1]
        end, often = begin + np.concatenate(numbers), np.concatenate(many)
        # Only windows count, and between the windows of two contexts there are other starts.
        hit = (repeated | _stretches(begin[often], end[often], n_bytes)) & _stretches(begin, end, n_bytes)
        at = np.flatnonzero(hit & np.append(True, ~hit[:-1]))
        run = np.flatnonzero(hit & np.append(~hit[1:], True)) + 1 - at
        owner = np.searchsorted(begin, at, "right") - 1
        offset = at - begin[owner]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(grams)[owner]), pa.array(np.concatenate(contexts)[owner]),
                pa.array(offset.astype(np.int32)), pa.array(run.astype(np.int32)),
                pa.nulls(len(at), pa.bool_()), pa.nulls(len(at), pa.binary()),
            ],
            _FOUND,
        )


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """Of hashed windows those that are repeated, as stretches of starts."""
    counted = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many"))
    # A window of a very common passage is a hash with very many rows.
    hit = lookup_join(windows, stored(counted.where("n > 1 OR many").select("digest"), "digests"), "digest", "left_semi")
    nr = F.row_number().over(W.partitionBy("gram", "context").orderBy("offset"))
    stretches = hit.withColumn("stretch", F.col("offset") - nr).groupBy("gram", "context", "stretch")
    made = stretches.agg(F.min("offset").alias("offset"), F.count(F.lit(1)).cast("int").alias("run"))
    return made.select("gram", "context", "offset", "run")


def _merged(starts: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of the spans of each text: where those of each begin, their first bytes and their ends."""
    # Texts one after the other, with room between them.
    room = int(end.max(initial=0)) + 1
    shift = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * room
    order = np.argsort(shift + first)
    first, end, shift = (shift + first)[order], (shift + end)[order], shift[order]
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(np.ones(min(1, len(first)), bool), first[1:] > reach[:-1]))
    last = np.append(new[1:], len(first))[: len(new)] - 1
    begins = np.searchsorted(first[new], np.arange(len(starts)) * room)
    return begins, first[new] - shift[new], reach[last] - shift[new]


def _cut(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unpack = zstandard.ZstdDecompressor()
            starts, spans = _listed(batch.column("spans"))
            bounds = (spans.field(name).to_numpy().astype(np.int64) for name in ("from", "to"))
            begins, first, end = _merged(starts, *bounds)
            sizes, digests, kept = [], [], []
            for i, packed in enumerate(batch.column("packed")):
                text, own = unpack.decompress(packed.as_py()), slice(begins[i], begins[i + 1])
                left = b"".join([text[x:y] for x, y in zip([0, *end[own].tolist()], [*first[own].tolist(), len(text)])])
                sizes.append((len(text), len(text) - len(left), begins[i + 1] - begins[i]))
                digests.append(hashlib.sha256(left).hexdigest())
                if keep:
                    kept.append(left)
            made = dict(zip(("n_bytes", "n_removed", "n_spans"), map(pa.array, np.array(sizes, np.int64).reshape(-1, 3).T)))
            made |= {"kept_sha256": pa.array(digests, pa.string())} | ({"kept": pa.array(kept, pa.binary())} if keep else {})
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made.values()], ["id", *made])

    return run


def remove_repeats(docs: DataFrame, keep: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null is empty. Bytes are removed if a LENGTH-byte string covers them
    that starts anywhere else too, in the same document or another, overlapping or not; strings
    do not cross documents and are judged on the input. ``n_spans`` counts the maximal removed
    runs. With ``keep`` the remaining bytes are returned as ``kept``. Rows that repeat an id and a
    text count as documents of their own, and a null id is an id like others; texts of one id are told
    apart by 128 bits of their hash. Ids are whole
    numbers. Empty tables give an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    plain = docs.select(
        F.col(id_column).cast("long").alias("id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("mark"), text.alias("text")
    )
    runs = stored(
        plain.mapInArrow(_anchor_rows, "id long, mark binary, gram long, context long, first int, number int"), "anchors"
    )
    # Stored, so that the join reads rows alone and Spark can split those of a hot anchor.
    often = stored(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "often")
    # Nor broadcast: Spark goes by the packed size of a file, of which the driver would hold many times as much.
    shared = stored(runs.join(often.hint("merge"), "gram", "left_semi"), "shared")
    # Of equal contexts one is sorted.
    alike = shared.groupBy("gram", "context", "number").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.coalesce("id", F.lit(0)), "id", "mark", "first")).alias("at")
    )
    sent = stored(
        alike.select("gram", "context", "number", (F.col("n") > 1).alias("many"), "at.id", "at.mark", "at.first"), "sent"
    )
    weight = F.sum(F.col("number") + LENGTH)
    size = sent.agg(weight.alias("bytes")).first()["bytes"] or 0
    # No more of them than bytes of contexts / HEAVY_BYTES.
    heavy = stored(sent.groupBy("gram").agg(weight.alias("bytes")).where(F.col("bytes") > HEAVY_BYTES).select("gram"), "heavy")
    marked = sent.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "gram", "left").fillna(False, ["heavy"])
    wanted = marked.groupBy("id", "mark").agg(
        F.collect_list(F.struct("gram", "context", "number", "many", "heavy", "first")).alias("wanted")
    )
    packed = stored(plain.mapInArrow(_packed, "id long, mark binary, packed binary"), "packed", compression="none")
    same = lambda other: F.col("id").eqNullSafe(F.col(f"{other}_id")) & (F.col("mark") == F.col(f"{other}_mark"))
    named = lambda df, other: df.withColumnsRenamed({"id": f"{other}_id", "mark": f"{other}_mark"})
    bodies = packed.join(named(wanted, "w"), same("w")).mapInArrow(
        _contexts, "gram long, context long, number int, many boolean, heavy boolean, body binary"
    )
    # Windows of heavy anchors are counted after this and may go anywhere.
    route = F.when(F.col("heavy"), F.xxhash64("gram", "context")).otherwise(F.col("gram"))
    sharded = bodies.withColumn("route", route).repartition(max(1, size // SHARD_BYTES), "route").drop("route")
    judged = stored(
        sharded.mapInArrow(_sorted_shard, "gram long, context long, offset int, run int, many boolean, digest binary"), "found"
    )
    found = judged.where("digest IS NULL").select("gram", "context", "offset", "run")
    if heavy.limit(1).count():
        found = found.unionByName(_repeated_windows(judged.where("digest IS NOT NULL")))
    placed = shared.hint("merge").join(found.hint("merge"), ["gram", "context"]).select(
        "id", "mark", (F.col("first") + F.col("offset")).alias("from"),
        (F.col("first") + F.col("offset") + F.col("run") + (LENGTH - 1)).alias("to"),
    )
    spans = placed.distinct().groupBy("id", "mark").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    made = packed.join(named(spans, "s"), same("s"), "left").mapInArrow(_cut(keep), schema)
    return made.withColumnRenamed("id", id_column)
