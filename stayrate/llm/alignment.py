"""Alignment of two tokenizers over the bytes of the same texts.

Tokenizer A is a byte-level BPE, B a SentencePiece BPE; both read a space and the text. Byte
offsets where tokens of both end cut a text into groups; tokens whose bytes overlap are linked.

One pass aligns all documents and keeps, per task, how many links hold each (A id, B id), and per
piece of a batch its alignment: the different cells and the order in which texts hold them. The
different pairs get indices from a minimal perfect hash per bucket of pairs, so counts are dense
vectors, which are summed in a tree. A second pass reads the alignments, not the texts, and looks
the counts of their pairs up, by index, with the key that stands there as proof.

Texts are cut into cells where words of A and chunks of B both end, which nothing crosses; equal
cells of a batch are aligned once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.kernels import mixed, pieces, text_bytes
from stayrate.llm.minimal_hash import MinimalHash, build
from stayrate.llm.native import stored
from stayrate.llm.piece_codec import MARK, Codec, codec, encoded_spans, ragged

#: Pairs are hashed in so many buckets. 50,257 x 32,000 pairs bound a bucket by 6.3 million.
BUCKETS = 256
#: So many dense vectors are summed in one task.
FAN_IN = 256
#: Counts of so many pairs (16 bytes each) are sent to tasks at a time; more take more passes.
SENT_PAIRS = 4_000_000
#: A worker forgets its cells, and reports its counts, beyond so many cells or pairs.
KEPT_CELLS = 500_000
#: Texts are aligned, and their alignments stored, in pieces of about so many bytes.
PIECE_BYTES = 1 << 20
#: Pieces are few and long rows: a row group ends at 8 MB, and its size is looked at after every row.
_STORED = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
_A_BITS = 32
_LETTER, _DIGIT, _OTHER, _SPACE = 1, 2, 3, 4  # in the order of the probes in kinds()
#: The endings that the words of A split off, each a word by itself.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_aligners: dict[int, Aligner] = {}
_known: dict[str, Known] = {}


class Cells(NamedTuple):
    """Alignments of cells, by their number: sizes, the ids of their groups, and their links one after the other."""

    facts: np.ndarray  # tokens of A and of B, groups, links: 4 x cells
    groups: pa.Array
    links: np.ndarray  # the numbers of their pairs

    @property
    def begins(self) -> np.ndarray:
        return np.cumsum(self.facts[3]) - self.facts[3]

    def and_also(self, more: Cells) -> Cells:
        both = zip(self, more, strict=True)
        return Cells(*(pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x, axis=-1) for x in both))


_NO_CELLS = Cells(np.zeros((4, 0), np.int64), pa.array([], pa.string()), np.zeros(0, np.int32))


class Aligner:
    """Both tokenizers, with the cells that a worker knows."""

    def __init__(self, byte_model: bytes, piece_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task per core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_model.decode())
        self.a.encode_special_tokens = True
        if self.a.normalizer is not None or "ByteLevel" not in repr(self.a.pre_tokenizer):
            raise ValueError("not a byte-level BPE that leaves texts as they are")
        self.b, self.b_library = codec(piece_model), SentencePieceProcessor(model_proto=piece_model)
        n_a = self.a.get_vocab_size(with_added_tokens=True)
        self.a_lengths = np.array([len(self.a.id_to_token(i) or "") for i in range(n_a)])  # a letter stands for a byte
        self.n_ids = max(n_a, len(self.b.pieces))
        self.shown = pa.array([f"{i}{end}" for end in ",|;" for i in range(self.n_ids)] + list(map(str, range(self.n_ids))), pa.string())
        self.kind = np.zeros(0x110000, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.cells = _NO_CELLS
        self.pairs = self.sorted_pairs = np.zeros(0, np.uint64)  # by number, and in order with their numbers
        self.numbers = np.zeros(0, np.int32)

    def numbered(self, links: np.ndarray) -> np.ndarray:
        """The numbers of the pairs that ``links`` hold; new pairs get the next ones."""
        different, place = np.unique(links, return_inverse=True)
        at = np.searchsorted(self.sorted_pairs, different)
        known = np.zeros(len(different), bool)
        inside = at < len(self.sorted_pairs)
        known[inside] = self.sorted_pairs[at[inside]] == different[inside]
        new = different[~known]
        number = np.empty(len(different), np.int32)
        number[known] = self.numbers[at[known]]
        number[~known] = len(self.pairs) + np.arange(len(new))
        self.pairs = np.concatenate((self.pairs, new))
        self.sorted_pairs = np.insert(self.sorted_pairs, at[~known], new)
        self.numbers = np.insert(self.numbers, at[~known], number[~known])
        return number[place]

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """What A takes each code point for; new ones are asked from its own splitter."""
        found = self.kind[points]
        if not found.all():
            new = np.unique(points[found == 0])
            split = self.a.pre_tokenizer.pre_tokenize_str
            for point in new.tolist():
                c = chr(point)
                one = [len(split(f"{x}{c}{x}")) == 1 for x in "a1!"]
                # a space joins letters that follow it, other white space stands alone
                self.kind[point] = _SPACE if not any(one) else 1 + one.index(True)
            found = self.kind[points]
        return found

    def word_starts(self, points: np.ndarray, opening: np.ndarray) -> np.ndarray:
        """Where words of A begin; spaces are marks in ``points`` and texts begin at ``opening``."""
        blank = points == ord(MARK)
        kind = self.kinds(np.where(blank, np.uint32(0x20), points))
        n = len(points)
        first, last = np.zeros(n, bool), np.zeros(n, bool)  # of a text
        edges = np.unique(opening)
        first[edges[edges < n]] = True
        last[:-1] = first[1:]
        if n:
            last[-1] = True
        space = kind == _SPACE
        before = np.concatenate((np.zeros(1, kind.dtype), kind[:-1]))
        before[first] = 0
        blank_before = np.concatenate((np.zeros(1, bool), blank[:-1])) & ~first
        space_after = np.concatenate((space[1:], np.zeros(1, bool))) & ~last
        start = (kind != before) & ~(blank_before & ~space)
        # the last white space of a run stands alone, or before a word, unless the text ends there
        start |= space & ~last & ~space_after
        for ending in _ENDINGS:
            size = len(ending)
            if n <= size:
                continue
            here = (points[: n - size] == ord("'")) & ~blank_before[: n - size] & (before[: n - size] != _OTHER)
            for k, letter in enumerate(ending, 1):
                here &= (points[k : n - size + k] == ord(letter)) & ~first[k : n - size + k]
            at = np.flatnonzero(here)
            start[at + 1] = False
            after = at + size + 1
            start[after[after < n]] = True
        start |= first
        return start

    def align(self, keys: list[str]) -> Cells:
        """Align cells, given as their words of A with a space between; what they hold lies on one axis of bytes."""
        words = [key.split(" ") for key in keys]
        flat = [w.replace(MARK, " ") for found in words for w in found]
        per_word = [e.ids for e in self.a.encode_batch_fast(flat, add_special_tokens=False)]
        # a line feed is in no longer piece, so the ids after it are those of the cell itself
        lines = ["\n" + key.replace(" ", "").replace(MARK, " ") for key in keys]
        per_cell = [ids[2:] for ids in self.b_library.encode(lines, num_threads=1)]
        a_ids = np.fromiter(chain.from_iterable(per_word), np.int64)
        b_ids = np.fromiter(chain.from_iterable(per_cell), np.int64)
        a_ends, b_ends = np.cumsum(self.a_lengths[a_ids]), np.cumsum(self.b.lengths[b_ids])
        word_ends = np.cumsum([len(ids) for ids in per_word])[np.cumsum([len(w) for w in words]) - 1]
        cell_ends = a_ends[word_ends - 1]
        if not np.array_equal(cell_ends, b_ends[np.cumsum([len(ids) for ids in per_cell]) - 1]):
            raise AssertionError("tokens of a cell do not cover the same bytes")
        a_cell, b_cell = np.searchsorted(cell_ends, a_ends), np.searchsorted(cell_ends, b_ends)
        # between neighbouring ends of tokens lies what one token of A and one of B share
        ends = np.union1d(a_ends, b_ends)
        links = (a_ids[np.searchsorted(a_ends, ends)] << _A_BITS) | b_ids[np.searchsorted(b_ends, ends)]
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        n = len(keys)
        facts = np.stack([np.bincount(np.searchsorted(cell_ends, e), minlength=n) for e in (a_ends, b_ends, common, ends)])
        # groups in order, each with its ids of A and then of B, which also end it
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        a_closes, b_closes = np.isin(a_ends, common), np.isin(b_ends, common)
        b_last = np.isin(b_ends, cell_ends)
        a_shown = a_ids + self.n_ids * np.where(a_closes, 1, 0)
        b_shown = b_ids + self.n_ids * np.where(b_last, 3, np.where(b_closes, 2, 0))
        order = np.argsort(np.concatenate((2 * a_group, 2 * b_group + 1)), kind="stable")
        shown = self.shown.take(pa.array(np.concatenate((a_shown, b_shown))[order]))
        sizes = np.concatenate(([0], np.cumsum(np.bincount(a_cell, minlength=n) + np.bincount(b_cell, minlength=n))))
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), shown), "")
        return Cells(facts, groups, self.numbered(links.view(np.uint64)))

    def cut(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[str], np.ndarray]]:
        """Ranges of texts with the number of each cell, the different cells, and where each text's begin.

        Null texts have no cells, nor have those that hold the mark: B takes it for a space.
        """
        body, starts = text_bytes(texts)
        marked_texts = pc.match_substring(texts, MARK).fill_null(False).to_numpy(zero_copy_only=False)
        for a, b in pieces(starts, PIECE_BYTES):
            points, edges, first = self.b.chunks_of(body[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
            if not len(points):
                yield a, b, np.zeros(0, np.int64), [], first * 0
                continue
            opening = edges[first]
            word = np.append(self.word_starts(points, opening), True)
            chunk = np.zeros(len(points) + 1, bool)
            chunk[edges] = True
            inner, cells = np.flatnonzero(word & ~chunk), np.flatnonzero(word & chunk)
            marked = np.insert(points, inner, 0x20)
            codes, different = encoded_spans(marked, cells + np.searchsorted(inner, cells))
            first = np.searchsorted(cells, opening)
            if marked_texts[a:b].any():
                sizes = np.where(marked_texts[a:b], 0, np.diff(first))
                used, codes = np.unique(codes[np.repeat(~marked_texts[a:b], np.diff(first))], return_inverse=True)
                different, first = [different[i] for i in used.tolist()], np.concatenate(([0], np.cumsum(sizes)))
            yield a, b, codes, different, first

    def known(self, keys: list[str]) -> np.ndarray:
        """The numbers in ``cells`` of the different ``keys``; unknown cells are aligned and kept."""
        if len(self.rows) > KEPT_CELLS or len(self.cells.links) > 8 * KEPT_CELLS:
            self.forget()
        found = np.fromiter(map(self.rows.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [keys[i] for i in missing.tolist()]
            found[missing] = np.arange(len(self.rows), len(self.rows) + len(new))
            self.rows.update(zip(new, found[missing].tolist(), strict=True))
            self.cells = self.cells.and_also(self.align(new))
        return found

    def piece(self, codes: np.ndarray, different: list[str], first: np.ndarray) -> Piece:
        """The alignment of some texts, which ``cut`` gave, and how many links hold each of its pairs."""
        rows = self.known(different)
        cells = self.cells
        sizes = cells.facts[3][rows]
        links = ragged(cells.links, cells.begins[rows], sizes)
        n_links = np.zeros(len(self.pairs), np.int64)
        n_links += np.bincount(links, np.repeat(np.bincount(codes, minlength=len(rows)), sizes), len(n_links)).astype(np.int64)
        used = np.flatnonzero(n_links)
        local = np.zeros(len(n_links), np.int32)
        local[used] = np.arange(len(used))
        running = np.zeros((4, len(codes) + 1), np.int64)
        np.cumsum(cells.facts[:, rows][:, codes], axis=1, out=running[:, 1:])
        facts = running[:, first[1:]] - running[:, first[:-1]]
        return Piece(first, codes, sizes, local[links], self.pairs[used], n_links[used], facts.ravel(), cells.groups.take(pa.array(rows)))


class Piece(NamedTuple):
    """The alignment of some texts by itself: their cells, and what the different cells hold."""

    first: np.ndarray  # where the cells of each text begin, and the end
    codes: np.ndarray  # the cells of all texts
    sizes: np.ndarray  # the links of each different cell
    links: np.ndarray  # the pairs of these links
    pairs: np.ndarray
    n_links: np.ndarray  # how many links hold each pair
    facts: np.ndarray  # tokens of A and of B, groups, links: 4 x texts
    groups: pa.Array  # of each different cell

    def packed(self) -> bytes:
        columns = []
        for values in self:
            if isinstance(values, np.ndarray):
                small = np.min_scalar_type(values.max(initial=0))
                values = pa.array(values.astype(small) if small.itemsize < values.itemsize else values)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays(columns, list(self._fields))
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpacked(cls, body: pa.Buffer) -> Piece:
        columns = [column.flatten() for column in pa.ipc.open_stream(body).read_next_batch().columns]
        return cls(*(c.to_numpy() if pa.types.is_integer(c.type) else c for c in columns))


def aligner(byte_model: bytes, piece_model: bytes) -> Aligner:
    """Both tokenizers, made once in a worker."""
    key = hash((byte_model, piece_model))
    if key not in _aligners:
        _aligners[key] = Aligner(byte_model, piece_model)
    return _aligners[key]


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys + np.uint64(11)) >> np.uint64(56)).astype(np.int64) % BUCKETS


class Counts:
    """Links per pair, added up over batches."""

    def __init__(self):
        self.keys, self.sizes, self.n = [], [], 0

    def add(self, keys: np.ndarray, sizes: np.ndarray) -> None:
        self.keys.append(keys)
        self.sizes.append(sizes)
        self.n += len(keys)
        if self.n > 4 * KEPT_CELLS:
            self.merge()

    def merge(self) -> None:
        keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, np.concatenate(self.sizes))
        self.keys, self.sizes, self.n = [keys], [total], len(keys)

    def rows(self, part: int) -> pa.RecordBatch:
        self.merge()
        keys, sizes = self.keys[0], self.sizes[0]
        bucket = bucket_of(keys)
        order = np.argsort(bucket, kind="stable")
        there, first = np.unique(bucket[order], return_index=True)
        ends = pa.array(np.append(first, len(keys)).astype(np.int32))
        columns = [pa.array(np.full(len(there), part, np.int64)), pa.array(there)]
        columns += [pa.ListArray.from_arrays(ends, pa.array(x[order].view(np.int64))) for x in (keys, sizes)]
        return pa.RecordBatch.from_arrays(columns, ["part", "bucket", "keys", "counts"])


_PAIRS = "part long, bucket long, keys array<long>, counts array<long>"


def _aligned(shipped):
    """The alignments of all pieces, and apart from them the counts of their pairs."""
    kinds = {"part": pa.int64(), "bucket": pa.int64(), "keys": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}

    def rows(made: pa.RecordBatch, ids: pa.Array) -> pa.RecordBatch:
        all_kinds = kinds | {"ids": pa.list_(ids.type), "piece": pa.binary()}
        own = dict(zip(made.schema.names, made.columns, strict=True))
        columns = [own.get(name, pa.nulls(made.num_rows, kind)) for name, kind in all_kinds.items()]
        return pa.RecordBatch.from_arrays(columns, list(all_kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = aligner(*shipped.value)
        counts, flushes, part = Counts(), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column(0)
            for a, b, *found in ours.cut(batch.column(1)):
                piece = ours.piece(*found)
                own = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids.slice(a, b - a))
                yield rows(pa.RecordBatch.from_arrays([own, pa.array([piece.packed()], pa.binary())], ["ids", "piece"]), ids)
                counts.add(piece.pairs, piece.n_links)
                if counts.n > 4 * KEPT_CELLS:
                    yield rows(counts.rows(part + (flushes << 32)), ids)
                    counts, flushes = Counts(), flushes + 1
        if counts.n:
            yield rows(counts.rows(part + (flushes << 32)), ids)

    return run


def _hashed(table: pa.Table) -> pa.Table:
    keys = table.column("key").to_numpy().view(np.uint64)
    levels = build(keys)
    placed = np.empty(len(keys), np.int64)
    placed[MinimalHash(levels).index(keys)] = keys.view(np.int64)
    row = {"bucket": [table.column("bucket")[0].as_py()], "levels": [levels], "keys": [placed.tobytes()]}
    return pa.table(row, pa.schema([("bucket", pa.int64()), ("levels", pa.list_(pa.binary())), ("keys", pa.binary())]))


_VECTOR = pa.schema([("bucket", pa.int64()), ("lot", pa.int64()), ("counts", pa.binary())])


def _filled(counted: pa.Table, hashes: pa.Table) -> pa.Table:
    """The dense counts of one lot of tasks in one bucket."""
    if not counted.num_rows:
        return _VECTOR.empty_table()
    hashed = MinimalHash(hashes.column("levels")[0].as_py())
    dense = np.zeros(hashed.n, np.int64)
    for keys, counts in zip(counted.column("keys"), counted.column("counts"), strict=True):
        found = hashed.index(keys.values.to_numpy().view(np.uint64))
        dense[found] += counts.values.to_numpy()  # the keys of a row differ
    row = [[counted.column(c)[0].as_py()] for c in ("bucket", "lot")]
    return pa.table([*row, [dense.tobytes()]], schema=_VECTOR)


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_buffer(), np.int64) for v in table.column("counts"))
    row = [[table.column(c)[0].as_py()] for c in ("bucket", "lot")]
    return pa.table([*row, [total.tobytes()]], schema=_VECTOR)


def _shipped(docs: DataFrame, byte_path: str, piece_path: str):
    with open(byte_path, "rb") as a, open(piece_path, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))  # vocabularies, not data


def pair_counts(counted: DataFrame) -> DataFrame:
    """Per bucket the ``levels`` of its hash, and by index its ``keys`` and ``counts`` (64-bit numbers)."""
    keys = counted.select("bucket", F.explode("keys").alias("key")).distinct()
    hashes = stored(
        keys.groupBy("bucket").applyInArrow(_hashed, "bucket long, levels array<binary>, keys binary"), "hashes"
    )
    lots = -(-counted.select("part").distinct().count() // FAN_IN)
    spread = counted.withColumn("lot", F.pmod(F.xxhash64("part"), F.lit(max(lots, 1))))
    copies = hashes.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(lots, 1) - 1).cast("long"))))
    fields = "bucket long, lot long, counts binary"
    sums = spread.groupBy("bucket", "lot").cogroup(copies.groupBy("bucket", "lot")).applyInArrow(_filled, fields)
    while lots > 1:
        sums = sums.withColumn("lot", F.floor(F.col("lot") / FAN_IN)).groupBy("bucket", "lot").applyInArrow(_summed, fields)
        lots = -(-lots // FAN_IN)
    return stored(hashes.join(sums.drop("lot"), "bucket"), "counts")


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most: dict[int, int] = {}
    for batch in batches:
        for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
            b_ids = np.frombuffer(keys.as_buffer(), np.int64) & ((1 << _A_BITS) - 1)
            n = np.frombuffer(counts.as_buffer(), np.int64)
            highest = np.zeros(int(b_ids.max()) + 1, np.int64)
            np.maximum.at(highest, b_ids, n)
            for i in np.flatnonzero(highest).tolist():
                most[i] = max(most.get(i, 0), int(highest[i]))
    yield pa.RecordBatch.from_arrays([pa.array(most.keys(), pa.int64()), pa.array(most.values(), pa.int64())], ["b", "n"])


class Known:
    """Counts of the pairs of some buckets, and the highest count of every B id."""

    def __init__(self, rows: list[tuple[int, list[bytes], bytes, bytes]], most: dict[int, int]):
        self.buckets = {
            bucket: (MinimalHash(levels), np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64))
            for bucket, levels, keys, counts in rows
        }
        self.most = np.zeros(max(most, default=0) + 1, np.int64)
        self.most[list(most)] = list(most.values())

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of every pair; 0 if another block has it."""
        found = np.zeros(len(keys), np.int64)
        bucket = bucket_of(keys)
        order = np.argsort(bucket, kind="stable")
        there, first = np.unique(bucket[order], return_index=True)
        for b, rows in zip(there.tolist(), np.split(order, first[1:]), strict=True):
            if b in self.buckets:
                hashed, own, counts = self.buckets[b]
                index = hashed.index(keys[rows])
                index[index >= 0] = np.where(own[index[index >= 0]] == keys[rows][index >= 0], index[index >= 0], -1)
                found[rows[index >= 0]] = counts[index[index >= 0]]
        return found

    def sums(self, piece: Piece) -> np.ndarray:
        """Per text how many links have the highest count of their B id, and the sum of counts."""
        if not len(piece.codes):
            return np.zeros((2, len(piece.first) - 1), np.int64)
        counts = self.counts(piece.pairs)
        b_ids = (piece.pairs & np.uint64((1 << _A_BITS) - 1)).astype(np.int64)
        best = ((counts > 0) & (counts == self.most[b_ids])).astype(np.int64)
        sizes = piece.sizes.astype(np.int64)
        running = np.zeros((2, len(piece.codes) + 1), np.int64)
        for of_texts, of_pairs in zip(running, (best, counts), strict=True):
            of_cells = np.add.reduceat(of_pairs[piece.links], np.cumsum(sizes) - sizes)
            np.cumsum(of_cells[piece.codes], out=of_texts[1:])
        first = piece.first.astype(np.int64)
        return running[:, first[1:]] - running[:, first[:-1]]


_FACTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _looked_up(block, last: bool):
    """Add what this block of counts has to the sums of every piece; the last block gives the rows of its texts."""

    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _known:  # a worker keeps one block, and needs no cells now
            for other in _aligners.values():
                other.forget()
            _known.clear()
            _known[token] = Known(*block.value)
        known = _known[token]
        for batch in batches:
            for i in range(batch.num_rows):
                piece = Piece.unpacked(batch.column(1)[i].as_buffer())
                before = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
                sums = known.sums(piece)
                sums += before.reshape(2, -1) if len(before) else 0
                if not last:
                    own = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([sums.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(own, ["ids", "piece", "sums"])
                    continue
                each = piece.groups.take(pa.array(piece.codes))
                groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(piece.first.astype(np.int32)), each), ";")
                facts = [*piece.facts.astype(np.int64).reshape(4, -1), *sums]
                ids = batch.column(0).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, groups.cast(pa.string()), *map(pa.array, facts)], ["id", "groups", *_FACTS])

    return run


def align(docs: DataFrame, byte_path: str, piece_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id, ``groups`` (as in ``a1,a2|b1;a3|b2,b3``), and of its tokens and links: ``n_a``,
    ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is the most frequent one of its B
    id, ties included) and ``count_sum`` (of the counts of its links).

    ``byte_path`` is a byte-level BPE for the tokenizers library, ``piece_path`` a SentencePiece
    BPE; the driver reads both. Texts that are null or empty, or that hold the mark which B takes
    for a space, have zeros and an empty string. Repeated rows count each; null ids stay; other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    shipped = _shipped(docs, byte_path, piece_path)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    aligned = stored(
        rows.mapInArrow(_aligned(shipped), f"{_PAIRS}, ids array<{id_type}>, piece binary"), "alignments", **_STORED
    )
    counts = pair_counts(aligned.where("part IS NOT NULL").select("part", "bucket", "keys", "counts"))
    most = {r["b"]: r["n"] for r in counts.select("keys", "counts").mapInArrow(_best, "b long, n long").groupBy("b").agg(F.max("n").alias("n")).collect()}
    sizes = counts.select("bucket", (F.octet_length("keys") / 8).cast("long").alias("n")).orderBy("bucket").collect()
    blocks: list[list[int]] = [[]]
    room = SENT_PAIRS
    for row in sizes:
        if row["n"] > room and blocks[-1]:
            blocks.append([])
            room = SENT_PAIRS
        blocks[-1].append(row["bucket"])
        room -= row["n"]
    found = aligned.where("part IS NULL").select("ids", "piece", F.lit(b"").alias("sums"))
    for i, block in enumerate(blocks):
        rows = counts.where(F.col("bucket").isin(block)).collect() if block else []
        sent = docs.sparkSession.sparkContext.broadcast(
            ([(r["bucket"], [bytes(x) for x in r["levels"]], bytes(r["keys"]), bytes(r["counts"])) for r in rows], most)
        )
        last = i == len(blocks) - 1
        fields = f"id {id_type}, groups string, " + ", ".join(f"{c} long" for c in _FACTS)
        found = found.mapInArrow(_looked_up(sent, last), fields if last else f"ids array<{id_type}>, piece binary, sums binary")
    return found.select(F.col("id").alias(id_column), *_FACTS, "groups")
