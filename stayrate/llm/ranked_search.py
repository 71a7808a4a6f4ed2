"""Ranked lexical search without random access (NRA).

A document's score for an item is a sum over the item's terms, so every term has a list of
(document, impact), read from the highest impact down. Lists are cut into blocks by impact, and a
round reads one more block of all lists. What has been read of a document is the lower end of its
score; with the next impact of every list that it was not met in yet, it is the upper end.

An item stays open while a document that was not met could still reach the k-th best lower end.
When it closes, documents whose upper end is below that go, and its lists are read on to their ends
for the few that remain. Then both ends agree: members, ties and scores are settled.

Lists are stored per shard of documents, each block in a column of its own, so a round reads the
columns up to its block, and all that is read of a document is in one task. Only the k best lower
ends of every shard and item are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.llm.kernels import _LOWER, _WORD, pieces, prefix_hashes, span_hashes, text_bytes, word_spans
from stayrate.llm.native import ascii_lower, stored
from stayrate.llm.piece_codec import ragged

#: Fixed value: what a term is.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: The first block of a list has so many documents for each that is asked for, later ones so many times more.
DEPTH, GROWTH, MOST_BLOCKS = 20, 4, 20
#: Impacts are cut into blocks between so many levels.
LEVELS = 1000
#: Items are searched in blocks of about so many terms, which are sent to all tasks.
TERMS_AT_A_TIME = 100_000
#: The k-th best lower end is taken from so many steps of an item's highest score.
STEPS = 4096
#: A shard has so many documents at most, and a task adds up so many items at a time.
SHARD_DOCS, ITEMS_AT_A_TIME = 4096, 256
_POSTING = np.dtype([("doc", np.int32), ("term", np.int32), ("part", np.int32)])


class Shard(NamedTuple):
    """Documents in order, with the vocabulary's terms that each has and how often."""

    ids: pa.Array
    sizes: np.ndarray
    n_terms: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    def row(self, number: int) -> pa.RecordBatch:
        own = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in self[1:]]
        ids = pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), self.ids)
        totals = [number, int((self.sizes > 0).sum()), int(self.sizes.sum())]
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in totals), ids, *own], _SHARD)


_SHARD = ["shard", "docs", "words", "ids", "sizes", "n_terms", "terms", "times"]


def _shards(vocabulary):
    """Count the vocabulary's terms in every text, in shards of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = vocabulary.value
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        own = np.frombuffer(b"".join(words), np.uint8)
        begins = np.concatenate(([0], ends))[:-1]
        hashes = span_hashes(prefix_hashes(own), begins, ends)
        order = np.argsort(hashes)
        hashes, begins, sizes = hashes[order], begins[order], (ends - begins)[order]
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_DOCS):
                part = batch.slice(at, SHARD_DOCS)
                body, starts = text_bytes(part.column("text"))
                found = []
                for a, b in pieces(starts):
                    low = _LOWER[body[starts[a] : starts[b]]]
                    first, last, text = word_spans(low, starts[a : b + 1] - starts[a], _WORD)
                    spans = span_hashes(prefix_hashes(low), first, last)
                    place = np.minimum(np.searchsorted(hashes, spans), len(hashes) - 1)
                    hit = np.flatnonzero((hashes[place] == spans) & (sizes[place] == last - first))
                    place = place[hit]
                    if len(hit):  # equal hashes are not trusted
                        same = ragged(low, first[hit], sizes[place]) == ragged(own, begins[place], sizes[place])
                        good = np.logical_and.reduceat(same, np.cumsum(sizes[place]) - sizes[place])
                        hit, place = hit[good], place[good]
                    both, times = np.unique(text[hit] * len(words) + order[place], return_counts=True)
                    counts = np.bincount(both // len(words), minlength=b - a)
                    found.append((np.bincount(text, minlength=b - a), counts, both % len(words), times))
                if found:
                    yield Shard(part.column("id"), *map(np.concatenate, zip(*found, strict=True))).row(number)
                    number += 1

    return run


def _postings(batch: pa.RecordBatch, i: int, docs: int, words: int) -> np.ndarray:
    """Per document and term of a shard the saturated count, which the term's weight multiplies."""
    sizes, n_terms, terms, times = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in _SHARD[4:])
    found = np.empty(len(terms), _POSTING)
    found["doc"], found["term"] = np.repeat(np.arange(len(sizes)), n_terms), terms
    # 64-bit integers, rounding down
    length = 100 - 50 + (50 * sizes * docs) // max(words, 1)
    found["part"] = (1000000000 * times) // (1000 * times + 20 * length[found["doc"]])
    return found


def _levels(docs: int, words: int):
    """Per term and level of impact: postings, and the highest impact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _postings(batch, i, docs, words)
                level = found["part"] // (1000000 // LEVELS)
                both, place, n = np.unique(found["term"].astype(np.int64) * (LEVELS + 1) + level, return_inverse=True, return_counts=True)
                top = np.zeros(len(both), np.int64)
                np.maximum.at(top, place, found["part"])
                columns = [both // (LEVELS + 1), both % (LEVELS + 1), n, top]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["term", "level", "n", "top"])

    return run


class Lists(NamedTuple):
    """Per term its weight, and per block the lowest level (one above all if it has none) and the highest impact."""

    weight: np.ndarray
    low: np.ndarray
    top: np.ndarray

    @property
    def n_blocks(self) -> int:
        return self.low.shape[1]

    def ahead(self, block: int) -> np.ndarray:
        """Per term the highest impact beyond ``block``."""
        rest = self.top[:, block + 1 :]
        return rest.max(axis=1) if rest.shape[1] else np.zeros(len(self.top), np.int64)


def _lists(shards: DataFrame, n_words: int, docs: int, words: int, k: int) -> Lists:
    """Cut every list into blocks between levels of impact."""
    fields = "term long, level long, n long, top long"
    levels = shards.mapInArrow(_levels(docs, words), fields).groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    above = W.partitionBy("term").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, -1)
    read = F.coalesce(F.sum("n").over(above), F.lit(0))
    block = sum((F.when(read >= DEPTH * k * GROWTH**i, 1).otherwise(0) for i in range(MOST_BLOCKS)), F.lit(0))
    frequency = F.sum("n").over(W.partitionBy("term"))
    weight = F.floor(1000 * F.log((2 * F.lit(docs).cast("double") + 2) / (2 * frequency.cast("double") + 1)))
    cut = levels.select("term", "level", "top", block.alias("block"), weight.alias("weight"))
    cut = cut.groupBy("term", "block").agg(F.min("level").alias("low"), F.max("top").alias("top"), F.first("weight").alias("weight"))
    found = cut.toPandas()  # bounded: the blocks of the terms of one block of items
    n_blocks = int(found["block"].max()) + 1 if len(found) else 1
    weight, term, at = np.zeros(n_words, np.int64), found["term"].to_numpy(), found["block"].to_numpy()
    low, top = np.full((n_words, n_blocks), LEVELS + 1, np.int64), np.zeros((n_words, n_blocks), np.int64)
    weight[term] = found["weight"].to_numpy()
    low[term, at], top[term, at] = found["low"].to_numpy(), found["top"].to_numpy() * weight[term]
    return Lists(weight, low, top)


def _by_block(docs: int, words: int, low):
    """The lists of a shard, each block in a column of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = np.minimum.accumulate(low.value, axis=1)
        for batch in batches:
            for i in range(batch.num_rows):
                found = _postings(batch, i, docs, words)
                level = found["part"] // (1000000 // LEVELS)
                block = (level[:, None] < lowest[found["term"]]).sum(axis=1)
                found = found[np.lexsort((-found["part"], found["term"], block))]
                ends = np.cumsum(np.bincount(block, minlength=lowest.shape[1]))
                own = [pa.array([x.tobytes()], pa.binary()) for x in np.split(found, ends[:-1])]
                names = ["ids", *(f"block{b}" for b in range(lowest.shape[1]))]
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1), *own], names)

    return run


class Asked(NamedTuple):
    """Items by number: their terms (item after item), and where each item's begin."""

    terms: np.ndarray
    begins: np.ndarray

    @property
    def n(self) -> int:
        return len(self.begins) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per item the sum of what ``values`` has for its terms."""
        running = np.concatenate(([0], np.cumsum(values[self.terms])))
        return running[self.begins[1:]] - running[self.begins[:-1]]

    def holders(self, chosen: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Per term the ``chosen`` items that have it, by their place in ``chosen``, and where each term's begin."""
        sizes = np.diff(self.begins)[chosen]
        own = ragged(self.terms, self.begins[:-1][chosen], sizes)
        order = np.argsort(own, kind="stable")
        items = np.repeat(np.arange(len(chosen)), sizes)[order]
        return items, np.searchsorted(own[order], np.arange(n_words + 1))


def interval_ends(found: np.ndarray, n_docs: int, asked: Asked, chosen: np.ndarray, weight: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``chosen`` items x documents: the sum of impacts read, and of what is ahead in the lists read from."""
    items, first = asked.holders(chosen, len(weight))
    times = (first[1:] - first[:-1])[found["term"]]
    item = ragged(items, first[:-1][found["term"]], times)
    cell = item * n_docs + np.repeat(found["doc"], times)
    size = len(chosen) * n_docs
    # sums stay below 2 ** 53, so doubles are exact
    sums = [np.bincount(cell, np.repeat(x, times), size).astype(np.int64) for x in (weight[found["term"]] * found["part"], ahead[found["term"]])]
    return sums[0].reshape(len(chosen), n_docs), sums[1].reshape(len(chosen), n_docs)


def _blocks_of(batch: pa.RecordBatch, i: int, blocks: range) -> np.ndarray:
    own = [np.frombuffer(batch.column(f"block{b}")[i].as_buffer(), _POSTING) for b in blocks]
    return np.concatenate([np.zeros(0, _POSTING), *own])


def _in_parts(numbers: np.ndarray) -> list[np.ndarray]:
    return [numbers[i : i + ITEMS_AT_A_TIME] for i in range(0, len(numbers), ITEMS_AT_A_TIME)]


def _round(block: int, opened: np.ndarray, step: np.ndarray, k: int, shipped):
    """Per open item the steps of its ``k`` best lower ends in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *own, weight, _ = shipped.value
        asked = Asked(*own)
        for batch in batches:
            for i in range(batch.num_rows):
                n_docs = len(batch.column("ids")[i])
                found = _blocks_of(batch, i, range(block + 1))
                for chosen in _in_parts(opened):
                    lower, _ = interval_ends(found, n_docs, asked, chosen, weight, weight * 0)
                    if n_docs > k:
                        lower = np.partition(lower, n_docs - k, axis=1)[:, n_docs - k :]
                    item, at = np.nonzero(lower)
                    both = np.stack((chosen[item], lower[item, at] // step[chosen[item]]), axis=1)
                    both, n = np.unique(both, axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (both[:, 0], both[:, 1], n)], ["item", "at", "n"])

    return run


def _settled(until: np.ndarray, least: np.ndarray, last: int, shipped):
    """Close every item where it was closed, and read on for the documents that remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *own, weight, top = shipped.value
        asked, lists = Asked(*own), Lists(weight, top, top)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                for block in np.unique(until).tolist():
                    ahead = lists.ahead(block)
                    for chosen in _in_parts(np.flatnonzero(until == block)):
                        found = _blocks_of(batch, i, range(block + 1))
                        lower, met = interval_ends(found, len(ids), asked, chosen, weight, ahead)
                        upper = lower + asked.sums(ahead)[chosen][:, None] - met
                        near = (lower > 0) & (upper >= least[chosen][:, None])
                        some = np.zeros(len(ids), bool)
                        some[np.flatnonzero(near.any(axis=0))] = True
                        rest = _blocks_of(batch, i, range(block + 1, last + 1))
                        rest = rest[some[rest["doc"]]]
                        more, _ = interval_ends(rest, len(ids), asked, chosen, weight, ahead)
                        item, doc = np.nonzero(near)
                        score = (lower + more)[item, doc]
                        columns = [pa.array(chosen[item]), ids.take(pa.array(doc)), pa.array(score)]
                        yield pa.RecordBatch.from_arrays(columns, ["item", "id", "score"])

    return run


def _best(shards: DataFrame, id_type: str, asked: Asked, n_words: int, k: int) -> DataFrame:
    """(item, id, score) of at least the best ``k`` documents of every item, with exact scores."""
    context = shards.sparkSession.sparkContext
    whole = shards.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    sizes = whole["docs"] or 0, whole["words"] or 0
    lists = _lists(shards, n_words, *sizes, k)
    last = lists.n_blocks - 1
    fields = ", ".join(f"block{b} binary" for b in range(last + 1))
    blocks = shards.mapInArrow(_by_block(*sizes, context.broadcast(lists.low)), f"ids array<{id_type}>, {fields}")
    blocks = stored(blocks, "blocks")
    shipped = context.broadcast((*asked, lists.weight, lists.top))
    step = asked.sums(lists.top.max(axis=1)) // STEPS + 1
    opened, until, least = np.arange(asked.n), np.full(asked.n, last), np.zeros(asked.n, np.int64)
    for block in range(last):
        unmet = asked.sums(lists.ahead(block))
        read = blocks.select("ids", *(f"block{b}" for b in range(block + 1)))
        steps = read.mapInArrow(_round(block, opened, step, k, shipped), "item long, at long, n long").groupBy("item", "at").agg(F.sum("n").alias("n"))
        better = W.partitionBy("item").orderBy(F.desc("at"))  # at most STEPS rows an item
        enough = steps.withColumn("n", F.sum("n").over(better)).where(F.col("n") >= k)
        for row in enough.groupBy("item").agg(F.max("at").alias("at")).collect():
            least[row["item"]] = row["at"] * step[row["item"]]
        closed = (unmet[opened] < least[opened]) | (unmet[opened] == 0)
        until[opened[closed]] = block
        opened = opened[~closed]
        if not len(opened):
            break
    return blocks.mapInArrow(_settled(until, least, last, shipped), f"item long, id {id_type}, score long")


def item_terms(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, item, term): the different terms of every item; equal (id, text) are one item."""
    different = items.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text")).distinct()
    found = F.array_distinct(F.regexp_extract_all(ascii_lower("text"), F.lit(TERM), F.lit(0)))
    item = F.xxhash64("item_id", F.col("item_id").isNull(), "text")
    return different.select("item_id", item.alias("item"), F.explode(found).alias("term"))


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    item_column: str = "item_id",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per item its ``k`` best documents: item, ``rank`` from 1, document, ``score`` above 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; the score is a
    sum over an item's different terms of the term's weight times its saturated count in the whole
    text. Equal scores are ordered by ascending document id, null ids last. Null or empty texts have
    no terms; an item without a term that some document has gets no rows. Repeated documents are
    ranked each; equal items count once. Empty tables give an empty result; other columns are
    ignored, whatever their names.

    Items are searched in blocks of about TERMS_AT_A_TIME terms, each over all documents.
    """
    spark = docs.sparkSession
    asked = stored(item_terms(items, item_column), "items")
    n_blocks = -(-asked.count() // TERMS_AT_A_TIME) or 1
    id_type = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    fields = f"shard long, docs long, words long, ids array<{id_type}>, sizes binary, n_terms binary, terms binary, times binary"
    result = None
    for block in range(n_blocks):
        mine = asked.where(F.pmod("item", F.lit(n_blocks)) == block)
        numbered = mine.select("item", "term").toPandas()  # bounded by the block
        words, term = np.unique(numbered["term"].to_numpy(dtype=object), return_inverse=True)
        items_here, item = np.unique(numbered["item"].to_numpy(np.int64), return_inverse=True)
        order = np.lexsort((term, item))
        own = Asked(term[order].astype(np.int64), np.searchsorted(item[order], np.arange(len(items_here) + 1)))
        shipped = spark.sparkContext.broadcast([w.encode() for w in words] or [b"\x00"])  # NUL is in no term
        shards = stored(rows.mapInArrow(_shards(shipped), fields), "shards")
        scored = _best(shards, id_type, own, max(len(words), 1), k)
        best = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = scored.where(F.col("score") > 0).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(items_here)], "item long, name long")
        ids = mine.select("item_id", F.col("item").alias("name")).distinct()
        ranked = ranked.join(F.broadcast(names), "item").join(F.broadcast(ids), "name")
        ranked = ranked.select(F.col("item_id").alias(item_column), "rank", F.col("id").alias(id_column), "score")
        result = ranked if result is None else result.unionByName(ranked)
    return result
