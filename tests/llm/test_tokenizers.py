"""Piece coding and token alignment against the tokenizer libraries and brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from stayrate.llm import alignment, minimal_hash, piece_codec
from stayrate.llm.catalogue import QUERIES
from tests.conftest import TEST_DATA

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "a", " a", "▁x", "x▁ y", " " * 40 + "hello" + " " * 33, "x" * 3000, "日本語😀\x00\n\t <s>",
    "�​", "é" * 500, "\r\n  \n", "it's 's ''s 'll'd\n's we're '", "a 　 b", "x \t", "x \ty", "<|endoftext|> </s>",
    "\x1c a\x1c\x1db", "\x85 \xa0x", "é ½ ² ٣", "the the the", "the the the",
]
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, ids string, groups string, n_a long, id string, bucket long"


@pytest.fixture(scope="module")
def sentencepiece():
    library = pytest.importorskip("sentencepiece")
    return library.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    found = tokenizers.Tokenizer.from_file(BYTES)
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    letters = "abcdehlmorstvd''  éèñ日本\n\t.,<>/0123😀ङ\xa0　\x1c½²́▁"
    made = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(600)]
    return ODD + made


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i % 50 else None, t, "x", "y", 1, "z", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[23]], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def codec():
    with open(PIECES, "rb") as file:
        return piece_codec.codec(file.read())


def test_encodes_and_decodes_as_the_library_does(docs, sentencepiece):
    coded = piece_codec.decode_ids(piece_codec.encode_texts(docs, PIECES), PIECES)
    found = [(r["doc_id"], list(r["ids"]), r["decoded"]) for r in coded.collect()]
    expected = []
    for r in docs.collect():
        ids = sentencepiece.encode(r["text"] or "")
        expected.append((r["doc_id"], ids, sentencepiece.decode(ids)))
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_decodes_any_ids_as_the_library_does(codec, sentencepiece):
    draw = random.Random(2)
    pick = lambda: draw.choice([draw.randrange(32000), draw.randrange(259), draw.randrange(131, 259)])
    lists = [[pick() for _ in range(draw.randint(0, 7))] for _ in range(20000)]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    found = codec.decode(np.array([i for x in lists for i in x], np.int32), starts)
    assert found == [sentencepiece.decode(x) for x in lists]
    with pytest.raises(ValueError):
        codec.decode(np.array([32000]), np.array([0, 1]))


def test_every_prefix_has_one_last_piece(codec):
    for text in ("▁internationalisation", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁x", "▁aaaaaaaaaaaaab"):
        last = codec.last_pieces(text)
        for end in range(1, len(text) + 1):
            assert codec.pieces[last[end]] == codec.merged(text[:end])[-1]


def test_worker_caches_may_be_dropped(codec, texts, monkeypatch):
    body, starts = piece_codec.text_bytes(pa.array(texts))
    before = codec.encode(body, starts)[0].tolist()
    monkeypatch.setattr(piece_codec, "KEPT_CHUNKS", 3)
    monkeypatch.setattr(piece_codec, "KEPT_PAIRS", 3)
    assert codec.encode(body, starts)[0].tolist() == before


def test_null_ids_decode_to_null_and_clashing_names_are_errors(spark):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [300])], "k int, ids array<int>")
    assert [r["decoded"] for r in piece_codec.decode_ids(frame, PIECES).orderBy("k").collect()] == [None, "", "om"]
    with pytest.raises(ValueError):
        piece_codec.decode_ids(frame.withColumnRenamed("k", "decoded"), PIECES)


def test_query_digests(spark, sentencepiece):
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_piece_codec"](spark, TEST_DATA).collect()}
    for r in spark.read.parquet(f"{TEST_DATA}/documents.parquet").collect():
        ids = sentencepiece.encode(r["text"] or "")
        sums = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), sentencepiece.decode(ids))]
        assert found[r["doc_id"]] == (len(ids), *sums)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert piece_codec.decode_ids(piece_codec.encode_texts(empty, PIECES), PIECES).count() == 0
    assert alignment.align(empty, BYTES, PIECES).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in alignment.align(nothing, BYTES, PIECES).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def _plain_alignment(rows, tokenizer, pieces):
    """Token by token, as the definitions say."""
    decoder = {c: b for b, c in _byte_letters().items()}
    aligned, counts = [], collections.Counter()
    for doc_id, text in rows:
        a = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        a_bytes = [bytes(decoder[c] for c in tokenizer.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[1:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces.id_to_piece(b), strict=True)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            aligned.append((doc_id, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        links = []
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if max(ends[0][i] - len(a_bytes[i]), ends[1][j] - len(b_bytes[j])) < min(ends[0][i], ends[1][j]):
                    links.append((x, y))
        counts.update(links)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(f"{','.join(map(str, a[i:i2]))}|{','.join(map(str, b[j:j2]))}")
            i, j = i2, j2
        aligned.append((doc_id, a, b, groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (d, len(a), len(b), len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), ";".join(g))
        for d, a, b, g, x in aligned
    ]


def _byte_letters():
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def test_alignment(docs, tokenizer, sentencepiece):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = [tuple(r) for r in alignment.align(docs, BYTES, PIECES).collect()]
    assert sorted(found, key=str) == sorted(_plain_alignment(rows, tokenizer, sentencepiece), key=str)


def test_alignment_in_small_steps(docs, tokenizer, sentencepiece, monkeypatch):
    """Vectors summed in a tree, counts sent in several passes, caches dropped: the result stays."""
    expected = [tuple(r) for r in alignment.align(docs, BYTES, PIECES).collect()]
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    monkeypatch.setattr(alignment, "SENT_PAIRS", 400)
    monkeypatch.setattr(alignment, "KEPT_CELLS", 20)
    found = [tuple(r) for r in alignment.align(docs, BYTES, PIECES).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_alignment_reads_and_cuts_texts_once(spark, docs, monkeypatch):
    """Looking the counts up rests on the stored alignments, however many passes the counts take."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(alignment, "SENT_PAIRS", 400)
    found = alignment.align(docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string"), BYTES, PIECES)
    assert len(found.collect()) == reads.value == docs.count()


def test_pieces_stand_by_themselves(texts):
    """A stored alignment gives what the texts gave, and no text of a piece may have cells."""
    with open(BYTES, "rb") as a, open(PIECES, "rb") as b:
        ours = alignment.Aligner(a.read(), b.read())
    for column in (texts, ["x▁", None, ""], [None]):
        for a, b, *found in ours.cut(pa.array(column, pa.string())):
            piece = ours.piece(*found)
            read = alignment.Piece.unpacked(pa.py_buffer(piece.packed()))
            assert all(x.tolist() == y.tolist() for x, y in zip(piece, read, strict=True))
            assert piece.n_links.sum() == piece.facts.reshape(4, b - a)[3].sum()


def test_minimal_hash():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    found = minimal_hash.MinimalHash(minimal_hash.build(keys))
    assert found.n == len(keys)
    assert np.array_equal(np.sort(found.index(keys)), np.arange(len(keys)))
    others = found.index(keys + np.uint64(1))
    assert others.min() >= -1 and others.max() < len(keys)
    assert minimal_hash.MinimalHash([]).index(keys[:2]).tolist() == [-1, -1]
