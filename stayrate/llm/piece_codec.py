"""SentencePiece BPE encoding and decoding by a table of last tokens.

Byte-pair merges give every prefix of a text one sequence of pieces, so one last piece. An
automaton of all pieces reports which of them end at a position; of these the last piece of that
prefix is the one that is compatible with the last piece of the prefix before it, where two pieces
are compatible if merging their joined characters gives these two back. From the table of last
pieces the ids follow backwards from the end.

No piece holds two neighbouring characters that stand together in no piece of the vocabulary, so
texts are cut between such characters first, and equal chunks of a batch are encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stayrate.llm.kernels import pieces, text_bytes

#: The mark that stands for a space inside pieces, and what an unknown id decodes to.
MARK, UNKNOWN = "▁", " ⁇ "
#: A worker forgets its chunks, and its tested pairs, beyond so many.
KEPT_CHUNKS, KEPT_PAIRS, KEPT_LENGTH = 250_000, 500_000, 64
_ROWS = 2000
_codecs: dict[int, Codec] = {}


class Codec:
    """A vocabulary with its automaton. Takes BPE models with byte fallback that normalise nothing."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        known = {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
        form = proto.normalizer_spec
        plain = form.add_dummy_prefix and form.escape_whitespaces and not form.remove_extra_whitespaces
        if not plain or form.precompiled_charsmap or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model normalises texts or marks spaces in another way")
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("not a BPE model with byte fallback")
        if any(p.type not in known for p in proto.pieces):
            raise ValueError("the model has pieces set by its user")
        self.pieces = [p.piece for p in proto.pieces]
        self.kind = np.array([p.type for p in proto.pieces], np.int8)
        self.normal, self.byte, self.unknown = kinds.NORMAL, kinds.BYTE, kinds.UNKNOWN
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kind[i] == self.normal}
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in np.flatnonzero(self.kind == self.byte).tolist()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merged(piece) == [piece]:  # others never come out of merging
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, list[int]] = {}
        self._joinable()
        self._surfaces()

    def _joinable(self) -> None:
        """Number the characters of longer pieces; a bitmap says which of them stand side by side."""
        side = {(a, b) for piece in self.ids for a, b in zip(piece, piece[1:], strict=False)}
        chars = sorted({c for both in side for c in both})
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.joins = np.zeros(self.width * self.width, bool)
        self.joins[[number[a] * self.width + number[b] for a, b in side]] = True

    def _surfaces(self) -> None:
        """The bytes of every id as it stands in a decoded text."""
        surface = [b""] * len(self.pieces)
        for i, piece in enumerate(self.pieces):
            if self.kind[i] == self.normal:
                surface[i] = piece.replace(MARK, " ").encode()
            elif self.kind[i] == self.byte:
                surface[i] = bytes([int(piece[1:-1], 16)])
            elif self.kind[i] == self.unknown:
                surface[i] = UNKNOWN.encode()
        self.surface = surface
        self.lengths = np.array([len(s) for s in surface], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.body = np.frombuffer(b"".join(surface), np.uint8)
        self.opens_with_mark = np.array([self.kind[i] == self.normal and p.startswith(MARK) for i, p in enumerate(self.pieces)])

    def merged(self, text: str) -> list[str]:
        """Merge characters by the best score, the leftmost of equals first. For short texts."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging what two pieces hold gives these two pieces."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            found = self.pairs[left, right] = self.merged(a + b) == [a, b]
        return found

    def last_pieces(self, text: str) -> list[int]:
        """For every prefix of ``text``, the id of its last piece; -1 for a character without one."""
        last = [-1] * (len(text) + 1)
        tested, compatible = self.pairs, self.compatible
        for end, (piece, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if before < 0 or tested.get((before, piece)) or ((before, piece) not in tested and compatible(before, piece)):
                last[end] = piece
        return last

    def chunk_ids(self, text: str) -> list[int]:
        """The ids of a text in which spaces are marks already."""
        last, found, end = self.last_pieces(text), [], len(text)
        while end:
            piece = last[end]
            if piece >= 0:
                found.append(piece)
                end -= len(self.pieces[piece])
            else:
                end -= 1
                found += [self.byte_ids[b] for b in reversed(text[end].encode())]
        return found[::-1]

    def known_chunk(self, text: str) -> list[int]:
        found = self.chunks.get(text)
        if found is None:
            found = self.chunk_ids(text)
            if len(text) <= KEPT_LENGTH:
                if len(self.chunks) >= KEPT_CHUNKS:
                    self.chunks.clear()
                self.chunks[text] = found
        return found

    def chunks_of(self, body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marked texts and their cuts: code points, where chunks begin (and the end), chunks before each text."""
        points = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), np.uint32)
        opening = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))[starts]  # in code points
        filled = np.flatnonzero(np.diff(opening))
        points = np.insert(np.where(points == 0x20, np.uint32(ord(MARK)), points), opening[filled], ord(MARK))
        n_before = np.concatenate(([0], np.cumsum(np.diff(opening) > 0)))
        opening = opening + n_before
        number = self.number[points].astype(np.int64)
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.joins[number[:-1] * self.width + number[1:]]
        cut[opening] = True
        edges = np.flatnonzero(cut) if len(points) else np.zeros(1, np.int64)
        return points, edges, np.searchsorted(edges, opening)

    def encode(self, body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin."""
        points, edges, first = self.chunks_of(body, starts)
        if len(edges) < 2:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        codes, different = encoded_spans(points, edges)
        each = [self.known_chunk(chunk) for chunk in different]
        sizes = np.array([len(e) for e in each], np.int64)
        flat = np.fromiter((i for e in each for i in e), np.int32, int(sizes.sum()))
        ids = ragged(flat, np.concatenate(([0], np.cumsum(sizes)))[:-1][codes], sizes[codes])
        return ids, np.concatenate(([0], np.cumsum(sizes[codes])))[first]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts of all lists of ids: without the mark that was put before, bytes joined to characters."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id beyond the vocabulary")
        sizes = self.lengths[ids]
        body = ragged(self.body, self.offsets[:-1][ids], sizes).tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        found = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            lead = a
            while lead < b and not sizes[lead]:  # control ids give nothing
                lead += 1
            try:
                if not sizes[a:b].all():  # they also end a run of bytes
                    text = self._mended(ids[a:b])
                else:
                    text = body[ends[a] : ends[b]].decode()
            except UnicodeDecodeError:
                text = self._mended(ids[a:b])
            found.append(text[1:] if lead < b and self.opens_with_mark[ids[lead]] else text)
        return found

    def _mended(self, ids: np.ndarray) -> str:
        """Decoding by runs of byte ids, in which every byte that opens no character is replaced."""
        parts, run = [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.kind[i] == self.byte:
                run += self.surface[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    parts.append("�")
                    run = run[1:]
            if i >= 0:
                parts.append(self.surface[i].decode())
        return "".join(parts)


def encoded_spans(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """A number for every span of code points between ``edges``, and the different spans by number."""
    utf8 = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))[edges]
    spans = pa.Array.from_buffers(
        pa.large_string(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(utf8)]
    ).dictionary_encode()
    return spans.indices.to_numpy(), spans.dictionary.to_pylist()


def ragged(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``begins``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begins - (ends - sizes), sizes) + np.arange(total)]


def codec(model: bytes) -> Codec:
    """The vocabulary of ``model``, made once in a worker."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _shipped(frame: DataFrame, model_path: str):
    with open(model_path, "rb") as file:
        return frame.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary, not data


def encode_texts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id and ``ids``: the pieces of the whole text, without begin and end.

    ``model_path`` names a SentencePiece BPE model with byte fallback, read by the driver. Null
    and empty texts have no ids; repeated rows and null ids stay; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    model = _shipped(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = codec(model.value)
        for batch in batches:
            body, starts = text_bytes(batch.column(1))
            for a, b in pieces(starts):
                ids, first = ours.encode(body[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["id", "ids"])

    id_type = dict(docs.dtypes)[id_column]
    found = docs.select(id_column, text_column).mapInArrow(run, f"id {id_type}, ids array<int>")
    return found.toDF(id_column, "ids")


def decode_ids(frame: DataFrame, model_path: str, ids_column: str = "ids", output: str = "decoded") -> DataFrame:
    """Add ``output``, the text that the ids stand for; null ids give null.

    Bytes that form no character become U+FFFD, unknown ids the mark of the library, control ids
    nothing. Ids beyond the vocabulary are an error.
    """
    if output in frame.columns:
        raise ValueError(f"the input has a column {output}; name another output")
    model, place = _shipped(frame, model_path), frame.columns.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = codec(model.value)
        for whole in batches:
            for a in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(a, _ROWS)
                column = batch.column(place)
                sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = column.flatten().to_numpy(zero_copy_only=False)
                texts = ours.decode(ids, np.concatenate(([0], np.cumsum(sizes))))
                known = column.is_valid().to_pylist()
                texts = [t if k else None for t, k in zip(texts, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    names = [*frame.columns, output]
    fields = ", ".join(f"`{n}` {t}" for n, t in [*frame.dtypes, (output, "string")])
    return frame.mapInArrow(run, fields)
