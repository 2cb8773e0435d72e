"""SentencePiece encoding with the bytes that every piece comes from, and decoding.

A text is normalised by the model's compiled character map (charmap), which records each normalised byte's place in the source.  Where no piece of the vocabulary
goes on behind a blank that follows something else, a text's pieces are those of its blank-led stretches, so each distinct stretch of a
batch is encoded once, by the library with its own normalisation switched off; a piece's place among the normalised bytes then
gives its bytes in the source.  All of it is done where the text is: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import charmap, textscan
from sievekit.llm.common import gather_ranges, texts

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct stretches and bytes of them that a task remembers; beyond, it starts anew.
REMEMBERED, REMEMBERED_BYTES = 1 << 18, 16 << 20


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, its own bytes) for each field of a protocol buffer message."""
    at = 0
    while at < len(raw):
        begin = at
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            if kind == 2:
                size, at = _varint(raw, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value, raw[begin:at]


class Model:
    """What a .model file holds of the vocabulary and of normalisation, and the library's encoder without normalisation."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        self.pieces: list[bytes] = []
        kinds, rules, plain = [], {}, []
        for number, value, own in fields(raw):
            if number == 1:
                piece = dict((n, v) for n, v, _ in fields(value))
                self.pieces.append(piece.get(1, b""))
                kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                rules = dict((n, v) for n, v, _ in fields(value))
            if number not in (3, 4):  # 4: texts that the library would check against the normalisation
                plain.append(own)
        self.kinds = np.array(kinds, np.uint8)
        if (self.kinds == USER).any():
            raise ValueError("models with symbols of the user's own are not supported")
        self.rules = charmap.Rules(rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1)))
        self.table = charmap.CharMap(self.rules.charmap)
        blank, usual = charmap.BLANK.tobytes(), self.kinds == NORMAL
        self.known = {p: i for i, p in enumerate(self.pieces) if usual[i]}
        # no piece has a blank behind anything but a blank: texts can be cut before such blanks
        self.parted = self.rules.escape and blank in self.known and not any(blank in p.lstrip(b"\xe2\x96\x81") for p in self.known)
        self.unnormalised = b"".join(plain) + b"\x1a\x10\x0a\x08identity\x18\x00\x20\x00\x28\x01"
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.bytes = self.kinds == BYTE
        spoken = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(blank, b" ") for p, k in zip(self.pieces, kinds)]
        self.length = np.array([len(p) for p in spoken], np.int64)
        self.flat = np.frombuffer(b"".join(spoken), np.uint8)
        self.start = np.cumsum(self.length) - self.length
        self.led = np.array([p.startswith(blank) and k == NORMAL for p, k in zip(self.pieces, kinds)])
        self.odd = np.isin(self.kinds, (UNKNOWN, CONTROL))
        self._plain = self._whole = None

    def encoder(self):
        if self._plain is None:
            import sentencepiece

            self._plain = sentencepiece.SentencePieceProcessor(model_proto=self.unnormalised)
        return self._plain

    def library(self):
        if self._whole is None:
            import sentencepiece

            self._whole = sentencepiece.SentencePieceProcessor(model_proto=self.raw)
        return self._whole


_models: dict[int, Model] = {}


def _model(raw: bytes) -> Model:
    """The model, once a worker."""
    key = hash(raw)
    if key not in _models:
        _models[key] = Model(raw)
    return _models[key]


def _stretches(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the stretches of normalised rows begin that are encoded on their own."""
    rows = offs[:-1][np.diff(offs) > 0]
    if not model.parted or not len(data):
        return rows
    blank = np.zeros(len(data), bool)
    blank[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
    before = np.zeros(len(data), bool)
    before[3:] = blank[:-3]
    begin = blank & ~before
    begin[rows] = True
    return np.flatnonzero(begin)


def _places(model: Model, ids: np.ndarray, raw: np.ndarray, counts: np.ndarray, begins: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of stretches begin and end within their stretch; stretches lie in `raw` from `begins` on, with `counts` pieces each.

    Of the bytes of a character without a piece, the last has its place, the others none.
    """
    byte = model.bytes[ids]
    size = np.where(byte, 1, model.size[ids]) if sizes is None else sizes
    end = np.cumsum(size)
    start = end - size
    if byte.any():
        lead = (np.append(raw, 0)[np.append(start, len(raw))] & 0xC0) != 0x80  # begins a character; the last entry is the end
        begin = np.where(byte, np.maximum.accumulate(np.where(byte & lead[:-1], start, 0)), start)
        start, end = begin, np.where(byte & ~lead[1:], begin, end)
    own = np.repeat(begins, counts)
    return start - own, end - own


class _Known:
    """Pieces of the stretches that a task has seen, one after another in arrays."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.of: dict[bytes, int] = {}
        self.read = 0
        self.ids, self.low, self.high = (np.zeros(0, np.int32) for _ in range(3))
        self.counts = np.zeros(0, np.int64)

    def look(self, stretches: list[bytes]) -> np.ndarray:
        """The numbers of the stretches in the arrays."""
        if len(self.of) + len(stretches) > REMEMBERED or self.read > REMEMBERED_BYTES:
            self._forget()
        fresh = [s for s in stretches if s not in self.of]
        if fresh:
            model, raw = self.model, b"".join(fresh)
            found = model.encoder().encode([s.decode("utf-8") for s in fresh], num_threads=1)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for one in found for i in one), np.int64, int(counts.sum()))
            lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
            sizes = None
            if model.odd[ids].any():  # pieces that aren't in the vocabulary are as long as what they stand for
                told = model.encoder().encode([s.decode("utf-8") for s in fresh], out_type=str, num_threads=1)
                sizes = np.where(model.bytes[ids], 1, np.fromiter((len(t.encode()) for one in told for t in one), np.int64, len(ids)))
            low, high = _places(model, ids, np.frombuffer(raw, np.uint8), counts, np.cumsum(lengths) - lengths, sizes)
            self.ids, self.low, self.high = (np.concatenate([a, b.astype(np.int32)]) for a, b in ((self.ids, ids), (self.low, low), (self.high, high)))
            self.counts = np.concatenate([self.counts, counts])
            self.of.update(zip(fresh, range(len(self.of), len(self.of) + len(fresh))))
            self.read += len(raw)
        return np.fromiter(map(self.of.__getitem__, stretches), np.int64, len(stretches))


def _encode_rows(model: Model, known: _Known, data: np.ndarray, offs: np.ndarray):
    """ids, starts and ends of all pieces, and where each row's begin (rows + 1)."""
    made, ends, places = charmap.normalise(model.rules, model.table, data, offs)
    begin = _stretches(model, made, ends)
    stop = np.append(begin[1:], len(made))
    codes, first, _ = textscan.distinct(made, begin, stop)
    raw = made.tobytes()
    number = known.look([raw[a:b] for a, b in zip(begin[first].tolist(), stop[first].tolist())])[codes]
    sizes = known.counts[number]
    at = gather_ranges((np.cumsum(known.counts) - known.counts)[number], sizes)
    row = np.searchsorted(ends, begin, "right") - 1
    base = np.repeat(begin + row, sizes)
    rows = np.concatenate([[0], np.cumsum(np.bincount(row, sizes, len(offs) - 1).astype(np.int64))])
    return known.ids[at], places[base + known.low[at]], places[base + known.high[at]], rows


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends (array<int>): every whole text's pieces and the bytes of the text that each comes from, end exclusive.

    ids are the library's, without begin and end.  One row comes out for each that goes in, repeated rows and null ids included; a null or empty text has no
    pieces, other columns are ignored, an empty table gives an empty table.  A text may be of any length that one task can hold.
    """
    with open(model_path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # one fixed file, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content.value)
        known = _Known(model)
        for batch in batches:
            data, offs = textscan.buffer_of(batch.column(1))
            for lo, hi in textscan.row_chunks(offs):
                ids, low, high, rows = _encode_rows(model, known, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                edges = pa.array(rows, pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (ids, low, high)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], names=["doc_id", "ids", "starts", "ends"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with a string column more: what the library's decode() makes of the ids.  Null ids count as none; an id that the model lacks stops the job, as it stops the library.

    The pieces' bytes are gathered from the vocabulary; lists with unknown or control ids, that don't begin with a blank, or whose bytes aren't valid UTF-8, go through the library.
    """
    with open(model_path, "rb") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content.value)
        strip = model.rules.dummy_prefix and not model.rules.extra_spaces
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(model.length)):
                raise ValueError("an id isn't in the vocabulary")
            ends = np.cumsum(sizes)
            starts = ends - sizes
            filled = np.flatnonzero(sizes)
            odd = np.zeros(len(sizes), bool)
            odd[np.searchsorted(ends, np.flatnonzero(model.odd[ids]), "right")] = True
            odd[filled] |= ~model.led[ids[starts[filled]]]
            parts = [model.flat[gather_ranges(model.start[ids[lo : lo + (1 << 19)]], model.length[ids[lo : lo + (1 << 19)]])] for lo in range(0, len(ids), 1 << 19)]
            raw = (np.concatenate(parts) if parts else np.zeros(0, np.uint8)).tobytes()
            to = np.concatenate([[0], np.cumsum(model.length[ids])])
            out = []
            for lo, hi, bad in zip(starts.tolist(), ends.tolist(), odd.tolist()):
                text = None
                if lo == hi:
                    text = ""
                elif strip and not bad:
                    try:
                        text = raw[to[lo] + 1 : to[hi]].decode("utf-8")
                    except UnicodeDecodeError:
                        text = None
                out.append(model.library().decode(ids[lo:hi].tolist()) if text is None else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(run, encoded.withColumn(out_col, F.lit("")).schema)


def digests(documents: DataFrame, model_path: str) -> DataFrame:
    """Per document: how many ids, SHA-256 of the ids in decimal with commas, SHA-256 of the decoded text."""
    done = decode(encode(documents, model_path).select("doc_id", "ids"), model_path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
