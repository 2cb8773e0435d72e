"""Substring dedup by compaction of a de Bruijn graph of words.

An edge is a k-mer of `width` consecutive words (a window).  The edges are dealt by minimizer, the smallest hash of the
shorter k-mers in them: a run of consecutive edges of one minimizer is a path, and one row.  Paths with the same words
compact to one, whose first document is known without looking at its edges unless another path of the same minimizer
branches off.  Only then are the edges of such paths compared one by one, and those that go on in one source compact again.
Every repeated span carries the place (document, word) of its source, and before words go, the digest of the words that
stand there is compared with the digest of the span's own: hashes find the repeats, the source's words decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import textscan
from sievekit.llm.common import forget, gather_ranges, save, small_batches, texts

#: Words of the k-mers whose smallest hash in a window is its minimizer.
SEED_WORDS = 12


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values (van Herk): one running minimum forwards and one backwards."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = textscan.words(data, offs)
    return textscan.word_hashes(data, starts, ends), rows


def _paths(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """m (minimizer), c (hash of the words), doc_id, lo (first word), n (windows) of each path of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textscan.buffer_of(batch.column(1))
            for a, b in textscan.row_chunks(offs):
                words, rows = _word_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                counts = np.diff(rows)
                has = np.flatnonzero(counts >= width)
                if not len(has):
                    continue
                at = np.arange(len(words) - seed + 1)
                least = sliding_min(textscan.sequence_hashes(words, at, at + seed, 1), width - seed + 1)
                windows = gather_ranges(rows[has], counts[has] - width + 1)
                row = np.repeat(has, counts[has] - width + 1)
                m = least[windows]
                first = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (row[1:] != row[:-1])]))
                n = np.diff(first, append=len(m))
                lo = windows[first]
                c = textscan.sequence_hashes(words, lo, lo + n + width - 1, 2)
                own = row[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m[first].view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(pa.array(own + a)), pa.array((lo - rows[own]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["m", "c", "doc_id", "lo", "n"],
                )

    return docs.mapInArrow(run, "m long, c long, doc_id long, lo int, n int")


def _edges(paths: DataFrame, width: int) -> DataFrame:
    """m, c, k, w, doc_id, at: hash and place of the k-th window of each path; paths: doc_id, text, paths array<struct<lo, n, m, c>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textscan.buffer_of(batch.column(1))
            column = batch.column(2)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            lo, n, m, c = (x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten())
            edge = np.concatenate([[0], np.cumsum(sizes)])
            for a, b in textscan.row_chunks(offs):
                words, rows = _word_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                own = slice(edge[a], edge[b])
                begin = np.repeat(rows[:-1], sizes[a:b])
                counts = n[own].astype(np.int64)
                at = gather_ranges(lo[own] + begin, counts)
                fits = at + width <= np.repeat(np.repeat(rows[1:], sizes[a:b]), counts)  # false only where one id has several texts
                k = gather_ranges(np.zeros(len(begin), np.int64), counts)[fits]
                at, path = at[fits], np.repeat(np.arange(len(begin)), counts)[fits]
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(a, b), sizes[a:b])[path]))
                w = textscan.sequence_hashes(words, at, at + width, 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m[own][path]), pa.array(c[own][path]), pa.array(k.astype(np.int32)), pa.array(w.view(np.int64)), ids, pa.array((at - begin[path]).astype(np.int32))],
                    names=["m", "c", "k", "w", "doc_id", "at"],
                )

    return paths.mapInArrow(run, "m long, c long, k int, w long, doc_id long, at int")


_RUN = "struct<k:int,n:int,source:long,at:int>"


def _runs(known: DataFrame) -> DataFrame:
    """m, c, runs: the edges of each path that go on, one after another, in one source; known: m, c, edges array<struct<k, source, at>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            k, source, at = (x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten())
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((k, row))
            row, k, source, at = row[order], k[order], source[order], at[order]
            new = np.ones(len(k), bool)
            new[1:] = (row[1:] != row[:-1]) | (k[1:] != k[:-1] + 1) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            n = np.diff(first, append=len(k)).astype(np.int32)
            edges = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(sizes)))])
            items = pa.StructArray.from_arrays([pa.array(x) for x in (k[first], n, source[first], at[first])], names=["k", "n", "source", "at"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), items)], names=["m", "c", "runs"])

    return known.mapInArrow(run, f"m long, c long, runs array<{_RUN}>")


def repeats(docs: DataFrame, width: int = 50, seed: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lo, n, source, at: the windows, n of them from word lo on, that also start in the document `source`, from its word `at` on.

    source is the smallest id in which they start, and smaller than doc_id.  Found by hashes, not yet verified.  Rows with a
    null id count for nothing.
    """
    rows = texts(docs, id_col, text_col).filter("doc_id is not null")
    paths = save(_paths(rows, width, seed), "paths")
    place = F.min(F.struct("doc_id", "lo")).alias("first")
    shared = paths.groupBy("m").agg(place, F.max("doc_id").alias("last"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("first.doc_id < last")
    shared = shared.select("m", F.col("first.doc_id").alias("source"), F.col("first.lo").alias("at"), (F.col("c0") != F.col("c1")).alias("branches"))
    found = save(paths.join(shared, "m"), "repeated-paths")
    forget(paths)
    whole = found.filter("not branches and source < doc_id").select("doc_id", "lo", "n", "source", "at")

    # One place of each distinct path of a minimizer with several: there its edges are read from the text.
    places = found.filter("branches").groupBy("m", "c").agg(F.min(F.struct("doc_id", "lo", "n")).alias("at"))
    # (the same words in one document twice: the first place; one id with several texts: the smallest)
    wanted = places.select("at.doc_id", F.struct("at.lo", "at.n", "m", "c").alias("path")).groupBy("doc_id").agg(F.collect_list("path").alias("paths"))
    edges = save(_edges(rows.join(wanted, "doc_id").select("doc_id", "text", "paths"), width), "edges")
    firsts = edges.groupBy("m", "w").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    known = edges.select("m", "c", "k", "w").join(firsts, ["m", "w"]).groupBy("m", "c").agg(F.collect_list(F.struct("k", F.col("first.doc_id").alias("source"), F.col("first.at").alias("at"))).alias("edges"))
    branching = found.filter("branches").select("m", "c", "doc_id", "lo").join(_runs(known), ["m", "c"])
    parts = branching.select("doc_id", "lo", F.explode(F.filter("runs", lambda r: r["source"] < F.col("doc_id"))).alias("run"))
    spans = whole.union(parts.select("doc_id", (F.col("lo") + F.col("run.k")).alias("lo"), "run.n", "run.source", "run.at"))
    out = save(spans, "spans")
    forget(found)
    forget(edges)
    return out


def span_digests(data: np.ndarray, offs: np.ndarray, row: np.ndarray, lo: np.ndarray, words: np.ndarray) -> list[bytes | None]:
    """A digest of so many words of a row from word lo on, joined by one blank; None where the row has fewer."""
    starts, ends, rows = textscan.words(data, offs)
    raw, starts, ends = textscan.joined(data, starts, ends)
    first = rows[row] + lo
    last = first + words - 1
    fits = (last < rows[row + 1]) & (words > 0)
    chosen = np.flatnonzero(fits)
    out: list[bytes | None] = [None] * len(row)
    for i, s, e in zip(chosen.tolist(), starts[first[chosen]].tolist(), ends[last[chosen]].tolist()):
        out[i] = blake2b(raw[s:e], digest_size=16).digest()
    return out


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, list[pa.Array]]:
    """How many items each row's list has (none, if null), and the fields of all items."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().flatten()


def proofs(docs: DataFrame, spans: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """source, at, n, proof: the digest of the source's own words for each distinct span (one for each text, if an id has several)."""
    asked = spans.groupBy("source", "at", "n").agg(F.count("*").alias("times")).groupBy("source").agg(F.collect_list(F.struct("at", "n")).alias("asked"))
    rows = texts(docs, id_col, text_col).join(asked, F.col("doc_id") == F.col("source")).select("source", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textscan.buffer_of(batch.column(1))
            sizes, (at, n) = _lists(batch, "asked")
            edge = np.concatenate([[0], np.cumsum(sizes)])
            for a, b in textscan.row_chunks(offs):
                own = slice(edge[a], edge[b])
                row = np.repeat(np.arange(b - a), sizes[a:b])
                at_, n_ = (x[own].to_numpy(zero_copy_only=False).astype(np.int64) for x in (at, n))
                found = span_digests(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], row, at_, n_ + width - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(at_.astype(np.int32)), pa.array(n_.astype(np.int32)), pa.array(found, pa.binary())], names=["source", "at", "n", "proof"])

    return rows.mapInArrow(run, "source long, at int, n int, proof binary").filter("proof is not null")


def _kept(data: np.ndarray, offs: np.ndarray, row: np.ndarray, lo: np.ndarray, n: np.ndarray, width: int):
    """Kept words of all rows joined by one blank, their offsets, words and removed words of each row."""
    starts, ends, rows = textscan.words(data, offs)
    first = np.minimum(rows[row] + lo, rows[row + 1])
    last = np.minimum(first + n + width - 1, rows[row + 1])
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, last, -1)
    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    counts = np.diff(rows)
    at = np.searchsorted(kept, rows)
    mask = np.zeros(len(data) + 1, np.int8)
    np.add.at(mask, starts[kept], 1)
    np.add.at(mask, ends[kept], -1)
    chosen = np.cumsum(mask[:-1]).astype(bool)
    joint = np.ones(len(kept), bool)
    joint[at[1:][np.diff(at) > 0] - 1] = False  # nothing behind a row's last word
    out = data.copy()
    out[ends[kept[joint]]] = 0x20
    chosen[ends[kept[joint]]] = True
    sizes = np.concatenate([[0], np.cumsum(chosen)])[offs]
    return out[chosen], sizes, counts, counts - np.diff(at)


def remove_repeats(docs: DataFrame, width: int = 50, seed: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the documents, and kept_text, n_words, n_removed.

    Words are `[^\\x20\\x09-\\x0D]+`.  A word goes if it is in a window of `width` words of its document that also
    starts in a document with a smaller id; the windows are those of the input.  A span goes only if its words equal those at its
    source's place, by a digest of both.  kept_text has the other words, joined by one blank.
    One row comes out for each row that goes in.  A null text has no words; a row with a null id keeps its
    words and takes none from others; rows that share an id are one document with the windows of all of them as a source, and each
    loses what its own text repeats; an empty table gives an empty table.  Columns named kept_text, n_words or
    n_removed are replaced.
    """
    small_batches(docs.sparkSession)
    spans = repeats(docs, width, seed, id_col, text_col)
    proved = spans.join(proofs(docs, spans, width, id_col, text_col), ["source", "at", "n"])
    marks = proved.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("lo", "n", "proof")).alias("__repeated"))
    docs = docs.drop("kept_text", "n_words", "n_removed")
    joined = docs.join(marks, F.col(id_col).cast("long") == F.col("__id"), "left").drop("__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textscan.buffer_of(batch.column(batch.schema.get_field_index(text_col)))
            sizes, (lo, n, proof) = _lists(batch, "__repeated")
            lo, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lo, n))
            edge = np.concatenate([[0], np.cumsum(sizes)])
            rest = [k for k, name in enumerate(batch.schema.names) if name != "__repeated"]
            for a, b in textscan.row_chunks(offs):
                own, row = slice(edge[a], edge[b]), np.repeat(np.arange(b - a), sizes[a:b])
                part, edges = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                same = np.array([x == y for x, y in zip(span_digests(part, edges, row, lo[own], n[own] + width - 1), proof[own].to_pylist())], bool)
                out, ends, words, gone = _kept(part, edges, row[same], lo[own][same], n[own][same], width)
                text = pa.StringArray.from_buffers(b - a, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in rest), text, pa.array(words, pa.int64()), pa.array(gone, pa.int64())], names=[*(batch.schema.names[k] for k in rest), "kept_text", "n_words", "n_removed"])

    schema = docs.withColumns({"kept_text": F.lit(""), "n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(run, schema)


def digests(documents: DataFrame) -> DataFrame:
    out = remove_repeats(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
