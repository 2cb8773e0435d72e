"""LM scoring: attention over subword ids, mixed word by word with the corpus's word counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import attention, textscan, wordblocks
from sievekit.llm.bpe import load_ranks
from sievekit.llm.common import forget, gather_ranges, pack, save, texts, unpack
from sievekit.llm.labelled import fold

#: Ids of a shard of training texts: one goes through the first rounds, each then trains on its own.
SHARD_IDS = 1 << 21
#: Rounds over the first shard, at most, until it has given SHARD_IDS ids.
FIRST_ROUNDS = 6
#: Steps of a weight when weights are averaged: sums of whole numbers don't depend on their order.
_STEP = 1 << 24
#: Weight of the word counts in the mixture.
COUNTS_WEIGHT = 0.25


def _scan(data: np.ndarray, offs: np.ndarray):
    data = textscan.lower_ascii(data)
    return data, *textscan.words(data, offs)


class Subwords:
    """Ids of a word with a blank before it; the ids of words seen are kept."""

    def __init__(self, content: bytes):
        import tiktoken

        self.tokens = sorted(load_ranks(content).items(), key=lambda x: x[1])
        self.size = self.tokens[-1][1] + 1
        self.one_piece = tiktoken.Encoding("subwords", pat_str=r"\S+", mergeable_ranks=dict(self.tokens), special_tokens={})._encode_single_piece
        self.begins = np.zeros(self.size + 1, bool)
        for token, i in self.tokens:
            self.begins[i] = token.startswith(b" ")
        self.begins[self.size] = True
        self.known: dict[bytes, np.ndarray] = {}

    def ids(self, word: bytes) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[word] = np.array(self.one_piece(b" " + word), np.int32)
        return found


_made: dict[int, Subwords] = {}


def _subwords(content: bytes) -> Subwords:
    key = hash(content)
    if key not in _made:
        _made[key] = Subwords(content)
    return _made[key]


def _answers(docs: DataFrame, content, buckets: int, tasks: int, folds: int, aside: int) -> DataFrame:
    """Kind 0: for each block and bucket the ids and training counts of its words.

    Kind 1: words, distinct words and counts of subword ids of a bucket; kind 2: counts of pairs of ids in its words.
    """
    def weigh(ids: pa.Array) -> np.ndarray:
        return np.array([i is not None and zlib.crc32(str(i).encode()) % folds != aside for i in ids.to_pylist()], np.int64)

    def close(bucket: int, held: list[tuple], subwords: Subwords) -> list[tuple]:
        sizes, words = zip(*(wordblocks.word_bytes(count, size, packed) for _, _, count, size, packed, _ in held))
        size, data = np.concatenate(sizes).astype(np.int64), np.concatenate(words)
        starts = np.cumsum(size) - size
        codes, first, _ = textscan.distinct(data, starts, starts + size)
        each = np.concatenate([np.frombuffer(unpack(8 * count, counted), np.int64) for _, _, count, _, _, counted in held])
        total = np.bincount(codes, each, len(first)).astype(np.int64)
        raw = data.tobytes()
        found = [subwords.one_piece(b" " + raw[s:e]) for s, e in zip(starts[first].tolist(), (starts + size)[first].tolist())]
        length = np.fromiter(map(len, found), np.int64, len(found))
        ids, start = np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum())), np.cumsum(length) - length
        out, at = [], 0
        for block, guard, count, *_ in held:
            some = codes[at : at + count]
            size, reply = pack(total[some], length[some].astype(np.uint32), ids[gather_ranges(start[some], length[some])])
            out.append((0, block, bucket, guard, count, size, reply))
            at += count
        used = np.flatnonzero(total)
        flat, weight, word = ids[gather_ranges(start[used], length[used])], np.repeat(total[used], length[used]), np.repeat(np.arange(len(used)), length[used])
        by_id = np.bincount(flat, weight, 1).astype(np.int64)
        some = np.flatnonzero(by_id)
        size, reply = pack(some.astype(np.int64), by_id[some])
        out.append((1, int(total.sum()), bucket, len(used), len(some), size, reply))
        both = np.flatnonzero(word[1:] == word[:-1])
        keys, place = np.unique(flat[both].astype(np.int64) * subwords.size + flat[both + 1], return_inverse=True)
        size, reply = pack(keys, np.bincount(place, weight[both], len(keys)).astype(np.int64))
        out.append((2, 0, bucket, 0, len(keys), size, reply))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, now, held = _subwords(content.value), None, []

        def rows(out):
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["kind", "block", "bucket", "guard", "n", "size", "reply"])

        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "guard", "n", "size", "words", "counted"))):
                if bucket != now and held:
                    yield rows(close(now, held, subwords))
                    held = []
                    textscan.release()
                now = bucket
                held.append(tuple(row))
        if held:
            yield rows(close(now, held, subwords))
        textscan.release()

    words = wordblocks.word_rows(docs, _scan, buckets, weigh)
    return wordblocks.by_bucket(words, tasks).mapInArrow(run, "kind int, block long, bucket int, guard long, n int, size int, reply binary")


def _added(rows: DataFrame, size: int) -> np.ndarray:
    """Rows key, n as an array: at most `size` rows come to the driver, whatever the corpus."""
    counts = np.zeros(size, np.int64)
    found = rows.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return counts


def _summed(answers: DataFrame, kind: int, size: int, slots=None) -> np.ndarray:
    """Counts by id summed over all buckets; with slots, counts of pairs of ids by those of their own slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for n, raw, reply in zip(*(batch.column(c).to_pylist() for c in ("n", "size", "reply"))):
                both = np.frombuffer(unpack(raw, reply), np.int64)
                keys, counts = both[:n], both[n:]
                if slots is not None:
                    tokens = len(slots.value) - 1
                    one, two = slots.value[keys // tokens], slots.value[keys % tokens]
                    own = (one < attention.SLOTS) & (two < attention.SLOTS)
                    keys, counts = (one * attention.SLOTS + two)[own], counts[own]
                total[keys] += counts
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["key", "n"])

    return _added(answers.filter(F.col("kind") == kind).select("n", "size", "reply").mapInArrow(run, "key long, n long"), size)


def _word_ids(spans: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """doc_id, n, size, packed: for each text its n words' training counts, how many ids each has, and these ids."""

    def finish(replies: pa.Table):
        counts, lengths, flat_ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for n, size, reply in zip(*(replies.column(c).to_pylist() for c in ("n", "size", "reply"))):
            raw = unpack(size, reply)
            counts.append(np.frombuffer(raw, np.int64, n))
            lengths.append(np.frombuffer(raw, np.uint32, n, 8 * n))
            flat_ids.append(np.frombuffer(raw, np.uint32, -1, 12 * n))
        count, length, flat = np.concatenate(counts), np.concatenate(lengths).astype(np.int64), np.concatenate(flat_ids)
        start = np.cumsum(length) - length

        def chunk(doc_ids: pa.Array, n_words: np.ndarray, numbers: np.ndarray) -> pa.Table:
            words, own = np.concatenate([[0], np.cumsum(n_words)]), length[numbers]
            places = np.concatenate([[0], np.cumsum(own)])[words].tolist()
            counts, lengths, ids = count[numbers], own.astype(np.int32), flat[gather_ranges(start[numbers], own)]
            sizes, packed = [], []
            for a, b, c, d in zip(words[:-1].tolist(), words[1:].tolist(), places[:-1], places[1:]):
                size, raw = pack(counts[a:b], lengths[a:b], ids[c:d])
                sizes.append(size)
                packed.append(raw)
            return pa.table({"doc_id": doc_ids, "n": pa.array(n_words.astype(np.int32)), "size": pa.array(sizes, pa.int32()), "packed": pa.array(packed, pa.binary())})

        return chunk

    return wordblocks.meet(spans, answers, tasks, finish, "doc_id long, n int, size int, packed binary")


def _opened(batches: Iterator[pa.RecordBatch], end: int, least: int = 1 << 16) -> Iterator[tuple]:
    """Some texts together: doc_id, and for all their words in a row the counts (-1 for an end), their numbers of ids, the ids, and each text's words.

    Every text has an end behind its last word, which is one id.
    """
    held: list[tuple] = []
    total, last = 0, (np.array([-1]), np.array([1]), np.array([end]))

    def flush():
        parts = ([x for h in held for x in (h[k], last[k - 1])] for k in (1, 2, 3))
        return [h[0] for h in held], *(np.concatenate(p, dtype=np.int64) for p in parts), np.array([len(h[1]) + 1 for h in held], np.int64)

    for batch in batches:
        for i, n, size, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "size", "packed"))):
            raw = unpack(size, packed)
            own = np.frombuffer(raw, np.uint32, -1, 12 * n)
            held.append((i, np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int32, n, 8 * n), own))
            total += len(own) + 1
            if total >= least:
                yield flush()
                held, total = [], 0
    if held:
        yield flush()


def _per_text(lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Ids of each text."""
    return np.add.reduceat(lengths, np.cumsum(words) - words)


def _classes(rows: DataFrame, by_id: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and slot of each id by its neighbours in all texts."""
    top, most = attention.chosen(by_id)
    tokens, size = len(by_id) - 1, len(top) * 2 * len(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, _, _, ids, _ in _opened(batches, tokens, 1 << 18):
            total += attention.neighbours(ids, tokens, top, most).ravel()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["key", "n"])

    context = _added(rows.mapInArrow(run, "key long, n long"), size).reshape(len(top), 2 * len(most))
    return attention.classes(by_id, top, context, begins)


def _train(rows: DataFrame, model, tasks: int, rate: float, first: bool) -> np.ndarray:
    """The weights after training on all rows: each shard goes on from the model's by itself, and the results are averaged by their ids.

    A shard's rows come in the order of their hashes, ids and texts, whatever the partitions; the average adds whole
    numbers; so the weights are the same however the table is cut.  first: more rounds, as for a first shard.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    slots = len(model.weights["embed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copy import deepcopy

        sums, total = None, 0

        def shard_rows():
            """The rows of a shard after those of another."""
            now, held = None, []
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("shard")).to_numpy()
                edges = np.flatnonzero(np.diff(column, prepend=-1, append=-1)).tolist()
                for lo, hi in zip(edges[:-1], edges[1:]):
                    if column[lo] != now and held:
                        yield held
                        held = []
                    now = column[lo]
                    held.append(batch.slice(lo, hi - lo))
            if held:
                yield held

        for held in shard_rows():
            own = deepcopy(shared.value)
            state = attention.start_state(own.weights)
            size = sum(r for batch in held for r in batch.column(batch.schema.get_field_index("ids")).to_pylist())
            seen = 0
            for _ in range(min(FIRST_ROUNDS, -(-SHARD_IDS // max(size, 1))) if first else 1):
                for _, _, lengths, ids, words in _opened(iter(held), own.end, 1 << 18):
                    attention.train(own, ids, _per_text(lengths, words), 1, rate, state=state)
                    seen += len(ids)
            flat = np.rint(attention.flat(own.weights).astype(np.float64) * _STEP).astype(np.int64)
            seen = max(seen >> 10, 1)
            sums, total = flat * seen + (0 if sums is None else sums), total + seen
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])

    ordered = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "h", "doc_id", "packed")
    each = ordered.mapInArrow(run, "n long, sums array<long>")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = None, 0
        for batch in batches:
            for n, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums, total = own.values.to_numpy() + (0 if sums is None else sums), total + n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])

    # a few rows of the size of one model each come to the driver, however many tasks there were
    found = each.repartition(8).mapInArrow(add, "n long, sums array<long>").collect()
    if not found:
        return attention.flat(model.weights)
    out = sum(np.array(r["sums"], np.float64) for r in found) / sum(r["n"] for r in found) / _STEP
    assert len(out) == attention.flat(attention.start_weights(slots)).size
    return out


@dataclass
class Fitted:
    """The attention model and the corpus's counts."""

    model: attention.Model
    total: int  # tokens learned from
    known: int  # distinct ones
    ends: int  # texts learned from

    def scores(self, counts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
        """Of each text, given all texts' words in a row as _opened gives them."""
        is_end = counts < 0
        c = np.where(is_end, self.ends, counts)
        begin = np.cumsum(words) - words  # every text has a word, its end
        first = np.cumsum(lengths) - lengths
        logp, begins = attention.log_probabilities(self.model, ids, _per_text(lengths, words))
        word = np.add.reduceat(logp, first) - begins[first]
        word += np.where(is_end, 0, begins[np.append(first[1:], 0)])
        word += np.log(1 - COUNTS_WEIGHT)
        mixed = np.where(c > 0, np.log(COUNTS_WEIGHT / max(self.total, 1) * np.maximum(c, 1) + np.exp(word)), word)
        return {
            "n_tokens": words,
            "n_known": np.add.reduceat((c > 0).astype(np.int64), begin),
            "base_score": np.add.reduceat(np.log((c + 1) / (self.total + self.known + 1)), begin) / np.log(10),
            "score": np.add.reduceat(mixed, begin) / np.log(10),
        }


def fit(answers: DataFrame, learned: DataFrame, subwords: Subwords, ends: int, tasks: int) -> Fitted:
    """Counts, classes and weights from all rows of `learned` (as _word_ids gives them)."""
    spark = learned.sparkSession
    words, distinct = (int(x) for x in answers.filter("kind = 1").agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("guard"), F.lit(0))).first())
    by_id = _summed(answers, 1, subwords.size + 1)
    by_id[subwords.size] = ends
    group, slot = _classes(learned, by_id, subwords.begins)
    pairs = _summed(answers, 2, attention.SLOTS**2, spark.sparkContext.broadcast(slot))
    smooth = by_id + 0.5
    within = smooth / np.bincount(group, smooth, attention.CLASSES)[group]
    model = attention.Model(slot, group, within, pairs.reshape(attention.SLOTS, -1).astype(np.float32), attention.start_weights(attention.SLOTS + 2))
    shards = max(1, -(-int(by_id.sum()) // SHARD_IDS))
    hashed = F.xxhash64("doc_id")
    # ids of a row, from the size of what is packed: 8 + 4 bytes a word, 4 an id
    dealt = learned.withColumn("h", hashed).withColumn("shard", F.pmod(hashed, F.lit(shards)).cast("int")).withColumn("ids", ((F.col("size") - 12 * F.col("n")) / 4).cast("long") + 1)
    if ends:
        for part, first, rate in ((dealt.filter("shard = 0"), True, 0.2), (dealt, False, 0.1)):
            model.weights = attention.unflat(_train(part, model, 1 if first else max(tasks, min(shards, 4 * tasks)), rate, first), attention.SLOTS + 2)
    return Fitted(model, words + ends, distinct + (ends > 0), ends)


def score_texts(docs: DataFrame, ranks_path: str, folds: int = 7, aside: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row.

    Tokens are the words of the text, lower-cased in A-Z, and an end.  base_score is the sum of log10((c + 1) / (N + V + 1)) with
    the counts of all rows whose id's CRC-32 modulo `folds` is not `aside`.  score is the model's log10 probability: each
    word has COUNTS_WEIGHT times its share of the training tokens, and the rest times the product of its subword ids'
    probabilities by attention, up to and with the word's end.
    Word counts, subword counts, and the classes and slots of ids cover all training rows, by one distinct-word shuffle that also
    gives every text's ids.  The attention weights learn from every training row: from one shard of texts first, then from each shard
    by itself, averaged.  Shards are dealt by ids, so the scores don't depend on partitions.
    One row comes out for each row that goes in; a row with a null id is scored and not learned from; a null or empty text is
    the end alone; repeated rows count each; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    rows = texts(docs, id_col, text_col)
    buckets, tasks = wordblocks.sizes(rows)
    subwords = _subwords(content.value)
    ends = rows.filter(fold("doc_id", folds) != aside).count()
    answers = save(_answers(rows, content, buckets, tasks, folds, aside), "word-counts")
    found = save(_word_ids(wordblocks.span_rows(rows, _scan, buckets), answers.filter("kind = 0").drop("kind"), tasks), "word-ids")
    fitted = fit(answers, found.filter(fold("doc_id", folds) != aside), subwords, ends, tasks)
    forget(answers)
    shared = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, counts, lengths, flat, words in _opened(batches, shared.value.model.end):
            out = shared.value.scores(counts, lengths, flat, words)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, out.values())], names=["doc_id", *out])
        textscan.release()

    out = found.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(fitted.total).cast("long").alias("train_tokens"), "base_score", "score")


def classify(documents: DataFrame, ranks_path: str, folds: int = 7, aside: int = 2) -> DataFrame:
    out = score_texts(documents, ranks_path, folds, aside)
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == aside, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
