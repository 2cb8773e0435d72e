"""The pipeline's stages against brute force, on odd rows and on an empty table."""

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SCHEMA, prose
from sievekit.llm import secrets, textscan, toxicity
from test_texts import brute_fingerprint, brute_repeats, labelled


def brute_near_duplicates(rows):
    """Ids and texts that stay: the smallest id of each group; rows without an id all stay."""
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    kept = {r[:2] for i, r in enumerate(rows) if r[0] is not None and r[0] == least[find(i)]}
    return sorted([*kept, *(r[:2] for r in rows if r[0] is None)], key=repr)


def pairs(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def brute_redacted(text):
    """Secrets found one text at a time, replaced from the last to the first."""
    raw = text.encode()
    found, at = secrets.find(*textscan.buffer_of(pa.array([text])))[0], len(raw) + 1
    for start, kind, stop in sorted(found, reverse=True):
        assert stop <= at
        raw, at = raw[:start] + f"[{secrets.ORDER[kind]}]".encode() + raw[stop:], start
    return raw.decode()


def test_near_duplicates(spark, odd, odd_rows):
    assert pairs(corpus_pipeline.drop_near_duplicates(spark, odd, "")) == brute_near_duplicates(odd_rows)


def test_texts_that_share_an_id(spark):
    """Each text of an id is judged by itself, and which of repeated rows stays is fixed."""
    rows = [(1, prose(1, 60), "en", "a"), (2, prose(1, 60), "en", "a"), (2, prose(2, 60), "fr", "b"), (2, prose(2, 60), "en", "b"), (3, prose(2, 60), None, "a"), (4, None, "en", "z"), (4, None, "en", "c")]
    docs = spark.createDataFrame([(i, t, lang, source, 1) for i, t, lang, source in rows], SCHEMA)
    got = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=repr) == [rows[0], rows[3], rows[6]]


def test_repeats(spark):
    shared = prose(9, 70)
    rows = [(1, shared + " one"), (2, "two " + shared), (3, prose(5, 60)), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    brute = brute_repeats(rows, 50)
    assert pairs(corpus_pipeline.drop_repeats(spark, docs, "")) == sorted((i, brute[i][2] if brute[i][1] else t) for i, t in rows)


def test_secrets(spark):
    rows = [(1, "a password=abcdefgh b"), (None, "x token: qwertyuiop"), (2, "none"), (2, "none"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    out = corpus_pipeline.drop_secrets(spark, docs, "")
    assert pairs(out) == sorted(((i, t if t is None else brute_redacted(t)) for i, t in rows), key=repr)
    assert all(r["n_chars"] == (1 if r["text"] is None else len(r["text"])) for r in out.collect())


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_odd_and_empty(spark, odd, none, tmp_path, number):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 15)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = corpus_pipeline.STAGES[number][1]
    assert stage(spark, none, str(tmp_path)).count() == 0
    out = stage(spark, odd.select(*corpus_pipeline.COLUMNS), str(tmp_path))
    assert out.count() > 0 and (number == len(corpus_pipeline.STAGES) - 1 or tuple(out.columns) == corpus_pipeline.COLUMNS)


def test_run(spark, tmp_path):
    from tokenizers import Tokenizer

    texts, y = labelled()
    texts += [texts[1], texts[2] + " password=abcdefgh", prose(9, 70) + " one", "two " + prose(9, 70)]
    rows = list(enumerate(texts, 1))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(v)) for i, v in enumerate(y, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    left = brute_near_duplicates([r for r in rows if score[r[0]] < 0.5])
    brute = brute_repeats(left, 50)
    left = [(i, brute_redacted(brute[i][2] if brute[i][1] else t)) for i, t in left]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    expected = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}
    got = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == expected and 0 < len(expected) < len(rows)
