"""Operators on texts against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievekit.llm import attention, bpe, lm, packing, quality, secrets, simhash, substring, textscan, toxicity, wordblocks

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_words_and_pretokens_match_patterns():
    regex = pytest.importorskip("regex")
    joined, apart = regex.compile(public_tokenizers.PATTERN), regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    random.seed(4)
    for _ in range(300):
        texts = ["".join(random.choice(" '  ''sstrevmlda1é\n\t\xa0!.漢") for _ in range(random.randint(0, 14))) for _ in range(5)]
        data, offs = textscan.buffer_of(pa.array(texts))
        raw = data.tobytes()
        for pattern, space in ((joined, True), (apart, False)):
            starts, ends, rows = textscan.pretoken_starts(data, offs, space)
            for i, text in enumerate(texts):
                assert [raw[a:b].decode() for a, b in zip(starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]])] == pattern.findall(text)
        starts, ends, rows = textscan.words(data, offs)
        for i, text in enumerate(texts):
            assert [raw[a:b].decode() for a, b in zip(starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]])] == SPLIT.findall(text)


def test_bpe(spark, odd, odd_rows, none):
    import tiktoken

    with open(RANKS, "rb") as f:
        encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    expected = []
    for i, text, *_ in odd_rows:
        ids = encoder.encode_ordinary(text or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows_of(bpe.digests(odd, RANKS)) == sorted(expected, key=repr)
    assert bpe.digests(none, RANKS).count() == 0


def brute_secrets(text):
    key = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets_match_brute_force():
    random.seed(2)
    parts = ["password", "TOKEN", "api_key", "apiKey", "secret", "passwd", ":", "=", " ", '"', "'", "é", "abcdef1", "deadbeef" * 3, "0123456789abcdef", "AKIA", "AKIA" + "B" * 16, "Q", ".", "\n", "ſecret"]
    for _ in range(500):
        texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 9))) for _ in range(4)]
        data, offs = textscan.buffer_of(pa.array(texts))
        assert [[s for s in row if s[1] < 3] for row in secrets.find(data, offs)] == [brute_secrets(t) for t in texts]


def test_secrets_checksums():
    body = "q" * 30
    good, bad = "ghp_" + body + secrets.base62_crc32(body), "ghp_" + "q" * 36
    data, offs = textscan.buffer_of(pa.array([good, bad]))
    assert [[secrets.ORDER[k] for _, k, _ in row] for row in secrets.find(data, offs)] == [["github"], []]


def test_secrets_in_long_runs():
    """Candidates one behind another are read once each, not once from each hit."""
    import time

    for text in ("eyJ" * 350_000, "eyJa." * 200_000, "-----BEGIN " * 90_000, "token " * 150_000, "AKIA" * 250_000, "password" + " " * 1_000_000):
        began = time.time()
        data, offs = textscan.buffer_of(pa.array([text]))
        secrets.find(data, offs)
        assert time.time() - began < 10
    header = "eyJhbGciOiJub25lIn0"
    data, offs = textscan.buffer_of(pa.array([f"eyJeyJ eyJx {header}.payload.sig", f"{header}.a.b eyJ.eyJ"]))
    assert [[secrets.ORDER[k] for _, k, _ in row] for row in secrets.find(data, offs)] == [["jwt"], ["jwt"]]


def test_secrets_odd_rows(spark, odd, odd_rows, none):
    assert secrets.scan(odd).count() == len(odd_rows) and secrets.scan(none).count() == 0
    out = secrets.redact(spark.createDataFrame([(1, "a password=abcdefgh b"), (2, None)], "doc_id long, text string"))
    assert rows_of(out) == [(1, "a [assign] b"), (2, None)]


def brute_repeats(rows, width):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize(("width", "seed"), [(6, 3), (8, 4)])
def test_substring_matches_brute_force(spark, width, seed):
    random.seed(width)
    rows = [(i, " ".join(random.choice("ab") for _ in range(random.choice([0, 3, 5, 9, 30, 200])))) for i in range(150)]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width, seed)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()} == brute_repeats(rows, width)


def test_substring_odd_rows(odd, odd_rows, none):
    out = substring.remove_repeats(odd)
    assert out.count() == len(odd_rows) and substring.remove_repeats(none).count() == 0
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in out.collect()}
    assert (6, 30_000, 0) in got and (7, 30_000, 30_000) in got and (None, 120, 0) in got and (11, 121, 120) in got


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = SPLIT.findall(lowered(text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_odd_rows(odd, odd_rows, none):
    got = simhash.digests(odd).collect()
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{brute_fingerprint(t):016x}" for _, t, *_ in odd_rows)
    component = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]}
    assert component[7] == 6 and component[3] == component[2] == 1
    assert simhash.digests(none).count() == 0


def test_simhash_links_match_brute_force(spark):
    random.seed(9)
    base = [random.getrandbits(64) for _ in range(40)]
    fps = list({b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 4))) for b in base for _ in range(30)})
    frame = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    from sievekit.llm.components import connected

    got = {r["node"] % (1 << 64): r["component"] for r in connected(simhash.links(frame)).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for f in fps:
        groups[find(f)].add(f)
    ours = collections.defaultdict(set)
    for f in fps:
        ours[got.get(f, f"alone {f}")].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_packing(odd, odd_rows, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD)
    whole.encode_special_tokens = True
    out = packing.pack_sequences(odd, WORD).collect()
    expected = []
    for i, text, *_ in odd_rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(expected, key=repr)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_sequences(none, WORD).count() == 0


def test_sum_of_squares_is_tight():
    lengths = np.random.default_rng(1).integers(1, 2049, 5000)
    bins, _ = packing.sum_of_squares(lengths, 2048)
    assert len(set(bins.tolist())) <= 1.01 * math.ceil(lengths.sum() / 2048)


def test_language_model_base_scores(odd, odd_rows, none):
    got = rows_of(lm.classify(odd, MULTI).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score"))
    count = collections.Counter()
    tokens = [(i, [*SPLIT.findall(lowered(t or "")), None]) for i, t, *_ in odd_rows]
    for i, words in tokens:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(words)
    n, v = sum(count.values()), len(count)
    expected = sorted(((i, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens), key=repr)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert [g[4] for g in got] == pytest.approx([e[4] for e in expected])
    assert lm.classify(none, MULTI).count() == 0


def language_texts(n=40, seed=1):
    words = "the of and river stone cloud window paper garden quiet letter morning unseenword".split()
    return {i: " ".join(random.Random(i + seed).choices(words, k=30 + i)) for i in range(n)}


def test_language_model_trains_on_every_learning_row(spark):
    """Another order of the words of any learning row, which no count of words shows, changes the scores."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    learn = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:12]
    rows = {i: t for i, t in language_texts(100).items() if i in (held, *learn)}

    def score(texts):
        docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
        return next(r["score"] for r in lm.score_texts(docs, MULTI).collect() if r["doc_id"] == held)

    plain = score(rows)
    for i in learn[:2]:
        assert score(rows | {i: " ".join(sorted(rows[i].split()))}) != plain


def test_language_model_is_the_same_however_the_table_is_cut(spark, monkeypatch):
    """Several shards, over 1 and 5 partitions in other orders: the same scores, but for the order in which single-precision products are summed."""
    monkeypatch.setattr(lm, "SHARD_IDS", 600)
    rows = [*language_texts(40).items(), (7, "the river again"), (None, "no id"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, *(str(x) for x in r[:4]))
    one, other = (sorted((tuple(r) for r in lm.score_texts(d, MULTI).collect()), key=key) for d in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).repartition(5)))
    assert [r[:5] for r in one] == [r[:5] for r in other]
    assert [r[5] for r in one] == pytest.approx([r[5] for r in other], rel=1e-7)


def fitted_model(spark, rows, monkeypatch):
    """What score_texts fits, and the words of the scored texts."""
    caught = {}
    plain = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: caught.setdefault("fitted", plain(*a)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, MULTI).collect()}
    return caught["fitted"], out


def brute_log_probability(fitted, subwords, words, counts):
    """log10 of a text's probability, word by word and id by id, from the weights."""
    m, w = fitted.model, fitted.model.weights
    ids = [i for word in words for i in subwords.ids(word).tolist()] + [m.end]
    slots = [int(m.slot[m.end]), *(int(m.slot[i]) for i in ids[:-1])]
    window, context = attention.WINDOW, attention.CONTEXT
    chances, starts = [], []
    for t, i in enumerate(ids):
        begin = 0
        while t >= begin + window:
            begin += window - context
        while begin and t < begin + context:
            begin -= window - context
        seen = slots[begin : t + 1]
        x = w["embed"][seen].astype(float)
        at = len(seen) - 1
        q = x[-1] @ w["query"] + w["at_query"][at]
        keys = x @ w["key"] + w["at_key"][: at + 1]
        a = np.exp(np.clip(keys @ q * attention.WIDTH**-0.5, -attention._LIMIT, attention._LIMIT))
        h = x[-1] + (a / a.sum()) @ (x @ w["value"])
        z = np.exp(np.clip(h @ w["out"] + w["bias"], -60, 60))
        share = float(m.share(np.array([slots[t]]), np.array([i]))[0])
        chances.append(math.log(z[m.group[i]] / z.sum() * share))
        starts.append(math.log(z[: attention.STARTS].sum() / z.sum()))
    total, at = 0.0, 0
    for word in [*words, None]:
        n = len(subwords.ids(word)) if word is not None else 1
        p = sum(chances[at : at + n]) - starts[at] + (starts[at + n] if word is not None else 0)
        c = counts[word] if word is not None else fitted.ends
        total += math.log10(lm.COUNTS_WEIGHT * c / fitted.total + (1 - lm.COUNTS_WEIGHT) * math.exp(p))
        at += n
    return total


def test_language_model_scores_match_brute_force(spark, monkeypatch):
    texts = language_texts(30)
    fitted, got = fitted_model(spark, sorted(texts.items()), monkeypatch)
    counts = collections.Counter(w.encode() for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split())
    subwords = lm.Subwords(open(MULTI, "rb").read())
    for i, t in texts.items():
        words = [w.encode() for w in t.split()]
        assert got[i] == pytest.approx(brute_log_probability(fitted, subwords, words, counts), rel=1e-3)


def test_language_model_knows_ids_of_all_learning_rows(spark):
    """Two words as frequent as each other are told apart by their neighbours, and classes are those of all texts at once."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    learn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:30]
    texts = {i: "the house and the road " * 4 + "of stone " * 6 + "to paper " * 6 for i in learn}
    texts |= {held[0]: "of stone " * 5, held[1]: "of paper " * 5}
    subwords = lm.Subwords(open(MULTI, "rb").read())
    assert len(subwords.ids(b"stone")) == len(subwords.ids(b"paper")) == 1
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, MULTI).collect()}
    assert abs(got[held[0]] - got[held[1]]) > 0.01

    per_text = [np.array([*(x for w in texts[i].split() for x in subwords.ids(w.encode()).tolist()), subwords.size]) for i in learn]
    ids = np.concatenate(per_text)
    packed = []
    for i, own in zip(learn, per_text):
        n = len(texts[i].split())
        lengths = [len(subwords.ids(w.encode())) for w in texts[i].split()]
        size, raw = lm.pack(np.ones(n, np.int64), np.array(lengths, np.int32), own[:-1].astype(np.uint32))
        packed.append((i, n, size, bytearray(raw)))
    rows = spark.createDataFrame(packed, "doc_id long, n int, size int, packed binary")
    by_id = np.bincount(ids, minlength=subwords.size + 1)
    for ours, brute in zip(lm._classes(rows.repartition(3), by_id, subwords.begins), attention.cluster(ids, subwords.size, subwords.begins)):
        assert (ours == brute).all()


@pytest.mark.parametrize("alike", [False, True])
def test_blocks_number_words_without_a_call_a_word(monkeypatch, alike):
    """Each word keeps its place and bytes, also where words share a hash; the calls made don't grow with the distinct words."""
    if alike:
        monkeypatch.setattr(textscan, "word_hashes", lambda data, starts, ends: ((ends - starts) % 3).astype(np.uint64))
    r = random.Random(3)
    chunks = [[" ".join(str(r.randint(0, 20_000)) for _ in range(n)) for n in (2_000, 0, 3_000)] for _ in range(4)]
    block, calls = wordblocks._Block(), 0
    textscan.distinct(*lm._scan(*textscan.buffer_of(pa.array(["what is imported once"])))[:3])

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        for some in chunks:
            block.add(pa.array(range(len(some))), *textscan.buffer_of(pa.array(some)), lm._scan, None)
        number, bucket, sizes, words, _ = block.close(8)
    finally:
        sys.setprofile(None)
    ends = np.cumsum(sizes).tolist()
    known = [words.tobytes()[e - n : e].decode() for e, n in zip(ends, sizes.tolist())]
    assert len(set(known)) == len(known) and (np.diff(bucket) >= 0).all()
    for some, (_, rows, own, _) in zip(chunks, block.chunks):
        for i, text in enumerate(some):
            assert [known[k] for k in number[own[rows[i] : rows[i + 1]]].tolist()] == text.split()
    assert alike or calls < len(known) / 4


@pytest.mark.parametrize("scale", [1, 30])
def test_attention_scores_in_one_window_match_the_formula(scale):
    """Also where sums over classes and attention are so large that they are clipped."""
    tokens, n = 60, 20
    r = np.random.default_rng(7)
    begins = np.arange(tokens + 1) % 3 == 0
    begins[tokens] = True
    ids = np.append(r.integers(0, tokens, n - 1), tokens)
    group, slot = attention.cluster(np.append(r.integers(0, tokens, 500), tokens), tokens, begins)
    w = {k: v * scale for k, v in attention.start_weights(attention.SLOTS + 2).items()}
    within = np.full(tokens + 1, 0.5)
    logp, starts = attention.log_probabilities(attention.Model(slot, group, within, None, w), ids, np.array([n]))
    x = w["embed"][slot[np.append(tokens, ids[:-1])]].astype(float)
    q, k = x @ w["query"] + w["at_query"][:n], x @ w["key"] + w["at_key"][:n]
    a = np.exp(np.clip(q @ k.T * attention.WIDTH**-0.5, -attention._LIMIT, attention._LIMIT)) * np.tril(np.ones((n, n)))
    plain = (x + a / a.sum(axis=1, keepdims=True) @ (x @ w["value"])) @ w["out"] + w["bias"]
    assert (abs(plain).max() > 60) == (scale > 1)
    z = np.clip(plain, -60, 60)
    total = np.log(np.exp(z).sum(axis=1))
    assert logp == pytest.approx(z[np.arange(n), group[ids]] - total + math.log(0.5), rel=1e-3, abs=1e-3)
    assert starts == pytest.approx(np.log(np.exp(z[:, : attention.STARTS]).sum(axis=1)) - total, rel=1e-3, abs=1e-3)


def test_attention_step_follows_the_gradient(monkeypatch):
    """By finite differences of the loss, and the same step whether windows are computed together or in parts."""
    r = np.random.default_rng(5)
    slots, classes, mask = r.integers(0, attention.SLOTS + 2, (100, attention.WINDOW)).astype(np.int32), r.integers(0, attention.CLASSES, (100, attention.WINDOW)), r.random((100, attention.WINDOW)) < 0.9

    def loss(weights):
        return attention.step({k: v.copy() for k, v in weights.items()}, attention.start_state(weights), slots, classes, mask, 0.0)

    after, state = [], []
    for together in (1000, 7):
        monkeypatch.setattr(attention, "TOGETHER", together)
        after.append(attention.start_weights(attention.SLOTS + 2))
        state.append({k: np.full_like(v, 1e-12) for k, v in after[-1].items()})
        attention.step(after[-1], state[-1], slots, classes, mask, 0.1)
    before = attention.start_weights(attention.SLOTS + 2)
    for name in before:
        assert state[0][name] == pytest.approx(state[1][name], rel=1e-3, abs=1e-10)
        place = np.unravel_index(state[0][name].argmax(), before[name].shape)
        up, down = ({k: v.copy() for k, v in before.items()} for _ in range(2))
        up[name][place] += 0.02
        down[name][place] -= 0.02
        slope = (loss(up) - loss(down)) / 0.04
        assert abs(slope) == pytest.approx(math.sqrt(state[0][name][place]), rel=0.05, abs=2e-5)
        assert (after[0][name][place] < before[name][place]) == (slope > 0)


def test_attention_gives_probabilities():
    """Over all ids the probabilities sum to one, and windows leave no id out."""
    tokens = 40
    begins = np.arange(tokens + 1) % 2 == 0
    begins[tokens] = True
    ids = np.random.default_rng(2).integers(0, tokens, 300)
    ids[[99, 199, 299]] = tokens
    group, slot = attention.cluster(ids, tokens, begins)
    counts = np.bincount(ids, minlength=tokens + 1) + 0.5
    within = counts / np.bincount(group, counts, attention.CLASSES)[group]
    model = attention.Model(slot, group, within, None, attention.start_weights(attention.SLOTS + 2))
    attention.train(model, ids, np.array([100, 100, 100]), 2, 0.1)
    total = 0.0
    for last in range(tokens + 1):
        text = np.append(ids[:60], last)
        logp, _ = attention.log_probabilities(model, text, np.array([61]))
        total += math.exp(logp[-1])
    # classes that no id has keep the rest
    assert 0.8 < total <= 1.0001
    logp, begins_ = attention.log_probabilities(model, ids, np.array([100, 100, 100]))
    assert (logp < 0).all() and (begins_ <= 1e-6).all()


def labelled(n=240):
    """Texts of invented words; one in four has an insult, some with characters between its letters."""
    random.seed(6)
    known = [a + b + c for a in ("ba", "ri", "lo", "ne", "du", "sha", "te") for b in ("ka", "mi", "ro", "ven", "lu") for c in ("", "n", "st", "ra")]
    texts, toxic = [], []
    for i in range(n):
        words = random.choices(known, k=40)
        bad = i % 4 == 0
        if bad:
            words[i % 40] = ["idiot", "moron", "i-d-i-o-t"][i % 3]
        texts.append(" ".join(words))
        toxic.append(float(bad))
    return texts, np.array(toxic)


def test_toxicity_learns_and_tolerates_gaps():
    texts, y = labelled()
    model = toxicity.train(texts, y)
    score = lambda t: float(model.score(*textscan.buffer_of(pa.array([t])))[0])
    assert score("bakan rimi idiot lovenst") > 0.5 and score("bakan m.oron lovenst") > 0.5 and score("bakan i d i o t") > 0.5
    assert score("bakan rimi lovenst neroka") < 0.5 and 0 <= score("") < 0.5


def test_quality_learns():
    texts, y = labelled()
    bad = [" | ".join(t.split()) + " %%%" for t in texts[:120]]
    model = quality.train([*texts[120:], *bad], np.array([1.0] * 120 + [0.0] * 120))
    got = model.score(*textscan.buffer_of(pa.array([texts[0], bad[1]])))
    assert got[0] > 0.5 > got[1]


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, odd, odd_rows, none, operator):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 15)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = operator.classify(odd, labels)
    assert out.count() == len(odd_rows) and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert operator.classify(none, labels).count() == 0
    empty = spark.createDataFrame([], labels.schema)
    assert operator.classify(odd, empty).count() == len(odd_rows)


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_words_that_collide_in_polynomial_hashes(spark):
    """Complementary Thue-Morse words collide modulo 2**64 in any polynomial hash with an odd base."""
    import tiktoken
    from tokenizers import Tokenizer

    s, t = thue_morse(2048), thue_morse(2048, "ba")
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{shared} {s}"), (2, f"{shared} {t}"), (3, s), (4, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    with open(RANKS, "rb") as f:
        encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(docs, RANKS).collect()} == {i: encoder.encode_ordinary(x) for i, x in rows}
    whole = Tokenizer.from_file(WORD)
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.pieces(docs, WORD).collect()} == {
        (i, 0): zlib.crc32(np.array([*whole.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in rows
    }
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(docs).collect()}
    assert out == brute_repeats(rows, 50) and out[2] == (61, 60, t)
    # the same arrangement of words and not of letters
    words = [(i, " ".join(x)) for i, x in ((1, s), (2, t), (3, s[:1024] + t[:1024]))]
    out = substring.remove_repeats(spark.createDataFrame(words, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()} == brute_repeats(words, 50)


def test_distinct_compares_bytes(monkeypatch):
    """Where all words of a length share a hash, they are still told apart."""
    monkeypatch.setattr(textscan, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    random.seed(3)
    words = ["".join(random.choice("ab") for _ in range(random.choice([1, 2, 3, 9, 70]))) for _ in range(400)]
    data, offs = textscan.buffer_of(pa.array([" ".join(words)]))
    starts, ends, _ = textscan.words(data, offs)
    codes, first, _ = textscan.distinct(data, starts, ends)
    assert [words[first[c]] for c in codes] == words and len(first) == len(set(words))


def test_substring_needs_equal_words_at_the_source(spark, monkeypatch):
    """Where hashes of sequences say too little, the words at the source's place decide: nothing goes that differs."""
    plain = textscan.sequence_hashes
    monkeypatch.setattr(textscan, "sequence_hashes", lambda values, starts, ends, seed=0: plain(values * np.uint64(0), starts, ends, seed))
    rows = [(1, " ".join("abcdefgh")), (2, " ".join("hgfedcba")), (3, " ".join("abcdefgh"))]
    spans = spark.createDataFrame([(2, 0, 3, 1, 0), (3, 0, 3, 1, 0)], "doc_id long, lo int, n int, source long, at int")
    monkeypatch.setattr(substring, "repeats", lambda *a, **k: spans)
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 6, 3)
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {1: 0, 2: 0, 3: 8}


def brute_kernel(s, t):
    """The gap-weighted subsequence kernel straight from its sum; a word is [(symbol, place)]."""
    import itertools

    def phi(word):
        out = collections.defaultdict(float)
        for some in itertools.combinations(word, toxicity.ORDER):
            out[tuple(c for c, _ in some)] += toxicity.DECAY ** (some[-1][1] - some[0][1] - (toxicity.ORDER - 1))
        return out

    a, b = phi(s), phi(t)
    return sum(v * b[u] for u, v in a.items() if u in b)


def placed(key):
    out, at = [(-1, 0.0)], 0.0
    for i, c in enumerate(key):
        at += 1 if c else toxicity.MARK
        if c:
            out.append((c, at))
    return [*out, (-2, at + 1)]


def test_subsequence_kernel_matches_brute_force():
    words = ["idiot", "ixdiot", "i-d--iot", "iddiioott", "id", "a", "moron", "inundation", "tiod", "xxidiotxx"]
    keys = [toxicity.symbols_of(w) for w in words]
    group = toxicity.words_of(keys)
    own = np.array([brute_kernel(placed(k), placed(k)) for k in keys])
    for some, grid, gaps in group.groups:
        assert toxicity.self_kernel(grid, gaps) == pytest.approx(own[some], rel=1e-4)
    norm = np.where(own > 0, own, 1) ** (toxicity.SHARP / 2)
    expected = np.array([[brute_kernel(placed(a), placed(b)) for b in keys] for a in keys]) / norm[:, None] / norm[None, :]
    bare = [i for i, w in enumerate(words) if "-" not in w]
    marks = toxicity.words_of([keys[i] for i in bare])
    assert toxicity.kernel(marks, marks) == pytest.approx(expected[np.ix_(bare, bare)], rel=1e-4, abs=1e-5)
    # the landmarks add up to one weight for each subsequence, marks between letters included
    amounts = np.linspace(-1, 2, len(bare))
    model = toxicity.Model(*toxicity.collapsed(marks, amounts), 0.25, 1.0, 0.0)
    assert model.decide(group) == pytest.approx(expected[:, bare] @ amounts + 0.25, rel=1e-3, abs=1e-4)


def test_toxicity_reads_whole_long_words():
    """An insult stands anywhere in a run of characters longer than one window."""
    texts, y = labelled()
    model = toxicity.train(texts, y)
    for at in range(0, 60, 7):
        key = "-" * at + "idiot" + "-" * (90 - at) + "x"
        data, offs = textscan.buffer_of(pa.array([key]))
        symbols, first, last, rows = toxicity._tokens(data, offs)
        assert rows.tolist() == [0, len(first)] and any((symbols[a:b] > 0).sum() >= 5 for a, b in zip(first, last))
    assert (model.worst(*textscan.buffer_of(pa.array(["", "...", "idiot " * 20000]))) >= model.offset).all()


def test_toxicity_tolerates_letters_put_in():
    """Held out of training: letters put in, doubled, or apart by marks, against words of clean texts."""
    texts, y = labelled(400)
    model = toxicity.train(texts, y)
    score = lambda t: float(model.score(*textscan.buffer_of(pa.array([t])))[0])
    forms = [f for w in ("idiot", "moron") for f in ("--".join(w), "-".join(w), w[:2] + "q" + w[2:], w[:3] + "z" + w[3:], "".join(c * 2 for c in w), w + w[-1] * 2, w.upper() + "!!")]
    assert sum(score(f"bakan rimi {f} lovenst") > 0.5 for f in forms) >= 0.9 * len(forms)
    assert sum(score(t) > 0.5 for t, bad in zip(*labelled(60)) if not bad) == 0


def test_factorisation_machine_matches_brute_force():
    """The linear-time identity against the sum over all pairs."""
    texts, _ = labelled(12)
    model = quality.train(texts, np.array([1.0, 0.0] * 6), rounds=2)
    row, feature, value = model.rows(*textscan.buffer_of(pa.array(texts)))
    got = model.raw(row, feature, value)
    for i in range(len(texts)):
        f, x = feature[row == i], value[row == i]
        assert len(set(f.tolist())) == len(f)
        pairs = sum(float(model.v[f[a]].astype(float) @ model.v[f[b]].astype(float)) * x[a] * x[b] for a in range(len(f)) for b in range(a))
        assert got[i] == pytest.approx(model.w0 + float(model.w[f] @ x) + pairs, rel=1e-4, abs=1e-5)


def test_components_of_a_star_whose_centre_is_spread(spark):
    from sievekit.llm.components import connected

    edges = [(5000, i) for i in range(3, 3000)] + [(i, i + 1) for i in range(6000, 6040)] + [(7, None), (9, 9), (2999, 1)] + [(20_000, 5_000_000 + i) for i in range(400)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = {i: 1 for i in [1, 5000, *range(3, 3000)]} | {i: 6000 for i in range(6000, 6041)} | {i: 20_000 for i in [20_000, *range(5_000_000, 5_000_400)]}
    assert got == expected


def test_join_spread_is_a_join(spark):
    from sievekit.llm.common import join_spread

    rows = spark.range(6000).select((F.when(F.col("id") < 2000, 0).when(F.col("id") < 2600, None).otherwise(F.col("id") % 700)).alias("k"), "id")
    found = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    counts = rows.groupBy("k").agg(F.count("*").alias("__n"))
    out = join_spread(rows, found, counts, ["k"], ["id"], 6000)
    assert out.columns == ["k", "id", "twice"] and rows_of(out) == rows_of(rows.join(found, "k"))
