"""Media, fingerprints, token counts, toxicity: against plain Python."""

import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkfall.llm import fingerprint, media, tokencount, toxicity
from inkfall.llm.common import id_text

from .conftest import SMALL


def plain_pairs(payload):
    """(time, code) of all peak pairs, frame by frame and by the definition."""
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 191) for i in range(192)]
    edges, peaks = [1, 17, 33, 49, 65, 81, 97], []
    for at in range(0, len(payload) - 191, 96):
        power = np.abs(np.fft.rfft([(b - 128) * w for b, w in zip(payload[at : at + 192], window)]))
        mean, found = power[1:].mean(), []
        for lo, hi in zip(edges, edges[1:]):
            best = max(range(lo, hi), key=lambda k: power[k])
            if power[best] > 1.2 * mean:
                found.append(best)
        peaks.append(found)
    out = [(t, x << 16 | y << 8) for t, f in enumerate(peaks) for i, x in enumerate(f) for y in f[i + 1 :]]
    out += [(t, x << 16 | y << 8 | gap) for t, f in enumerate(peaks) for gap in (1, 2, 3) if t + gap < len(peaks) for x in f for y in peaks[t + gap]]
    return sorted(out)


def test_media_digests(odd_docs, odd_texts, no_docs):
    got = {r["doc_id"]: r for r in media.media_digests(odd_docs).collect()}
    assert len(got) == len(odd_texts) and media.media_digests(no_docs).count() == 0
    by_text = {}
    for i, text in odd_texts:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest()
        assert by_text.setdefault(text or "", r["feature"]) == r["feature"]
        if len(payload) < 20000:
            pairs = plain_pairs(payload)
            codes, times = [c for _, c in pairs], [t for t, _ in pairs]
            assert (r["codes"], r["times"]) == (codes, times)
            raw = np.array(codes, np.int32).tobytes() + np.array(times, np.int32).tobytes()
            assert r["feature"] == f"{len(codes)}-{len(set(codes))}-{xxhash.xxh3_128_hexdigest(raw)}"
    assert len(set(by_text.values())) > 0.8 * len(by_text)  # blank texts sound alike


@pytest.mark.parametrize("units", [1, 2, 30, 2100])
def test_every_peak_meets_all_peaks_within_reach(units):
    payload = bytes(np.random.default_rng(units).integers(0, 256, media.UNIT * units, dtype=np.uint8))
    top = [[x for x in frame if x >= 0] for frame in media.peaks(np.frombuffer(payload, np.uint8)).tolist()]
    want = [(t, x << 16 | y << 8) for t, frame in enumerate(top) for k, x in enumerate(frame) for y in frame[k + 1 :]]
    want += [(t, x << 16 | y << 8 | gap) for t, frame in enumerate(top) for gap in range(1, media.REACH + 1) if t + gap < len(top) for x in frame for y in top[t + gap]]
    code, time = media.landmarks(payload)
    assert code.dtype == time.dtype == np.int32 and list(zip(time.tolist(), code.tolist())) == sorted(want)


def test_media_round_trip_and_shift(spark):
    payload = bytes(np.random.default_rng(1).integers(0, 256, 192 * 50, dtype=np.uint8))
    assert media.from_wav(media.to_wav(payload)) == payload
    code, time = media.landmarks(payload)
    later, then = media.landmarks(b" " * 192 * 4 + payload)
    pairs, moved = set(zip(code.tolist(), time.tolist())), set(zip(later.tolist(), (then - 8).tolist()))
    assert len(pairs) > 100 and len(pairs & moved) > 0.95 * len(pairs)  # the same sound, 8 frames later
    row = media.media_columns(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert media.from_wav(bytes(row["media"])).startswith(b"abc ") and len(row["codes"]) == len(row["times"])


def test_fingerprints(odd_docs, odd_texts, no_docs):
    got = dict(fingerprint.fingerprints(odd_docs).collect())
    texts = dict(odd_texts)
    for a in texts:
        for b in (0, 3, 8, 9, 12):
            assert (got[a] == got[b]) == (fingerprint.canonical(texts[a] or "") == fingerprint.canonical(texts[b] or ""))
    assert got[0] == got[2] and got[3] == got[4] == got[5] and got[8] == got[9]
    assert fingerprint.fingerprints(no_docs).count() == 0


def test_edited_digests(odd_docs, odd_texts, no_docs):
    got = {r["doc_id"]: r for r in fingerprint.edited_digests(odd_docs).collect()}
    rows = sorted(odd_texts)
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[k - 1][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_next"] == float(fingerprint.canonical(text) == fingerprint.canonical(after))
        assert r["near_edited"] == float(fingerprint.canonical(text) == fingerprint.canonical(edited))
    assert len(got) == len(rows) and fingerprint.edited_digests(no_docs).count() == 0
    one = fingerprint.edited_digests(odd_docs.where("doc_id = 0")).first()
    assert one["near_next"] == 1.0


def test_equal_digests_are_compared_by_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "A ", "b", "c", "c", "a"])], "doc_id long, text string").repartition(3)
    assert fingerprint.collisions(docs).count() == 0
    real = fingerprint.digest
    short = lambda canon: real(b"x" if canon in (b"a", b"b") else canon)  # noqa: E731  a and b collide
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(fingerprint)  # workers get the patched module
    try:
        monkeypatch.setattr(fingerprint, "digest", short)
        got = dict(fingerprint.fingerprints(docs).collect())
    finally:
        cloudpickle.unregister_pickle_by_value(fingerprint)
    assert got[0] == got[1] == got[5] != got[2] and got[3] == got[4] and got[0][:32] == got[2][:32]


@pytest.mark.parametrize("most", [1 << 27, 1 << 10])
def test_many_repeated_digests(spark, monkeypatch, most):
    """By a bitmap, or by a join where they are too many for one."""
    monkeypatch.setattr(fingerprint, "MOST_SLOTS", most)
    docs = spark.createDataFrame([(i, f"Text {i % 700}") for i in range(1000)], "doc_id long, text string").repartition(3)
    repeated = fingerprint.repeated_digests(docs)
    assert repeated.count() == 300 and (fingerprint.slots_of(repeated, 300) is None) == (most < 1 << 16)
    got = dict(fingerprint.fingerprints(docs).collect())
    assert all((got[i] == got[j]) == (i % 700 == j % 700) for i in range(0, 1000, 37) for j in range(1000))


def test_scores_by_the_definition(spark, trained):
    """Scores of texts by their weights, feature by feature."""
    _, _, (at, w, bias) = trained
    weight = dict(zip(at.tolist(), w.tolist()))
    texts = ["", "One two, three!", "the THE the", "é È x", None, "a b c d e f g"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    texts += [r["text"] for r in docs.collect()]
    got = dict(toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), trained[2]).collect())
    for i, text in enumerate(texts):
        places = set(toxicity.features((text or "").encode()).tolist())
        words = [x.strip(toxicity.PUNCTUATION.decode()).lower() for x in (text or "").split()]
        grams = {(a,) for a in words} | set(zip(words, words[1:])) | {(a, None, b) for a, b in zip(words, words[2:])}
        assert len(places) >= 0.99 * len(grams) and len(places) <= len(grams)
        want = 1 / (1 + math.exp(-max(-35, min(35, bias + sum(weight.get(p, 0.0) for p in places)))))
        assert got[i] == pytest.approx(want, abs=1e-5)


def test_one_id_gives_one_row_to_the_fit(spark):
    rows = [(1, "bad bad words"), (2, "fine words")] * 3
    many = rows + [(1, "zz " + str(i)) for i in range(200)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, y int")
    models = [toxicity.fit(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows[:2], many)]
    assert all(np.array_equal(a, b) for a, b in zip(models[0], models[1]))


def test_token_counts(odd_docs, odd_texts, no_docs):
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    path = tokencount.default_vocabulary()
    vocab = tokencount.vocabulary(path)
    assert not any(p in ("<unk>", "<s>", "</s>") for p, _ in vocab)
    exact = Tokenizer(models.Unigram([("\0", tokencount.BYTE_SCORE), *vocab], 0, byte_fallback=True))
    exact.normalizer = normalizers.Replace(Regex("[ \t-\r]+"), " ")
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(odd_docs, path).collect()}
    for i, text in odd_texts:
        bare = (text or "").strip(" \t\n\r\x0b\x0c")
        assert got[i] == (len(exact.encode(bare, add_special_tokens=False).ids) if bare else 0)
    assert tokencount.token_counts(no_docs, path).count() == 0


def test_ranks_become_probabilities():
    import sentencepiece

    path = tokencount.default_vocabulary()
    vocab = dict(tokencount.vocabulary(path))
    pieces = [s for p, s in vocab.items() if s != tokencount.BYTE_SCORE]
    assert sum(math.exp(s) for s in pieces) == pytest.approx(1)
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the quick brown fox jumps over the lazy dog", "internationalization of documents", "Ein kurzer Satz."]
    counter = tokencount.UnigramCounter(list(vocab.items()))
    assert [counter(t.encode())[0] for t in texts[:2]] == [len(own.encode(t)) for t in texts[:2]]
    assert counter(b"x" * 50000)[0] > 0  # one very long word


def test_viterbi_ties_and_unknown():
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("aba", -6.0), ("ba", -4.0), ("c", -1.0), ("cc", -2.0)] + [(f"<0x{i:02X}>", -20.0) for i in range(256)]
    count = tokencount.UnigramCounter(vocab)
    exact = Tokenizer(models.Unigram(vocab, 0, byte_fallback=True))
    for text in ("a", "ab", "aba", "abab", "baba", "ccc", "acb", "xé", "axxb", "éa日", "<0x41>", "cabé"):
        assert count.viterbi(text)[0] == len(exact.encode(text).ids), text


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs, labels, toxicity.fit(id_text(docs), toxicity.training_labels(labels))


def test_toxicity_on_held_out_rows(trained):
    docs, labels, model = trained
    held = toxicity.scored(docs, model).join(labels, "doc_id").where(toxicity.held_out()).select("score", "toxic").collect()
    hit = sum(r["toxic"] and r["score"] >= 0.3 for r in held)
    assert hit / sum(r["score"] >= 0.3 for r in held) > 0.9
    assert hit / sum(r["toxic"] for r in held) > 0.8
    assert 0 < len(model[0]) < 5000


def test_toxicity_of_odd_rows(spark, trained, odd_docs, odd_texts, no_docs):
    model = trained[2]
    got = dict(toxicity.scored(odd_docs, model).collect())
    assert len(got) == len(odd_texts) and all(0 <= s <= 1 for s in got.values())
    assert got[3] == got[4] == got[5]
    kept = toxicity.not_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(s < 0.3 for s in got.values())
    assert toxicity.scored(no_docs, model).count() == 0
    none = toxicity.fit(id_text(no_docs), spark.createDataFrame([], "doc_id long, y int"))
    assert set(dict(toxicity.scored(odd_docs, none).collect()).values()) == {0.5}


def test_ftrl_learns_sparsely():
    rng = np.random.default_rng(0)
    model = toxicity.Ftrl(10, l1=1.0)
    for _ in range(600):
        y = int(rng.random() < 0.5)
        model.learn(np.unique(np.append(rng.integers(100, 1000, 8), [7] if y else [8])).astype(np.int32), y)
    at, w, _ = model.kept()
    weights = dict(zip(at.tolist(), w.tolist()))
    assert weights[7] > 1 and weights[8] < -1 and len(at) < 500


def test_query_columns(spark):
    row = toxicity.op1_toxicity(spark, SMALL).first().asDict()
    assert list(row) == ["doc_id", "held_out", "score", "predicted"]
    assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
    assert media.op2_media_columns(spark, SMALL).where(F.col("n_bytes") > F.col("payload_bytes")).count() == 0
