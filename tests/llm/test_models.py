"""Classifiers: held-out accuracy, the identities and gradients they rest on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starweave.llm import language, quality, toxicity
from starweave.llm.common import crc32_of
from tests.llm import helpers as H

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def _auc(rows):
    order = np.argsort([r["score"] for r in rows], kind="stable")
    rank = np.empty(len(rows))
    rank[order] = np.arange(1, len(rows) + 1)
    y = np.array([r["y"] for r in rows])
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    model = quality.quality_model(docs, labels, crc32_of("doc_id") % 4 != 2)
    rows = quality.score_quality(docs, model, name="score").join(labels, "doc_id").where(crc32_of("doc_id") % 4 == 2).select("score", F.col("quality").alias("y")).collect()
    assert len(rows) > 50 and _auc(rows) > 0.9


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    model = toxicity.toxicity_model(docs, labels, crc32_of("doc_id") % 3 != 1)
    rows = toxicity.score_toxicity(docs, model, name="score").join(labels, "doc_id").where(crc32_of("doc_id") % 3 == 1).select("score", F.col("toxic").alias("y")).collect()
    assert len(rows) > 80 and _auc(rows) > 0.8


def test_language_on_held_out_rows(spark, tables):
    docs, _ = tables
    net = language.language_model(docs, crc32_of("doc_id") % 5 != 0)
    rows = language.predict_language(docs.where(crc32_of("doc_id") % 5 == 0), net).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    odd = language.predict_language(H.frame(spark, [(1, None), (2, ""), (3, "12 34 !!"), (4, "die und der")]), net).collect()
    assert [r["lang_pred"] for r in odd][:3] == ["und"] * 3 and odd[3]["lang_pred"] in net.languages


def test_network_gradients(monkeypatch):
    draw = np.random.default_rng(0)
    monkeypatch.setattr(language, "STRETCH", 5)
    x = draw.integers(0, 256, (3, 5)).astype(np.uint8)
    parts = [draw.normal(0, 0.5, s) for s in ((256, 12), (4, 12), (4, 2))]
    target = draw.normal(0, 1, (5, 3, 2))

    def loss(p):
        logits = np.zeros((5, 3, 2))
        language._run(x.T.copy(), language.Direction(*[a.astype(np.float32) for a in p]), range(5), logits)
        return float((logits * target).sum())

    kept = []
    language._run(x.T.copy(), language.Direction(*[a.astype(np.float32) for a in parts]), range(5), np.zeros((5, 3, 2)), kept)
    grads = language._back(x.T.copy(), language.Direction(*[a.astype(np.float64) for a in parts]), kept, target)
    for i, at in ((0, (x[1, 2], 3)), (0, (x[0, 0], 9)), (1, (2, 5)), (1, (1, 10)), (1, (3, 0)), (2, (1, 1))):
        up, down = [a.copy() for a in parts], [a.copy() for a in parts]
        up[i][at] += 1e-2
        down[i][at] -= 1e-2
        assert grads[i][at] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.03, abs=3e-3)


def test_sum_of_squares_identity():
    draw = np.random.default_rng(1)
    import pyarrow as pa

    from starweave.llm.common import text_bytes

    data, bounds = text_bytes(pa.array(["one two three two", "", "ONE | two\nfour!!", None]))
    x = quality.features(data, bounds)
    size = (1 << quality.BITS) + len(quality.STATISTICS)
    model = quality.Model(0.3, draw.normal(size=size), draw.normal(size=(size, 3)), x.statistics.mean(axis=0), x.statistics.std(axis=0) + 1)
    got = quality._scores(model, x, 4)
    for d in range(4):
        dense = np.clip((x.statistics[d] - model.mean) / model.scale, -4, 4)
        column = np.concatenate([x.column[x.doc == d], (1 << quality.BITS) + np.arange(len(dense))])
        value = np.concatenate([x.value[x.doc == d], dense])
        z = 0.3 + model.weight[column] @ value + sum(
            model.vectors[column[i]] @ model.vectors[column[j]] * value[i] * value[j] for i in range(len(column)) for j in range(i)
        )
        assert got[d] == pytest.approx(z)


def test_grams_do_not_cross_documents():
    import pyarrow as pa

    from starweave.llm.common import text_bytes

    grams = lambda *texts: [b for n in toxicity.gram_buckets(*text_bytes(pa.array(texts))) for b in n[0]]
    assert sorted(grams("Abcdefg", "", "xyz\tuvw")) == sorted(grams("abcdefg") + grams("XYZ uvw"))
    assert len(grams("abcdefg")) == 5 + 4 + 3 + 2


def test_language_probabilities_equal_a_plain_walk(monkeypatch):
    """Byte by byte, with state carried from the start of each window; no byte is labelled twice or not at all."""
    monkeypatch.setattr(language, "LABELLED", 7)
    monkeypatch.setattr(language, "WARM", 3)
    draw, units, names = np.random.default_rng(4), 2, ["a", "b", "c"]
    side = lambda: language.Direction(*[draw.normal(0, 0.7, s).astype(np.float32) for s in ((256, 3 * units), (units, 3 * units), (units, 3))])
    net = language.Network(side(), side(), draw.normal(0, 1, 3).astype(np.float32), names)
    sigmoid = lambda v: (1 + np.tanh(v)) / 2  # noqa: E731  halves are in the weights

    def walk(d, data):
        h, out = np.zeros(units), []
        for byte in data:
            inputs, inner = d.byte[byte], h @ d.hidden
            z, r = sigmoid(inputs[:units] + inner[:units]), sigmoid(inputs[units : 2 * units] + inner[units : 2 * units])
            h = (1 - z) * h + z * np.tanh(inputs[2 * units :] + r * inner[2 * units :])
            out.append(h @ d.out)
        return out

    texts = ["", "x", "seven b", "eight by", "ünï çödé text over some windows, with more of it", "0123456789abcd"]
    data, bounds = language.text_bytes(language.pa.array(texts))
    got = language.document_probabilities(net, data, bounds)
    for text, row in zip(texts, got):
        raw, total, n = text.encode(), np.zeros(3), 0
        for start in range(0, len(raw), 7):
            a = max(start - 3, 0)
            window = (raw[a:] + bytes(30))[: 13] if start + 10 <= len(raw) else raw[a:] + bytes(13 - len(raw[a:]))
            logits = np.array(walk(net.forward, window)) + np.array(walk(net.backward, window[::-1]))[::-1] + net.bias
            p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
            places = range(start - a, min(start + 7, len(raw)) - a)
            total, n = total + p[list(places)].sum(axis=0), n + len(places)
        assert n == len(raw)
        assert row == pytest.approx(total / max(n, 1), abs=1e-5)


def test_toxicity_score_equals_plain_sums(spark):
    """Each distinct n-gram of the lower-cased bytes adds its bucket's weight once."""
    draw = np.random.default_rng(2)
    weight = draw.normal(0, 0.1, 1 << toxicity.BITS).astype(np.float32)
    weight[draw.random(len(weight)) < 0.5] = 0
    texts = ["You are an IDIOT\tidiot", "", None, "ab", "abc", "çé ünï " * 5, "aaaaaaaaaa", "long words " * 2000]

    def bucket(gram):
        key = 0
        for byte in gram:
            key = (key * 0x01000193 + (32 if 9 <= byte <= 13 else byte + 32 if 65 <= byte <= 90 else byte) + 1) % (1 << 32)
        key = ((key ^ (key >> 15)) * 0x85EBCA6B + len(gram) * 0x27D4EB2F) % (1 << 32)
        return (key * 0xC2B2AE35 % (1 << 32)) >> (32 - toxicity.BITS)

    scored = toxicity.score_toxicity(H.frame(spark, list(enumerate(texts))), toxicity.Model(weight, -0.3))
    for r in scored.collect():
        raw = (r["text"] or "").encode()
        found = {bucket(raw[i : i + n]) for n in toxicity.LENGTHS for i in range(len(raw) - n + 1)}
        assert r["score"] == pytest.approx(1 / (1 + np.exp(0.3 - sum(float(weight[b]) for b in found))), abs=1e-6)


def test_log_count_ratios_and_significance(spark):
    """Weighted n-grams are just those whose shares in the classes differ significantly; ratios have the sign of the difference."""
    rows = [(i, ("common words " + ("vile" if i % 3 == 0 else "fine") + f" {i % 7}")) for i in range(120)]
    sample = H.frame(spark, rows).select("text", (F.col("doc_id") % 3 == 0).cast("int").alias("y"))
    model = toxicity.train(sample)
    import pyarrow as pa

    from starweave.llm.common import text_bytes

    buckets = lambda t: {int(b) for n in toxicity.gram_buckets(*text_bytes(pa.array([t]))) for b in n[0]}
    assert all(model.weight[b] > 0 for b in buckets("vile")) and all(model.weight[b] < 0 for b in buckets("fine"))
    assert not any(model.weight[b] for b in buckets("common words"))


def test_nothing_to_learn_from(spark):
    docs = H.frame(spark, [(1, "a text"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert all(0 <= r["s"] < 0.5 for r in toxicity.score_toxicity(docs, toxicity.toxicity_model(docs, labels), name="s").collect())
        assert all(0 <= r["s"] <= 1 for r in quality.score_quality(docs, quality.quality_model(docs, labels), name="s").collect())
    assert language.language_model(docs.where("doc_id > 5")) is None
    assert [r["lang_pred"] for r in language.predict_language(docs, None).collect()] == ["und", "und"]
