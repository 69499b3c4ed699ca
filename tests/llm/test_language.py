import numpy as np
import pytest
from common import DOCS, clashing, documents, odd

from pagewarden.llm import language
from pagewarden.llm.queries import op10_language, table


def test_gradients_match_differences():
    network = language.Network(["a", "b", "c"], 4, 3)
    for w in network.weights():
        w *= 0.3
    rng = np.random.default_rng(1)
    data, label = rng.integers(60, 120, (6, 5)), rng.integers(0, 3, 5)

    def loss():
        forth = network.forth.run(data)[0]
        hence = network.hence.run(data[::-1])[0][::-1]
        p = network._odds(forth, hence).astype(np.float64)
        p /= p.sum(axis=1, keepdims=True)
        return -np.log(p[:, label, np.arange(5)]).mean()

    for w, g in zip(network.weights(), network.learn(data, label)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = w[at].copy()
        w[at] = before + np.float32(1e-2)
        up = loss()
        w[at] = before - np.float32(1e-2)
        assert abs((up - loss()) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3
        w[at] = before


def test_filling_has_no_part_in_the_gradients():
    network = language.Network(["a", "b"], 4, 3)
    rng = np.random.default_rng(2)
    data, label = rng.integers(60, 120, (6, 5)), rng.integers(0, 2, 5)
    filled = np.concatenate((data, np.full((9, 5), language.OUTSIDE)))
    for g, h in zip(network.learn(data, label), network.learn(filled, label)):
        assert np.allclose(g, h, atol=1e-5)


def test_short_texts_are_learnt_from(spark):
    texts = ["the and of that with", "der und das nicht mit"] * 60
    rows = [(i, t, "de" if i % 2 else "en", None, None) for i, t in enumerate(texts)]
    found = language.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) == 1
    # One language with short texts only beside one with long ones.
    mixed = ["the and of that with " * 20, "der und das nicht mit"] * 30
    network = language.train(mixed, ["en", "de"] * 30, epochs=8)
    short = np.frombuffer(b"der und das nicht mit", np.uint8)
    assert language._predict_rows(network, short, np.array([0, len(short)]))[0].argmax() == 0


def test_twenty_languages(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüßéèñçåø"))
    words = [["".join(rng.choice(letters, rng.integers(2, 9), p=w)) for _ in range(200)] for w in rng.dirichlet(np.full(len(letters), 0.7), 20)]
    rows = [(i, " ".join(rng.choice(words[i % 20], 40)), f"l{i % 20:02}", None, None) for i in range(2400)]
    found = language.identify(spark.createDataFrame(rows, DOCS)).where("held_out").collect()
    assert len(found) > 600 and np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.95


def test_held_out_rule(spark):
    frame = documents(spark, ["x"] * 50)
    rows = frame.select("doc_id", language.held_out("doc_id").alias("h")).collect()
    assert all(r["h"] == language.is_held_out(r["doc_id"]) for r in rows)


def test_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = table(spark, folder, "documents").select("doc_id", "lang")
    rows = op10_language(spark, folder).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def network():
    texts = ["the and of that with " * 20, "der und das nicht mit " * 20] * 30
    return language.train(texts, ["en", "de"] * 30, epochs=8)


def test_odd_texts(spark, network):
    frame = clashing(odd(spark), "found", "score", "lang_pred")
    rows = language.predict(frame, network).collect()
    assert len(rows) == frame.count()
    for row in rows:
        letters = any(c.isalpha() for c in row["text"] or "")
        assert (row["lang_pred"] == "und") == (not letters)
        assert 0 <= row["score"] <= 1 and row["found"] == "extra found"
    assert language.predict(frame.limit(0), network).count() == 0


def test_nothing_to_learn_from(spark):
    rows = language.identify(odd(spark)).collect()
    assert {r["lang_pred"] for r in rows} == {"und"} and {r["score"] for r in rows} == {0.0}


def test_pieces_do_not_change_the_result(network, monkeypatch):
    texts = [b"the and of that with " * 300, b"der und", b"", b"nicht mit " * 77]
    offsets = np.cumsum([0, *map(len, texts)])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    whole = language._predict_rows(network, buf, offsets)
    monkeypatch.setattr(language, "GROUP_BYTES", 400)
    assert np.allclose(language._predict_rows(network, buf, offsets), whole, atol=1e-5)
    one = language._predict_rows(network, np.frombuffer(texts[3], np.uint8), np.array([0, len(texts[3])]))
    assert np.allclose(one[0], whole[3], atol=1e-5)
