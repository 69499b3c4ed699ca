import random
from fractions import Fraction

import test_lines
import test_minhash
from common import documents

import corpus_pipeline
from pagewarden.llm import language, mixing
from pagewarden.llm.queries import table, vocabulary

FOLDER = "/root/testdata/sf0.01"


def test_the_order_of_the_mix_reaches_the_result(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    path = str(tmp_path / "mixed")
    corpus_pipeline.mix_sources(spark, docs, FOLDER).repartition(7).write.parquet(path)
    coded = corpus_pipeline.encode(spark, spark.read.parquet(path), FOLDER)
    rows = coded.select("doc_id", "source", "n_tokens", "slot", "place").collect()
    assert len(rows) == docs.count() and len({(r["slot"], r["place"]) for r in rows}) == len(rows)
    rows.sort(key=lambda r: (r["slot"], r["place"]))
    mixed = mixing.mix(docs).orderBy("slot", "place").collect()
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in mixed]
    # Each source is within a block of its weight until it ends.
    sizes = {}
    for r in mixed:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"] or "")
    weights = {name: Fraction(max(1.0, size**0.5)) for name, size in sizes.items()}
    block = {(r["source"], r["slot"]): r["block"] for r in mixed}
    assert len(block) > len(sizes)
    for source, slot in {(r["source"], r["slot"]) for r in rows}:
        share = weights[source] / sum(weights.values())
        nth = block[source, slot]
        assert abs(share * slot - nth) < 1 and abs(share * (slot + 1) - (nth + 1)) < 1


def test_run_matches_a_walk(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    shared = "This line of more than forty characters stands in many documents"
    bodies = [" ".join(word() for _ in range(60)) for _ in range(20)]
    texts = [f"{b}\n{shared}" if n < 12 else b for n, b in enumerate(bodies)]
    texts += [*bodies[:6], None, "", "1234 5678 !", "ab", bodies[7] + " more"]
    frame = documents(spark, texts).selectExpr("doc_id", "text", "'xx' AS lang", "source", "n_chars")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    left = [(i, t) for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    left = [(i, t) for i, _, _, t in test_lines.brute(left)]
    left = dict(left)
    firsts = {i for i, kind in test_minhash.brute(list(left.items())) if i == kind}
    spelled = {rank: token for token, rank in vocabulary().items()}

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: b"".join(spelled[i] for i in r["ids"]).decode() for r in rows} == {
        i: left[i] for i in firsts
    }
    assert len(rows) == len(firsts) < len(left) < len(texts)
    assert all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_a_low_score_drops_no_document(spark, monkeypatch):
    frame = documents(spark, ["some text", "other text", "77", None])
    low = lambda docs: docs.selectExpr("*", "IF(text RLIKE '[a-z]', 'xx', 'und') AS lang_pred", "0.06D AS score")
    monkeypatch.setattr(language, "identify", low)
    kept = corpus_pipeline.keep_languages(spark, frame, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1] and kept.columns == frame.columns
