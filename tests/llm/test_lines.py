import hashlib
from collections import defaultdict

import duckdb
from common import clashing, documents, odd

from pagewarden.llm import lines
from pagewarden.llm.queries import OP8_SQL, op8_line_dedup

SHARED = "  This very line is shared by many of the documents here \t"


def brute(rows, least_chars=40, least_documents=5):
    """Text after dropping and counts, row by row."""

    def key(line):
        bare = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in bare)

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars and doc_id is not None:
                holders[key(line)].add(doc_id)
    shared = {k: max(v) for k, v in holders.items() if len(v) >= least_documents}
    out = []
    for doc_id, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if key(p) not in shared or doc_id is None or shared[key(p)] == doc_id]
        out.append((doc_id, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def spark_rows(frame, **how):
    dropped = lines.drop_shared_lines(frame, **how)
    return sorted(
        ((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in dropped.collect()), key=repr
    )


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_odd_texts(spark):
    frame = odd(spark)
    assert spark_rows(frame) == brute(pairs(frame))


def test_shared_lines(spark):
    other = "Another LINE, of forty characters and some more é"
    texts = [f"{SHARED}\nown {i}\n{other}\n{SHARED.upper()}" for i in range(4)]
    texts += [SHARED, f"{other.lower()}\n", f"x\n{SHARED.strip()}\ny\n", "\n".join([SHARED] * 200), None, ""]
    frame = documents(spark, texts)
    assert spark_rows(frame) == brute(pairs(frame))
    few = documents(spark, texts[:4])
    assert spark_rows(few) == brute(pairs(few))


def test_repeated_and_missing_ids(spark):
    texts = [f"{SHARED}\n{i}" for i in range(7)]
    frame = documents(spark, texts, [1, 1, 2, 3, 4, 4, None])
    assert spark_rows(frame) == brute(pairs(frame))
    frame = documents(spark, texts, [1, 1, 2, 3, 4, 5, None])
    assert spark_rows(frame) == brute(pairs(frame))


def test_many_lines_and_words_of_the_bitmap(spark):
    long = "\n".join(f"Line number {i % 97} that others have as well, word for word" for i in range(300))
    frame = documents(spark, [long + f"\n{i}" for i in range(6)])
    assert spark_rows(frame) == brute(pairs(frame))
    drops = lines.drop_bitmaps(frame).collect()
    assert len(drops) == 5 and all(len(r["drops"]) == 5 for r in drops)


def test_clashing_columns_and_empty_table(spark):
    frame = clashing(documents(spark, [SHARED] * 6), "row", "drops", "n_lines", "bits", "mine", "h1", "word")
    rows = lines.drop_shared_lines(frame).collect()
    assert [r["n_dropped"] for r in rows].count(1) == 5 and {r["row"] for r in rows} == {"extra row"}
    assert lines.drop_shared_lines(frame.limit(0)).count() == 0


def test_plan_is_native(spark, monkeypatch):
    plans = []

    def kept(frame, label):
        plans.append(frame._jdf.queryExecution().toString())
        return frame

    monkeypatch.setattr(lines, "written", kept)
    plans.append(op8_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString())
    assert not any("Python" in plan or "Arrow" in plan for plan in plans)
    ranged = plans[1][plans[1].index("Physical Plan") :]
    assert ranged.count("rangepartitioning") == 1 and "hashpartitioning" not in ranged


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = pairs(spark.read.parquet(f"{folder}/documents.parquet"))
    want = [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in brute(rows)]
    found = op8_line_dedup(spark, folder).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    theirs = db.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({OP8_SQL})").fetchall()
    assert sorted(theirs, key=repr) == sorted(want, key=repr)
