import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from common import clashing
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden.llm import prefixes
from pagewarden.llm.queries import OP11_SQL, op11_prefix_trie

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def rebuilt(frame):
    """Turns of every conversation after the first few are another's."""
    said = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = defaultdict(list)
    for c, turn, role, text, a, b in frame.select("conv_id", "turn", *said, F.xxhash64(*said), F.xxhash64(F.lit(1), *said)).collect():
        if c is not None:
            own[c].append(((turn is not None, turn or 0), a, b, role, text))
    own = {c: [row[3:] for row in sorted(rows)] for c, rows in own.items()}
    out = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(head, [])[:h] + rows[h:]
    return out


def brute(built):
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for prefix, cs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        ended = sorted(c for c in cs if len(built[c]) == len(prefix))
        out.append(
            (
                min(cs),
                len(prefix),
                min(members[prefix[:-1]]) if prefix else None,
                len(cs),
                len(children),
                len(leaves),
                sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest(),
            )
        )
    return sorted(out)


def nodes(frame, **how):
    found = prefixes.trie(*prefixes.regrafted(prefixes.numbered(frame)), **how)
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


def some(seed, n=60):
    """Conversations that share beginnings, whole contents or nothing; odd ids, numbers and texts."""
    rng = random.Random(seed)
    ids = rng.sample([*range(0, 420), *range(-150, 0), 10**15, 10**15 + 1], n)
    rows = []
    for c in ids:
        for turn in range(rng.choice([1, 1, 2, 3, 6, 9, 14])):
            number = rng.choice([turn, turn, turn, None, 2])
            rows.append((c, number, rng.choice(["user", None, ""]), rng.choice(["ab", "ab", "ab", "é🙂", "", None])))
    rows += rng.sample(rows, 5)
    rows += [(None, 1, "user", "of no conversation")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block", [(1, 4), (2, 1), (3, 3), (4, 8)])
def test_against_every_prefix(spark, seed, block, monkeypatch):
    monkeypatch.setattr(prefixes, "STRETCH", 2)
    monkeypatch.setattr(prefixes, "IDS", 3)
    frame = spark.createDataFrame(some(seed), SCHEMA)
    assert nodes(clashing(frame, "depth", "k", "owner", "n"), block=block) == brute(rebuilt(frame))


def test_equal_and_turnless_conversations(spark):
    turnless = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 1][:9]
    equal = [(200 + c, t, "user", f"say {t}") for c in range(40) for t in range(3)]
    frame = spark.createDataFrame([(c, 0, "user", "gone") for c in turnless] + equal, SCHEMA)
    found = nodes(frame)
    assert found == brute(rebuilt(frame))
    assert [row[3] for row in found if row[1] == 0] == [49]


def test_only_turnless_conversations(spark):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 1)
    (root,) = nodes(spark.createDataFrame([(c, 0, "user", "gone")], SCHEMA))
    assert root == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


def test_one_conversation_in_many_files(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(500)] + [(c, 0, "user", "turn 0") for c in range(8, 12)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert nodes(frame) == brute(rebuilt(frame))
        assert {tuple(r) for r in prefixes.numbered(frame).where("conv_id = 7").select("depth").collect()} == {
            (d,) for d in range(1, 501)
        }
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_table(spark):
    assert nodes(spark.createDataFrame([], SCHEMA)) == []


def test_query_agrees_with_its_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    theirs = db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({OP11_SQL})").fetchall()
    mine = [tuple(r[c] for c in COLUMNS) for r in op11_prefix_trie(spark, sf_dir).collect()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)
