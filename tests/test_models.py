import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagewarden.constants import (
    BEDROCK_MODELS,
    ENRICH_FAILED,
    NO_ANSWER,
    OPENAI_MODELS,
    PLACEHOLDER_CONTENT,
    QUERY_FAILED,
    SUMMARY_QUESTION,
)
from pagewarden.functions.prompts import context_text, fill, message_list, prompt_template
from pagewarden.operators.chat import clear_sessions, latest_messages, message_rows, session_info
from pagewarden.operators.models import (
    complete_with,
    describe_with,
    embed_with,
    refuse_warned,
)
from pagewarden.operators.routing import model_catalogue, model_settings, route
from pagewarden.plans.ask import answer, prompts, retrieve, summarise
from pagewarden.plans.ingest import index_records
from pagewarden.schema import DENSE_VECTOR
from pagewarden.operators.index import PageIndex
from pagewarden.sources.pages import split_pages


# Workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _failing_sometimes():
    tries = {}

    def client(prompt):
        tries[prompt] = tries.get(prompt, 0) + 1
        if "never" in prompt or ("later" in prompt and tries[prompt] < 3):
            raise TimeoutError("slow")
        return prompt.upper()

    return client


def test_a_failing_call_costs_no_row(spark):
    df = spark.createDataFrame([("fine",), ("later",), ("never",)], "p string")
    rows = complete_with(df, _failing_sometimes, "p", "r", "gone", partitions=2).collect()
    assert {r["p"]: r["r"] for r in rows} == {"fine": "FINE", "later": "LATER", "never": "gone"}


def _echo_client():
    def client(prompt):
        if "bad page" in prompt:
            raise ValueError
        return prompt

    return client


def test_describing_with_a_model(spark):
    pages = spark.createDataFrame(
        [("u", "f", "good page"), ("u", "g", "bad page")], "unique_id string, file_path string, text string"
    )
    got = {r["file_path"]: r["llm_generated"] for r in describe_with(pages, _echo_client).collect()}
    assert '{"unique_id":"u","file_path":"f"}' in got["f"] and "good page" in got["f"]
    assert got["g"] == ENRICH_FAILED


def test_warned_pages_are_refused(spark):
    pages = spark.createDataFrame([("a", None), ("b", ""), ("c", "x (PERSON)")], "f string, pii_warning string")
    kept, refused = refuse_warned(pages)
    assert {r["f"] for r in kept.collect()} == {"a", "b"}
    assert "x (PERSON)" in refused.first()["error"]


def _embedder():
    def embed(texts):
        if any(t is None or "bad" in t for t in texts):
            raise ValueError
        return [[float(len(t)), 1.0] if t != "none" else None for t in texts]

    return embed


def test_embedding_with_a_model(spark):
    df = spark.createDataFrame([("abc",), ("bad",), ("none",), (None,)], "t string").coalesce(1)
    got = {r["t"]: r["v"] for r in embed_with(df, _embedder, "t", "v", 2).collect()}
    assert got == {"abc": [3.0, 1.0], "bad": [0.0, 0.0], "none": [0.0, 0.0], None: [0.0, 0.0]}


def test_dense_index_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame(
        [("u", "f", "abc"), ("u", "g", ""), ("v", "h", "abcdef")], "unique_id string, file_path string, text string"
    )

    def embed(df, column, name="text_embedding"):
        return embed_with(df, _embedder, column, name, 2)

    index = PageIndex(spark, str(tmp_path / "dense"), DENSE_VECTOR)
    index.append(index_records(split_pages(docs), embedder=embed))
    asked = spark.createDataFrame([(1, "xyz")], "question_id int, question string")
    hits = retrieve(index.read(), asked, 2, embedder=embed, dim=2).orderBy("rank").collect()
    assert [(h["file_path"], h["score"]) for h in hits][0] == ("f", 2.0)
    assert index.read().where("file_path = 'g'").first()["llm_generated"] == PLACEHOLDER_CONTENT


def test_fill_takes_braces_in_values_as_text(spark):
    df = spark.createDataFrame([("{b}", 7)], "a string, b int")
    got = df.select(fill("{a}-{b}-{c}", a=F.col("a"), b=F.col("b"))).first()[0]
    assert got == "{b}-7-{c}"


def test_messages(spark):
    df = spark.createDataFrame(
        [("now", [("User", "a"), ("assistant", "b"), ("tool", "c")]), ("alone", None)],
        "m string, h array<struct<role:string,content:string>>",
    )
    rows = df.select(message_list(F.col("m"), F.lit("sys"), F.col("h")).alias("l")).collect()
    assert [tuple(x) for x in rows[0]["l"]] == [("system", "sys"), ("user", "a"), ("assistant", "b"), ("user", "now")]
    assert [tuple(x) for x in rows[1]["l"]] == [("system", "sys"), ("user", "alone")]
    no_system = df.select(message_list(F.col("m"), F.lit("")).alias("l")).first()["l"]
    assert [tuple(x) for x in no_system] == [("user", "now")]
    filled = df.select(
        prompt_template("{x} and {y}", {"x": F.lit(1), "y": F.lit("two")}, F.col("m"), F.col("h")).alias("l")
    ).first()["l"]
    assert tuple(filled[0]) == ("system", "1 and two") and len(filled) == 4


def test_message_rows(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "assistant", "d"), (2, 0, "assistant", "e")],
        "conv_id long, turn long, role string, text string",
    )
    rows = message_rows(turns, "be kind").orderBy("conv_id", "turn").collect()
    assert [(r["role"], r["content"], r["is_current"]) for r in rows] == [
        ("system", "be kind", False), ("user", "a", False), ("assistant", "b", False), ("user", "c", True),
    ]
    assert message_rows(turns).count() == 3


def test_the_whole_history_is_kept(spark):
    turns = spark.createDataFrame(
        [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(1, 13)]
        + [(1, 0, "system", "s"), (2, 0, "user", "alone"), (3, 0, "assistant", "e")],
        "conv_id long, turn long, role string, text string",
    )
    rows = {r["conv_id"]: r for r in latest_messages(turns).collect()}
    assert sorted(rows) == [1, 2]
    assert (rows[1]["turn"], rows[1]["text"]) == (11, "t11")
    assert [m["content"] for m in rows[1]["history"]] == [f"t{t}" for t in range(1, 11)]
    assert (rows[2]["text"], rows[2]["history"]) == ("alone", [])


def test_context_defaults(spark):
    df = spark.createDataFrame(
        [([("f", "page_1", "text"), (None, None, None)],), ([],)],
        "hits array<struct<file_path:string,page_number:string,llm_generated:string>>",
    )
    rows = [r[0] for r in df.select(context_text(F.col("hits"))).collect()]
    assert rows[0] == (
        "\nDocument 1:\nSource: f\nPage: page_1\nContent: text\n"
        "\nDocument 2:\nSource: Unknown\nPage: Unknown\nContent: \n"
    )
    assert rows[1] == ""


@pytest.fixture(scope="module")
def records(spark):
    docs = spark.createDataFrame(
        [("a", "f", "red apples grow"), ("a", "g", "green pears"), ("b", "h", "red wine")],
        "unique_id string, file_path string, text string",
    )
    return index_records(split_pages(docs))


def test_answers(spark, records):
    asked = spark.createDataFrame(
        [(1, "red wine", ["a", "b"]), (2, "red wine", ["a"]), (3, "red wine", ["nobody"]), (4, "x", [])],
        "question_id int, question string, unique_ids array<string>",
    )
    hits = retrieve(records, asked, 1)
    got = {r["question_id"]: r["answer"] for r in answer(asked, hits).collect()}
    assert got == {1: "red wine", 2: "red apples grow", 3: NO_ANSWER, 4: NO_ANSWER}
    assert prompts(asked, hits).where("question_id = 1").first()["prompt"].count("red wine") == 2


def _angry_client():
    def client(prompt):
        raise RuntimeError

    return client


def test_answer_from_a_failing_model(spark, records):
    asked = spark.createDataFrame([(1, "red")], "question_id int, question string")
    assert answer(asked, retrieve(records, asked), _angry_client).first()["answer"] == QUERY_FAILED


def test_summaries_see_only_their_tenant(spark, records):
    requests = spark.createDataFrame([("x", ["a"]), ("y", ["b"])], "question_id string, unique_ids array<string>")
    got = {r["question_id"]: r for r in summarise(records, requests).collect()}
    assert "red wine" not in got["x"]["context"] and "red wine" in got["y"]["context"]
    assert SUMMARY_QUESTION in got["x"]["prompt"]


def test_catalogue_and_routing(spark):
    catalogue = model_catalogue(spark)
    rows = catalogue.orderBy("position").collect()
    assert len(rows) == len(BEDROCK_MODELS) + len(OPENAI_MODELS) == 40
    assert [r["position"] for r in rows if r["is_default"]] == [12]
    assert {"gpt-o1-mini", "gpt-o1-pro"} <= {r["model_id"] for r in rows}
    wanted = spark.createDataFrame([("gpt-4o",), (BEDROCK_MODELS[0],), ("us.amazon.nova-pro-v1:0",), ("x",), (None,)], "model_id string")
    routed, refused = route(wanted, catalogue)
    assert {(r["provider"], r["limit_key"]) for r in routed.collect()} == {
        ("openai", "max_tokens"), ("bedrock", "max_tokens"), ("bedrock", "maxTokenCount"),
    }
    assert {r["error"] for r in refused.collect()} == {"Unsupported model: x", "Model ID must be provided"}
    assert route(wanted, catalogue, "gpt-4")[1].count() == 1


def test_model_settings(spark):
    df = spark.createDataFrame([("us.amazon.nova-pro-v1:0",), ("gpt-4o",)], "m string")
    rows = [r[0] for r in df.select(model_settings(F.col("m"), 500)).collect()]
    assert rows == [{"temperature": 0.7, "maxTokenCount": 500.0}, {"temperature": 0.7, "max_tokens": 500.0}]
    assert df.select(model_settings(F.col("m"))).first()[0] == {"temperature": 0.7}


def test_sessions(spark):
    messages = spark.createDataFrame([("s",), ("s",), ("t",)], "session string")
    uploads = spark.createDataFrame([("t",), ("u",)], "session string")
    got = {tuple(r) for r in session_info(messages, uploads).collect()}
    assert got == {("s", 2, 0), ("t", 1, 1), ("u", 0, 1)}
    assert clear_sessions(messages, uploads).count() == 2


def test_hung_calls_hold_up_no_others(spark):
    def load():
        import time

        def client(text):
            if "hang" in text:
                time.sleep(60)
            return f"re: {text}"

        return client

    prompts = [f"hang {i}" for i in range(8)] + [f"ask {i}" for i in range(6)]
    frame = spark.createDataFrame([(p,) for p in prompts], "prompt string").coalesce(1)
    started = time.time()
    done = complete_with(frame, load, "prompt", "reply", "none", tries=1, timeout=2, error="problem").collect()
    assert time.time() - started < 20
    assert sum(r["reply"].startswith("re:") for r in done) == 6
    assert {r["problem"] is None for r in done if r["reply"] != "none"} == {True}
    assert {r["problem"] for r in done if r["reply"] == "none"} == {"TimeoutError: no reply in time"}


def test_equal_prompts_are_called_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def load():
        def client(text):
            with open(log, "a") as calls:
                calls.write(text + "\n")
            if text == "fails":
                raise ValueError("no")
            return text.upper()

        return client

    frame = spark.createDataFrame([("a",), ("b",), ("a",), ("fails",), ("a",)], "prompt string").coalesce(1)
    done = complete_with(frame, load, "prompt", "reply", "none", tries=2, error="problem").collect()
    assert [r["reply"] for r in done] == ["A", "B", "A", "none", "A"]
    assert done[3]["problem"] == "ValueError: no"
    assert sorted(open(log).read().split()) == ["a", "b", "fails", "fails"]
