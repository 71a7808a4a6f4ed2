"""URLs, tool calls, token counts and the pipeline."""

import collections
import json
from random import Random

import pytest
from pyspark.sql import functions as F

from stayrate.llm import token_counts, tool_calls, url_filter
from tests.conftest import TEST_DATA


def test_hosts_and_rules(spark):
    urls = [
        ("https://WWW.example.com/en/x?a=1", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://blog.example.com/en/", "blog.example.com", "/en/", "example.com/en/", "block"),
        ("http://a.com/", "a.com", "/", "com/", "allow"),
        ("http://a.com", "a.com", "", None, None),
        ("http://b.net/es/1#t", "b.net", "/es/1", "net/es/", "block"),
        ("http://b.net/fr/", "b.net", "/fr/", "net/fr/", "block"),
        ("http://b.net/fr", "b.net", "/fr", None, None),
        ("http://xcom/", "xcom", "/", None, None),
        ("x://y://z.com/", "y:", "//z.com/", None, None),
        ("no scheme", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None),
        ("http://c.org/" + "a" * 30_000, "c.org", "/" + "a" * 30_000, None, None),
    ]
    pages = spark.createDataFrame([(i, u[0], "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    found = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        assert found[i].verdict == verdict if verdict else found[i].verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_trees_learn_labelled_urls(spark):
    urls = [(f"http://h{i}.org/" + ("pills-" * 5 if i % 2 else "page/") + str(i), i % 2) for i in range(400)]
    labelled = spark.createDataFrame(urls[:300], "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    found = url_filter.judge_urls(pages, labelled).where("page_id >= 300").collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in found) >= 95


CALLS = "conv_id string, call_id string, name string, arguments string, depends_on array<string>, at long"


def test_tool_calls(spark):
    tools = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}, "additionalProperties": False}}
    calls = [
        ("c", "2", "add", '{"b": 1, "a": 2.0}', ["1", "9", "2"], 1), ("c", "1", "add", '{"a":1}', None, 5),
        ("c", "1", "add", '{"a":7}', None, 6), ("c", "3", "mul", "{}", ["1"], 0), ("c", "4", "add", None, ["2", "3"], 0),
        ("d", "1", "add", '{"a":"é"}', ["2"], 0), ("d", "2", "add", '{"a":NaN}', ["1"], 1), (None, "1", "add", "[]", None, 0),
    ]
    results = [("c", "1", "y", 9), ("c", "1", 'x "q"', 8), ("d", "5", "lost", 1), ("c", "4", None, 1)]
    found = tool_calls.link_calls(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id string, call_id string, content string, at long"), tools
    )
    rows = {(r.conv_id, r.call_id): r for r in found.collect()}
    order = sorted((r.position, r.call_id) for k, r in rows.items() if k[0] == "c")
    assert [call for _, call in order] == ["1", "3", "2", "4"] and [p for p, _ in order] == [0, 1, 2, 3]
    assert rows["c", "1"].message == '{"arguments":{"a":1},"call_id":"1","name":"add","result":"x \\"q\\""}'
    assert rows["c", "2"].errors == ["$.b: unknown"] and rows["c", "2"].message.startswith('{"arguments":{"a":2,"b":1}')
    status = {k: r.status for k, r in rows.items()}
    assert status == {
        ("c", "1"): "answered", ("c", "2"): "unanswered", ("c", "3"): "unanswered", ("c", "4"): "answered",
        ("d", "1"): "cycle", ("d", "2"): "cycle", ("d", "5"): "orphan", (None, "1"): "unlinked",
    }
    assert rows["c", "3"].errors == ["unknown tool"] and rows["c", "4"].errors == ["not JSON"]
    assert all(json.loads(r.message) for r in rows.values())


def test_every_input_row_is_accounted_for(spark, tmp_path):
    from stayrate.llm import catalogue

    calls = [
        ("c", "1", "f", "{}", None, 0), ("c", "1", "f", '{"a":1}', None, 1), ("c", "1", "f", '{"a":1}', None, 1),
        ("c", "1", "f", "{}", None, 0), ("c", None, "f", "[", None, 2), (None, "3", "f", "{}", None, 0),
    ]
    results = [("c", "1", "x", 3), ("c", "1", "y", 4), ("c", "1", "y", 4), (None, "1", "p", 5), ("c", None, "q", 6), ("c", "8", "o", 1), ("c", "8", "o2", 2)]
    found = tool_calls.link_calls(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id string, call_id string, content string, at long"), {"f": {}}
    ).collect()
    status = collections.Counter(r.status for r in found)
    assert status == {"answered": 1, "duplicate": 6, "unlinked": 4, "orphan": 1}
    messages = [json.loads(r.message) for r in found if r.status == "duplicate"]
    assert sorted(str((m["arguments"], m["result"])) for m in messages) == sorted(
        str(x) for x in [({}, None), ({"a": 1}, None), ({"a": 1}, None), (None, "y"), (None, "y"), (None, "o2")]
    )
    turns = [
        ("k", 0, "system", "s"), ("k", 1, "user", "u"), ("k", 2, "assistant", "a"), ("k", 3, "tool", "t"), ("k", 4, None, "n"),
        ("k", None, "assistant", "lost"), (None, 5, "assistant", "gone"), (None, 1, "user", "u"), ("k", 1, "user", "again"),
    ]
    spark.createDataFrame(turns, "conv_id string, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = catalogue.QUERIES["op1_tool_call_linking"](spark, str(tmp_path)).collect()
    status = collections.Counter(r.status for r in rows)
    assert status == {"unanswered": 1, "answered": 1, "duplicate": 1, "other_role": 2, "unlinked": 3}


def test_topological_positions(spark):
    """Cycles, dependencies on later places, ties and null places, against rounds in Python; a long chain is one wave."""
    random, calls = Random(3), []
    for c in range(40):
        n = random.randint(1, 9)
        for i in range(n):
            deps = [str(random.randrange(n)) for _ in range(random.choice([0, 0, 1, 2]))]
            calls.append((f"c{c}", str(i), "f", "{}", deps, random.choice([None, i, n - i, 3])))
    calls += [("long", str(i), "f", "{}", [str(i - 1), str(i - 2)], i) for i in range(300)]
    none = spark.createDataFrame([], "conv_id string, call_id string, content string, at long")
    rows = tool_calls.link_calls(spark.createDataFrame(calls, CALLS), none, {"f": {}}).collect()
    found = {(r.conv_id, r.call_id): r for r in rows}
    assert len(rows) == len(found) == len(calls)
    for conv in {c[0] for c in calls}:
        deps = {c[1]: set(c[4]) - {c[1]} for c in calls if c[0] == conv}
        deps = {call: of & deps.keys() for call, of in deps.items()}
        done = set()
        while ready := {call for call, of in deps.items() if call not in done and of <= done}:
            done |= ready
        assert {call for call in deps if found[conv, call].status == "cycle"} == deps.keys() - done
        assert sorted(found[conv, call].position for call in done) == list(range(len(done)))
        assert all(found[conv, d].position < found[conv, call].position for call in done for d in deps[call])
    assert all(found["long", str(i)].position == i and found["long", str(i)].wave == 0 for i in range(300))


def test_token_histogram(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    texts = [None, "", "one two three", "one two three", "é" * 300, "x " * 5000]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, length int")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs, path, public_tokenizers.PATTERN))
    with open(path, "rb") as file:
        encoder = token_counts._encoder(file.read(), public_tokenizers.PATTERN)
    lengths = [len(encoder.encode_ordinary(t or "")) for t in texts]
    assert {r.length: r.n_docs for r in sums.collect()} == collections.Counter(lengths)
    for r in sums.collect():
        assert r.truncated_tokens == sum(min(n, r.length) for n in lengths)
        assert r.docs_longer == sum(n > r.length for n in lengths)
    for limit in (0, 2, 100, 10**6):
        assert token_counts.truncated_total(sums, limit).first()[0] == sum(min(n, limit) for n in lengths)
    middle = token_counts.length_quantiles(sums, [0.5]).first()[0]
    assert middle == sorted(lengths)[2]


def test_pipeline(spark):
    import corpus_pipeline

    kept = corpus_pipeline.run(spark, TEST_DATA).collect()
    documents = spark.read.parquet(f"{TEST_DATA}/documents.parquet")
    known = {r.doc_id for r in documents.select("doc_id").collect()}
    assert kept and {r.doc_id for r in kept} <= known
    for shard in {r.shard for r in kept}:
        slots = sorted(r.slot for r in kept if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_stages_judge_rows(spark, tmp_path):
    """Null and repeated ids: each row is kept or dropped for its own text, as brute force has it."""
    import corpus_pipeline
    from stayrate.llm import decontaminate

    text = lambda name, n=30: " ".join(f"{name}{i}" for i in range(n))
    schema = "doc_id long, text string, source string"
    rows = [
        (None, text("a"), "s"), (None, text("b"), "s"), (None, text("b"), "s"), (1, text("c"), "s"), (1, text("c"), "s"),
        (2, text("c"), "t"), (2, text("d"), "t"), (3, text("b"), "t"), (3, text("e"), "t"), (4, "", "t"), (4, "", "t"),
    ]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    # One row per text, of the smallest id; rows without words stay.
    least = {}
    for i, t, _ in rows:
        least[t] = min(least.get(t, (True, 0)), (i is None, i or 0))
    expected = [(None if none else i, t) for t, (none, i) in least.items() if t] + [(4, "")] * 2
    found = corpus_pipeline.drop_near_duplicates(spark, docs, None)
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted(expected, key=str)

    items = spark.createDataFrame([(1, text("a", 20)), (2, text("d", 20))], "item_id long, text string")
    clean = decontaminate.decontaminate(docs, items).collect()
    dirty = {text("a"), text("d")}
    assert sorted(((r.doc_id, r.text) for r in clean), key=str) == sorted(((i, t) for i, t, _ in rows if t not in dirty), key=str)

    mixed = [(None, text(f"m{i}_", 10), "a" if i < 4 else "b" if i < 60 else "c") for i in range(90)] + [(9, text("z"), "b")] * 3
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(mixed, schema).repartition(3)
    taken = collections.Counter(r.source for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect() for _ in r.text.split())
    from stayrate.llm import mixing

    plan = mixing.mix(docs, mixing.quality_weights(labels)).collect()
    assert all(abs(taken[r.source] - r.target) <= 16 for r in plan)


def test_stages_keep_columns_of_any_name(spark):
    """Columns with the names that stages use inside come through unharmed, and decide nothing."""
    import corpus_pipeline

    plain = spark.read.parquet(f"{TEST_DATA}/documents.parquet")
    names = ["times", "most", "n", "nr", "row", "_row", "_again", "_nr", "score", "score_", "doc", "again", "copy"]
    docs = plain.select("*", *(F.concat(F.lit(f"{name}:"), "doc_id").alias(name) for name in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found, expected = stage(spark, docs, TEST_DATA), stage(spark, plain, TEST_DATA)
        assert found.columns == docs.columns, name
        rows = [r.asDict() for r in found.collect()]
        assert all(r[x] == f"{x}:{r['doc_id']}" for r in rows for x in names), name
        assert sorted(r["doc_id"] for r in rows) == sorted(r.doc_id for r in expected.select("doc_id").collect()), name


def test_pipeline_on_empty_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TEST_DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, TEST_DATA).count() == 0, name
