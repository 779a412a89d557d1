"""Archives, traces, versioned folders, message operators, declarative pipelines and streams."""

import json

import pytest
from pyspark.sql import functions as F

from sparkact.catalog import Catalog
from sparkact.functions import text as tx
from sparkact.operators import messages as msg
from sparkact.plans.pipeline import Pipeline
from sparkact.sources.archive import archive_messages, safe_member, trace_lines
from sparkact.streaming import windows


def archive(path, version="1.0"):
    rows = [{"id": "m1", "type": "text", "sender": "a", "createdAt": "2024-01-01T00:00:01Z", "text": "hello"}, {"type": "system", "sender": "b", "createdAt": "2024-01-01T00:00:02Z"}]
    path.write_text(json.dumps({"schemaVersion": version, "exportId": "e", "account": {"stableId": "acc"}, "conversation": {"stableId": "conv"}, "messages": rows}))
    return str(path)


def test_archive(spark, tmp_path):
    got = archive_messages(spark, [archive(tmp_path / "m.json")]).orderBy("source_ordinal").collect()
    assert [(r.message_id, r.kind, r.created_at_ms, r.content) for r in got] == [("m1", "text", 1704067201000, "hello"), (None, "system", 1704067202000, None)]
    with pytest.raises(Exception, match="unsupported schema version"):
        archive_messages(spark, [archive(tmp_path / "n.json", "9")]).collect()
    assert safe_member("a/b.json") and not any(map(safe_member, ["", "/a", "../a", "a/../b", "C:/a"]))


def test_trace_drops_only_a_cut_tail(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"eventId": "1"}\n{"eventId": "2"}\n{"eventI')
    assert sorted(r.eventId for r in trace_lines(spark, str(tmp_path / "t.jsonl"), "eventId string").collect()) == ["1", "2"]
    (tmp_path / "u.jsonl").write_text('{"eventId": "1"}\n{"even\n{"eventId": "3"}\n')
    with pytest.raises(Exception, match="damaged trace line"):
        trace_lines(spark, str(tmp_path / "u.jsonl"), "eventId string").collect()


def chat(spark, *rows):
    return spark.createDataFrame([(1, i, t, c) for i, (t, c) in enumerate(rows)], "conversation long, ordinal long, created_at_ms long, content string")


def test_chunks_do_not_overlap_across_a_gap(spark):
    got = msg.chunks(chat(spark, (0, "a"), (1, "b"), (4_000_000, "c"))).orderBy("chunk_index").collect()
    assert [(r.first_ordinal, r.last_ordinal, r.messages) for r in got] == [(0, 1, 2), (2, 2, 1)]


def test_chunks_overlap_after_a_split_by_size(spark):
    got = msg.chunks(chat(spark, *[(i, "x" * 100) for i in range(8)])).orderBy("chunk_index").collect()
    assert all(r.bytes <= 512 for r in got) and got[1].first_ordinal == got[0].last_ordinal - 1
    again = msg.chunks(chat(spark, *[(i, "x" * 100) for i in range(8)]).repartition(3)).orderBy("chunk_index").collect()
    assert again == got


def test_versions(spark):
    got = msg.versions(chat(spark, (1, "a"), (2, "b"), (3, "a")), ["conversation"]).orderBy("version").collect()
    assert [(r.first_ms, r.copies, r.version) for r in got] == [(1, 2, 1), (2, 1, 2)]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "t"))
    assert c.current() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert c.publish(rows, 1) == 1
    assert c.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"], 2) == 2
    assert c.upsert(rows, ["k"], 2) == 2  # run again: nothing changes
    assert sorted(map(tuple, c.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert c.read(1).count() == 2
    with pytest.raises(ValueError):
        c.publish(rows, 3, lambda df: False)
    assert c.current() == 2
    twice = spark.createDataFrame([(3, "x"), (3, "z"), (3, "y")], "k int, v string")
    c.upsert(twice, ["k"], 3)
    assert sorted(map(tuple, c.read().collect())) == [(1, "a"), (2, "c"), (3, "z")]


def test_second_writer_of_a_version_leaves_the_first_ones_rows(spark, tmp_path):
    a, b = (Catalog(spark, str(tmp_path / "t")) for _ in range(2))
    first, second = (spark.createDataFrame([(x,)], "v string") for x in "ab")
    with pytest.raises(RuntimeError):
        a.publish(first, 1, lambda df: bool(b.publish(second, 1)))
    assert [r.v for r in a.read().collect()] == ["b"]


def test_helper_columns_do_not_clash(spark):
    from sparkact.functions import privacy
    from sparkact.operators import messages, retrieval

    a = spark.createDataFrame([(1, "x", "x", "x y", 5)], "_row int, _action string, _w string, text string, _new int")
    assert retrieval.keyword_scores(a, ["y"]).select("_w", "score").collect() == [("x", 45)]
    assert privacy.applied(a, F.lit("record"), ["text"]).collect() == a.collect()
    assert messages.latest_wins(a, a, ["text"], "_new").collect() == a.collect()
    assert messages.winners(a, ["_row"], ["_new"], ["_w"]).collect() == [(1, "x")]


def test_pipeline(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), ("c", 9)], "k string, v int")
    p = Pipeline([
        {"kind": "filter", "where": {"any": [{"field": "k", "op": "in", "value": ["a", "b"]}, {"field": "v", "op": "gt", "value": 100}]}},
        {"kind": "aggregate", "by": ["k"], "metrics": [{"metric": "sum", "field": "v", "as": "s"}, {"metric": "count", "as": "n"}]},
        {"kind": "sort", "by": ["-s"]}, {"kind": "limit", "n": 1}, {"kind": "select", "columns": ["k", "s", "n"]},
    ])
    assert [tuple(r) for r in p.apply(df).collect()] == [("a", 6, 2)]
    with pytest.raises(ValueError):
        Pipeline([{"kind": "filter", "where": {"field": "k", "op": "like", "value": "a"}}]).apply(df)


def test_text_functions(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]
    assert one(tx.redacted, "mail a.b@c.org card 4111111111111111 ip 10.0.0.1") == "mail [email] card [card] ip [ip]"
    assert one(tx.html_text, "<p>a &amp; b</p><script>x</script><p>c</p>").strip() == "a & b\nc"
    assert one(tx.host, "https://Sub.Example.org:80/x?y") == "sub.example.org"
    assert one(tx.suffixes, "a.b.c") == ["a.b.c", "b.c", "c"]


def test_stream_of_hours(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "view", 1.5), ("2024-01-01 00:20:00", "view", 2.5), ("2024-01-01 01:10:00", "view", 3.0), ("2024-01-01 05:00:00", "click", 1.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts string, event_type string, value double").json(str(tmp_path / "in"))
    q = windows.hourly(stream).writeStream.outputMode("append").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.hour.hour, r.event_type, r.n, r.seconds) for r in spark.sql("SELECT * FROM hours").collect()) == [(0, "view", 2, 3), (1, "view", 1, 3)]


def test_stream_of_runs(spark, tmp_path):
    rows = [(1, 1, "x", 10, 100), (1, 2, "x", 20, 200), (1, 3, "y", 5, 300), (1, 4, "y", 5, 2000)]
    schema = "owner long, id long, app string, duration long, end_ts long"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    q = windows.merged(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.app, r.seconds, r.end_ts, r.n) for r in spark.sql("SELECT * FROM runs").collect()) == [("x", 30, 200, 2), ("y", 5, 300, 1)]


def test_late_records_and_last_runs(spark, tmp_path):
    schema = "owner long, id long, app string, duration long, end_ts long"
    batches = [[(1, 1, "x", 10, 1000), (1, 2, "y", 10, 1300), (2, 5, "z", 7, 1200)], [(1, 3, "x", 20, 1100), (1, 4, "y", 30, 1400)], [(3, 9, "w", 1, 9000)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"{i}"))
    (tmp_path / "in").mkdir()
    q = windows.merged(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start()
    for i in range(len(batches)):
        for part in (tmp_path / f"{i}").glob("part-*"):
            part.rename(tmp_path / "in" / f"{i}-{part.name}")
        q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM late").collect())) == [(1, "x", 30, 1100, 2), (1, "y", 40, 1400, 2), (2, "z", 7, 1200, 1)]


def test_nothing_else_imports_the_llm_package():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "sparkact"
    own = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert own and not [p for p in own if "sparkact.llm" in p.read_text()]
