"""Files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from tierflow.operators import embedding, routing
from tierflow.schemas import LOG_COLUMNS, TRACE_SCHEMA
from tierflow.sources import logs, results, tiers

HEADER = ",".join(LOG_COLUMNS)


def test_csv_scan(spark, tmp_path):
    path = tmp_path / "logs.csv"
    path.write_text(
        HEADER + "\n"
        '1,"Sun Dec 04 04:47:44 2005",E2,,<*>,"say ""hi"", äß",app,2005-12-04,h,OpenSSH\n'
        '2,18:06:20,E3,nan,<*>,"two\nlines",app,,h,\n',
        encoding="utf-8",
    )
    rows = logs.read_logs(spark, str(path), multiline=True).orderBy("log_id").collect()
    assert len(rows) == 2
    assert rows[0].Level == "" and rows[0].Content == 'say "hi", äß'
    assert rows[1].Content == "two\nlines" and rows[1].LogSource == ""
    assert [r.log_id for r in rows] == [1, 2]


def test_columns_are_read_by_name_and_ids_by_file(spark, tmp_path):
    turned = list(reversed(LOG_COLUMNS))
    for name in ("b.csv", "a.csv"):
        lines = [",".join(turned)]
        lines += [",".join(f"{i}" if c == "LineId" else f"{c}-{name}" for c in turned) for i in (1, 2)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    rows = logs.read_logs(spark, f"{tmp_path}/*.csv").orderBy("log_id").collect()
    assert [r.Level for r in rows] == ["Level-a.csv"] * 2 + ["Level-b.csv"] * 2
    second = 1 << logs.LINE_BITS
    assert [r.log_id for r in rows] == [1, 2, second + 1, second + 2]
    (tmp_path / "c.csv").write_text(HEADER + "\n" + ",".join(["1"] * 10) + "\n")
    with pytest.raises(Exception, match="header|schema"):
        logs.read_logs(spark, f"{tmp_path}/*.csv").collect()


def test_streamed_ids_differ_between_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.csv").write_text(HEADER + "\n" + "\n".join(f"{i}" + ",x" * 9 for i in (1, 2)) + "\n")

    def ids(run):
        out = str(tmp_path / run)
        logs.stream_logs(spark, str(folder)).select("log_id").writeStream.format("parquet").option(
            "path", out
        ).option("checkpointLocation", out + "-c").trigger(availableNow=True).start().awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(out).collect())

    first = ids("one")
    assert len(set(first)) == 4 and min(first) >= 0 and first == ids("two")


def test_tier_shapes_replace_their_part(spark, tmp_path):
    df = log(spark, Level="crit", Content="a").unionByName(log(spark, Level="info", Content="b"))
    decided = routing.apply_compliance(routing.route_static(df.unionByName(log(spark, Level="warn"))))
    for _ in range(2):
        tiers.write_tier_shapes(decided, list(LOG_COLUMNS), str(tmp_path / "t"), "batch_id=0")
    read = lambda name: tiers.read_tier(spark, str(tmp_path / "t"), name).collect()
    assert [r.log_message for r in read("relational")] == ["b"]
    assert [json.loads(r.document)["Level"] for r in read("search")] == ["warn"]
    assert [r.content for r in read("content")] == ["a"] and len(read("references")) == 1
    assert read("relational_rejects") == []


def test_event_time_by_shape(spark):
    df = spark.createDataFrame([("2005-12-04 04:47:44",), ("04/12/2005 04:47",), ("soon",), (None,)], "Time string")
    formats = {r"^\d{4}-\d\d-\d\d ": "yyyy-MM-dd HH:mm:ss", r"^\d\d/\d\d/\d{4} ": "dd/MM/yyyy HH:mm"}
    got = [str(r[0]) for r in df.select(logs.event_time(formats)).collect()]
    assert got == ["2005-12-04 04:47:44", "2005-12-04 04:47:00", "None", "None"]


LOG = "log_id long, " + ", ".join(f"{c} string" for c in LOG_COLUMNS)


def log(spark, **values):
    row = {"log_id": 1, **{c: "" for c in LOG_COLUMNS}, **values}
    return spark.createDataFrame([tuple(row.values())], LOG)


def test_relational_widths(spark, tmp_path):
    fits = tiers.relational_rows(log(spark, Level="x" * 32, Content="ä" * 32_767)).first()
    assert not fits.overflow and fits.log_timestamp is None
    assert tiers.relational_rows(log(spark, Level="x" * 33)).first().overflow
    assert tiers.relational_rows(log(spark, Content="ä" * 32_768)).first().overflow
    both = log(spark, Level="x" * 33).unionByName(log(spark, Level="ok"))
    tiers.write_relational(both, str(tmp_path / "ok"), str(tmp_path / "rejects"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 1


def test_search_document(spark):
    df = log(spark, Level="l" * 300, Date="2024-01-01").withColumn("load", F.lit(float("nan")))
    row = tiers.search_documents(df, [*LOG_COLUMNS, "load"]).first()
    document = json.loads(row.document)
    assert document["load"] is None and document["Date"] == "2024-01-01"
    assert row.level_keyword is None and row.date_keyword == "2024-01-01"


def test_content_store_keeps_one_copy(spark):
    import hashlib

    df = log(spark, Content="same").unionByName(log(spark, Content="same")).unionByName(log(spark, Content=None))
    store = {r.content: r.cid for r in tiers.content_store(df).collect()}
    assert store == {t: hashlib.sha256(t.encode()).hexdigest()[:46] for t in ("same", "")}
    assert tiers.content_references(df).count() == 3


def test_tier_folders(spark, tmp_path):
    df = log(spark, Level="crit").unionByName(log(spark, Level="info"))
    decided = routing.apply_compliance(routing.route_static(df))
    tiers.write_tiers(decided, str(tmp_path / "tiers"))
    back = spark.read.parquet(str(tmp_path / "tiers"))
    assert sorted(r.destination for r in back.collect()) == ["ipfs", "mysql"]


def test_trace_files_named_by_run(spark, tmp_path):
    header = ",".join(f.name for f in TRACE_SCHEMA)
    line = "{},x,x,elk,elk,False,1.0,2.0,{},True,0.5,10,TRUE,,"
    (tmp_path / "direct_elk_My_Logs.csv").write_text(header + "\n" + line.format(1, "3.0") + "\n")
    (tmp_path / "q_learning_Other.csv").write_text(header + "\n" + line.format(2, "bad") + "\n")
    (tmp_path / "summary_static_Logs.csv").write_text("destination,total_latency_ms\n0.1,0.233\n")
    (tmp_path / "notes.csv").write_text("a\n1\n")
    skipped = {r.path.rsplit("/", 1)[1] for r in results.skipped_files(spark, f"{tmp_path}/*.csv").collect()}
    assert skipped == {"summary_static_Logs.csv", "notes.csv"}
    rows = results.read_trace_csv(spark, f"{tmp_path}/*.csv").orderBy("log_id").collect()
    assert [(r.router, r.dataset_name) for r in rows] == [("direct_elk", "My_Logs"), ("q_learning", "Other")]
    assert rows[0].total_latency_ms == 3.0 and rows[1].total_latency_ms is None
    assert rows[0].sensitive is True and rows[0].compliance_forced is False


def test_trace_round_trip(spark, tmp_path):
    row = (1, "r", "d", "elk", "elk", False, 1.0, 2.0, 3.0, True, 0.5, 10, False, None, None)
    df = spark.createDataFrame([row], TRACE_SCHEMA)
    results.write_trace(df, str(tmp_path / "trace"))
    back = spark.read.parquet(str(tmp_path / "trace")).select(df.columns).first()
    assert tuple(back) == row


def test_merge_reads_the_path(spark, tmp_path):
    for side, extra in (("eval_real_baseline", ""), ("eval_real_compliance", ",more")):
        folder = tmp_path / side
        folder.mkdir()
        value = ",7" if extra else ""
        (folder / "combined_summary_My_Logs.csv").write_text(f"rows{extra}\n5{value}\n")
    tables = [results.read_summaries(spark, f"{tmp_path}/eval_real_{s}/*.csv") for s in ("baseline", "compliance")]
    rows = results.merge_summaries(tables).orderBy("compliance").collect()
    assert [(r.dataset, r.compliance, r.more) for r in rows] == [("My_Logs", False, None), ("My_Logs", True, 7)]


def text_of(path):
    parts = [p for p in path.iterdir() if p.name.startswith("part-")]
    return "".join(p.read_text() for p in sorted(parts))


def test_markdown_file(spark, tmp_path):
    df = spark.createDataFrame([("d", 0.25)], "name string, share double")
    results.write_markdown(df, ["name", "share"], "Title", str(tmp_path / "md"))
    assert text_of(tmp_path / "md").splitlines() == [
        "# Title",
        "",
        "| name | share |",
        "| --- | --- |",
        "| d | 0.250000 |",
    ]


def test_histories(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5, 0.7), (1, 1.5, 1.0)], "episode long, reward double, epsilon double")
    results.write_rewards(df, str(tmp_path / "rewards"))
    assert text_of(tmp_path / "rewards").splitlines() == ["episode,reward", "1,1.5", "2,0.5"]
    assert results.read_rewards(spark, str(tmp_path / "rewards")).count() == 2
    results.write_events(df, str(tmp_path / "events"))
    lines = [json.loads(x) for x in text_of(tmp_path / "events").splitlines()]
    assert lines == [{"episode": 1, "epsilon": 1.0}, {"episode": 2, "epsilon": 0.7}]
    results.write_one_csv(df, str(tmp_path / "one"))
    assert len(text_of(tmp_path / "one").splitlines()) == 3


def test_embedding_uses_the_cache(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, ""), (4, None), (5, "c")], "id long, t string")
    encoder = embedding.hashed_words(8)
    first = embedding.embed_texts(df, F.col("t"), "ns", encoder)
    rows = {r.key: r.embedding for r in first.collect()}
    assert len(rows) == 3 and sum(sum(v) == 0 for v in rows.values()) == 1

    def marked(batches):
        for batch in batches:
            yield batch[["key"]].assign(embedding=[[9.0]] * len(batch))

    cache = first.where(F.array_max("embedding") > 0)
    custom = embedding.python_encoder(marked)
    mixed = embedding.embed_texts(df, F.col("t"), "ns", custom, cache).collect()
    assert sum(list(r.embedding) == [9.0] for r in mixed) == 1 and len(mixed) == 3
    joined = embedding.attach_embeddings(df, F.col("t"), "ns", first)
    assert joined.count() == 5 and joined.where("embedding IS NULL").count() == 0
