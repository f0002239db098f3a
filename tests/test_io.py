"""Sources, streams and vector search."""

from __future__ import annotations

import datetime
import json
import os
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import chunking as K
from tallyweave.operators import registry as G
from tallyweave.operators import retrieval as S
from tallyweave.operators.matching import base_metrics
from tallyweave.session import work_folder
from tallyweave.sources import files, items
from tallyweave.streaming import incremental, sessions


def vectors(spark, n, seed, name):
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rnd.standard_normal((n, 8)))]
    rows += [(n + i, rows[0][1]) for i in range(30)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<double>")


def test_grid_search_equals_block_search(spark):
    queries, corpus = vectors(spark, 40, 1, "query_id"), vectors(spark, 500, 2, "id").repartition(5)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    block = key(S.top_n(queries, corpus, 7))
    assert block == key(S.top_n(queries, corpus, 7, max_block=9, grid_rows=100))
    q = np.stack([r["embedding"] for r in queries.orderBy("query_id").collect()])
    c = np.stack([r["embedding"] for r in corpus.orderBy("id").collect()])
    scores = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T, 9)
    want = [(i, r + 1, int(j)) for i, row in enumerate(scores) for r, j in enumerate(sorted(range(len(row)), key=lambda j: (-row[j], j))[:7])]
    assert block == sorted(want)


def test_hashed_search_finds_most_neighbours(spark):
    queries, corpus = vectors(spark, 20, 3, "query_id"), vectors(spark, 800, 4, "id")
    exact = {(r["query_id"], r["id"]) for r in S.top_n(queries, corpus, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in S.hashed_top_n(queries, corpus, 10, tables=16).collect()}
    assert len(exact & found) / len(exact) > 0.9


def test_hashed_search_of_copies_nulls_and_widths(spark):
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(500)] + [(1000, None), (1001, [1.0, 0.5]), (1002, [-1.0, -0.5, 0.25])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.5, -0.25]), (2, None)], "query_id long, embedding array<double>")
    got = S.hashed_top_n(queries, corpus, 5, tables=4, bits=3)
    assert [(r["query_id"], r["rank"], r["id"]) for r in got.orderBy("rank").collect()] == [(1, i + 1, i) for i in range(5)]
    assert [S.bits_for(n) for n in (0, 1, 512, 513, 32 * 2**20, 32 * 2**20 + 1)] == [4, 4, 4, 5, 20, 21]


def test_search_pipeline_and_scores(spark):
    corpus = spark.createDataFrame(
        [(0, "cash and bank", "a.pdf", 1, [1.0, 0.0]), (1, "inventory of goods", "b.pdf", 2, [0.9, 0.1]), (2, "other", None, None, [0.0, 1.0])],
        "id bigint, text string, source_path string, page int, embedding array<double>",
    )
    queries = spark.createDataFrame([(7, "goods inventory", [1.0, 0.0])], "query_id bigint, query string, embedding array<double>")
    got = S.search(queries, corpus, n=3, k=2).orderBy("position").collect()
    assert [r["id"] for r in got] == [1, 0] and got[0]["rerank_score"] == 10.0
    bad = spark.createDataFrame([('[{"index": 0, "score": 3}]',), ("prose",), ('[{"score": 3}]',), ('[{"index": 1}]',)], "t string")
    parsed = [r["p"] for r in bad.select(S.parse_scores(F.col("t")).alias("p")).collect()]
    assert parsed[0][0]["score"] == 3.0 and parsed[1] is None and parsed[2] is None and parsed[3][0]["score"] == 0.0


def test_payload_query(spark):
    schema = "p struct<message:string,messages:array<struct<role:string,content:string,items:array<struct<type:string,text:string>>>>>"
    turn = lambda role, content=None, texts=None: (role, content, texts)
    rows = [
        ((" hi ", None),),
        ((None, [turn("user", "old"), turn("user", None, [("text", "a"), ("image", "x"), ("text", "b")])]),),
        ((None, [turn("user", "old"), turn("user", None, [])]),),
        ((None, [turn("user", "old"), turn("user", ""), turn("assistant", "z")]),),
        ((None, None),),
    ]
    got = [r["q"] for r in spark.createDataFrame(rows, schema).select(G.payload_query(F.col("p")).alias("q")).collect()]
    assert got == ["hi", "a b", "old", "", ""]


def test_file_scan_and_chunk_sink(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.PDF").write_bytes(b"one")
    (tmp_path / "b.docx").write_bytes(b"two")
    (tmp_path / "c.txt").write_bytes(b"three")
    got = files.scan_files(spark, str(tmp_path)).collect()
    assert len(got) == 2 and all(r["doc_id"] == r["hash"][:32] for r in got)
    with pytest.raises(FileNotFoundError):
        files.scan_files(spark, str(tmp_path / "none"))
    docs = spark.createDataFrame([("d", "a\n\nb", 1)], "doc_id string, text string, page int")
    chunks = K.chunk_documents(docs, K.chunk_column("sentence"))
    files.write_chunks(chunks, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 1


def test_item_files_isolate_errors(spark, tmp_path):
    item = {"id": "q1", "pre_text": ["a", ""], "table": [["x", "1"]], "post_text": [], "qa": {"question": "why?", "answer": "so"}}
    (tmp_path / "list.json").write_text(json.dumps([item, {"uid": "u2", "pre_text": ["b"]}], indent=1))
    (tmp_path / "lines.json").write_text(json.dumps({"pre_text": ["c"], "question": "q?"}) + "\nnot json\n")
    (tmp_path / "broken.json").write_text("[{")
    good, bad = items.read_items(spark, str(tmp_path))
    docs = {r["doc_text"]: r for r in items.question_documents(good).collect()}
    assert set(docs) == {"a\n\nTABLE:\nx\t1", "b", "c"}
    assert docs["a\n\nTABLE:\nx\t1"]["source_path"] == "finqa::list.json::q1" and docs["b"]["qa_id"] == "u2"
    assert docs["c"]["qa_id"] == docs["c"]["hash"][:12]
    assert bad.count() == 2
    assert items.question_rows(items.question_documents(good)).count() == 2


def test_layout_files(spark, tmp_path):
    folder = tmp_path / "r1"
    folder.mkdir()
    content = [
        {"type": "text", "text": "标题", "text_level": 1, "page_idx": 0}, {"type": "text", "text": "正文", "page_idx": 0},
        {"type": "table", "table_caption": ["cap"], "table_body": "<table></table>", "table_footnote": "note", "page_idx": 1},
        {"type": "text", "text": "lost"},
    ]
    (folder / "x_content_list.json").write_text(json.dumps(content, indent=1), encoding="utf-8")
    (folder / "page.md").write_text("# md", encoding="utf-8")
    read = items.read_layout_items(spark, str(tmp_path)).withColumns({"report_id": F.lit("r1"), "engine": F.lit("layout")})
    pages = {r["page"]: r for r in items.layout_pages(read).collect()}
    assert pages[1]["text_md"] == "# 标题\n\n正文" and pages[2]["text_md"] == "### cap\n\n<table></table>\n\nnote"
    assert pages[2]["text_raw"] == "cap\nnote" and set(pages) == {1, 2}
    md = items.markdown_pages(spark, str(tmp_path))
    assert md.first()["page"] == 1
    assert items.prefer_layout(items.layout_pages(read).select(*md.columns), md).count() == 2


def test_dictionary_overrides_and_cases_files(spark, tmp_path):
    full = {"metric_code": "m", "metric_name_cn": "指标", "statement_type": "income", "value_nature": "flow", "patterns_cn": ["营业收入", "税"]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"version": 1, "metrics": [full, {"metric_code": "x"}]}, ensure_ascii=False), encoding="utf-8")
    got = files.read_metrics(spark, str(path)).collect()
    assert [(r["metric_code"], r["patterns"], r["patterns_exact"]) for r in got] == [("m", ["营业收入"], ["税"])]
    assert set(got[0].asDict()) == set(base_metrics(spark).columns)
    files.write_metrics(base_metrics(spark), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 141
    (tmp_path / "o.csv").write_text("report_id,fact_type,metric_code,as_of_date,value\n1,stock,m,2024-12-31,\n")
    row = files.read_overrides(spark, str(tmp_path / "o.csv")).first()
    assert row["value"] is None and str(row["as_of_date"]) == "2024-12-31" and row["unit"] is None
    (tmp_path / "o.json").write_text(json.dumps({"rows": [{"report_id": "1", "value": "3"}]}))
    assert files.read_overrides(spark, str(tmp_path / "o.json")).first()["value"] == "3"
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"id": "p", "label": "l", "statement_type": "income"}]}, indent=2))
    assert files.read_cases(spark, str(tmp_path / "c.json")).first()["required"] is True


def test_taxonomy_label_files(spark, tmp_path):
    ns = 'xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"'
    body = (
        '<link:loc xlink:label="loc1" xlink:href="core.xsd#ns:Cash"/>'
        '<link:labelArc xlink:from="loc1" xlink:to="lab1"/>'
        '<link:label xlink:label="lab1" xlink:role="std" xml:lang="zh"> 货币资金 </link:label>'
        '<link:label xlink:label="lab1" xlink:role="std" xml:lang="en">Cash</link:label>'
    )
    (tmp_path / "core_label_zh.xml").write_text(f'<?xml version="1.0"?><link:linkbase {ns}><link:labelLink>{body}</link:labelLink></link:linkbase>', encoding="utf-8")
    (tmp_path / "other.xml").write_text(f"<link:linkbase {ns}>{body}</link:linkbase>", encoding="utf-8")
    got = {(r["concept"], r["label"], r["lang"]) for r in files.read_taxonomy_labels(spark, str(tmp_path), "cas").collect()}
    assert got == {("Cash", "货币资金", "zh"), ("Cash", "Cash", "en")}


def test_rule_tables(spark, tmp_path):
    rows = [("d", 0, ["ELR名称", "变化说明"]), ("d", 1, ["[230005] 个别资产负债表", "新增 [230005a] 表"]), ("d", 2, ["[230105] 利润表"]), ("d", 3, ["[230105] 现金流量表", "x", "extra"])]
    records = files.table_records(spark.createDataFrame(rows, "doc string, row_index int, cells array<string>"))
    flat = records.select("row_index", F.col("record")["ELR名称"].alias("ELR名称"), F.col("record")["变化说明"].alias("变化说明"))
    changes = files.rule_changes(flat)
    got = {r["code"]: r["statement_type"] for r in files.rule_statements(changes, "row_index").collect()}
    assert got == {"230005": "balance_sheet", "230005a": "balance_sheet", "230105": "cash_flow"}
    files.write_tsv(flat, str(tmp_path / "t"))
    assert files.read_tsv(spark, str(tmp_path / "t")).count() == 3
    assert spark.range(1).select(files.rule_map(files.rule_statements(changes, "row_index")).alias("m")).first()["m"]["230005"] == "balance_sheet"


def test_registry_stream_over_files_and_reruns(spark, tmp_path):
    schema = "doc_id bigint, text string, source string"
    for i, rows in enumerate([[(1, "a", "s"), (2, "b", "s"), (3, "a", "s")], [(4, "b", "s"), (5, "c", "s")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    registry = str(tmp_path / "registry")
    incremental.registry_stream(stream, registry, str(tmp_path / "progress")).awaitTermination()
    again = spark.createDataFrame([(4, "b", "s"), (5, "c", "s")], schema)
    last = max(r["batch"] for r in spark.read.parquet(registry).select("batch").collect())
    before = sorted(r["hash"] for r in spark.read.parquet(registry).collect())
    incremental.register_batch(again, last + 1, registry)
    assert sorted(r["hash"] for r in spark.read.parquet(registry).collect()) == before and len(before) == 3


def test_session_stream_merges_batches(spark, tmp_path):
    schema = "session_id bigint, ts bigint, role string, content string"
    for i in range(3):
        rows = [(s, i * 10 + t, "user", f"m{t}") for s in range(2) for t in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    root = str(tmp_path / "state")
    sessions.session_stream(stream, root, str(tmp_path / "progress"), limit=5).awaitTermination()
    activity = sessions.merged_activity(spark, root).orderBy("session_id").collect()
    assert [(r["created_at"], r["updated_at"], r["n_messages"]) for r in activity] == [(0, 23, 12), (0, 23, 12)]
    last = sessions.merged_messages(spark, root, 5).filter("session_id = 0").orderBy("position").collect()
    assert [r["ts"] for r in last] == [13, 20, 21, 22, 23]


def test_registry_reads_only_the_prefixes_of_a_batch(spark, tmp_path):
    schema, registry = "doc_id bigint, text string, source string", str(tmp_path / "registry")
    batches = [[(1, "a", "s"), (2, "a", "t"), (3, "b", "s")], [(4, "b", "s"), (5, "c", "s"), (6, None, "s")], [(7, "a", "s"), (8, "c", "s"), (9, "d", "s"), (10, None, "s")]]
    for number, rows in enumerate(batches):
        incremental.register_batch(spark.createDataFrame(rows, schema), number, registry)
    stored = spark.read.parquet(registry)
    assert sorted((r["doc_no"], r["batch"]) for r in stored.filter("hash is not null").collect()) == [(1, 0), (3, 0), (5, 1), (9, 2)]
    one = spark.createDataFrame([(11, "b", "s")], schema).withColumnRenamed("doc_id", "doc_no")
    asked = incremental.with_hash(one).withColumn("prefix", F.left("hash", F.lit(incremental.PREFIX_DIGITS)))
    earlier = incremental.earlier_hashes(spark, asked, 3, registry, stored.schema)
    assert earlier.count() == 1
    files_read = earlier._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in files_read and "prefix" in files_read.split("PartitionFilters", 1)[1].split("]")[0]
    assert {f.split("prefix=")[1].split("/")[0] for f in earlier.inputFiles()} >= {asked.first()["prefix"]}
    assert earlier.select(F.input_file_name().alias("f")).distinct().count() == 1


def test_live_sessions_over_micro_batches_with_late_messages(spark, tmp_path):
    schema, base = "session_id string, ts timestamp, role string, content string", datetime.datetime(2024, 1, 1)
    at = lambda s: base + datetime.timedelta(seconds=s)
    files_of = [
        [("a", 5, "user", "x"), ("a", 1, "user", "y"), ("b", 2, "user", "z"), ("idle", 1, "user", "old")],
        [("a", 3, "bot", "late but in time"), ("b", 4, None, None), ("b", 4, "user", "tie")],
        [("a", 7200, "user", "much later")],  # the watermark leaves the other sessions behind
        [("b", 5, "user", "too late"), ("c", 7300, "user", "new")],
        [("c", 7301, "user", "more")],
    ]
    for i, rows in enumerate(files_of):
        folder = tmp_path / f"in{i}"
        spark.createDataFrame([(s, at(t), r, c) for s, t, r, c in rows], schema).coalesce(1).write.parquet(str(folder))
        for f in folder.glob("*.parquet"):
            os.utime(f, (1_000_000_000 + i, 1_000_000_000 + i))  # the source takes files by age
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    root = str(tmp_path / "live")
    made = sessions.live_session_stream(stream, root, str(tmp_path / "progress"), limit=2, lateness="10 minutes", idle_ms=60_000)
    made.awaitTermination()
    got = {r["session_id"]: r for r in sessions.newest_sessions(spark, root).collect()}
    seconds = lambda t: int((t - base).total_seconds())
    state = {k: (r["n_messages"], seconds(r["created_at"]), seconds(r["updated_at"]), [m["content"] for m in r["last_messages"]], r["closed"]) for k, r in got.items()}
    assert state["a"] == (4, 1, 7200, ["x", "much later"], False)
    assert state["b"] == (3, 2, 4, [None, "tie"], True) and state["idle"] == (1, 1, 1, ["old"], True)
    assert state["c"] == (2, 7300, 7301, ["new", "more"], False)


def test_live_sessions_keep_times_as_numbers(spark, tmp_path):
    # 01:30 comes twice in this night; times of the local clock would be one
    stamps = [1_699_162_200, 1_699_165_800, None]
    rows = spark.createDataFrame([(t, s) for s, t in enumerate(stamps)], "s long, n int").selectExpr("timestamp_seconds(s) AS ts", "n")
    rows.selectExpr("1 AS session_id", "ts", "'user' AS role", "string(n) AS content").write.parquet(str(tmp_path / "in"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = spark.readStream.schema("session_id int, ts timestamp, role string, content string").parquet(str(tmp_path / "in"))
        sessions.live_session_stream(stream, str(tmp_path / "live"), str(tmp_path / "progress")).awaitTermination()
        seconds = "unix_seconds(created_at)", "unix_seconds(updated_at)", "transform(last_messages, m -> unix_seconds(m.ts))", "n_messages"
        got = [tuple(r) for r in sessions.newest_sessions(spark, str(tmp_path / "live")).selectExpr(*seconds).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [(*stamps[:2], stamps[:2], 2)]


def test_item_lines_in_splits(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "pre_text": ["x"]}\n{broken\n\n{"id": "2"}\n')
    good, bad = items.read_items(spark, str(tmp_path), layout="lines")
    assert sorted(r["id"] for r in good.collect()) == ["1", "2"] and bad.count() == 1


def test_batch_embedder_is_checked(spark):
    docs = spark.createDataFrame([("a. b.",), ("",)], "text string")
    made = K.embed_sentences(docs, lambda texts: [[float(len(t)), 1.0] for t in texts], 2).collect()
    assert [list(map(list, r["vecs"])) for r in made] == [[[2.0, 1.0], [2.0, 1.0]], []]
    with pytest.raises(Exception, match="count mismatch"):
        K.embed_sentences(docs, lambda texts: [], 2).collect()


@pytest.mark.parametrize("concurrency", [1, 3])
def test_embedder_is_called_with_full_batches_across_rows(spark, concurrency):
    from tallyweave.functions import text as X

    rows = [(i, None if i % 17 == 0 else " ".join(f"word{i} x{k}." for k in range(i % 7)), f"v{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "id long, text string, note string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        made = K.embed_sentences(docs, lambda texts: [[float(len(t)), float(len(texts))] for t in texts], 2, concurrency=concurrency).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["id"], r["note"]) for r in made] == [(i, n) for i, _, n in rows]
    alone = {r["id"]: r["s"] or [] for r in docs.select("id", X.sentences(F.col("text")).alias("s")).collect()}
    assert all(r["sents"] == alone[r["id"]] and [v[0] for v in r["vecs"]] == list(map(len, r["sents"])) for r in made)
    calls = [int(v[1]) for r in made for v in r["vecs"]]
    rest = len(calls) % 32
    assert len(calls) > 300 and calls == [32] * (len(calls) - rest) + [rest] * rest


def test_term_search_reads_only_blocks_that_a_candidate_can_be_in(spark):
    rng = random.Random(4)
    kinds = [f"t{k}" for k in range(30)]
    docs = {i: {"common"} | {t for n, t in enumerate(kinds) if rng.random() < 0.5 / (n + 1)} | ({"rare"} if i in (7, 900, 4003) else set()) for i in range(5000)}
    table = spark.createDataFrame([(i, " ".join(sorted(d)) + " common") for i, d in docs.items()], "doc long, text string")
    index = S.postings(table, "doc").drop("positions")
    asked = ["common rare", "rare common t0", "t3 t1 common", "common", "common nowhere", "", None, "t29 t28 rare"]
    asked += [" ".join(rng.sample(kinds, rng.randint(1, 4))) for _ in range(40)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = sorted(map(tuple, S.term_search(index, queries, "doc", ranges=64).collect()))
    want = []
    for n, q in enumerate(asked):
        terms = set((q or "").split())
        want += [(n, i, len(terms) + ("common" in terms)) for i, d in docs.items() if terms and terms <= d]
    assert got == sorted(want)

    blocks = S.posting_blocks(index, "doc", 64)
    first, others = S.probe_plan(blocks, queries.filter("query_id = 0"))
    assert [r["term"] for r in first.collect()] == ["rare"]
    read = S.needed_blocks(blocks, S.candidates(blocks, first, "doc"), others).collect()
    assert {r["term"] for r in read} == {"common"} and len(read) <= 3 and sum(r["df"] for r in read) < 400
    assert sum(r["df"] for r in blocks.filter("term = 'common'").collect()) == 5000


def test_copies_inside_a_batch_follow_the_sequential_rule(spark):
    from tallyweave.operators import facts as H

    rng = random.Random(6)
    rows = [(i, f"h{rng.randrange(60)}", rng.choice(["indexed", "empty", "failed"])) for i in range(400)]
    made = [(i, h, s, 5 if s == "indexed" else 0, "bad" if s == "failed" else None) for i, h, s in rows]
    tried = spark.createDataFrame(made, "no long, hash string, status string, num_chunks int, error string").repartition(6)
    known, want = set(), []
    for i, h, s, n, e in made:
        want.append((i, h, "skipped", 0, None) if h in known else (i, h, s, n, e))
        if s == "indexed":
            known.add(h)
    got = G.skip_copies(tried, "no").select("no", "hash", "status", "num_chunks", "error").collect()
    assert sorted(map(tuple, got)) == want

    reports = tried.select(F.col("no").alias("report_id"), F.col("hash").alias("source_hash"))
    registry = spark.createDataFrame([("h1", 9000), ("h2", 9001)], "source_hash string, report_id long")
    seen, want = {"h1": 9000, "h2": 9001}, []
    for i, h, _ in rows:
        want.append((i, "append_candidates" if h in seen else "new", seen.get(h)))
        seen.setdefault(h, i)
    got = H.ingest_mode(reports, registry, allow_existing=True, order="report_id").select("report_id", "mode", "known_report_id").collect()
    assert sorted(map(tuple, got)) == want


def test_group_limits_and_local_lookups_are_planned(spark):
    from tallyweave.operators import matching as M

    messages = spark.range(100).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("ts"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(G.last_messages(messages, 2))
    lookup = plan(M.match_labels(spark.range(5).select(F.lit("x").alias("label")), base_metrics(spark)))
    assert "BroadcastHashJoin" in lookup and "SortMergeJoin" not in lookup


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_cluster_without_shared_folder_is_an_error(master):
    named = {}
    conf = SimpleNamespace(get=lambda key, default=None: named.get(key, default), set=named.__setitem__)
    context = SimpleNamespace(master=master, getConf=lambda: conf)
    session = SimpleNamespace(conf=conf, sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(session, "x")
    named["spark.checkpoint.dir"] = "hdfs://host/shared/"
    assert work_folder(session, "x").startswith("hdfs://host/shared/x-")
    named.clear()
    context.master = "local[2]"
    assert "/x-" in work_folder(session, "x") and named["spark.checkpoint.dir"]
