"""Versions over runs, discovery in two phases, observed counts, long pages."""

from foliospark.operators import chunking, embedding
from foliospark.plans import discovery
from foliospark.sources import tables
from pyspark.sql import functions as F

ROW = "key string, value int"


def current(spark, path):
    return {r["key"]: r["value"] for r in tables.read_current(spark, path, ROW, "key").collect()}


def rows(spark, **values):
    return spark.createDataFrame(list(values.items()), ROW)


def test_newest_commit_wins_over_runs(spark, tmp_path):
    path = str(tmp_path / "t")
    assert current(spark, path) == {} and tables.compact(spark, path, ROW, "key") is None
    assert tables.append_version(rows(spark, a=1, b=1), path, 0, "A") == 0
    assert tables.append_version(rows(spark, a=2), path, 3, "A") == 1
    assert tables.append_version(rows(spark, b=3), path, 0, "B") == 2
    assert current(spark, path) == {"a": 2, "b": 3}
    assert tables.append_version(rows(spark, a=9), path, 3, "A") == 1      # a retry keeps its place
    assert current(spark, path) == {"a": 9, "b": 3}
    assert {r["seq"] for r in tables.commits(spark, path).collect()} == {0, 1, 2}


def test_rows_without_a_commit_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append_version(rows(spark, a=1), path, 0, "A")
    tables._write(rows(spark, a=7, c=7), path, "A", 1, ())                  # the writer died here
    assert current(spark, path) == {"a": 1}
    tables.append_version(rows(spark, a=2), path, 1, "A")
    assert current(spark, path) == {"a": 2}


def test_compaction_keeps_the_table_and_knows_late_retries(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append_version(rows(spark, a=1, b=1), path, 0, "A")
    tables.append_version(rows(spark, a=2), path, 1, "A")
    tables.compact(spark, path, ROW, "key")
    assert tables.read_versions(spark, path, ROW).count() == 2
    assert tables.vacuum(spark, path) == 2
    tables.append_version(rows(spark, a=5), path, 1, "A")                   # folded already
    assert current(spark, path) == {"a": 2, "b": 1}
    tables.append_version(rows(spark, b=4), path, 0, "B")
    assert current(spark, path) == {"a": 2, "b": 4}
    early = tables.earlier_versions(spark, path, ROW, "A", 1)
    assert {(r["key"], r["value"]) for r in early.collect()} == {("b", 1), ("b", 4)}
    tables.compact(spark, path, ROW, "key")
    tables.compact(spark, path, ROW, "key")
    assert current(spark, path) == {"a": 2, "b": 4}


def test_compaction_without_a_key_keeps_every_row(spark, tmp_path):
    path = str(tmp_path / "t")
    for version in range(3):
        tables.append_version(rows(spark, a=version), path, version, "A", by=("key",))
    tables.compact(spark, path, ROW, by=("key",))
    tables.vacuum(spark, path)
    stored = tables.read_versions(spark, path, ROW)
    assert sorted((r["value"], r["version"]) for r in stored.collect()) == [(0, 0), (1, 1), (2, 2)]


ANNOUNCED = ("symbol string, desc string, attchmntText string, attchmntFile string, an_dt string, "
             "seq_id string, an_ts timestamp")


def test_discovery_holds_out_what_a_failing_embedder_left(spark, tmp_path):
    """The next run completes it, and asks the embedder only for what it had failed."""
    held = discovery.DiscoveryTables(str(tmp_path))
    feed = spark.createDataFrame([
        ("A", "transcript", None, f"u{i}", None, str(i), None) for i in range(1, 6)], ANNOUNCED)
    texts = {"u1": "One page.", "u2": "Bad page.", "u3": "One page.", "u4": None, "u5": "Fine page."}
    table = spark.createDataFrame(list(texts.items()), "source_url string, text string")

    def fetch(pending):
        return pending.join(table, "source_url", "left").withColumns({
            "sha256": F.sha2("text", 256), "error": F.when(F.col("text").isNull(), "HTTP 404")})

    def embedder(bad):
        def run(texts):
            if any(bad in t for t in texts):
                raise RuntimeError("down")
            return [[float(len(t))] for t in texts]
        return run

    def settle(bad):
        outcomes, counts = discovery.settle(spark, held, fetch, embedder(bad), "p", batch_size=1,
                                            tries=1)
        seen = sorted(r["seen"] for r in held.read_ledger(spark).collect())
        return {r["ledger_key"]: r["outcome"] for r in outcomes.collect()}, counts, seen

    discovery.find(feed, held, ["an_ts", "source_url"])
    discovery.find(feed, held, ["an_ts", "source_url"])           # found already
    outcomes, counts, seen = settle("Bad")
    assert outcomes == {"seq:1": "ingested", "seq:2": "ingested", "seq:3": "skipped",
                        "seq:4": "error", "seq:5": "ingested"}
    assert counts == {"total": 3, "skipped": 0, "embedded": 2, "failed": 1} and seen == ["seq:3"]
    outcomes, counts, seen = settle("nothing")
    assert counts == {"total": 3, "skipped": 2, "embedded": 1, "failed": 0}
    assert seen == ["seq:1", "seq:2", "seq:3", "seq:5"]
    outcomes, counts, seen = settle("nothing")
    assert outcomes == {"seq:4": "error"} and counts["total"] == 0
    documents = tables.read_versions(spark, held.documents, discovery.DOCUMENT)
    assert sorted(r["id"] for r in documents.collect()) == ["seq:1", "seq:2", "seq:5"]


def test_counts_are_observed_while_rows_are_written(spark, tmp_path):
    chunks = spark.createDataFrame([(i, str(i)) for i in range(20)], "id bigint, content string")
    done = spark.createDataFrame([(0, "p"), (1, "other")], "id bigint, embedding_provider string")
    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(1)
        if "7" in texts:
            raise RuntimeError("down")
        return [[1.0] for _ in texts]

    path = str(tmp_path / "out")
    counts = embedding.embed_pending(chunks, done, embedder, "p", lambda r: r.write.parquet(path),
                                     batch_size=1, tries=1)
    assert counts == {"total": 20, "skipped": 1, "embedded": 18, "failed": 1} and calls.value == 19
    none = embedding.embed_pending(chunks.limit(0), done, embedder, "p",
                                   lambda r: r.write.parquet(path + "2"))
    assert none == {"total": 0, "skipped": 0, "embedded": 0, "failed": 0}


def test_a_page_may_be_a_book(spark):
    """Sentences, headings and chunks of one long page, against a plain packing."""
    n = 20_000
    sentences = [f"Sentence {i} tells of margins." for i in range(n)]
    text = " ".join(sentences)
    pages = spark.createDataFrame([("b", 1, text), ("c", 1, ""), ("d", 1, None)],
                                  "document_id string, page int, text string")
    got = chunking.segment_sentences(pages).orderBy("ord").collect()
    assert [r["sentence"] for r in got] == sentences and [r["ord"] for r in got] == list(range(1, n + 1))
    assert got[-1]["end"] == len(text)
    chunks = chunking.chunk_pages(pages, 50, 10).orderBy("start").collect()
    per, step = 50 // 5, 50 // 5 - 10 // 5
    want = [" ".join(sentences[i:i + per]) for i in range(0, n - per + step, step)]
    assert [c["content"] for c in chunks] == want


def test_table_of_a_stream_is_a_file_or_a_folder(spark, tmp_path):
    from foliospark.catalog.inputs import Tables
    from foliospark.catalog.streams import _stream

    values = spark.range(40).withColumn("text", F.lit("a"))
    values.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    values.toPandas().to_parquet(tmp_path / "events.parquet")
    values.toPandas().to_parquet(tmp_path / "events2.parquet")
    for name in ("documents", "events"):
        out = str(tmp_path / f"{name}-out")
        _stream(Tables(spark, str(tmp_path)), name).writeStream.format("parquet") \
            .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out) \
            .awaitTermination()
        assert spark.read.parquet(out).count() == 40


def test_small_batches_are_given_out_together(spark):
    """Batches of one: each keeps its own fate over the borders of what is given out."""
    def failing(texts):
        if any(int(x) % 7 == 3 for x in texts):
            raise RuntimeError("down")
        return [[float(x)] for x in texts]

    chunks = spark.range(0, 1203, 1, 1).withColumn("content", F.col("id").cast("string"))
    done = embedding.embed_batches(chunks, failing, "p", batch_size=1, tries=1).collect()
    assert len(done) == 1203
    for r in done:
        bad = r["id"] % 7 == 3
        assert (r["embedding"], r["embedding_provider"], r["status"], r["error"]) == (
            (None, None, "failed", "down") if bad else ([float(r["id"])], "p", "embedded", None))
