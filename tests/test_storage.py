"""Batches, commits, growth, runs and the stream."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from feedloom import session as feed_session
from feedloom.operators import classify, incremental
from feedloom.operators.validate import ValidationError
from feedloom.plans import all_queries
from feedloom.plans.domain import Domain
from feedloom.schemas import KEY, TABLES, TableSpec
from feedloom.sources import caches, dataset, growth
from feedloom.streaming.classify_stream import classify_stream, retry_failed, stored_answers, stored_sentences, to_ask
from tests.conftest import plan_of
from test_quality import base

ORDERS = {"orders": TABLES["orders"]}


def orders(spark, first, last, batch=1):
    return spark.range(first, last).select(
        F.format_string("O%09d", "id").alias("order_id"), F.format_string("C%07d", F.col("id") % 7).alias("customer_id"),
        F.expr("TIMESTAMP_NTZ '2025-01-01' + make_dt_interval(cast(id AS INT))").alias("ordered_at"),
        F.lit(5.0).alias("order_total"), F.lit(batch).alias("batch_id"))


def test_whole_dataset_round_trip(spark, tmp_path):
    tables = base(spark)
    dataset.write_dataset(tables, str(tmp_path))
    read = dataset.read_dataset(spark, str(tmp_path))
    assert set(read) == set(tables)
    for name, df in tables.items():
        assert sorted(map(str, read[name].collect())) == sorted(map(str, df.collect())) and read[name].dtypes == df.dtypes
    with pytest.raises(ValidationError):
        dataset.write_dataset({"orders": orders(spark, 0, 3).withColumn("order_total", F.lit(-1.0))}, str(tmp_path))
    with pytest.raises(ValueError, match="unknown"):
        dataset.write_dataset({"other": tables["orders"]}, str(tmp_path))


def test_absent_tables_are_absent(spark, tmp_path):
    assert dataset.read_dataset(spark, str(tmp_path)) == {}


def test_catalogue_from_csv(spark, tmp_path):
    path = tmp_path / "products.csv"
    path.write_text("sku,product_id,product_name,category,description,list_price,fuel_type,launched_on\n"
                    's1,P001,Kettle,grills,"Big, red",9.5,,2021-03-01\n')
    row = dataset.read_catalogue(spark, str(path)).first()
    assert row.asDict() == {"product_id": "P001", "sku": "s1", "product_name": "Kettle", "category": "grills",
                            "description": "Big, red", "list_price": 9.5, "fuel_type": None, "launched_on": date(2021, 3, 1)}


def test_catalogue_lines_that_are_refused(spark, tmp_path):
    path = tmp_path / "products.csv"
    path.write_text("note,product_id,sku,product_name,category,description,list_price,fuel_type,launched_on\n"
                    'x,P001,s1,Kettle,grills,"Big, red",9.5,,2021-03-01\n'
                    "x,P002,s2,Pot,grills,d,cheap,,2021-03-01\n"
                    "x,P003,s3,Pan,grills,d,1.0,,2021-03-01,more\n"
                    "x,P004,s4\n\n"
                    "x,7,s5,Lid,grills,d,-1,,yesterday\n")
    accepted, rejected = dataset.checked_catalogue(spark, str(path))
    assert [r.product_id for r in accepted.collect()] == ["P001"]
    found = {r.line.split(",")[1]: r.reasons for r in rejected.collect()}
    assert found["P002"] == ["list_price is not double"]
    assert found["P003"] == found["P004"] == ["the number of fields differs from the header's"]
    assert set(found["7"]) == {"launched_on is not date", "product_id matches its pattern", "list_price is in range"}
    path.write_text("product_id,sku\n")
    accepted, rejected = dataset.checked_catalogue(spark, str(path))
    assert accepted.count() == rejected.count() == 0 and "launched_on" in accepted.columns


def test_an_interrupted_batch_is_invisible_then_replaced(spark, tmp_path):
    path = str(tmp_path)
    counts = dataset.write_batch({"orders": orders(spark, 0, 30)}, 1, path)
    dataset.write_commit(spark, path, batch_id=1, kind="advance", counts=counts)
    dataset.write_batch({"orders": orders(spark, 0, 30), "review_truth": base(spark)["review_truth"]}, 2, path)
    read = dataset.read_dataset(spark, path)
    assert read["orders"].count() == 30 and read["review_truth"].count() == 0
    counts = dataset.write_batch({"orders": orders(spark, 30, 40)}, 2, path)
    dataset.write_commit(spark, path, batch_id=2, kind="advance", counts=counts)
    read = dataset.read_dataset(spark, path)
    assert counts == {"orders": 10}
    assert read["orders"].count() == read["orders"].select("order_id").distinct().count() == 40
    assert read["review_truth"].count() == 0  # what the interrupted run left in another table is gone too
    assert dataset.read_dataset(spark, path, batches=[2])["orders"].count() == 10
    assert {(r.batch_id, r.rows) for r in dataset.batch_status(spark, path).collect()} == {(1, 30), (2, 10)}


def test_only_committed_folders_are_read(spark, tmp_path):
    path = str(tmp_path)
    for n in (1, 2, 3):
        dataset.write_batch({"orders": orders(spark, n, n + 1)}, n, path)
    dataset.write_commit(spark, path, batch_id=2, kind="advance", counts={"orders": 1})
    plan = dataset.read_dataset(spark, path)["orders"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan.replace("\n", " ") or "PartitionFilters: [(batch_id" in plan


def test_committing_again_changes_nothing(spark, tmp_path):
    for _ in range(2):
        dataset.write_commit(spark, str(tmp_path), batch_id=1, kind="advance", counts={"orders": 1})
    assert dataset.committed_batches(spark, str(tmp_path)) == [1]


SETTINGS = {"start": "2025-01-01"}
SPECS = {
    "customers": TableSpec("customer_id STRING, signup_at TIMESTAMP_NTZ"),
    "orders": TABLES["orders"],
    "order_lines": TableSpec("order_line_id STRING, order_id STRING"),
    "reviews": TableSpec("review_id STRING, customer_id STRING, order_line_id STRING, reviewed_at TIMESTAMP_NTZ"),
}


@pytest.fixture(scope="module")
def source(spark):
    placed = orders(spark, 0, 200)
    lines = placed.select(F.concat(F.lit("L"), "order_id").alias("order_line_id"), "order_id")
    reviews = placed.select(F.concat(F.lit("R"), "order_id").alias("review_id"), "customer_id",
                            F.concat(F.lit("L"), "order_id").alias("order_line_id"),
                            F.expr("ordered_at + INTERVAL 20 DAYS").alias("reviewed_at"))
    people = spark.range(7).select(F.format_string("C%07d", "id").alias("customer_id"),
                                   F.expr("TIMESTAMP_NTZ '2024-12-01'").alias("signup_at"))
    return {"customers": people, "orders": placed, "order_lines": lines, "reviews": reviews}


def grow(spark, path, source, *steps, people=(None,)):
    growth.init_dataset(spark, path, as_of=steps[0], settings=SETTINGS)
    for up_to in people:
        growth.add_customers(spark, path, source, settings=SETTINGS, specs=SPECS, rules=[], up_to=up_to)
    for to in steps[1:]:
        growth.advance(spark, path, source, to=to, settings=SETTINGS, specs=SPECS, rules=[])
    return dataset.read_dataset(spark, path, specs=SPECS)


T0, T1, T2 = datetime(2025, 2, 1), datetime(2025, 4, 1), datetime(2025, 6, 1)


def same(a, b):
    plain = lambda t: {n: df.drop("batch_id") for n, df in t.items()}
    a, b = plain(a), plain(b)
    return set(a) == set(b) and all(
        tuple(incremental.slice_equivalence(a[n], b[n].select(a[n].columns)).first()) == (0, 0) for n in a)


def test_steps_equal_one_step(spark, source, tmp_path):
    once = grow(spark, str(tmp_path / "once"), source, T0, T2)
    assert same(grow(spark, str(tmp_path / "steps"), source, T0, T1, T2), once)
    assert same(grow(spark, str(tmp_path / "people"), source, T0, T2, people=("C0000002", None)), once)
    late = incremental.late_reviews(
        dataset.read_dataset(spark, str(tmp_path / "steps"), specs=SPECS | {
            "reviews": TableSpec(SPECS["reviews"].ddl + ", batch_id INT")})["reviews"],
        dataset.read_dataset(spark, str(tmp_path / "steps"), specs=SPECS | {
            "order_lines": TableSpec(SPECS["order_lines"].ddl + ", batch_id INT")})["order_lines"])
    assert late.count() > 0


def test_growth_is_idempotent_and_refuses_other_settings(spark, source, tmp_path):
    path = str(tmp_path)
    grow(spark, path, source, T0, T1)
    before = dataset.committed_batches(spark, path)
    again = growth.advance(spark, path, source, to=T1, settings=SETTINGS, specs=SPECS, rules=[])
    assert again.batch_id is None and "nothing to do" in again.note
    assert growth.add_customers(spark, path, source, settings=SETTINGS, specs=SPECS, rules=[]).batch_id is None
    growth.init_dataset(spark, path, as_of=T0, settings=SETTINGS)
    assert dataset.committed_batches(spark, path) == before
    with pytest.raises(ValueError, match="other settings"):
        growth.init_dataset(spark, path, as_of=T0, settings={"start": "2020-01-01"})
    with pytest.raises(ValueError, match="other settings"):
        growth.advance(spark, path, source, to=T2, settings={}, specs=SPECS)
    with pytest.raises(FileNotFoundError):
        growth.current(spark, str(tmp_path / "none"))


def test_waiting_texts_are_filled_once(spark, source, tmp_path):
    path = str(tmp_path)
    specs = SPECS | {"review_texts": TableSpec("review_id STRING, review_text STRING")}
    grow(spark, path, source, T0, T1)
    texts = source["reviews"].select("review_id", F.lit("fine").alias("review_text"))
    fill = lambda df: growth.fill_texts(spark, path, df, settings=SETTINGS, writer="w", specs=specs, rules=[])
    some = fill(texts.where("review_id < 'RO000000010'"))
    rest = fill(texts)
    assert some.counts["review_texts"] == 10 and rest.batch_id == some.batch_id + 1
    assert fill(texts).batch_id is None
    stored = dataset.read_dataset(spark, path, specs=specs)
    assert stored["review_texts"].count() == stored["reviews"].count()


def test_slices_share_no_row_and_leave_none_out(spark):
    df = orders(spark, 0, 100)
    border = datetime(2025, 1, 31)
    first = incremental.time_slice(df, "ordered_at", until=border)
    second = incremental.time_slice(df, "ordered_at", since=border)
    assert tuple(incremental.slice_equivalence(first.union(second), df).first()) == (0, 0)
    assert tuple(incremental.slice_equivalence(first.union(first), df).first()) == (31, 69)
    assert incremental.missing_keys(df, first, "order_id").count() == second.count()


def test_runs_are_saved_and_loaded(spark, tmp_path):
    results = spark.createDataFrame([("k", 0, 5)], "review_key STRING, sentence_index INT, latency_ms BIGINT")
    for _ in range(2):
        caches.save_run(results, str(tmp_path), run="a", seconds=2.0, concurrency=8)
    caches.save_run(results, str(tmp_path), run="b", seconds=4.0, concurrency=8)
    loaded, runs = caches.load_runs(spark, str(tmp_path))
    assert {r.run for r in loaded.collect()} == {"a", "b"} and loaded.count() == 2
    assert {r.run: r.seconds for r in runs.collect()} == {"a": 2.0, "b": 4.0}


def test_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Cluster()

        class conf:
            get = staticmethod(lambda name, default=None: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        feed_session.shared_dir(Session())
    assert feed_session.fresh_path(spark, "x") != feed_session.fresh_path(spark, "x")


def test_a_broken_batch_leaves_no_commit(spark, source, tmp_path):
    path = str(tmp_path)
    growth.init_dataset(spark, path, as_of=T0, settings=SETTINGS)
    dry = growth.add_customers(spark, path, source, settings=SETTINGS, specs=SPECS, rules=["order_customer"], dry_run=True)
    assert dry.batch_id is None and dry.counts["customers"] == 7 and dataset.committed_batches(spark, path) == [0]
    growth.add_customers(spark, path, source, settings=SETTINGS, specs=SPECS, rules=["order_customer"])
    before = dataset.committed_batches(spark, path)
    orphans = source | {"order_lines": source["order_lines"].withColumn("order_id", F.lit("O-none"))}
    lines = orphans["order_lines"]
    with pytest.raises(ValueError, match="broken rules"):
        growth.check_batch({"order_lines": lines}, dataset.read_dataset(spark, path, specs=SPECS), specs=SPECS,
                           rules=["line_order"])
    assert dataset.committed_batches(spark, path) == before
    other = str(tmp_path / "tables")
    source["customers"].write.parquet(f"{other}/customers.parquet")
    with pytest.raises(ValueError, match="no commit list"):
        growth.init_dataset(spark, other, as_of=T0, settings=SETTINGS)


def test_the_stream_asks_again_for_what_failed(spark, tmp_path):
    arriving, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    catalogue = spark.createDataFrame([("Kettle",)], "product_name STRING")
    healthy = tmp_path / "healthy"
    flag = str(healthy)

    def ask(row):
        if not __import__("os").path.exists(flag):
            raise TimeoutError("busy")
        return {"answers": {"frustration": {"score": 1.0, "confidence": 1.0}}}

    scorer = classify.per_sentence(ask, model="m", concurrency=1)

    def run(rows):
        spark.createDataFrame(rows, REVIEWS).coalesce(1).write.mode("append").parquet(arriving)
        classify_stream(spark, arriving, sink, checkpoint, reviews_ddl=REVIEWS, catalogue=catalogue, scorer=scorer,
                        columns=KEY, partitions=1).awaitTermination()

    run([("R1", "Kettle", "Good. Fine.")])
    assert stored_answers(spark, sink).where("error IS NOT NULL").count() == 2
    healthy.touch()
    run([("R2", "Kettle", "New.")])  # the second run answers what failed in the first
    answers = stored_answers(spark, sink)
    assert answers.count() == 3 and answers.where("error IS NOT NULL").count() == 0
    healthy.unlink()
    run([("R3", "Kettle", "Another.")])
    healthy.touch()
    retry = lambda: retry_failed(spark, sink, catalogue=catalogue, scorer=scorer, columns=KEY)
    assert retry() == 1 and retry() == 0
    answers = stored_answers(spark, sink)
    assert answers.count() == answers.select(*KEY).distinct().count() == 4
    assert answers.where("error IS NOT NULL").count() == 0


REVIEWS = "review_id STRING, product_name STRING, review_text STRING"


def test_stream_scores_each_text_once(spark, tmp_path):
    arriving, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def ask(row):
        with open(f"{folder}/{row['review_key']}-{row['sentence_index']}-{len(__import__('os').listdir(folder))}", "w"):
            pass
        return {"answers": {"frustration": {"score": 1.0, "confidence": 1.0}}}

    catalogue = spark.createDataFrame([("Kettle",)], "product_name STRING")

    def run(rows):
        if rows:
            spark.createDataFrame(rows, REVIEWS).coalesce(1).write.mode("append").parquet(arriving)
        classify_stream(spark, arriving, sink, checkpoint, reviews_ddl=REVIEWS, catalogue=catalogue,
                        scorer=classify.per_sentence(ask, model="m", concurrency=1), columns=KEY,
                        partitions=1).awaitTermination()

    run([("R1", "Kettle", "Good. Fine."), ("R2", "Kettle", "Good. Fine.")])
    assert len(list(calls.iterdir())) == 2
    run([("R3", "Kettle", "Good. Fine."), ("R4", "Kettle", "New.")])
    assert len(list(calls.iterdir())) == 3  # the known text is not asked again
    run([])
    assert stored_sentences(spark, sink).count() == 7
    answers = stored_answers(spark, sink)
    assert answers.count() == 3 and answers.select(*KEY).distinct().count() == 3
    assert len(dataset.committed_batches(spark, sink)) == 2
    # a batch whose commit is missing is invisible
    spark.createDataFrame([], answers.drop("batch_id").schema).write.parquet(f"{sink}/answers/batch_id=99")
    assert stored_answers(spark, sink).count() == 3


def test_a_batch_moves_its_text_once(spark):
    ddl = "review_id BIGINT, product_name STRING, review_text STRING, review_key STRING"
    reviews = spark.createDataFrame([(2, "Kettle", "One. Two. Three.", "a"), (1, "Kettle", "One. Two. Three.", "a"),
                                     (3, "Kettle", "Four.", "b"), (4, None, "Five.", None), (5, "Kettle", None, None)], ddl)
    settled = spark.createDataFrame([("a", 1), ("c", 0), (None, 0)], "review_key STRING, sentence_index INT")
    for partitions in (None, 3):
        asked = to_ask(reviews, settled, partitions)
        assert [tuple(r) for r in asked.orderBy("review_key", "sentence_index").collect()] == [
            (1, "a", "Kettle", 0, 3, "One."), (1, "a", "Kettle", 2, 3, "Three."), (3, "b", "Kettle", 0, 1, "Four.")]
        plan = plan_of(asked)
        assert plan.count("Exchange") == 1 and "Join" not in plan
    assert asked.rdd.getNumPartitions() == 3  # scoring has as many tasks as it asks for
    assert to_ask(reviews.limit(0), settled, 2).count() == 0


def test_failed_sentences_come_back_beside_their_errors(spark):
    def ask(row):
        assert list(row) == KEY
        if row["sentence_index"]:
            raise TimeoutError("busy")
        return {"answers": {}}

    asked = spark.createDataFrame([(7, "a", "Kettle", 0, 2, "One."), (7, "a", "Kettle", 1, 2, "Two."), (8, None, "Kettle", 1, 2, "x")],
                                  "review_id BIGINT, review_key STRING, product_name STRING, sentence_index INT, "
                                  "sentence_count INT, sentence STRING")
    raw = classify.score_sentences(asked, classify.per_sentence(ask, model="m"), columns=KEY, partitions=2,
                                   beside_errors=["review_id", "sentence_count", "sentence"])
    rows = {(r.review_key, r.sentence_index): (r.error is None, r.review_id, r.sentence_count, r.sentence) for r in raw.collect()}
    assert rows == {("a", 0): (True, None, None, None), ("a", 1): (False, 7, 2, "Two."), (None, 1): (False, 8, 2, "x")}


def test_stored_answers_without_products_meet_no_names(spark):
    catalogue = spark.createDataFrame([("Kettle",)], "product_name STRING")
    said = lambda name: '{"' + name + '": {"probability": 0.9}}'
    raw = spark.createDataFrame(
        [("a", 0, said("mentions__kettle"), None), ("a", 1, said("\\u006dentions__kettle"), None), ("a", 2, "{}", None),
         ("a", 3, None, "busy"), ("b", 0, said("mentions__pan"), None), (None, 0, "{}", None), ("c", 0, None, None)],
        "review_key STRING, sentence_index INT, answers_json STRING, error STRING").selectExpr(
        "review_key", "sentence_index", "answers_json", "'m' AS model", "1L AS input_tokens", "1L AS output_tokens",
        "1L AS latency_ms", "error")
    together, apart = (sorted(map(str, classify.flatten_answers(raw, catalogue, stored=s).collect())) for s in (False, True))
    assert together == apart and sum("['Kettle']" in row for row in apart) == 2
    plain = classify.flatten_answers(raw.where("NOT contains(answers_json, 'entions')"), catalogue, stored=True)
    assert plain.count() == 2


def test_only_columns_asked_for_are_gathered_from_stored_answers(spark, tmp_path):
    arriving, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame([("R1", "Kettle", "Good. Fine.")], REVIEWS).write.parquet(arriving)
    classify_stream(spark, arriving, sink, checkpoint, reviews_ddl=REVIEWS, columns=KEY, partitions=1,
                    catalogue=spark.createDataFrame([("Kettle",)], "product_name STRING"),
                    scorer=classify.per_sentence(lambda row: {"answers": {}}, model="m")).awaitTermination()
    some = stored_answers(spark, sink, columns=["model"])
    assert some.columns == [*KEY, "model"] and some.count() == 2
    gathered = [line for line in plan_of(some).splitlines() if "min_by" in line]
    assert gathered and not any("latency_ms, answers_json" in line.split("AS first")[0] for line in gathered)


def test_a_table_is_not_broadcast_by_its_size_on_disk(spark, tmp_path):
    """A product list of a few MB on disk takes many times that in the driver: only small guesses count."""
    path = str(tmp_path / "products")
    spark.range(150_000).select(F.col("id").alias("product_id"), F.md5(F.col("id").cast("string")).alias("product_name")) \
        .coalesce(1).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "products").glob("*.parquet"))
    assert 2 * feed_session.GUESSED_BYTES < size < 10 << 20
    reviews = spark.range(3_000_000).select("id", (F.col("id") % 150_000).alias("product_id"))
    assert "BroadcastHashJoin" not in plan_of(reviews.join(spark.read.parquet(path), "product_id"))
    for allowed, guessed, measured in (("20MB", "262144b", "20MB"), ("256k", "256k", None), ("-1", "-1", None)):
        other = spark.newSession()
        other.conf.set(feed_session.GUESSED, allowed)
        for _ in range(2):
            feed_session.tune(other)
            assert (other.conf.get(feed_session.GUESSED), other.conf.get(feed_session.MEASURED, None)) == (guessed, measured)


def test_tables_with_broken_rules_are_written_with_what_was_broken(spark, tmp_path):
    tables = {"orders": orders(spark, 0, 3).withColumn("order_total", F.lit(-1.0)), "customers": base(spark)["customers"]}
    path = str(tmp_path / "kept")
    dataset.write_dataset(tables, path, rules=["order_customer"], refuse=False)
    assert dataset.read_dataset(spark, path)["orders"].count() == 3
    known = {r.customer_id for r in tables["customers"].collect()}
    strangers = [f"C{k:07d}" for k in range(3) if f"C{k:07d}" not in known]
    broken = {r.rule: (r.violations, r["sample"]) for r in dataset.broken_rules(spark, path).collect()}
    assert broken.pop("orders: order_total is in range") == (3, "")
    assert list(broken.values()) == [(len(strangers), ";".join(strangers))]
    with pytest.raises(ValidationError):
        dataset.write_dataset(tables, path, rules=["order_customer"])
    with pytest.raises(ValidationError, match="expected"):
        dataset.write_dataset({"orders": tables["orders"].drop("batch_id")}, path, refuse=False)


def test_dataset_query_writes_tables_whose_ids_have_gaps(spark, tmp_path):
    """Reviews find their order by a position, so with gaps in the ids some texts have none; the rows are written all the same."""
    sf, apart = "/root/testdata/sf0.001", {"orders": "o_orderkey", "lineitem": "l_orderkey"}
    for name in ("customer", "orders", "lineitem", "part", "nation", "documents", "labels"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        if name in apart:
            df = df.withColumn(apart[name], F.col(apart[name]) * 3)
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = {r["table"]: r["rows"] for r in all_queries.runner("write_dataset")(spark, str(tmp_path)).collect()}
    n = {name: spark.read.parquet(f"{tmp_path}/{name}.parquet").count() for name in ("customer", "orders", "lineitem", "documents")}
    assert (rows["customers"], rows["orders"], rows["order_lines"], rows["review_texts"]) == tuple(n.values())
    assert 0 < rows["reviews"] < n["documents"]


def test_sentences_are_not_shuffled_to_be_written_with_their_answers(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("customer", "nation", "orders", "lineitem", "part", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(k, None if k == 2 else f"It leaks {k % 3 // 2}. The pot broke, and it is the worst.  No.", "en", "s", 9)
                           for k in (0, 1, 2, 3, 4, 4, 5)], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    d = Domain(spark, str(tmp_path))
    plain, ours = d.classified(), Domain(spark, str(tmp_path)).classified_by_review()
    assert ours.dtypes == plain.dtypes and sorted(map(str, ours.collect())) == sorted(map(str, plain.collect()))
    assert plain.count() == 24 and ours.where("model IS NOT NULL").count() > 0
    with feed_session.kept_together(spark):
        plan = plan_of(ours.select("review_id", "sentence", "model"))
    moved = [line for line in plan.splitlines() if " Exchange " in line]
    assert len(moved) == 2 and not any("sentence_index" in line for line in moved)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
