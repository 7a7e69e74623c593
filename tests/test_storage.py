"""Files, run history, streaming."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsieve.operators import mapping, policy, repeats, runs
from claimsieve.plans.pipeline import score_claims
from claimsieve.sources import files, records
from claimsieve.sources.run_store import CommitConflict, RunStore
from claimsieve.streaming import history
from claimsieve.streaming.history import stream_policy_history
from claimsieve.streaming.scoring import score_stream

#: Ten claims and the scores that the rule weights give them by hand.
SAMPLE = """claim_id,total_claim_amount,incident_hour_of_the_day,age,incident_state,incident_severity,incident_type,witnesses
A-01,3200,10,61,WA,Minor Damage,Parked Car,4
A-02,82000,0,47,OR,Minor Damage,Single Vehicle Collision,2
A-03,152500,13,19,FL,Minor Damage,Multi-vehicle Collision,1
A-04,260700,15,50,NV,Major Damage,Vehicle Theft,3
A-05,305000,4,33,TX,Total Loss,Parked Car,0
A-06,100000,11,40,OH,Minor Damage,Single Vehicle Collision,2
A-07,9100,5,70,NY,Minor Damage,Multi-vehicle Collision,0
A-08,41300,18,22,IL,Major Damage,Multi-vehicle Collision,0
A-09,170000,9,58,CA,Minor Damage,Parked Car,0
A-10,700,2,36,AZ,Minor Damage,Vehicle Theft,1
"""
SCORES = [0, 12 + 15, 20 + 28, 30 + 25, 100, 12, 12 + 15, 25 + 20, 20 + 12 + 22, 25]


@pytest.fixture()
def upload(spark, tmp_path):
    path = tmp_path / "claims.csv"
    path.write_text(SAMPLE)
    return files.read_claims_csv(spark, str(path))


def test_sample_upload_scores(upload):
    found = score_claims(upload).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in found] == list(range(10))
    # A-05: (18 + 25 + 30 + 22 + 25 + 20) * 1.3, capped.
    assert [r["risk_score"] for r in found] == SCORES


def test_row_index_over_many_files_and_splits(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).repartitionByRange(6, "id").sortWithinPartitions("id").selectExpr("id", "repeat('x', 50) AS pad").write.option("header", True).csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = files.read_claims_csv(spark, path)
        assert found.where("row_idx <> CAST(id AS BIGINT)").count() == 0
        assert found.count() == 1000
        keyed = files.read_claims_csv(spark, path, order_key="id")
        assert keyed.where("row_idx <> CAST(id AS BIGINT)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_results_round_trip(spark, upload, tmp_path):
    scored = score_claims(upload)
    files.write_results_csv(scored, str(tmp_path / "csv"))
    back = files.read_results_csv(spark, str(tmp_path / "csv"))
    expected = {tuple(r) for r in files.results_columns(scored).collect()}
    assert {tuple(r) for r in back.collect()} == expected
    exported = files.results_columns(scored)
    files.write_results_json(exported, str(tmp_path / "json"))
    assert {tuple(r) for r in files.read_results_json(spark, str(tmp_path / "json"), exported.schema).collect()} == expected


def test_store_and_read_runs(spark, upload, tmp_path):
    path = str(tmp_path / "store")
    scored = score_claims(upload)
    for i in range(2):
        files.store_run(scored, path, f"run{i}", 1.0 + i, F.lit(dt.datetime(2024, 1, 1, i)))
    stored = files.read_runs(spark, path)
    assert stored.count() == 2
    record = stored.where("run_id = 'run1'").first()
    assert (record["claims_count"], record["high_risk_count"], record["runtime"]) == (10, 1, 2.0)
    stats = runs.session_statistics(stored, now=F.lit(dt.datetime(2024, 1, 1, 3))).first()
    assert (stats["total_analyses"], stats["total_claims"], stats["avg_runtime"], stats["session_duration"]) == (2, 20, 1.5, 3.0)
    text = json.loads(runs.export_session_json(stored, F.lit(dt.datetime(2024, 1, 1, 3))).first()[0])
    assert [r["runtime"] for r in text["analysis_history"]] == [1.0, 2.0]
    assert text["session_statistics"]["total_claims"] == 20


def test_run_ids_stay_text_and_empty_runs_are_zeros(spark, upload, tmp_path):
    path = str(tmp_path / "store")
    scored = score_claims(upload)
    files.store_run(scored.where("false"), path, "none", 0.5)
    files.store_run(scored, path, "007", 1.0)
    found = {r["run_id"]: (r["claims_count"], r["high_risk_count"], r["avg_risk_score"], r["runtime"]) for r in files.read_runs(spark, path).collect()}
    assert found["none"] == (0, 0, 0.0, 0.5)
    assert found["007"][:2] == (10, 1) and found["007"][2] == pytest.approx(sum(SCORES) / 10)
    stored = files.read_stored_results(spark, path)
    assert {r[0] for r in stored.select("run_id").distinct().collect()} == {"007"} and stored.count() == 10


def test_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("claim_id,amount,note\nA,100,x\n")
    (tmp_path / "b.csv").write_text('note,claim_id,amount\n"say ""hi"", you",B,200\n')
    (tmp_path / "c.csv").write_text("amount,claim_id\n300,C\n")
    found = files.read_claims_csv(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [tuple(r) for r in found] == [("A", "100", "x", 0), ("B", "200", 'say "hi", you', 1), ("C", "300", None, 2)]


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('claim_id,note\nA,"one\ntwo"\nB,x\n')
    with pytest.raises(ValueError, match="multi_line"):
        files.read_claims_csv(spark, str(tmp_path))
    found = files.read_claims_csv(spark, str(tmp_path), multi_line=True).orderBy("row_idx").collect()
    assert [tuple(r) for r in found] == [("A", "one\ntwo", 0), ("B", "x", 1)]


AWKWARD = (
    'id,a,b,c\n1,x,,""\n2,"say ""hi""","q,r",z\r\n\n   \n3,short\n4,a,b,c,extra\n5," lead",trail ,"é"\n'
    '6,"multi\nline","two\r\nbreaks\n\nblank",x\n7,,,\n8,"1,""\n9,2",y,z'
)
AWKWARD_ROWS = [
    ("1", "x", None, None), ("2", 'say "hi"', "q,r", "z"), ("3", "short", None, None), ("4", "a", "b", "c"), ("5", " lead", "trail ", "é"),
    ("6", "multi\nline", "two\r\nbreaks\n\nblank", "x"), ("7", None, None, None), ("8", '1,"\n9,2', "y", "z"),
]


@pytest.mark.parametrize("range_bytes", [1, 2, 7, 64, 1 << 20])
def test_ranges_may_begin_anywhere(spark, tmp_path, range_bytes):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + AWKWARD.encode())
    (tmp_path / "b.csv").write_bytes(b"")
    (tmp_path / "c.csv").write_text("\n \nid,a,b,c\n")
    (tmp_path / "d.csv").write_text("id,a,b,c\nlast,1,2,3\n\n")
    found = files.read_claims_csv(spark, str(tmp_path), multi_line=True, range_bytes=range_bytes).orderBy("row_idx").collect()
    assert [tuple(r) for r in found] == [(*r, i) for i, r in enumerate([*AWKWARD_ROWS, ("last", "1", "2", "3")])]


@pytest.mark.parametrize("multi_line", [False, True])
def test_index_holds_when_splits_change_after_the_call(spark, tmp_path, multi_line):
    path = str(tmp_path / "many")
    spark.range(1000).repartitionByRange(3, "id").sortWithinPartitions("id").selectExpr("id", "repeat('x', 50) AS pad").write.option("header", True).csv(path)
    name = "spark.sql.files.maxPartitionBytes"
    for before, after in (("4096", "128m"), ("128m", "4096")):
        spark.conf.set(name, before)
        found = files.read_claims_csv(spark, path, multi_line=multi_line, range_bytes=5000)
        spark.conf.set(name, after)
        try:
            assert found.count() == 1000 and found.where("row_idx <> CAST(id AS BIGINT)").count() == 0
        finally:
            spark.conf.unset(name)


def test_pieces_of_a_range_and_open_quotes(spark, tmp_path, monkeypatch):
    import io

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    monkeypatch.setattr(records, "PIECE_BYTES", 5)
    monkeypatch.setattr(records, "TAIL_BYTES", 3)
    source = Source(AWKWARD.encode())
    size, whole = source.size(), [r for part in records.solid_records(source, 0, source.size(), False, True) for r in part]
    assert len(whole) == 1 + len(AWKWARD_ROWS)
    for cut in range(size + 1):
        inside = AWKWARD.encode()[:cut].count(b'"') % 2 == 1
        first = [r for part in records.solid_records(source, 0, cut, False, True) for r in part] if cut else []
        second = [r for part in records.solid_records(source, cut, size, inside, True) for r in part] if cut else whole
        assert first + second == whole
        if cut:
            quotes, outside, _ = records.tally_range(source, 0, cut, True)
            assert (quotes % 2 == 1, outside) == (inside, len(first))
            assert records.tally_range(source, cut, size, True)[2 if inside else 1] == len(second)
    monkeypatch.setattr(records, "MOST_RECORD_BYTES", 20)
    with pytest.raises(ValueError, match="left open"):
        list(records.find_records(Source(b'a,"' + b"x" * 50), 0, 10, False, True))


def test_upload_is_not_shuffled_for_its_index(upload):
    plan = upload._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Sort " not in plan


# --- stored runs ----------------------------------------------------------------
def ids(frame):
    return sorted(r[0] for r in frame.select("claim_id").collect())


def test_a_repeated_call_replaces_keeps_or_is_refused(spark, upload, tmp_path):
    store, scored = RunStore(spark, str(tmp_path / "store")), score_claims(upload)
    store.store(scored, "a", 1.0)
    store.store(scored.where("row_idx < 4"), "a", 2.0)
    assert store.results().count() == 4
    assert [(r["claims_count"], r["runtime"]) for r in store.runs().collect()] == [(4, 2.0)]
    assert store.store(scored, "a", 3.0, on_repeat="keep") == 2
    with pytest.raises(ValueError, match="there is a run a"):
        store.store(scored, "a", 3.0, on_repeat="refuse")
    assert store.versions() == [1, 2] and store.results().count() == 4
    # Readers of the first version still have it.
    assert store.results(version=1).count() == 10


def test_data_without_a_commit_is_not_read(spark, upload, tmp_path, monkeypatch):
    store, scored = RunStore(spark, str(tmp_path / "store")), score_claims(upload)
    store.store(scored, "a", 1.0)

    def broken(*_):
        raise OSError("the writer dies")

    with monkeypatch.context() as patched:
        patched.setattr(RunStore, "_commit", broken)
        with pytest.raises(OSError):
            store.store(scored, "b", 1.0)
    assert store.runs().count() == 1 and store.results().count() == 10
    assert store.vacuum(older_than=3600) == 0
    assert store.vacuum(older_than=0) == 3
    store.store(scored, "b", 1.0)
    assert store.runs().count() == 2 and store.results().count() == 20


def test_two_writers_at_a_time(spark, upload, tmp_path, monkeypatch):
    first, second, scored = RunStore(spark, str(tmp_path / "store")), RunStore(spark, str(tmp_path / "store")), score_claims(upload)
    commit, late = RunStore._commit, []

    def slow(self, version, entries):
        if self is first and not late:
            late.append(version)
            second.store(scored, "second", 2.0)
        commit(self, version, entries)

    monkeypatch.setattr(RunStore, "_commit", slow)
    first.store(scored, "first", 1.0)
    assert late == [1] and first.versions() == [1, 2]
    assert {r["run_id"] for r in first.runs().collect()} == {"first", "second"}
    with pytest.raises(CommitConflict):
        commit(first, 2, [])


def test_retention_merging_and_cleaning(spark, upload, tmp_path):
    store, scored = RunStore(spark, str(tmp_path / "store")), score_claims(upload)
    for i in range(4):
        store.store(scored.where(f"row_idx % 4 = {i}"), f"run{i}", 1.0, F.timestamp_seconds(F.lit(i)))
    all_rows, files_before = ids(store.results()), len(store.results().inputFiles())
    store.compact()
    assert ids(store.results()) == all_rows and len(store.results().inputFiles()) == 1 < files_before
    version = store.retain(2)
    assert sorted(e["run_id"] for e in store.entries()) == ["run2", "run3"]
    assert ids(store.results()) == ids(scored.where("row_idx % 4 > 1"))
    assert ids(store.results(version=version - 1)) == all_rows
    # A run replaced after merging: its old rows stay in the merged files, unseen.
    store.store(scored.where("row_idx = 0"), "run2", 1.0, F.timestamp_seconds(F.lit(2)))
    assert ids(store.results(["run2"])) == ids(scored.where("row_idx = 0"))
    assert runs.rollup_kpis(store.rollup()).first()["total_analyzed"] == 1 + scored.where("row_idx % 4 = 3").count()
    store.vacuum(older_than=0)
    assert len(store.versions()) == 1 and ids(store.results()) == ids(scored.where("row_idx = 0 OR row_idx % 4 = 3"))


def test_merging_sorts_chunks_and_not_whole_files(spark, tmp_path, monkeypatch):
    store, plans = RunStore(spark, str(tmp_path / "store")), []
    rows = spark.range(20_000).selectExpr("id AS row_idx", "CAST(id AS STRING) AS claim_id", "md5(CAST(id AS STRING)) AS note", "id % 101 * 1.0D AS final_risk_score", "'Low' AS risk_level", "'Legitimate' AS fraud_prediction")
    for i in range(4):
        store.store(rows.where(f"row_idx % 4 = {i}"), f"run{i}", 1.0, F.timestamp_seconds(F.lit(i)))
    size = sum(f.stat().st_size for f in (tmp_path / "store" / "data").rglob("*.parquet"))
    stage = RunStore._stage

    def seen(self, df, folder):
        if folder == "data":
            plans.append((df._jdf.queryExecution().executedPlan().toString(), df.rdd.getNumPartitions()))
        return stage(self, df, folder)

    monkeypatch.setattr(RunStore, "_stage", seen)
    store.compact(file_bytes=size // 2)
    assert max(n for plan, n in plans if "Sort" in plan) <= 3 * 16 + 1 and min(n for plan, n in plans if "Sort" in plan) >= 2 * 16
    assert len(store.results().inputFiles()) <= 3 and len({e["data"] for e in store.entries()}) == 1
    found = store.results().groupBy("run_id").agg(F.count("*").alias("n"), F.min(F.col("row_idx") % 4).alias("low"), F.max(F.col("row_idx") % 4).alias("high"))
    assert {tuple(r) for r in found.collect()} == {(f"run{i}", 5_000, i, i) for i in range(4)}
    # The chunks are gone: four runs as stored, and the merged ones.
    assert len(list((tmp_path / "store" / "data").iterdir())) == 5


def test_runs_with_other_columns(spark, upload, tmp_path):
    store, scored = RunStore(spark, str(tmp_path / "store")), score_claims(upload)
    store.store(scored, "a", 1.0)
    store.store(scored.withColumn("note", F.lit("x")), "b", 1.0)
    found = store.results()
    assert found.where("run_id = 'a' AND note IS NULL").count() == 10 and found.where("note = 'x'").count() == 10
    with pytest.raises(ValueError, match="no such run"):
        store.results(["c"])


def test_rollups_add_up(spark, upload, tmp_path):
    store, scored = RunStore(spark, str(tmp_path / "store")), score_claims(upload).withColumn("timestamp", F.timestamp_seconds(F.col("row_idx") * 40_000))
    store.store(scored.where("row_idx < 3"), "a", 1.0)
    store.store(scored.where("row_idx >= 3"), "b", 1.0)
    rolled = store.rollup()
    assert runs.rollup_kpis(rolled).first() == runs.dashboard_kpis(scored).first()
    assert runs.rollup_top_rules(rolled, 4).collect() == runs.top_rules(scored, 4).collect()
    assert {tuple(r) for r in runs.rollup_counts(rolled, "day", "day").collect()} == {tuple(r) for r in runs.daily_claim_counts(scored).collect()}
    assert runs.rollup_kpis(rolled.where("false")).first() == runs.dashboard_kpis(scored.where("false")).first()


def test_repeats_across_runs_are_exact_and_filtered_before_the_shuffle(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    columns = "CAST(id AS STRING) AS claim_id", "'Low' AS risk_level", "1D AS final_risk_score", "'N' AS fraud_prediction"
    ranges = {"a": (0, 3000), "b": (2900, 6000), "c": (6000, 9000), "d": (2950, 2960)}
    for name, (start, end) in ranges.items():
        store.store(spark.range(start, end).selectExpr(*columns), name, 1.0)
    nulls = spark.range(3).selectExpr("CAST(NULL AS STRING) AS claim_id", *columns[1:])
    store.store(nulls.union(spark.range(2999, 3001).selectExpr(*columns)).union(spark.range(2999, 3000).selectExpr(*columns)), "e", 1.0)
    expected = {}
    for name, (start, end) in [*ranges.items(), ("e", (2999, 3001))]:
        for i in range(start, end):
            expected.setdefault(str(i), []).append(name)
    expected["2999"].append("e")
    expected = {i: (len(set(runs)), len(runs)) for i, runs in expected.items() if len(set(runs)) > 1}
    found = store.repeated_ids()
    assert {r["claim_id"]: (r["runs"], r["n"]) for r in found.collect()} == expected
    plain = mapping.count_duplicate_ids(store.results().withColumn("row_idx", F.lit(1))).first()[0]
    assert store.count_duplicate_ids().first()[0] == plain
    # The filter stands below the first exchange.
    plan = store.repeated_ids()._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.rindex("Exchange") < plan.index("ArrowEvalPython")
    candidates = repeats.possible_repeats(store.results(), store.id_filters())
    assert candidates.count() - sum(n for _, n in expected.values()) < 9000 * 4 * 3 * repeats.FALSE_POSITIVES


def test_filters_know_their_ids_and_few_others(spark):
    ids = spark.range(20_000).selectExpr("CAST(id AS STRING) AS claim_id")
    bits = repeats.bits_for(20_000)
    filled = np.frombuffer(bytes(repeats.build_filter(ids.repartition(5), "claim_id", bits).first()[0]), np.uint8)
    assert 8 * len(filled) == bits >= repeats.BITS_PER_ID * 20_000
    hashes = spark.range(40_000).select(*repeats.id_hashes(F.col("id").cast("string"))).toPandas()
    found = repeats.known(filled, hashes["h1"].to_numpy(), hashes["h2"].to_numpy())
    assert found[:20_000].all() and found[20_000:].mean() < 2 * repeats.FALSE_POSITIVES
    assert repeats.bits_for(0) == repeats.LEAST_BITS and repeats.bits_for(10**12) == repeats.MOST_BITS


# --- policy history of a stream ---------------------------------------------------
HISTORY = "row_idx long, policy_number string, incident_date date"


def run_stream(spark, tmp_path, batches, **settings):
    """Rows that a stream gives for batches of claims, one file each, in order."""
    source, found = tmp_path / "in", tmp_path / "out"
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, HISTORY).coalesce(1).write.mode("append").parquet(str(source))
        claims = spark.readStream.schema(HISTORY).option("maxFilesPerTrigger", 1).parquet(str(source))
        writer = stream_policy_history(claims, **settings).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        writer.option("checkpointLocation", str(tmp_path / "progress")).start(str(found)).awaitTermination()
    return {r["row_idx"]: (r["days_since_last_claim"], r["claims_last_30d"], r["rule_high_frequency"]) for r in spark.read.parquet(str(found)).collect()}


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_a_stream_in_random_order_gives_the_batch_columns(spark, tmp_path):
    rng = np.random.default_rng(4)
    claims = [(i, "hot" if i % 3 == 0 else f"p{rng.integers(0, 9)}" if i % 20 else None, day(int(rng.integers(0, 90)))) for i in range(300)]
    shuffled = [claims[i] for i in rng.permutation(300)]
    found = run_stream(spark, tmp_path, [shuffled[:150], shuffled[150:], [(999, "ahead", day(400))]], delay="95 days")
    batch = policy.policy_history(spark.createDataFrame(claims, HISTORY)).collect()
    assert found == {r["row_idx"]: (r["days_since_last_claim"], r["claims_last_30d"], r["rule_high_frequency"]) for r in batch}


def test_stream_state_is_called_for_buckets_of_policies(spark, tmp_path):
    # Two hundred policies in three buckets: each bucket has several policies with histories of their own, and one policy is forgotten.
    rng = np.random.default_rng(8)
    claims = [(i, f"p{rng.integers(0, 200)}" if i % 25 else None, day(int(rng.integers(0, 120)))) for i in range(900)]
    shuffled = [claims[i] for i in rng.permutation(900)]
    found = run_stream(spark, tmp_path, [shuffled[:400], shuffled[400:], [(999, "ahead", day(500))]], delay="125 days", buckets=3)
    batch = policy.policy_history(spark.createDataFrame(claims, HISTORY)).collect()
    assert found == {r["row_idx"]: (r["days_since_last_claim"], r["claims_last_30d"], r["rule_high_frequency"]) for r in batch}
    states = spark.read.format("statestore").load(str(tmp_path / "progress"))
    assert 0 < states.count() <= 4


def test_settled_days_come_in_steps():
    never = np.array([history.NEVER, history.NEVER])
    none = (np.zeros(0, int),) * 3
    # Claims of day 1 in two steps, and a policy that is forgotten after 50 days.
    last, counts, out = history.settle(never, none, (np.array([0, 0, 1]), np.array([5, 1, 1]), np.array([12, 11, 10])), 50)
    assert out[["place", "row", "since", "recent"]].values.tolist() == [[0, 11, -1, 1], [0, 12, 4, 2], [1, 10, -1, 1]] and last.tolist() == [5, 1]
    last, counts, out = history.settle(last, counts, (np.array([0, 0, 1]), np.array([31, 31, 52]), np.array([21, 20, 22])), 50)
    # Day 1 is 30 days before day 31 and counts; policy 1's claim is 51 days later, so its first.
    assert out[["place", "row", "since", "recent"]].values.tolist() == [[0, 20, 26, 4], [0, 21, 0, 4], [1, 22, -1, 1]]
    assert [part.tolist() for part in counts] == [[0, 0, 1], [5, 31, 52], [1, 2, 1]]


def test_late_claims_are_left_out_and_old_policies_forgotten(spark, tmp_path):
    batches = [
        [(1, "a", day(0)), (2, "b", day(1)), (3, "a", day(3))],
        [(4, "x", day(40))],
        # Day 2 has been settled by now.
        [(5, "a", day(2)), (6, "a", day(45)), (7, "b", day(60))],
        [(8, "x", day(300))],
    ]
    found = run_stream(spark, tmp_path, batches, delay="5 days", forget_days=50)
    # Policy b's last claim was 59 days before.
    assert found == {1: (-1, 1, 0), 2: (-1, 1, 0), 3: (3, 2, 0), 4: (-1, 1, 0), 6: (42, 1, 0), 7: (-1, 1, 0)}
    with pytest.raises(ValueError, match="remembered"):
        stream_policy_history(spark.readStream.schema(HISTORY).parquet(str(tmp_path / "in")), forget_days=30)


def test_sketches_of_many_runs_keep_their_error_bound(spark):
    rows = spark.range(50_000).selectExpr("CAST(id % 20 AS STRING) AS run_id", "pow(hash(id) % 1000, 2) AS total_claim_amount", "IF(id % 7 = 0, NULL, id % 101) AS final_risk_score", "'Low' AS risk_level")
    rolled = runs.rollup(rows)
    assert rolled.where("kind = 'sketch'").count() == 40
    shares = {"q10": 0.1, "q50": 0.5, "q99": 0.99}
    for found in runs.rollup_quantiles(rolled, shares).collect():
        values = sorted(r[0] for r in rows.select(found["col"]).dropna().collect())
        for name, share in shares.items():
            below, upto = sum(v < found[name] for v in values) / len(values), sum(v <= found[name] for v in values) / len(values)
            assert below - 0.005 <= share <= upto + 0.005


def test_no_runs_give_zeros(spark):
    empty = spark.createDataFrame([], "timestamp timestamp, run_id string, claims_count long, high_risk_count long, fraud_predictions long, runtime double")
    stats = runs.session_statistics(empty).first()
    assert set(stats) == {0}
    assert runs.high_risk_pct(empty).first()[0] == 0 and runs.avg_runtime(empty).first()[0] == 0


def test_retention_keeps_the_newest(spark):
    many = spark.range(60).selectExpr("timestamp_seconds(id) AS timestamp", "CAST(id AS STRING) AS run_id", "id AS claims_count", "0L AS high_risk_count")
    kept = runs.retain_last_runs(many)
    assert kept.count() == 50 and kept.agg(F.min("claims_count")).first()[0] == 10
    assert [r["claims_count"] for r in runs.recent_runs(many, 3).collect()] == [59, 58, 57]


def test_stream_scores_like_the_batch(spark, upload, tmp_path):
    source = str(tmp_path / "source")
    canonical = upload.selectExpr("claim_id", *[f"CAST({c} AS DOUBLE) AS {c}" for c in ("total_claim_amount", "incident_hour_of_the_day", "age", "witnesses")], "incident_severity", "incident_type")
    canonical.write.parquet(source)
    stream = score_stream(spark.readStream.schema(canonical.schema).parquet(source))
    query = stream.writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    found = {r["claim_id"]: r["risk_score"] for r in spark.table("arrived").collect()}
    assert found == {r["claim_id"]: r["risk_score"] for r in score_claims(upload).collect()}
