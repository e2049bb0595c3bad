import pytest
from pyspark.sql import functions as F

from equivcheck.plans import report, suite
from equivcheck.plans.compare import compare
from equivcheck.plans.relations import RELATIONS, Params, origin
from equivcheck.sources import generate


@pytest.fixture(scope="module")
def sources(spark):
    made = [
        generate.generate_source(spark, generate.random_source(f"g{i}", 3, 4), 3, 2, 150)
        for i in range(2)
    ]
    return [suite.SuiteSource(m.source.name, m.frame.drop("producer", "row").persist()) for m in made]


@pytest.fixture(scope="module")
def ran(spark, sources, tmp_path_factory):
    out = f"{tmp_path_factory.mktemp('suite')}"
    config = suite.SuiteConfig(
        relations=("Filter", "Map", "AggSum", "KeyAggAvg", "WinPartMax"),
        reps=1, others=2, depth=2, seed=1, parallel_sets=3, timeout_s=600,
    )
    verdicts = suite.run_suite(spark, sources, config, out)
    return out, config, verdicts


def test_every_pair_agrees(spark, ran):
    out, _, verdicts = ran
    rows = verdicts.collect()
    assert len(rows) == 10
    assert all(r.relation in ("Equal", "Reordered") for r in rows), rows
    assert [r.set_id for r in rows] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    execs = suite.read_table(spark, suite.run_dir(out, 0), "test_set_execs")
    assert execs.count() == 15 and execs.where("status != 'Success'").isEmpty()


def test_plans_come_from_the_seed(spark, sources, ran):
    out, config, _ = ran
    again = suite.plan_suite(sources, config, out)
    stored = [c for i in range(5) for c in suite.load_cases(spark, suite.run_dir(out, 0), i)]
    assert stored == again
    assert suite.plan_suite(sources, suite.replace(config, seed=2), out) != again
    assert suite.plan_suite(sources, config, out, run_id=1) != again


def test_replay_of_a_set_and_a_case(spark, sources, ran, tmp_path):
    out, config, _ = ran
    target = suite.run_dir(out, 0)
    verdicts = suite.replay(spark, sources, target, 3, config, f"{tmp_path}/set")
    assert [(r.case_id, r.strategy) for r in verdicts.collect()] == [
        ("Other0", "KeyAggAvg"),
        ("Other1", "KeyAggAvg"),
    ]
    one = suite.replay(spark, sources, target, 2, config, f"{tmp_path}/case", case_id="Other1")
    assert [r.case_id for r in one.collect()] == ["Other1"]
    first, second = suite.load_cases(spark, target, 2, "Other1")
    for case in (first, second):
        moved = suite.redirect(case, f"{tmp_path}/case/results")
        before, after = (spark.read.parquet(c.result_path) for c in (case, moved))
        assert compare(before, after).relation in ("Equal", "Reordered")
    with pytest.raises(KeyError):
        suite.load_cases(spark, target, 99)
    with pytest.raises(KeyError):
        suite.load_cases(spark, target, 2, "Other7")


def _pair(spark, mixed, path, **changes):
    case = suite.Case(
        0, 0, suite.ORIGIN, "AggSum", "mixed", "value", 2, 5000, None, "key", None, None,
        "union", f"{path}/results/set0-Origin",
    )
    return case, suite.SuiteSource("mixed", mixed, {"value": 2})


def test_failures_are_recorded(spark, mixed, tmp_path):
    first, source = _pair(spark, mixed, tmp_path)
    bad = suite.replace(first, case_id="Other0", predicate="(no_such > 1)", result_path=f"{tmp_path}/a")
    good = suite.replace(first, case_id="Other1", predicate="(value > 5)", result_path=f"{tmp_path}/b")
    config = suite.SuiteConfig()
    verdicts = suite.run_cases(spark, [source], [first, bad, good], config, f"{tmp_path}/t")
    assert [(r.case_id, r.relation) for r in verdicts.collect()] == [("Other1", "Equal")]
    execs = suite.read_table(spark, f"{tmp_path}/t", "test_set_execs").collect()
    assert {r.case_id: r.status for r in execs} == {
        "Origin": "Success",
        "Other0": "Failed",
        "Other1": "Success",
    }
    assert "no_such" in [r.reason for r in execs if r.status == "Failed"][0]

    broken = [suite.replace(c, field="no_such") for c in (first, good)]
    suite.run_cases(spark, [source], broken, config, f"{tmp_path}/u")
    execs = suite.read_table(spark, f"{tmp_path}/u", "test_set_execs").collect()
    assert {r.case_id: r.status for r in execs} == {"Origin": "Failed", "Other1": "Skipped"}


def test_timeout(spark, mixed, tmp_path):
    first, _ = _pair(spark, mixed, tmp_path)
    slow = spark.range(10**13).select(
        F.col("id").alias("ts"), F.lit(1).alias("key"), F.col("id").cast("double").alias("value")
    )
    source = suite.SuiteSource("mixed", slow, {"value": 2})
    status, reason = suite.execute(first, {"mixed": source}, timeout_s=2)
    assert (status, reason) == ("TimedOut", None)


def test_diffs_are_extracted_per_run(spark, mixed, tmp_path):
    first, source = _pair(spark, mixed, tmp_path)
    second = suite.replace(first, case_id="Other0", predicate="(real > 0.5)", result_path=f"{tmp_path}/r/o")
    config = suite.SuiteConfig()
    for run in (0, 1):
        cases = [suite.replace(c, run_id=run, result_path=f"{c.result_path}-{run}") for c in (first, second)]
        target = suite.run_dir(f"{tmp_path}/x", run)
        suite.run_cases(spark, [source], cases, config, target)
        # a result that lost its first window
        less = origin(RELATIONS["AggSum"], mixed, Params("value", 2, 5000)).where("start > -5000")
        less.write.mode("overwrite").parquet(cases[1].result_path)
        verdict = suite.judge(spark, *cases, config)
        assert verdict.relation == "Diff" and verdict.differing == 1
        row = (run, 0, "Other0", "AggSum", *suite.asdict(verdict).values())
        spark.createDataFrame([row], suite.RESULT_SCHEMA).write.mode("overwrite").parquet(
            f"{target}/test_set_results"
        )
        suite.extract_diffs(spark, target, f"{tmp_path}/diffs")
    for run in (0, 1):
        (row,) = spark.read.parquet(f"{tmp_path}/diffs/run-{run}/set0-Other0").collect()
        assert (row.side, row.n, row.start) == ("left", 1, -5000)


EXECS = [
    (0, "A", "Success"), (0, "A", "Success"), (0, "A", "Failed"), (0, "B", "Skipped"),
    (1, "A", "Success"), (1, "B", "TimedOut"),
]
RESULTS = [(0, "A", "Equal"), (0, "A", "Diff"), (1, "A", "Reordered")]


@pytest.fixture
def log(spark):
    return (
        spark.createDataFrame(EXECS, "run_id int, strategy string, status string"),
        spark.createDataFrame(RESULTS, "run_id int, strategy string, relation string"),
    )


def test_summary(log):
    got = {(r.run_id, r.strategy): r for r in report.summary(*log).collect()}
    assert set(got) == {(0, "A"), (0, "B"), (1, "A"), (1, "B")}
    a = got[0, "A"]
    assert (a.total_count, a.success_count, a.fail_count, a.total_res_count) == (3, 2, 1, 2)
    assert (a.equal_count, a.reorder_count, a.diff_count) == (1, 0, 1)
    assert (a.exec_success_rate, a.eval_success_rate) == (2 / 3, 0.5)
    assert got[0, "B"].eval_success_rate is None and got[0, "B"].exec_success_rate == 0
    assert got[1, "B"].timeout_count == 1


def test_rollup_and_totals(log):
    rolled = {(r.run_id, r.strategy): r for r in report.summary_rollup(*log).collect()}
    assert set(rolled) == {(0, "A"), (0, "B"), (1, "A"), (1, "B"), (0, "All"), (1, "All"), (None, "All")}
    assert rolled[None, "All"].total_count == 6 and rolled[None, "All"].total_res_count == 3
    totals = {(r.run_id, r.strategy): r for r in report.summary_totals(*log).collect()}
    assert set(totals) - set(rolled) == {(None, "A"), (None, "B")}
    assert totals[None, "A"].success_count == 3


def test_variance_over_runs(log):
    got = {r.strategy: r for r in report.rate_variance(*log).collect()}
    assert abs(got["A"].exec_variance - ((1 - 2 / 3) / 2) ** 2) < 1e-12
    assert got["B"].eval_variance is None


def test_an_interrupted_run_goes_on(spark, mixed, tmp_path, monkeypatch):
    """A run that ends in its third set, and the same run without interruption."""
    config = suite.SuiteConfig(relations=("Filter", "KeyAggSum", "AggCount"), reps=1, others=1, seed=4, time_scale=10)
    sources = [suite.SuiteSource("s", mixed.select("ts", "key", "value", "real"), {"value": 2})]
    whole = suite.run_suite(spark, sources, config, f"{tmp_path}/whole").collect()
    run_set, ran = suite.run_set, []

    def killed(session, cases, *rest):
        ran.append(cases[0].set_id)
        if len(ran) == 3:
            raise KeyboardInterrupt
        return run_set(session, cases, *rest)

    monkeypatch.setattr(suite, "run_set", killed)
    with pytest.raises(KeyboardInterrupt):
        suite.run_suite(spark, sources, config, f"{tmp_path}/cut")
    target = suite.run_dir(f"{tmp_path}/cut", 0)
    assert suite.finished_sets(spark, target) == {0, 1}
    got = suite.resume(spark, sources, target, config).collect()
    assert ran == [0, 1, 2, 2]
    assert [tuple(r) for r in got] == [tuple(r) for r in whole]
    assert suite.finished_sets(spark, target) == {0, 1, 2}
    suite.resume(spark, sources, target, config)
    assert ran == [0, 1, 2, 2]
    # Judged again from what is stored, also with another tolerance.
    again = suite.recheck(spark, target, suite.replace(config, atol=1e-6), f"{tmp_path}/again").collect()
    assert [(r.set_id, r.case_id, r.relation, r.left_rows) for r in again] == [(r.set_id, r.case_id, r.relation, r.left_rows) for r in whole]
