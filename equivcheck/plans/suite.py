"""Suites: drawing relation pairs from a seed, running, judging and replaying them.

A suite is a list of *cases*.  Case ``Origin`` of a set is the plain query and
``Other<n>`` a rewritten form; all of them are stored as rows with everything
needed to build them again.  These lists live on the driver: their length is set
by the suite's configuration and not by the data.  Every case is one Spark job
that writes its result, and every judgement reads two written results.
"""

from __future__ import annotations

import random
import threading
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, fields, replace
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck import types
from equivcheck.functions.predicates import ExpressionPool, quantiles, splitting_predicates
from equivcheck.plans import multiset
from equivcheck.plans.compare import ATOL, DIFF, EQUAL, ERROR, RTOL, Verdict, compare, diff_rows
from equivcheck.plans.multiset import Digest
from equivcheck.plans.relations import RELATIONS, Params, origin, other
from equivcheck.plans.report import FAILED, SKIPPED, SUCCESS, TIMED_OUT
from equivcheck.session import exists, remove
from equivcheck.streaming.bounded import Handle, run_bounded

# Ranges that windows are drawn from, in milliseconds.
WINDOW_MS = (200, 20_000)
OUTER_STEP_MS = 120
OUTER_STEPS = (20, 200)  # both included
INNER_DIVISORS = [1, 2, 3, 4, 5]

ORIGIN = "Origin"


@dataclass(frozen=True)
class SuiteSource:
    """A source for suites.  ``scales`` are the decimal digits of double columns.

    With ``stream`` the cases run over that streaming frame, each as a query of its own up to the end
    of its input; ``frame`` then only serves to draw literals and predicates from.
    """

    name: str
    frame: DataFrame
    scales: dict[str, int] = field(default_factory=dict)
    key: str = "key"
    stream: DataFrame | None = None

    @property
    def value_fields(self) -> list[str]:
        return [
            f.name
            for f in self.frame.schema
            if f.name not in ("ts", self.key) and types.is_numeric(f.dataType)
        ]


@dataclass(frozen=True)
class SuiteConfig:
    """``time_scale`` stretches the windows for sources slower than a few rows per second."""

    relations: tuple[str, ...] = tuple(RELATIONS)
    reps: int = 2
    others: int = 5
    depth: int = 3
    seed: int = 0
    time_scale: int = 1
    mode: str | None = None  # None: tagged where it gives the same rows in one scan
    timeout_s: float | None = None
    parallel_sets: int = 1
    atol: float = ATOL
    rtol: float = RTOL


@dataclass(frozen=True)
class Case:
    run_id: int
    set_id: int
    case_id: str
    strategy: str
    source: str
    field: str | None
    scale: int | None
    window_ms: int | None
    inner_ms: int | None
    key: str
    expr: str | None
    predicate: str | None
    mode: str
    result_path: str

    def params(self) -> Params:
        return Params(
            self.field, self.scale, self.window_ms, self.inner_ms, self._keys(), self.expr
        )

    def _keys(self) -> tuple[str, ...]:
        return (self.key,) if RELATIONS[self.strategy].family == "keyagg" else ()

    def build(self, source: SuiteSource, frame: DataFrame | None = None) -> DataFrame:
        rel = RELATIONS[self.strategy]
        frame = source.frame if frame is None else frame
        if self.case_id == ORIGIN:
            return origin(rel, frame, self.params())
        return other(rel, frame, self.params(), self.predicate, self.mode)


CASE_SCHEMA = (
    "run_id INT, set_id INT, case_id STRING, strategy STRING, source STRING, field STRING, "
    "scale INT, window_ms BIGINT, inner_ms BIGINT, key STRING, expr STRING, predicate STRING, "
    "mode STRING, result_path STRING"
)
EXEC_SCHEMA = (
    "run_id INT, set_id INT, case_id STRING, strategy STRING, status STRING, reason STRING"
)
RESULT_SCHEMA = (
    "run_id INT, set_id INT, case_id STRING, strategy STRING, relation STRING, "
    "left_rows BIGINT, right_rows BIGINT, differing BIGINT, tolerant BOOLEAN, maybe BOOLEAN, "
    "reason STRING"
)


SCHEMAS = {
    "test_sets": CASE_SCHEMA,
    "test_set_execs": EXEC_SCHEMA,
    "test_set_results": RESULT_SCHEMA,
}


def plan_suite(
    sources: Iterable[SuiteSource], config: SuiteConfig, out: str, run_id: int = 0
) -> list[Case]:
    """Draw all cases of a run from its seed.  Each other has a predicate of its own."""
    sources = list(sources)
    rng = random.Random(f"{config.seed}/{run_id}")
    wanting: dict[str, list[int]] = {}
    samples: dict[str, dict[str, list]] = {}
    cases = []
    for at, strategy in enumerate(config.relations):
        rel = RELATIONS[strategy]
        for rep in range(config.reps):
            set_id = at * config.reps + rep
            source = rng.choice(sources)
            if rel.uses_predicate and source.name not in samples:
                samples[source.name] = quantiles(source.frame)
            literals = samples.get(source.name)
            path = _result_path(out, run_id, set_id, ORIGIN)
            first = _draw_origin(rel, source, rng, config, literals, (run_id, set_id), path)
            cases.append(first)
            for n in range(config.others):
                predicate = inner = None
                if rel.uses_predicate:
                    wanting.setdefault(source.name, []).append(len(cases))
                elif rel.family == "winpart":
                    inner = first.window_ms // rng.choice(INNER_DIVISORS)
                cases.append(
                    replace(
                        first,
                        case_id=f"Other{n}",
                        predicate=predicate,
                        inner_ms=inner,
                        result_path=_result_path(out, run_id, set_id, f"Other{n}"),
                    )
                )
    frames = {s.name: s.frame for s in sources}
    for name, places in wanting.items():
        seed = rng.getrandbits(32)
        drawn = splitting_predicates(frames[name], seed, len(places), config.depth, samples[name])
        for place, predicate in zip(places, drawn, strict=True):
            cases[place] = replace(cases[place], predicate=predicate)
    return cases


def _draw_origin(rel, source: SuiteSource, rng, config, literals, ids, path) -> Case:
    name = window = expr = None
    if rel.family == "map":
        bigints = T.StructType([f for f in source.frame.schema if f.dataType == T.LongType()])
        expr = ExpressionPool(bigints, rng.getrandbits(32), literals).number(T.LongType(), 1)
    elif rel.family != "filter":
        name = rng.choice(source.value_fields)
        if rel.family == "winpart":
            window = rng.randint(*OUTER_STEPS) * OUTER_STEP_MS
        else:
            window = rng.randrange(*WINDOW_MS)
        window *= config.time_scale
    run_id, set_id = ids
    return Case(
        run_id,
        set_id,
        ORIGIN,
        rel.name,
        source.name,
        name,
        source.scales.get(name),
        window,
        None,
        source.key,
        expr,
        None,
        config.mode or ("tagged" if rel.family in ("agg", "keyagg") else "union"),
        path,
    )


def run_dir(out: str, run_id: int) -> str:
    return f"{out}/run-{run_id}"


def _result_path(out: str, run_id: int, set_id: int, case_id: str) -> str:
    return f"{run_dir(out, run_id)}/results/set{set_id}-{case_id}"


def execute(
    case: Case,
    sources: dict[str, SuiteSource],
    timeout_s: float | None,
    digests: dict[str, Digest] | None = None,
) -> tuple:
    """Run one case and write its result: (status, reason).

    A batch result's digest is put into ``digests`` under its path.
    """
    source = sources[case.source]
    spark = source.frame.sparkSession
    tag = f"equivcheck-{case.run_id}-{case.set_id}-{case.case_id}"
    expired, ended, handle = threading.Event(), threading.Event(), Handle()

    def watch():
        if ended.wait(timeout_s):
            return
        expired.set()
        handle.stop()
        # A query that is being planned has no job yet: cancel until the case has ended.
        while not ended.is_set():
            spark.sparkContext.cancelJobsWithTag(tag)
            ended.wait(0.5)

    spark.sparkContext.addJobTag(tag)
    try:
        if timeout_s:
            threading.Thread(target=watch, daemon=True).start()
        if source.stream is not None:
            _stream(case, source, handle)
            return SUCCESS, None
        frame = case.build(source)
        if expired.is_set():  # while the query was being planned there was no job to cancel
            return TIMED_OUT, None
        found = multiset.write(frame, case.result_path)
        if found is not None and digests is not None:
            digests[case.result_path] = found
        return SUCCESS, None
    except Exception as error:  # a failed query is a finding of the suite, not the end of it
        return (TIMED_OUT, None) if expired.is_set() else (FAILED, str(error).split("\n")[0])
    finally:
        ended.set()
        spark.sparkContext.removeJobTag(tag)


def _stream(case: Case, source: SuiteSource, handle: Handle) -> None:
    """Run a case over its source's stream into an empty folder."""
    remove(source.frame.sparkSession, case.result_path)
    windows = RELATIONS[case.strategy].agg is not None
    run_bounded(
        source.stream, lambda df: case.build(source, df), windows=windows, out=case.result_path, handle=handle
    )


def run_set(
    spark: SparkSession,
    cases: list[Case],
    sources: dict[str, SuiteSource],
    config: SuiteConfig,
) -> tuple[list[tuple], list[tuple]]:
    """Run and judge one set.  Without an origin there is nothing to judge: others are skipped."""
    first, rest = cases[0], cases[1:]
    execs, results = [], []
    digests: dict[str, Digest] = {}

    def note(case: Case, status: str, reason: str | None) -> None:
        execs.append((case.run_id, case.set_id, case.case_id, case.strategy, status, reason))

    status, reason = execute(first, sources, config.timeout_s, digests)
    note(first, status, reason)
    for case in rest:
        if execs[0][4] != SUCCESS:
            note(case, SKIPPED, f"origin: {execs[0][4]}")
            continue
        status, reason = execute(case, sources, config.timeout_s, digests)
        note(case, status, reason)
        if status == SUCCESS:
            verdict = _verdict(spark, first, case, config, digests)
            head = (case.run_id, case.set_id, case.case_id, case.strategy)
            results.append((*head, *asdict(verdict).values()))
    return execs, results


def judge(
    spark: SparkSession,
    first: Case,
    case: Case,
    config: SuiteConfig,
    digests: dict[str, Digest] | None = None,
) -> Verdict:
    """Compare two written results; those with equal digests are not read again."""
    left, right = ((digests or {}).get(c.result_path) for c in (first, case))
    if left is not None and left == right:
        return Verdict(EQUAL, left.rows, right.rows, 0)
    return compare(
        spark.read.parquet(first.result_path),
        spark.read.parquet(case.result_path),
        atol=config.atol,
        rtol=config.rtol,
    )


def _verdict(spark: SparkSession, first: Case, case: Case, config: SuiteConfig, digests=None) -> Verdict:
    try:
        return judge(spark, first, case, config, digests)
    except Exception as error:  # a comparison that fails is a finding as well
        return Verdict(ERROR, reason=str(error).split("\n")[0])


def run_suite(
    spark: SparkSession,
    sources: Iterable[SuiteSource],
    config: SuiteConfig,
    out: str,
    run_id: int = 0,
) -> DataFrame:
    """Plan and run a suite, write its three tables, return the verdicts."""
    sources = list(sources)
    cases = plan_suite(sources, config, out, run_id)
    return run_cases(spark, sources, cases, config, run_dir(out, run_id))


def run_suites(
    spark: SparkSession, sources: Iterable[SuiteSource], config: SuiteConfig, out: str, runs: int
) -> tuple[DataFrame, DataFrame]:
    """Several runs, each with predicates of its own; executions and verdicts of all of them."""
    sources = list(sources)
    for run_id in range(runs):
        run_suite(spark, sources, config, out, run_id)
    return stored_runs(spark, out, runs)


def stored_runs(spark: SparkSession, out: str, runs: int) -> tuple[DataFrame, DataFrame]:
    """Executions and verdicts of stored runs, as the reports take them."""
    tables = []
    for name in ("test_set_execs", "test_set_results"):
        parts = [read_table(spark, run_dir(out, i), name) for i in range(runs)]
        tables.append(reduce(DataFrame.unionByName, parts))
    return tables[0], tables[1]


def run_cases(
    spark: SparkSession,
    sources: Iterable[SuiteSource],
    cases: list[Case],
    config: SuiteConfig,
    target: str,
    done_before: frozenset[int] = frozenset(),
) -> DataFrame:
    """Run cases set by set; the sets in ``done_before`` have been stored and are left as they are."""
    by_name = {s.name: s for s in sources}
    sets: dict[int, list[Case]] = {}
    for case in cases:
        sets.setdefault(case.set_id, []).append(case)
    done: dict[int, tuple] = {}

    def store(name: str, part: str, rows: list[tuple]) -> None:
        frame = spark.createDataFrame(rows, SCHEMAS[name])
        frame.coalesce(1).write.mode("overwrite").parquet(f"{target}/{name}/{part}")

    def work(set_id: int) -> None:
        done[set_id] = run_set(spark, sets[set_id], by_name, config)
        # What a set found is kept, whatever becomes of the sets after it.
        for name, rows in zip(("test_set_execs", "test_set_results"), done[set_id], strict=True):
            store(name, f"set-{set_id}", rows)

    if not done_before:
        store("test_sets", "all", [tuple(asdict(c).values()) for c in cases])
        for name in ("test_set_execs", "test_set_results"):
            store(name, "none", [])
    for set_id in done_before:
        sets.pop(set_id, None)

    if config.parallel_sets > 1:
        # Sets are independent; their jobs share the cluster.
        def in_own_thread(set_id: int) -> None:
            thread = InheritableThread(target=work, args=(set_id,), session=spark)
            thread.start()
            thread.join()

        with ThreadPoolExecutor(config.parallel_sets) as pool:
            list(pool.map(in_own_thread, sets))
    else:
        for set_id in sets:
            work(set_id)

    return read_table(spark, target, "test_set_results")


def read_table(spark: SparkSession, target: str, name: str) -> DataFrame:
    """One of the run's tables: ``test_sets``, ``test_set_execs`` or ``test_set_results``."""
    stored = spark.read.schema(SCHEMAS[name]).option("recursiveFileLookup", True)
    # One file per set: the rows are as many as the suite has cases.
    return stored.parquet(f"{target}/{name}").orderBy("run_id", "set_id", "case_id")


def load_cases(
    spark: SparkSession, target: str, set_id: int, case_id: str | None = None
) -> list[Case]:
    """Stored cases of one set, origin first; or the origin and one of the others."""
    stored = read_table(spark, target, "test_sets").where(F.col("set_id") == set_id)
    if case_id is not None:
        stored = stored.where(F.col("case_id").isin(ORIGIN, case_id))
    names = [f.name for f in fields(Case)]
    cases = [Case(**{n: row[n] for n in names}) for row in stored.collect()]
    if not cases or (case_id and case_id not in {c.case_id for c in cases}):
        raise KeyError(f"no stored set {set_id}, case {case_id}")
    return sorted(cases, key=lambda c: (c.case_id != ORIGIN, c.case_id))


def _stored_sets(spark: SparkSession, target: str) -> dict[int, list[Case]]:
    """All stored cases by set, origins first: as many as the suite was configured to have."""
    names = [f.name for f in fields(Case)]
    sets: dict[int, list[Case]] = {}
    for row in read_table(spark, target, "test_sets").collect():
        sets.setdefault(row.set_id, []).append(Case(**{n: row[n] for n in names}))
    return {i: sorted(cases, key=lambda c: (c.case_id != ORIGIN, c.case_id)) for i, cases in sets.items()}


def finished_sets(spark: SparkSession, target: str) -> frozenset[int]:
    """Sets that were run and judged to their end.

    Verdicts are stored after executions, and Spark marks a folder that is written to its end.
    """
    marks = [i for i in _stored_sets(spark, target) if exists(spark, f"{target}/test_set_results/set-{i}/_SUCCESS")]
    return frozenset(marks)


def resume(
    spark: SparkSession, sources: Iterable[SuiteSource], target: str, config: SuiteConfig
) -> DataFrame:
    """Go on with an interrupted run: sets without an end are run, the others are kept as stored."""
    cases = [c for stored in _stored_sets(spark, target).values() for c in stored]
    done = finished_sets(spark, target)
    return run_cases(spark, sources, cases, config, target, done)


def recheck(spark: SparkSession, target: str, config: SuiteConfig, folder: str) -> DataFrame:
    """Judge the stored results of a run again, without running a query; verdicts go below ``folder``.

    Cases are those that ended with success, as was their origin.  Verdicts of several settings of the
    tolerance can thereby lie side by side.
    """
    execs = read_table(spark, target, "test_set_execs").where(F.col("status") == SUCCESS)
    good = {(r.set_id, r.case_id) for r in execs.select("set_id", "case_id").collect()}
    rows = []
    for set_id, (first, *rest) in sorted(_stored_sets(spark, target).items()):
        for case in rest if (set_id, first.case_id) in good else []:
            if (set_id, case.case_id) in good:
                head = (case.run_id, case.set_id, case.case_id, case.strategy)
                rows.append((*head, *asdict(_verdict(spark, first, case, config)).values()))
    frame = spark.createDataFrame(rows, RESULT_SCHEMA)
    frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/test_set_results")
    return read_table(spark, folder, "test_set_results")


def redirect(case: Case, folder: str) -> Case:
    """The same query with another sink."""
    return replace(case, result_path=f"{folder}/set{case.set_id}-{case.case_id}")


def replay(
    spark: SparkSession,
    sources: Iterable[SuiteSource],
    target: str,
    set_id: int,
    config: SuiteConfig,
    folder: str,
    case_id: str | None = None,
) -> DataFrame:
    """Run a stored set, or one stored case and its origin, again with results below ``folder``."""
    cases = [redirect(c, f"{folder}/results") for c in load_cases(spark, target, set_id, case_id)]
    return run_cases(spark, sources, cases, config, folder)


def extract_diffs(
    spark: SparkSession, target: str, folder: str, config: SuiteConfig | None = None
) -> DataFrame:
    """Write the differing rows of every case judged ``Diff``; returns those verdicts.

    Rows with a partner within the suite's tolerance are no differences.

    Every case has a folder of its own below ``folder`` and its run, so the
    extracts of several runs lie side by side.
    """
    config = config or SuiteConfig()
    verdicts = read_table(spark, target, "test_set_results").where(F.col("relation") == DIFF)
    sets = {}
    for row in verdicts.select("run_id", "set_id", "case_id").collect():
        if row.set_id not in sets:
            sets[row.set_id] = {c.case_id: c for c in load_cases(spark, target, row.set_id)}
        left, right = (
            spark.read.parquet(sets[row.set_id][c].result_path) for c in (ORIGIN, row.case_id)
        )
        path = f"{folder}/run-{row.run_id}/set{row.set_id}-{row.case_id}"
        diff_rows(left, right, config.atol, config.rtol).write.mode("overwrite").parquet(path)
    return verdicts
