"""All jobs wired together over one set of inputs.

:class:`ProblemListMetrics` exposes each intermediate and published table as a
lazily built attribute.  Tables that several jobs read are materialised once
(``materialise``: ``table`` writes Parquet to the shared checkpoint folder and
reads it back, ``checkpoint`` uses ``DataFrame.checkpoint``, ``persist`` keeps
them on the executors, ``none`` keeps plain lazy plans).  Without ``outputs`` every table is; with ``outputs`` only those that
the jobs behind them read more than once (:func:`shared_tables`), the rest stay lazy plans.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dxlens.operators.dyadic import GAIN, KeyLoads, key_depths, pairs_of, plain_partitions
from dxlens.operators.intervals import DEFAULT_TASK_PAIRS
from dxlens.plans import billing, report, snapshot, stays, terminology
from dxlens.sources.sinks import delete_path, materialise, publish, table_root, write_table

DEFAULT_STUDY_END = "2015-06-06"


@dataclass
class Inputs:
    descr: DataFrame
    relats: DataFrame
    pldata: DataFrame
    disch: DataFrame
    billdata: DataFrame

    @classmethod
    def from_mapping(cls, tables: dict[str, DataFrame]) -> Inputs:
        return cls(**{k: tables[k] for k in ("descr", "relats", "pldata", "disch", "billdata")})


# What each job reads of the others, once for every scan of it.
GRAPH: dict[str, tuple[str, ...]] = {
    "names": (), "log": (),
    "terms": ("names", "log"),
    "hot_patients": ("log",),
    "loads": ("hot_patients", "hot_patients", "hot_patients", "log", "log"),   # one test, one join to either side; the size and pairs
    "concepts": ("terms",),
    "snapshot_pairs": ("log", "concepts", "loads"),
    "snapshot": ("snapshot_pairs", "terms"),
    "latest": ("log", "log", "concepts", "loads", "terms"),
    "candidate_closure": ("concepts",),
    "closure": ("candidate_closure", "latest"),
    "subsumption": ("latest", "latest", "closure"),
    "problems": ("latest", "latest", "subsumption", "closure", "terms"),
    "summary": ("problems", "problems"),
    "disch2": ("summary",),
    "updated_during": ("log", "terms", "loads"),
    "present_during": ("log", "terms", "loads"),
    "pr_present": ("present_during", "loads"),
    "pr_updated": ("updated_during",),
    "pusumm": ("pr_present", "pr_updated"),
    "disch3": ("disch2", "pusumm"),
    "outside": ("log", "updated_during"),
    "billdata": (),
    "match_concept": ("present_during", "loads"),
    "match_dx": ("match_concept",),
    "stats_dx": ("match_dx",),
    "stats_concept": ("match_concept",),
    "match_stats": ("match_concept",),
    "disch4": ("disch3", "match_stats"),   # of declared outputs; of all tables, the stored stats_dx and stats_concept
}
# tables that are files already when they are built
_FILES = {"candidate_closure"}


def needed_tables(outputs: Iterable[str]) -> set[str]:
    """``outputs`` and all tables on the way to them."""
    todo, needed = list(outputs), set()
    while todo:
        job = todo.pop()
        if job not in needed:
            needed.add(job)
            todo.extend(GRAPH[job])
    return needed


def shared_tables(outputs: Iterable[str]) -> set[str]:
    """Tables that are read more than once on the way to ``outputs`` (named once for every read of the caller)."""
    reads = Counter(outputs)
    needed = needed_tables(reads)
    for job in needed:
        reads.update(GRAPH[job])
    # a selection or a pair of tables is read through, not stored
    for through in ("concepts", "loads", "snapshot"):
        if reads[through] > 1:
            reads.update(GRAPH[through])
    stored = {job for job, n in reads.items() if n > 1} - {"concepts", "loads", "snapshot", "billdata"} - _FILES
    # both readers of the match group it as it is dealt: they share its last shuffle
    stored -= {"match_concept"}
    # both statistics of a stay come from one pass
    stored |= {"match_stats"} & needed
    # names in use meet the edits of every range join; from a file the planner knows how few they are
    return stored | ({"terms"} & needed)


class ProblemListMetrics:
    """Problem-list quality metrics for one set of inputs.

    ``integer_ratio`` reproduces truncating integer ratios (see
    :func:`dxlens.functions.ratios.percent`); ``study_end`` censors readmission
    times; ``outputs`` names the attributes the caller reads, once for every read; ``task_pairs`` is the number of edit x stay pairs above which range joins
    split a patient over several tasks; ``max_depth`` limits the closure (default: no limit).
    """

    def __init__(self, inputs: Inputs, *, study_end: str = DEFAULT_STUDY_END, integer_ratio: bool = False,
                 materialise: str = "table", task_pairs: int = DEFAULT_TASK_PAIRS,
                 max_depth: int | None = None, outputs: Iterable[str] | None = None):
        self.inputs = inputs
        self.study_end = study_end
        self.integer_ratio = integer_ratio
        self.how = materialise
        self.task_pairs = task_pairs
        self.max_depth = max_depth
        outputs = None if outputs is None else list(outputs)
        self.shared = None if outputs is None else shared_tables(outputs)
        # problems that the caller does not read are stored without the columns that no other job reads
        self.measured_only = outputs is not None and not {"latest", "problems"} & set(outputs)
        self.text_ids_apart = outputs is not None and "match_concept" not in outputs
        self.present_only = outputs is not None and "present_during" not in outputs
        self._tables: list[str] = []

    @property
    def spark(self) -> SparkSession:
        return self.inputs.pldata.sparkSession

    def _keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Materialise a table that several jobs read."""
        if self.shared is not None and name not in self.shared:
            return df
        if self.how != "table":
            return materialise(df, self.how, name)
        out, path = write_table(df, name)
        self._tables.append(path)
        return out

    def release(self) -> None:
        """Delete the tables this pipeline materialised (call when done with its results)."""
        for path in self._tables:
            delete_path(self.spark, path)
        self._tables.clear()
        for name in list(self.__dict__):
            if name not in ("inputs", "study_end", "integer_ratio", "how", "task_pairs", "max_depth", "shared", "measured_only", "text_ids_apart", "present_only", "_tables"):
                del self.__dict__[name]

    # -- terminology ---------------------------------------------------------
    @cached_property
    def names(self) -> DataFrame:
        """D1 ``descrshort``."""
        return self._keep(terminology.current_names(self.inputs.descr), "names")

    @cached_property
    def terms(self) -> DataFrame:
        """Current names of the concepts that occur in the edit log.

        Every later name join only meets these concepts; the table is at most
        one row per concept in use (plus tied names), small enough for the
        planner to broadcast from its exact stored size.
        """
        used = self.log.select(F.col("snomed").alias("conceptid")).where(F.col("conceptid").isNotNull())
        return self._keep(self.names.join(used.distinct(), "conceptid", "left_semi"), "terms")

    @cached_property
    def hot_patients(self) -> DataFrame:
        """Patients whose edit x stay pairs outweigh dyadic copies, with their depth.

        Shared by the three range joins (D5, D13, D14); the counts are upper
        bounds for the distinct projections D14 joins.
        """
        return self._keep(key_depths(self.log.where(F.col("ptid").isNotNull()), self.inputs.disch.where(F.col("ptid").isNotNull()),
                                     ["ptid"], self.task_pairs), "hot_patients")

    @cached_property
    def loads(self) -> KeyLoads:
        """The hot patients, and whether one of them may need the grid as well; the partitions that all pairs fill.

        A plain patient has at most ``GAIN`` pairs a row; a hot one counts as the rows that its pairs stand for as well.
        """
        rows = self.log.count() + self.inputs.disch.count()
        if self.hot_patients.isEmpty():
            return KeyLoads(self.hot_patients, False, plain_partitions(self.spark, rows))
        rows += pairs_of(self.log, self.inputs.disch, ["ptid"], self.hot_patients) // GAIN
        return KeyLoads(self.hot_patients, not self.hot_patients.where("_grid").isEmpty(),
                        dealt=plain_partitions(self.spark, rows))

    @cached_property
    def concepts(self) -> DataFrame:
        return self.terms.select("conceptid").distinct()

    # -- problem log ---------------------------------------------------------
    @cached_property
    def log(self) -> DataFrame:
        """Edit log with back-filled noted dates (published as ``problem_log``)."""
        return self._keep(snapshot.backfill_noted(self.inputs.pldata), "log")

    @cached_property
    def snapshot(self) -> DataFrame:
        """D5 ``dcprobstemp1`` with names."""
        return snapshot.attach_terms(self.snapshot_pairs, self.terms, snapshot.SNAPSHOT_COLUMNS)

    @cached_property
    def snapshot_pairs(self) -> DataFrame:
        """D5 pairs without names (``dcprobstemp1`` before the name join)."""
        return self._keep(snapshot.snapshot_pairs(self.log, self.inputs.disch, self.concepts, self.task_pairs,
                                                  self.loads), "snapshot_pairs")

    @cached_property
    def latest(self) -> DataFrame:
        """D6 ``pldata2`` before the flag columns."""
        if self.loads.partitions:
            rows = snapshot.latest_in_place(self.log, self.inputs.disch, self.concepts, self.task_pairs, self.loads)
        else:
            keys = snapshot.snapshot_keys(self.log, self.inputs.disch, self.concepts, self.task_pairs, self.loads)
            rows = snapshot.latest_from_keys(keys, self.log, self.inputs.disch)
        columns = snapshot.MEASURED_COLUMNS if self.measured_only else snapshot.SNAPSHOT_COLUMNS
        return self._keep(snapshot.attach_terms(rows, self.terms, columns), "latest")

    @cached_property
    def candidate_closure(self) -> DataFrame:
        """Descendant closure of every named concept in the edit log.

        The D7 seeds (concepts of the latest problems) are a subset of these,
        and each seed's descendants do not depend on the other seeds, so D7 is
        this table restricted to its seeds.  Needing only the concepts in use,
        it can run while the snapshot is still being built.
        """
        edges = terminology.isa_edges(self.inputs.relats)
        root = f"{table_root(self.spark)}/closure-{uuid.uuid4().hex}"
        self._tables.append(root)
        return terminology.descendant_closure(edges, self.concepts, max_depth=self.max_depth, root=root)

    @cached_property
    def closure(self) -> DataFrame:
        """D7 ``closure``: the candidate closure of the concepts of the latest problems."""
        seeds = terminology.concept_seeds(self.latest)
        return self._keep(self.candidate_closure.join(
            seeds, self.candidate_closure.destinationid == seeds.conceptid, "left_semi"), "closure")

    @cached_property
    def subsumption(self) -> DataFrame:
        """D8 ``subsumed`` pairs."""
        return self._keep(snapshot.subsumption_pairs(self.latest, self.closure), "subsumption")

    @cached_property
    def problems(self) -> DataFrame:
        """``pldata2`` with all flags: D6a duplic, D8 subsumed, D9 specificity, D10 tags."""
        p = snapshot.with_list_flags(self.latest, self.subsumption)
        return self._keep(terminology.with_concept_facts(p, self.closure, self.terms), "problems")

    @cached_property
    def summary(self) -> DataFrame:
        """D11 ``plsumm``."""
        return self._keep(snapshot.discharge_summary(self.problems, self.integer_ratio), "summary")

    @cached_property
    def disch2(self) -> DataFrame:
        """D12 discharges with readmission and problem-list summary."""
        return self._keep(snapshot.discharge_enrichment(self.inputs.disch, self.summary, self.study_end), "disch2")

    # -- stays ---------------------------------------------------------------
    @cached_property
    def updated_during(self) -> DataFrame:
        """D13."""
        return self._keep(stays.updated_during(self.log, self.inputs.disch, self.terms, self.task_pairs,
                                               self.loads), "updated_during")

    @cached_property
    def present_during(self) -> DataFrame:
        """D14."""
        present = stays.present_during(self.log, self.inputs.disch, self.terms, self.task_pairs, self.loads)
        if self.present_only:   # stored without the names, dates and text ids that no other job reads
            present = present.select(*stays.COUNTED_COLUMNS)
        return self._keep(present, "present_during")

    @cached_property
    def pr_present(self) -> DataFrame:
        """D15."""
        present = self.present_during
        stored = self.shared is None or "present_during" in self.shared
        if stored or self.loads.dealt:  # read back, it has lost how it was dealt; dealt by nodes, a stay is in many partitions
            dealt = [self.loads.tasks] if self.loads.tasks else []
            present = present.repartition(*dealt, "ptid", "dischid")
        return self._keep(stays.active_counts(present), "pr_present")

    @cached_property
    def pr_updated(self) -> DataFrame:
        """D16."""
        return self._keep(stays.update_activity(self.updated_during), "pr_updated")

    @cached_property
    def pusumm(self) -> DataFrame:
        """D17."""
        return self._keep(stays.activity_ratios(self.pr_present, self.pr_updated, self.integer_ratio), "pusumm")

    @cached_property
    def disch3(self) -> DataFrame:
        """D18."""
        return self._keep(stays.discharge_activity(self.disch2, self.pusumm), "disch3")

    @cached_property
    def outside(self) -> DataFrame:
        """D25."""
        return self._keep(stays.edits_outside(self.log, self.updated_during), "outside")

    # -- billing -------------------------------------------------------------
    @cached_property
    def billdata(self) -> DataFrame:
        """D19."""
        return billing.billing_keys(self.inputs.billdata)

    @cached_property
    def match_dx(self) -> DataFrame:
        """D20 ``pbmatchdx``."""
        return self._keep(billing.match_dx_from_concept(self.match_concept), "match_dx")

    @cached_property
    def match_concept(self) -> DataFrame:
        """D21 ``pbmatchpr``."""
        match = billing.match_concept(self.present_during, self.inputs.billdata, self.loads.tasks)
        if self.text_ids_apart:
            match = match.drop("dcbilldxid", "dcxbillid", "dcprobid")
        return self._keep(match, "match_concept")

    @cached_property
    def stats_dx(self) -> DataFrame:
        """D22 ``pbmatchsummdx``."""
        return self._keep(billing.match_stats_dx(self.match_dx), "stats_dx")

    @cached_property
    def stats_concept(self) -> DataFrame:
        """D22 ``pbmatchsummpr``."""
        return self._keep(billing.match_stats_concept(self.match_concept), "stats_concept")

    @cached_property
    def match_stats(self) -> DataFrame:
        """``pbmatchsummdx`` and ``pbmatchsummpr`` side by side."""
        return self._keep(billing.match_stats_both(self.match_concept), "match_stats")

    @cached_property
    def disch4(self) -> DataFrame:
        """The published discharge table."""
        if self.shared is None:
            stats_dx, stats_concept = self.stats_dx, self.stats_concept
        else:
            stats_dx = self.match_stats.select("ptid", "dischid", *billing.DX_STATS)
            stats_concept = self.match_stats.select("ptid", "dischid", *billing.CONCEPT_STATS)
        return self._keep(billing.final_discharge(self.disch3, stats_dx, stats_concept), "disch4")

    def reconciliation(self) -> DataFrame:
        """D24."""
        return report.reconciliation({
            "disch": self.inputs.disch, "plsumm": self.summary, "disch2": self.disch2,
            "pr_updated": self.pr_updated, "pr_present": self.pr_present, "pusumm": self.pusumm,
            "disch3": self.disch3, "billdata": self.inputs.billdata, "disch4": self.disch4})

    # -- running ---------------------------------------------------------------
    # Stages run one after another; the branches of a stage share no table, so
    # they can be computed by concurrent Spark jobs from separate threads.
    RUN_PLAN = [
        [["names"], ["log", "hot_patients"]],
        [["terms"]],
        [["snapshot_pairs", "latest"], ["candidate_closure"],
         ["updated_during", "pr_updated", "outside"],
         ["present_during", "pr_present", "match_concept", "match_dx", "stats_dx", "stats_concept"]],
        [["closure", "subsumption", "problems", "summary", "disch2"]],
        [["pusumm", "disch3", "disch4"]],
    ]

    def compute(self, name: str) -> DataFrame:
        """Build one table and make sure it is computed."""
        df = getattr(self, name)
        if self.how == "none":
            df.write.format("noop").mode("overwrite").save()
        return df

    def run(self, parallel: int = 3, on_step: Callable[[str, float], None] | None = None) -> dict[str, DataFrame]:
        """Compute every table of :attr:`RUN_PLAN`; return the published outputs.

        ``parallel`` bounds the concurrent branches; ``on_step(name, seconds)``
        receives each table's build time.
        """
        def branch(names):
            for name in names:
                t0 = time.time()
                self.compute(name)
                if on_step:
                    on_step(name, time.time() - t0)

        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            for stage in self.RUN_PLAN:
                for future in [pool.submit(branch, names) for names in stage]:
                    future.result()
        return self.outputs()

    # -- SQL access ----------------------------------------------------------
    # Temporary view name -> table, using the table names the metrics were
    # published under, so existing ad-hoc SQL runs unchanged on spark.sql.
    VIEWS = {
        "descr": "inputs.descr", "relats": "inputs.relats", "disch": "inputs.disch", "pldata": "log",
        "descrshort": "names", "dcprobstemp1": "snapshot", "pldata2": "problems", "closure": "closure",
        "subsumed": "subsumption", "plsumm": "summary", "disch2": "disch2", "updated_during": "updated_during",
        "present_during": "present_during", "pr_present": "pr_present", "pr_updated": "pr_updated",
        "pusumm": "pusumm", "disch3": "disch3", "billdata": "billdata", "pbmatchdx": "match_dx",
        "pbmatchpr": "match_concept", "pbmatchsummdx": "stats_dx", "pbmatchsummpr": "stats_concept",
        "disch4": "disch4",
    }

    def register_views(self, prefix: str = "") -> list[str]:
        """Register every table as a temporary view (``prefix`` + name) for ``spark.sql``."""
        names = []
        for view, attr in self.VIEWS.items():
            obj = self
            for part in attr.split("."):
                obj = getattr(obj, part)
            obj.createOrReplaceTempView(prefix + view)
            names.append(prefix + view)
        return names

    def register_functions(self, prefix: str = "") -> list[str]:
        """Register D9's lookups as temporary SQL functions of a concept id: ``DescLookup``, ``LogDescLookup``.

        Their bodies are scalar subqueries over the view of the closure, which the optimizer turns
        into one aggregate and one left join per call site; no row is looked up by itself.
        """
        view, plain, log = prefix + "closure", prefix + "DescLookup", prefix + "LogDescLookup"
        self.closure.createOrReplaceTempView(view)
        count = f"(SELECT count(*) FROM {view} c WHERE c.destinationid = concept)"
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {plain}(concept BIGINT) RETURNS INT RETURN CAST({count} AS INT)")
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {log}(concept BIGINT) RETURNS DOUBLE RETURN log10(1 + {count})")
        return [plain, log]

    # -- outputs -------------------------------------------------------------
    def outputs(self) -> dict[str, DataFrame]:
        """The published tables."""
        return {"discharge_metrics": self.disch4, "updated_during": self.updated_during,
                "present_during": self.present_during, "problem_log": self.log}

    def publish(self, root: str, mode: str = "overwrite") -> dict[str, str]:
        return publish(self.outputs(), root, mode)
