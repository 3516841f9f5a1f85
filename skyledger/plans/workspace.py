"""Shared inputs of the registered queries: adapter views and the prepared tables several of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import behaviour, cases, chain, context, escalation, exposure, graph, ranking
from skyledger.plans import shared_views
from skyledger.plans.oracle import BURST_MIN, BURST_N, COLLAPSE_MIN, PAD_MIN, TRAVEL_MIN
from skyledger.session import cut_lineage
from skyledger.sources import snapshots

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


class Views(dict):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, build: Callable[[str], DataFrame]):
        super().__init__()
        self._build = build

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._build(name)
        return self[name]


class Workspace:
    """Tables of one data folder. Prepared results are written once and shared by the queries that need them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._made: dict[str, object] = {}

    def once(self, name: str, build: Callable[[], object]):
        if name not in self._made:
            self._made[name] = build()
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """Adapter view over the base tables, through table arguments of the SQL text."""
        text = shared_views.on_ordered_lines(shared_views.view_sql(name, shared_views.SPARK))
        used = {t: self.table(t) for t in TABLES if f" {t} " in f"{text} " .replace("\n", " ").replace(")", " ")}
        if " ordered_lines " in text:
            used["ordered_lines"] = self.ordered_lines
        for t, df in used.items():
            df.createOrReplaceTempView(t)
        return self.spark.sql(text)

    @property
    def ordered_lines(self) -> DataFrame:
        """The lines with the customer of their order, joined once for all views that sum them."""
        o, li = self.table("orders"), self.table("lineitem")
        return self.once("ordered_lines", lambda: cut_lineage(
            li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey", "l_suppkey", "l_quantity"), compression="zstd"))

    # events ----------------------------------------------------------------
    @property
    def events(self) -> DataFrame:
        """Normalised events, landed once in time order as an ingest job would leave them.

        Detectors then scan real columns: time and event filters are pushed to files whose ranges exclude most of them.
        The rows are dealt out as they are stored: the sample of the ranges and the shuffle read the few stored columns, and the wide
        event is made once, by all tasks, on its way to the file.
        """
        return self.once("events", lambda: cut_lineage(self.event_view(self.table("events").repartitionByRange("ts"))))

    def event_view(self, base: DataFrame) -> DataFrame:
        """Audit events from the events table, batch or stream."""
        base.createOrReplaceTempView("events")
        none = F.lit(None).cast("string")
        session = F.when(F.col("issuer").isNotNull(), F.struct(
            F.col("issuer").alias("issuer_arn"), F.lit("Role").alias("issuer_type"), none.alias("session_name"), F.lit(None).cast("boolean").alias("mfa_authenticated")))
        rows = self.spark.sql(shared_views.view_sql("ev", shared_views.SPARK))
        return rows.withColumn("session", session).withColumn("bytes_transferred", F.col("bytes"))

    @property
    def history(self) -> DataFrame:
        return self.events.filter(F.col("us") < int(shared_views.SPLIT_US))

    @property
    def current(self) -> DataFrame:
        return self.events.filter(F.col("us") >= int(shared_views.SPLIT_US))

    # permissions -----------------------------------------------------------
    @property
    def permissions(self) -> dict[str, DataFrame]:
        return self.once("permissions", lambda: Views(lambda n: cut_lineage(self.view(n))))

    @property
    def permissions_before(self) -> dict[str, DataFrame]:
        """The earlier snapshot: the same accounts and policies, attachments and trusts as they were."""
        earlier = {n: f"{n}_before" for n in ("attachment", "trust_statement")}
        return self.once("permissions_before", lambda: Views(lambda n: cut_lineage(self.view(earlier[n])) if n in earlier else self.permissions[n]))

    @property
    def index(self) -> DataFrame:
        return self.once("index", lambda: graph.statement_index(self.permissions))

    @property
    def graph(self) -> dict[str, object]:
        """``edges`` of single nodes, ``shared`` ones of classes of principals, ``index`` of the statements."""
        def build():
            own, shared = escalation.escalation_parts(self.permissions, self.index)
            edges = cut_lineage(graph.build_edges(self.permissions).unionByName(own))
            return {"edges": edges, "shared": shared, "index": self.index}
        return self.once("graph", build)

    @property
    def paths(self) -> DataFrame:
        return escalation.escalation_paths(self.permissions, self.graph["edges"], self.index, self.graph["shared"])

    @property
    def blast(self) -> DataFrame:
        return self.once("blast", lambda: cut_lineage(ranking.blast_radius(self.permissions, self.graph)))

    # cases -----------------------------------------------------------------
    def behaviour_options(self) -> dict:
        return {"travel_minutes": TRAVEL_MIN, "burst_minutes": BURST_MIN, "burst_threshold": BURST_N}

    @property
    def sensitive_buckets(self) -> DataFrame:
        risky = self.view("resource").filter("sensitivity IN ('high', 'medium')")
        return risky.select(F.regexp_extract("arn", "arn:aws:s3:::(.*)", 1).alias("bucket"))

    def advanced(self) -> DataFrame:
        """Snapshot-aware findings of the current events."""
        return exposure.s3_exfiltration(self.current, exposure.s3_profile(self.history), 3.0, 5, 400_000_000).unionByName(
            exposure.sensitive_public_access(self.current, self.sensitive_buckets))

    @property
    def detections(self) -> DataFrame:
        return self.once("detections", lambda: cut_lineage(cases.detect(self.current, self.history, advanced=self.advanced(), **self.behaviour_options())))

    @property
    def cases(self) -> dict[str, DataFrame]:
        return self.once("cases", lambda: cases.correlate(self.detections))

    @property
    def chain(self) -> dict[str, DataFrame]:
        return self.once("chain", lambda: chain.reconstruct(self.cases, self.current, self.graph["edges"], COLLAPSE_MIN, PAD_MIN, self.graph["shared"]))

    @property
    def ranked(self) -> DataFrame:
        return self.once("ranked", lambda: cut_lineage(ranking.rank_cases(self.cases, self.chain["step"], self.blast)))

    @property
    def plan(self) -> DataFrame:
        return self.once("plan", lambda: cut_lineage(ranking.response_plan(self.ranked, self.chain["step"])))

    @property
    def playbooks(self) -> DataFrame:
        return snapshots.playbooks(self.spark)

    @property
    def tags(self) -> DataFrame:
        return context.case_tags(self.cases["case"], self.cases["case_detection"], self.plan)


_OPEN: dict[tuple, Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, folder)
    return _OPEN[key]


def forget(keep: tuple[str, ...] = ()) -> None:
    """Drop prepared results except those named, so that the next query pays its own cost."""
    for w in _OPEN.values():
        w._made = {k: v for k, v in w._made.items() if k in keep}
