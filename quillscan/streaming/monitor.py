"""Continuous monitoring: new and changed files are scanned as they come, the registry is polled at its own pace, and only findings
that the subject's previous scan didn't have are reported. State is Spark's own, so it survives restarts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillscan.functions.catalog import Rule
from quillscan.operators import manifest, scan, score
from quillscan.plans import notify
from quillscan.plans.report import Outcome
from quillscan.sources import files, registry
from quillscan.sources.config import Config, Target
from quillscan.sources.tables import scratch, slices
from quillscan.streaming import state, tree
from quillscan.streaming.landing import drop, exists, land, landings
from quillscan.streaming.ticks import ticks

SCANS = "subject string, scan long, key string, payload string"


def findings_of(sources: DataFrame, rules: list[Rule] | None = None, deobfuscate: bool = True) -> DataFrame:
    """All findings of sources(path, content), code and manifests; batch or stream."""
    code = scan.scan(sources.where(files.is_code(F.col("path"))), rules, deobfuscate)
    return code.unionByName(manifest.as_findings(manifest.check(sources.where(files.is_manifest(F.col("path"))))))


def new_keys(stream: DataFrame) -> DataFrame:
    """subject, key of stream(subject, key) that the subject's previous batch didn't have. A batch's keys replace the
    previous ones, so that a key which goes and comes back is new again."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = set(json.loads(state.get[0])) if state.exists else set()
        now = {k for f in frames for k in f["key"]}
        state.update((json.dumps(sorted(now)),))
        fresh = sorted(now - before)
        yield pd.DataFrame({"subject": [group[0]] * len(fresh), "key": fresh})

    return stream.groupBy("subject").applyInPandasWithState(step, "subject string, key string", "keys string", "append", GroupStateTimeout.NoTimeout)


def new_since(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The batch form: rows of current(subject, key, ...) whose pair isn't in previous."""
    return current.join(previous.select("subject", "key").distinct(), ["subject", "key"], "left_anti")


def version_changes(polls: DataFrame) -> DataFrame:
    """name, version, previous, poll of polls(name, version, poll): each name's first version and every change."""
    before = F.lag("version").over(Window.partitionBy("name").orderBy("poll"))
    return polls.withColumn("previous", before).where(F.col("previous").isNull() | (F.col("previous") != F.col("version"))).select("name", "version", "previous", "poll")


def to_download(latest: DataFrame, known: DataFrame | None) -> DataFrame:
    """Packages of latest(name, version, tarball) whose version isn't the known one; all of them at the first poll."""
    return latest if known is None else latest.join(known.select("name", "version"), ["name", "version"], "left_anti")


def poll(manifests: DataFrame, documents: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One registry poll: (packages to download and scan, the versions known from now on).

    The dependencies of manifests(path, content), each name once, meet the registry's documents(name, json). A version
    is known from the poll that saw it, whether or not its archive can be fetched later; the first poll (known is None) takes
    every package. Known versions of names that this poll doesn't mention stay."""
    wanted = manifest.merged(manifest.dependencies(manifests)).select("name")
    latest = files.registry_versions(documents.join(wanted, "name", "left_semi"))
    now = latest.select("name", "version")
    if known is not None:
        now = now.unionByName(known.select("name", "version").join(now, "name", "left_anti"))
    return to_download(latest, known), now


def manifests_below(found: DataFrame) -> DataFrame:
    """The manifests of sources.files outside the directories the monitor prunes."""
    return found.where((F.col("kind") == "manifest") & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, files.IGNORED_BY_MONITOR))))


def archive_findings(archives: DataFrame, rules: list[Rule] | None = None, deobfuscate: bool = True) -> DataFrame:
    """Findings of package archives(subject, content), with the subject as a column: everything in them is scanned."""
    members = files.archive_members(archives)
    split = "\u0001"
    named = members.select(F.concat_ws(split, "subject", "path").alias("path"), "content")
    found = findings_of(named, rules, deobfuscate)
    return found.withColumn("subject", F.split("file", split)[0]).withColumn("file", F.split("file", split)[1])


def poll_stream(spark: SparkSession, wanted: DataFrame, documents: registry.Documents, last: int | None = None, buckets: int | None = None) -> DataFrame:
    """The stream of first and changed versions (state.CHANGES) of wanted(name): each tick asks for all names, dealt by their hash over `buckets` tasks.
    With `last`, polls 1 to last are replayed."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = wanted.select("name").distinct().withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int"))
    asked = ticks(spark, last, buckets).join(names, "bucket").select(F.col("tick").alias("poll"), "name")
    return state.version_changes(files.registry_versions(documents(asked).where("json IS NOT NULL"), "poll"))


def drained(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """What the stream gives until nothing is due, as a table of its own in `at` (a new shared folder by default); a second call with the same
    folder goes on where the first ended."""
    spark, at = stream.sparkSession, at or scratch(stream.sparkSession)
    with state.state_store(spark):
        query = stream.writeStream.format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/{name}.state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/{name}")


def scanned(subjects: DataFrame, found: DataFrame, number: int) -> DataFrame:
    """SCANS of subjects(subject) and their findings found(subject, ...): each finding with its key and all of it as JSON, and a row without a key for
    each subject that is clean."""
    key = F.concat_ws(":", "rule_id", "subject", F.col("line").cast("string"), F.col("column").cast("string"))
    rows = found.select("subject", key.alias("key"), F.to_json(F.struct(*scan.COLUMNS)).alias("payload"))
    every = subjects.select("subject").distinct().join(rows, "subject", "left")
    return every.select("subject", F.lit(number).cast("long").alias("scan"), "key", "payload")


def reports(fresh: DataFrame, verbose: bool = False, tasks: int | None = None) -> DataFrame:
    """subject, scan, fresh, line, outcome (JSON) of each scan in state.fresh_findings' rows that has something new; with `verbose`, of every scan.
    They are rendered in so many tasks, if given: a Python worker is handed up to 10,000 of a task's scans at once."""
    each = Window.partitionBy("subject", "scan")
    kept = fresh if verbose else fresh.withColumn("any", F.max("fresh").over(each)).where("any").drop("any")
    one = kept.withColumn("id", F.concat_ws("\u0001", F.col("scan").cast("string"), "subject"))
    found = one.where("key IS NOT NULL").select("id", "fresh", F.from_json("payload", scan.FINDINGS).alias("f")).select("id", "fresh", "f.*")
    parts = found.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("severity_rank")).alias("o"), "file", "deobfuscated", "rule_ordinal", "match_ordinal", F.struct(*scan.COLUMNS).alias("f")))).alias("found"), F.max("fresh").alias("fresh")
    )
    parts = parts.join(score.scores(found, subject="id"), "id")
    rows = one.select("id", "subject", "scan").distinct().join(parts, "id", "left")

    listed = F.when(F.col("found").isNotNull(), F.transform("found", lambda x: x["f"])).otherwise(F.array().cast(f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in scan.FINDINGS.split(', '))}>>"))
    facts = F.struct(
        listed.alias("findings"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("level", F.lit("CLEAN")).alias("level"), F.coalesce("verdict", F.lit("PASS")).alias("verdict"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("categories", F.array().cast("array<struct<category:string,findings:int,points:int>>")).alias("categories"),
    )

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, "facts"):
            lines, outcomes = [], []
            for s, f in zip(b["subject"], b["facts"], strict=True):
                o = Outcome(s, **json.loads(f))
                lines.append(notify.summary(o) if o.findings else f"{o.subject} — clean")
                outcomes.append(json.dumps(vars(o)))
            yield b[["subject", "scan", "fresh"]].assign(line=lines, outcome=outcomes)

    rows = rows.select("subject", "scan", F.coalesce("fresh", F.lit(False)).alias("fresh"), facts.alias("facts"))
    rows = (rows.repartition(tasks) if tasks else rows).withColumn("facts", F.to_json("facts"))
    return rows.mapInPandas(told, "subject string, scan long, fresh boolean, line string, outcome string")


def send(row: dict, targets: tuple[Target, ...], transport: notify.Transport) -> list[str]:
    """Sends a report to the targets that fire, if it has something new; the errors."""
    if not row["fresh"]:
        return []
    o = json.loads(row["outcome"])
    return [e for e in notify.dispatch(targets, Outcome(**o), transport) if e is not None]


def delivered(told: DataFrame, targets: tuple[Target, ...], transport: notify.Transport) -> DataFrame:
    """subject, scan, line, errors: the reports sent by the tasks that hold them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = ["; ".join(send(r, targets, transport)) for r in b.to_dict("records")]
            yield pd.DataFrame({"subject": b["subject"], "scan": b["scan"], "line": b["line"], "errors": errors})

    return told.mapInPandas(run, "subject string, scan long, line string, errors string")


class Watch:
    """The queries of a running monitor."""

    def __init__(self, queries: list) -> None:
        self.queries = queries

    def awaitTermination(self) -> None:  # noqa: N802  as a streaming query's
        for q in self.queries:
            q.awaitTermination()

    def stop(self) -> None:
        for q in self.queries:
            q.stop()


def watch(
    spark: SparkSession,
    folders: str | list[str],
    config: Config,
    checkpoint: str,
    rules: list[Rule] | None = None,
    transport: notify.Transport = notify.post,
    show: Callable[[str], None] = print,
    once: bool = False,
    subject: Callable[[F.Column], F.Column] = lambda path: path,
    documents: registry.Documents | None = None,
    fetch: registry.Fetch | None = None,
    verbose: bool = False,
    spread: bool = False,
    every_s: float = 2.0,
) -> Watch:
    """Watches folders and the registry, as queries of their own that leave tables for each other in `checkpoint` (a folder that driver and executors share):

    * tree: every `every_s` seconds, files that are new or changed in place are scanned (`tree.changed`);
    * polls: every `config.interval_s` seconds and at once at the start, whether or not a file changes, `documents` is asked for the dependencies of the
      manifests that are there then; versions: a package's first or changed version is shown and, with `fetch`, its archive is fetched and scanned as
      name@version (`state.Versions`);
    * findings: the scans' findings meet those of the subject's scan before (`state.FindingKeys`); what has something new is shown and sent.

    `subject` says whose version a file is. `verbose` also shows clean subjects, repeated findings and failures. With `spread` the
    tasks send (`transport` must be picklable then and runs in the executors), else the driver. A batch that was sent isn't sent again when it is replayed; one that fails
    while it is being sent is sent again as a whole. With `once` all that is due is done and the call returns when it is."""
    folders, at = [folders] if isinstance(folders, str) else list(folders), checkpoint.rstrip("/")
    started = []

    def start(name: str, stream: DataFrame, handle: Callable[[DataFrame, int], None], seconds: float) -> None:
        writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{at}/{name}")
        with state.state_store(spark):
            query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds:g} seconds")).start()
        if once:
            query.awaitTermination()
        started.append(query)

    def scan_tree(batch: DataFrame, number: int) -> None:
        files_now = tree.changed(spark, folders, f"{at}/snapshots", number)
        if files_now is not None:
            named = files_now.withColumn("subject", subject(F.col("path")))
            found = scan.deduplicate(findings_of(files_now, rules)).join(named.select(F.col("path").alias("file"), "subject"), "file")
            land(scanned(named, found, number), f"{at}/scans", f"tree-{number}")

    def ask(batch: DataFrame, number: int) -> None:
        wanted = manifest.merged(manifest.dependencies(tree.manifests(spark, folders))).select(F.lit(number).cast("long").alias("poll"), "name")
        got = documents(wanted)
        for c, value in (("poll", F.lit(number).cast("long")), ("error", F.lit(None).cast("string"))):
            got = got if c in got.columns else got.withColumn(c, value)
        got = land(got.select("poll", "name", "json", "error"), f"{at}/polled", str(number))
        if verbose:
            for r in got.where("error IS NOT NULL").toLocalIterator():
                show(f"{r['name']}: {r['error']}")

    def replayed(batch: DataFrame, path: str) -> None:
        """A batch whose result is there already is run for its state alone, which Spark must see written."""
        if exists(spark, path):
            batch.write.format("noop").mode("overwrite").save()

    def download(batch: DataFrame, number: int) -> None:
        replayed(batch, f"{at}/versions-new/{number}")
        new = land(batch, f"{at}/versions-new", str(number))
        for r in new.toLocalIterator():
            show(f"{r['name']} {r['version']} — {r['tarball']}")
        if fetch is not None:
            got = land(registry.archives(new, fetch), f"{at}/archives", str(number))
            if verbose:
                for r in got.where("error IS NOT NULL").select("subject", "error").toLocalIterator():
                    show(f"{r['subject']}: {r['error']}")
            ok = got.where("error IS NULL")
            found = archive_findings(ok, rules)
            first = Window.partitionBy("subject", "rule_id", "file", "line", "column").orderBy("deobfuscated", "rule_ordinal", "match_ordinal")
            found = found.withColumn("k_", F.row_number().over(first)).where("k_ = 1").drop("k_")
            land(scanned(ok, found, number), f"{at}/scans", f"packages-{number}")
            drop(spark, f"{at}/archives/{number - 1}")

    def deliver(batch: DataFrame, number: int) -> None:
        replayed(batch, f"{at}/outbox/{number}")
        if exists(spark, f"{at}/sent/{number}"):
            return
        told = land(reports(batch, verbose), f"{at}/outbox", str(number))
        if spread:
            done = land(delivered(told, config.targets, transport), f"{at}/sent", str(number))
        else:
            for r in told.toLocalIterator():
                for e in send(r.asDict(), config.targets, transport):
                    show(f"{r['subject']}: {e}")
            done = land(told.select("subject", "scan", "line", F.lit("").alias("errors")), f"{at}/sent", str(number))
        for r in done.toLocalIterator():
            show(r["line"])
            if r["errors"]:
                show(f"{r['subject']}: {r['errors']}")
        drop(spark, f"{at}/outbox/{number - 1}")

    if config.watch:
        start("tree", ticks(spark), scan_tree, every_s)
    if config.registry and documents is not None:
        start("polls", ticks(spark), ask, config.interval_s)
        polled = landings(spark, f"{at}/polled", "poll long, name string, json string, error string").where("json IS NOT NULL")
        start("versions", state.version_changes(files.registry_versions(polled, "poll")), download, every_s)
    start("findings", state.fresh_findings(landings(spark, f"{at}/scans", SCANS)), deliver, every_s)
    return Watch(started)
