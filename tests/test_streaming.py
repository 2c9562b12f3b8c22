"""The monitor's streams: ticks, tree snapshots, state, fetching and delivery."""

import io
import json
import os
import tarfile
import time
import urllib.error

from pyspark.sql import functions as F

from quillscan.plans import derived, queries
from quillscan.sources import config, files, registry
from quillscan.sources.config import Target
from quillscan.streaming import landing, monitor, state, ticks, tree

SF = "/root/testdata/sf0.001"


def test_retries_stop_at_what_the_client_did_wrong():
    asked = []

    def fetch(url):
        asked.append(url)
        if url == "gone":
            raise urllib.error.HTTPError(url, 404, "gone", None, None)
        if len(asked) < 3:
            raise OSError("busy")
        return b"ok"

    assert registry.tried(fetch, "u", pause=0) == (b"ok", None) and len(asked) == 3
    asked.clear()
    assert registry.tried(fetch, "gone", pause=0)[0] is None and len(asked) == 1


def test_replayed_polls_go_on_after_a_restart(spark, few_partitions, tmp_path):
    names = spark.createDataFrame([("a",), ("b",), ("a",)], "name string")
    document = lambda poll, name, v: (poll, name, json.dumps({"dist-tags": {"latest": v}, "versions": {v: {"dist": {"tarball": f"{name}-{v}"}}}}))
    said = spark.createDataFrame([document(1, "a", "1"), document(2, "a", "1"), document(3, "a", "2"), document(2, "b", "1"), document(4, "b", "1"), document(5, "b", "3"), (5, "a", "broken"), document(1, "z", "9")], "poll long, name string, json string")
    for last, want in ((3, 3), (5, 4)):
        got = monitor.drained(monitor.poll_stream(spark, names, registry.landed(said), last, buckets=2), "polls", f"file://{tmp_path}")
        assert got.count() == want
    assert sorted(tuple(r) for r in got.select("name", "version", "previous", "poll", "tarball").collect()) == [("a", "1", None, 1, "a-1"), ("a", "2", "1", 3, "a-2"), ("b", "1", None, 2, "b-1"), ("b", "3", "1", 5, "b-3")]


def test_each_trigger_without_a_last_tick_has_one(spark, few_partitions, tmp_path):
    seen = []
    for _ in range(2):
        q = ticks.ticks(spark).writeStream.foreachBatch(lambda b, n: seen.append([r["tick"] for r in b.collect()])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [len(x) for x in seen] == [1, 1] and seen[0] < seen[1]


def test_snapshots_see_new_and_edited_files_alone(spark, tmp_path):
    folder, root = tmp_path / "t é", f"file://{tmp_path}/snapshots"
    (folder / "sub").mkdir(parents=True)
    for name, text in {"a.js": "1", "sub/b.ts": "2", "c.d.ts": "3", "d.txt": "4", "sub/package.json": "{}"}.items():
        (folder / name).write_text(text)
    (folder / "bad.js").write_bytes(b"\xff\xfe")
    look = lambda n, where: {os.path.basename(r["path"]): r["content"] for r in found.collect()} if (found := tree.changed(spark, [where], root, n)) is not None else None
    assert look(0, str(folder)) == {"a.js": "1", "b.ts": "2", "package.json": "{}"}
    assert look(1, str(folder)) is None
    (folder / "a.js").write_text("new text")
    os.utime(folder / "sub/b.ts", (1e9, 1e9))
    assert look(2, str(folder)) == {"a.js": "new text", "b.ts": "2"} == look(2, str(folder))  # the same when the batch is replayed
    (folder / "sub/e.mjs").write_text("5")
    (folder / "a.js").unlink()
    assert look(3, f"file://{folder}") == {"e.mjs": "5"}


def test_state_grows_by_what_a_batch_touches(spark, few_partitions, tmp_path):
    rows = lambda n, which: spark.createDataFrame([(f"s{k}", n, f"k{j}", "p") for k in which for j in range(5)], monitor.SCANS)
    updated = []
    for n, which in enumerate([range(60), [7]]):
        landing.land(rows(n, which), f"file://{tmp_path}/in", str(n))
        if n:
            landing.land(rows(9, [8]), f"file://{tmp_path}/in", str(n))  # lands once only
        with state.state_store(spark):
            q = state.fresh_findings(landing.landings(spark, f"file://{tmp_path}/in", monitor.SCANS)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        updated.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"]))
    assert updated == [300, 0]
    assert spark.read.parquet(str(tmp_path / "out")).where("fresh").count() == 300


def archive(**members):
    blob = io.BytesIO()
    with tarfile.open(fileobj=blob, mode="w:gz") as tar:
        for name, text in members.items():
            info = tarfile.TarInfo(name.replace("__", "/").replace("_js", ".js"))
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
        link = tarfile.TarInfo("package/link.js")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(link)
    return blob.getvalue()


def test_archives_are_fetched_by_tasks_and_hostile_ones_do_no_harm(spark, tmp_path):
    good = archive(package__a_js=b"eval(x)", **{"../up_js": b"eval(x)", "/abs_js": b"eval(x)"})
    for name, body in {"good": good, "cut": good[: len(good) // 2], "text": b"no archive", "empty": b""}.items():
        (tmp_path / name).write_bytes(body)
    where = str(tmp_path)

    def fetch(url):
        with open(f"{where}/{url}", "rb") as f:
            return f.read()

    versions = spark.createDataFrame([(n, "1", n) for n in ("good", "cut", "text", "empty", "missing")], "name string, version string, tarball string")
    got = registry.archives(versions, fetch, attempts=2, pause=0)
    assert {r["subject"]: bool(r["error"]) for r in got.collect()} == {"good@1": False, "cut@1": False, "text@1": False, "empty@1": False, "missing@1": True}
    found = {(r["subject"], r["file"]) for r in monitor.archive_findings(got).collect()}
    assert ("good@1", "package/a.js") in found and {f for _, f in found} == {"package/a.js"}


def test_packed_documents_come_back_with_the_built_in_findings(spark):
    packages = derived.packages(spark, SF)
    got = monitor.archive_findings(registry.landed_archives(files.registry_versions(packages), packages.limit(10**6)))
    have = {(r["subject"][3:].split("@")[0], r["rule_id"], r["line"], r["column"]) for r in got.where("rule_id NOT LIKE 'MANIFEST%'").collect()}
    want = {(r["file"], r["rule_id"], r["line"], r["column"]) for r in queries.q_builtin_scan(spark, SF).where("file NOT LIKE 'page %'").collect()}
    assert have == want and want


def test_polls_on_an_idle_tree_edits_in_place_and_no_second_delivery(spark, few_partitions, tmp_path):
    folder, web, out, at = tmp_path / "w", tmp_path / "web", tmp_path / "sent", f"file://{tmp_path}/monitor"
    for d in (folder, web, out):
        d.mkdir()
    (folder / "a.js").write_text("let a = 1")
    (folder / "package.json").write_text('{"dependencies": {"pkg": "1", "gone": "1"}}')
    lines, where, into = [], str(web), str(out)

    def fetch(url):
        with open(f"{where}/{url.split('/')[-1]}", "rb") as f:
            return f.read()

    def publish(version, text):
        (web / "pkg").write_text(json.dumps({"dist-tags": {"latest": version}, "versions": {version: {"dist": {"tarball": f"pkg-{version}"}}}}))
        (web / f"pkg-{version}").write_bytes(archive(package__i_js=text))

    def transport(url, body):
        with open(f"{into}/{time.time_ns()}", "wb") as f:
            f.write(body)

    def run(verbose=False):
        lines.clear()
        settings = config.Config(registry=True, targets=(Target("u"),))
        monitor.watch(spark, str(folder), settings, at, transport=transport, show=lines.append, once=True, documents=registry.fetched("http://r", fetch, 1), fetch=fetch, verbose=verbose, spread=True).awaitTermination()
        return sorted(x.replace(f"file:{folder}/", "") for x in lines)

    sent = lambda: sorted(json.loads(p.read_bytes())["subject"].split("/")[-1] for p in out.iterdir())
    publish("1.0", b"eval(x)")
    first = run(verbose=True)
    assert "a.js — clean" in first and "pkg 1.0 — pkg-1.0" in first and any(x.startswith("pkg@1.0 — ") for x in first) and any(x.startswith("gone: ") for x in first)
    assert sent() == ["pkg@1.0"]
    publish("2.0", b"eval(y); new Function(z)")  # nothing below the folder changes
    (folder / "a.js").write_text("eval(x)")  # in place
    second = run()
    assert "pkg 2.0 — pkg-2.0" in second and any(x.startswith("pkg@2.0 — ") for x in second) and any(x.startswith("a.js — PASS") for x in second)
    assert sent() == ["a.js", "pkg@1.0", "pkg@2.0"]
    # The last batch of findings is replayed as after a failure before its commit.
    commits = tmp_path / "monitor/findings/commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (last, commits / f".{last.name}.crc"):
        p.unlink(missing_ok=True)
    assert not [x for x in run() if "—" in x] and sent() == ["a.js", "pkg@1.0", "pkg@2.0"]


def test_reports_of_a_clean_and_a_repeated_scan(spark):
    rows = spark.createDataFrame([("s", 1, None, None, False, False), ("t", 1, None, None, False, False)], state.FRESH)
    assert monitor.reports(rows).count() == 0
    assert {r["line"] for r in monitor.reports(rows, verbose=True).collect()} == {"s — clean", "t — clean"}
    assert monitor.reports(rows.where(F.lit(False)), verbose=True).count() == 0
