"""The command line: scan a tree, list rules, rewrite sources, monitor a folder."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from quillscan.functions.catalog import SEVERITIES, builtin_rules, load_rules
from quillscan.functions.packages import POPULAR, load_names
from quillscan.plans import export, notify, oneshot, report
from quillscan.sources import config, files, registry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quillscan", description="Static analysis of JavaScript and TypeScript packages on Spark.")
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("-r", "--rules", help="TOML rules that replace the built-in ones")
    p.add_argument("--extend-rules", action="store_true", help="add them to the built-in ones instead")
    p.add_argument("-s", "--severity", default="low", help="least severity")
    p.add_argument("-f", "--format", default="text", help="text, json or sarif")
    p.add_argument("--report", metavar="PATH", help="write the JSON or SARIF report (-f) there, of any size and on any file system, instead of printing it")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("-d", "--deobfuscate", action="store_true", help="print rewritten sources and stop")
    p.add_argument("-o", "--output", help="folder for rewritten sources")
    p.add_argument("--no-deobfuscate", action="store_true")
    p.add_argument("--no-manifest", action="store_true")
    p.add_argument("--manifest-only", action="store_true")
    p.add_argument("--max-file-size", type=int, default=files.MAX_BYTES)
    p.add_argument("--exit-threshold", default="high")
    p.add_argument("--disable", action="append", default=[])
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--list-rules", action="store_true")
    p.add_argument("--monitor", action="store_true")
    p.add_argument("--config")
    p.add_argument("--notify", action="store_true")
    p.add_argument("--telegram-chat-ids", metavar="UPDATES_JSON", help="list the chats of a saved getUpdates response")
    p.add_argument("--baseline")
    p.add_argument("--write-baseline", action="store_true")
    p.add_argument("--popular", help="file of well-known package names")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, transport: notify.Transport = notify.post) -> int:
    a, began = parser().parse_args(argv), time.time()
    say = lambda s: print(s, file=out or sys.stdout)
    if a.severity.lower() not in SEVERITIES or (a.write_baseline and not a.baseline):
        print("bad severity, or --write-baseline without --baseline", file=sys.stderr)
        return 1
    try:
        rules = load_rules(a.rules, a.extend_rules) if a.rules else builtin_rules()
        settings = config.load(a.config)
    except (OSError, ValueError, KeyError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    if a.list_rules:
        say(report.rule_listing(rules))
        return 0
    spark = spark or SparkSession.builder.appName("quillscan").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.telegram_chat_ids:
        for r in files.chats(spark.read.text(a.telegram_chat_ids, wholetext=True).withColumnRenamed("value", "json")).collect():
            say(f"{r['id']}  {r['label']}")
        return 0
    options = oneshot.Options(tuple(a.paths), a.severity, tuple(a.disable), not a.manifest_only, a.manifest_only or not a.no_manifest, not a.no_deobfuscate, a.max_file_size, load_names(a.popular) if a.popular else POPULAR)
    if a.deobfuscate:
        for r in oneshot.clean_sources(files.files(spark, a.paths, max_bytes=1 << 62)).orderBy("path").toLocalIterator():
            if a.output:
                os.makedirs(a.output, exist_ok=True)
                with open(os.path.join(a.output, os.path.basename(r["path"])), "w", encoding="utf-8") as f:
                    f.write(r["content"])
            else:
                say(f"// === {r['path']} ===\n{r['content']}")
        return 0
    if a.monitor:
        from quillscan.streaming import monitor

        shared = a.output or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            print("--monitor needs a folder that all machines share: --output URI, or spark.checkpoint.dir", file=sys.stderr)
            return 1
        at = f"{shared or os.path.abspath('.')}/.quillscan-monitor"
        asked = registry.fetched(settings.registry_url) if settings.registry else None
        monitor.watch(spark, list(a.paths), settings, at, rules, transport, say, documents=asked, fetch=registry.http, verbose=a.verbose, spread=transport is notify.post).awaitTermination()
        return 0
    accepted = files.accepted(spark, a.baseline) if a.baseline and not a.write_baseline else None
    result = oneshot.run(spark, options, rules, accepted)
    if a.write_baseline:
        try:
            export.write_accepted(result.findings, a.baseline if "://" in a.baseline else os.path.abspath(a.baseline))
        except Exception as e:  # noqa: BLE001  the file system's own errors
            print(e, file=sys.stderr)
            return 1
        return 0
    if a.report and a.format in ("json", "sarif"):
        {"json": export.write_json, "sarif": export.write_sarif}[a.format](result.findings, result.scored, a.report if "://" in a.report else os.path.abspath(a.report))
        worst = result.findings.agg({"severity_rank": "max"}).first()[0]
        return report.exit_code([{"severity": SEVERITIES[worst - 1]}] if worst else [], a.exit_threshold)
    o = report.outcome(", ".join(a.paths), result.findings, result.scored)
    if a.format == "json":
        say(report.json_report(o))
    elif a.format == "sarif":
        say(report.sarif_report(o))
    elif not a.quiet:
        s = result.stats.first()
        say(report.text_report(o, s["js_files"], s["manifest_files"], s["bytes"], time.time() - began, a.verbose))
        hidden = result.suppressed.first()["suppressed"]
        if hidden:
            say(f" {report.plural(hidden, 'accepted finding')} left out")
    if a.notify:
        if not settings.targets:
            print("no notification targets", file=sys.stderr)
        notify.dispatch(settings.targets, o, transport)
    return report.exit_code(o.findings, a.exit_threshold)


if __name__ == "__main__":
    sys.exit(main())
