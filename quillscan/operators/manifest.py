"""Checks of package manifests, as expressions over each manifest's own row, once its text is read: nothing shuffles, nothing is collected."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.functions import jsontext
from quillscan.functions import packages as P
from quillscan.functions.catalog import SEVERITIES

_FOUND = "struct<rule_id:string,name:string,description:string,severity:string,detail:string>"
INVALID, NO_OBJECT = "invalid JSON", "not an object"


#: What the checks read of a manifest.
_READ = frozenset(("scripts", "bin", *P.SECTIONS, *P.MONITOR_SECTIONS))


def _outlines(content: pd.Series) -> pd.Series:
    def of(b: bytes | None) -> str | None:
        try:
            return None if b is None else jsontext.outline(b.decode(), _READ)
        except UnicodeDecodeError:
            return None

    return content.map(of)


def _outlined(manifests: DataFrame) -> DataFrame:
    """manifests(path, content) with `outline`: the members that the checks read, "[]" where the text isn't an object, null where it is no JSON."""
    # Not deterministic by name only, so that a condition on its result doesn't run it once more.
    outline = F.pandas_udf(_outlines, "string").asNondeterministic()
    return manifests.withColumn("outline", outline(F.col("content").cast("binary")))


def parsed(manifests: DataFrame) -> DataFrame:
    """manifests(path, content) with `json`, a variant of the members that the checks read; null where the text is no JSON object."""
    return _outlined(manifests).withColumn("json", F.when(F.col("outline").startswith("{"), F.try_parse_json("outline"))).drop("outline")


def judged(manifests: DataFrame) -> DataFrame:
    """path and error of manifests(path, content): why a manifest can't be checked, null where it can."""
    return _outlined(manifests).select("path", F.when(F.col("outline").isNull(), INVALID).when(~F.col("outline").startswith("{"), NO_OBJECT).alias("error"))


def invalid(manifests: DataFrame) -> DataFrame:
    """The manifests that can't be checked, with the reason."""
    return judged(manifests).where("error IS NOT NULL")


def _kind(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit(""))


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _strings(v: Column) -> Column:
    """(name, text) of an object's string-valued members, by name."""
    members = F.map_entries(F.from_json(F.to_json(v), "map<string,variant>"))
    members = F.filter(members, lambda e: _kind(e["value"]) == "STRING")
    return F.array_sort(F.transform(members, lambda e: F.struct(e["key"].alias("name"), F.try_variant_get(e["value"], "$", "string").alias("text"))))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _finding(rule: str, name: str, description: Column, severity: Column | str, detail: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(rule).alias("rule_id") if isinstance(rule, str) else rule.alias("rule_id"), (F.lit(name) if isinstance(name, str) else name).alias("name"), description.alias("description"), severity.alias("severity"), detail.alias("detail"))


def install_reason(command: Column) -> Column:
    """download, fetch, inline, encoded, shell, network, or null when nothing is wrong: the first that holds."""
    low = F.lower(command)
    fetch = _any(low, P.FETCHERS)
    url = F.contains(low, F.lit("http://")) | F.contains(low, F.lit("https://"))
    return (
        F.when(fetch & (_any(low, P.PIPES) | F.contains(low, F.lit("http"))), "download")
        .when(fetch, "fetch")
        .when(_any(low, P.INLINE), "inline")
        .when(_any(low, P.ENCODED) | _any(command, P.ENCODED_EXACT), "encoded")
        .when(_any(low, P.SHELLS), "shell")
        .when(~_any(low, P.BENIGN_TOOLS) & url, "network")
    )


# Fixed values: (rule, name, severity, reason in the description) of each kind of install script.
INSTALL = {
    "download": ("MANIFEST-001", "Malicious install script", "critical", "remote download piped into a shell"),
    "fetch": ("MANIFEST-001", "Malicious install script", "critical", "network fetch during install"),
    "inline": ("MANIFEST-001", "Malicious install script", "critical", "inline code execution flag"),
    "encoded": ("MANIFEST-005", "Obfuscated install script", "critical", "encoded/eval payload in install script"),
    "shell": ("MANIFEST-001", "Malicious install script", "critical", "raw shell primitive"),
    "network": ("MANIFEST-006", "Install script makes network request", "high", "references a remote URL during install"),
}


def _install(json: Column) -> Column:
    scripts = _get(json, "scripts")
    steps = F.array(*[F.struct(F.lit(k).alias("key"), F.when(_kind(_get(scripts, k)) == "STRING", F.try_variant_get(scripts, f"$.{k}", "string")).alias("command")) for k in P.LIFECYCLE])
    facts = F.create_map(*[x for k, v in INSTALL.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    bad = F.filter(F.transform(steps, lambda s: F.struct(s["key"].alias("key"), s["command"].alias("command"), install_reason(s["command"]).alias("why"))), lambda s: s["why"].isNotNull())

    def finding(s: Column) -> Column:
        fact = lambda i: F.get(F.try_element_at(facts, s["why"]), F.lit(i))
        text = F.concat(F.lit('The lifecycle script "'), s["key"], F.lit('" runs at install time: '), fact(3), F.lit("."))
        return _finding(fact(0), fact(1), text, fact(2), F.concat(s["key"], F.lit(": "), s["command"]))

    return F.transform(bad, finding)


def bin_entries(json: Column) -> Column:
    v = _get(json, "bin")
    single = F.array(F.struct(F.lit("<default>").alias("name"), F.try_variant_get(v, "$", "string").alias("text")))
    return F.when(_kind(v) == "STRING", single).when(_kind(v) == "OBJECT", _strings(v))


def _bins(json: Column) -> Column:
    patterns = F.array(*map(F.lit, P.BIN_PATTERNS))
    hit = lambda e: F.get(F.filter(patterns, lambda p: F.contains(F.lower(e["text"]), F.lower(p))), F.lit(0))
    bad = F.filter(bin_entries(json), lambda e: hit(e).isNotNull())
    return F.transform(bad, lambda e: _finding("MANIFEST-004", "Suspicious bin entry", F.concat(F.lit('The bin entry "'), e["name"], F.lit('" has the suspicious pattern "'), hit(e), F.lit('".')), "high", F.concat(F.lit("bin."), e["name"], F.lit(": "), e["text"])))


def _section(json: Column, name: str) -> Column:
    v = _get(json, name)
    keys = F.array_sort(F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>")))
    items = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: _kind(x) == "STRING")
    items = F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))
    return F.when(_kind(v) == "OBJECT", keys).when(_kind(v) == "ARRAY", items).otherwise(F.array().cast("array<string>"))


def dependency_names(json: Column, sections: tuple[str, ...] = P.SECTIONS) -> Column:
    """Distinct names, sections in order and names by alphabet within one (arrays as they stand)."""
    return F.array_distinct(F.flatten(F.array(*[_section(json, s) for s in sections])))


def bare_name(dep: Column) -> Column:
    """A dependency without its scope."""
    return F.when(dep.rlike("^@[^/]*/"), F.regexp_replace(dep, "^@[^/]*/", "")).otherwise(dep)


def normal_name(name: Column) -> Column:
    return F.lower(F.translate(name, "-_.", ""))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body uses it, inside other lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def look_alikes(deps: Column, popular: tuple[str, ...]) -> Column:
    """array<struct<dep, popular, distance>>: distance 0 stands for equal up to separators, which excludes the others."""
    first: dict[str, str] = {}
    for p in popular:
        first.setdefault(p.translate({ord(c): None for c in "-_."}).lower(), p)
    same = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    # The well-known names by length, as only those of about the same length can be near; each with its place.
    of_length: dict[int, list] = {}
    for k, p in enumerate(popular):
        for n in range(max(len(p) - 2, 0), len(p) + 3):
            of_length.setdefault(n, []).append(F.struct(F.lit(p).alias("p"), F.lit(len(p.encode())).alias("n")))
    near_length = F.create_map(*[x for n, ps in sorted(of_length.items()) for x in (F.lit(n), F.array(*ps))])
    none = F.array().cast("array<struct<dep:string,popular:string,distance:int>>")
    row = lambda dep, p, d: F.struct(dep.alias("dep"), p.alias("popular"), d.cast("int").alias("distance"))

    def near(x: Column) -> Column:
        # Beyond two edits the distance isn't worked out.
        scored = F.transform(F.try_element_at(near_length, F.length(x["bare"])), lambda p: F.struct(p["p"].alias("p"), F.levenshtein(x["bare"], p["p"], 2).alias("d"), F.when(F.least(p["n"], x["bytes"]) <= 5, 1).otherwise(2).alias("most")))
        return F.transform(F.filter(scored, lambda s: s["d"].between(F.lit(1), s["most"])), lambda s: row(x["dep"], s["p"], s["d"]))

    def of(x: Column) -> Column:
        return F.when(x["same"].isNotNull(), F.array(row(x["dep"], x["same"], F.lit(0)))).otherwise(F.coalesce(near(x), none))

    bares = F.transform(deps, lambda dep: F.struct(dep.alias("dep"), bare_name(dep).alias("bare")))
    names = F.array(*map(F.lit, popular))
    open_ = F.filter(bares, lambda x: (F.octet_length(x["bare"]) >= 4) & ~F.array_contains(names, x["bare"]))
    known = F.transform(open_, lambda x: F.struct(x["dep"].alias("dep"), x["bare"].alias("bare"), F.octet_length(x["bare"]).alias("bytes"), F.try_element_at(same, normal_name(x["bare"])).alias("same")))
    return F.flatten(F.transform(known, of))


def _typosquats(deps: Column, popular: tuple[str, ...]) -> Column:
    def finding(x: Column) -> Column:
        how = F.when(x["distance"] == 0, "separator trick").otherwise(F.concat(F.lit("distance "), x["distance"].cast("string")))
        return _finding("MANIFEST-002", "Potential typosquat dependency", F.concat(F.lit('Dependency "'), x["dep"], F.lit('" resembles the well-known package "'), x["popular"], F.lit('" ('), how, F.lit(").")), "medium", F.concat(x["dep"], F.lit(" ~ "), x["popular"], F.lit(" ("), how, F.lit(")")))

    return F.transform(look_alikes(deps, popular), finding)


def confusions(deps: Column, popular: tuple[str, ...]) -> Column:
    """array<struct<scoped, name, both>>: names that are also a scoped dependency's, then well-known names a scoped one shadows."""
    scoped = F.transform(F.filter(deps, lambda d: d.rlike("^@[^/]*/") & ~d.startswith("@types/")), lambda d: F.struct(d.alias("scoped"), bare_name(d).alias("name")))
    facts = F.struct(scoped.alias("scoped"), F.transform(scoped, lambda s: s["name"]).alias("bases"), F.filter(deps, lambda d: ~d.startswith("@")).alias("plain"))
    names = F.array(*map(F.lit, popular))

    def found(x: Column) -> Column:
        last = lambda n: F.try_element_at(F.filter(x["scoped"], lambda s: s["name"] == n), F.lit(-1))["scoped"]
        row = lambda n, both: F.struct(last(n).alias("scoped"), n.alias("name"), F.lit(both).alias("both"))
        together = F.transform(F.filter(x["plain"], lambda n: F.array_contains(x["bases"], n)), lambda n: row(n, True))
        alone = F.transform(F.array_except(F.array_intersect(names, x["bases"]), x["plain"]), lambda n: row(n, False))
        return F.concat(together, alone)

    return _bound(facts, found)


def _confused(deps: Column, popular: tuple[str, ...]) -> Column:
    def finding(x: Column) -> Column:
        both = F.concat(F.lit('Both "'), x["scoped"], F.lit('" and the unscoped "'), x["name"], F.lit('" are dependencies.'))
        one = F.concat(F.lit('"'), x["scoped"], F.lit('" has the base name of the well-known package "'), x["name"], F.lit('".'))
        detail = F.concat(x["scoped"], F.when(x["both"], " vs ").otherwise(" shadows "), x["name"])
        return _finding("MANIFEST-003", "Dependency confusion risk", F.when(x["both"], both).otherwise(one), F.when(x["both"], "high").otherwise("medium"), detail)

    return F.transform(confusions(deps, popular), finding)


def check(manifests: DataFrame, popular: tuple[str, ...] = P.POPULAR, kinds: tuple[str, ...] = ("install", "bin", "typosquat", "confusion")) -> DataFrame:
    """path, rule_id, name, description, severity, detail, ordinal of every problem of manifests(path, content), of the kinds asked for."""
    rows = parsed(manifests).where("json IS NOT NULL").withColumn("deps", dependency_names(F.col("json")))
    json, none = F.col("json"), F.array().cast(f"array<{_FOUND}>")
    made = {"install": lambda: _install(json), "bin": lambda: _bins(json), "typosquat": lambda: _typosquats(F.col("deps"), popular), "confusion": lambda: _confused(F.col("deps"), popular)}
    found = F.concat(*[F.coalesce(f().cast(f"array<{_FOUND}>"), none) for k, f in made.items() if k in kinds])
    return rows.select("path", F.posexplode(found).alias("ordinal", "f")).select("path", "f.*", "ordinal")


def as_findings(found: DataFrame) -> DataFrame:
    """Manifest problems in the shape of code findings, all at the file's first character."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int")
    return found.select(
        "rule_id", F.col("name").alias("rule_name"), "description", "severity", F.col("path").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"),
        F.col("detail").alias("snippet"), F.array(F.lit("supply-chain"), F.lit("manifest")).alias("tags"), F.lit(False).alias("deobfuscated"),
        rank.alias("severity_rank"), F.lit(100_000).alias("rule_ordinal"), F.col("ordinal").alias("match_ordinal"),
    )


def dependencies(manifests: DataFrame, sections: tuple[str, ...] = P.MONITOR_SECTIONS) -> DataFrame:
    """path, section, name, range, ordinal of the string-valued dependencies."""
    rows = parsed(manifests).where("json IS NOT NULL")
    each = F.flatten(F.array(*[F.transform(F.when(_kind(_get(F.col("json"), s)) == "OBJECT", _strings(_get(F.col("json"), s))).otherwise(F.array().cast("array<struct<name:string,text:string>>")), _tagged(s)) for s in sections]))
    return rows.select("path", F.posexplode(each).alias("ordinal", "d")).select("path", "d.section", "d.name", "d.range", "ordinal")


def _tagged(section: str):
    return lambda e: F.struct(F.lit(section).alias("section"), e["name"].alias("name"), e["text"].alias("range"))


def merged(deps: DataFrame) -> DataFrame:
    """One range for each name: that of the first path and place."""
    return deps.groupBy("name").agg(F.min_by("range", F.struct("path", "ordinal")).alias("range"))
