"""Sources: files of a tree, manifests, package archives, accepted findings, registry documents and chat updates, as tables."""

from __future__ import annotations

import io
import os
import re
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories left out of a scan, of the monitor's search for manifests, and of nothing (archives).
IGNORED = ("node_modules", ".git", "dist", "build", ".next", "vendor", ".scan-cache")
IGNORED_BY_MONITOR = ("node_modules", ".git", "dist", "build")
CODE = r"\.(js|mjs|cjs|jsx|ts|mts|cts|tsx)$"
DECLARATIONS = r"\.d\.(ts|cts|mts)$"
MAX_BYTES = 10_485_760
IGNORE_FILE = ".scanignore"


def is_code(path) -> F.Column:
    return path.rlike(CODE) & ~path.rlike(DECLARATIONS)


def is_manifest(path) -> F.Column:
    return F.element_at(F.split(path, "/"), -1) == "package.json"


def glob_pattern(glob_: str) -> str:
    """A regular expression for a glob over a path's parts: * and ? stay within a part, ** as a part of its own stands for any number of them."""
    out = ""
    parts = re.sub(r"/+", "/", glob_).strip("/").split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        at = 0
        while at < len(part):
            c = part[at]
            end = part.find("]", at + (3 if part[at + 1 : at + 2] == "!" else 2)) if c == "[" else -1
            if c in "*?":
                out += "[^/]*" if c == "*" else "[^/]"
            elif end > 0:
                inner = part[at + 1 : end]
                negated = inner.startswith("!")
                for special in "\\[^&":
                    inner = inner.replace(special, "\\" + special)
                out += f"[^/{inner[1:]}]" if negated else f"[{inner}]"
                at = end
            else:
                out += re.escape(c)
            at += 1
        out += "" if last else "/"
    return out


@dataclass(frozen=True)
class Root:
    """A path to scan: as the file system names it, as its files' paths begin, whether it is a file, and the globs of the ignore file beside it or in it."""

    uri: str
    path: str
    single: bool
    globs: tuple[str, ...] = ()

    @property
    def base(self) -> str:
        return self.path.rsplit("/", 1)[0] if self.single else self.path.rstrip("/")

    def kept(self, path: F.Column, ignored: tuple[str, ...]) -> F.Column:
        """Whether a scan of this root takes the file of that path."""
        if self.single:
            inside = path == self.path
        else:
            top = self.base.rsplit("/", 1)[0]
            inside = path.startswith(f"{self.base}/") & ~F.arrays_overlap(F.split(F.substring(path, F.lit(len(top) + 2), F.lit(1 << 30)), "/"), F.array(*map(F.lit, ignored)).cast("array<string>"))
        if self.globs:
            rest = F.substring(path, F.lit(len(self.base) + 2), F.lit(1 << 30))
            inside = inside & ~rest.rlike("^(?s:" + "|".join(map(glob_pattern, self.globs)) + r")\z")
        return inside


def _plain(path: str) -> str:
    """A local URI as the path it names; any other path as it is."""
    return re.sub("^file:/+", "/", path)


def root_of(spark: SparkSession, path: str) -> Root:
    """A root on any Hadoop file system. Its ignore file has a glob a line, blank lines and # comments skipped. A directory's glob
    doesn't exclude what is in it."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path if "://" in path else f"file://{os.path.realpath(path)}")
    fs = where.getFileSystem(hadoop)
    full = fs.makeQualified(where)
    single = fs.exists(full) and fs.getFileStatus(full).isFile()
    beside = jvm.org.apache.hadoop.fs.Path(full.getParent() if single else full, IGNORE_FILE)
    globs: list[str] = []
    if fs.exists(beside):
        stream = fs.open(beside)  # not through a reader of Spark's, which skips names that begin with a dot
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        globs = [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]
    return Root(full.toString(), _plain(full.toString()), single, tuple(sorted(set(globs))))


def files(spark: SparkSession, paths: list[str], ignored: tuple[str, ...] = IGNORED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, kind (code or manifest), n_bytes, content (null: over the limit or not UTF-8) of the files below the paths, which may
    be on any Hadoop file system.

    Names and sizes are filtered before any content is read, and Spark packs the files into tasks by their sizes. A file below
    several paths counts once: each path leaves out what the paths before it take, which their names tell, so no content is
    shuffled for that. A path that is a file is taken directly; below a
    directory, and for the directory itself, those named in `ignored` are pruned. Symbolic links in a local path itself are followed. Names that
    begin with a dot or an underscore aren't listed, as by Spark's file sources."""
    roots = list(dict.fromkeys(root_of(spark, p) for p in paths or ["."]))
    name = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    out = None
    for k, root in enumerate(roots):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root.uri)
        part = listed.withColumn("path", F.when(F.col("path").startswith("file:"), name).otherwise(F.col("path")))
        part = part.where((is_code(F.col("path")) | is_manifest(F.col("path"))) & root.kept(F.col("path"), ignored))
        for before in roots[:k]:
            part = part.where(~before.kept(F.col("path"), ignored))
        out = part if out is None else out.unionByName(part)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    row = lambda kind, content: [F.lit(kind).alias("kind"), F.col("length").alias("n_bytes"), content.alias("content")]
    code = out.where(is_code(F.col("path")))
    # The size test on its own column reaches the reader, and files over the limit are listed without their content.
    small = code.where(F.col("length") <= max_bytes).select("path", *row("code", text))
    large = code.where(F.col("length") > max_bytes).select("path", *row("code", F.lit(None).cast("string")))
    manifests = out.where(is_manifest(F.col("path"))).select("path", *row("manifest", text))
    return small.unionByName(large).unionByName(manifests)


def scan_stats(found: DataFrame) -> DataFrame:
    """js_files, manifest_files and bytes of `files`, files over the size limit included."""
    return found.agg(F.count_if(F.col("kind") == "code").alias("js_files"), F.count_if(F.col("kind") == "manifest").alias("manifest_files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"))


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """key: the lines of an accepted-findings file, without blank lines and # comments; a missing file is empty."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "key string")
    return spark.read.text(path).select(F.trim("value").alias("key")).where("key <> '' AND NOT startswith(key, '#')")


def archive_members(archives: DataFrame, max_bytes: int = MAX_BYTES, slice_chars: int = 1 << 24) -> DataFrame:
    """subject, path, content of the code files and manifests in gzipped tar archives(subject, content binary), read in
    memory; members with absolute paths or parent steps, links and undecodable ones are left out. A broken archive has the members before its break.
    An archive's members leave the task in slices, so a large one isn't held whole."""

    def members(blob: bytes) -> Iterator[tuple[str, str]]:
        try:
            with tarfile.open(fileobj=io.BytesIO(blob), mode="r|*") as tar:
                for m in tar:
                    if not m.isfile() or m.name.startswith("/") or ".." in m.name.split("/"):
                        continue
                    if m.size > max_bytes and not m.name.endswith("package.json"):
                        continue
                    try:
                        yield m.name, tar.extractfile(m).read().decode("utf-8")
                    except UnicodeDecodeError:
                        continue
        except (tarfile.TarError, EOFError, OSError, zlib.error):
            return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for s, blob in zip(b["subject"], b["content"], strict=True):
                for p, t in members(blob or b""):
                    rows.append((s, p, t))
                    size += len(t)
                    if size > slice_chars:
                        yield pd.DataFrame(rows, columns=["subject", "path", "content"])
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=["subject", "path", "content"])

    out = archives.select("subject", "content").mapInPandas(run, "subject string, path string, content string")
    return out.where(is_code(F.col("path")) | is_manifest(F.col("path")))


def packed(rows: DataFrame) -> DataFrame:
    """rows with `content`, the gzipped tar archive of their members(path, content), in place of `members`: the inverse of archive_members."""
    kept = [c for c in rows.columns if c != "members"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size, first = [], 0, 0
            for k, members in enumerate(b["members"], 1):
                blob = io.BytesIO()
                with tarfile.open(fileobj=blob, mode="w:gz", compresslevel=1) as tar:
                    for m in members:
                        body = m["content"].encode()
                        info = tarfile.TarInfo(m["path"])
                        info.size = len(body)
                        tar.addfile(info, io.BytesIO(body))
                out.append(blob.getvalue())
                size += len(out[-1])
                if size > 1 << 20 or k == len(b):  # archives leave the task in slices
                    yield b[kept].iloc[first:k].assign(content=out)
                    out, size, first = [], 0, k

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "members")
    return rows.mapInPandas(run, f"{shape}, content binary")


def registry_versions(documents: DataFrame, *kept: str) -> DataFrame:
    """name, version, tarball (and the columns kept) from registry documents(name, json): the version tagged latest and its archive."""
    meta = F.from_json("json", "`dist-tags` map<string,string>, versions map<string,struct<dist:struct<tarball:string>>>")
    rows = documents.withColumn("m", meta).withColumn("version", F.try_element_at(F.col("m.dist-tags"), F.lit("latest")))
    return rows.select(*kept, "name", "version", F.try_element_at(F.col("m.versions"), F.col("version"))["dist"]["tarball"].alias("tarball")).where("version IS NOT NULL AND tarball IS NOT NULL")


def registry_url(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name.replace('/', '%2f')}"


def chats(updates: DataFrame) -> DataFrame:
    """id, label of the distinct chats in bot updates(json)."""
    chat = "struct<chat:struct<id:bigint,title:string,username:string,first_name:string>>"
    kinds = ("message", "channel_post", "edited_message", "my_chat_member")
    parsed = F.from_json("json", "result array<struct<" + ",".join(f"{k}:{chat}" for k in kinds) + ">>")
    rows = updates.select(F.posexplode(parsed["result"]).alias("k", "u")).select("k", F.posexplode(F.array(*[F.col(f"u.{k}.chat") for k in kinds])).alias("j", "c")).where("c.id IS NOT NULL")
    label = F.coalesce("c.title", "c.username", "c.first_name", F.lit("(chat)"))
    return rows.groupBy(F.col("c.id").alias("id")).agg(F.min_by(label, F.struct("k", "j")).alias("label"))
