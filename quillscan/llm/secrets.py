"""Operator 2 (native): secret scans. Fixed patterns give the base spans; two character Markov models, one of random
strings and one of ordinary identifiers, add spans: a long run of token characters counts as a secret when its
log-likelihood ratio between them is high enough for each of its transitions.

The models are first-order over a fixed alphabet and trained by SQL from a table of labelled samples; the driver gets
the ratio of each pair of characters, rounded to thousandths (a table whose size the alphabet fixes), and it enters
the plan as a literal. All else happens in each row: no shuffle, no Python.

`redact` looks closer than `scan`, whose result SQL fixes. It adds secrets glued to names and paths: the transitions of a run are
summed less LEAST each, a stretch ends where its sum falls to zero or by DROP below its top, and a stretch of CORE
characters with a sum of NEED is widened to the separators (= / _ -) around it. It asks neither for a digit nor for distance from base spans.

Positions are code points, ends exclusive. A pattern's matches are leftmost and non-overlapping, and a match that
fails its length test is dropped after it has consumed its text. Added spans never overlap base spans.

A run without a digit or without a letter is not asked about by `scan`. Defined results: an empty table gives no rows; very long texts are scanned
whole. A null text counts as empty and has no spans; repeated rows are scanned alike; other columns,
whatever their names, are kept by `redact` and ignored by `scan`.
"""

from __future__ import annotations

import hashlib
import random
from base64 import b64encode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.functions import native
from quillscan.llm.common import free_names

# The base patterns, in both engines' common dialect.
_ANY_CASE = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}
_NAMES = "|".join("".join(_ANY_CASE.get(c, c) for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"""({_NAMES})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: (kind, pattern, group that must have so many characters, characters)
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Thousandths of a nat for each transition.
LEAST = 200
#: Of stretches within a run, in the same unit: fall that ends one, least sum, least characters.
DROP, NEED, CORE = 8000, 4000, 10
PLACEHOLDER = "[SECRET]"
_SPAN = "struct<s:int,k:int,e:int>"


def labelled_samples(count: int = 1500, seed: int = 11) -> list[tuple[str, int]]:
    """(token, 1 for random strings and 0 for ordinary identifiers), built from a rule."""
    words = (
        "account action active address admin alpha api app archive array async backup base batch beta block body branch buffer build button cache call case "
        "change channel check class client code color column command common component config connect content context control copy core count create current data "
        "date debug default delete device document domain download draft edit element email enable end entry error event export feature field file filter final "
        "first folder font form format frame function group handle header height history home host http image import index info input item key label language last "
        "layout level library line link list load local lock log login main manager map menu message method mobile model module name network node note number "
        "object offset open option order output page panel parent path pattern policy port prefix price process product profile project public query queue random "
        "range rate read record remote report request resource response result role root route rule sample schema score script search section select server service "
        "session set shape share sign size source spec stage start state static status step store stream string style summary support switch system table target task "
        "team template test text theme thread time title track type update upload user value vector version video view week width window worker year zone"
    ).split()
    rng, out = random.Random(seed), []
    for i in range(count):
        raw = hashlib.sha256(f"sample {seed} {i}".encode()).digest() + hashlib.sha256(f"more {seed} {i}".encode()).digest()
        text = (raw.hex(), b64encode(raw).decode(), "".join(ALPHABET[x % 62] for x in raw), "".join(ALPHABET[x % 36 if x % 36 < 26 else 52 + x % 36 - 26] for x in raw))[i % 4]
        out.append((text[: rng.randint(24, 44)], 1))
        some = [rng.choice(words) for _ in range(rng.randint(3, 6))]
        tail = rng.choice(["", "", str(rng.randint(0, 99)), str(rng.randint(1990, 2030)), f"{rng.randint(1, 9)}"])
        joined = ("_".join(some), "-".join(some), some[0] + "".join(w.title() for w in some[1:]), "".join(w.title() for w in some), "/".join(some), "_".join(some).upper(), "".join(some))[i % 7]
        out.append((joined + rng.choice(["", "_", "-", "v"]) * bool(tail) + tail, 0))
    return out


def samples_table(spark: SparkSession) -> DataFrame:
    """The default labelled samples as a table (token string, secret int)."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f"('{t}', {y})" for t, y in labelled_samples())} AS v(token, secret)")


def train(samples: DataFrame) -> list[int]:
    """The log-likelihood ratio, in thousandths, of each pair of alphabet places (0: any other character)."""
    size = len(ALPHABET) + 1
    place = lambda c: F.expr(f"instr('{ALPHABET}', {c})")
    pairs = (
        samples.where("length(token) > 1 AND secret IS NOT NULL")
        .select((F.col("secret") > 0).alias("y"), F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substring(token, i, 2))")).alias("pair"))
        .select("y", place("left(pair, 1)").alias("a"), place("right(pair, 1)").alias("b"))
    )
    counts = pairs.groupBy("a", "b").agg(F.count_if("y").alias("n1"), F.count_if(~F.col("y")).alias("n0"))
    rows = pairs.groupBy("a").agg(F.count_if("y").alias("t1"), F.count_if(~F.col("y")).alias("t0"))
    grid = samples.sparkSession.range(size * size).select((F.col("id") / size).cast("int").alias("a"), (F.col("id") % size).cast("int").alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = F.log((zero("n1") + 1) / (zero("t1") + size)) - F.log((zero("n0") + 1) / (zero("t0") + size))
    found = grid.join(counts, ["a", "b"], "left").join(rows, "a", "left").select("a", "b", F.round(ratio * 1000).cast("int").alias("llr")).collect()
    table = [0] * (size * size)
    for r in found:
        table[r["a"] * size + r["b"]] = r["llr"]
    return table


def _matches(text: Column, pattern: str, ordinal: int, group: int, least: int) -> Column:
    """array<struct<s, k, e>> of a pattern's matches that pass, from the lengths of the matches and of the gaps between."""
    p = F.lit(pattern)
    found, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    tested = found if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    steps = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), tested, lambda x, t: F.struct(x["g"].alias("g"), x["m"].alias("m"), F.length(t).alias("t")))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.coalesce(x["m"], F.lit(0))
        span = F.struct(begin.alias("s"), F.lit(ordinal).alias("k"), end.alias("e"))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & (x["t"] >= least), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), native.folded(steps, step, lambda x: x["g"] + F.coalesce(x["m"], F.lit(0)), none)).otherwise(none)


def _ratio(token: Column, table: list[int]) -> Column:
    """Whether a token's transitions are at least LEAST each on average more likely under the random model."""
    size = len(ALPHABET) + 1
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0), lambda a, i: a + F.get(ratios, at(i) * size + at(i + 1)))
    return total >= LEAST * (F.length(token) - 1)


def _stretches(token: Column, table: list[int], begin: Column) -> Column:
    """array<struct<s, k, e>> of the random stretches in a run that begins there."""
    size = len(ALPHABET) + 1
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    value = lambda i: F.get(ratios, at(i) * size + at(i + 1)) - LEAST
    state = lambda first, total, top, last, out: F.struct(first.alias("first"), total.alias("total"), top.alias("top"), last.alias("last"), out.alias("out"))
    none = F.array().cast(f"array<{_SPAN}>")

    def put(a: Column) -> Column:
        s = a["first"] - F.length(F.regexp_extract(F.substring(token, F.lit(1), a["first"]), "[^=/_-]*$", 0))
        e = a["last"] + 1 + F.length(F.regexp_extract(F.substring(token, a["last"] + 2, F.length(token)), "^[^=/_-]*", 0))
        good = (a["top"] >= NEED) & (a["last"] - a["first"] + 1 >= CORE) & (e - s >= 20)
        span = F.struct((begin + s).cast("int").alias("s"), F.lit(len(BASE)).alias("k"), (begin + e).cast("int").alias("e"))
        return F.when(good, F.array_append(a["out"], span)).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        total = a["total"] + x["v"]
        top, last = F.greatest(a["top"], total), F.when(total > a["top"], x["i"]).otherwise(a["last"])
        ends = (total <= 0) | (total < top - DROP)
        return F.when(ends, state(x["i"], F.lit(0), F.lit(0), x["i"], put(a))).otherwise(state(a["first"], total, top, last, a["out"]))

    steps = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.struct(i.alias("i"), value(i).alias("v")))
    return F.aggregate(steps, state(F.lit(0), F.lit(0), F.lit(0), F.lit(0), none), step, put)


def with_spans(docs: DataFrame, table: list[int], closer: bool = False, names: tuple[str, str] = ("__base", "__all")) -> DataFrame:
    """docs with two columns, by their names the base spans and all spans: arrays of (start, ordinal of the kind, end), by start and then kind; `closer` adds the random stretches of runs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.array_sort(F.concat(*[_matches(text, p, k, g, n) for k, (_, p, g, n) in enumerate(BASE)]))
    docs = docs.withColumn(names[0], base)
    runs = _matches(text, CANDIDATE, len(BASE), 0, 20)

    def added(x: Column) -> Column:
        token = F.substring(text, x["s"] + 1, x["e"] - x["s"])
        apart = ~F.exists(names[0], lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
        return apart & token.rlike("[0-9]") & token.rlike("[A-Za-z]") & _ratio(token, table)

    spans = [names[0], F.filter(runs, added)]
    if closer:
        spans.append(F.flatten(F.transform(runs, lambda x: _stretches(F.substring(text, x["s"] + 1, x["e"] - x["s"]), table, x["s"]))))
    return docs.withColumn(names[1], F.array_sort(F.concat(*spans)))


def _written(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("model"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_model, base_sha256 and spans of every row of docs."""
    table = train(samples if samples is not None else samples_table(docs.sparkSession))
    found = with_spans(docs.select(F.col("doc_id").cast("long"), "text"), table)
    of = lambda k: F.size(F.filter("__all", lambda x: x["k"] == k)).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate([*(b[0] for b in BASE), "model"])]
    return found.select("doc_id", *counts, F.sha2(_written("__base"), 256).alias("base_sha256"), _written("__all").alias("spans"))


def redact(docs: DataFrame, samples: DataFrame | None = None, placeholder: str = PLACEHOLDER) -> DataFrame:
    """docs with every span of the text replaced (spans that overlap by one placeholder), n_chars counted anew where it is a column."""
    table = train(samples if samples is not None else samples_table(docs.sparkSession))
    base, every = free_names(docs, "__base", "__all")
    found = with_spans(docs, table, closer=True, names=(base, every))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], kept, F.lit(placeholder))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(every, start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    out = found.withColumn("text", F.when(F.size(every) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(every) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def oracle_sql() -> str:
    """The same scan for DuckDB, the models trained by its own SQL."""
    size = len(ALPHABET) + 1
    values = ", ".join(f"('{t}', {y})" for t, y in labelled_samples())
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = [*((k, p, g, n) for k, p, g, n in BASE), ("model", CANDIDATE, 0, 20)]
    raw = " UNION ALL ".join(
        f"SELECT rid, {k} AS k, {n} AS least, unnest(regexp_extract_all(text, {quoted(p)})) AS m, unnest(regexp_extract_all(text, {quoted(p)}, {g})) AS t, "
        f"unnest(string_split_regex(text, {quoted(p)})[:len(regexp_extract_all(text, {quoted(p)}))]) AS gap, generate_subscripts(regexp_extract_all(text, {quoted(p)}), 1) AS i FROM d WHERE regexp_matches(text, {quoted(p)})"
        for k, (_, p, g, n) in enumerate(kinds)
    )
    names = "['assign', 'access', 'hex', 'model'][k + 1]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
samples AS (SELECT * FROM (VALUES {values}) AS v(token, secret)),
pairs AS (SELECT secret, instr('{ALPHABET}', substring(token, i, 1)) AS a, instr('{ALPHABET}', substring(token, i + 1, 1)) AS b
  FROM (SELECT token, secret, unnest(range(1, length(token))) AS i FROM samples)),
cells AS (SELECT a, b, sum(secret) AS n1, sum(1 - secret) AS n0 FROM pairs GROUP BY a, b),
sums AS (SELECT a, sum(secret) AS t1, sum(1 - secret) AS t0 FROM pairs GROUP BY a),
grid AS (SELECT x // {size} AS a, x % {size} AS b FROM range({size * size}) AS r(x)),
llr AS (SELECT grid.a, grid.b, round(1000 * (ln((coalesce(n1, 0) + 1) / (coalesce(t1, 0) + {size})) - ln((coalesce(n0, 0) + 1) / (coalesce(t0, 0) + {size}))))::BIGINT AS v
  FROM grid LEFT JOIN cells USING (a, b) LEFT JOIN sums USING (a)),
raw AS ({raw}),
placed AS (SELECT rid, k, m, length(t) >= least AS good, sum(length(gap) + length(m)) OVER (PARTITION BY rid, k ORDER BY i) AS e FROM raw),
spans AS (SELECT rid, k, m, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM placed WHERE good),
base AS (SELECT * FROM spans WHERE k < 3),
apart AS (SELECT * FROM spans c WHERE k = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.s < c.e AND c.s < b.e)),
steps AS (SELECT rid, s, m, instr('{ALPHABET}', substring(m, i, 1)) AS a, instr('{ALPHABET}', substring(m, i + 1, 1)) AS b
  FROM (SELECT rid, s, m, unnest(range(1, length(m))) AS i FROM apart)),
added AS (SELECT rid, s FROM steps JOIN llr USING (a, b) GROUP BY rid, s, m HAVING sum(v) >= {LEAST} * (length(m) - 1)),
kept AS (SELECT * FROM base UNION ALL SELECT apart.* FROM apart JOIN added USING (rid, s)),
written AS (SELECT rid, sum((k = 0)::INT) AS n_assign, sum((k = 1)::INT) AS n_access, sum((k = 2)::INT) AS n_hex, sum((k = 3)::INT) AS n_model,
  string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, coalesce(n_model, 0)::BIGINT AS n_model,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN written USING (rid)"""
