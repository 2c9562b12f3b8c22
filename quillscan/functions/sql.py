"""The engine's functions for SQL: register(spark), then for instance

    SELECT path, f.* FROM sources, LATERAL scan_source(path, content) f
    SELECT path, rewrite_source(content) FROM sources
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillscan.functions import matching
from quillscan.functions.catalog import Rule, builtin_rules
from quillscan.functions.pretty import pretty
from quillscan.functions.rewrite import rewrite

_SHAPE = "rule_id string, severity string, line int, column int, snippet string, deobfuscated boolean"


def register(spark: SparkSession, rules: list[Rule] | None = None) -> None:
    """Registers the table function scan_source and the functions rewrite_source, pretty_source and entropy_of."""
    catalog = builtin_rules() if rules is None else rules

    @F.udtf(returnType=_SHAPE)
    class Scan:
        def __init__(self):
            self.ready = matching.prepare(catalog)

        def eval(self, path: str, content: str):
            if path is None or content is None or matching.dialect(path) is None:
                return
            new, record = rewrite(content)
            for text, changed in ((content, False), (new, True)):
                if changed and not any(n for _, n in record):
                    break
                hidden = matching.suppressed(text)
                for h in matching.hits(text, self.ready):
                    if h.line not in hidden:
                        r = self.ready[h.rule].rule
                        yield r.id, r.severity, h.line, h.column, h.snippet, changed

    def each(f):
        return lambda s: s.map(lambda t: None if t is None else f(t))

    spark.udtf.register("scan_source", Scan)
    for name, f, kind in (("rewrite_source", lambda t: rewrite(t)[0], "string"), ("pretty_source", pretty, "string"), ("entropy_of", matching.entropy, "double")):
        spark.udf.register(name, _series(each(f), kind))


def _series(f, kind: str):
    def run(s: pd.Series) -> pd.Series:
        return f(s)

    return F.pandas_udf(run, kind)
