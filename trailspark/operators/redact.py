"""Masking of potential secrets before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import patterns as P
from trailspark.functions import scalars as S

TEXT_FIELDS = ("text", "details", "summary", "target", "working_directory")
LIST_FIELDS = ("commands", "urls", "api_endpoints")
FINDINGS = "array<struct<type:string,masked:string,source:string,sha256:string>>"


def redact(value: Column) -> Column:
    """struct<text, findings>: the patterns in turn, each over what the ones before left.

    A text is cut at its matches and put together again with masked ones, so replacement needs no callback.
    """
    state = F.struct(value.alias("text"), F.array().cast(FINDINGS).alias("findings"))
    for name, pattern in P.SECRETS.items():
        state = S.let(state, _masker(name, pattern))
    return state


def _masker(name: str, pattern: str):
    """One pattern's step over struct<text, findings>."""

    def one(v):
        return F.struct(F.lit(name).alias("type"), S.mask_secret(v).alias("masked"), F.lit(None).cast("string").alias("source"), S.hash_text(v).alias("sha256"))

    def cut(a, v):
        at = F.instr(a["rest"], v)
        return F.struct(F.concat(a["out"], F.left(a["rest"], at - 1), S.mask_secret(v)).alias("out"), F.substring(a["rest"], at + F.char_length(v), F.char_length(a["rest"])).alias("rest"))

    def over(s):
        def with_found(found):
            masked = F.aggregate(found, F.struct(F.lit("").alias("out"), s["text"].alias("rest")), cut, lambda a: F.concat(a["out"], a["rest"]))
            return F.struct(masked.alias("text"), F.concat(s["findings"], F.transform(found, one)).alias("findings"))

        return S.let(S.all_matches(s["text"], pattern), with_found)

    return over


def redact_events(events: DataFrame, metadata: bool = True) -> DataFrame:
    """Event fields with secrets masked, findings appended. ``metadata=True`` also masks raw metadata.

    All values of a row pass through one expression, as one array: texts first, then the lists behind each other.
    """
    single = (*TEXT_FIELDS, "metadata")
    values = F.concat(F.array(*map(S.text, single)), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in LIST_FIELDS])
    df = events.withColumn("_r", F.transform(values, redact))
    start, cut = F.lit(len(single) + 1), {}
    for c in LIST_FIELDS:
        n = F.coalesce(F.size(c), F.lit(0))
        cut[c] = F.transform(F.slice("_r", start, n), lambda x: x["text"])
        start = start + n
    found = F.flatten(F.transform(F.filter("_r", lambda x, i: i != len(TEXT_FIELDS)), lambda x: x["findings"]))
    new = {c: F.col("_r")[i]["text"] for i, c in enumerate(single) if c != "metadata" or metadata} | cut | {"secret_findings": F.concat(F.col("secret_findings").cast(FINDINGS), found)}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in events.columns])


def redact_column(df: DataFrame, name: str, flag: str | None = None) -> DataFrame:
    """One column masked; ``flag`` names a boolean for rows that changed."""
    df = df.withColumn("_r", redact(S.text(name))).withColumn(name, F.col("_r.text"))
    return (df.withColumn(flag, F.size("_r.findings") > 0) if flag else df).drop("_r")
