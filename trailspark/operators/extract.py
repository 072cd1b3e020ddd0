"""Commands, secrets and indicators in event texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailspark.functions import patterns as P
from trailspark.functions import scalars as S

SHELL_WORDS = ("exec_command", "shell_command", "commandevent", "powershell", "cmd.exe", "bash", "zsh", "shell")


def commands(look) -> Column:
    """Up to 30 distinct commands of shell events: metadata fields, else the lines of text and details."""
    words = F.concat_ws(" ", *[F.lower(S.text(c)) for c in ("category", "action", "tool_name")])
    fields = F.filter(F.array(*[look(f"cmd:{k}") for k in ("command", "cmd", "argv", "process_command_line")]), lambda x: x != "")
    lines = F.split(F.concat(S.text("text"), F.lit("\n"), S.text("details")), r"\r\n|[\n\r\u000b\f\u001c-\u001e\u0085  ]")
    clean = F.filter(F.transform(F.when(F.size(fields) > 0, fields).otherwise(lines), S.collapse), lambda x: x != "")
    return F.when(S.has_any(words, SHELL_WORDS), F.slice(F.array_distinct(clean), 1, 30)).otherwise(F.array().cast("array<string>"))


#: What a text must contain for a pattern to match at all: marks as they are, and marks in any case. Looking for them is
#: far cheaper than running the pattern.
SECRET_MARKS = {
    "AWS Access Key": (("AKIA", "ASIA"), ()), "GitHub Token": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ()), "Slack Token": (("xox",), ()), "Google API Key": (("AIza",), ()),
    "JWT": (("eyJ",), ()), "Private Key": (("PRIVATE KEY-----",), ()), "Generic Credential": ((), ("key", "secret", "token"))}
INDICATOR_MARKS = {"aws_arn": (("arn:",), ()), "azure_resource": ((), ("/subscriptions/",)), "gcp_project": ((), ("project",)), "registry": ((), ("hkey_", "hklm", "hkcu"))}
LONG_HEX = "[A-Fa-f0-9]{32}"


def matches(text: Column, pattern: str, marks: tuple | None, group: int = 0) -> Column:
    """All matches of a pattern, which runs only on texts with one of its marks; None: on texts with a long run of hexadecimal digits."""
    may = text.rlike(LONG_HEX) if marks is None else S.has_any(text, marks[0]) | S.has_any(F.lower(text), marks[1])
    return F.when(may, S.all_matches(text, pattern, group)).otherwise(F.array().cast("array<string>"))


def secret_matches(text: Column) -> Column:
    """array<struct<type, value>>, pattern by pattern; overlaps of patterns count for each."""
    def named(name):
        return lambda v: F.struct(F.lit(name).alias("type"), v.alias("value"))

    return F.concat(*[F.transform(matches(text, p, SECRET_MARKS[name]), named(name)) for name, p in P.SECRETS.items()])


def secret_findings(text: Column, source: str | None = "event") -> Column:
    """array<struct<type, masked, source, sha256>>; findings of events carry no hash, those of redaction no source."""
    return F.transform(secret_matches(text), lambda m: F.struct(
        m["type"].alias("type"), S.mask_secret(m["value"]).alias("masked"), F.lit(source).cast("string").alias("source"),
        (F.lit(None).cast("string") if source else S.hash_text(m["value"])).alias("sha256")))


def indicator_matches(text: Column) -> Column:
    """array<struct<kind, value>>: every match of the hash, cloud and registry patterns."""
    one = lambda kind, p: F.transform(matches(text, p, INDICATOR_MARKS.get(kind), int(kind == "gcp_project")), lambda v: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(v, "[.,;:]+$", "").alias("value")))
    return F.concat(*[one(k, p) for k, p in P.INDICATORS.items()])
