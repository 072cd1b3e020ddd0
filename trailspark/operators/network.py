"""URLs, domains, endpoints and contacted hosts."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import patterns as P
from trailspark.functions import scalars as S

#: scheme, authority, path and query of a URL; no part is decoded or validated.
SPLIT = r"(?is)^([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_EDGE = "`'\".,;:()[]{}<>"


def url_host(url: Column) -> Column:
    """The lower-cased host: user information and port removed, brackets of an IPv6 address too; empty if none."""
    authority = F.regexp_extract(url, SPLIT, 2)
    bare = F.regexp_replace(authority, r"^.*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(bare, r"^([^:]*)", 1)))


def normalize_url(url: Column) -> Column:
    return F.regexp_replace(S.strip(url, "`'\""), r"[)\]}>.,;:]+$", "")


def is_domain(c: Column) -> Column:
    return S.let(F.lower(S.strip(c, _EDGE)), lambda v: _domain(v, F.split(v, r"\.", -1)))


def _domain(v: Column, labels: Column) -> Column:
    return (v != "localhost") & v.contains(".") & (F.char_length(v) <= 253) & ~F.element_at(labels, -1).isin(P.FILE_EXTENSIONS) & F.forall(labels, lambda x: x.rlike(P.LABEL))


def text_urls(text: Column) -> Column:
    """array<struct<url, host, path, query>> of the URLs of a text that have a host."""
    parts = F.transform(S.let(text, lambda t: F.when(t.contains("://"), S.all_matches(t, P.URL)).when(t.isNotNull(), F.array().cast("array<string>"))), lambda u: F.struct(normalize_url(u).alias("url")))
    parts = F.transform(parts, lambda x: F.struct(x["url"].alias("url"), url_host(x["url"]).alias("host"), F.regexp_extract(x["url"], SPLIT, 3).alias("path"), F.regexp_extract(x["url"], SPLIT, 4).alias("query")))
    return F.filter(parts, lambda x: x["host"] != "")


def url_domains(urls: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(urls, lambda x: x["host"]), is_domain))


def url_endpoints(urls: Column) -> Column:
    some = F.filter(urls, lambda x: ~x["path"].isin("", "/"))
    full = F.transform(some, lambda x: F.regexp_replace(F.concat(x["path"], F.when(x["query"] != "", F.concat(F.lit("?"), x["query"])).otherwise("")), "[`'\".,;:]+$", ""))
    return F.array_distinct(F.filter(full, lambda e: e != ""))


def _host(v: Column) -> Column:
    """struct(kind, value) for a host; an address with colons is settled later, by ``settle_ipv6``."""
    return S.let(F.lower(S.strip(v, "[](){}<>`'\".,;:")), _judged)


def _judged(low: Column) -> Column:
    quad = low.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}(?<!\.)$")
    dropped = quad & (low.startswith("127.") | (low == "0.0.0.0"))
    fine = (low != "") & ~dropped & (quad | is_domain(low) | low.rlike("^[0-9a-f:.]*:[0-9a-f:.]*$"))
    return F.struct(F.when(low.rlike(P.DOTTED), "ipv4").otherwise("domain").alias("kind"), F.when(fine, low).otherwise("").alias("value"))


def _urls(found: Column) -> Column:
    return F.transform(found, lambda u: F.struct(F.lit("url").alias("kind"), F.regexp_replace(u, "[.,;:]+$", "").alias("value")))


def observables() -> Column:
    """Contacted targets of an enriched event: array<struct<kind, value>> in order, distinct.

    Five gates admit a URL or host: request contexts, URL fields and host fields of the metadata, network
    tools, and network commands. Hosts of admitted URLs follow their URLs.
    """
    body = F.concat_ws("\n", S.text("text"), S.text("details"), S.text("target"))
    words = F.concat_ws(" ", *[F.lower(S.text(c)) for c in ("event_type", "category", "action", "tool_name")])
    tool, kind = S.has_any(words, P.NETWORK_TOOLS), F.upper(S.text("event_type"))
    context = (kind == "NETWORK / API") | body.rlike(P.REQUEST_CONTEXT) | tool | F.lower(S.text("source_type")).startswith("sqlite:")
    none = F.array().cast("array<struct<kind:string,value:string>>")
    look = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    fields = F.filter(_urls(F.array(*[look(f"url:{k}") for k in P.URL_KEYS])), lambda x: x["value"].rlike(rf"^(?:{P.URL})$"))
    hosts = F.filter(F.transform(F.filter(F.array(*[look(f"host:{k}") for k in P.HOST_KEYS]), lambda h: h != ""), _host), lambda x: x["value"] != "")
    calls = F.transform(S.all_matches(body, P.SHELL_CALL, 1), lambda j: F.get_json_object(F.concat(F.lit('{"c":'), j, F.lit("}")), "$.c"))
    commands = F.concat(F.col("commands"), F.when(kind == "COMMAND", F.array(body)).otherwise(F.array().cast("array<string>")),
                        F.when(F.lower(S.text("tool_name")) == "exec", F.filter(calls, lambda c: c.isNotNull())).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.flatten(F.transform(commands, lambda c: F.split(c, r"\r\n|[\n\r\u000b\f\u001c-\u001e\u0085  ]"))), lambda x: x.rlike(P.NETWORK_COMMAND))
    asked = F.flatten(F.transform(lines, lambda x: F.concat(_urls(S.all_matches(x, P.URL)), F.filter(F.transform(S.all_matches(x, P.DNS_QUERY, 1), _host), lambda h: h["value"] != ""))))
    every = F.concat(F.when(context, _urls(S.all_matches(body, P.REQUEST_URL, 1))).otherwise(none), fields, hosts, F.when(tool, _urls(S.all_matches(body, P.URL))).otherwise(none), asked)
    hosted = lambda x: S.let(_host(url_host(x["value"])), lambda h: F.when(h["value"] == "", none).otherwise(F.array(x, h)))
    spread = F.flatten(F.transform(every, lambda x: F.when(x["kind"] != "url", F.array(x)).otherwise(hosted(x))))
    return F.array_distinct(spread)


def _canonical(v):
    try:
        ip = ipaddress.ip_address(v)
    except ValueError:
        return None
    return None if ip.is_loopback or ip.is_unspecified else str(ip)


def settle_ipv6(rows: DataFrame, kind: str = "kind", value: str = "value") -> DataFrame:
    """Exploded observables with IPv6 addresses in canonical form; invalid, loopback and unspecified ones go."""
    @F.pandas_udf("string")
    def settled(s: pd.Series) -> pd.Series:
        return s.map(_canonical, na_action="ignore")

    v6 = (F.col(kind) != "url") & F.col(value).contains(":")
    return rows.withColumn(value, F.when(v6, settled(F.when(v6, F.col(value)))).otherwise(F.col(value))).where(F.col(value).isNotNull())
