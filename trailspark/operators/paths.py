"""File system paths: extraction, validation, categories, scores and project roots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailspark.functions import patterns as P
from trailspark.functions import scalars as S

ROOTS = tuple(f"/{r.lower()}/" for r in P.POSIX_ROOTS)
PROTOCOL = ("jsonrpc", "otel.name", "submission_id=", "thread_id=", "codex.op=")
WEB_PREFIXES = ("/chatgpt.com/", "/backend-api/", "/api/", "/v1/", "/v2/")
RESERVED = ("path", "entry", "special", "filesystem", "permission_profile")
SOURCE_EXTENSIONS = "py ps1 js ts tsx jsx java cs go rs cpp c h hpp rb php sh yml yaml json toml xml html css sql".split()
SCORES = {"Workspace Paths": 5, "Source / Project Files": 5, "Git Paths": 4, "Session Files": 3, "Agent Config / State": 3, "Visualization Paths": 2, "Temporary Files": 1,
          "Runtime Libraries": 1, "Other Filesystem Paths": 2}
LIBRARY_MARKS = ("\\runneradmin\\", "/usr/lib/", "/site-packages/", "\\cargo\\registry\\")
INNER_MARKS = ("\\.git", "\\.agents", "\\.codex", "\\.claude", "\\.gemini")
ANCHORS = ("\\documents\\codex\\", "\\projects\\", "\\workspace\\", "\\src\\")
NO_PROJECT = ("Session Files", "Visualization Paths", "Agent Config / State", "Runtime Libraries", "Temporary Files")


def without_urls_and_markup(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, P.URL, " "), P.OTHER_MARKUP, " ")


def normalize_path(c: Column) -> Column:
    s = S.strip(F.regexp_replace(S.strip(c, "'\"`"), r"(?i)</?path\s*>", ""))
    s = F.replace(s, F.lit("\\\\"), F.lit("\\"))
    return S.strip(F.rtrim(F.rtrim(s, F.lit(S.SPACE + "}])>,;:'\"`")), F.lit(".")))


def is_path(value: Column) -> Column:
    return S.let(F.struct(value.alias("v"), F.lower(value).alias("low")), lambda x: _is_path(x["v"], x["low"]))


def _is_path(v: Column, low: Column) -> Column:
    starts = lambda words: reduce(Column.__or__, map(low.startswith, words))
    common = (v != "") & ~v.contains("<") & ~v.contains(">") & ~low.contains("://") & ~starts(WEB_PREFIXES) & ~S.has_any(low, PROTOCOL)
    windows = (F.char_length(v) > 4) & (F.char_length(v) - F.char_length(F.replace(v, F.lit("\\"), F.lit(""))) >= 2) & v.rlike(r'^[A-Za-z]:\\[^<>|*?"\r\n]+$')
    posix = v.startswith("/") & starts(ROOTS) & low.rlike("[^/]/+[^/]") & ~S.has_any(F.concat(low, F.lit("/")), [f"/{w}/" for w in RESERVED])
    return F.when(v.rlike(P.DRIVE), windows).otherwise(posix) & common


def _distinct(found: Column) -> Column:
    """First occurrences; paths with a drive letter are compared without case."""
    def firsts(x: Column) -> Column:
        return S.let(F.array_distinct(x["k"]), lambda ks: F.when(F.size(ks) == F.size(x["k"]), x["p"]).otherwise(F.transform(ks, lambda k: F.element_at(x["p"], F.array_position(x["k"], k).cast("int")))))

    keyed = S.let(found, lambda ps: F.struct(ps.alias("p"), F.transform(ps, lambda p: F.when(p.rlike(P.DRIVE), F.lower(p)).otherwise(p)).alias("k")))
    return S.let(keyed, firsts)


def extract_paths(text: Column, cwd: Column, target: Column, free: Column) -> Column:
    """High-confidence paths in order of trust: declared fields, <path> bodies, then free text where ``free`` holds.

    Patterns run only on texts with their marks; a candidate that is no path falls out at the end, the target too."""
    none = F.array().cast("array<string>")
    bodies = lambda t: F.when(t.contains("<"), S.all_matches(t, P.PATH_BODY, 1)).when(t.isNotNull(), none)
    windows = lambda t: F.when(t.contains(":\\"), S.all_matches(t, P.WINDOWS_PATH, 1)).otherwise(none)
    posix = lambda t: F.when(t.contains("/"), S.all_matches(t, P.POSIX_PATH, 1)).otherwise(none)
    loose = lambda t: S.let(without_urls_and_markup(t), lambda clean: F.concat(windows(clean), posix(clean)))
    marked = lambda t: F.concat(bodies(t), F.when(free & (t.contains("/") | t.contains("\\")), loose(t)).otherwise(none))
    every = F.concat(F.array(S.text(cwd), S.text(target)), S.let(text, marked))
    return _distinct(F.filter(F.transform(every, normalize_path), is_path))


def categorize(path: Column) -> Column:
    return S.let(F.struct(F.lower(path).alias("raw"), F.lower(F.replace(path, F.lit("/"), F.lit("\\"))).alias("low")), lambda x: _category(x["raw"], x["low"]))


def _category(raw: Column, low: Column) -> Column:
    return (
        F.when(low.contains("\\sessions\\") | low.endswith(".jsonl"), "Session Files").when(low.contains("\\visualizations\\"), "Visualization Paths").when(low.contains("\\.git"), "Git Paths")
        .when(S.has_any(low, ("\\.codex", "\\.claude", "\\.gemini", "\\.continue")), "Agent Config / State")
        .when(S.has_any(low, ("\\.cargo\\registry\\", "\\cargo\\registry\\")), "Runtime Libraries")
        .when(low.rlike(rf"\.(?:{'|'.join(SOURCE_EXTENSIONS)})$"), "Source / Project Files")
        .when(low.contains("\\documents\\codex") | S.has_any(raw, ("/projects/", "/workspace/")), "Workspace Paths")
        .when(S.has_any(low, ("\\temp\\", "\\tmp\\")), "Temporary Files").otherwise("Other Filesystem Paths"))


def interest_score(path: Column, category: Column) -> Column:
    scores = F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv])
    score = F.coalesce(F.try_element_at(scores, category), F.lit(1))
    return F.when(S.has_any(F.lower(path), LIBRARY_MARKS), F.least(score, F.lit(1))).otherwise(score)


def project_root(path: Column) -> Column:
    """The project a path belongs to: cut at internal folders, then an anchor and two parts, else a fixed depth."""
    norm = F.replace(path, F.lit("/"), F.lit("\\"))
    for mark in INNER_MARKS:
        norm = S.let(norm, _cut_at(mark))
    return S.let(F.struct(path.alias("path"), norm.alias("norm"), categorize(path).alias("category")), lambda x: _root(x["path"], x["norm"], x["category"]))


def _cut_at(mark: str):
    return lambda n: F.when(F.instr(F.lower(n), mark) > 3, F.left(n, F.instr(F.lower(n), mark) - 1)).otherwise(n)


def _root(path: Column, norm: Column, category: Column) -> Column:
    def anchored(anchor: str) -> Column:
        end = F.instr(F.lower(norm), anchor) + len(anchor) - 1
        rest = F.filter(F.split(F.substring(norm, end + 1, F.char_length(norm)), r"\\"), lambda p: p != "")
        return F.when(F.instr(F.lower(norm), anchor) > 0, S.let(rest, lambda r: F.when(F.size(r) > 0, F.concat(F.left(norm, end), F.array_join(F.slice(r, 1, 2), "\\")))))

    def deep(parts: Column) -> Column:
        return F.when(F.get(parts, F.lit(0)).rlike("^[A-Za-z]:$") & (F.size(parts) >= 4), F.array_join(F.slice(parts, 1, 4), "\\")).when(
            path.startswith("/") & (F.size(parts) >= 3), F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, 3), "/"))).otherwise("")

    by_depth = S.let(F.filter(F.split(norm, r"\\"), lambda p: p != ""), deep)
    return F.coalesce(*map(anchored, ANCHORS), F.when(category.isin(*NO_PROJECT), "").otherwise(by_depth))


def records(found: Column, observation: Column) -> Column:
    sorted_out = F.transform(found, lambda p: F.struct(p.alias("p"), categorize(p).alias("c")))
    return F.transform(sorted_out, lambda x: F.struct(
        x["p"].alias("path"), x["c"].alias("category"), interest_score(x["p"], x["c"]).alias("interest_score"), project_root(x["p"]).alias("project_root"), observation.alias("observation")))
