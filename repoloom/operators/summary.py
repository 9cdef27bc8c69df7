"""Key files, README excerpts and one-row summaries of checkouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_col
from ..functions.paths import file_ext
from ..functions.text import let, utf8_prefix
from .listing import lang_counts, total_files, visible

README_BYTES = 32 * 1024
EXCERPT_LINES = 40

# Names that make a root-level file important.
ALWAYS = ["README", "CONTRIBUTING", "LICENSE", "COPYING", "NOTICE", "CHANGELOG"]
MANIFESTS = [
    "go.mod", "go.work", "package.json", "pnpm-lock.yaml", "yarn.lock", "pyproject.toml", "setup.py", "setup.cfg",
    "Pipfile", "poetry.lock", "Cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle",
    "mix.exs", "Gemfile", "Gemfile.lock", "composer.json", "pubspec.yaml", "deno.json", "deno.jsonc", "shard.yml",
    "stack.yaml", "cabal.project", "Project.toml", "DESCRIPTION", "flake.nix", "default.nix",
]
CONFIGS = [
    "Dockerfile", "Containerfile", "docker-compose.yml", "docker-compose.yaml", "Makefile", "GNUmakefile", "Justfile",
    "justfile", "Taskfile.yml", "Taskfile.yaml",
]
CONFIG_EXTS = [".yaml", ".yml", ".toml"]
CONFIG_WORDS = [".github", ".gitlab", "goreleaser", "ci", "renovate", "netlify", "vercel", "trunk"]
README_EXTS = [".md", ".rst", ".markdown", ".adoc", ".org", ".txt", ""]

_S = r"[\t\n\f\r ]"
# Lines that hold nothing but badges or images.
BADGES = [
    rf"\A{_S}*(?:\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\){_S}*)+\z",
    rf"\A{_S}*(?:!\[[^\]]*\]\([^)]*\){_S}*)+\z",
    rf"\A{_S}*(?:<img\b[^>]*>(?:{_S}|</img>)*)+\z",
    rf"\A{_S}*(?:<a\b[^>]*>{_S}*<img\b[^>]*>{_S}*(?:</a>{_S}*)+)+\z",
]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def important_rank(name: Column | str) -> Column:
    """0 for README and friends, 1 for manifests, 2 for configuration, else null."""
    n = as_col(name)
    base = F.lower(F.regexp_replace(n, r"(\.[^.]*)\z", ""))
    config = n.isin(CONFIGS) | (F.lower(file_ext(n)).isin(CONFIG_EXTS) & _any([base.contains(w) for w in CONFIG_WORDS]))
    return (
        F.when(_any([F.upper(n).startswith(p) for p in ALWAYS]), 0)
        .when(n.isin(MANIFESTS) | n.rlike(r"(?id)\Arequirements.*\.txt\z"), 1)
        .when(config, 2)
    )


def important_files(files: DataFrame) -> DataFrame:
    """Root-level files worth a look, by category and then name."""
    return _important(files).orderBy("project", "category", F.lower("name"), "name")


def _important(files: DataFrame) -> DataFrame:
    root = visible(files).where(~F.col("path").contains("/"))
    return root.select("project", F.col("path").alias("name"), important_rank("path").alias("category")).where("category is not null")


def find_readme(files: DataFrame) -> DataFrame:
    """The README of each project that has one."""
    low = F.lower("path")
    rank = F.lit(None).cast("int")
    for i, ext in enumerate(README_EXTS):
        rank = F.when(low == "readme" + ext, i).otherwise(rank)
    found = files.where(~F.col("path").contains("/") & rank.isNotNull())
    return found.groupBy("project").agg(F.min(F.struct(rank.alias("rank"), "path")).alias("best")).select(
        "project", F.col("best.path").alias("path")
    )


def is_badge_line(line: Column) -> Column:
    """Whether a trimmed line holds badges or images only."""
    return _any([line.rlike(p) for p in BADGES])


def strip_tags(line: Column) -> Column:
    """A line without `<...>`; an unclosed tag runs to the end of the line."""
    return F.replace(F.regexp_replace(line, r"<[^>]*(?:>|\z)", ""), F.lit(">"))


def is_contentless_html(line: Column) -> Column:
    """Markup that shows nothing, or only a short label."""
    rest = _trimmed(strip_tags(line))
    return line.startswith("<") & ((rest == "") | ((F.octet_length(rest) < 30) & ~rest.rlike("[.:;]")))


def opens_banner(line: Column) -> Column:
    """Whether an aligned paragraph or div starts on a trimmed line."""
    low = F.lower(line)
    return low.rlike(r"\A<(?:p|div)(?:\z|[ \t>/])") & (low.contains("align=") | low.contains('style="text-align'))


def closes_banner(line: Column) -> Column:
    """Whether a paragraph or div ends on the line."""
    low = F.lower(line)
    return low.contains("</p>") | low.contains("</div>")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def excerpt(text: Column | str) -> Column:
    """The prose a README starts with, without badges, banners and blank runs.

    One fold over the lines: fenced code is kept as it is, a banner is skipped
    to its end, and the fold stops adding once 40 lines are kept.
    """
    lines = F.transform(F.split(as_col(text), "\n"), lambda raw: F.struct(raw.alias("raw"), _trimmed(raw).alias("line")))
    start = F.struct(
        F.array().cast("array<string>").alias("out"), F.lit(True).alias("lead"),
        F.lit(0).alias("depth"), F.lit(False).alias("fence"),
    )

    def state(out: Column, lead: Column, depth: Column, fence: Column) -> Column:
        return F.struct(out.alias("out"), lead.alias("lead"), depth.alias("depth"), fence.alias("fence"))

    def step(acc: Column, x: Column) -> Column:
        out, lead, depth, fence = acc["out"], acc["lead"], acc["depth"], acc["fence"]
        raw, line = x["raw"], x["line"]
        marks = line.startswith("```") | line.startswith("~~~")
        opens, closes = opens_banner(line), closes_banner(line)
        kept = F.concat(out, F.array(raw))
        shift = F.when(opens & ~closes, 1).when(closes & ~opens & (depth > 0), -1).otherwise(0)
        return (
            F.when(F.size(out) >= EXCERPT_LINES, acc)
            .when(marks, state(kept, F.lit(False), depth, ~fence))
            .when(fence, state(kept, F.lit(False), depth, fence))
            .when((depth > 0) | opens, state(out, lead, depth + shift, fence))
            .when(is_badge_line(line) & (line != "") | is_contentless_html(line), acc)
            .when((line == "") & lead, acc)
            .when(line == "", state(F.concat(out, F.array(F.lit(""))), lead, depth, fence))
            .otherwise(state(kept, F.lit(False), depth, fence))
        )

    def blank(l: Column) -> Column:
        return _trimmed(l) == ""

    def tidy(out: Column) -> Column:
        single = F.filter(out, lambda l, i: ~(blank(l) & (i > 0) & blank(F.coalesce(F.get(out, i - 1), F.lit("x")))))
        return let(single, lambda s: F.when(
            (F.size(s) > 0) & blank(F.coalesce(F.get(s, F.size(s) - 1), F.lit("x"))),
            F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))),
        ).otherwise(s))

    folded = F.aggregate(lines, start, step, lambda acc: acc["out"])
    return F.array_join(let(folded, tidy), "\n")


def readme_excerpts(files: DataFrame) -> DataFrame:
    """(project, path, excerpt) from the first 32 KiB of each README."""
    chosen = find_readme(files)
    # Only possible READMEs carry their contents into the join.  The first
    # letter is a filter parquet can use to skip the rest of a sorted table.
    path = F.col("path")
    likely = files.where((path.startswith("R") | path.startswith("r")) & ~path.contains("/") & F.lower(path).startswith("readme"))
    heads = likely.select("project", "path", utf8_prefix("content", README_BYTES).alias("head"))
    return heads.join(chosen, ["project", "path"]).select("project", "path", excerpt("head").alias("excerpt"))


def summary(files: DataFrame) -> DataFrame:
    """One row per checkout: files, languages, key files and README.

    Every part is aggregated per project before the parts meet.
    """
    languages = lang_counts(files).groupBy("project").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("file_count")).alias("o"), "name", "file_count", "share"))),
            lambda s: F.struct(s["name"].alias("name"), s["file_count"].alias("file_count"), s["share"].alias("share")),
        ).alias("languages")
    )
    key_files = _important(files).groupBy("project").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("category", F.lower("name").alias("low"), "name"))), lambda s: s["name"]
        ).alias("important_files")
    )
    readme = readme_excerpts(files).select("project", F.col("path").alias("readme_path"), "excerpt")
    joined = total_files(files).join(languages, "project", "left").join(key_files, "project", "left").join(readme, "project", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "project", "total_files",
        F.coalesce("languages", F.array().cast("array<struct<name:string,file_count:bigint,share:double>>")).alias("languages"),
        F.coalesce("important_files", none).alias("important_files"), "readme_path", "excerpt",
    )
