"""Language labels of paths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, file_ext

# Label of a lower-cased extension.
EXT_LANG = {
    ".go": "Go", ".py": "Python", ".ts": "TypeScript", ".tsx": "TSX", ".js": "JavaScript",
    ".jsx": "JSX", ".java": "Java", ".rs": "Rust", ".rb": "Ruby", ".c": "C",
    ".h": "C/C++ header", ".cc": "C++", ".cpp": "C++", ".cxx": "C++", ".hpp": "C++",
    ".cs": "C#", ".kt": "Kotlin", ".swift": "Swift", ".scala": "Scala", ".clj": "Clojure",
    ".elm": "Elm", ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang", ".hs": "Haskell",
    ".lua": "Lua", ".php": "PHP", ".pl": "Perl", ".pm": "Perl", ".sh": "Shell",
    ".bash": "Shell", ".zsh": "Shell", ".fish": "Shell", ".ps1": "PowerShell", ".sql": "SQL",
    ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".less": "Less", ".vue": "Vue",
    ".svelte": "Svelte", ".md": "Markdown", ".rst": "reStructuredText", ".yaml": "YAML",
    ".yml": "YAML", ".toml": "TOML", ".json": "JSON", ".xml": "XML",
    ".proto": "Protocol Buffers", ".tf": "Terraform", ".nix": "Nix", ".dart": "Dart",
    ".zig": "Zig", ".v": "V",
}
# Label of a whole base name, looked up first.
NAME_LANG = {
    "Dockerfile": "Dockerfile", "Containerfile": "Dockerfile", "Makefile": "Make",
    "GNUmakefile": "Make", "Justfile": "Just", "Rakefile": "Ruby", "Gemfile": "Ruby",
    "build.gradle": "Gradle", "settings.gradle": "Gradle",
    "build.gradle.kts": "Gradle (Kotlin DSL)", "settings.gradle.kts": "Gradle (Kotlin DSL)",
}
OTHER = "Other"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for v in chain(*table.items())]), key)


def detect_language(path: Column | str) -> Column:
    """Label of a path, empty when unknown."""
    return F.coalesce(
        _lookup(NAME_LANG, basename(path)), _lookup(EXT_LANG, F.lower(file_ext(path))), F.lit("")
    )
