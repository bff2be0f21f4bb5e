"""The language of a file: by its name, else by how it begins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of each language.
SUFFIXES = {
    "python": ".py .pyw", "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .tsx", "go": ".go", "java": ".java", "kotlin": ".kt .kts", "rust": ".rs", "c": ".c .h", "cpp": ".cc .cpp .cxx .hpp",
    "csharp": ".cs", "ruby": ".rb", "php": ".php", "swift": ".swift", "scala": ".scala", "terraform": ".tf .hcl", "yaml": ".yml .yaml", "json": ".json", "dockerfile": ".dockerfile", "shell": ".sh .bash .zsh",
    "powershell": ".ps1", "sql": ".sql", "markdown": ".md",
}
#: What a text without a telling name begins with, in its first characters, and what it holds in the first characters after.
FIRST, FURTHER = 200, 2000
UNKNOWN = "unknown"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def detected(path: Column, content: Column) -> Column:
    """A Dockerfile by its name, other files by their suffix in lower case, the rest by how they begin; null content has no sign, a null path no name."""
    name = F.lower(base_name(path))
    suffix = F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))
    by_name = F.coalesce(F.when(name.rlike(r"^dockerfile(?:\.|$)"), "dockerfile"), *(F.when(suffix.isin(*s.split()), k) for k, s in SUFFIXES.items()))
    head, more = F.left(content, F.lit(FIRST)), F.left(content, F.lit(FURTHER))
    go = F.contains(head, F.lit("package main")) & F.contains(more, F.lit("func "))
    python = F.contains(head, F.lit("def ")) | F.contains(head, F.lit("import "))
    return F.coalesce(by_name, F.when(go, "go").when(python, "python"), F.lit(UNKNOWN))
