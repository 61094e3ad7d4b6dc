"""Which files to index, and why not the others."""

from __future__ import annotations

from fnmatch import translate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LANGUAGES = {
    ".py": "python", ".java": "java", ".js": "javascript", ".ts": "typescript", ".tsx": "typescriptreact", ".jsx": "javascriptreact", ".cpp": "cpp",
    ".cc": "cpp", ".c": "c", ".h": "c/cpp-header", ".hpp": "cpp-header", ".go": "go", ".rs": "rust",
}
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".venv", "venv",
    "env", "node_modules", "dist", "build", "target", "out", ".next", ".turbo", ".gradle",
)
EXCLUDED_GLOBS = (
    "*.pyc", "*.pyo", "*.so", "*.dll", "*.dylib", "*.exe", "*.obj", "*.o", "*.a", "*.lib", "*.zip", "*.tar", "*.tar.gz", "*.tgz", "*.7z", "*.rar",
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.webp", "*.ico", "*.pdf", "*.npy", "*.npz", "*.pt", "*.pth", "*.safetensors", "*.bin", "*.gguf", "*.onnx",
)
MAX_SIZE = 2_000_000
REASONS = ("excluded", "too_large", "unsupported_extension", "binary", "candidate")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension(path)]


def scan_reason(path: Column, size: Column) -> Column:
    globs = "|".join(translate(g).replace(r"\z", r"\Z") for g in EXCLUDED_GLOBS)
    return (
        F.when(F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRS])) | path.rlike(globs), "excluded")
        .when(size > MAX_SIZE, "too_large")
        .when(language(path).isNull(), "unsupported_extension")
        .otherwise("candidate")
    )


def is_binary(content: Column) -> Column:
    """A NUL anywhere, or more than 0.3 of the first 4096 bytes outside text."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    odd = F.length(F.regexp_replace(head, r"[\x07\x08\x09\x0A\x0C\x0D\x1B\x20-\x7E]", ""))
    return F.decode(content, "ISO-8859-1").contains("\x00") | F.coalesce(odd / F.nullif(F.length(head), F.lit(0)) > 0.3, F.lit(False))


def skip_counts(files: DataFrame) -> DataFrame:
    """files (reason) to a count of each reason, zeros kept."""
    keys = files.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    return keys.join(files.groupBy("reason").agg(F.count("*").alias("n")), "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))
