"""Scalar functions on code, documents and keys, all of them column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns that results must agree on.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
LANGUAGE_OF_EXTENSION = {"py": "python", "java": "java", "cs": "csharp", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript"}
NODE_TYPES = {
    "function_definition": "function", "class_definition": "class", "import_statement": "import", "import_from_statement": "import",
    "method_declaration": "function", "constructor_declaration": "function", "class_declaration": "class",
    "function_declaration": "function", "method_definition": "function", "arrow_function": "function", "import_declaration": "import",
}
RATE_LIMIT_WORDS = ("429", "rate limit", "rate-limited", "too many requests", "quota", "resource_exhausted")
BRANCH_PREFIX = "migration/"


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def uuid5(key: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based UUID of `key`, as Python's uuid5; missing for a missing key."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.when(key.isNotNull(), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12)))


def chunk_key(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"))


def item_id(name: Column, query: Column) -> Column:
    return F.substring(F.sha1(F.concat(name, F.lit(":"), query)), 1, 32)


def signature_key(before: Column, kind: Column) -> Column:
    return F.concat(before, F.lit(" -> "), kind)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def title(text: Column) -> Column:
    """The first heading, however long, else the first line without leading hashes, up to 80 characters, else `untitled`."""
    heading = r"(?mdU)^#{1,6}\s+(.+)$"
    first = F.substring(_stripped(F.regexp_replace(_stripped(F.split_part(text, F.lit("\n"), F.lit(1))), "^#+", "")), 1, 80)
    return F.when(text.rlike(heading), _stripped(F.regexp_extract(text, heading, 1))).otherwise(F.coalesce(_or_null(first), F.lit("untitled")))


def docstring(code: Column, language: Column) -> Column:
    """In Python the first text between three double quotes, or if there is none between three single ones; missing if it is empty."""
    double, single = '"""([\\s\\S]*?)"""', "'''([\\s\\S]*?)'''"
    found = F.when(code.rlike(double), F.regexp_extract(code, double, 1)).otherwise(F.regexp_extract(code, single, 1))
    return F.when(language == "python", _or_null(_stripped(found)))


def node_type(syntax: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in NODE_TYPES.items() for x in kv])[syntax], F.lit("code"))


def language_of_path(path: Column) -> Column:
    """The language of a path's extension; missing if there is none for it."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGE_OF_EXTENSION.items() for x in kv])[F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))]


def parent_class(context: Column) -> Column:
    """The name after the last line of a context that begins with `class `."""
    lines = F.filter(F.split(context, "\n"), lambda x: F.ltrim(x).startswith("class "))
    return _or_null(F.trim(F.regexp_extract(F.try_element_at(lines, F.lit(-1)), r"^\s*class ([^(:]*)", 1)))


def fenced_code(text: Column, tags: str = "python|py") -> Column:
    """The content of the first fence that is tagged with one of `tags`, or not at all, up to its line's end; missing if there is none."""
    fence = rf"(?i)```[ \t]*(?:{tags})?[ \t]*\n([\s\S]*?)```"
    return F.when(text.rlike(fence), F.regexp_extract(text, fence, 1))


def module_name(path: Column) -> Column:
    """A file's dotted module: packages by their folder, Python without its ending, others by folder and stem, `index` by its folder."""
    dotted = F.replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit("/"), F.lit("."))
    package = F.regexp_replace(dotted, r"(^|\.)__init__$", "")
    return F.when(path.endswith(".py"), package).otherwise(F.regexp_replace(dotted, r"\.index$", ""))


def resolve_relative(level: Column, name: Column, module: Column) -> Column:
    """The module that a relative import means: `level` parts dropped from the importer's, `name` added; missing beyond the top or if nothing is left."""
    parts = F.split(module, r"\.")
    keep = F.size(parts) - level
    base = F.when(keep > 0, F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0)))).when(keep == 0, F.array().cast("array<string>"))
    return _or_null(F.array_join(F.concat(base, F.when(F.coalesce(name, F.lit("")) != "", F.array(name)).otherwise(F.array().cast("array<string>"))), "."))


def import_target(found: Column, module: Column) -> Column:
    """The module that an import (level, name, submodule) of `module` means; names imported from a package may be its modules, at the top and beyond they stand alone."""
    parts = F.split(module, r"\.")
    none = F.array().cast("array<string>")
    base = F.when(found["level"] <= F.size(parts), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - found["level"], F.lit(0)))).when(found["submodule"], none)
    return F.when(found["level"] == 0, found["name"]).otherwise(F.array_join(F.concat(base, F.array(found["name"])), "."))


def branch_name(run: Column, path: Column) -> Column:
    """The branch of a run for a file: dots for folders, no `.py`, a dash for whatever is neither letter, digit, underscore, dash, dot nor slash."""
    dotted = F.replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.py\z", ""), F.lit("/"), F.lit("."))
    return F.concat(F.lit(BRANCH_PREFIX), run, F.lit("/"), F.regexp_replace(dotted, r"(?U)[^\w\-./]", "-"))


def slug(text: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(text, "utf-8")), r"\s", ""), "+/", "-_"), F.lit("="))


def unslug(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.decode(F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")), "utf-8")


def ratio(part: Column, whole: Column, default: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(default)


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, cut and not rounded; 0 of nothing."""
    return F.when(whole > 0, (part / whole * 100).cast("int")).otherwise(0)


def backoff_seconds(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt) * base, F.lit(most))


def is_rate_limit(message: Column, words: tuple[str, ...] = RATE_LIMIT_WORDS) -> Column:
    low = F.lower(message)
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))


def test_path(path: Column) -> Column:
    """Where the adjacent test of a file would lie."""
    return F.regexp_replace(path, r"([^/]+)$", "test_$1")


def worktree_path(root: Column, branch: Column) -> Column:
    return F.concat(root, F.lit("/"), F.regexp_replace(branch, r"[/\\]", "_"))


def token_usage(metadata: Column) -> Column:
    """Input and output tokens of a message's metadata in either of its two layouts, 0 where absent."""

    def first(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object(metadata, p).cast("int") for p in paths], F.lit(0))

    return F.struct(first("$.usage_metadata.input_tokens", "$.token_usage.prompt_tokens").alias("input_tokens"), first("$.usage_metadata.output_tokens", "$.token_usage.completion_tokens").alias("output_tokens"))
