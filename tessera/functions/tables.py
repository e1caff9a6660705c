"""Functions from a text to many rows, for what SQL can't say; batches go through Arrow."""

from __future__ import annotations

import ast
import difflib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Boundaries from strong to weak, and default sizes.
SEPARATORS = ("\n## ", "\n### ", "\n#### ", "\n\n", "\n", " ")
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 100


def _packed(pieces: Iterator[str], size: int, overlap: int) -> list[str]:
    """Pieces joined by line breaks as long as they fit; a new chunk begins with the end of the one before if that fits."""
    out: list[str] = []
    for piece in pieces:
        if out and len(out[-1]) + 1 + len(piece) <= size:
            out[-1] += "\n" + piece
        else:
            longer = f"{out[-1][-overlap:]}\n{piece}".strip() if out and overlap else piece
            out.append(longer if len(longer) <= size else piece)
    return out


def _windows(text: str, size: int, overlap: int) -> list[str]:
    cut = (text[i : i + size].strip() for i in range(0, len(text), max(1, size - overlap)))
    return [piece for piece in cut if piece]


def split_markdown(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the strongest separator that the text holds, parts that are too long at weaker ones, and packed again
    with overlap. Parts lose the blanks at their ends before they are measured; a text without any separator is cut into windows."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        return _windows(text, size, overlap)
    sep, weaker = separators[at], separators[at + 1 :]
    head, *rest = text.split(sep)

    def pieces() -> Iterator[str]:
        for part in (p.strip() for p in (head, *(sep + r for r in rest))):
            if part:
                yield from split_markdown(part, size, overlap, weaker)

    return _packed(pieces(), size, overlap)


def markdown_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """An array of the chunks of a text; empty for a missing or blank one."""

    @pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_markdown(t, size, overlap) if t else [])

    return run(text)


def _python_imports(code: str | None, module: str | None) -> list[dict]:
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [{"level": 0, "name": a.name, "submodule": False} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [{"level": node.level, "name": n, "submodule": not node.module} for n in ([node.module] if node.module else [a.name for a in node.names])]
    return out


def python_imports(code: Column) -> Column:
    """An array of (level, name, submodule) of what a Python source imports; from-imports give their module, relative ones without a module their names,
    which may be submodules. A source that doesn't parse imports nothing."""

    @pandas_udf("array<struct<level:int,name:string,submodule:boolean>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: _python_imports(c, None))

    return run(code)


def assembled(chunks: DataFrame) -> DataFrame:
    """Rows (file_path, content), one for each file of code chunks: the content of its chunks, one for each start_line (of redelivered ones the
    smallest chunk_id), at its line, with empty lines between. Rows without path, start_line or content add nothing. A task holds one file at a time."""
    own = chunks.select("file_path", "start_line", "chunk_id", "content").filter("file_path is not null and start_line is not null and content is not null")
    placed = own.repartition("file_path").sortWithinPartitions("file_path", "start_line", "chunk_id")

    def run(batches):
        path, last, lines = None, None, []
        for b in batches:
            out = []
            for p, start, content in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if p != path:
                    if path is not None:
                        out.append((path, "\n".join(lines)))
                    path, last, lines = p, None, []
                if start != last:
                    last = start
                    lines.extend([""] * (start - 1 - len(lines)))
                    lines.extend(content.split("\n"))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["file_path", "content"])
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array(["\n".join(lines)])], names=["file_path", "content"])

    return placed.mapInArrow(run, "file_path string, content string")


#: A string, which stays, or a remark, which goes.
SCRIPT_REMARK = r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`)|//[^\n]*|/\*[\s\S]*?\*/"""
SCRIPT_IMPORT = r"(?:\bimport\s*(?:[\w$*{},\s]+\bfrom\s*)?|\brequire\s*\(\s*)[\"'](\.{1,2}/[^\"']*)[\"']"
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx")


def script_imports(code: Column) -> Column:
    """An array of the relative paths that a script imports or requires; what stands in remarks, is exported again or imported at run time counts for nothing."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(code, SCRIPT_REMARK, "$1"), F.lit(SCRIPT_IMPORT), F.lit(1)))


def script_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each import (src, folder, spec): the first that exists of the path as it is, with an ending in place of its own, or an index within."""
    path = F.concat_ws("/", "folder", "spec")

    @pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        import posixpath

        return s.map(posixpath.normpath)

    stem = F.regexp_replace("base", r"(?<=[^/])\.[^./]*$", "")
    tries = [F.col("base"), *(F.concat(stem, F.lit(e)) for e in SCRIPT_ENDINGS), *(F.concat("base", F.lit("/index" + e)) for e in SCRIPT_ENDINGS)]
    tried = imports.select("src", "spec", clean(path).alias("base")).select("src", "spec", F.posexplode(F.array(*tries)).alias("place", "dst"))
    there = tried.join(files.select(F.col("file_path").alias("dst")).distinct(), "dst")
    return there.groupBy("src", "spec").agg(F.min_by("dst", "place").alias("dst"))


def diff_summary(before: Column, after: Column, name: Column, context: int = 2, most: int = 60) -> Column:
    """A unified diff of at most `most` lines, between a/name and b/name, and a note of how many more there are; `(no diff)` for equal texts. A missing text is empty."""

    @pandas_udf("string")
    def run(a: pd.Series, b: pd.Series, names: pd.Series) -> pd.Series:
        def one(x, y, n):
            lines = list(difflib.unified_diff((x or "").splitlines(keepends=True), (y or "").splitlines(keepends=True), f"a/{n}", f"b/{n}", n=context))
            more = [f"... ({len(lines) - most} more lines)\n"] if len(lines) > most else []
            return "".join(lines[:most] + more) or "(no diff)"

        return pd.Series([one(*x) for x in zip(a, b, names)], dtype=object)

    return run(before, after, name)


CHUNK = "array<struct<start_line:int,end_line:int,node_type:string,name:string,content:string,part:int,parent_class:string,parent_context:string>>"


def _solid(text: str) -> int:
    return len(re.sub(r"\s", "", text))


class _Chunks:
    """Chunks of a source in the making: runs of imports and of other code come together, and what is above the limit is cut."""

    def __init__(self, lines: list[str], limit: int):
        self.lines, self.limit, self.out = lines, limit, []

    def text(self, a: int, b: int) -> str:
        return "\n".join(self.lines[a - 1 : b])

    def fits(self, a: int, b: int) -> bool:
        return _solid(self.text(a, b)) <= self.limit

    def add(self, a: int, b: int, kind: str, name: str | None, parent: str | None = None, context: tuple[str, ...] = ()) -> None:
        own = {"node_type": kind, "name": name, "part": 0, "parent_class": parent, "parent_context": "\n".join(context) or None}
        last = self.out[-1] if self.out else None
        if last and kind in ("import", "code") and not last["part"] and all(last[k] == own[k] for k in ("node_type", "parent_context")) and self.fits(last["start_line"], b):
            last |= {"end_line": b, "content": self.text(last["start_line"], b)}
            return
        while a <= b:
            to, size = a, _solid(self.lines[a - 1])
            while to < b and (more := _solid(self.lines[to])) + size <= self.limit:
                to, size = to + 1, size + more
            for part, text in enumerate([self.text(a, to)] if size <= self.limit else self.pieces(self.lines[a - 1])):
                if text.strip():
                    self.out.append(own | {"start_line": a, "end_line": to, "content": text, "part": part})
            a = to + 1

    def pieces(self, line: str) -> list[str]:
        """A line above the limit, cut after the last sign that ends something, or anywhere."""
        out = []
        while len(line) > self.limit:
            cut = max(line.rfind(c, self.limit // 2, self.limit) for c in ";},) ") + 1 or self.limit
            out.append(line[:cut])
            line = line[cut:]
        return [*out, line]

    def close(self, a: int, b: int, parent: str | None, context: tuple[str, ...]) -> None:
        """The end of a block goes with the chunk before it if there is room."""
        last = self.out[-1] if self.out else None
        if last and not last["part"] and self.fits(last["start_line"], b):
            last |= {"end_line": b, "content": self.text(last["start_line"], b)}
        else:
            self.add(a, b, "code", None, parent, context)


_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*`"
_REGEX = r"(?:(?<=[=(,:;!&|?{}\[\n])|(?<=\breturn)|(?<=^))[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"
_QUIET = rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"\"\"[\s\S]*?\"\"\"|(?:@\$?|\$@)\"(?:[^\"]|\"\")*\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_SILENT = {"typescript": re.compile(f"{_QUIET}|{_TEMPLATE}|{_REGEX}"), "": re.compile(_QUIET)}
_NOTE = re.compile(r"\s*(?:@(?!interface)[\w.]+(?:\(.*\))?|\[[^\]]*\])?\s*")
_ON = re.compile(r"\s*(?:[{.?:&|+,)\]]|=>|(?:extends|implements|where|throws)\b)")
_MODS = r"(?:(?:public|private|protected|internal|static|final|sealed|partial|strictfp|unsafe|new|readonly|override|virtual|abstract|async|synchronized|native|extern|default|get|set)\s+)*"
_CLASS = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?{_MODS}(class|interface|struct|record|enum)\s+(\w+)")
_FUNCTION = re.compile(r"(?:async\s+)?function\s+(\w+)")
_METHOD = re.compile(rf"{_MODS}(?:[\w.<>\[\],? ]+\s)?[*#]?([\w$]+)\s*(?:<[^()]*>)?\s*\(")
_NO_METHOD = {"if", "for", "while", "switch", "catch", "return", "throw", "do", "else", "foreach", "lock", "using", "fixed", "function", "await", "yield"}


def _brace_chunks(source: str, language: str, limit: int) -> list[dict]:
    script = language in ("typescript", "javascript", "tsx", "jsx")
    lines = source.split("\n")
    mask = lambda m: re.sub(r"[^\n]", " " if m[0].lstrip()[:2] in ("//", "/*") else "_", m[0])
    bare = _SILENT["typescript" if script else ""].sub(mask, source).split("\n")
    depth, now = [], 0
    for line in bare:
        now += sum(line.count(c) for c in "{[(") - sum(line.count(c) for c in "}])")
        depth.append(now)
    chunks = _Chunks(lines, limit)

    def unit(i: int, b: int, base: int) -> int:
        """The last line of the statement or member that begins at line i, with what is noted before it."""
        while i < b and depth[i - 1] <= base and _NOTE.fullmatch(bare[i - 1]):
            i += 1
        while i < b:
            end = bare[i - 1].rstrip()
            then = next((bare[j] for j in range(i, b) if bare[j].strip()), "")
            ended = script or not end.strip() or end.endswith((";", "}")) or end.lstrip().startswith("#")
            if depth[i - 1] <= base and ended and (end.endswith(";") or not _ON.match(then)):
                break
            i += 1
        return i

    def walk(a: int, b: int, base: int, parent: str | None, context: tuple[str, ...], members: bool) -> None:
        while a <= b:
            if not lines[a - 1].strip():
                a += 1
                continue
            e = unit(a, b, base)
            while e > a and not lines[e - 1].strip():
                e -= 1
            code = next((i for i in range(a, e + 1) if not _NOTE.fullmatch(bare[i - 1])), a)
            head = " ".join(" ".join(bare[code - 1 : e]).split("{")[0].split())
            kind, name, of = "code", None, None
            if m := _CLASS.match(head):
                of = name = m[2]
                kind = "class" if m[1] == "class" and not (script and head.startswith(("export", "abstract", "declare"))) else "code"
            elif m := _FUNCTION.match(head) if script else None:
                kind, name = "function", m[1]
            elif re.match(r"import\b(?!\s*[(.])", head):
                kind = "import"
            elif members and (m := _METHOD.match(head)) and m[1] not in _NO_METHOD and "=" not in head[: m.end()] and head.split("(")[0].split()[0] not in _NO_METHOD | {"new"} and (not script or "{" in " ".join(bare[code - 1 : e])):
                kind, name = "function", m[1]
            opened = next((i for i in range(code, e) if "{" in bare[i - 1] and depth[i - 1] > base), e)
            if chunks.fits(a, e) or opened >= e - 1:
                chunks.add(a, e, kind, name, parent, context)
            else:
                chunks.add(a, opened, kind, name, parent, context)
                shown = lines[code - 1].strip().rstrip("{").rstrip()
                walk(opened + 1, e - 1, depth[opened - 1], of or parent, (*context, shown) if name else context, bool(of))
                chunks.close(e, e, parent, context)
            a = e + 1

    walk(1, len(lines), 0, None, (), False)
    return chunks.out


def brace_chunks(code: Column, language: Column, limit: int = 1200) -> Column:
    """An array like that of `python_chunks`, of a source in Java, C#, TypeScript or JavaScript: its statements and members along the
    blocks. What is above the limit comes as its header and what is in its block; what has no block is cut between lines, a line after a sign."""

    @pandas_udf(CHUNK)
    def run(s: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([_brace_chunks(t, k, limit) if t and t.strip() else [] for t, k in zip(s, kind)])

    return run(code, language)


def python_chunks(code: Column, limit: int = 1200) -> Column:
    """An array of (start_line, end_line, node_type, name, content, part, parent_class, parent_context) of a Python source: its top-level
    statements in runs of at most `limit` characters that are no blanks; a class or function above that comes as its header and what is in it, all else
    is cut between lines, and a line into parts. Contexts are the first lines of the classes and functions around. A source that doesn't parse is code."""

    def one(source: str | None) -> list[dict]:
        if not source or not source.strip():
            return []
        lines = source.split("\n")
        chunks = _Chunks(lines, limit)
        try:
            body = ast.parse(source).body
        except (SyntaxError, ValueError):
            chunks.add(1, len(lines), "code", None)
            return chunks.out

        def first(node) -> int:
            return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])

        def walk(nodes, parent: str | None, context: tuple[str, ...], after: int | None = None) -> None:
            for node in nodes:
                a, b = first(node), node.end_lineno
                if after is not None:  # remarks between the statements of a function stay
                    if b <= after:
                        continue
                    a, after = after + 1, b
                kind = "class" if isinstance(node, ast.ClassDef) else "function" if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else "import" if isinstance(node, (ast.Import, ast.ImportFrom)) else "code"
                if kind in ("class", "function") and not chunks.fits(a, b) and first(node.body[0]) > node.lineno:
                    to = first(node.body[0]) - 1
                    chunks.add(a, to, kind, node.name, parent, context)
                    inner = (*context, lines[node.lineno - 1].strip())
                    walk(node.body, node.name if kind == "class" else parent, inner, to if kind == "function" else None)
                else:
                    chunks.add(a, b, kind, getattr(node, "name", None), parent, context)

        walk(body, None, ())
        return chunks.out

    @pandas_udf(CHUNK)
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(code)
