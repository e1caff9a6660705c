"""Lexers that fold sources into groups for the grammars, and the question whether a source is valid."""

from __future__ import annotations

import functools
import re

from tessera.llm import grammars as g
from tessera.llm.gll import BRACKETS, GROUP, NEWLINE, Grammar

LANGUAGES = {"python": "python", "java": "java", "csharp": "csharp", "c#": "csharp", "typescript": "typescript", "javascript": "typescript", "tsx": "typescript", "jsx": "typescript"}
EXTENSIONS = {".py": "python", ".java": "java", ".cs": "csharp", ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript"}
_CLOSE = {")": "(", "]": "[", "}": "{"}
_CLOSE_OF = {-1: "(", -2: "[", -3: "{"}
_ERROR = (1 << 28) - 1  # a kind that no terminal matches
_PATH = re.compile(r"\s*[^\W\d]\w*(?:\.[^\W\d]\w*)*\s*\Z")

_OPEN, _SHUT, _BAD, _BREAK = {"(": -1, "[": -2, "{": -3}, {")": -4, "]": -5, "}": -6}, -7, -8
_KEPT = 200_000
#: Rules of the grammars that are elements between commas.
_PYTHON_LISTS = {"ListBody": "StarItem", "Index": "Slice", "PatGroup": "Pattern", "Args": "Named", "DictBody": "Item", "Paren": "Named"}
_LISTS = {
    "java": {"ArrayInit": "VarInit", "AnnArray": "AnnVal"},
    "csharp": {"ArrayInit": "VarInit", "Init": "InitItem", "Elements": "Expr"},
    "typescript": {"Elements": "Assign", "Tuple": "TupleItem", "ObjLit": "Prop"},
}


class _Kinds(dict):
    """Kinds of tokens by their text, found out once each; below 0 are brackets, errors and line breaks."""

    def __init__(self, grammar: Grammar, literal):
        self.known = {w: c for w, c in grammar.kinds.items() if w not in ("NUM", "STR", "ID") and w != "~~"} | _OPEN | _SHUT
        if "~~" in grammar.kinds:
            self.known["~"] = grammar.kinds["~~"]
        self.grammar, self.literal = grammar, literal

    def __missing__(self, text: str) -> int:
        kind = self.known.get(text)
        if kind is None:
            kind = self.literal(text, self.grammar)
        if len(self) > _KEPT:
            self.clear()
        self[text] = kind
        return kind


# ---------------------------------------------------------------- Python

_HEADS = [h for h in g.PYTHON_LINES if h not in ("Line", "Decorator", "MatchHead")]
_LINES = [*g.PYTHON_LINES, *(h + "1" for h in _HEADS)]
_INT = r"(?:[1-9](?:_?\d)*|0(?:_?0)*)"
_DIGITS = r"\d(?:_?\d)*"
_PY_NUMBER = rf"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:{_DIGITS})?\.{_DIGITS}(?:[eE][-+]?{_DIGITS})?[jJ]?|{_DIGITS}\.(?:[eE][-+]?{_DIGITS})?[jJ]?|{_DIGITS}[eE][-+]?{_DIGITS}[jJ]?|{_DIGITS}[jJ]|{_INT})"
_FIELD = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
_PY = re.compile(
    rf"""(?:[ \t\f]|\\\r?\n|\#[^\n]*)*+(
    \r?\n[ \t\f]*
  | (?:[rR]?[fFtT]|[fFtT][rR])(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|\'\'\'(?:[^\\]|\\.)*?\'\'\'|(?!\"\"\"|\'\'\')(?:"(?:[^"\\\n{{]|\\N\{{[^}}\n]*\}}|\\.|\{{\{{|{_FIELD})*"|'(?:[^'\\\n{{]|\\N\{{[^}}\n]*\}}|\\.|\{{\{{|{_FIELD})*'))
  | (?:[rR][bB]?|[bB][rR]?|[uU])?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|\'\'\'(?:[^\\]|\\.)*?\'\'\'|(?!\"\"\"|\'\'\')(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))
  | [^\W\d]\w*
  | {_PY_NUMBER}(?![\w"']|(?<=\d)\.[^\W\d])
  | \*\*=|//=|>>=|<<=|\.\.\.|->|:=|[-+*/%&|^@=<>!]=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{{}},:;.=]
  | \d\w*\.?\w*|.
    )""",
    re.X | re.S,
)
_NUMBER_ONLY = re.compile(_PY_NUMBER)
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?![0-9a-fA-F]{8})|N(?!\{))")
_NAME = rf"(?!(?:{'|'.join(w for w in g.PYTHON_RESERVED.split() if w.islower())})\b)[^\W\d]\w*"
_PY_PATH = re.compile(rf"\s*{_NAME}(?:\.{_NAME})*\s*\Z")
_EASY_FIELDS = re.compile(rf"(?:[^{{}}]|\{{\{{|\}}\}}|\{{\s*{_NAME}(?:\.{_NAME})*\s*=?(?:![rsa])?(?::[^{{}}]*)?\}})*\Z")


@functools.cache
def _python() -> tuple[Grammar, Grammar]:
    lines = Grammar(g.PYTHON + "".join(f"{h}1 = {h} Line ;\n" for h in _HEADS), g.PYTHON_RESERVED)
    blocks = Grammar(g.PYTHON_BLOCKS, "")
    lines.line_masks, lines.line_first = {}, None
    inner = [blocks._bit.get(("t", n), 0) for n in ("ElifHead", "ElifHead1", "ElseHead", "ElseHead1", "ExceptHead", "ExceptHead1", "GroupHead", "GroupHead1", "FinallyHead", "FinallyHead1")]
    blocks.inner = sum(inner)
    blocks.decorator = blocks._bit["t", "Decorator"]
    return lines, blocks


def _line_kind(lines: Grammar, blocks: Grammar, kinds: tuple[int, ...]) -> int:
    """The kind of a line in the grammar of blocks: all that it may be."""
    code = lines.line_masks.get(kinds)
    if code is None:
        mask = own = 0
        for i, name in enumerate(_LINES):
            if lines.derives(name, kinds):
                mask |= 1 << i
                own |= blocks._bit.get(("t", name), 0)
        code = mask << 4 | 1
        blocks.match[code] = own
        if len(lines.line_masks) > 400_000:
            lines.line_masks.clear()
        lines.line_masks[kinds] = code
    return code


def _statements(blocks: Grammar):
    def cut(content: tuple[int, ...]) -> list[tuple[int, ...]]:
        out, start = [], 0
        for i in range(1, len(content)):
            k = content[i]
            if k < GROUP and not blocks.match[k] & blocks.inner and not blocks.match[content[i - 1]] & blocks.decorator:
                out.append(content[start:i])
                start = i
        return [*out, content[start:]]

    return cut


@functools.lru_cache(4096)
def _column(blank: str) -> tuple[int, int]:
    """Columns of an indentation after its line break, with tabs up to the next multiple of 8, and as 1."""
    col = alt = 0
    for c in blank.lstrip("\r\n"):
        if c == "\t":
            col, alt = (col // 8 + 1) * 8, alt + 1
        elif c == "\f":
            col = alt = 0
        else:
            col, alt = col + 1, alt + 1
    return col, alt


def _string_ok(s: str) -> bool:
    q = min(i for i in (s.find('"'), s.find("'")) if i >= 0)
    prefix = s[:q].lower()
    n = 3 if s[q : q + 3] in ('"""', "'''") else 1
    body = s[q + n : -n]
    if "\\" in body and "r" not in prefix and _BAD_ESCAPE.search(body) and ("b" not in prefix or re.search(r"\\x(?![0-9a-fA-F]{2})", body)):
        return False
    if "b" in prefix and not body.isascii():
        return False
    if "f" in prefix or "t" in prefix:
        return bool(_EASY_FIELDS.match(body)) or _fields_ok(re.sub(r"\\N\{[^}]*\}", "x", body) if "r" not in prefix else body)
    return True


def _fields_ok(body: str, depth: int = 0) -> bool:
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if c == "{" and body[i : i + 2] != "{{" or c == "{" and depth:
            level, j, colon, quote = 1, i + 1, 0, ""
            while j < n:
                d = body[j]
                if quote:
                    quote = "" if d == quote else quote
                elif d in "\"'" and not colon:
                    quote = d
                elif d in "([{":
                    level += 1
                elif d in ")]}":
                    level -= 1
                    if not level:
                        break
                elif d == ":" and level == 1 and not colon:
                    colon = j
                j += 1
            if j >= n:
                return False
            expr = re.sub(r"(?:(?<![=!<>])=)?\s*(?:![rsa])?\s*\Z", "", body[i + 1 : colon or j])
            if not _PY_PATH.match(expr) and not python_expression(expr):
                return False
            if colon and "{" in body[colon:j] and not _fields_ok(body[colon + 1 : j], depth + 1):
                return False
            i = j + 1
        elif c == "}":
            if depth or body[i : i + 2] != "}}":
                return False
            i += 2
        else:
            i += 2 if c == "{" else 1
    return True


def _python_literal(text: str, grammar: Grammar) -> int:
    c = text[0]
    if text[-1] in "\"'" and len(text) > 1:
        return grammar.kinds["STR"] if _string_ok(text) else _BAD
    if c.isalpha() or c == "_":
        return grammar.identifier
    if c.isdigit() or c == "." and len(text) > 1:
        return grammar.kinds["NUM"] if _NUMBER_ONLY.fullmatch(text) else _BAD
    return _BREAK if "\n" in text else _BAD


@functools.cache
def _python_kinds() -> _Kinds:
    return _Kinds(_python()[0], _python_literal)


def _python_lines(src: str) -> list[tuple[str, tuple[int, ...]]] | None:
    """Logical lines with their indentation."""
    lines, _ = _python()
    kinds = _python_kinds()
    out, cur, stack, blank = [], [], [], ""
    for text in _PY.findall("\n" + src + "\n"):
        kind = kinds[text]
        if kind >= 0:
            cur.append(kind)
        elif kind >= -3:
            stack.append((kind, cur))
            cur = []
        elif kind >= -6:
            if not stack or stack[-1][0] != kind + 3:
                return None
            _, outer = stack.pop()
            outer.append(lines.group(_CLOSE[text], tuple(cur), {}, _PYTHON_LISTS))
            cur = outer
        elif kind == _BREAK:
            if not stack:
                if cur:
                    out.append((blank, tuple(cur)))
                    cur = []
                blank = text
        else:
            return None
    return None if stack or cur else out


def python_expression(src: str) -> bool:
    lines, _ = _python()
    found = _python_lines("(" + src + ")")
    return bool(found) and len(found) == 1 and len(found[0][1]) == 1 and bool(src.strip()) and lines.derives("Line", found[0][1])


def python_valid(src: str) -> bool:
    if "\0" in src:
        return False
    found = _python_lines(src.removeprefix("\ufeff"))
    if found is None:
        return False
    lines, blocks = _python()
    blocks.match.setdefault(_ERROR, 0)
    cut = _statements(blocks)
    sequences = {"Block": cut}
    levels, open_ = [(0, 0)], [[]]

    def close() -> None:
        levels.pop()
        done = tuple(open_.pop())
        open_[-1].append(blocks.group("#", done, sequences))

    for blank, kinds in found:
        col = _column(blank)
        code = _line_kind(lines, blocks, kinds)
        if not blocks.match[code]:
            return False
        if col[0] > levels[-1][0]:
            if col[1] <= levels[-1][1]:
                return False
            levels.append(col)
            open_.append([])
        else:
            while col[0] < levels[-1][0]:
                close()
            if col != levels[-1]:
                return False
        open_[-1].append(code)
    while len(open_) > 1:
        close()
    top = tuple(open_[0])
    return not top or all(blocks.derives("Block", part) for part in cut(top)) or blocks.derives("Block", top)


# ---------------------------------------------------------------- languages of braces

_COMMENTS = r"//[^\n]*|/\*[\s\S]*?\*/"
_NUMBER = r"(?:0[xX][\da-fA-F_]+[lLuU]*|0[bB][01_]+[lLuUn]*|0[oO][0-7_]+n?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][-+]?\d[\d_]*)?[fFdDmM]?|\d[\d_]*(?:\.(?![.\w]))?(?:[eE][-+]?\d[\d_]*)?[fFdDmMlLuUn]{0,2})(?![\w$])"
_CHAR = r"'(?:[^'\\\n]|\\(?:[^\nuxU]|[0-7]{1,3}|u+[\da-fA-F]{4}|x[\da-fA-F]{1,4}|U[\da-fA-F]{8}))'"
_SIMPLE = r'"(?:[^"\\\n]|\\.)*"'


def _lexer(skip: str, word: str, string: str, ops: str) -> re.Pattern:
    operators = "|".join(re.escape(o) for o in sorted(ops.split(), key=len, reverse=True))
    return re.compile(rf"(?:{skip})*+({word}|{_NUMBER}|{string}|/\*|{operators}|[\s\S])")


_OPS = "( ) [ ] { } ; , . @ = < > ! ~ ? : + - * / & | ^ % == <= >= != && || ++ -- += -= *= /= &= |= ^= %= <<= << -> :: ..."
_LEX = {
    "java": _lexer(rf"\s+|{_COMMENTS}", r"(?:[^\W\d]|\$)[\w$]*", rf'"""[\s\S]*?(?<!\\)"""|{_SIMPLE}|{_CHAR}', _OPS),
    "csharp": _lexer(
        rf"\s+|{_COMMENTS}|" + r"\#(?:if|else|elif|endif|region|endregion|pragma|nullable|define|undef|line|warning|error)\b[^\n]*",
        r"@?[^\W\d]\w*",
        rf'\$*"""[\s\S]*?"""|(?:@\$|\$@)"(?:[^"]|"")*"|@"(?:[^"]|"")*"|\$"(?:[^"\\\n{{]|\\.|\{{\{{|\{{[^{{}}\n]*\}})*"|{_SIMPLE}(?:u8)?|{_CHAR}',
        _OPS + " => .. ?? ??=",
    ),
    "typescript": _lexer(  # line breaks, and remarks that hold one, are tokens
        r"[^\S\n]+|//[^\n]*|/\*[^*\n]*+(?:\*(?!/)[^*\n]*+)*+\*/",
        r"\n\s*|/\*[\s\S]*?\*/|(?:[^\W\d]|\$)[\w$]*",
        rf"{_SIMPLE}|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{(?:[^{{}}`]|\{{[^{{}}`]*\}}|`[^`]*`)*\}})*`|(?:(?<=[=(,:\[!&|?;{{}}\n])|(?<=[=(,:\[!&|?;{{}}\n] )|(?<=return ))/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*",
        _OPS.replace(" ->", "").replace(" ::", "") + " => ?? ??= ?. === !== ** **= ||= &&= #",
    ),
}
_TEXT = {"java": (g.JAVA, g.JAVA_RESERVED), "csharp": (g.CSHARP, g.CSHARP_RESERVED), "typescript": (g.TYPESCRIPT, g.TYPESCRIPT_RESERVED)}
#: Words that go on with what a block before them began.
_STAY = "else catch finally while instanceof as is in of with switch when where satisfies extends implements".split()
_SEQUENCES = {"java": ("Block", "ClassBody"), "csharp": ("Block", "ClassBody", "NsBody"), "typescript": ("Block", "ClassBody")}


@functools.cache
def _braces(language: str) -> tuple[Grammar, dict]:
    grammar = Grammar(*_TEXT[language])
    words = {c for w, c in grammar.kinds.items() if re.fullmatch(r"\w+", w) and w not in _STAY and w not in ("NUM", "STR")} | {grammar.kinds.get("@", -1)}
    semi, lines = grammar.kinds[";"], language == "typescript"
    other = grammar.kinds.get("else")

    def cut(content: tuple[int, ...]) -> list[tuple[int, ...]]:
        out, start, last = [], 0, len(content) - 1
        for i, k in enumerate(content):
            if i == last:
                break
            after = content[i + 1]
            bare = after & ~NEWLINE
            if k & ~NEWLINE == semi:
                if bare == other:
                    continue
            elif not (k >= GROUP and BRACKETS[k & 3] == "{" and (bare in words or bare >= GROUP and BRACKETS[bare & 3] == "[") and (not lines or after & NEWLINE)):
                continue
            out.append(content[start : i + 1])
            start = i + 1
        return [*out, content[start:]]

    return grammar, {name: cut for name in _SEQUENCES[language]}


def _braces_literal(language: str):
    def literal(text: str, grammar: Grammar) -> int:
        c = text[0]
        if c == "\n" or text.startswith("/*") and len(text) > 3:
            return _BREAK
        if (text[-1] in "\"'`" or c in "\"'`/" or c in "$@" and '"' in text) and len(text) > 1:
            return grammar.kinds["STR"] if c not in "`$@" or _holes_ok(language, text) else _BAD
        if c.isalpha() or c in "_$@" and len(text) > 1 or c == "_" or c == "$":
            return grammar.identifier
        if c.isdigit() or c == "." and len(text) > 1:
            return grammar.kinds["NUM"]
        return _BAD

    return literal


@functools.cache
def _braces_kinds(language: str) -> _Kinds:
    return _Kinds(_braces(language)[0], _braces_literal(language))


def _folded(language: str, src: str) -> list[int] | None:
    grammar, sequences = _braces(language)
    kinds = _braces_kinds(language)
    cur, stack, newline = [], [], 0
    for text in _LEX[language].findall(src):
        kind = kinds[text]
        if kind >= 0:
            cur.append(kind | newline)
        elif kind >= -3:
            stack.append((kind, cur, newline))
            cur = []
        elif kind >= -6:
            if not stack or stack[-1][0] != kind + 3:
                return None
            _, outer, flag = stack.pop()
            outer.append(grammar.group(_CLOSE[text], tuple(cur), sequences, _LISTS[language]) | flag)
            cur = outer
        elif kind == _BREAK:
            newline = NEWLINE
            continue
        else:
            return None
        newline = 0
    return None if stack else cur


def _holes_ok(language: str, text: str) -> bool:
    """Whether the expressions inside a template are valid."""
    if language == "typescript":
        holes = re.findall(r"(?<!\\)\$\{((?:[^{}`]|\{[^{}`]*\}|`[^`]*`)*)\}", text)
    elif "$" in text[:2] and '"""' not in text:
        holes = [re.sub(r"(?:,\s*-?\w+)?(?::[^()?\"]*)?\Z", "", h) for h in re.findall(r"\{([^{}]*)\}", text.replace("{{", "").replace("}}", ""))]
    else:
        return True
    grammar = _braces(language)[0]
    for hole in holes:
        if not _PATH.match(hole):
            kinds = _folded(language, hole)
            if kinds is None or not grammar.derives("Expr", tuple(kinds)):
                return False
    return True


_MARKUP = re.compile(r"(?=[A-Za-z_$>])(?![A-Za-z_$][\w$]*\s*(?:,|extends\b))")
_TAG_NAME = re.compile(r"\s*([A-Za-z_$][\w$.:\-]*)?\s*")
_IN_TAG = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/)*([A-Za-z_$][\w$:\-]*|\"[^\"]*\"|'[^']*'|/\s*>|[\s\S])")
_TAG_END = re.compile(r"<\s*/\s*([A-Za-z_$][\w$.:\-]*)?\s*>")
_TEXT_RUN = re.compile(r"[^<>{}]+")
#: Words after which an operand follows, so that `<` begins an element.
_OPERAND_FOLLOWS = frozenset("return case default typeof void delete await yield throw else do in of instanceof new extends as".split())


def _folded_markup(src: str) -> list[int] | None:
    """As `_folded`, for the dialect with elements: where an operand may stand, `<` and a name or `>` begin one. An element is a group; its
    tags must match, in its texts braces hold expressions."""
    grammar, sequences = _braces("typescript")
    kinds, lex, lists, own = _braces_kinds("typescript"), _LEX["typescript"], _LISTS["typescript"], grammar.kinds
    cur, stack, newline, at, value, mode = [], [], 0, 0, False, "code"  # the stack holds (bracket, tokens outside, flag, mode outside, name)

    def close(bracket: str) -> None:
        nonlocal cur, mode, value
        _, outer, flag, mode, _ = stack.pop()
        outer.append(grammar.group(bracket, tuple(cur), sequences, lists) | flag)
        cur, value = outer, True

    while True:
        if mode == "code":
            m = lex.match(src, at)
            if not m:
                break
            text, at = m[1], m.end()
            if text == "<" and not value and _MARKUP.match(src, at):
                stack.append(["#", cur, newline, mode, None])
                cur, newline, mode = [], 0, "name"
                continue
            kind = kinds[text]
            if kind >= 0:
                cur.append(kind | newline)
                value = text[0] in "\"'`/$_" and len(text) > 1 or text[0].isalnum() and text not in _OPERAND_FOLLOWS or text[0] in "_$"
            elif kind >= -3:
                stack.append([_CLOSE_OF[kind], cur, newline, mode, None])
                cur, value = [], False
            elif kind >= -6:
                if not stack or stack[-1][0] != _CLOSE[text]:
                    return None
                close(_CLOSE[text])
            elif kind == _BREAK:
                newline = NEWLINE
                continue
            else:
                return None
            newline = 0
        elif mode == "name":
            m = _TAG_NAME.match(src, at)
            at, name = m.end(), m[1] or ""
            stack[-1][4] = name
            if name and src[at : at + 1] == "<":  # arguments of types
                depth, end = 0, at
                while end < len(src):
                    depth += (src[end] == "<") - (src[end] == ">" and src[end - 1] != "=")
                    end += 1
                    if not depth:
                        break
                types = _folded("typescript", src[at:end])
                if depth or types is None or not grammar.derives("TArgs", tuple(types)):
                    return None
                at = end
            if not name:
                if src[at : at + 1] != ">":
                    return None
                at += 1
            cur.append(own["<tag"] if name else own["<frag"])
            mode = "tag" if name else "texts"
        elif mode == "tag":
            m = _IN_TAG.match(src, at)
            if not m:
                return None
            text, at = m[1], m.end()
            if text == "{":
                stack.append(["{", cur, 0, mode, None])
                cur, mode, value = [], "code", False
            elif text == "<":
                stack.append(["#", cur, 0, mode, None])
                cur, mode = [], "name"
            elif text == ">":
                cur.append(own["<open"])
                mode = "texts"
            elif text[0] == "/" and len(text) > 1:
                cur.append(own["/>"])
                close("#")
            elif text == "=":
                cur.append(own["="])
            elif len(text) > 1 and text[0] in "\"'":
                cur.append(own["<str"])
            elif text[0].isalpha() or text[0] in "_$":
                cur.append(own["<name"])
            else:
                return None
        else:
            c = src[at : at + 1]
            if c == "{":
                stack.append(["{", cur, 0, mode, None])
                cur, mode, value, at = [], "code", False, at + 1
            elif c == "<":
                m = _TAG_END.match(src, at)
                if m:
                    if (m[1] or "") != stack[-1][4]:
                        return None
                    at = m.end()
                    cur.append(own["</tag"])
                    close("#")
                else:
                    stack.append(["#", cur, 0, mode, None])
                    cur, mode, at = [], "name", at + 1
            else:
                m = _TEXT_RUN.match(src, at)
                if not m:
                    return None
                at = m.end()
                cur.append(own["<text"])
    return None if stack else cur


def braces_valid(language: str, src: str) -> bool:
    """Whether any dialect of the language accepts the source."""
    grammar, sequences = _braces(language)
    grammar.match.setdefault(_ERROR, 0)
    src = src.removeprefix("\ufeff")
    kinds = _folded(language, src)
    if kinds is not None and _derived(language, grammar, sequences, tuple(kinds)):
        return True
    if language != "typescript" or "<" not in src:
        return False
    kinds = _folded_markup(src)
    return kinds is not None and _derived(language, grammar, sequences, tuple(kinds))


def _derived(language: str, grammar: Grammar, sequences: dict, content: tuple[int, ...]) -> bool:
    if language == "typescript":
        cut = sequences["Block"]
        if content and all(grammar.derives("Block", part) for part in cut(content)):
            return True
    return grammar.derives("File", content)


def valid(language: str | None, src: str) -> bool | None:
    """Whether a source is valid in its language; None if the language is not supported."""
    known = LANGUAGES.get((language or "").strip().lower())
    if known is None:
        return None
    return python_valid(src) if known == "python" else braces_valid(known, src)
