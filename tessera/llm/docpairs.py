"""Functions and methods paired with the text that documents them.

A content is cut into tokens by one regular expression for its language, and the tokens become rows. Lag and lead windows over the rows
attach comments and strings to the heads of functions; running sums give every token its place and its depth in braces. The tokens of one depth
are an island, in which the next closing brace ends a function. In Python, indentation is the depth: a line is on the islands of all heads that are
indented no less than it, and the next line on a head's island ends its function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.parsing import language_of
from tessera.session import staged

NESTED = 32  # parentheses in the head of a function; regular expressions nest no further than they are written
_STRING = r'"(?:[^"\\\n]++|\\[\s\S])*+"|' + r"'(?:[^'\\\n]++|\\[\s\S])*+'"
_TRIPLE = r'"""(?:[^\\"]++|\\[\s\S]|"(?!""))*+"""|' + r"'''(?:[^\\']++|\\[\s\S]|'(?!''))*+'''"


def _parens(string: str, comment: str, quotes: str) -> str:
    """Parentheses with what they hold, `NESTED` deep, of which strings and comments are skipped."""
    skip = f"{string}|{comment}"
    flat = rf"[^()/#{quotes}]++|{skip}|[/#]"
    inner = rf"\((?:{flat})*+\)"
    for _ in range(NESTED - 1):
        inner = rf"\((?:{flat}|{inner})*+\)"
    return inner


_PY_PARENS = _parens(f"{_TRIPLE}|{_STRING}", r"#[^\n]*+", "\"'")
_PY_HEAD = rf"(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*(?:\[[^\]\n]*\][ \t]*)?{_PY_PARENS}[ \t]*(?:->[^:\n]*(?:\[[^\]]*\])?[^:\n]*)?:"
_QUOTED = f"{_TRIPLE}|{_STRING}"
#: A string that is a statement, with what ends it: it may document. Contents get a line break at their end.
_DOCABLE = rf"[rRuU]?(?:{_QUOTED})[ \t]*+(?:#[^\n]*+)?(?:\r?\n|;)"
_PYTHON = rf"[ \t\r\n\f]*+(?:{_PY_HEAD}|{_DOCABLE}|[rRbBuUfFtT]{{0,2}}(?:{_TRIPLE}|{_STRING})|#[^\n]*+|;|[^\s\"'#;][^\"'#\n;]*+|\S)|\s++"

_COMMENT = r"//[^\n]*+|/\*[\s\S]*?\*/"
_DOC = r"/\*\*(?!/)[\s\S]*?\*/|///(?!/)[^\n]*+(?:\r?\n[ \t]*+///(?!/)[^\n]*+)*+"
_TEMPLATE = r"`(?:[^`\\]++|\\[\s\S])*+`"
_C_STRING = r'@\$?"(?:[^"]++|"")*+"|\$@"(?:[^"]++|"")*+"|\$?' + _STRING
_RAW = r'"""[\s\S]*?"""'
#: Words that begin no head; a name is none of them either.
_NO = r"(?!(?:if|else|for|foreach|while|do|switch|case|default|catch|finally|try|return|throw|new|in|of|is|as|when|await|yield|using|lock|fixed|checked|unchecked|unsafe|typeof|sizeof|nameof|delete|void|assert|goto|class|record|struct|enum|interface|namespace|package|import|with|super|this|base)\b)"
_NO_NAME = _NO.replace("void|", "")
_MOD = r"(?!(?:if|else|for|foreach|while|do|switch|case|catch|finally|try|return|throw|new|in|is|as|when|await|yield|using|lock|fixed|typeof|assert|goto|class|record|struct|enum|interface|namespace|package|import|var|let|const|function)\b)"


def _typed_head(parens: str, tail: str) -> str:
    """Modifiers, types and a name before parentheses, up to the brace or arrow. No language has twelve modifiers that may stand together, and none twice."""
    word = rf"{_MOD}(?:[\w.$]++(?:\s*<[^(){{}};=]*>)?(?:\s*\[[\s,]*\]|\?)*+|\((?:[^()]*)\)\??|<[^(){{}};=]*>)"
    return rf"(?:{word}\s+){{0,12}}?{_NO_NAME}([^\W\d][\w$]*)\s*(?:<[^(){{}};=]*>)?\s*{parens}\s*{tail}"


_JAVA_PARENS = _parens(f"{_RAW}|{_STRING}", _COMMENT, "\"'")
_JAVA_HEAD = _typed_head(_JAVA_PARENS, r"(?:throws\s+[\w.,\s<>$]+?)?\{")
_CS_PARENS = _parens(f"{_RAW}|{_C_STRING}", _COMMENT, "\"'@$")
_CS_PARENS = _CS_PARENS.replace("|[/#]", "|[/#@$]")
_CS_HEAD = _typed_head(_CS_PARENS, rf"(?:where\s[^{{;=]+)?(?::\s*(?:base|this)\s*{_CS_PARENS}\s*)?(?:\{{|=>)")
_TS_PARENS = _parens(f"{_STRING}|{_TEMPLATE}", _COMMENT, "\"'`")
_RETURNS = r"(?:\s*:\s*[^{};=]+?(?:\{[^{}]*\})?[^{};=]*?)?\s*"
_TS_HEAD = (
    rf"(?:(?:export|default|declare|async)\s+)*+function\s*\*?\s*([^\W\d][\w$]*)\s*(?:<[^(){{}};]*>)?\s*{_TS_PARENS}{_RETURNS}\{{"
    rf"|(?:export\s+)?(?:const|let|var)\s+([^\W\d][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:<[^(){{}};]*>\s*)?(?:{_TS_PARENS}{_RETURNS}|[^\W\d][\w$]*\s*)=>"
    rf"|(?:export\s+)?(?:const|let|var)\s+([^\W\d][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s+)?function\s*\*?\s*\w*\s*(?:<[^(){{}};]*>)?\s*{_TS_PARENS}{_RETURNS}\{{"
    rf"|(?:(?:public|private|protected|static|readonly|override|declare)\s+)*+([^\W\d][\w$]*)\s*[?!]?(?::[^=;(]+)?=\s*(?:async\s*)?{_TS_PARENS}{_RETURNS}=>"
    rf"|(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+|\*\s*)*+(?!(?:function|catch)\b){_NO_NAME}#?([^\W\d][\w$]*)\s*\??\s*(?:<[^(){{}};]*>)?\s*{_TS_PARENS}{_RETURNS}\{{"
)


def _braces(head: str, string: str, parens: str, note: str, stops: str) -> str:
    return rf"[ \t\r\n\f]*+(?:{_DOC}|{_COMMENT}|{note}|{head}|{string}|[{{}};]|[^\s{stops}/{{}};][^{stops}/{{}};\n]*+|\S)|\s++"


_AT = r"@(?!interface\b)[\w.]+[ \t]*"
_TOKENS = {
    "python": _PYTHON,
    "java": _braces(_JAVA_HEAD, f"{_RAW}|{_STRING}", _JAVA_PARENS, rf"{_AT}(?:{_JAVA_PARENS})?", "\"'@"),
    "csharp": _braces(_CS_HEAD, f"{_RAW}|{_C_STRING}", _CS_PARENS, rf"\[[ \t]*(?:\w+:[ \t]*)?[A-Z][\w.]*[ \t]*(?:{_CS_PARENS})?(?:[ \t]*,[ \t]*[A-Z][\w.]*[ \t]*(?:{_CS_PARENS})?)*+[ \t]*\](?=\s*[\w\[/])", "\"'@$"),
    "typescript": _braces(_TS_HEAD, f"{_STRING}|{_TEMPLATE}", _TS_PARENS, rf"{_AT}(?:{_TS_PARENS})?", "\"'`@"),
}
_HEADS = {"python": (_PY_HEAD, 1), "java": (_JAVA_HEAD, 1), "csharp": (_CS_HEAD, 1), "typescript": (_TS_HEAD, 5)}
_NAMES = {"typescript": "typescript", "javascript": "typescript", "tsx": "typescript", "jsx": "typescript", "c#": "csharp", "csharp": "csharp", "java": "java", "python": "python"}
_EXTENSIONS = {"py": "python", "java": "java", "cs": "csharp", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript"}

_SECTIONS = "Args|Arguments|Parameters|Params|Param|Returns?|Yields?|Raises?|Throws|Exceptions?|Attributes|Examples?|Usage|Notes?|Keyword Args|Keyword Arguments|Other Parameters|See Also|Warnings?|References"
_CUT = rf"(?:^|\s)@[A-Za-z]|(?:^|\s):(?:param|parameter|type|returns?|rtype|raises?|throws|arg|argument|key|keyword|var|ivar|cvar|meta|yields?)\b|(?:^|\n)[ \t]*(?:{_SECTIONS})[ \t]*:|(?:^|\n)[ \t]*(?:{_SECTIONS})[ \t]*\n[ \t]*-{{3,}}|<(?:param|typeparam|returns|remarks|exception|value|example|seealso|permission|include|inheritdoc)\b"


def _language(chunks: DataFrame) -> Column:
    names = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])
    ends = F.create_map(*[F.lit(x) for kv in _EXTENSIONS.items() for x in kv])
    return F.when(language_of(F.col("language")).isNotNull(), names[language_of(F.col("language"))]).otherwise(ends[F.lower(F.regexp_extract("file_path", r"\.(\w+)\z", 1))])


def description(doc: Column) -> Column:
    """What a documentation comment or string says before its first tag or section, on one line; missing if that says nothing: fewer than four
    words, or a note that it is still to be written."""
    bare = F.coalesce(F.nullif(F.regexp_extract(doc, rf"\A[rRuU]?({_QUOTED})[ \t]*+(?:#[^\n]*+)?[\r\n;]*\z", 1), F.lit("")), doc)
    text = F.regexp_replace(bare, r"^(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')\z", "")
    text = F.regexp_replace(text, r"\A/\*\*+|\*+/\z", "")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:///|\*+(?!/))[ \t]?", "")
    text = F.regexp_replace(text, r"(?i)</?summary\s*/?>", " ")
    text = F.regexp_replace(F.regexp_extract(text, rf"\A([\s\S]*?)(?:{_CUT}|\z)", 1), r"</?[A-Za-z][^<>]*>", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    good = (F.size(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))) >= 4) & ~text.rlike(r"(?i)\A(?:TODO|FIXME|TBD|auto[- ]?generated)(?![a-z])")
    return F.when(good, text)


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def numbered(chunks: DataFrame) -> DataFrame:
    """Rows (rid, chunk_id, file_path, lang, content, spare) of the chunks in a known language that hold anything that documents; `rid` tells rows apart, `spare` is a
    docstring that stands in for one in the content."""
    own = chunks.select("chunk_id", "file_path", "language", "node_type", "content", "docstring", F.monotonically_increasing_id().alias("rid")).withColumn("lang", _language(chunks))
    elsewhere = ~F.contains(F.col("content"), F.trim("docstring")) & ~F.contains(_squeezed(F.col("content")), F.trim(_squeezed(F.col("docstring"))))
    spare = F.when((F.col("node_type") == "function") & F.col("docstring").isNotNull() & elsewhere, F.col("docstring"))
    own = own.filter("content is not null and lang is not null").withColumn("spare", spare)
    quoted = F.col("content").contains('"') | F.col("content").contains("'")
    documented = F.when(F.col("lang") == "python", F.col("content").contains("def") & quoted).otherwise(F.col("content").contains("/**") | F.col("content").contains("///"))
    return own.filter(documented | F.col("spare").isNotNull()).select("rid", "chunk_id", "file_path", "lang", "content", "spare")


def tokens(own: DataFrame) -> DataFrame:
    """Rows (rid, pos, kind, size, space, indent, py, text, lang, chunk_id, file_path, spare) of the tokens of each row of `numbered`.

    A token has the white space before it. Kinds: H head, D documentation comment, S string that may document, A annotation or in Python remark, O and X braces,
    E semicolon, C remark, T anything else, also white space at the end. `size` counts its characters, `space` those of the white space, and `indent`, in Python,
    those of the white space after a line break. Heads carry what belongs to the chunk; heads, comments and strings their text.
    """
    text = F.when(F.col("lang") == "python", F.concat("content", F.lit("\n"))).otherwise(F.col("content"))
    cut = F.coalesce(*[F.when(F.col("lang") == name, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for name, p in _TOKENS.items()])
    rows = own.select("rid", "lang", "chunk_id", "file_path", "spare", F.posexplode(cut).alias("pos", "whole"))
    rows = rows.withColumn("tok", F.ltrim("whole", F.lit(" \t\r\n\f")))
    tok, py, one = F.col("tok"), F.col("lang") == "python", F.length("tok") == 1
    start, end, size = F.substring("tok", 1, 1), F.right("tok", F.lit(1)), F.length("whole")
    # First and last characters tell the kinds apart; a head's pattern is the only one that goes on to a brace.
    kind = (
        F.when(tok == "", "T")
        .when(
            py,
            F.when(start == "#", "A")
            .when(start == ";", "E")
            .when((end == ":") & start.isin("d", "a") & tok.rlike(r"\A(?:async[ \t]+)?def[ \t]"), "H")
            .when(end.isin("\n", ";") & ~one, "S")
            .otherwise("T"),
        )
        .when(start == "/", F.when(tok.startswith("/**") & (tok != "/**/") | tok.startswith("///") & ~tok.startswith("////"), "D").when(one, "T").otherwise("C"))
        .when(start == "{", "O")
        .when(start == "}", "X")
        .when(start == ";", "E")
        .when((end == "{") | tok.endswith("=>"), "H")
        .when((start == "@") & ~tok.startswith('@"') & ~tok.startswith("@$") | (start == "[") & (end == "]") & (F.col("lang") == "csharp"), "A")
        .otherwise("T")
    )
    space = size - F.length("tok")
    white = F.substring("whole", F.lit(1), space)
    indent = F.when(py & white.contains("\n"), F.length(F.substring_index(white, "\n", -1)))
    rows = rows.withColumns({"kind": kind, "size": size, "space": space, "indent": indent, "py": py})
    head = F.col("kind") == "H"
    return rows.select("rid", "pos", "kind", "size", "space", "indent", "py", F.when(F.col("kind").isin("D", "S", "H"), tok).alias("text"), *[F.when(head, F.col(c)).alias(c) for c in ("lang", "chunk_id", "file_path", "spare")])


def name_of(head: Column, lang: Column) -> Column:
    """The name in a head; missing if the token is none."""
    groups = {name: [F.nullif(F.regexp_extract(head, rf"\A(?:{p})\z", g), F.lit("")) for g in range(1, n + 1)] for name, (p, n) in _HEADS.items()}
    return F.coalesce(*[F.when(lang == name, F.coalesce(*found)) for name, found in groups.items()])


def delimited(rows: DataFrame) -> DataFrame:
    """The heads among tokens with `doc`, their documentation - the string after it in Python, the comment before it in other languages, else the chunk's docstring for its
    first head -, `start`, and `stop`, where the function ends; missing if that is the end of the chunk."""
    by_place = "over (partition by rid order by pos)"
    solid = "if(kind <> 'A', struct(kind, text), null)"
    opens = "(kind = 'O' or kind = 'H' and not py and endswith(text, '{'))"
    seen = rows.select(
        "rid", "pos", "kind", "py", "text", "lang", "chunk_id", "file_path", "spare", "size", "space", "indent",
        F.expr(f"lag({solid}, 1) ignore nulls {by_place}").alias("before"), F.expr(f"lead({solid}, 1) ignore nulls {by_place}").alias("after"), F.expr(f"lag(kind) {by_place}").alias("last"),
        F.expr(f"sum(size) {by_place}").alias("end"), F.expr(f"sum(if(kind = 'H', 1, 0)) {by_place}").alias("nth"),
        F.expr(f"cast(sum(case when {opens} then 1 when kind = 'X' then -1 else 0 end) {by_place} - if({opens}, 1, 0) as int)").alias("depth"),
    )
    first_on_line = F.coalesce("indent", F.when(F.col("last").isNull() | (F.col("last") == "S"), F.col("space")))
    seen = seen.withColumn("indent", F.when(F.col("py") & (F.col("kind") != "A"), first_on_line))
    # The islands of a chunk of Python are the indents of its heads, of which the language allows a hundred.
    seen = seen.withColumn("heads", F.expr("collect_set(if(py and kind = 'H', coalesce(indent, 0), null)) over (partition by rid)"))
    kept = seen.filter(F.expr("if(py, kind = 'H' or indent is not null, kind in ('H', 'O', 'X', 'E'))"))
    depth = F.when(F.col("py"), F.filter("heads", lambda k: k >= F.coalesce("indent", F.lit(0)))).otherwise(F.array("depth"))
    begin = (F.col("end") - F.col("size") + F.col("space")).alias("start")
    islands = kept.select("rid", "pos", "kind", "py", "nth", "text", "lang", "chunk_id", "file_path", "spare", "before", "after", "indent", "end", begin, F.explode(depth).alias("depth"))
    by_island = "over (partition by rid, depth order by pos)"
    ended = islands.withColumns(
        {
            "closing": F.expr(f"lead(if(kind = 'X', end, null), 1) ignore nulls {by_island}"),
            "ending": F.expr(f"lead(if(kind = 'E', end, null), 1) ignore nulls {by_island}"),
            "next": F.expr(f"lead(start, 1) {by_island}"),
        }
    )
    heads = ended.filter(F.expr("kind = 'H' and (not py or depth = coalesce(indent, 0))"))
    doc = F.when(F.col("py"), F.when(F.col("after.kind") == "S", F.col("after.text"))).when(F.col("before.kind") == "D", F.col("before.text"))
    stop = F.when(F.col("py"), F.col("next")).when(F.col("text").endswith("{") | (F.col("after.kind") == "O"), F.col("closing")).otherwise(F.col("ending"))
    return heads.select("rid", "pos", "chunk_id", "file_path", "lang", "text", F.coalesce(doc, F.when(F.col("nth") == 1, F.col("spare"))).alias("doc"), "start", stop.alias("stop"))


def functions(own: DataFrame) -> DataFrame:
    """Rows (rid, chunk_id, file_path, func_name, description, start, stop) of the functions of rows of `numbered` that have a description.

    Chunks without content or of a language without lexer have none; repeated rows count by themselves. Functions within strings and
    remarks are none. A function without a body is none.
    """
    heads = delimited(tokens(own)).filter("doc is not null and coalesce(stop, start + 1) > start")
    named = heads.select("rid", "chunk_id", "file_path", name_of(F.col("text"), F.col("lang")).alias("func_name"), description(F.col("doc")).alias("description"), "start", "stop")
    return named.filter("func_name is not null and description is not null")


def valid_only(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """Rows whose file is not among the invalid ones of `checked`, the result of `parsing.files`."""
    return rows.join(checked.filter("not valid").select("file_path"), "file_path", "left_anti")


def found(chunks: DataFrame, checked: DataFrame) -> DataFrame:
    return valid_only(functions(numbered(chunks)), checked).select("chunk_id", "func_name")


def pairs(chunks: DataFrame, checked: DataFrame) -> DataFrame:
    """Rows (chunk_id, file_path, func_name, description, code): functions with a description and their code, from the head to the end of the body."""
    own = staged(numbered(chunks), "numbered-chunks")  # one numbering for both uses
    out = valid_only(functions(own), checked).join(own.select("rid", "content"), "rid")
    code = F.rtrim(F.expr("substring(content, cast(start + 1 as int), cast(coalesce(stop, length(content)) - start as int))"), F.lit(" \t\r\n"))
    return out.select("chunk_id", "file_path", "func_name", "description", code.alias("code"))
