"""Credentials written into source code: found by form and by name, through layers of encoding, and masked.

A content is scanned for forms that are credentials by themselves (addresses with passwords, headers, tokens with a known make-up, private keys)
and for literals that a name marks (assignments, arguments, defaults, remarks). What may hold more is decoded - base64, hex, percent and
backslash escapes, again and again until nothing is left to decode - and what comes out is scanned again or, if it is binary, read as a key container (DER or
an SSH key). That is done for literals on a line, parts of a concatenation together, literals over lines, runs wrapped over lines and runs without quotes. A hit
inside an encoded literal masks the whole literal, the innermost if they are nested. Rows are independent: no shuffle.
"""

from __future__ import annotations

import binascii
import math
import re
import urllib.parse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PASS = "password passwd pwd pass passphrase passcode pw".split()
_TOKEN = "token secret apikey credential credentials signature sig authkey bearer jwt passkey".split()
_KEYED = "api access private signing secret encryption shared account client master auth service license session deploy app host storage webhook hmac aes rsa ssh".split()
_PLACEHOLDER = re.compile(
    r"""(?ix) \s* | <.*> | \$\{.*\} | \$\(.*\) | \{\{?.*\}?\} | %\(\w+\)s | %s | %[A-Z_]+% | \$[A-Z_]+ | [*x•.\-_#?]+ | (?:your|my|some|insert|enter|put)[-_ ].* | .*[-_ ](?:here|placeholder)
    | change[-_ ]?(?:me|it|this)\W* | replace[-_ ]?me\W* | to[-_ ]?do | tbd | n/?a | null | none | nil | undefined | empty | removed | masked | hidden | test | default
    | (?:example|sample|dummy|fake|placeholder|redacted)?[-_ ]?(?:value|secret|password|passwd|token|key|credential)?s?"""
)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: Forms that are credentials by themselves; group v is what is masked.
_FORMS = re.compile(
    r"""(?x)
    (?P<pem>-----BEGIN[ ](?:[A-Z0-9]+[ ])*PRIVATE[ ]KEY(?:[ ]BLOCK)?-----)
  | (?P<url>[A-Za-z][A-Za-z0-9+.\-]*://[^\s:/@"'`<>{}$\\]*:(?P<v_url>[^\s@/"'`<>\\]+)@(?=[\w\[]))
  | (?P<query>[?&](?:access_?token|auth_?token|token|sig|signature|api_?key|apikey|key|auth|secret|client_secret|password|passwd|pwd)=(?P<v_query>[A-Za-z0-9._~%+/\-]{8,}=*))
  | (?P<conn>(?<=[;"'`,])\s*(?:[Pp]assword|[Pp]wd|PASSWORD|PWD|AccountKey|SharedAccessKey|SharedAccessSignature)\s*=\s*(?P<v_conn>[^;"'`\s]+))
  | (?P<bearer>\b(?:[Bb]earer|BEARER)[ ]+(?P<v_bearer>[A-Za-z0-9._~+/\-]{12,}=*))
  | (?P<basic>\b(?:[Bb]asic|BASIC)[ ]+(?P<v_basic>[A-Za-z0-9+/\-_]{8,}={0,2}))
  | (?P<user>(?:\s-u|--user|--proxy-user)[ =]["']?[^\s:"']+:(?P<v_user>[^\s"'`]+))
  | (?P<jwt>\b(?P<v_jwt>eyJ[\w\-]{8,}\.eyJ[\w\-]{4,}\.[\w\-]{8,}))
  | (?P<known>(?<![\w+/\-])(?P<v_known>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_\w{30,}|github_pat_\w{30,}|[sr]k_(?:live|test)_\w{16,}|xox[abeprs]-[\w\-]{10,}|AIza[\w\-]{35}|glpat-[\w\-]{20,}|npm_\w{36}|pypi-[\w\-]{30,}|SG\.[\w\-]{16,}\.[\w\-]{16,})(?![\w+/]))
  | (?P<login>(?i:\b(?:password|passwd|pwd|passphrase)(?:\s*(?:is|was)?\s*[:=]|\s+is|\s+was)?)[ ]+["'`]?(?P<v_login>[^\s"'`=,;()]{6,}))
    """
)
#: A name, what may stand between, and a quoted value, which may go on in further quoted parts.
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
_NAMED = re.compile(
    rf"""(?xi)(?:pass(?:word|wd|phrase|code|key)?|pwd|(?<![a-z])pw|token|secret|key|credentials?|sig(?:nature)?|access[_-]?id|key[_-]?id|jwt|bearer)(?:[_\-]?(?:b64|base64|hex|encoded))?(?![\w$\-])(?P<glue>
    (?:["'`\]]{{0,2}}\s*(?:\?\s*)?(?::\s*[\w.<>\[\]|?]+\s*=|=>|:=|=|:|,|\(|\?\?|\|\||\bor\b|\*/)\s*))
    (?:(?:new\s+)?[\w.]{{1,40}}\(\s*)?[rbuf@$]{{0,2}}(?P<lit>{_QUOTED})(?P<more>(?:\s*+(?:(?:\+|\.|&|\\\n)\s*+)?(?:{_QUOTED}))*)"""
)
_ENCODING = re.compile(r"(?i)[_\-]?(?:b64|base64|hex|encoded)\Z")
_BARE = re.compile(r"(?<![\w$.\-\"'`?&;])(?P<name>[A-Za-z_][\w\-]*)\s?=\s?(?P<v>[A-Za-z0-9+/_.~!@#$%^&*?\-]{8,}=*)(?![\w(\[\"'])")
_LEADING = re.compile(r"\s*(?:export\s+)?")
_LITERAL = re.compile(rf"{_QUOTED}")
_TRIGGER = re.compile(r"-----BEGIN|://[^\s/]*@|[?&][a-z_]+=|(?i:assword|passwd|pwd|passphrase)|(?:Account|Access)Key|SharedAccessSig|[Bb]earer |BEARER |[Bb]asic |BASIC |eyJ|AKIA|ASIA|gh[pousr]_|github_pat|[sr]k_live|[sr]k_test|xox[a-z]-|AIza|glpat-|npm_|pypi-|SG\.|\s-u[ =]|--user|--proxy-user")
#: Pieces of which a text must hold one to be searched for forms, as they are or in any case, or for names. Each form has one.
_FORM_PIECES = ("://", "-----BEGIN", "AccessKey", "AccountKey", "SharedAccessSig", "earer ", "EARER ", "asic ", "ASIC ", "eyJ", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat", "k_live", "k_test", "xox", "AIza", "glpat-", "npm_", "pypi-", "SG.", "-u ", "-u=", "--user", "--proxy-user", "token=", "sig=", "signature=", "key=", "auth=", "secret=")
#: The end of a word and a long run after it, which is a token if it looks drawn at random.
_TAGGED = re.compile(r"(?<=[A-Za-z][A-Za-z])[_\-](?P<v>[A-Za-z0-9]{30,})(?![\w+/])")
_FORM_WORDS = ("assword", "passwd", "pwd", "passphrase")
_NAME_PIECES = ("pass", "pwd", "pw", "token", "secret", "key", "credential", "sig", "access", "jwt", "bearer")
_PARTS = re.compile(r"[A-Za-z0-9+/_\-]{11,}={0,2}")
_ENCODED = re.compile(r"(?<![\w+/\-])(?=[a-z_/+\-]*[A-Z0-9])(?=[A-Z_/+\-]*[a-z0-9])[A-Za-z0-9+/_\-]{11,}={0,2}|%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[0-7]{3}|&#x?[0-9A-Fa-f]+;")
_BREAK = re.compile(r"(?:\\[nr])+(?:\\?\r?\n[ \t]*)?|[ \t]*\\?\r?\n[ \t]*(?:(?://+|--)[ \t]+|[#*]+[ \t]*)?")
_WRAPPED = re.compile(rf"(?<![\w+/\-])(?:[A-Za-z0-9+/_\-]{{16,}}(?:{_BREAK.pattern}))+[A-Za-z0-9+/_\-]+={{0,2}}(?![\w+/\-])")
_CHAIN = re.compile(rf"(?:{_QUOTED})(?:\s*+(?:(?:\+|\.|&|\\\n)\s*+)?[rbuf@$]{{0,2}}(?:{_QUOTED}))+")
_LONG = re.compile(rf"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`")
_RUN = re.compile(r"(?:[\w.\-]+[=:](?![\s=\"'`<>]|//|$))?([^\s\"'`<>]+)")
_HEX = re.compile(r"[0-9a-fA-F]+").fullmatch
_PEM_END = re.compile(r"-----END[ ](?:[A-Z0-9]+[ ])*PRIVATE[ ]KEY(?:[ ]BLOCK)?-----")


def placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.fullmatch(value))


def kind_of(name: str) -> str | None:
    """What a name says its value is: password, token, id, or nothing. Its last words decide: `token_url` names no token."""
    words = [w.lower() for w in _WORDS.findall(_ENCODING.sub("", name))]
    if not words:
        return None
    last, before = words[-1], words[-2] if len(words) > 1 else ""
    if last in _PASS:
        return "password"
    if last in _TOKEN or last == "key" and before in _KEYED:
        return "token"
    if last == "id" and (before == "key" or before == "access"):
        return "id"
    return None


def _mixed(value: str) -> bool:
    return bool(re.search(r"[a-z][A-Z]|[A-Z][a-z]+[A-Z]", value)) and sum(a.islower() != b.islower() for a, b in zip(value, value[1:])) >= 4


def like_password(value: str) -> bool:
    """Whether a value may be a password, and not the name of a field, a path or a sentence."""
    if len(value) < 4 or placeholder(value) or re.search(r"\s|://|[{}<>]", value) or value.startswith(("${", "$(")):
        return False
    return bool(re.search(r"\d|[^\w\-./:,]", value)) or _mixed(value)


def like_token(value: str) -> bool:
    """Whether a value may be a token or key: long, of one piece, and no words or name."""
    if len(value) < 12 or placeholder(value) or not re.fullmatch(r"[A-Za-z0-9+/=_.~:\-]+", value) or "://" in value:
        return False
    if re.fullmatch(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|sha\d+[:\-].*|[\d.:\-]+", value):
        return False
    if re.fullmatch(r"(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)(?:[_./:\-](?:[a-z]+|[A-Z]+|[A-Z][a-z]+|\d{1,4}))*\d{0,4}", value):
        return len(value) >= 16 and not re.search(r"[_./:\-]", value) and bool(re.fullmatch(r"[A-Z0-9]{16,}", value)) and bool(re.search(r"\d", value))
    return bool(re.search(r"\d", value)) or _mixed(value)


def _random(value: str) -> bool:
    """Whether letters of both cases, with or without digits, are as mixed as if drawn at random; hex digests and names are not."""
    counts = [value.count(c) for c in set(value)]
    entropy = math.log2(len(value)) - sum(n * math.log2(n) for n in counts) / len(value)
    near = list(zip(value, value[1:]))
    changes = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in near)
    odd = sum(a.isupper() and b.isupper() for a, b in near) + sum(c.isdigit() for c in value)  # names have few of either
    return value != value.lower() and value != value.upper() and entropy >= 3.9 and changes * 5 >= len(value) * 2 and odd >= 4


def _word_start(text: str, at: int) -> int:
    while at and (text[at - 1].isalnum() or text[at - 1] in "_$-"):
        at -= 1
    return at


#: Object identifiers under which keys are encrypted with a password, as DER: 1.2.840.113549.1.5 and 1.2.840.113549.1.12.1.
_ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _ssh_key(b: bytes) -> bool:
    """Whether bytes are an SSH key: after the magic the names of cipher and derivation and its options, a number of public keys, and the private part."""
    at = 15

    def number() -> int | None:
        nonlocal at
        if at + 4 > len(b):
            return None
        at += 4
        return int.from_bytes(b[at - 4 : at], "big")

    def string() -> bytes | None:
        nonlocal at
        n = number()
        if n is None or at + n > len(b):
            return None
        at += n
        return b[at - n : at]

    cipher, derivation, options, keys = string(), string(), string(), number()
    if not cipher or not derivation or options is None or not keys or keys > len(b):
        return False
    for _ in range(keys):
        public = string()
        if not public or len(public) < 8 or int.from_bytes(public[:4], "big") + 4 > len(public):
            return False
    private = string()
    if not private or len(private) < 16 or at != len(b):
        return False
    return cipher != b"none" or private[:4] == private[4:8]


def key_container(b: bytes) -> bool:
    """Whether bytes are a private key: an SSH key, or DER whose outermost sequence is made up as PKCS#1, PKCS#8 (plain or encrypted), PKCS#12, SEC1 or DSA."""
    if b.startswith(b"openssh-key-v1\0"):
        return _ssh_key(b)

    def element(at: int) -> tuple[int, int, int] | None:
        if at + 2 > len(b):
            return None
        tag, n, at = b[at], b[at + 1], at + 2
        if n & 0x80:
            size = n & 0x7F
            if not 0 < size <= 4 or at + size > len(b):
                return None
            n, at = int.from_bytes(b[at : at + size], "big"), at + size
        return (tag, at, at + n) if at + n <= len(b) else None

    top = element(0)
    if not top or top[0] != 0x30 or top[2] < len(b) - 2:
        return False
    first = element(top[1])
    if first and first[0] == 0x30:  # certificates and public keys go on with a sequence or a bit string; an encrypted key with an octet string
        oid, data = element(first[1]), element(first[2])
        return bool(oid and data) and oid[0] == 0x06 and b[oid[1] : oid[2]].startswith(_ENCRYPTIONS) and data[0] == 0x04 and data[2] == top[2] and data[2] - data[1] >= 16
    if not first or first[0] != 0x02:
        return False
    version, then = int.from_bytes(b[first[1] : first[2]], "big"), element(first[2])
    if not then:
        return False
    if version == 0:  # PKCS#8: an algorithm, then an octet string; PKCS#1 and DSA: integers up to the end
        after = element(then[2])
        return bool(after) and (then[0] == 0x30 and after[0] == 0x04 or then[0] == 0x02 and after[0] == 0x02 and then[2] - then[1] >= 32)
    if version == 1:  # SEC1: an octet string; PKCS#8 with a public key
        return then[0] == 0x04 or then[0] == 0x30
    return version == 3 and then[0] == 0x30  # PKCS#12


def _decoded(value: str):
    """What a literal may stand for: texts, or bytes that are no text."""
    if "%" in value and re.search(r"%[0-9A-Fa-f]{2}", value):
        yield urllib.parse.unquote(re.sub(r"%(?:25)+(?=[0-9A-Fa-f]{2})", "%", value))  # layers of the sign alone at once
    if "\\" in value and re.search(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-7]{3}|[nrt\"'\\/])", value):
        yield re.sub(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|([0-7]{3})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else chr(int(m[3], 8)) if m[3] else {"n": "\n", "r": "\r", "t": "\t"}.get(m[4], m[4]), value)
    if "&#" in value and re.search(r"&#x?[0-9A-Fa-f]+;", value):
        value = re.sub(r"&#(?:38|x26);(?:#(?:38|x26);)*(?=#)", "&", value)
        yield re.sub(r"&#(?:x([0-9A-Fa-f]{1,6})|(\d{1,7}));", lambda m: chr(min(int(m[1], 16) if m[1] else int(m[2]), 0x10FFFF)), value)
    for part in [*_PARTS.findall(value), *(x for _, _, x in (_wrapped(value) if "\n" in value or "\\" in value else ()))]:
        for raw in _binary(part):
            text = _text(raw)
            yield text if text is not None else raw


def _wrapped(value: str):
    """Encoded runs that go on over lines, as (start, end, joined); also without a first or last line, which may be a word of its own."""
    for m in _WRAPPED.finditer(value):
        breaks = [x.span() for x in _BREAK.finditer(value, *m.span())]
        lines = list(zip([m.start(), *(b for _, b in breaks)], [*(a for a, _ in breaks), m.end()]))
        for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
            own = lines[a : len(lines) - b]
            if len(own) > 1:
                yield own[0][0], own[-1][1], "".join(value[i:j] for i, j in own)


def _opened(value: str) -> bool:
    """Whether a credential comes out of a text, through any layers of encoding. Each is shorter than the one around it, so there is an end."""
    seen, left = {value}, [value]
    while left:
        inner = left.pop()
        for out in _decoded(inner):
            if isinstance(out, bytes):
                if key_container(out):
                    return True
            elif len(out) < len(inner) and out not in seen:
                seen.add(out)
                if _plain(out, True):
                    return True
                if _ENCODED.search(out) or _WRAPPED.search(out):
                    left.append(out)
    return False


def _binary(part: str):
    if len(part) % 2 == 0 and _HEX(part):
        yield bytes.fromhex(part)
    body = part.rstrip("=")
    if len(body) % 4 != 1:
        try:
            yield binascii.a2b_base64(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), strict_mode=True)
        except (binascii.Error, ValueError):
            pass


def _text(raw: bytes) -> str | None:
    if len(raw) < 8:
        return None
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text.isprintable() or all(c.isprintable() or c in "\n\r\t" for c in text) else None


def _promising(token: str) -> bool:
    """Whether an encoded token holds text or what begins as a key container does; escapes may always."""
    return token[0] in "%\\&" or any(raw[:1] == b"0" or raw[:8] == b"openssh-" or _text(raw) is not None for raw in _binary(token))


def _pem_end(text: str, at: int, ends: list) -> int | None:
    """The end of a private key that begins at `at`; none if no key follows. `ends` holds the next end line found for an earlier one, or that there is none."""
    if not ends or ends[0] is not None and ends[0].start() < at:
        ends[:] = [_PEM_END.search(text, at)]
    end = ends[0]
    stop = end.end() if end else None
    if stop is None:
        after = re.compile(r"(?:[A-Za-z0-9+/=\s#*]|\\[nr]|//)*").match(text, at + 20)
        stop = after.end() if after else at
    body = re.sub(r"\\[nr]|-----[A-Z0-9 ]+-----|[^A-Za-z0-9+/=]", "", text[at:stop])
    return stop if len(body) >= 24 else None


def _basic(value: str) -> bool:
    for raw in _binary(value):
        text = _text(raw)
        if text and ":" in text and not placeholder(text.split(":", 1)[1]):
            return True
    return False


def _plain(text: str, inside: bool) -> list[tuple[int, int, str]]:
    """Credentials that stand in a text as they are; inside: it was decoded."""
    hits: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(piece in text for piece in _FORM_PIECES) or any(piece in low for piece in _FORM_WORDS):
        ends: list = []
        for a, b in _lines(text, _TRIGGER):
            _forms(text, a, b, hits, ends)
    for m in _TAGGED.finditer(text):
        if _random(m["v"]):
            hits.append((_word_start(text, m.start()), m.end(), "known"))
    if any(piece in low for piece in _NAME_PIECES):
        _names(text, hits, inside)
    return hits


def _layers(text: str, hits: list) -> None:
    """Adds what is credentials only once it is decoded."""

    covered = bytearray(len(text))
    for a, b, _ in hits:
        covered[a:b] = b"\1" * (b - a)

    def free(s: int, e: int) -> bool:
        return covered.find(1, s, e) < 0

    def add(s: int, e: int) -> None:
        hits.append((s, e, "encoded"))
        covered[s:e] = b"\1" * (e - s)

    encoded = list(_lines(text, _ENCODED, _promising))
    for a, b in encoded:
        for m in _LITERAL.finditer(text, a, b):
            s, e = m.start() + 1, m.end() - 1
            if _ENCODED.search(text, s, e) and free(s, e) and _opened(text[s:e]):
                add(s, e)
    for m in _CHAIN.finditer(text):
        parts = [(x.start() + 1, x.end() - 1) for x in _LITERAL.finditer(text, *m.span()) if len(x[0]) > 2]
        value = "".join(text[s:e] for s, e in parts)
        if len(parts) > 1 and (_ENCODED.search(value) or _WRAPPED.search(value)) and all(free(s, e) for s, e in parts) and _opened(value):
            for s, e in parts:
                add(s, e)
    wrapped = list(_wrapped(text))
    if not encoded and not wrapped:
        return
    for m in _LONG.finditer(text):
        if "\n" in m[0]:
            q = 3 if m[0].startswith(('"""', "'''")) else 1
            inner = m[0][q:-q]
            s, e = m.start() + q + len(inner) - len(inner.lstrip()), m.end() - q - len(inner) + len(inner.rstrip())
            if s < e and (_ENCODED.search(text, s, e) or _WRAPPED.search(text, s, e)) and free(s, e) and _opened(text[s:e]):
                add(s, e)
    for s, e, value in wrapped:
        if free(s, e) and any(key_container(x) if isinstance(x, bytes) else _plain(x, True) or _opened(x) for x in _decoded(value)):
            add(s, e)
    for a, b in encoded:
        for m in _RUN.finditer(text, a, b):
            if _ENCODED.search(text, *m.span(1)) and free(*m.span(1)) and _opened(m[1]):
                runs = [x.span() for x in _PARTS.finditer(text, *m.span(1)) if _opened(x[0])]
                for s, e in runs or [m.span(1)]:
                    add(s, e)


def scan(text: str) -> list[tuple[int, int, str]]:
    """Credentials in a text as (start, end, kind), the places to mask, in order and apart from each other."""
    hits = _plain(text, False)
    _layers(text, hits)
    hits.sort()
    kept: list[tuple[int, int, str]] = []
    for h in hits:
        if kept and h[0] < kept[-1][1]:
            if h[1] > kept[-1][1]:
                kept[-1] = (kept[-1][0], h[1], kept[-1][2])
        else:
            kept.append(h)
    return kept


def _lines(text: str, what: re.Pattern, wanted=None):
    """Bounds of the lines in which `what` is found, with what it finds as wanted."""
    at = 0
    while m := what.search(text, at):
        if wanted and not wanted(m[0]):
            at = m.end()
            continue
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.end())
        at = b = len(text) if b < 0 else b
        yield a, b


def _forms(text: str, at: int, to: int, hits: list, ends: list) -> None:
    while m := _FORMS.search(text, at, to):
        kind, at = m.lastgroup if not m.lastgroup.startswith("v_") else m.lastgroup[2:], m.end()
        if kind == "pem":
            stop = _pem_end(text, m.start(), ends)
            if stop:
                hits.append((m.start(), stop, "private key"))
                at = stop
            continue
        value = m["v_" + kind]
        a, b = m.span("v_" + kind)
        if kind == "url":
            ok = not placeholder(value) and "{" not in value
        elif kind == "conn":
            ok = like_password(value) or like_token(value)
        elif kind == "query":
            ok = like_token(value) or like_password(value)
        elif kind == "basic":
            ok = _basic(value)
        elif kind == "user":
            ok = not placeholder(value)
        elif kind == "login":
            value = value.rstrip(".:")
            b = a + len(value)
            ok = like_password(value) and bool(re.search(r"\d|[!#%+?*^&]", value)) and not re.search(r"[\[\](]", value)
        else:
            ok = kind == "known" or kind == "jwt" or like_token(value)
        if ok:
            hits.append((a, b, kind))
        else:
            at = max(m.start() + 1, a)


def _names(text: str, hits: list, inside: bool) -> None:
    at = 0
    while m := _NAMED.search(text, at):
        at = m.end()
        kind = kind_of(text[_word_start(text, m.start("glue")) : m.start("glue")])
        if not kind:
            at = m.start("glue") + 1
            continue
        a, b = m.start("lit") + 1, m.end("lit") - 1
        parts = [(a, b)]
        joined = re.match(r"\s*(?:\+|\.|&|\\\n|\s)", m["more"]) if m["more"] else None
        if joined:
            parts += [(m.start("more") + x.start() + 1, m.start("more") + x.end() - 1) for x in _LITERAL.finditer(m["more"])]
        value = "".join(text[s:e] for s, e in parts)
        if kind == "password":
            ok = like_password(value)
        else:
            ok = like_token(value) and (kind != "id" or bool(re.fullmatch(r"[A-Z0-9]{12,}", value)))
        if ok:
            hits.extend((s, e, kind) for s, e in parts)
        else:
            at = m.start("glue") + 1
    begin = seen = 0  # of the line, and up to where it was looked through
    remark = False
    for m in _BARE.finditer(text):
        kind = kind_of(m["name"])
        if kind and (like_password(m["v"]) and re.search(r"\d", m["v"]) if kind == "password" else like_token(m["v"])):
            new = text.rfind("\n", seen, m.start()) + 1
            if new:
                begin = seen = new
                remark = False
            remark = remark or bool(re.search(r"#|//|\*|--", text[max(begin, seen - 1) : m.start()]))
            seen = m.start()
            if inside or remark or _LEADING.fullmatch(text, begin, m.start()):
                hits.append((*m.span("v"), kind))


def masked(text: str, hits: list[tuple[int, int, str]]) -> str:
    """The text with every place covered by asterisks, line breaks kept, so that lines and all around stay as they are."""
    out, at = [], 0
    for a, b, _ in hits:
        out += [text[at:a], re.sub(r"[^\r\n]", "*", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def places(df: DataFrame, id_col: str = "chunk_id", content_col: str = "content") -> DataFrame:
    """Rows (id, line_no, kind, start, length), one for each place: its line from 1 and its start from 0 in the content, in code points.

    A credential in parts has a place for each part, all on their lines; `found` counts lines. Missing and empty contents have none. Repeated
    rows count by themselves. Other columns don't matter.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                line, done = 1, 0
                for s, e, kind in scan(text) if text else ():
                    line, done = line + text.count("\n", done, s), s
                    at.append(i)
                    rows.append((line, kind, s, e - s))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["id", "line_no", "kind", "start", "length"])

    own = df.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).filter("content is not null")
    return own.mapInArrow(run, f"id {id_type}, line_no bigint, kind string, start bigint, length bigint")


def redacted(df: DataFrame, id_col: str = "chunk_id", content_col: str = "content") -> DataFrame:
    """`df` with its contents masked and `n_masked`, the number of places; rows without any, also missing contents, come out as they are. A column of
    that name is replaced."""

    df = df.drop("n_masked")
    names = df.columns
    k = names.index(content_col)

    def run(batches):
        for b in batches:
            out, counts = [], []
            for text in b.column(k).to_pylist():
                hits = scan(text) if text else []
                out.append(masked(text, hits) if hits else text)
                counts.append(len(hits))
            cols = list(b.columns)
            cols[k] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=[*names, "n_masked"])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("n_masked", T.LongType())]))


def found(chunks: DataFrame) -> DataFrame:
    """Rows (chunk_id, line_no) of the lines on which a credential, or a part of one, begins."""
    return places(chunks).select(F.col("id").alias("chunk_id"), "line_no").distinct()
