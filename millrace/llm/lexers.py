"""Token kinds of Python and C++ texts, as stretches of single-byte kinds, and positions of tokens when asked for.

A text is cut by one regular expression; the kind of a spelling is looked up once and remembered. Stretches end where
statements usually do, so that equal statements give equal stretches.
"""

from __future__ import annotations

import re

from millrace.llm.grammars import CPP, CPP_KINDS, PYTHON, PYTHON_KINDS

SPELLINGS = 400_000


def normalized(text: str) -> str:
    """Leading U+FEFF dropped; CR LF and CR read as LF."""
    text = text.lstrip("﻿")
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


class Kinds(dict):
    """Spelling to kind, worked out when first asked for."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, spelling: str) -> int:
        if len(self) > SPELLINGS:
            self.clear()
        kind = self[spelling] = self.rule(spelling)
        return kind


# ---- Python

_PREFIX = r"(?:[rR][bB]|[bB][rR]|[bBrRuU])?"
_FPREFIX = r"(?:[fF][rR]?|[rR][fF])"
_LONG3, _LONG1 = r'"""(?:[^\\"]|\\.|"(?!""))*"""', r"'''(?:[^\\']|\\.|'(?!''))*'''"
_SHORT2, _SHORT1 = r'"(?!"")(?:[^\\"\n]|\\.)*"', r"'(?!'')(?:[^\\'\n]|\\.)*'"
_F2 = r'"(?:[^\\"{}\n]|\\.|\{\{|\}\}|\{[^"\'\\{}\n#]*(?:\{[^"\'\\{}\n#]*\}[^"\'\\{}\n#]*)*\})*"(?!")'
_F1 = _F2.replace('"(', "'(", 1).replace('[^\\\\"{}\\n]', "[^\\\\'{}\\n]").replace(')*"(?!")', ")*'(?!')")
_NAME = r"[^\W\d]\w*"
_NUM = r"(?>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*(?:[eE][-+]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*\.?(?:[eE][-+]?[0-9](?:_?[0-9])*)?[jJ]?)(?:(?!\w)|(?=(?:and|else|for|if|in|is|or|not)\b))"
_OPS = r"\*\*=|//=|<<=|>>=|\.\.\.|->|:=|\*\*|//|<<|>>|[-+*/%@&|^=!<>]=|[-+*/%@&|^=<>~.,:;()\[\]{}]"
_NEWLINE = r"(?:#[^\n]*)?\n(?:[ \t\f]*(?:#[^\n]*)?\n)*[ \t\f]*"
_PY = re.compile(rf"(?:[ \t\f]|\\\n)*(?:({_FPREFIX}(?:{_F2}|{_F1})|{_FPREFIX}(?:\"\"\"|'''|\"|')|{_PREFIX}(?:{_LONG3}|{_LONG1}|{_SHORT2}|{_SHORT1})|{_NAME}|{_NUM}|{_OPS}|{_NEWLINE}|#[^\n]*\Z|.)|\Z)", re.S)
_K = PYTHON_KINDS
#: The reserved words of Python.
_RESERVED = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_INTEGER = re.compile(r"0[0-9_]*[1-9][0-9_]*\Z")
_NL, _FIELD, _OPEN, _BLANK = _K["NEWLINE"], "FIELD", 254, 255


def _python_kind(token: str) -> int:
    first = token[0]
    if first == "\n" or first == "#":
        return _NL if "\n" in token else _BLANK
    if token in _K and token.islower() is False and not token.isalpha():
        return _K[token]
    if token in _RESERVED or token in ("match", "case", "type", "_"):
        return _K[token]
    if first in "\"'" or token[-1] in "\"'":
        prefix = token[: min(i for i in (token.find('"'), token.find("'")) if i >= 0)].lower()
        if "f" in prefix:
            body = token[len(prefix) :]
            if body in ('"""', "'''", '"', "'"):
                return _OPEN
            return _K["STRING"] if _fields_hold(token[len(prefix) + 1 : -1]) else _K["ERROR"]
        body = token[len(prefix) :]
        if len(body) < 2 or body[0] != body[-1]:
            return _K["ERROR"]
        if "b" in prefix:
            return _K["BYTES"] if token.isascii() else _K["ERROR"]
        return _K["STRING"] if "r" in prefix or "\\" not in body or _escapes_hold(body) else _K["ERROR"]
    if first.isdigit() or first == "." and len(token) > 1 and token[1].isdigit():
        return _K["ERROR"] if _INTEGER.match(token) else _K["NUMBER"]
    if token.isidentifier():
        return _K["NAME"]
    return _K.get(token, _K["ERROR"]) if not token.isspace() else _K["ERROR"]


_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})?|u([0-9a-fA-F]{4})?|U([0-9a-fA-F]{8})?|N(\{[^}]+\})?|.)", re.S)


def _escapes_hold(body: str) -> bool:
    for m in _ESCAPE.finditer(body):
        if m.group(0)[1] in "xuUN" and not any(m.groups()):
            return False
        if m.group(3) and int(m.group(3), 16) > 0x10FFFF:
            return False
        if m.group(4):
            import unicodedata

            try:
                unicodedata.lookup(m.group(4)[1:-1])
            except KeyError:
                return False
    return True


_CONVERSION = re.compile(r"!\s*[sra]\s*\Z")


def _field_holds(body: str, nested: int = 0) -> bool:
    """Whether the inside of a replacement field is an expression with optional ``=``, conversion and format."""
    depth, at, quote = 0, 0, ""
    expression, rest = body, ""
    while at < len(body):
        c = body[at]
        if quote:
            if c == "\\":
                at += 1
            elif body.startswith(quote, at):
                at += len(quote) - 1
                quote = ""
        elif c in "\"'":
            quote = c * 3 if body.startswith(c * 3, at) else c
            at += len(quote) - 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0 and (c == ":" or c == "!" and body[at + 1 : at + 2] != "="):
            expression, rest = body[:at], body[at:]
            break
        at += 1
    if rest.startswith("!"):
        conversion, colon, format_ = rest.partition(":")
        if not _CONVERSION.match(conversion):
            return False
        rest = colon + format_
    if rest and nested < 3 and not _fields_hold(rest[1:], nested + 1, in_format=True):
        return False
    return bool(expression.strip()) and python_expression_holds(expression)


def _fields_hold(body: str, nested: int = 0, in_format: bool = False) -> bool:
    at, n = 0, len(body)
    while at < n:
        c = body[at]
        if c == "\\" and not in_format and at + 1 < n and body[at + 1] == "N" and body[at + 2 : at + 3] == "{":
            at = body.find("}", at)
            if at < 0:
                return False
        elif c == "{":
            if body[at + 1 : at + 2] == "{" and not in_format:
                at += 2
                continue
            end = _field_end(body, at + 1)
            if end < 0 or not _field_holds(body[at + 1 : end], nested):
                return False
            at = end
        elif c == "}":
            if body[at + 1 : at + 2] != "}" or in_format:
                return False
            at += 1
        at += 1
    return True


def _field_end(body: str, at: int) -> int:
    """The brace that closes a replacement field opened before ``at``, or -1."""
    depth, in_format = 0, False
    while at < len(body):
        c = body[at]
        if c == ":" and depth == 0:
            in_format = True
        elif c in "\"'" and not (in_format and depth == 0):
            quote = c * 3 if body.startswith(c * 3, at) else c
            at += len(quote)
            while at < len(body) and not body.startswith(quote, at):
                at += 2 if body[at] == "\\" else 1
            if at >= len(body):
                return -1
            at += len(quote) - 1
        elif c == "{" or c in "([" and not (in_format and depth == 0):
            depth += 1
        elif c in ")]" and not (in_format and depth == 0):
            depth -= 1
        elif c == "}":
            if depth == 0:
                return at
            depth -= 1
        at += 1
    return -1


def _fstring_end(text: str, at: int, quote: str) -> int:
    """The position after the f-string whose text starts at ``at``, or -1."""
    while at < len(text):
        if text.startswith(quote, at):
            return at + len(quote)
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "\n" and len(quote) == 1:
            return -1
        elif c == "{":
            if text[at + 1 : at + 2] == "{":
                at += 2
                continue
            end = _field_end(text, at + 1)
            if end < 0:
                return -1
            at = end + 1
        else:
            at += 1
    return -1


PY_KINDS = Kinds(_python_kind)
_SHUT = bytes(_K[c] for c in ")]}")
_OPENING = bytes(_K[c] for c in "([{")
_NET: dict[bytes, int] = {}


def _net(stretch: bytes) -> int:
    """Brackets opened less brackets closed."""
    found = _NET.get(stretch)
    if found is None:
        if len(_NET) > SPELLINGS:
            _NET.clear()
        found = _NET[stretch] = sum(map(stretch.count, _OPENING)) - sum(map(stretch.count, _SHUT))
    return found


def _python_tokens(text: str) -> list[str]:
    tokens = [t for t in _PY.findall(text) if t]
    return [t for t, _ in _placed(text)] if _OPEN in set(map(PY_KINDS.__getitem__, tokens)) else tokens


def _placed(text: str) -> list[tuple[str, int]]:
    """The tokens of a Python text with their positions; an f-string with inner quotes or braces becomes ``""``, or an
    error if its fields do not hold."""
    tokens, at = [], 0
    while at < len(text):
        m = _PY.match(text, at)
        token, start, at = m.group(1), m.start(1), m.end()
        if token and PY_KINDS[token] == _OPEN:
            quote = token.lstrip("fFrR")
            end = _fstring_end(text, at, quote)
            good = end > 0 and _fields_hold(text[at : end - len(quote)])
            token, at = ('""' if good else "\x00"), end if end > 0 else len(text)
        if token:
            tokens.append((token, start))
    return tokens


def python_place(text: str, number: int) -> tuple[int, str]:
    """(line, spelling) of the ``number``-th kind of the text's stretches."""
    kinds = b"".join(python_stretches(text))
    tokens = [(t, at) for t, at in _placed("\n" + text + "\n") if PY_KINDS[t] != _BLANK]
    at = 0
    for kind in kinds[:number]:
        if kind in (_INDENT[0], _DEDENT[0]):
            continue
        found = next((k for k in range(at, len(tokens)) if PY_KINDS[tokens[k][0]] == kind), None)
        at = at if found is None else found + 1
    while at < len(tokens) - 1 and PY_KINDS[tokens[at][0]] == _NL and kinds[number : number + 1] != _LINE:
        at += 1
    token, start = tokens[min(at, len(tokens) - 1)] if tokens else ("", 0)
    return ("\n" + text).count("\n", 0, start + (token[:1] == "\n")), token.strip()[:40]


def _columns(blank: str) -> tuple[int, int]:
    """Indentation with tabs to multiples of eight, and with tabs as one."""
    column = alternative = 0
    for c in blank:
        if c == "\t":
            column, alternative = (column // 8 + 1) * 8, alternative + 1
        elif c == "\f":
            column = alternative = 0
        else:
            column, alternative = column + 1, alternative + 1
    return column, alternative


_INDENT, _DEDENT, _ERROR, _LINE = bytes([_K["INDENT"]]), bytes([_K["DEDENT"]]), bytes([_K["ERROR"]]), bytes([_NL])


def python_stretches(text: str) -> list[bytes]:
    """The logical lines of a Python text (normalized), each ending in NEWLINE, with INDENT and DEDENT between them."""
    if "\x00" in text:
        return [_ERROR]
    tokens = _python_tokens("\n" + text + ("" if text.endswith("\n") else "\n"))
    if text.rstrip("\n").endswith("\\") and tokens[-1][0] != "#":
        tokens.append("\x00")  # a continued line without a line to follow
    kinds = bytes(map(PY_KINDS.__getitem__, tokens)).replace(bytes([_BLANK]), b"")
    breaks = [t for t in tokens if t[0] in "\n#"]
    out: list[bytes] = []
    stack = [(0, 0)]
    waiting, depth = b"", 0
    for line, before in zip(kinds.split(_LINE)[1:], breaks):
        if depth <= 0:
            if not line:
                continue
            blank = before[before.rfind("\n") + 1 :]
            if blank:
                column, alternative = _columns(blank) if "\t" in blank or "\f" in blank else (len(blank), len(blank))
            else:
                column = alternative = 0
            top, top_alternative = stack[-1]
            if column == top:
                if alternative != top_alternative:
                    out.append(_ERROR)
            elif column > top:
                if alternative <= top_alternative:
                    out.append(_ERROR)
                stack.append((column, alternative))
                out.append(_INDENT if len(stack) <= 100 else _ERROR)
            else:
                while column < stack[-1][0]:
                    stack.pop()
                    out.append(_DEDENT)
                if (column, alternative) != stack[-1]:
                    out.append(_ERROR)
        waiting = waiting + line if waiting else line
        depth += _net(line)
        if depth <= 0:
            out.append(waiting + _LINE)
            waiting, depth = b"", 0
    if waiting:
        out.append(waiting)
    else:
        out.extend([_DEDENT] * (len(stack) - 1))
    return out


_PARSERS: dict = {}


def parser(language: str):
    """The worker's own derivative parser of Python, a replacement field, or C++."""
    from millrace.llm.derivatives import Language

    if language not in _PARSERS:
        _PARSERS[language] = Language(CPP, "file", CPP_KINDS) if language == "C++" else Language(PYTHON, "file" if language == "Python" else "field", PYTHON_KINDS)
    return _PARSERS[language]


def python_expression_holds(body: str) -> bool:
    tokens = [t for t in _python_tokens(body) if t[0] not in "\n#"]
    kinds = bytes(map(PY_KINDS.__getitem__, tokens)).replace(bytes([_BLANK]), b"")
    return parser(_FIELD).read([kinds]) == (-1, True)


# ---- C++

_C = CPP_KINDS
_CPP_SKIP = r"(?:[ \t\f\v]+|\\\n|\n(?![ \t]*\#)|//(?:[^\n\\]|\\.)*|/\*(?:[^*]|\*(?!/))*\*/)*"
_DIRECTIVE = r"\n[ \t]*\#(?:[^\n\\/]|\\.|/\*(?:[^*]|\*(?!/))*\*/|//(?:[^\n\\]|\\.)*|/)*"
_CPP = re.compile(rf"""{_CPP_SKIP}(?:({_DIRECTIVE}
|(?:u8|[uUL])?R"(?P<d>[^()\\\s"]{{0,16}})\((?:.*?)\)(?P=d)"(?:[^\W\d]\w*)?
|(?:u8|[uUL])?"(?:[^\\"\n]|\\.)*"(?:[^\W\d]\w*)?
|(?:u8|[uUL])?'(?:[^\\'\n]|\\.)+'(?:[^\W\d]\w*)?
|(?:[^\W\d]|\$)[\w$]*
|\.?\d(?:'?[\w.]|(?<=[eEpP])[-+])*
|\.\.\.|->\*|->|<<=|<=>|::|\.\*|\+\+|--|&&|\|\||<<|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>~?:;.,(){{}}\[\]]
|.)|\Z)""", re.S | re.X)
_CPP_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F]+(?:'[0-9a-fA-F]+)*(?:\.[0-9a-fA-F]*)?(?:[pP][-+]?\d+)?|0[bB][01]+(?:'[01]+)*|\d+(?:'\d+)*(?:\.(?:\d+(?:'\d+)*)?)?(?:[eE][-+]?\d+)?|\.\d+(?:'\d+)*(?:[eE][-+]?\d+)?)(?:[uUlLfF]{1,3}|_\w+|h|min|s|ms|us|ns|if|il|i|d|y)?\Z")
_OCTAL = re.compile(r"0[0-7']*[89][0-9']*(?:[uUlL]*)\Z")
#: Reserved words of C++17 the grammar spells out, and alternative spellings of operators.
_ALIKE = {"not": "!", "compl": "~", "and": "&&", "bitand": "&"}
_DIRECTIVES = frozenset("define undef include include_next import ident if ifdef ifndef elif elifdef elifndef else endif error warning pragma line".split())
_DIRECTIVE_KIND = 253


def _cpp_kind(token: str) -> int:
    first = token[0]
    if first == "\n":
        return _DIRECTIVE_KIND
    if token in _ALIKE:
        return _C[_ALIKE[token]]
    if token in ("override", "final"):
        return _C["FINAL"]
    if (token.isidentifier() or "$" in token) and not token.isupper() and token in _C:
        return _C[token]
    if first.isdigit() or first == "." and len(token) > 1 and token[1].isdigit():
        return _C["NUMBER"] if _CPP_NUMBER.match(token) and not _OCTAL.match(token) else _C["ERROR"]
    if len(token) > 1 and '"' in token:
        return _C["STRING"]
    if len(token) > 2 and "'" in token:
        return _C["CHAR"]
    if token.replace("$", "_").isidentifier():
        return _C["ID"]
    return _C.get(token, _C["ERROR"]) if not token.isalnum() else _C["ERROR"]


CPP_KIND = Kinds(_cpp_kind)
_CPP_CUT = re.compile(b"[^%b]*[%b]?" % ((re.escape(bytes([_C[";"], _C["{"], _C["}"]])),) * 2), re.S)
_CERROR = bytes([_C["ERROR"]])
_FALSE = re.compile(r"(?:0|false|\(\s*0\s*\))\Z")


def _directive(token: str) -> tuple[str, str]:
    body = token.lstrip().lstrip("#").strip()
    word = re.match(r"\w*", body).group(0)
    return word, body[len(word) :].strip()


def _kept(tokens: list[str], kinds: bytes, last_branch: bool) -> list[tuple[int, int]]:
    """The ranges of tokens that are read; (k, -1) stands for an error at token k."""
    mark = bytes([_DIRECTIVE_KIND])
    if mark not in kinds:
        return [(0, len(kinds))]
    at = [i for i, kind in enumerate(kinds) if kind == _DIRECTIVE_KIND]
    directives = [_directive(tokens[i]) for i in at]
    last = _last_branches(directives) if last_branch else {}
    ranges, groups = [(0, at[0])], []
    for number, (word, rest) in enumerate(directives):
        bad = bool(rest if not word else word not in _DIRECTIVES)
        if word in ("if", "ifdef", "ifndef"):
            false = word == "if" and bool(_FALSE.match(rest.split("//")[0].strip()))
            taken = not false if number not in last else last[number] == number
            groups.append([taken, taken, False, number])
            bad = not rest
        elif word in ("elif", "else", "elifdef", "elifndef"):
            if not groups or groups[-1][2]:
                bad = True
            else:
                group = groups[-1]
                group[2] = word == "else"
                if group[3] in last:
                    group[1] = last[group[3]] == number
                else:
                    group[1] = not group[0] and not (word == "elif" and _FALSE.match(rest))
                group[0] = group[0] or group[1]
        elif word == "endif":
            if groups:
                groups.pop()
            else:
                bad = True
        active = all(g[1] for g in groups)
        if bad and (active or word in ("if", "elif", "else", "endif")):
            ranges.append((at[number], -1))
        if active:
            ranges.append((at[number] + 1, at[number + 1] if number + 1 < len(at) else len(kinds)))
    if groups:
        ranges.append((len(kinds), -1))
    return [r for r in ranges if r[0] != r[1]]


def cpp_stretches(text: str, last_branch: bool = False) -> list[bytes]:
    """The statements of a C++ text (normalized), cut after ``;``, ``{`` and ``}``. Of each conditional group the first
    branch is read that is not plainly false, or, if asked for, the last one."""
    tokens = [t[0] for t in _CPP.findall("\n" + text) if t[0]]
    kinds = bytes(map(CPP_KIND.__getitem__, tokens))
    ranges = _kept(tokens, kinds, last_branch)
    if len(ranges) != 1 or ranges[0] != (0, len(kinds)):
        kinds = b"".join(kinds[a:b] if b >= 0 else _CERROR for a, b in ranges)
    return [s for s in _CPP_CUT.findall(kinds) if s]


def cpp_place(text: str, number: int) -> tuple[int, str]:
    """(line, spelling) of the ``number``-th kind of the text's stretches."""
    placed = [(m.group(1), m.start(1)) for m in _CPP.finditer("\n" + text) if m.group(1)]
    tokens = [t for t, _ in placed]
    for a, b in _kept(tokens, bytes(map(CPP_KIND.__getitem__, tokens)), False):
        length = b - a if b >= 0 else 1
        if number < length:
            token, start = placed[min(a + number, len(placed) - 1)] if placed else ("", 0)
            return ("\n" + text).count("\n", 0, start + (token[:1] == "\n")), token.strip()[:40]
        number -= length
    return text.count("\n") + 1, ""


def _last_branches(directives: list[tuple[str, str]]) -> dict[int, int]:
    """For each conditional group, by its first directive, the directive of its last branch."""
    last, stack = {}, []
    for number, (word, _) in enumerate(directives):
        if word in ("if", "ifdef", "ifndef"):
            stack.append(number)
            last[number] = number
        elif word in ("elif", "else", "elifdef", "elifndef") and stack:
            last[stack[-1]] = number
        elif word == "endif" and stack:
            stack.pop()
    return last
