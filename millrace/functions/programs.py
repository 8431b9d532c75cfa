"""Python programs as values: parsing, repair, imports, functions, examples.

Arrow functions give facts about a text; what follows from them (the candidate that is kept, a diagnosis) is said in column
expressions.
"""

from __future__ import annotations

import ast
import re
import tokenize
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def outcome(text: str | None) -> tuple[str | None, int | None, str | None]:
    """(ok, indentation, syntax, value, memory or recursion; line; message); null for a null text."""
    if text is None:
        return None, None, None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return "ok", None, None
    except IndentationError as e:
        return "indentation", e.lineno, e.msg
    except SyntaxError as e:
        return "syntax", e.lineno, e.msg
    except ValueError as e:
        return "value", None, str(e)
    except MemoryError:
        return "memory", None, None
    except RecursionError:
        return "recursion", None, None


@F.pandas_udf(T.StructType([T.StructField("outcome", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("message", T.StringType())]))
def parse_outcome(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([outcome(t) for t in texts], columns=["outcome", "line", "message"]).astype({"line": "Int32"})


# ---- repair

#: Fixed value: what anonymisation left in place of names.
PLACEHOLDER = "<(EMAIL|KEY|NAME|PASSWORD)>"
#: A tab in front of a line leads to the next multiple of this column.
TAB = 8


def bare_names(text: Column) -> Column:
    """Placeholders without their angle brackets: names again."""
    return F.regexp_replace(text, PLACEHOLDER, "$1")


def spaced_lines(text: Column) -> Column:
    """White space in front of a line that holds a tab, as blanks of the same width."""
    def line(x: Column) -> Column:
        lead = F.regexp_extract(x, r"\A[ \t]*", 0)
        width = F.aggregate(F.split(lead, ""), F.lit(0), lambda at, c: at + F.when(c == "\t", TAB - at % TAB).when(c == " ", 1).otherwise(0))
        return F.when(F.contains(lead, F.lit("\t")), F.concat(F.repeat(F.lit(" "), width), F.substr(x, F.length(lead) + 1))).otherwise(x)

    return F.when(F.contains(text, F.lit("\t")), F.array_join(F.transform(F.split(text, "\n"), line), "\n")).otherwise(text)


@F.pandas_udf(T.IntegerType())
def first_valid(candidates: pd.Series) -> pd.Series:
    """The place (from 1) of the first text that parses; null without one. Later ones are not looked at."""
    return candidates.map(lambda texts: next((k for k, t in enumerate(texts, 1) if outcome(t)[0] == "ok"), None) if texts is not None else None).astype("Int32")


def repaired(text: Column) -> Column:
    """The text as it is, or with the fewest repairs that make it parse, placeholders before tabs; null if none do.

    A translation from Python 2 is not among the repairs: no library for it is at hand.
    """
    named = bare_names(text)
    candidates = F.when(text.isNotNull(), F.array_distinct(F.array(text, named, spaced_lines(text), spaced_lines(named))))
    return F.try_element_at(candidates, first_valid(candidates))


# ---- imports

def tree_of(text: str | None) -> ast.Module | None:
    """The syntax tree; null for a text that is null or does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text) if text is not None else None
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None


#: An import on a line of its own, for texts that do not parse.
_IMPORT = re.compile(r"^[ \t]*(?:import[ \t]+(?P<names>[\w., \t]+?)|from[ \t]+(?P<base>\.*[\w.]*)[ \t]+import[ \t]+\(?(?P<from>[\w., \t*]+?)\)?)[ \t]*(?:#.*)?$", re.M)


def imports_of(text: str | None) -> list[tuple[str, str | None]]:
    """(module, name) of every import in order of appearance: the name is null for a whole module, ``*`` for all of one, and
    relative modules keep their dots. A text that does not parse is read line by line."""
    if text is None or "import" not in text:
        return []
    tree = tree_of(text)
    if tree is None:
        found = []
        for m in _IMPORT.finditer(text):
            names = [x.split()[0] for x in (m["names"] or m["from"]).split(",") if x.split()]
            found += [(n, None) for n in names] if m["names"] else [(m["base"], n) for n in names]
        return found
    placed = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            placed += [(node.lineno, (a.name, None)) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            placed += [(node.lineno, ("." * node.level + (node.module or ""), a.name)) for a in node.names]
    return [x for _, x in sorted(placed, key=lambda x: x[0])]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("module", T.StringType()), T.StructField("name", T.StringType())])))
def imports(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"module": m, "name": n} for m, n in imports_of(t)])


def names_from(found: Column, module: str) -> Column:
    """The distinct names that ``imports`` found to come from one module, ascending; all-names marks are none."""
    mine = F.filter(found, lambda x: (x["module"] == module) & x["name"].isNotNull() & (x["name"] != "*"))
    return F.array_sort(F.array_distinct(F.transform(mine, lambda x: x["name"])))


# ---- functions

class _Value(ast.NodeVisitor):
    """Whether a body returns a value itself; what is defined inside it is not its own."""

    def __init__(self) -> None:
        self.found = False

    def visit_Return(self, node: ast.Return) -> None:
        self.found = self.found or node.value is not None

    def _inner(self, node: ast.AST) -> None:
        pass

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = visit_Lambda = _inner


def functions_of(text: str | None) -> list[tuple[str, bool]] | None:
    """(name, whether it returns a value) of the top-level functions in order; null for a text that does not parse."""
    tree = tree_of(text)
    if tree is None:
        return None
    found = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            value = _Value()
            for statement in node.body:
                value.visit(statement)
            found.append((node.name, value.found))
    return found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("returns", T.BooleanType())])))
def functions(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if (found := functions_of(t)) is None else [{"name": n, "returns": r} for n, r in found])


def diagnosis(text: Column, found: Column, entry: Column) -> Column:
    """Of ``functions``: ``unparsed``, ``missing`` entry function, ``returns_nothing``, or ``ok`` for the last one of that name;
    null for a null text. Without an entry name the last function counts."""
    last = F.element_at(F.filter(found, lambda f: entry.isNull() | (f["name"] == entry)), -1)
    named = F.size(F.filter(found, lambda f: entry.isNull() | (f["name"] == entry)))
    return F.when(text.isNull(), None).when(found.isNull(), "unparsed").when(named == 0, "missing").when(last["returns"], "ok").otherwise("returns_nothing")


# ---- examples

def literals(text: str) -> Iterator[str]:
    """The values of the string literals, as far as the text can be cut into tokens."""
    lines = iter(text.splitlines(keepends=True))
    tokens = tokenize.generate_tokens(lambda: next(lines, ""))
    while True:
        try:
            token = next(tokens)
        except (StopIteration, tokenize.TokenError, SyntaxError):
            return
        if token.type == tokenize.STRING:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                try:
                    value = ast.literal_eval(token.string)
                except (SyntaxError, ValueError):
                    continue
            if isinstance(value, str):
                yield value


def sessions(text: str) -> list[tuple[str, str]]:
    """(source, want) of the interactive examples in a text: prompted lines, lines that go on, and what stands below them up
    to a blank line or the next prompt. A text whose lines do not keep to their prompt's indent has none."""
    found: list[tuple[list[str], list[str]]] = []
    indent, part = 0, None  # the part of an example that lines are added to
    for line in text.expandtabs().split("\n"):
        body = line.lstrip(" ")
        if body.startswith(">>>") and body != ">>>" and not body.startswith(">>> ") or part is not None and line.strip() and line[:indent].strip():
            return []
        if body.startswith(">>>"):
            indent = len(line) - len(body)
            found.append(([body[4:]], []))
            part = 0
        elif part == 0 and body.startswith("...") and body[3:4] in ("", " "):
            found[-1][0].append(body[4:])
        elif part is not None and line.strip():
            part = 1
            found[-1][1].append(line[indent:])
        else:
            part = None
    return [("\n".join(s).removesuffix("\n") + "\n", "".join(w + "\n" for w in wanted)) for s, wanted in found if "".join(s).strip() and not "".join(s).lstrip().startswith("#")]


def examples_of(text: str | None) -> list[tuple[str, str]]:
    """The examples in a program's string literals: interactive ones, and lines that are a valid assertion (they want
    nothing)."""
    found = []
    for value in literals(text or ""):
        found += sessions(value)
        stated = [line.strip() for line in value.splitlines()]
        found += [(line, "") for line in stated if line.startswith("assert ") and outcome(line)[0] == "ok"]
    return found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("want", T.StringType())])))
def examples(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"source": s, "want": w} for s, w in examples_of(t)])
