"""Import graphs of repositories: edges between files, dependency order, samples."""

from __future__ import annotations

import heapq
import posixpath
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.programs import imports_of
from millrace.operators.components import connected_components
from millrace.operators.ranking import global_rank
from millrace.session import cut, spread

_INCLUDE = re.compile(r'(?m)^[ \t]*#[ \t]*include(?:_next)?[ \t]*(?:"([^"\n]+)"|<([^>\n]+)>)')


def python_keys(path: str, module: str, name: str | None) -> list[str]:
    """Keys of all files that an import may mean: the module, or its package, and the name as a module or package in it.
    Absolute modules are path ends; relative ones stand at exact places above the file."""
    level = len(module) - len(module.lstrip("."))
    parts, inner = [p for p in module[level:].split(".") if p], [name] if name and name != "*" else []
    if not level:
        stem = "/".join(parts)
        return [f"~{x}" for at in ([stem] + [f"{stem}/{n}" for n in inner]) for x in (f"{at}.py", f"{at}/__init__.py")]
    above = path.split("/")[:-1]
    if level - 1 > len(above):
        return []
    target = above[: len(above) - level + 1] + parts
    whole = "/".join(target)
    found = [f"{whole}.py"] if parts else []
    found.append("/".join([*target, "__init__.py"]))
    for n in inner:
        found += ["/".join([*target, f"{n}.py"]), "/".join([*target, n, "__init__.py"])]
    return [f"={x}" for x in found]


def cleaned(path: str) -> str | None:
    """The path without dots, if it stays inside the repository."""
    path = posixpath.normpath(path)
    return None if path.split("/")[0] in ("..", "") else path


def candidates(path: str, text: str, language: str) -> list[list[str]]:
    """Keys of each thing a file asks for, best first: ``=`` and a whole path, or ``~`` and a path's end. A Python import asks
    for every file it may mean; a quoted C++ include for the file beside, and only without one, like any other include, for
    files that end with it."""
    if language == "C++":
        found = []
        for quoted, angled in _INCLUDE.findall(text):
            near = cleaned(posixpath.join(posixpath.dirname(path), quoted)) if quoted else None
            end = cleaned(quoted or angled)
            keys = ([f"={near}"] if near else []) + ([f"~{end}"] if end else [])
            if keys:
                found.append(keys)
        return found
    return [[key] for key in dict.fromkeys(k for module, name in imports_of(text) for k in python_keys(path, module, name))]


def edges(paths: list[str], texts: list[str], language: str) -> list[tuple[int, int]]:
    """(file, file it imports) by position, without self edges; all of one repository at once."""
    index: dict[str, list[int]] = {}
    for i, path in enumerate(paths):
        parts = path.split("/")
        for key in (f"={path}", *("~" + "/".join(parts[k:]) for k in range(len(parts)))):
            index.setdefault(key, []).append(i)
    found = set()
    for i, (path, text) in enumerate(zip(paths, texts)):
        for keys in candidates(path, text, language):
            found.update((i, j) for j in next((index[k] for k in keys if k in index), ()) if i != j)
    return sorted(found)


def strong_parts(n: int, after: Callable[[int], Iterable[int]]) -> Iterator[list[int]]:
    """Strongly connected parts, their members ascending, those they depend on first. ``after`` gives a file's imports
    ascending; it is asked once for each file, repeats and the file itself change nothing."""
    # found depth first without recursion
    number, low, on, stack = [-1] * n, [0] * n, [False] * n, []
    count = 0
    for start in range(n):
        if number[start] >= 0:
            continue
        work = [(start, iter(after(start)))]
        number[start] = low[start] = count
        count += 1
        stack.append(start)
        on[start] = True
        while work:
            v, successors = work[-1]
            for w in successors:
                if number[w] < 0:
                    number[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, iter(after(w))))
                    break
                if on[w]:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on[w] = False
                        part.append(w)
                        if w == v:
                            break
                    yield sorted(part)


def dependency_order(n: int, links: list[tuple[int, int]]) -> list[list[int]]:
    """Weakly connected groups, by least member; in each, files after those they import, a cycle's members ascending."""
    after: list[list[int]] = [[] for _ in range(n)]
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        after[a].append(b)
        parent[max(root(a), root(b))] = min(root(a), root(b))
    groups: dict[int, list[int]] = {}
    for part in strong_parts(n, lambda v: sorted(after[v])):
        groups.setdefault(root(part[0]), []).extend(part)
    return [groups[r] for r in sorted(groups)]


WANTS = T.ArrayType(T.StructType([T.StructField("item", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("key", T.StringType())]))


@F.pandas_udf(WANTS)
def wants(paths: pd.Series, texts: pd.Series, langs: pd.Series) -> pd.Series:
    return pd.Series([[{"item": i, "rank": k, "key": key} for i, keys in enumerate(candidates(*x)) for k, key in enumerate(keys)] for x in zip(paths, texts, langs)])


def _keys(path: Column) -> Column:
    """The keys a file answers to: its whole path and every end of it."""
    parts = F.split(path, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("~"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    return F.concat(F.array(F.concat(F.lit("="), path)), ends)


PLACED = "repo string, lang string, file_id long, least string, least_id long, position int, imports int"


def _place(files: list[tuple]) -> list[tuple]:
    """Rows of PLACED of one sample's (repo, lang, file_id, relative_path, uses, answers)."""
    files = sorted(files, key=lambda f: (f[3], f[2]))
    members: dict[str, list[int]] = {}
    for i, f in enumerate(files):
        for key in f[5]:
            members.setdefault(key, []).append(i)
    # a name that many files use and many answer to stays two lists, never their product
    after = [[members[k] for k in f[4]] for f in files]
    least, at = (files[0][3], files[0][2]), 0
    out = []
    for part in strong_parts(len(files), lambda v: heapq.merge(*after[v])):
        for i in part:
            imports = len(set().union(*after[i]) - {i})
            out.append((*files[i][:3], *least, at, imports))
            at += 1
    return out


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by component; holds one sample at a time, and its names and paths only."""
    at, files, done = None, [], []
    for batch in batches:
        for component, *row in batch.itertuples(index=False, name=None):
            if component != at and files:
                done += _place(files)
                files = []
            at = component
            files.append(tuple(row))
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in PLACED.split(", ")])
            done = []
    if files:
        yield pd.DataFrame(_place(files), columns=[c.split()[0] for c in PLACED.split(", ")])


def samples(files: DataFrame, first: tuple[str, ...] = ("file_id",), one_per_path: bool = True) -> DataFrame:
    """(repo, lang, file_id, sample, position, imports) of rows (repo, lang, file_id, relative_path, content).

    A sample is a weakly connected group of a repository's files of one language, in dependency order; samples are
    numbered by their least path. Of one path the first row by ``first`` counts, or with ``one_per_path`` false every row;
    null paths and texts are left out. file_id is unique.

    Imports are resolved over the whole repository, whatever its size: the keys they ask for are joined with the keys
    files answer to, a key's files hang on the least of them (so links are as many as names, not as pairs of files),
    samples are the components of these links, and one task orders one sample from its paths and keys, without texts.
    """
    whole = spread(files.where("relative_path is not null and content is not null"))
    asking = whole.select("repo", "lang", "relative_path", "file_id", F.struct(*first).alias("first"), wants("relative_path", "content", "lang").alias("wants"))
    if one_per_path:
        asking = asking.groupBy("repo", "lang", "relative_path").agg(F.min_by(F.struct("file_id", "wants"), "first").alias("f")).select("repo", "lang", "relative_path", "f.file_id", "f.wants")
    base = cut(asking.select("repo", "lang", "relative_path", "file_id", "wants"))
    key = ["repo", "lang", "key"]
    asked = base.select("repo", "lang", "file_id", F.explode("wants").alias("w")).select("repo", "lang", "file_id", "w.item", "w.rank", "w.key")
    members = cut(base.select("repo", "lang", "file_id", F.explode(_keys(F.col("relative_path"))).alias("key")).join(asked.select(*key).distinct(), key, "left_semi"))
    heads = members.groupBy(*key).agg(F.min("file_id").alias("head"))
    best = asked.join(heads, key).groupBy("file_id", "item", "repo", "lang").agg(F.min_by(F.struct("key", "head"), "rank").alias("b"))
    used = cut(best.select("repo", "lang", "file_id", "b.key", "b.head").distinct())
    answering = members.join(used.select(*key, "head").distinct(), key)
    components = connected_components(used.select("file_id", "head").unionByName(answering.select("file_id", "head")), "file_id", "head")
    names = used.select("file_id", F.col("key").alias("use"), F.lit(None).cast("string").alias("answer")).unionByName(answering.select("file_id", F.lit(None).cast("string").alias("use"), F.col("key").alias("answer")))
    linked = components.withColumnRenamed("node", "file_id").join(names.groupBy("file_id").agg(F.collect_set("use").alias("uses"), F.collect_set("answer").alias("answers")), "file_id")
    rows = base.drop("wants").join(linked, "file_id", "left")
    alone = rows.where("component is null").select("repo", "lang", "file_id", F.col("relative_path").alias("least"), F.col("file_id").alias("least_id"), F.lit(0).alias("position"), F.lit(0).alias("imports"))
    together = rows.where("component is not null").select("component", "repo", "lang", "file_id", "relative_path", "uses", "answers").repartition("component").sortWithinPartitions("component").mapInPandas(_placed, PLACED)
    ranked = global_rank(alone.unionByName(together).withColumn("first", F.when(F.col("position") == 0, 1).otherwise(0)), ["repo", "lang", "least", "least_id", "position"], weight="first")
    begin = ranked.groupBy(F.col("repo").alias("_repo"), F.col("lang").alias("_lang")).agg(F.min("running").alias("begin"))
    numbered = ranked.join(begin, (F.col("repo") == F.col("_repo")) & (F.col("lang") == F.col("_lang")))
    return numbered.select("repo", "lang", "file_id", (F.col("running") - F.col("begin")).cast("int").alias("sample"), "position", "imports")


def document_parts(placed: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, part, file_id, start, text): a document for each value of ``by`` (leading columns of repo, lang, sample) as
    its files' texts in the order of ``placed`` (samples); joined by part they are the document, ``start`` is the
    character where a part begins. ``texts`` has (file_id, text). No task holds a document: offsets come from lengths,
    and each text is moved once.
    """
    sized = placed.select("repo", "lang", "sample", "position", "file_id").join(texts.select("file_id", F.length("text").cast("long").alias("n")), "file_id")
    ranked = global_rank(sized, ["repo", "lang", "sample", "position"], weight="n")
    begin = ranked.groupBy(*by).agg(F.min("rank").alias("_rank"), F.min(F.col("running") - F.col("n")).alias("_start"))
    parts = ranked.join(begin, by).select(*by, (F.col("rank") - F.col("_rank")).cast("int").alias("part"), "file_id", (F.col("running") - F.col("n") - F.col("_start")).alias("start"))
    return parts.join(texts.select("file_id", "text"), "file_id").select(*by, "part", "file_id", "start", "text")
