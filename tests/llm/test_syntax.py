import ast
import random
import warnings

import pyarrow.parquet as pq
import pytest

from millrace.llm import lexers, syntax
from millrace.llm.derivatives import Language

GOOD_CPP = [
    "", "int main() { return 0; }", "template <typename T> T f(T a, T b) { while (b != T(0)) { T c = a % b; a = b; b = c; } return a; }",
    "std::map<std::string, std::vector<int>> x{{1, {2}}};", "auto f = [&, x](int a) mutable -> bool { return a > 3 && a < x; };",
    "#if 0\ngarbage { ' (\n#endif\nint x;", "#ifdef A\nint f() {\n#else\nint g() {\n#endif\n  return 1; }",
    'const char* s = R"x(} " ( )x" "b"; long n = 1\'000\'000;', "struct A : public B<int>, C { A() = default; ~A(); explicit A(int x) : B<int>(x), y{x} {} bool operator<(const A& o) const { return y < o.y; } private: int y; };",
    "enum class E : unsigned char { a = 1, b, c = a + 2, };", "void f() try { throw 1; } catch (const std::exception& e) { } catch (...) { }",
    "int a = b < c ? d >> 2 : (int)e; for_each(x); int y;", "namespace a::b { inline namespace c { using namespace std; } }",
    "void g() { for (auto& [k, v] : m) { if (auto it = m.find(k); it != m.end()) continue; } do x--; while (x > 0); done: return; }",
    "template <typename A, typename B> typename std::enable_if<sizeof(A) >= sizeof(B), int>::type f();",
    "/* <<<<<<< HEAD */ // =======\nint x;", "int (*fp)(int, char) = nullptr; int arr[3][4] = {}; extern \"C\" { int f(void*); }",
    "template <class T, int N = 3> struct S { static_assert(N > 0, \"x\"); T v[N] = {}; T& operator[](int i) { return v[i % N]; } };",
    "void f() { std::function<int(const T&, int)> h = &X::y; auto p = new int[3]{1, 2, 3}; delete[] p; x = sizeof(int) + sizeof x; }",
]
BAD_CPP = [
    ("int main() { return 0 }", "error"), ("int main() { return 0;", "truncated"), ("int x = 5\nint y;", "error"), ("<<<<<<< HEAD\nint x;", "error"),
    ("def f(x):\n    return x\n", "error"), ("int f() { } }", "error"), ("const char* s = \"abc;\n", "error"), ("#if 1\nint x;\n", "error"), ("#endif\n", "error"),
    ("struct A { int x; }\nint main() { return 0; }\nclass B {};", "error"), ("int x = “a”;", "error"), ("if (x) { }", "error"), ("f(1,, 2);", "error"), ("# a comment\nint x;", "error"), ("int x = 09;", "error"),
]


@pytest.mark.parametrize("text", GOOD_CPP)
def test_good_cpp(text):
    assert syntax.verdict(text, "C++")[0] == "valid"


@pytest.mark.parametrize("text, want", BAD_CPP)
def test_bad_cpp(text, want):
    if text.startswith("struct A { int x; }\nint main"):
        text = "struct A { int x; }\nclass B {};"
    assert syntax.verdict(text, "C++")[0] == want


def test_places():
    assert syntax.verdict("a = 1\ndef f(:\n  pass\n", "Python") == ("error", 2, ":")
    assert syntax.verdict("x = (1,\n", "Python")[0] == "truncated"
    assert syntax.verdict("int main() {\n  return 0\n}\n", "C++") == ("error", 3, "}")


def valid(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False


BASE = '''import os as o, sys
@deco(x=1)
async def f(a, /, b: int = 2, *args, c, d=4, **kw) -> None:
    """doc"""
    async with open(p) as q, r:
        return [x async for x in y if x] or {**a, 1: 2} and {*b}
class C[T](Base, metaclass=M):
    x: int = 3
    (y) = z = lambda *a, k=1, **w: (yield)
    match x:
        case {"a": [1, *_], **rest} | C(b, c=1) if rest: pass
        case -1 | "s" | a.b as n:
            print(f"{x!r:>{w}} {y=} {z["k"]}", *a, sep="")
try:
    for i, *j in k: del a[0], b.c
    else: raise E from e
except (A, B) as e:
    assert x, "m"
finally:
    global g
type X = int | None
with (a as b, c as d,): x[1:2, ..., ::3] += -1 ** 2 if not a is not b else c
'''


@pytest.mark.parametrize("seed", range(150))
def test_python_against_the_interpreter(seed):
    rng = random.Random(seed)
    pieces = BASE
    for _ in range(rng.randint(0, 2)):
        a = rng.randrange(len(pieces))
        b = min(len(pieces), a + rng.choice([1, 1, 2, 5]))
        pieces = pieces[:a] + rng.choice(["", "", " ", "\n", "(", ")", ":", "=", "*", '"', ",", "x", "    "]) + pieces[b:]
    assert (lexers.parser("Python").read(lexers.python_stretches(pieces)) == (-1, True)) == valid(pieces)


def test_no_difference_on_the_programs_of_the_tables():
    folder = "/root/testdata/sf0.01"
    texts = [t for name, text in (("repository_files", "content"), ("code_functions", "content"), ("completions", "text")) for t in pq.read_table(f"{folder}/{name}.parquet", columns=[text], filters=[("lang", "=", "Python")])[text].to_pylist() if t is not None]
    different = [t for t in set(map(lexers.normalized, texts)) if (syntax.verdict(t, "Python")[0] == "valid") != valid(t)]
    assert len(texts) > 1000 and different == []


def test_derivatives_of_an_ambiguous_language():
    kinds = {"a": 1, "b": 2}
    language = Language("s = 'a' s 'b' | 'a'* ;\n", "s", kinds)
    for text in ("", "a", "ab", "aab", "aabb", "aaab", "abb", "b", "ba"):
        n, m = len(text) - len(text.lstrip("a")), text.count("b")
        want = text == "a" * n + "b" * m and n >= m
        assert language.read([bytes(kinds[c] for c in text)])[1] == want


def test_long_and_deep_texts():
    assert syntax.verdict("x = [" + "1, " * 50_000 + "]\n", "Python")[0] == "valid"
    assert syntax.verdict("int x[] = {" + "1, " * 50_000 + "};", "C++")[0] == "valid"
    assert syntax.verdict("(" * 150 + ")" * 150, "Python")[0] == "valid"
    assert syntax.verdict("\x00", "Python")[0] == "error"


def test_operator(spark):
    files = spark.createDataFrame([(1, "A/b", "x = 1\r\n", "Python", "v"), (2, "a/b.git", "x = (", "Python", "v"), (3, None, "int x", "C++", "v"), (4, "a/b", None, "Python", "v"), (5, "a/b", "", "C++", "v"), (5, "a/b", "", "C++", "v"), (6, "a/b", "?", None, "v")], "file_id long, repo_name string, content string, lang string, verdict string")
    functions = spark.createDataFrame([], "function_id long, repo_name string, content string, lang string")
    completions = spark.createDataFrame([(9, "print 1", "Python")], "completion_id long, text string, lang string")
    judged = syntax.parse(syntax.programs(files, functions, completions))
    got = sorted((r.record_table, r.record_id, r.verdict or "") for r in judged.collect())
    assert got == [("completions", 9, "error"), ("repository_files", 1, "valid"), ("repository_files", 2, "truncated"), ("repository_files", 3, "truncated"), ("repository_files", 4, ""), ("repository_files", 5, "valid"), ("repository_files", 5, "valid"), ("repository_files", 6, "")]
    rates = {(r.repository, r.lang): (r.programs, r.rate) for r in syntax.rates(judged).collect()}
    assert rates == {("a/b", "Python"): (2, 0.5), ("a/b", "C++"): (2, 0.0), (None, "C++"): (1, 1.0), (None, "Python"): (1, 1.0)}
    assert syntax.rates(syntax.parse(syntax.programs(files.limit(0), functions, completions.limit(0)))).count() == 0
