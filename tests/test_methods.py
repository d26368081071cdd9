"""M1-M5 on hand-written C# files; S3 reading keeps BOM and CR."""

import os
import re

from pyspark.sql import functions as F

from vulnscan.operators import directives as D
from vulnscan.operators import methods as M
from vulnscan.sources import io as S

DATA = os.path.join(os.path.dirname(__file__), "data")


def _names(spark, code):
    files = spark.createDataFrame([(1, code)], "doc_id bigint, code string")
    out = M.extract_methods(files).orderBy("method_idx").collect()
    return [r.name for r in out]


def test_four_methods_in_document_order(spark):
    code = open(os.path.join(DATA, "four_methods.cs"), encoding="utf-8", newline="").read()
    assert "\r\n" in code
    assert _names(spark, code) == ["Bad", "GoodG2B1", "GoodG2B2", "Good"]


def test_bare_block_with_bom_has_no_method(spark):
    code = open(os.path.join(DATA, "bare_block.cs"), encoding="utf-8", newline="").read()
    assert code.startswith("﻿")
    assert _names(spark, code) == []


CASES = [
    ("", []),
    ("class C { // ü\n string ü = \"é\"; int F(int a) { return a; } }", ["F"]),
    ("abstract class A { public abstract int M1(int x); public int M2() => 42; }", ["M1", "M2"]),
    ("class C { void Outer() { int Inner(int y) { return y; } Inner(1); } }", ["Outer"]),
    ('class C { void M() { var s = "{"; var c = \'}\'; } }', ["M"]),
    ("class C { public C(int k) { this.k = k; } int P { get { return 1; } } }", []),
    ("class V { public static V operator +(V a, V b) { return a; } }", []),
    ("class G { public List<int> Items<T>(T x) where T : class { return null; } }", ["Items"]),
    ("class D { [Obsolete] internal static async Task<int> Run() { return 1; } }", ["Run"]),
    ("class C { void M() { if (x) { y(); }", []),
    ("class C { void M() { } } } }", ["M"]),
    ("class C { IEnumerator<T> IEnumerable<T>.GetEnumerator() { return null; } }", ["GetEnumerator"]),
    ("class C { Task<(int a, int b)> Run() { return null; } void N() { } }", ["Run", "N"]),
    ("class C { int F(int x) => x switch { 0 => 1, _ => 2 }; int G() { return 1; } }", ["F", "G"]),
    ("class C { Foo F() => new Foo { A = 1 }; void G() { } }", ["F", "G"]),
    ('class C { [HttpGet("[action]/{id}")] public int Get(int id) { return id; } }', ["Get"]),
    ("class C { [InlineData(new[] { 1, 2 })] public void T(int[] a) { } }", ["T"]),
    ("class C { Dictionary<K, V>.Enumerator GetE() { return e; } }", ["GetE"]),
    ("class C { unsafe byte* P(byte* a) { return a; } }", ["P"]),
    ('class C { void M(string s = ")") { } void N() { } }', ["M", "N"]),
    ("class C { global::System.Int32 M() { return 1; } }", ["M"]),
    ('class C { void M() { var t = $"{(x ? "{" : "b")}"; } void N() { } }', ["M", "N"]),
    ("class C { public C() { int Local(int y) { return y; } } void M() { } }", ["M"]),
    ("int Top(int x) { return x; } class C { void M() { } }", ["M"]),
    ("interface I { void A(); int B(int x); } struct S { int C() => 1; } record R(int X) { int D() { return X; } }", ["A", "B", "C", "D"]),
    ("enum E { A = F(1), B } namespace N { class C { (int, int)? Pair((int, int) p) { return p; } } }", ["Pair"]),
    ("class C { Dictionary<string, List<(int, Foo<Bar>)>> Deep() { return null; } }", ["Deep"]),
    ("class C { " + "A<" * 50 + "int" + ">" * 50 + " Deep() { return null; } }", ["Deep"]),
    ("class C { List<" + "(" * 40 + "int, int" + ", int)" * 40 + "> Tup(Dictionary<" + "List<" * 30 + "int" + ">" * 30 + ", (int, (int, int))> x) { } }", ["Tup"]),
    ("public file class A { void M() { } }", ["M"]),
    ("class C { bool Cmp(int a = 1 << 2, [In] int b = 3) { return a > b; } void N() { } }", ["Cmp", "N"]),
    ("class C { Func<int, int> f = x => { return x; }; int[] a = { 1, 2 }; void N() { } }", ["N"]),
    ("class C { public C(int x) : base(x) { } ~C() { } void N() { } }", ["N"]),
    ("class C { bool operator <(C a, C b) { return true; } bool operator >(C a, C b) => false; public static implicit operator int(C c) => 1; void N() { } }", ["N"]),
    ('class C { [A([B(1)], "]")] [C] void M() => x(y => z); }', ["M"]),
    ("class C { int this[int i] { get { return 1; } } int P => 3; event Action E; void N() { } }", ["N"]),
    ("class C { void M() { } } } class D { void N() { } }", ["M", "N"]),
]


def test_method_cases(spark):
    """All cases in one DataFrame: one file per case."""
    files = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "doc_id bigint, code string")
    got = {i: [] for i in range(len(CASES))}
    for r in M.extract_methods(files).orderBy("doc_id", "method_idx").collect():
        got[r.doc_id].append(r.name)
    assert got == {i: e for i, (_, e) in enumerate(CASES)}


def test_literal_safe_keeps_comment_marks_in_literals(spark):
    code = 'class C { void M() {\n var u = "http://x"; } void N() {\n } // } \n }'
    files = spark.createDataFrame([(1, code)], "doc_id bigint, code string")
    assert [r.name for r in M.extract_methods(files, literal_safe=True).orderBy("method_idx").collect()] == ["M", "N"]


def test_long_literals_in_files_do_not_recurse(spark):
    escapes, doubled = "\\\\u0041" * 1_000_000, '""k"": 1, ' * 100_000
    code = f'class C {{ void M() {{ var a = "{escapes}"; var b = @"{doubled}"; Call({"F(1), " * 20000}0); }} int N() {{ return 1; }} }}'
    files = spark.createDataFrame([(1, code)], "doc_id bigint, code string")
    assert [r.name for r in M.extract_methods(files).orderBy("method_idx").collect()] == ["M", "N"]


def test_method_text_gets_line_delimiters(spark):
    files = spark.createDataFrame([(1, "class C { int F() { a(); return 1; } }")], "doc_id bigint, code string")
    m = M.extract_methods(files).first()
    assert m.method == "int F() \n{\n a();\n return 1;\n }\n"


def test_offsets_are_characters(spark):
    code = "class ü { int F() { return 1; } }"
    files = spark.createDataFrame([(1, code)], "doc_id bigint, code string")
    m = M.extract_methods(files).first()
    assert code[m.start_pos : m.end_pos + 1] == "int F() { return 1; }"


def test_brace_pairs_and_counts(spark):
    files = spark.createDataFrame(
        [(1, "class C { void M() { if (a) { } } }"), (2, "{ x; }"), (3, "")], "doc_id bigint, code string"
    )
    pairs = M.brace_pairs(files).filter("doc_id = 1").orderBy("open_pos").collect()
    assert [(p.level, p.open_pos, p.close_pos) for p in pairs] == [(1, 8, 34), (2, 19, 32), (3, 28, 30)]
    counts = {r.doc_id: r.n_methods for r in M.methods_per_file(files, M.extract_methods(files)).collect()}
    assert counts == {1: 1, 2: 0, 3: 0}


def test_read_code_files_keeps_bom_and_cr(spark):
    df = S.read_code_files(spark, DATA).withColumn("name", F.element_at(F.split("path", "/"), -1))
    got = {r.name: r.code for r in df.collect()}
    assert got["bare_block.cs"].startswith("﻿{\r\n")
    assert got["four_methods.cs"].count("\r\n") > 40


def _stack_pairs(code):
    """Independent model: brace pairs by a stack, braces inside (...) ignored."""
    pairs, stack, paren = [], [], 0
    for i, ch in enumerate(code):
        if ch == "(":
            paren += 1
        elif ch == ")":
            paren -= 1
        elif paren <= 0 and ch == "{":
            stack.append(i)
        elif paren <= 0 and ch == "}":
            pairs.append((len(stack), stack.pop(), i))
    return sorted(pairs, key=lambda p: p[1])


def test_brace_pairs_match_stack_model(spark):
    import random

    rnd = random.Random(3)
    codes = ["x{(a{b)}x", "x{ f(a}) }x"]
    while len(codes) < 300:
        depth, paren, out = 0, 0, []
        for _ in range(rnd.randint(1, 40)):
            c = rnd.choice("{{}}a;()x")
            if (c in "{}" and paren > 0) or (c == "}" and depth == 0) or (c == ")" and paren == 0):
                c = "a"
            depth += {"{": 1, "}": -1}.get(c, 0)
            paren += {"(": 1, ")": -1}.get(c, 0)
            out.append(c)
        codes.append("x" + "".join(out) + ")" * paren + "}" * depth + "x")
    files = spark.createDataFrame(list(enumerate(codes)), "doc_id bigint, code string")
    got = {i: [] for i in range(len(codes))}
    for r in M.brace_pairs(files).orderBy("doc_id", "open_pos").collect():
        got[r.doc_id].append((r.level, r.open_pos, r.close_pos))
    assert got == {i: _stack_pairs(c) for i, c in enumerate(codes)}


CONDITIONS = ["A", "!A", "A && B", "A || !B", "(A == true) && !(B || C)", "A != B", "!(A) == B", "true && false || A", "A || B && C", "!!A", "((((B))))||A",
              "A &&", "A B", "", "A && B || C == A", "!(A && (B || !C))", "(A || B) && (C || A)", "!" * 60 + "A", "(" * 40 + "A" + ")" * 40, "&&".join("A" * 50)]


def _truth(condition, symbols):
    e = re.sub(r"\b[A-Za-z]+\b", lambda m: str(m[0] in symbols or m[0] == "true"), condition).replace("&&", " and ").replace("||", " or ")
    try:
        return bool(e.strip()) and bool(eval(re.sub(r"!(?!=)", " not ", e)))
    except SyntaxError:
        return False


def test_conditions_equal_python(spark):
    df = spark.createDataFrame([(c,) for c in CONDITIONS], "c string")
    for symbols in ({"A"}, {"B", "C"}, set()):
        got = {r.c: r.v for r in df.select("c", D.condition_value(F.col("c"), symbols).alias("v")).collect()}
        assert got == {c: _truth(c, symbols) for c in CONDITIONS}


BRANCHY = """class C {
#if A && !(B)
 int One(int x) {
#elif B
 int Two(int x) {
#else
 int Three(int x) {
# if A
 foo {
# endif
#endif
 return 1; }
 #if (!OMIT) // y
 void Four() { }
 #if B
   void Five() { }
 #else
   void Six() { }
 #endif
 #endif
 #else
 void Seven() { }
 string s = "a"; /* #if NEVER */
}"""


def test_one_branch_of_each_conditional(spark):
    files = spark.createDataFrame(
        [(1, BRANCHY), (2, None), (3, "class C { void M() { } }"), (4, "#if X\nclass A { void N() { } }\n"), (5, "")], "doc_id bigint, code string")
    for symbols, want in [
        (set(), ["Three", "Four", "Six", "Seven"]), ({"A"}, ["One", "Four", "Six", "Seven"]), ({"B"}, ["Two", "Four", "Five", "Seven"]),
        ({"A", "B"}, ["Two", "Four", "Five", "Seven"]), ({"OMIT"}, ["Three", "Seven"]), ({"X"}, ["Three", "Four", "Six", "Seven"]),
    ]:
        rows = M.extract_methods(files, symbols=symbols).orderBy("doc_id", "method_idx").collect()
        assert [r.name for r in rows if r.doc_id == 1] == want
        assert [(r.doc_id, r.name) for r in rows if r.doc_id > 1] == [(3, "M")] + [(4, "N")] * ("X" in symbols)
    plan = M.extract_methods(files, symbols={"A"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
