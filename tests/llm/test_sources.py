"""Valid and broken sources; every prefix of a file that ends inside something must be found."""

import time

import pytest

from tessera.llm.glr import build, first_error
from tessera.llm.sources import parsed, rates, syntax_error, tables

KOTLIN = '''@file:JvmName("X")
package a.b

import a.c.D as E
import a.c.*

/* outer /* nested { */ still ( */
sealed interface Shape<out T : Any> where T : Comparable<T>

@Suppress("unused", "x")
data class P(val x: Int = 1, vararg val more: String?,) : Base(x), Shape<P> by other {
    companion object { const val N = "}" }
    init { require(x > 0) { "bad ${if (x > 1) "a${x}b" else "{"} $x" } }
    constructor() : this(1)
    val size: Int
        get() = more.size
    var late: Map<String, List<Int>>? = null
        private set
    override fun toString() = """raw " ${x} { <<<<<<< """
    fun <T : Comparable<T>> List<T>.top(n: Int = 3): T? {
        val (p, q) = n to 'c'
        for ((i, v) in withIndex()) { if (i < n && v > v) return v else continue }
        return filter { it != null }
            .map { a -> a }
            ?.firstOrNull() ?: throw IllegalStateException("x")
    }
}

enum class K(val s: String) { A("1"), B("2") { override fun f() = 1 }, ; abstract fun f(): Int }

fun interface Run { fun run() }
typealias F = (Int, String?) -> Unit
fun `odd { name`(block: suspend Foo.(Int) -> Unit = { }) = when (val y = 3) {
    in 0..9, !in 3..4 -> 1; is Int -> { 2 }
    else -> try { a[0] as? B } catch (e: Exception) { null } finally { }
}
val o = object : Run { override fun run() {} }
val t by lazy { a::class to ::b }
'''
JAVA = '''@Deprecated package a.b;
import static java.util.List.of;
import java.util.*;
/** { */
public sealed class A<T extends Comparable<? super T> & B> extends C<Map<String, List<int[]>>> implements D permits E {
    static final int[] X = {1, 2, 0x1F,}; String s = "a \\" { \\u007d", t = """
        text " block { \\""" }
        """;
    static { x = (char) 'c'; }
    { y++; }
    enum K implements I { ONE("a") { void f() {} }, TWO; K(String... s) { this.s = s; } }
    record R<T>(@N int a, String... b) { R { if (a < 0) throw new IllegalArgumentException("x"); } }
    @interface Q { String[] value() default {"a", "b"}; int n() default 1 + 2; }
    <U> U f(final int a, List<?>... b) throws E, F {
        for (int i = 0, j = 1; i < n; i++, j--) { if (a < b && c > (d)) continue; else break; }
        for (var x : xs) synchronized (this) { x.<U>g(y)[1].z = (A & B) () -> { return 1; }; }
        try (var r = open(); q) { } catch (E | F e) { } finally { }
        int v = switch (k) { case ONE, TWO -> 1; case P(int q) when q > 1 -> { yield 2; } default -> throw new E(); };
        switch (v) { case 1: case 2: g(); break; default: }
        Runnable w = A.B::new; Object o = new int[3][], p = new A<>() { }; String c = String[].class.getName();
        return a ? (x) -> x : o instanceof String str && !str.isEmpty() ? null : (U) b >>> 2;
    }
    A(int a) { super(a); }
    int g();
}
'''


@pytest.mark.parametrize(("text", "ext"), [(KOTLIN, "kt"), (JAVA, "java"), ("", "kt"), ("", "java"), ("// only\n", "kt"), ("/* a */", "java"), ("package x", "kt"), ("package x;", "java"), ("#!/x\nplugins { id(\"a\") version \"1\" }\nfoo(1)\n", "kts")])
def test_valid(text, ext):
    for eol in ("\n", "\r\n", "\r"):
        assert syntax_error(text.replace("\n", eol), ext) is None


@pytest.mark.parametrize("ext", ["kt", "java"])
def test_truncations(ext):
    text = {"kt": KOTLIN, "java": JAVA}[ext]
    start, end = (text.index("data class"), text.index("enum class K")) if ext == "kt" else (text.index("class A"), text.rindex("}"))
    body = text[:end].rstrip() if ext == "kt" else text[:end]
    opened = text.index("{", start)
    assert all(syntax_error(body[:k], ext) for k in range(opened + 1, len(body) - 1, 7))


@pytest.mark.parametrize(("text", "ext"), [
    ("class A {\n<<<<<<< HEAD\n    val a = 1\n=======\n    val a = 2\n>>>>>>> x\n}\n", "kt"), ("class A { int a; }\n", "kt"), ("class A { val a = 1 }", "java"), ("# Title\n\ntext\n", "kt"), ("fun f() { a b }", "kt"),
    ("fun f() { val a = 1 val b = 2 }", "kt"), ('val s = "open\n', "kt"), ("val c = 'ab'", "kt"), ("/* open", "kt"), ("/* open", "java"), ("class A { void f() { 1; } }", "java"), ("class A { String s = \"x\n\"; }", "java"), ("}", "kt"), ("class A { } }", "java"),
    ("fun f() { if (a { } }", "kt"), ("println(1)", "kt"), ("class A { int f() { return 1 } }", "java"),
])
def test_broken(text, ext):
    assert syntax_error(text, ext)


def test_place():
    assert syntax_error("class A {\n  int f( { }\n}\n", "java")[:2] == (2, 10)


def test_ambiguous_grammar():
    t = build("e : e '+' e | 'x' | f 'x' ; f : ( 'x' )? ;", "e")
    assert first_error(t, [" x", " +", " x", " +", " x"]) == -1 and first_error(t, [" x", " +"]) == 2 and first_error(t, []) == 0


def test_deep_nesting_is_linear():
    n = 3000
    assert syntax_error("val a = " + "(" * n + "1" + ")" * n, "kt") is None
    assert syntax_error("val a = " + "(" * n + "1" + ")" * (n - 1), "kt")
    assert syntax_error("fun f() { if (a < b) " + "{ if (a < b) x = { a -> b } else c } ;" * 500 + " }", "kt") is None


VALID_MORE = [
    ("fun f() = a or\n  b", "kt"), ("val p = x to\n\n y", "kt"), ("fun f() { for (i in 1 until\n 2) {} }", "kt"), ("context(Foo) fun f() {}", "kt"), ("context(a: Foo, b: Bar)\nfun f() {}", "kt"),
    ("fun g(context: Int) { context(3); val x: context(A) () -> Unit = y }", "kt"), ("module a.b { requires transitive java.base; exports a.b to c.d, e; uses x.Y; provides A with B, C; opens q; }", "java"),
    ("@Deprecated open module a { requires static x; }", "java"), ("class A { int open, to; void with() { module = to; } }", "java"), ("class A { int a = 07, b = 0; double c = 08.5, d = 09f, e = 0x1.8p3; long l = 0xFFL; int x = 0_7; }", "java"),
    ("val x = 0x1F_FF; val y = 1_000", "kt"), ("class A { val x: Int get() = 1; val y = 2 }", "kt"), ("class A { val x = 1 }", "kt"), ("class A { var x = 1\n private set\n\n fun f() {} }", "kt"), ("enum class E { A; val x = 1 }", "kt"),
    ("val x by lazy { 1 }\nval y = 2", "kt"), ("val x = 1;;val y = 2", "kt"), ("val a: Int\n get() = 3\nval b = 1", "kt"), ("interface A { val x: Int; fun f() }", "kt"), ("class A { val a = object : B { val c = 1 } }", "kt"),
]


@pytest.mark.parametrize(("text", "ext"), VALID_MORE)
def test_valid_more(text, ext):
    assert syntax_error(text, ext) is None


@pytest.mark.parametrize(("text", "ext"), [("val x = 1_", "kt"), ("class A { int a = 08; }", "java"), ("class A { int a = 1_; }", "java"), ("class A { int a = 0x; }", "java"), ("val x = 0x", "kt"), ("val x = 1 val y = 2", "kt"), ("class A { val x = 1 val y = 2 }", "kt"), ("module a { requires; }", "java"), ("val x = a or", "kt"), ("val x = 01", "kt")])
def test_broken_more(text, ext):
    assert syntax_error(text, ext)


@pytest.mark.parametrize(("text", "ext"), [("val x = " + "(a < " * 200 + "b" + ")" * 200, "kt"), ("class A { Object f() { return " + "(a < " * 200 + "b" + ")" * 200 + "; } }", "java"), ("class A { Object f() { return " + "(a) -> (T) (" * 200 + "b" + ")" * 200 + "; } }", "java")])
def test_ambiguity_is_polynomial(text, ext):
    known, began = tables(), time.time()
    assert syntax_error(text, ext, known) is None and syntax_error(text.replace(")", "", 1), ext, known)
    assert time.time() - began < 2


def test_same_id_with_different_contents(spark):
    df = spark.createDataFrame([(1, "r/a.kt", "val a = 1"), (1, "r/a.kt", "\nval"), (1, "r/a.kt", "val")], "id bigint, path string, content string")
    assert [(r["valid"], r["line"], r["token"]) for r in parsed(df).collect()] == [(False, 2, "end of file")]


def test_operator(spark):
    rows = [(1, "r/a.kt", "val a = 1", "kotlin"), (1, "r/a.kt", "val a = 1", "kotlin"), (2, "r/b.java", "class {", None), (3, "q/c.kts", "", "x"), (4, "q/d.md", "{", ""), (5, None, "{", ""), (6, "q/e.kt", None, "")]
    df = spark.createDataFrame(rows, "id bigint, path string, content string, valid string")
    out = parsed(df)
    assert {(r["id"], r["valid"]) for r in out.collect()} == {(1, True), (2, False), (3, True)}
    assert {tuple(r) for r in rates(out).collect()} == {("r", "kotlin", 1, 0, 0.0), ("r", "java", 1, 1, 1.0), ("q", "kotlin", 1, 0, 0.0)}
    assert parsed(df.limit(0)).count() == 0
