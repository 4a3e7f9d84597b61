"""Whole sources of the languages whose files were held to nothing, or to paired brackets only, and statements that are none."""

from pathlib import Path

import pytest

from codeloom.functions.languages import EXTENSIONS
from codeloom.llm import wellformed
from codeloom.llm.grammar import scala

SOURCES = sorted(Path(__file__).with_name("sources").iterdir())
#: brackets, literals and comments of all of these are right
BAD = {
    "ruby": ["def f\n 1", "class A\n def f\n end", "end", "x = ", "x = 1 2", "a b)", "puts 'a", "while x do\n a\nend\nend", "return if x\nend", "x = <<~A\n foo\n", "case x\nwhen 1\n2", "begin\nrescue\n", "<<<<<<< HEAD\nx = 1\n", 'puts "#{x y z)}"'],
    "rust": ["fn f() { let x = ; }", "fn f() { let = 3; }", "struct A { x i32 }", "fn f(x) { }", "fn f() { a b }", "use a::;", "fn f() -> { }", "impl { }", "enum A { B C }", "fn f() { x + ; }", "fn f() { for x y {} }", "let x = 1;"],
    "kotlin": ["fun f() { val = 1 }", "class { }", "val x = ", "fun f() { a b }", "fun f(x) {}", "println(1)", "val x = 1 val y = 2", "fun f() { when (x) { 1 => 2 } }", "interface A { x: Int }", "fun f() { for (i : x) {} }", 'val s = "${x +}"'],
    "kts": ["x = ", "val x y z w"],
    "csharp": ["class A { void F() }", "class A { int x = ; }", "class A { void F() { return 1 } }", "using ;", "class A { public x; }", "int x = 1 int y = 2;", "foreach (var x y) {}", "class A extends B { }", "class A { int X { get; set } }", "a b c;", 'var s = $"{x +}";'],
    "scala": ["val = 1", "val x = ", "object A { if }", "def f(x) = 1", "object A { x match { case => 1 } }", "for (x y) z", "val x: = 1", "case class P(a Int)", "val x = 1 val y = 2", "foo(1 2)", "import"],
    "swift": ["let = 1", "let x = ", "struct { }", "func f() { a b }", "func f(x) {}", "func f() -> { }", "switch x { case }", "struct A { x: Int }", "for x y { }", "let x = 1 let y = 2", "enum A { case }", "#if X\nlet x = 1", 'let s = "\\(x +)"'],
    "php": ["<?php $a = ;", "<?php class A { function f() }", "<?php class { }", "<?php $a = 1 $b = 2;", "<?php class A { public x; }", "<?php $x = 1", "<?php for ($i) {}", "<?php return 1 2;", "<?php $a->;", "<?php match ($x) { 1 = 2 };", "<?php if ($a): echo 1;", '<?php $s = "{$x[}";'],
}


def _key(path: Path) -> str:
    return "kts" if path.suffix == ".kts" else EXTENSIONS[path.suffix]


@pytest.mark.parametrize("path", SOURCES, ids=[p.name for p in SOURCES])
def test_whole_sources_pass_and_what_is_put_into_them_does_not(path):
    text = path.read_text(encoding="utf8")
    assert wellformed.check_text(_key(path), text) is None
    for stray in ("\n<<<<<<< HEAD\n", "\n)\n", "\n}\n"):
        assert wellformed.check_text(_key(path), text.split("__END__")[0] + ("<?php " if path.suffix == ".php" else "") + stray) is not None


@pytest.mark.parametrize("language", sorted(BAD))
def test_statements_that_are_none(language):
    for text in BAD[language]:
        assert wellformed.check_text(language, text) is not None, text


def test_every_language_of_the_registry_but_markdown_has_a_grammar():
    assert set(EXTENSIONS.values()) - {"markdown"} <= set(wellformed.LANGUAGES)


def test_every_end_of_ruby_counts():
    text = "module A\n  def f\n    return if x\n    y while z\n    [1].each do |a|\n      a\n    end\n  end\nend\n"
    assert wellformed.check_text("ruby", text) is None
    assert wellformed.check_text("ruby", text + "end\n") is not None and wellformed.check_text("ruby", text[:-4]) is not None


def test_indentation_of_scala_is_told_from_continued_lines():
    kinds = [t[0] for t in scala.scala_tokens("def f =\n  a\n    .b\nval c = d\n  .e\n")]
    assert kinds.count("INDENT") == kinds.count("DEDENT") == 1


def test_depth_is_no_error():
    n = 3000
    assert wellformed.check_text("javascript", "x = " + "`${" * n + "1" + "}`" * n) is None
    assert wellformed.check_text("javascript", "x = " + "`${" * n + "1" + "}`" * (n - 1)) is not None


def test_files_of_these_languages(spark):
    rows = [("a.rb", "r", "def f\n"), ("b.rb", "r", "def f\nend\n"), ("c.rs", "r", "fn f() { a b }"), ("d.KTS", "r", "println(1)"), ("e.kt", "r", "println(1)"), ("f.php", "r", "<?php $a = ;"), ("g.cs", "r", "class A { int x = ; }")]
    checked = wellformed.check_files(spark.createDataFrame(rows, "file_path string, repo string, content string"), EXTENSIONS).collect()
    assert {r.file_path for r in checked if r.reason} == {"a.rb", "c.rs", "e.kt", "f.php", "g.cs"}
    assert {r.language for r in checked} == {"ruby", "rust", "kotlin", "php", "csharp"}


def test_expressions_inside_strings_elements_and_substitutions_are_parsed():
    fine = {
        "python": ["x = f'{a!r:>{w}} {b=} {{c}} {d['e']}' f'{f\"{g}\"}'\n", "x = rf'\\{a}'\n", "x = f'''{\na\n}'''\n"],
        "javascript": ["x = <a b={c} {...d}>{/* e */}{f ? <g/> : null} text</a>;"],
        "tsx": ["const x = <a b={c as D}>{e!.f}</a>;"],
        "shell": ["echo $(a $(b $(c $(d $(e)))))", 'x=$(case $1 in a) echo b;; *) c;; esac) y="$(a "$(b \'c\')" | d)"', "diff <(a) <(b | c); echo ${x:-$(a)} $((1 + (2 * 3))) $( (a; b) )"],
    }
    broken = {
        "python": ["x = f'{a +}'\n", "x = f'{a b}'\n", "x = f'{}'\n", "x = f'}'\n", "x = f'{a:{b +}}'\n", "x = f'{a'\n"],
        "javascript": ["x = <a>{y + }</a>;", "x = <a b={y + }/>;"],
        "tsx": ["const x = <a>{y + }</a>;"],
        "shell": ["echo $(if true)", 'echo "$(a |)"', "echo $(a", "echo ${x", "cat <(if true)"],
    }
    for language, texts in fine.items():
        for text in texts:
            assert wellformed.check_text(language, text) is None, text
    for language, texts in broken.items():
        for text in texts:
            assert wellformed.check_text(language, text) is not None, text
