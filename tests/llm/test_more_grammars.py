import pytest

from codeloom.llm.wellformed import check_text

GOOD = {
    "lua": '#!/usr/bin/lua\nlocal M <const>, x = {}, 0x1F\n--[==[ long ]] comment ]==]\nfunction M.a.b:c(x, ...)\n  if not x then return nil, "a\\"b" elseif #x > 3 and x ~= {1, 2; k = 3, ["z"] = f"s"} then goto done else x = x .. [[raw "]] end\n  for i = 1, 10, 2 do print(i) end\n  for k, v in pairs(t) do t[k], t.v = v, function() end end\n  repeat local y = -x ^ 2 // 3 until y <= 0 or (x)\n  while true do break end\n  ::done::\n  return x\nend\nM:run { a = 1 }\n("x"):rep(3)\nreturn M;\n',
    "r": '# note\nf <- function(x, y = 2, ...) {\n  if (x > 1 && !is.null(y)) {\n    z <- x[1, , drop = FALSE]\n  }\n  else if (y) y else {\n    z = x[["a"]]$b@c\n  }\n  for (i in 1:10) print(i %in% c(1L, 2.5e3, NULL))\n  repeat { break }\n  while (TRUE) next\n  g <- \\(a) a + 1; h <- list(a = 1, `b c` = "d\\n", e = )\n  pkg::fun(x,\n    y)[[1]][[2]]\n  x |>\n    f() -> k\n  lm(y ~ x + I(x^2), data = d)\n  x[y[1]]\n}\n',
    "rust": 'use a::{b, c};\n/* outer /* inner */ still */\nfn main<\'a>(x: &\'a str) -> Vec<u8> { let c = \'}\'; let s = "a \\" { \n b"; let r = r#"raw " { "#; let b = b\'(\'; if x[0] == (1) { vec![1, 2] } else { "}".into() } }\n#[derive(Debug)] struct P { x: i32 }\n',
    "kotlin": 'package a\nfun f(x: Int): String { val s = "a ${if (x > 1) "b}" else "c"} d"; val t = """raw { " ${g("}")} """; val c = \'"\'; return "$s\\"" }\n',
    "scala": 'object A { def f(x: Int) = s"a ${g("}")} b"; val c = \'{\'; val y = \'sym; val t = """x " {"""; def g(x: String): Int = x match { case "a" => 1 case _ => 2 } }\n',
    "csharp": '#region x (\nusing System;\nclass A { string P => $"a {b["k"]} {{literal"; string v = @"c:\\ "" {"; char c = \'{\'; int F(int[] x) { return x[0]; } }\n#endregion\n',
    "swift": 'import A\nfunc f(_ x: Int) -> String { let s = "a \\(g("b)")) c"; let r = #"raw " { "#; let m = """\n text " \\(x) {\n"""; return s + r + m }\n',
    "php": '<html> ( { <?php\n// note ) ?> text {\n<?php function f($x) { $s = "a {$x["k"]} \\" {"; $h = <<<EOT\n  text ) {\n  EOT; return [\'a\' => \'}\', "b" => $x]; } # done (\n?>\n)',
}
BAD = {
    "lua": ["function f( end", "if x then", "x = ", "local function f() return 1", "x = {1, 2", "print('a)", "end", "<<<<<<< HEAD\nx = 1", "--[[ open"],
    "r": ["f <- function(x {", "x <- (1 + ", "if (x", "x[[1]", "a b", "x <- 'open", "}", "<<<<<<< HEAD"],
    "rust": ["fn main( {", "fn f() { let s = \"open; }", "fn f() { /* open }", "}", "fn f() {\n<<<<<<< HEAD\n}\n=======\n>>>>>>> main\n"],
    "kotlin": ["fun f() { val s = \"a ${x\" }", "class A {", "fun f(x: Int]"],
    "scala": ["object A { def f = (1 }", "val x = \"\"\"open", "object A {"],
    "csharp": ["class A { void F( { } }", "class A { string s = \"open; }", "class A {\n=======\n}"],
    "swift": ["func f() { let s = \"a \\(x\" }", "struct A {", "let x = [1, 2)"],
    "php": ["<?php function f( { }", "<?php $s = 'open;", "<?php if (x) {"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_whole_sources_and_their_cuts(language):
    assert check_text(language, GOOD[language]) is None
    for text in BAD[language]:
        assert check_text(language, text) is not None, text
    assert check_text(language, "") is None and check_text(language, None) is None
