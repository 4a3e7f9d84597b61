"""Sources that use much of each language; all of them are well-formed."""

SAMPLES = {
    "cpp": '#include <map>\nnamespace a::b { template <typename T, int N = 3> class V : public W<T>, private X { public: V() = default; explicit V(std::vector<std::pair<int, T>> v) : v_{std::move(v)}, n(N) {} ~V(); \n template <class U> auto f(U&& u) const noexcept -> decltype(u.g()) { return u.g(); } operator bool() const { return n < 3 && 4 > n; } V& operator=(const V&) = delete; bool operator<(const V& o) const; static constexpr int k = 1 << 3; private: std::vector<std::pair<int,T>> v_; int n : 4; }; }\nenum class E : int { A = 1, B, };\nusing F = std::function<void(int, const std::string&)>;\nint main(int argc, char** argv) { auto l = [&, x = 1](auto a) mutable { return a + x; }; for (const auto& [k, v] : m) { std::cout << k << v << std::endl; } if (int y = f(1); y > 0) { delete[] p; } else throw std::runtime_error("x"); \n int* q = new int[3]{1,2,3}; auto z = static_cast<double>(y) / 2; std::map<std::string, std::vector<int>> mm{{"a", {1}}}; foo<int>(3); x = a < b ? c : d; try { g(); } catch (const std::exception& e) { } catch (...) { } switch (c) { case \'a\': break; default: ; } goto end; end: return f(a < b); }\nextern "C" { void h(void); }\nstruct P { int x{0}; double y = 1.0; } __attribute__((packed));\ntypedef struct { int a; } Q;\nstatic const char *names[] = { "a", "b" };\ntemplate <> struct H<int> : std::true_type {};\nvoid (*fp)(int) = nullptr;\n',
    "typescript": 'import type { A } from "./a"; import fs, { b as c } from \'x\';\nexport abstract class Foo<T extends object = {}> extends Bar<T> implements I, J { private readonly x?: number; static #p = 3; constructor(private a: string, public b?: number) { super(); } get v(): T | undefined { return this._v!; } async *gen<U>(this: Foo<T>, ...rest: U[]): AsyncGenerator<U> { yield* rest; } abstract m(): void; [key: string]: any; @dec() foo = (x: number): x is 3 => x === 3; }\ntype M<T> = { readonly [K in keyof T]?: T[K] extends (infer U)[] ? U : never }; type F = (a: string, b?: number) => Promise<void>; type L = `a${string}`; \ninterface I { (x: number): string; new (x: number): I; m?<T>(a: T): void; readonly a: [x: number, y?: string, ...z: boolean[]] }\nexport default function f<T,>(x: T, y = 3 as const): asserts x is NonNullable<T> { const g = <T>(a: T) => a; let z = x as unknown as string[]; for (const [a, b] of Object.entries(o)) { if (!a) continue; } return void 0 }\nenum E { A = 1, B = A << 2, C = "x" } declare module "foo" { export const x: number } namespace N.M { export let y = 1 }\nconst o = { a, b: 1, [c]: 2, d() { }, get e() { return 1 }, async f() { }, ...g, \'h\': /re[/]x/g.test(s) ? 1 : 2 }\nlabel: while (true) { break label }\nlet { p = 1, q: { r }, ...rest } = obj, [s, , t = 2] = arr\nconst u = a ?? b?.c?.[d]?.(e) ?? new Map<string, number>([["x", 1]])\nif (a) b(); else if (c) { d() } do { x++ } while (x < 3)\nexport * as ns from "y"; export { a as b, type C } from \'z\'; \nconst h = async <T,>(x: T) => { await x; }; function over(a: string): void; function over(a: any) {}\n',
    "javascript": '#!/usr/bin/env node\n\'use strict\'\nimport a, * as b from \'c\'\nclass A extends (B, C) { static x = 1; #y; static { init() } async *[Symbol.iterator]() { yield* this } get z() { return `a${`b${c}`}d` } }\nexport const f = ({ a, b: [c] = [] }, ...d) => ({ a, c }), g = async x => { for await (const y of x) console.log(y) }\nvar r = a / b / c, re = /[/\\]]+/gi, n = 0xFFn + 1_000 + .5e-3\nx = y\n++z\nswitch (a) { case 1: case 2: { break } default: throw new Error(\'x\') }\nconst el = cond ? <div className="a" {...p}>text {list.map(i => <Item key={i} />)} </div> : null\nif (a) ; else b\na ||= b; c ??= d; e **= 2; f?.(); g?.[0]; delete h.i, void 0\n(function () { return this })()\n;[1, 2].forEach(function (x) { })\nexport default class { }\n',
    "go": 'package main\nimport ( "fmt"; m "math" )\ntype S[T any] struct { *Base; a, b int `json:"x"`; f func(int) (string, error) }\ntype I interface { M(x int) string; ~int | ~string; fmt.Stringer }\nconst ( A = iota; B )\nvar x, y = 1, map[string][]int{"a": {1, 2}, "b": nil}\nfunc (s *S[T]) Do(ctx context.Context, xs ...int) (n int, err error) {\n\tfor i, v := range xs { if v > 0 { continue } else if w := f(v); w != nil { return 0, w } ; _ = i }\n\tswitch t := x.(type) { case int, *string: fmt.Println(t); default: }\n\tselect { case v, ok := <-ch: _ = v; case ch <- 1: default: }\n\tgo func() { defer mu.Unlock() }()\n\ta[1:2:3], b = c[:], d[i:]\n\tp := &S[int]{a: 1, b: 2}\nL:\tfor { break L }\n\tvar z []struct{ a int } = []struct{ a int }{{1}, {2}}\n\tif v, ok := m[k]; ok && v == (T{1}) { x <<= 2; x++ }\n\treturn len(xs) + int(\'a\'), nil\n}\n',
    "java": 'package a.b;\nimport static java.util.List.*;\n@Ann(x = 1, y = {"a", "b"}) public sealed abstract class A<T extends Comparable<? super T>> extends B<T> implements C, D permits E { \n private static final Map<String, List<int[]>> M = new HashMap<>(); int a[] = {1, 2}, b; static { x(); } { y(); }\n public <U> A(U u, final int... xs) throws IOException { super(u); this.a = xs; }\n @Override public T get(int i) { return switch (i) { case 1, 2 -> null; case 3 -> { yield foo(); } default -> throw new X(); }; }\n void m() { for (int i = 0, j = 1; i < 3; i++, j--) { if (o instanceof String s && s.length() > 2) continue; } for (var e : map.entrySet()) { } Runnable r = () -> { }; Function<Integer, Integer> f = x -> x + 1; BiFunction<A, B, C> g = (a, b) -> a.b(b); list.stream().map(String::valueOf).toArray(String[]::new);\n try (var in = open(); out) { } catch (A | B e) { } finally { } synchronized (this) { } do { } while (x); label: while (true) break label; int x = (int) y >> 2 >>> 3; Object o = (Runnable & Serializable) () -> { }; String t = """\n  text "x" """; assert x > 0 : "m"; new Foo() { void z() { } }.z(); int[][] q = new int[3][]; char c = \'\\n\'; long l = 1_000L; throw new E(); }\n enum K { A(1) { int f() { return 1; } }, B; int f() { return 0; } } record P(int x, String y) { P { } } interface I { default void d() { } int e(); } @interface Z { int v() default 3; } }\n',
    "c": '#define X(a) \\\n  foo(a)\n#if 0\nbroken(\n#endif\ntypedef unsigned long int ulong_t; struct s { int a:3; union { int b; float c; }; struct s *next; } *head, arr[3] = { [0] = { .a = 1 }, };\nstatic inline int (*get(void))(int, ...) { return 0; }\nenum e { A, B = 2, };\nint main(int argc, char *argv[]) { int i = 0, *p = &i; for (;;) { if (i++ > 3) break; } do i--; while (i); switch (i) { case 1 ... 3: return sizeof(struct s) + sizeof i; default: goto out; } out: return (int)(*p) ? i : -1; }\n',
    "shell": '#!/bin/bash\nset -euo pipefail\nf() { local x="$1"; echo "${x:-y}" | grep -E \'a|b\' > /dev/null 2>&1 || return 1; }\nfor i in "$@"; do case "$i" in -h|--help) usage;; *) echo "$i" ;; esac; done\nwhile read -r line; do ((n++)); [[ $line =~ ^a ]] && echo ok; done < <(ls)\ncat <<EOF > out\ntext $(date) "\nEOF\narr=(a b c); if [ -n "$x" ] && ! cmd; then :; elif true; then x=$((1+2)); else y=`pwd`; fi\nfunction g { until false; do break; done }\n(cd /tmp && ls) & wait\necho $\'a\\n\' "a $(echo "b" | tr a b) c"\n',
    "sql": "WITH RECURSIVE t(a) AS (SELECT 1 UNION ALL SELECT a + 1 FROM t WHERE a < 5) SELECT DISTINCT x.a, count(*) FILTER (WHERE b > 1) AS n, sum(c) OVER (PARTITION BY d ORDER BY e DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM t AS x LEFT JOIN (SELECT * FROM u) y ON x.a = y.a AND y.b IN (1, 2) WHERE NOT EXISTS (SELECT 1) AND z BETWEEN 1 AND 2 OR q LIKE '%a' GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC LIMIT 10 OFFSET 5;\nCREATE TABLE IF NOT EXISTS a (id INTEGER PRIMARY KEY, b VARCHAR(20) NOT NULL DEFAULT 'x', c NUMERIC(10, 2) REFERENCES d (e) ON DELETE CASCADE, UNIQUE (b, c));\nINSERT INTO a (id, b) VALUES (1, 'it''s'), (2, NULL) ON CONFLICT (id) DO UPDATE SET b = excluded.b; UPDATE a SET b = CASE WHEN id = 1 THEN 'a' ELSE b END WHERE id <> 3; DELETE FROM a WHERE id IS NOT NULL; -- c\nCREATE OR REPLACE VIEW v AS SELECT CAST(a AS TEXT), b::int FROM a; DROP TABLE IF EXISTS a, b CASCADE; ALTER TABLE a ADD COLUMN z int; CREATE UNIQUE INDEX i ON a (b DESC);\n",
    "yaml": '# c\n---\na: 1\nb:\n  - x: 1\n    y: [1, {z: "q"}]\n  - - n\n    - m\n  -\n    k: v\nc: |\n  text: here\n    more\nd: >-\n  folded\ne: "quoted: yes" # c\nf: &anchor\n  g: *ref\nh: plain text\n  continued\n"k": \'it\'\'s\'\nurl: http://x.y/z\ni:\n- a\n- b: 2\n---\n- doc2\n...\n',
    "python": 'import os, sys as s\nfrom . import (a as b, c,)\n@dec(1)\nasync def f(a, /, b: int = 3, *args: "T", c, d=4, **kw) -> list[int]:\n    """Doc."""\n    async with open(a) as x, y(b) as (p, q): pass\n    async for i, *j in z: yield i\n    else: return\n    try: await g()\n    except* (A, B) as e: raise X from e\n    finally: del a[1:2, ::3], b.c\n    return [x async for x in y if x if not z], {**a, 1: 2}, {*b, 3}, (i for i in j), lambda *a, k=1, **kw: (yield)\nclass K(A, metaclass=M):\n    x: int = 3\n    def m(self): return super().m if False else None\nmatch x:\n    case [1, 2, *rest] if rest: pass\n    case {"a": A(b=1) as c, **k} | None: pass\n    case -1 | "s" | a.b: pass\n    case _: pass\nmatch = case = type = 1\ntype X[T: int] = list[T]\nif (n := 10) > 5: print(f"{n!r:>{w}} {\'a\' \'b\'}", rb"\\x00", 1_000.5e-3j, 0xFF, end="")\nwhile 1:\n    if a: continue\n    elif b: break\n    else:\n        global q\nwith (open(a) as b, c): pass\nassert a is not b not in c, "m"\nx = y = z = *a, b\na @= b; c **= d; e //= f\nprint(*a, **b, k=v)\n',
    "json": '{"a": [1, -2.5e3, true, null, "\\\\u00e9"], "b": {}}',
}
