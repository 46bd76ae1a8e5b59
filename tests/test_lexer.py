"""Strings, comments and brackets of source text, against a scan by characters, and the facts that rest on them."""

import random

from pyspark.sql import functions as F

from graphloom.operators import facts, lexer

HARD = 'class A { string s = "}"; char c = \'{\'; /* } */ string v = @"a""}\\"; // }\n string r = """ } "" """; string i = $"{x}"; int Z() { return 1; } } class B { }'


def test_bodies_pass_over_strings_and_comments():
    inner = HARD[HARD.index("{") + 1 : HARD.rindex("} class B")]
    assert lexer.enclosed([HARD, "", "x", HARD], [[0], [0], [], [HARD.index("class B")]], "{", "}") == [[inner], [None], [], [" "]]
    assert lexer.enclosed(["a { b", "c } d { e }"], [[0], [0]], "{", "}") == [[None], [" e "]]
    assert lexer.enclosed(['{ "open }', "{ 'x }", "{ /* }", "\0{ 😀 }"], [[0]] * 4, "{", "}") == [[None], [" 'x "], [None], [" 😀 "]]


def plain_depths(text):
    depth, out = 0, []
    for c in text:
        depth += (c == "{") - (c == "}")
        out.append(depth)
    return out


def plain_enclosed(text, at):
    begin = text.find("{", at)
    depth = 0
    for i in range(begin if begin >= 0 else len(text), len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[begin + 1 : i]
    return None


def test_random_brackets_against_a_scan(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("{}ab\n") for _ in range(rng.randrange(40))) for _ in range(300)]
    froms = [[rng.randrange(len(t) + 1) for _ in range(3)] for t in texts]
    for piece in (7, 1 << 20):  # pieces of a batch change nothing
        monkeypatch.setattr(lexer, "PIECE", piece)
        assert lexer.enclosed(texts, froms, "{", "}") == [[plain_enclosed(t, a) for a in at] for t, at in zip(texts, froms)]
    lexed = lexer.Lexed(texts)
    assert [lexed.depth("{", "}")[a:b].tolist() for a, b in zip(lexed.starts, lexed.ends)] == [plain_depths(t) for t in texts]


def test_parameter_types():
    given = {
        "IFoo foo, IDictionary<string, IBar[]> bars": ["IFoo", "IDictionary<string,IBar[]>"],
        '[From("a, b", Keys = new[] { 1, 2 })] [X] this IFoo foo = null, string s = ",", char c = \')\'': ["IFoo", "string", "char"],
        "IFoo foo /* a, b */, // c, d\n  ref readonly global::N.IBar? bar": ["IFoo", "N.IBar"],
        "(int a, int b) pair, Func<A, B> f": ["(inta,intb)", "Func<A,B>"],
        "": [], "  ": [], "nameless": [], ", ,": [],
    }
    assert lexer.parameter_types(list(given)) == list(given.values())


def test_constructors_with_brackets_and_strings_in_their_parameters(spark):
    text = 'public class Mill([Named(")", 1)] IDam dam, IGate gate) { }\nclass Weir { public Weir(IPond pond = default(IPond), string s = "(") { } }\n// class Old(IRust (rust)\nclass New(ISteel steel) { }'
    files = spark.createDataFrame([("src/A.cs", text), ("src/B.cs", "class Open(IFoo foo { )")], "path string, content string")
    got = {(r.path, r.line, r.display.split("(")[0], tuple(r.parameter_types)) for r in facts.consumers(files).collect()}
    assert got == {("src/A.cs", 1, "Mill", ("IDam", "IGate")), ("src/A.cs", 2, "Weir", ("IPond", "string")), ("src/A.cs", 4, "New", ("ISteel",))}


def plain_dead(files):
    import re

    count = {}
    for _, text in files:
        for name in re.findall(facts.IDENTIFIER, text):
            count[name] = count.get(name, 0) + 1
    out = set()
    for path, text in files:
        for pattern, kind in ((facts.PRIVATE_METHOD, "private-method"), (facts.PRIVATE_FIELD, "private-field")):
            out |= {(kind, m[2], path) for m in re.finditer(pattern, text) if count.get(m[2]) == 1}
        for m in re.finditer(facts.INTERNAL_TYPE, text):
            body = plain_enclosed(text, m.end()) or "" if "static" in m[1] else ""
            if count.get(m[2]) == 1 and all(count.get(x) == 1 for x in re.findall(facts.STATIC_METHOD, body)):
                out.add(("internal-type", m[2], path))
    return out


def test_dead_code_shuffles_what_may_be_declared_only(spark):
    rng = random.Random(3)
    files = []
    for i in range(60):
        words = " ".join(f"w{rng.randrange(6000)}" for _ in range(300))
        files.append((f"src/F{i}.cs", f"internal static class T{i} {{ public static int M{i}(int n) {{ return n; }} }}\nprivate int f{i} = 1;\nprivate void P{i}() {{ }}\n{words} M{i if i % 3 else 'x'} f{i % 7} T{i % 5} P{i % 11}"))
    rows = spark.createDataFrame(files, "path string, content string")
    assert {(r.kind, r.name, r.path) for r in facts.dead_code(rows).collect()} == plain_dead(files)
    asked = spark.createDataFrame([(f"{k}{i}",) for k in "TMfP" for i in range(60)], "name string")
    from graphloom.operators import bloom

    names = facts.identifiers(rows).select("name").distinct()
    passed = {r.name for r in names.where(bloom.may_be_in(asked, "name", F.col("name"))).collect()}
    assert {r.name for r in asked.join(names, "name").collect()} <= passed and len(passed) < 0.1 * names.count()


def test_bloom_edge_cases(spark):
    from graphloom.operators import bloom

    one = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    none = one.where("false")
    assert [r.x for r in one.where(bloom.may_be_in(none, "x", F.col("x"))).collect()] == []
    assert [r.x for r in one.where(bloom.may_be_in(one.where("x = 'a' or x is null"), "x", F.col("x"))).collect()] == ["a"]
    assert bloom.words_for(0) == 1 and bloom.words_for(10**12) * 64 == bloom.MOST_BITS
