import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import docpairs, truncation

DOCS = "doc_id long, text string, source string"


def cut(spark, texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return [bool(r.is_cut) for r in truncation.judge_ends(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()]


def test_small_corpora(spark):
    texts = ["We agreed on the plan.\n\nBest regards,\nAnna Keller", "We agreed on the plan.\n\nThanks,\n- Anna K.", "It is finished now.", "We agreed on the", "Steps:\n- first step of all\n- second step of all of"]
    assert cut(spark, texts)[:4] == [False, False, False, True]


def test_an_unfinished_name_is_known_by_its_longer_words(spark):
    texts = [f"Keller wrote note number {i} about Keller." for i in range(6)] + ["All is said.\n\nRegards,\nAnna Kell"]
    assert cut(spark, texts)[-1] is True


def test_long_closing_lines_count_like_short_ones(spark):
    closer = "This page is kept by the people of the index team and changes with every release of the engine"
    texts = [f"Page {i} tells how shard {i} works.\n\n{closer}" for i in range(8)]
    assert not any(cut(spark, texts)) and cut(spark, [*texts, "Page tells more.\n\n" + closer[:60]])[-1]


def test_words_of_any_length(spark):
    long_ = "x".join(string.ascii_lowercase) * 4
    texts = [f"Text {i} names {long_} in its middle." for i in range(4)] + [f"Text names {long_[:90]}"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = truncation.judge_ends(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()
    assert got[-1].is_cut and got[-1].evidence == "unfinished word"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["ab", "cd", "x9", "e-f"]), min_size=2, max_size=14), st.integers(0, 13))
def test_lines_that_differ_in_one_word_share_a_key(words, at):
    at %= len(words)
    other = [*words[:at], "zz", *words[at + 1 :]]
    bare = lambda line: {k.split("\x02")[0] for k in truncation.closing_keys(line)}
    assert bare(" ".join(words)) & bare(" ".join(other)) or any(c in words[at] for c in "9-")
    assert truncation.closing_keys(" ".join(words))[0] != truncation.closing_keys(" ".join(words) + " more")[0]


@pytest.mark.parametrize(
    ("doc", "name", "says"),
    [
        ("Idempotent.", "retry", True),
        ("Dit is een functie die iets doet", "retry", False),
        ("Questa è una funzione che fa qualcosa.", "retry", False),
        ("Retry.", "retry", False),
        ("Waits for the lock and gives up after a minute.", "retry", True),
        ("Placeholder.", "retry", False),
        (None, "retry", False),
    ],
)
def test_what_says_something(doc, name, says):
    assert docpairs.says_something(doc, name) is says


def test_heads_of_any_length():
    body = ",\n".join(f"      int parameter{i}" for i in range(30))
    text = "class A {\n  /** Adds one row and tells the watchers. */\n  public void f(\n" + body + "\n  ) {\n    x();\n  }\n}\n"
    (name, first, last, doc, signature), *more = docpairs.functions_in(text, "brace")
    assert (name, first, last) == ("f", 3, 36) and "Adds one row" in doc and "parameter29" in signature and not more
    tags = "\n".join(f"@param parameter{i} parameter{i}" for i in range(30))
    assert not docpairs.says_something(tags, "f", signature)


def test_code_of_a_pair_is_the_delimited_function(spark):
    nodes = [(1, "function", "go", "# Drops rows older than the limit.\ndef go(x):\n    return x\n\nleft = 1\n", None, "python")]
    row = docpairs.pair_nodes(spark.createDataFrame(nodes, "node_id long, node_type string, name string, content string, docstring string, language string")).first()
    assert row.code == "def go(x):\n    return x" and row.documentation == "Drops rows older than the limit."
