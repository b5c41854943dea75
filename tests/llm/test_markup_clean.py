import numpy as np
import pytest

from lorewell.llm import markup


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("a <em>b</em> c", "a b c"),
        ("x &mdash; y&nbsp;z", "x — y z"),
        ("see [[A|the b]] and [[C]]", "see the b and C"),
        ("[a](b.md) ![c](d.png)", "a c"),
        ("x{{cite note|no=5}} {{note|kept words}}", "x kept words"),
        (r"\cite{a5} \textbf{bold} and \emph{it}", "bold and it"),
        (r"so $\frac{a}{3}$ stays", r"so $\frac{a}{3}$ stays"),
        ("run `ls *.md` now", "run `ls *.md` now"),
        ("**a** __b c__ _d_ ~~e~~ ''f'' '''g'''", "a b c d e f g"),
        ("== Over ==", "## Over"),
        ("<h2>Over</h2>text", "## Over\ntext"),
        ("# Stays", "# Stays"),
        ("- item", "- item"),
        ("<li>one</li><li>two</li>", "- one\n- two"),
        ("| a | **b** |", "a\tb"),
        ("<code>x</code> y", "`x` y"),
        ("end.<ref>{{cite note|no=1}}</ref>", "end."),
        ("<!-- no --> yes", "yes"),
        ("> quoted", "quoted"),
        ("**see [[A|b <em>c</em>]]**", "see b c"),
        ("[https://a.example the site]", "the site"),
        ("a < b and b > c", "a < b and b > c"),
        (r"\section{Start} go", "# Start go"),
        ("", ""),
    ],
)
def test_rendered(text, clean):
    assert markup.rendered(text, markup.constructs(text)) == clean
    assert markup.rendered(clean, [x for x in markup.constructs(clean) if x[2] not in ("heading", "list", "code", "formula")]) == clean


def test_wrapped_text_comes_back():
    """A round trip: markup put around words of a clean text leaves that text."""
    rng = np.random.default_rng(4)
    words = "the keepers cleaned one shelf of our northern gate before noon and nobody had checked it".split()
    shapes = ["<em>{}</em>", '<span class="x">{}</span>', "**{}**", "__{}__", "*{}*", "_{}_", "~~{}~~", "''{}''", "'''{}'''", "[{}](page.md)", "[[{}]]", "[[A b|{}]]", r"\textbf{{{}}}", r"\emph{{{}}}", "{{{{note|{}}}}}"]
    for _ in range(300):
        i, k = int(rng.integers(0, len(words))), int(rng.integers(1, 4))
        shape = shapes[rng.integers(0, len(shapes))]
        text = " ".join([*words[:i], shape.format(" ".join(words[i : i + k])), *words[i + k :]])
        assert markup.rendered(text, markup.constructs(text)) == " ".join(words), text


def test_long_leaves_and_deep_paths():
    text = "<em>" + " ".join(f"w{i}" for i in range(60)) + "</em> " + "".join(f"<i{c}>" for c in "abcdefghj") + "x"
    leaves = markup.excerpt_leaves(text)
    assert "".join(text[b:e] for _, b, e in leaves) == text
    assert {f"w:w{i}" for i in range(60)} <= {t for tokens, _, _ in leaves for t in tokens} and sum(t.startswith("path:") for t in leaves[-1][0]) == 9
    assert len(markup.features("x" * 100, False)) > 10
