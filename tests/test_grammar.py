import pytest
from hypothesis import given, settings, strategies as st

from lorewell.functions import fingerprint, grammar as g, names as n, rewriting as r

GOLDEN_IN = (
    '---\naliases: [ "Beta" , "", Beta, 안녕 ]\ntitle:  Hello world  \ntags: [wiki, "graph stuff"]\nother: value\n---\n\n'
    "#   Heading   ###\n\n\n* [[ Page | Alias ]]\n+ [ Label ]( ./hello.md )\n\n```\n* [[ No | Change ]]\n```\n"
)
GOLDEN_OUT = (
    "---\ntitle: Hello world\naliases:\n  - Beta\n  - 안녕\ntags:\n  - wiki\n  - graph stuff\nother: value\n---\n\n"
    "# Heading\n\n- [[Page|Alias]]\n- [Label](./hello.md)\n\n```\n* [[ No | Change ]]\n```\n"
)


def test_link_only_lines():
    text = "Alpha summary.\n\n- [[Beta]]\n- **[[Beta]]**\n- [Beta](Beta.md)\n- [[Beta|B]]\n- [[Beta]] [[Gamma]]\n- [[Beta]] explains Beta.\n```\n- [[Beta]]\n```\n"
    assert g.parse(text).link_only == [(3, "- [[Beta]]"), (4, "- **[[Beta]]**"), (5, "- [Beta](Beta.md)"), (6, "- [[Beta|B]]")]


@pytest.mark.parametrize("line", ["![i](p.png) [[B]]", "- [[B]] é", "> [[A]] 1"])
def test_not_only_a_link(line):
    assert not g.only_a_link(line)


@pytest.mark.parametrize("line", ["> - [ ] [[B]]", "1. # [[B]]", "* ++ [[B]] --", "[[B]]"])
def test_only_a_link(line):
    assert g.only_a_link(line)


def links(text):
    return [(x.kind, x.display_target, x.target_key, x.raw_target) for x in g.parse(text).links]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("[[A\\|b]]", [("wiki", "A", "a", "A")]),
        ("[[A#h|b]]", [("wiki", "A#h", "a", "A")]),
        ("![[x]]", [("wiki", "x", "x", "x")]),
        ("[[http://x/y]]", [("wiki", "y", "y", "http://x/y")]),
        ("[[#only]] [[ ]]", []),
        ("[l](./b/C.md#h \"t\") [[Z]]", [("wiki", "Z", "z", "Z"), ("markdown", "C#h", "c", "./b/C.md")]),
        ("[l](<a b.md>)", [("markdown", "a b", "a b", "a b.md")]),
        ("[l](mailto:a@b) [l](#h) [l](https://x.y) ![i](a.md) [l]()", []),
        ("[f](x.pdf)", [("markdown", "x.pdf", "x.pdf", "x.pdf")]),
        ("`[[A]]` ``[[B]] ` `` [[C]]", [("wiki", "C", "c", "C")]),
        ("`[[A]]", [("wiki", "A", "a", "A")]),
        ("~~~\n[[A]]\n```\n~~~ x\n[[B]]", [("wiki", "B", "b", "B")]),
        ("[[É]]", [("wiki", "É", "é", "É")]),
        ("[x](./)", [("markdown", ".", ".", "./")]),
        ("---\nsee: [[F]]\n---\n[[G]]", [("wiki", "F", "f", "F"), ("wiki", "G", "g", "G")]),
    ],
)
def test_links(text, found):
    assert links(text) == found


def test_front_matter():
    text = "---\r\ntitle: 'A'\naliases:\n  - x\n\n\t- \"y\"\n  - x\ntitle: B\n---\nbody"
    front = g.front_matter(text)
    assert (front.title, front.aliases, text.encode()[front.body_offset :]) == ("B", ("x", "y"), b"body")
    assert g.front_matter("---\ntitle: A\n") == g.Front()
    assert g.front_matter("---\naliases:\n- a\n---\n").aliases == ()
    assert g.front_matter("---\naliases: [a, \"b, c\", '']\n---\n").aliases == ("a", "b, c")
    assert g.front_matter("---\naliases: one\n---\n").aliases == ("one",)


def test_excerpt_and_statistics():
    text = "# T\n\n```\ncode\n```\nFirst  line.\nSecond\n"
    assert g.parse(text).excerpt == "First line."
    assert g.statistics(text)[:2] == (3, 5)
    assert g.statistics("a `b\nc` d-e: É!ΟΔΟΣ")[2] == "a d e é οδοσ"
    assert g.statistics("")[:2] == (0, 0)


def test_names_and_paths():
    assert n.clean_path("a/./b/../c") == "a/c" and n.clean_path("../x") == "../x" and n.clean_path("") == "."
    assert n.document_key(" <./a/B.MD#x> ") == "b" and n.path_key("./A/b.md") == "a/b"
    assert n.resolve_from("a/b", "../c.md") == "a/c.md" and n.folder_of("a/b.md") == "a"


def test_fingerprint_vector():
    import numpy as np

    hashes = fingerprint.gram_hashes(np.frombuffer("hello".encode("utf-32-le"), np.uint32), 5)
    assert hashes.tolist() == [11831194018420276491]


@given(st.text(max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint_is_brute_force(text):
    def grams(k):
        out = []
        for i in range(len(text) - k + 1):
            h = 0xCBF29CE484222325
            for b in text[i : i + k].encode():
                h = (h ^ b) * 0x100000001B3 % 2**64
            out.append(h)
        return out

    five = grams(5)
    least = {min(five[i : i + 8]) for i in range(len(five) - 7)} if len(five) >= 8 else set(five and [min(five)])
    size = fingerprint.gram_size(text)
    shingles, winnow = fingerprint.fingerprint(text)
    assert shingles.tolist() == sorted(h - 2**63 for h in set(grams(size)))
    assert winnow.tolist() == sorted(h - 2**63 for h in least)


def test_gram_size():
    assert fingerprint.gram_size("안녕 a") == 3 and fingerprint.gram_size("안 abc") == 5


def test_format_golden():
    assert r.format_note(GOLDEN_IN) == GOLDEN_OUT
    assert r.format_note(GOLDEN_OUT) == GOLDEN_OUT


@given(st.text(alphabet="#*+- `[]()|\\ab:\n\"'~", max_size=60))
@settings(max_examples=200, deadline=None)
def test_format_ends_in_one_break(text):
    out = r.format_note(text)
    assert out.endswith("\n") and not out.endswith("\n\n")


@pytest.mark.parametrize(
    ("line", "out"),
    [("####### x", "####### x"), ("#x", "#x"), ("## a ##", "## a"), ("*  a", "- a"), ("`[[ a ]]`", "`[[ a ]]`"), ("[[ a \\| b ]]", "[[a \\| b]]"), ("[[ a # b ]]", "[[a#b]]"), ("[[a| ]]", "[[a]]")],
)
def test_format_line(line, out):
    assert r.format_line(line) == out


def test_yaml_quotes():
    assert r.yaml_scalar("a: b") == '"a: b"' and r.yaml_scalar("a,b") == '"a,b"' and r.yaml_scalar("plain") == "plain"


def test_rename():
    text = "---\ntitle: \"Old\"\nsee: [[old]]\n---\n[[Old#h|l]] [[x/Old.md]] `[[Old]]` [l](d/Old.md#h \"t\") [a](<Old.md>) ![i](Old.md)\n```\n[[Old]]\n```\n"
    out, count = r.retarget(text, "old", "New")
    assert count == 6
    assert "[[New#h|l]] [[New.md]] `[[Old]]` [l](d/New.md#h \"t\") [a](<New.md>) ![i](New.md)" in out and "```\n[[Old]]\n```" in out
    assert r.retitle(out, "Old", "New") == (out.replace('title: "Old"', 'title: "New"'), True)
    assert r.retitle(out, "Other", "New")[1] is False
    assert r.renamed_path("a/b.md", "c", True) == "a/c" and r.renamed_path("a/b.md", "x/c.md", True) == "x/c"
    for bad in ("", "a?b", "<>"):
        with pytest.raises(ValueError):
            r.new_name(bad)
