import pytest

from lorewell.llm import lookalike, quality, truncation

PROSE = "The keepers cleaned the shelf before the fair, because the binder had cracked. Nobody at Marwick had checked it.\n" * 6


def profile(text):
    return dict(zip(quality.STATS, quality.page_profile(text, frozenset("the a of at had it because before".split()))))


def test_profiles_tell_shapes():
    table = "| a | b |\n|---|---|\n" + "".join(f"| row{i} | {i} |\n" for i in range(20))
    items = "".join(f"- [x] cleaned gate {i}\n" for i in range(20))
    junk = "§�%±/v76 ¬@kq\n" * 20
    assert profile(table)["aligned_share"] > 0.9 and profile(items)["item_share"] > 0.9 and profile(items)["indent_period"] > 0.9
    assert profile(PROSE)["aligned_share"] == profile(PROSE)["item_share"] == 0 and profile(PROSE)["punct_end_share"] == 1
    assert profile("ab   cd   ef\nxyz  cd   gh\nq    cd   hij\n")["column_share"] == 1 and profile("a b  c\nd eeeeeeee  f\n")["column_share"] == 0
    assert profile(junk)["punct_end_share"] == 0 and profile(junk)["symbol_ratio"] > 0.3
    assert profile("")["words"] == 0 and profile(None)["words"] == 0 and profile("   \n\n")["words"] == 0
    assert profile("word " * 200_000)["words"] == 200_000
    assert quality.autocorrelation([3, 9] * 10) > 0.8 and quality.autocorrelation([1]) == 0


def test_quality_on_tables(spark):
    import datetime as dt

    files = spark.createDataFrame(
        [(1, PROSE, dt.datetime(2024, 1, 1), 7), (1, None, dt.datetime(2024, 2, 1), 7), (2, "- a\n" * 9, None, 7), (2, "- a\n" * 9, None, 7), (3, None, None, 7), (None, PROSE, None, 7)],
        "page_id long, content string, received_at timestamp_ntz, words int",
    )
    common = spark.createDataFrame([("en", "the"), ("en", "the"), (None, None)], "lang string, word string")
    stats = quality.page_quality(files, common)
    words = {r["page_id"]: r["words"] for r in stats.collect()}
    assert words == {1: len(PROSE.split()), 2: 18, 3: 0}
    labels = spark.createDataFrame([(1, "prose"), (2, "list"), (2, "list"), (3, None)], "page_id long, shape string")
    chance = {r["page_id"]: r["chance"] for r in quality.scored(stats, quality.fit(stats, labels)).collect()}
    assert chance[1] < 0.5 < chance[2] and chance[3] is None
    none = quality.fit(stats, labels.limit(0))
    assert {r["page_id"]: r["chance"] > 0.5 for r in quality.scored(stats, none).where("words > 0").collect()} == {1: False, 2: True}
    assert quality.page_quality(files.limit(0), common.limit(0)).count() == 0


def test_alignment_rhythm_and_indentation_are_needed(spark):
    """Tables and lists of whole sentences without any sign before them: without the signals of layout nobody could tell them."""
    import random

    rng = random.Random(7)
    words = "the keepers cleaned a shelf of northern gate before noon because it had cracked at fair".split()
    some = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for i in range(240):
        shape = ("prose", "table", "list")[i % 3]
        lines = []
        for k in range(rng.randrange(6, 14)):
            cells = some(6)
            if shape == "table":
                lines.append("".join(w.ljust(10) for w in cells[:5]) + cells[5] + ".")
            elif shape == "list":
                lines.append("  " * (1 + k % 2) + " ".join(cells) + ".")
            else:
                lines.append(" ".join(cells) + ".")
        rows.append((i, "\n".join(lines), None, shape))
    files = spark.createDataFrame([r[:3] for r in rows], "page_id long, content string, received_at timestamp_ntz")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "page_id long, shape string")
    common = spark.createDataFrame([("en", w) for w in ("the", "a", "of", "it", "at", "had")], "lang string, word string")
    stats = quality.page_quality(files, common).cache()
    layout = ("aligned_share", "column_share", "indent_period", "length_autocorrelation")
    rest = tuple(f for f in quality.STATS[2:] if f not in layout)

    def right(features):
        model = quality.fit(stats.where("page_id < 120"), labels, features=features)
        held_out = quality.scored(stats.where("page_id >= 120"), model, features).select("page_id", "chance").collect()
        return sum((r["chance"] > 0.5) == (rows[r["page_id"]][3] != "prose") for r in held_out) / len(held_out)

    assert right(quality.STATS[2:]) > 0.95 and right(rest) < 0.8


def test_fit_survives_wrong_labels():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.c_[np.ones(400), rng.normal(size=400)]
    y = (x[:, 1] > 0).astype(float)
    y[:12] = 1 - y[:12]
    w = quality._logistic(x, y)
    assert (((x @ w) > 0)[12:] == (y[12:] > 0)).mean() > 0.95


@pytest.mark.parametrize(
    ("a", "b"),
    [("Ｆｅｎ Ａxle", "Fen Axle"), ("Cafe\u0301", "Café"), ("re\u200blay\u00ad x", "relay x"), ("a\u3000b\u2009c\u00a0d", "a b c d"), ("GX\u20111 ﬂow", "GX-1 flow")],
)
def test_plain_forms(a, b):
    assert lookalike.plain_form(a) == b


def test_accents_and_scripts():
    assert lookalike.plain_form("Cafe") != lookalike.plain_form("Café")
    assert "Keldale" in lookalike.options("Кeldаle") and lookalike.options("Обзор") == [] == lookalike.options("Keldale")
    assert "Обзор" in lookalike.options("Oбзop") and "Άνεμος" in lookalike.options("Άvεμoς")


def test_tokens_in_another_script_than_their_text(spark):
    assert lookalike.foreign("ΟΗ", "latin") == "OH" and lookalike.foreign("Обзор", "latin") is None and lookalike.foreign("OH", "latin") is None and lookalike.foreign("12", "latin") is None
    assert lookalike.dominant_script("ΟΗ-12 seedbed") == "latin" and lookalike.dominant_script("12 - 3") is None
    pages = spark.createDataFrame([(1, "v", "OH-12 seedbed"), (2, "v", "Обзор ОН"), (3, "v", "Plan 3")], "page_id long, vault string, name string")
    links = spark.createDataFrame([(1, "v", "ΟΗ-12 seedbed"), (2, "v", "Обзор OH"), (3, "v", "Обзор ОН"), (4, "v", "ΟΗ"), (5, "v", "Рlan 3")], "link_id long, vault string, raw_target string")
    assert sorted(tuple(r) for r in lookalike.look_alike_links(links, pages).collect()) == [(1, 1), (2, 2), (5, 3)]


def test_links_find_what_looks_the_same(spark):
    pages = spark.createDataFrame([(1, "v", "Weekly Keel", 0), (2, "v", "Обзор 12", 0), (3, "v", "Café", 0), (4, "w", "Weekly Keel", 0), (5, "v", None, 0), (None, "v", "x", 0), (6, "v", "", 0)], "page_id long, vault string, name string, text int")
    raw = [(1, "v", "Wеekly Kеel"), (1, "v", "Wеekly Kеel"), (2, "v", "./weekly keel.md"), (3, "v", "Oбзop\u00a012.md"), (4, "v", "Cafe"), (5, "v", "Cafe\u0301"), (6, "v", None), (7, None, "Café"), (8, "w", "ＷＥＥＫＬＹ Keel"), (9, "v", ""), (10, "v", "Zеta")]
    links = spark.createDataFrame([(*x, 0) for x in raw], "link_id long, vault string, raw_target string, form int")
    got = sorted(tuple(r) for r in lookalike.look_alike_links(links, pages).collect())
    assert got == [(1, 1), (3, 2), (5, 3), (8, 4)]
    assert lookalike.look_alike_links(links.limit(0), pages.limit(0)).count() == 0
    assert lookalike.canonical_names(links, pages).where("form is null").count() == 0


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("A sentence.", "whole"), ("It ends…", "cut"), ("It ends �", "cut"), ("```\ncode", "cut"), ("x.\n```\ncode\n```", "whole"), ("| a | b |\n| c | d", "cut"), ("| a | b |\n| c | d |", "whole"),
        ("See [[War", "cut"), ("Done! 🙂", "whole"), ("“Quoted.”", "whole"), ("- an item", "item"), ("opened 737.", "number"), ("the end of the", "prose"), ("Marwick, 10 May 2025", "whole"), ("---\ntitle: A", "cut"),
    ],
)
def test_endings(text, state):
    assert truncation.ending(text)["state"] == state


def test_blank_endings():
    assert truncation.ending(None) is None and truncation.ending(" \n\t") is None


def test_truncation_on_tables(spark):
    from lorewell.session import Scratch

    whole = [f"The keepers cleaned shelf number {i} of the northern gate before the fair. Nobody had seen the binder at noon." for i in range(40)]
    rows = [(i, "s", t) for i, t in enumerate(whole)]
    rows += [(100, "s", whole[3][:70]), (101, "s", "The keepers cleaned the bin"), (102, None, None), (103, "s", ""), (104, "s", "  "), (105, None, whole[5]), (105, None, whole[5]), (106, "s", "word " * 100_000 + "end.")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, source string, text string, cut int, key int")
    decided = truncation.decided(docs, Scratch(spark))
    cut = {r["doc_id"] for r in decided.where("cut").collect()}
    assert cut == {100, 101} and decided.where("doc_id in (102, 103, 104)").count() == 0
    assert {r["doc_id"] for r in truncation.prefix_copies(docs).collect()} == {100}
    rates = {r["source"]: (r["texts"], r["cut"]) for r in truncation.source_rates(decided).collect()}
    assert rates["s"] == (43, 2)
    assert truncation.decided(docs.limit(0), Scratch(spark)).count() == 0


def test_prefix_copies_of_short_texts_and_of_one_letter(spark):
    from lorewell.llm import truncation

    long = "The keeper of the northern gate at Marwick cleaned the lanterns"
    texts = ["Committee of the nor", "Committee of the northern gate", "Closed for the fair", "Closed for the fair.", "Binder", "Binder", long, long + "s", long + "s.", "Gone…", "Gone", "Gone home", "Plain words", "", " ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in truncation.prefix_copies(docs).collect()} == {0, 6, 9, 10}
    assert truncation.prefix_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", ["1", "7"])
def test_prefix_copies_are_brute_force(spark, parts):
    """Many texts with one header, nested prefixes, lone closing stops, and more parts than chains."""
    import random

    rng = random.Random(int(parts))
    header = "Minutes of the meeting of the keepers of the northern gate at Marwick. "
    whole = [header + " ".join(rng.choice(["oar", "keel", "sail", "bay"]) for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".", "!"]) for _ in range(150)]
    texts = [t[: rng.randrange(1, len(t) + 1)] for t in whole for _ in range(2)] + whole + [header.strip(), header.strip()[:-1], "a", "a.", "a!", "a. b"]
    bare = [t.rstrip(" ") for t in texts]
    wanted = {i for i, t in enumerate(bare) if t and any(len(o) > len(t) and o.startswith(t) and o[len(t) :] not in set(".!?。！？؟।") for o in bare)}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(r["doc_id"] for r in truncation.prefix_copies(docs).collect()) == sorted(wanted)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_block_counts_are_those_of_a_plain_count():
    from collections import Counter

    import numpy as np

    lines = ["“The keepers” of Marwick cleaned 12 gates. They left.", "- AB-12 was it, 3.5 of 1200", "日本 は 良い", "...", "x", "The keepers of Marwick cleaned"]
    block = truncation._Block(np.full(1 << (truncation.MAP_BITS - 3), 255, np.uint8))
    seen, ends, last = Counter(), Counter(), Counter()
    for n, line in enumerate(lines):
        block.add(line, n == 5)
        found, masks = truncation._tokens(line)
        most = len(masks)
        while most and not masks[most - 1][0].isalnum():
            most -= 1
        for i in range(most):
            if masks[i][0].isalnum():
                end = i == most - 1 or masks[i + 1] in truncation._STOPS
                for k in range(min(i, 2) + 1):
                    run = " ".join(masks[i - k : i + 1])
                    seen[run] += 1
                    ends[run] += end
                    last[run] += n == 5 and i == most - 1
    got = {r.unit: (r.seen, r.ends, r.last) for r in block.rows().itertuples() if r.kind == "run"}
    assert got == {u: (seen[u], ends[u], last[u]) for u in seen}


def test_map_of_asked_runs(spark):
    ends = spark.createDataFrame([([0, 5, 32767, 32768],), ([5, (1 << truncation.MAP_BITS) - 1],), ([],), (None,)], "places array<long>")
    found = truncation.asked_runs(ends)
    assert len(found) == 1 << (truncation.MAP_BITS - 3)
    assert {i * 8 + b for i, x in enumerate(found) if x for b in range(8) if x >> b & 1} == {0, 5, 32767, 32768, (1 << truncation.MAP_BITS) - 1}
