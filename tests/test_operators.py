import pytest
from pyspark.sql import functions as F

from lorewell.operators import duplicates, graph, lengths, parse, resolve
from lorewell.plans import report
from lorewell.plans.wiki import Wiki
from lorewell.sources import notes

FILES = "page_id long, vault string, rel_file string, content string, received_at timestamp"


def wiki(spark, files, nested=False):
    rows = [(i, "v", name, text, None) for i, (name, text) in enumerate(files.items())]
    return Wiki(spark.createDataFrame(rows, FILES), nested)


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.fixture(scope="module")
def chain(spark):
    return wiki(spark, {"A.md": "[[C]] [[B]] [[A]]", "B.md": "[[D]]", "C.md": "[[D]] x", "D.md": "d", "E.md": "[[F]]", "F.md": "f", "G.md": "[[G]] [[X#a]] [[X#b]] [[x]]", "H.md": "[[I]]", "I.md": ""})


def test_path_takes_first_names(chain):
    pairs = chain.spark.createDataFrame([(0, 3), (0, 0), (0, 4)], "source long, target long")
    assert rows(chain.paths(pairs), "source", "target", "distance", "path") == [(0, 0, 0, [0]), (0, 3, 2, [0, 1, 3])]
    with pytest.raises(LookupError):
        report.path(chain, 0, 4)
    # Pairs without a path end the search beside others that have one; a page without links reaches itself alone.
    many = chain.spark.createDataFrame([(0, 4), (4, 5), (6, 0), (3, 0), (6, 6), (7, 3), (2, 1)], "source long, target long")
    assert rows(chain.paths(many), "source", "target", "path") == [(2, 1, [2, 0, 1]), (3, 0, [3, 1, 0]), (4, 5, [4, 5]), (6, 6, [6])]


def test_components_and_lint(chain):
    sizes = rows(chain.component_sizes(), "place", "component", "pages")
    assert sizes == [(1, 0, 4), (2, 4, 2), (3, 7, 2)]
    assert rows(chain.orphans(), "page_id") == [(6,)]
    row = chain.lint().first()
    assert (row["documents"], row["orphans"], row["islands"], row["largest"], row["covered"]) == (9, 1, 2, 4, 8)
    assert (row["largest_component_ratio"], row["orphan_rate"]) == (4 / 9, 1 / 9)


def test_only_orphans_and_nothing(spark):
    assert wiki(spark, {"A.md": "a", "B.md": "b"}).lint().first()["largest"] == 1
    assert wiki(spark, {"A.md": "a"}).largest().count() == 0
    empty = Wiki(spark.createDataFrame([], FILES))
    assert empty.lint().count() == 0 and report.lint(empty)[1] is False and empty.components.count() == 0


def test_self_link_and_wanted(chain):
    out = rows(chain.outgoing().where("src_page = 6"), "missing", "name")
    assert out == [(False, "G"), (True, "X#a"), (True, "X#b"), (True, "x")]
    assert rows(chain.wanted(), "name", "mentions", "docs") == [("X", 3, 1)]
    assert report.wanted_list(chain).startswith("[[X]] (3 links)\n\n- [[G]]: [[G]] [[X#a]]")


def test_lookup(spark):
    w = wiki(spark, {"A.md": "---\ntitle: One\naliases: [Both, Own]\n---\n", "B.md": "---\naliases: Both\n---\n[[One]]"})
    assert w.find("a", "v") == 0 and w.find("own", "v") == 0
    with pytest.raises(LookupError, match="ambiguous"):
        w.find("both", "v")
    with pytest.raises(LookupError, match="not found"):
        w.find("zzz", "v")
    assert w.edges.count() == 0  # titles and aliases are for look-up, links go by name


def test_duplicate_names(spark):
    with pytest.raises(ValueError, match='duplicate document names "x/Ab"'):
        wiki(spark, {"C.md": "", "x/Ab.md": "", "aB.md": "", "z/ab.md": "", "z/c.md": ""}).check()


def test_nested_resolution(spark):
    w = wiki(spark, {"N.md": "", "x/N.md": "", "a/b/M.md": "[[N]] [[x/N]] [[../N]] [l](N.md) [[../../N]] [[sub/Z]]", "a/b/N.md": "", "a/b/sub/Z.md": ""}, nested=True)
    assert [r["resolved"] for r in w.links.orderBy("link_pos").collect()] == [0, 1, None, 0, 4, 3]


def test_latest_delivery(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    files = spark.createDataFrame([(1, "v", "A.md", "old", day(1)), (1, "v", "A.md", "new", day(2)), (1, "v", "A.md", None, day(3)), (2, "v", "B.md", None, day(1)), (None, "v", "C.md", "x", day(1))], FILES)
    assert rows(parse.latest(files), "page_id", "content") == [(1, "new"), (2, None)]
    assert rows(parse.statistics(parse.latest(files)), "page_id", "words") == [(1, 1), (2, None)]


def test_lengths(spark):
    stats = spark.createDataFrame([(1, "v", "a", 120, 5), (2, "v", "b", 1, 1200), (3, "v", "c", 1, 40), (4, "v", "d", 0, 0), (5, "v", "e", 1, 41)], "page_id long, vault string, rel_path string, visible_lines int, words int")
    assert rows(lengths.long_pages(stats), "page_id", "place") == [(1, 2), (2, 1)]
    assert rows(lengths.short_pages(stats), "page_id", "place") == [(1, 1), (3, 2)]
    assert rows(lengths.rates(stats), "long_rate", "short_rate") == [(0.4, 0.4)]


def test_posting_cap(spark):
    prints = spark.createDataFrame([(i, "v", list(range(30)), [1, 2, 3] + [100 + i]) for i in range(65)], "page_id long, vault string, shingles array<long>, winnow array<long>")
    assert duplicates.candidates(prints).count() == 0
    few = prints.where("page_id < 3")
    assert rows(duplicates.near_duplicates(few), "a", "b", "shared", "score") == [(0, 1, 30, 1.0), (0, 2, 30, 1.0), (1, 2, 30, 1.0)]


def test_sampled_pairs(spark):
    places = spark.range(1, 41).select(F.lit("v").alias("vault"), (F.col("id") * 10).alias("page_id"), F.col("id").alias("place"))
    some = rows(graph.sampled_pairs(places, 100), "source", "target")
    assert len(set(some)) == 100 and all(a < b for a, b in some)
    assert len(set(rows(graph.sampled_pairs(places, 500), "source", "target"))) == 500
    assert len(set(rows(graph.sampled_pairs(places, 5000), "source", "target"))) == 780


def test_components_brute_force(spark):
    import random

    rng = random.Random(4)
    pairs = {(rng.randrange(300), rng.randrange(300)) for _ in range(220)}
    pairs = {(a, b) for a, b in pairs if a != b}
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    both = spark.createDataFrame([("v", a, b) for a, b in pairs] + [("v", b, a) for a, b in pairs], "vault string, a long, b long")
    assert dict(rows(graph.components(both), "node", "component")) == label


def test_suggest_report(spark):
    sentence = "The same long sentence about gardens, rivers and bridges is written twice here so that two pages share nearly all of their text, word by word, from beginning to end without changes. " * 2
    w = wiki(spark, {"Alpha.md": "Alpha connects to [[Beta]] and asks for [[Missing Idea]].\n", "Beta.md": "Beta connects to [[Gamma]].\n", "Gamma.md": "Gamma completes the chain.\n", "Long.md": "One.\nTwo.\nThree.\nFour.\nFive.\n", "Stub.md": "Tiny note.\n", "Duplicate A.md": sentence, "Duplicate B.md": sentence})
    text = report.suggest(w, samples=20, paths=2, limit=5, long_lines=4, long_words=80, short_words=3, threshold=0.8)
    assert "// sampled_diameter samples=3 sampled_diameter=2 paths=2" in text
    assert "[[Missing Idea]] mentions=1 source_documents=1" in text and "[[Long]]: One. lines=5" in text
    assert "[[Stub]]: Tiny note. lines=1 words=2" in text and "[[Duplicate A]] <-> [[Duplicate B]] score=1.000" in text
    assert report.average_path(w).startswith("// avg_shortest_path component=3 samples=3 avg=1.3333\n// path distance=2")


def test_folder_and_cli(spark, tmp_path, capsys):
    from lorewell import cli

    (tmp_path / "target").mkdir()
    (tmp_path / "sub").mkdir()
    (tmp_path / "target" / "G.md").write_text("g")
    (tmp_path / "sub" / "_b.MD").write_text("* [[A]]\n")
    (tmp_path / "A.md").write_text("---\ntitle: A\n---\nSee [[_b]].\n")
    (tmp_path / ".md").write_text("no name")
    assert notes.list_notes(str(tmp_path)) == ["A.md"] and notes.list_notes(str(tmp_path), True) == ["A.md", "sub/_b.MD"]
    root = ["-root", str(tmp_path), "-r"]
    assert cli.main(["lint", *root]) == 1  # a link-only line
    assert cli.main(["rename", *root, "A", "C"]) == 0
    assert (tmp_path / "C.md").read_text() == "---\ntitle: C\n---\nSee [[_b]].\n" and not (tmp_path / "A.md").exists()
    assert (tmp_path / "sub" / "_b.MD").read_text() == "* [[C]]\n"
    assert cli.main(["format", *root]) == 0 and (tmp_path / "sub" / "_b.MD").read_text() == "- [[C]]\n"
    capsys.readouterr()
    assert cli.main(["format", *root]) == 0 and capsys.readouterr().out == "// format documents=2 changed=0\n"
    assert cli.main(["path", *root, "C", "sub/_b"]) == 0
    assert capsys.readouterr().out == "[[C]]: See [[_b]].\n[[sub/_b]]: - [[C]]\n"
    assert cli.main(["links", *root, "C"]) == 0 and cli.main(["wanted", *root]) == 0
    assert cli.main(["nothing"]) == 2 and cli.main([]) == 2 and cli.main(["path", *root, "C"]) == 1 and cli.main(["lint", "-x"]) == 1
    assert cli.main(["suggest", *root, "--filter=nope"]) == 1 and cli.main(["version"]) == 0


def test_streams(spark, data, tmp_path):
    from lorewell.streaming import notes as streams

    files = spark.read.parquet(f"{data}/files.parquet")
    files.write.parquet(str(tmp_path / "in"))
    stream = streams.statistics_stream(streams.read_stream(spark, str(tmp_path / "in"), files.schema))
    query = stream.writeStream.format("memory").queryName("stats").start()
    query.processAllAvailable()
    query.stop()
    got = {r["page_id"]: r["norm"] for r in spark.table("stats").collect()}
    assert got == {r["page_id"]: r["norm"] for r in spark.read.parquet(f"{data}/page_stats.parquet").collect() if r["norm"] is not None and r["page_id"] in got}
    assert len(got) > 10


def test_files_are_read_and_shuffled_once(spark, data):
    """One scan and one exchange for statistics and fingerprints; sizes shuffle no text."""
    w = Wiki.of_tables(spark, data)
    for frame, scans in ((w.statistics, 1), (w.fingerprints, 1), (w.sizes, 1)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == scans and plan.count("Exchange hashpartitioning") == 1
    optimised = w.sizes._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in optimised.split("MapInPandas")[0]


def test_object_store(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "target").mkdir()
    for name, text in (("A.md", "a [[b]]"), ("sub/b.MD", "b"), ("target/G.md", "g"), ("c.txt", "c")):
        (tmp_path / name).write_text(text)
    found = notes.read_object_store(spark, str(tmp_path), nested=True)
    assert rows(found, "rel_file", "content") == [("A.md", "a [[b]]"), ("sub/b.MD", "b")]
    assert rows(notes.read_object_store(spark, str(tmp_path)), "rel_file") == [("A.md",)]
    folder = notes.read_folder(spark, str(tmp_path), nested=True)
    assert rows(Wiki(found, True).documents, "name", "excerpt") == rows(Wiki(folder, True).documents, "name", "excerpt")
    (tmp_path / "sub" / "_hidden.md").write_text("h")
    with pytest.raises(ValueError, match="1 notes have names"):
        notes.read_object_store(spark, str(tmp_path), nested=True)


def test_places_over_many_parts(spark):
    frame = spark.createDataFrame([("v" if i % 3 else "w", f"k{i}", f"Name {i % 7}", i % 5, i % 2) for i in range(200)], "vault string, target_key string, name string, mentions int, docs int")
    from lorewell.operators import wanted

    whole = {r["target_key"]: r["place"] for r in wanted.ranked(frame).collect()}
    limited = {r["target_key"]: r["place"] for r in wanted.ranked(frame, 1000).collect()}
    assert whole == limited and len(whole) == 200


def test_views(chain):
    assert set(chain.register_views("t_")) == {"t_" + name for name in Wiki.VIEWS}
    found = chain.spark.sql("SELECT d.name, count(*) AS n FROM t_edges e JOIN t_documents d ON d.page_id = e.dst GROUP BY d.name HAVING count(*) > 1")
    assert rows(found, "name", "n") == [("D", 2)]
    assert chain.spark.sql("SELECT sum(words) FROM t_sizes").first()[0] == chain.spark.sql("SELECT sum(words) FROM t_statistics").first()[0]
