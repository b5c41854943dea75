import pytest
from hypothesis import given, settings, strategies as st

from lorewell.llm import mixing, tokens

ENC = tokens.encoder(tokens.rank_file())


def stitched(text, chunk, overlap):
    """The pieces of the operator's rules, in plain Python."""
    spans = tokens.windows(len(text), chunk, overlap)
    found = [set(b + x for x in tokens.stitch_points(text[b:e], e == len(text))) for b, e in spans]
    cuts = [0]
    for k in range(len(spans) - 1):
        begin = spans[k + 1][0]
        shared = {x for x in found[k] if x >= begin} & {x for x in found[k + 1] if x < begin + overlap}
        if shared:
            cuts.append(min(shared))
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


@given(st.text(alphabet="ab 's1\n!é안\u3000tre", max_size=120), st.integers(6, 12), st.integers(3, 5))
@settings(max_examples=300, deadline=None)
def test_stitching_is_exact(text, chunk, overlap):
    ids = [i for piece in stitched(text, chunk, overlap) for i in ENC.encode_ordinary(piece)]
    assert ids == ENC.encode_ordinary(text) and tokens.decode(ids) == text


def test_encoded_on_tables(spark):
    texts = {1: "Hello world's end", 2: "", 3: None, 4: "many words here, " * 400, 5: "x" * 5000, 6: " \n" * 900, 7: "안녕 " * 800, 8: "<|endoftext|>"}
    docs = spark.createDataFrame([(k, t, "c", 0) for k, t in texts.items()], "doc_id long, text string, ids string, k int")
    for options in ({}, {"chunk": 256, "overlap": 16}):
        got = {r["doc_id"]: r["ids"] for r in tokens.encoded(docs, **options).collect()}
        assert got == {k: None if t is None else ENC.encode_ordinary(t) for k, t in texts.items()}
    assert all(tokens.decode(got[k]) == t for k, t in texts.items())
    assert tokens.encoded(docs.limit(0)).count() == 0
    counts = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(docs).collect()}
    assert counts[2] == counts[3] == 0 and counts[1] == len(got[1])


def test_same_vocabulary_in_another_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{tokens.vocabulary_folder()}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in ("It's 12 o'clock — naïve 안녕 🙂\n\n  x", "<|endoftext|>"):
        assert other.encode(text, add_special_tokens=False).ids == ENC.encode_ordinary(text)


def test_water_fill():
    fill = mixing.water_fill
    assert fill({"a": 10, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 2}, 100) == {"a": 20, "b": 80}
    assert fill({"a": 10}, {"a": 1, "b": 1}, {"a": 1, "b": 9}, 100) == {"a": 10, "b": 0}
    assert fill({"a": 5, "b": 5}, {"a": 0, "b": 2}, {"a": 1, "b": 1}, 4) == {"a": 0, "b": 4}
    assert fill({}, {"a": 1}, {"a": 1}, 0) == {"a": 0}


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 5), st.integers(0, 4)), min_size=1, max_size=6), st.integers(0, 400))
@settings(max_examples=200, deadline=None)
def test_water_fill_is_fair(rows, total):
    sizes, weights, repeats = ({str(i): r[k] for i, r in enumerate(rows)} for k in range(3))
    given_ = mixing.water_fill(sizes, weights, repeats, total)
    assert all(given_[s] <= sizes[s] * repeats[s] + 1e-6 for s in given_) and sum(given_.values()) <= total + 1e-6 or sum(given_.values()) <= sum(sizes[s] * repeats[s] for s in sizes) + 1e-6
    open_ = [s for s in given_ if weights[s] and given_[s] < sizes[s] * repeats[s] - 1e-6]
    assert len({round(given_[s] / weights[s], 6) for s in open_}) <= 1


def test_mixture_on_tables(spark):
    rows = [(i, "big", 10) for i in range(1000)] + [(2000 + i, "small", 10) for i in range(20)] + [(3000, None, 5), (3001, "other", 50), (3002, "small", 0), (3003, "small", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, tokens long, copies int")
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.4, 3), ("small", 0.4, 3), ("none", 0.1, 2), ("zero", 0.0, 1), (None, 1.0, 1), ("nulls", None, None)], "source string, weight double, max_repeats int")
    mixed = mixing.mixture(docs, targets)
    used = {}
    for r in mixed.collect():
        used.setdefault(r["source"], []).append((r["tokens"], r["copies"]))
    assert set(used) == {"big", "small"} and max(c for _, c in used["small"]) == 3 and max(c for _, c in used["big"]) <= 2
    assert sum(t * c for t, c in used["small"]) == 600 and abs(sum(t * c for t, c in used["big"]) - 9600) <= 10
    shares = {r["source"]: r for r in mixing.shares(mixed, docs, targets).collect()}
    assert set(shares) == {"big", "small", "none", "zero", "nulls"} and shares["zero"]["used_tokens"] == 0 == shares["none"]["used_tokens"]
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    assert sorted(map(tuple, mixing.mixture(docs.repartition(7), targets).collect())) == sorted(map(tuple, mixed.collect()))
    assert mixing.mixture(docs.limit(0), targets).count() == 0 and mixing.mixture(docs, targets.limit(0)).count() == 0
