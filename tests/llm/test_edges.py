"""Every operator and pipeline stage on odd rows: null ids, texts, languages and sources, empty and very long texts and
words, ties, repeated rows, empty tables, and extra columns with the names that the operators use inside."""

import base64
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from residua.llm import ann, decontaminate, langid, lines, near_dup, pieces, quality, substrings, token_counts, warc
from residua.llm.queries import tokenizer
from tests.llm.test_corpus import prose

NAMES = """doc begins sizes _doc gone _gone bad _bad kept _kept hit at r1 r2 h1 h2 line site ids v n cell part block far p query_id
bucket kind body start src_doc src_start shift path root component a b c key id label share class sig token size word words count
language_ score_ source2 item cosine common spot asked rank x w""".split()
WORDS = {"en": "the of and that with from this there", "de": "der die und nicht ist auch wenn über"}
LONG = prose(9, 30_000)
ROWS = [
    *((i, prose(i, 40, WORDS[k].split()), k, f"s{i % 12}") for i, k in enumerate(["en", "de"] * 20)),
    (None, prose(1000, 40), "en", "s1"),
    (None, None, None, None),
    (100, None, "de", "s1"),
    (101, "", "en", None),
    (102, " \t\r\n\x0b ", None, "s2"),
    (103, LONG, "en", "s3"),
    (104, LONG, "en", "s4"),
    (105, "y" * 400_000, "de", "s5"),
    (106, "same text of the twins here now", "en", "s6"),
    (106, "same text of the twins here now", "en", "s6"),
    (107, prose(2000, 50), "en", "s6"),
    (107, prose(2001, 50), "de", "s7"),
    (-5, "12 34 !? \U0001f642", "en", "s7"),
]
ITEMS = [(1, "a passage of ten words that no document holds anywhere"), (1, "a passage of ten words that no document holds anywhere"), (None, "x"), (2, None), (3, "")]


def documents(spark):
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, len(r[1] or ""), *["z"] * len(NAMES)) for r in ROWS], ddl).repartition(3)


def benchmark(spark):
    return spark.createDataFrame([(*r, "z", "z") for r in ITEMS], "item_id bigint, text string, id string, doc string")


def rows_of(df, columns):
    return Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    path = tmp_path_factory.mktemp("v") / "v"
    path.write_bytes(b"\n".join(base64.b64encode(v) + b" 0" for v in (b" a", b" ab", b"b", b" ")))
    return str(path)


def added(spark, docs, vocabulary):
    """Operators that give every row back."""
    model = "piece_bpe_32k.model"
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 0), (None, 1), (107, None)], "doc_id bigint, quality int")
    return {
        "langid": lambda d: langid.identify(d, langid.train(docs), into="out"),
        "quality": lambda d: quality.score(d, quality.train(docs, labels), into="out"),
        "tokens": lambda d: token_counts.count(d, vocabulary, into="out"),
        "digest": lambda d: pieces.digest(d, tokenizer(model), into="out"),
        "encode": lambda d: pieces.encode(d, tokenizer(model), into="out"),
        "substrings": lambda d: substrings.without_repeats(d),
        "lines": lambda d: lines.remove(d),
    }


@pytest.mark.parametrize("name", ["langid", "quality", "tokens", "digest", "encode", "substrings", "lines"])
def test_rows_and_columns_pass(spark, vocabulary, name):
    docs = documents(spark)
    run = added(spark, docs, vocabulary)[name]
    assert rows_of(run(docs), docs.columns) == rows_of(docs, docs.columns)
    empty = run(docs.limit(0))
    assert empty.count() == 0 and set(docs.columns) <= set(empty.columns)


@pytest.mark.parametrize("name", ["near-dup", "clean"])
def test_filters_keep_the_rest_as_it_is(spark, name):
    docs = documents(spark)
    run = {"near-dup": lambda d: near_dup.kept(d), "clean": lambda d: decontaminate.clean(d, benchmark(spark))}[name]
    left, all_ = rows_of(run(docs), docs.columns), rows_of(docs, docs.columns)
    gone = sorted(r[0] for r in (all_ - left).elements())
    assert not left - all_ and gone == ([104] if name == "near-dup" else [])
    assert run(docs.limit(0)).count() == 0 and run(docs.limit(0)).columns == docs.columns


def test_components_have_a_row_for_each_document(spark):
    got = near_dup.components_of(documents(spark)).collect()
    assert Counter(r.id for r in got) == Counter(r[0] for r in ROWS)
    assert all(r.component == (103 if r.id == 104 else r.id) for r in got)


def test_matches_of_odd_items(spark):
    docs = documents(spark)
    assert decontaminate.matches(docs, benchmark(spark)).count() == 0
    assert decontaminate.matches(docs, benchmark(spark).limit(0)).count() == 0
    held = spark.createDataFrame([(7, ROWS[0][1], "z")], "item_id bigint, text string, doc string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, held).collect()} == {(0, 7)}


def test_archives_of_odd_pages(spark, tmp_path):
    rows = [(1, "u", b"", "z"), (2, None, None, "z"), (None, "u v\r\nw", b"x", "z"), (3, "u", b"x", "z"), (4, "u", b"\xff\x00" * 300_000, "z"), (5, "u", b"\xff\x00" * 300_000, "z")]
    pages = spark.createDataFrame(rows, "id bigint, url string, payload binary, name string")
    warc.write(pages, str(tmp_path / "a"), segment=1 << 16)
    got = {(r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.records(warc.read(spark, str(tmp_path / "a"))).collect()}
    assert got == {(2, "response", None, 0), (1, "revisit", 2, 0), (3, "response", None, 1), (None, "revisit", 3, 1), (5, "response", None, 600_000), (4, "revisit", 5, 600_000)}


def test_vectors_with_clashing_columns(spark):
    rng = random.Random(1)
    vectors = [[float(rng.choice((-1, 0, 1))) for _ in range(4)] for _ in range(60)]
    names = [n for n in NAMES if n not in ("vec_id", "embedding")]
    ddl = "vec_id bigint, embedding array<double>, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame([(i, v, *["z"] * len(names)) for i, v in enumerate(vectors)], ddl)
    got = {}
    for r in ann.search(df, df.vec_id % 10 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    for q in range(0, 60, 10):
        a = np.array(vectors[q])
        if not a.any():
            assert q not in got
            continue
        s = {i: a @ b / np.linalg.norm(a) / np.linalg.norm(b) for i, b in enumerate(map(np.array, vectors)) if i != q and b.any()}
        want = sorted(s, key=lambda i: (-round(s[i], 12), i))[:5]
        assert [got[q][k][0] for k in range(1, 6)] == want


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, tmp_path, name, stage):
    docs = documents(spark)
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and not rows_of(out, ["doc_id", "lang"]) - rows_of(docs, ["doc_id", "lang"])
    assert {r.doc_id for r in out.collect()} >= {103, 107} and stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_last_stage(spark):
    out = corpus_pipeline.sentence_pieces(spark, documents(spark), "")
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in ROWS)


def _hash(runs, mul, bits):
    return [(((x + (k << 24)) * mul) & 0xFFFFFFFF) >> (32 - bits) for k, x in runs]


def _mean(data, weights, mul, bits):
    """Mean weight of the runs of one to three bytes, one at a time."""
    total = 0.0
    for i, one in enumerate(data):
        two = data[i - 1] << 8 | one if i else 0
        three = data[i - 2] << 16 | two if i > 1 else 0
        total = total + sum(weights[h] for h in _hash(((1, one), (2, two), (3, three)), mul, bits))
    return total / (3 * len(data))


def test_languages_equal_a_plain_prediction(spark):
    docs = documents(spark)
    model = langid.train(docs)
    texts = [prose(k, 25, (WORDS["en"] + " " + WORDS["de"]).split()) for k in range(12)] + ["A", "über 1,5", "y" * 50]
    letters = [32 if b < 128 and not chr(b).isalpha() else ord(chr(b).lower()) if b < 128 else b for b in range(256)]
    sigmoid = lambda z: 1 / (1 + math.exp(-4 * z))
    names, scores = model.predict(pa.array(texts))
    for t, name, score in zip(texts, names, scores, strict=True):
        s = _mean([letters[b] for b in f" {t.lower()} ".encode()], model.weights.astype(float), 2654435761, langid.BITS) + model.bias
        families = s[: len(model.families)]
        sure = sigmoid(max(families)) if len(families) > 1 else 1.0
        margin = s[len(families)]  # the one pair, de against en
        assert model.pairs == [("de", "en")]
        assert name == ("de" if margin >= 0 else "en") and score == pytest.approx(min(sure, sigmoid(abs(margin))), abs=1e-5)


def test_quality_equals_a_plain_score(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    model = quality.train(documents(spark), labels)
    texts = [None, "", "Plain text, with 12 marks!", prose(3, 30), "ÜX" * 40]
    for t, score in zip(texts, model.score(pa.array(texts, pa.string())), strict=True):
        data = [48 if 49 <= b < 58 else b for b in f"\n{t or ''}\n".encode()]
        z = model.curve[0] * (_mean(data, model.weights.astype(float), 2246822519, quality.BITS) + model.bias) + model.curve[1]
        assert score == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, z)))), abs=1e-5)


def test_sums_of_cells_equal_plain_sums():
    """Cells of eight places, the last of a document cut short; words without a slot weigh nothing."""
    from residua.llm.decontaminate import CELLS, _cell_sums

    rng = np.random.default_rng(5)
    cells = 2 * CELLS + 9
    places = np.flatnonzero(rng.random(8 * cells) < 0.8)
    slots, weights = rng.integers(-1, 40, len(places)).astype(np.int32), rng.random(len(places)).astype(np.float32)
    latent = rng.standard_normal((40, 6)).astype(np.float32)
    want = np.zeros((cells, 6))
    for at, k, w in zip(places // 8, slots, weights, strict=True):
        want[at] += latent[k] * w if k >= 0 else 0
    assert np.allclose(_cell_sums(latent, slots, weights, places, cells, 8), want, atol=1e-5)


def test_words_equal_plain_words(monkeypatch):
    """Dropped signs within words, empty texts, words as long as a chunk of letters and longer; hashes are plain sums."""
    from residua.llm.common import ODD, mixed

    rng = random.Random(7)
    texts = [None, "", "-", "it's", " a-b€ c ", "x" * 50, "été ÉTÉ\n."] + ["".join(rng.choice("aBé \n.-'1_") for _ in range(rng.randrange(40))) for _ in range(200)]
    want = [[x for x in ("".join(c for c in w if c.isalnum()).encode() for w in re.split(r"[ \t-\r]+", (t or "").lower())) if x] for t in texts]
    for letters in (16, decontaminate.LETTERS):
        monkeypatch.setattr(decontaminate, "LETTERS", letters)
        terms = decontaminate._terms(pa.array(texts, pa.string()))
        assert [terms.shown(a, b) for a, b in zip(terms.offsets[:-1], terms.offsets[1:], strict=True)] == want
        plain = [sum((c + 1) * pow(int(ODD), k, 1 << 64) for k, c in enumerate(w)) % (1 << 64) for x in want for w in x]
        assert np.array_equal(terms.hashed, mixed(np.array(plain, np.uint64)))


def test_sums_of_weighed_rows_equal_those_with_weights():
    from residua.llm.decontaminate import CELLS, _cell_sums

    rng = np.random.default_rng(6)
    cells = CELLS + 30
    places = np.flatnonzero(rng.random(8 * cells) < rng.random(8 * cells))
    slots = rng.integers(-1, 40, len(places)).astype(np.int32)
    latent, weights = rng.standard_normal((40, 6)).astype(np.float32), rng.random(40).astype(np.float32)
    want = _cell_sums(latent, slots, weights[slots], places, cells, 8)
    assert np.array_equal(_cell_sums(latent * weights[:, None], slots, None, places, cells, 8), want)


def test_stretches_with_too_few_words_of_an_item_are_not_compared(monkeypatch):
    """The same best stretch as that of all stretches, but only those are compared that hold enough of the item's words."""
    made = []
    real = decontaminate._common
    monkeypatch.setattr(decontaminate, "_common", lambda size, found: made.append(len(found)) or real(size, found))
    item, other = [f"w{k}".encode() for k in range(20)], [b"z"] * 4000
    assert decontaminate.best_stretch(item, other + item[:9] + other, 10)[0] == 0 and not made
    text = other + item[:18] + other
    want = max((decontaminate.subsequence(item, x), -a) for a, x in decontaminate.stretches(item, text))
    made.clear()
    assert decontaminate.best_stretch(item, text, 10) == (*want, 30) and want[0] == 18
    assert len(made) < 20
