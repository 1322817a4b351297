"""Lexical search, byte-level BPE and the Merkle manifest against plain Python, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from residua.llm import bpe, lexical, merkle
from residua.llm.common import held_out
from residua.llm.queries import tokenizer
from tests.compare import oracle, shown
from tests.llm.test_corpus import TEXTS, frame, prose
from tests.llm.test_edges import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def ranking(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    for item, own in wanted.items():
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:top], 1)]
    return out


WORDY = ["Ab ab-AB_ab.ab", "naïve Naïve ÄÖ äö", "1st 2nd 1st", "ab1 ab 1ab", None, "", "...", "日本語 テキスト", "x" * 3000 + " ab", *(prose(k, 80) for k in range(40)), *(prose(3, 80) for _ in range(15))]
ASKED = [(1, "AB 1st naïve"), (1, "äö"), (2, prose(3, 12)), (3, None), (4, "?!"), (None, "日本語 ab"), (5, "nobody-holds this0"), *((10 + k, prose(k, 6)) for k in range(8))]


@pytest.mark.parametrize("block_bytes,cells", [(4 << 20, 1 << 22), (700, 40)])
def test_lexical_search_equals_plain_ranking(spark, monkeypatch, block_bytes, cells):
    """In one block, and with a pair of scans for almost every item."""
    monkeypatch.setattr(lexical, "CELLS", cells)
    ids = [*range(len(WORDY) - 2), None, 0]
    docs = frame(spark, WORDY, ids).repartition(5)
    items = spark.createDataFrame([(*r, "z", "z") for r in ASKED], "item_id bigint, text string, item string, term string")
    got = [tuple(r) for r in lexical.rank(docs, items, block_bytes=block_bytes).select("item_id", "rank", "doc_id", "score").collect()]
    assert Counter(got) == Counter(ranking(zip(ids, WORDY, strict=True), ASKED))
    assert block_bytes > 700 or lexical.blocks_of(lexical.terms_of(items), block_bytes) > 2
    assert not lexical.rank(docs.limit(0), items).count() and not lexical.rank(docs, items.limit(0)).count()


def test_long_text_is_scanned_in_parts(monkeypatch):
    monkeypatch.setattr(lexical, "SCAN_BYTES", 16)
    texts = [prose(1, 200), "", None, "y" * 500, "alpha" * 9 + " alpha1 alpha1"]
    own = ("alpha1", "beta3", "y" * 500)
    n, doc, term, times = lexical._scanned(pa.array(texts), own)
    assert n.tolist() == [len(terms(t)) for t in texts]
    assert {(d, own[t]): k for d, t, k in zip(doc, term, times, strict=True)} == {(d, t): k for d, x in enumerate(texts) for t, k in Counter(terms(x)).items() if t in own}


MODEL = tokenizer("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


def mixture(seed, n):
    """Text with long runs that nothing splits, blanks of many kinds, marks, and the special token's string."""
    r = random.Random(seed)
    parts = ["a", "the", "éa", "日本", "🙂", "  ", " ", "\n", "\t", " ", "　", " ", "12", "'s", "'", "!!", "<|endoftext|>", "_", "ab", "\x00", "\x85", "é", "aaaa", "ðŸ"]
    return "".join(r.choice(parts) * r.choice((1, 1, 1, 2, 30)) for _ in range(n))


def test_bpe_equals_the_library(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = [*TEXTS, "<|endoftext|>", " <|endoftext|> x", "a    b", "  x", *(mixture(s, 150) for s in range(60)), prose(5, 9000), mixture(1000, 4000), "ab" * 9000 + "🙂" * 5000, " " * 40_000 + "x", "é" * 30_000]
    docs = frame(spark, [*texts, texts[-1]])
    lib = library()
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in [*texts, texts[-1]]]
    for big in (bpe.BIG, 20_000):
        got = {r.doc_id: r for r in bpe.digest(docs, MODEL, big=big).select("doc_id", "encoded.*").collect()}
        for i, ids in enumerate(want):
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))), i
    coded = bpe.encode(docs, MODEL)
    assert {r.doc_id: r.ids for r in coded.select("doc_id", "ids").collect()} == dict(enumerate(want))
    assert all((t or "") == d for t, d in bpe.decode(coded, MODEL).select("text", "decoded").collect())
    assert bpe.digest(docs.limit(0), MODEL).count() == 0
    odd = spark.createDataFrame([([64, 10_000_000, -1],), (None,), ([171],), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, MODEL).collect()] == [lib.decode([64]), "", "�", ""]


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 5000, "abcdefghij" * 1000, "!?" * 4000, " " * 9001, "7" * 5000, "🙂é" * 2000, "".join(random.Random(1).choices("etaoinshrdlu", k=20_000)), "一" * 4097])
def test_halves_join_exactly(text):
    with open(MODEL, "rb") as f:
        e = bpe.Encoder(f.read())
    assert e.halved([text])[0].tolist() == library().encode(text, add_special_tokens=False).ids


def test_rows_pass_the_encoder(spark):
    docs = documents(spark)
    rows = lambda df: Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in docs.columns]).collect())
    assert rows(bpe.digest(docs, MODEL, into="out")) == rows(docs)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(digests):
    """The levels of a tree, leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_proofs(rows):
    """rows: (doc_id, source, lang, n_chars, text); a result for each."""
    leaf = lambda r: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = plain_tree([leaf(r) for r in groups[s]])
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for k, r in enumerate(groups[s]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], r[4].translate({i: i + 32 for i in range(65, 91)}) if tampered and r[4] else r[4]))
            proof = ""
            for at, levels in ((k, trees[s]), (g, top)):
                for level in levels[:-1]:
                    run, own = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += "".join(run[:own] + run[own + 1 :])
                    node = H(*run[:own], node, *run[own + 1 :])
                    at //= 16
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H(proof), node, node == top[-1][0]))
    return out


def manifest_rows(spark, rows):
    from residua.llm import queries

    docs = spark.createDataFrame([(*r, "z", "z", "z") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, digest string, `group` string")
    return docs, queries


@pytest.mark.parametrize("sizes", [[1], [300], [1, 16, 17, 1, 257, 40], [3] * 20, [0]])
def test_manifest_equals_a_plain_tree(spark, tmp_path, sizes):
    rows, r = [], random.Random(len(sizes))
    for g, n in enumerate(sizes):
        for _ in range(n):
            source = None if g == 1 else ["", "a", "é", "z\U0001f642", "Z"][g] if g < 5 else f"s{g}"
            rows.append((r.choice((None, *range(900))), source, r.choice((None, "en")), r.randrange(9), r.choice((None, "", "Ab CD", "éÉ", prose(r.randrange(9), 5).title()))))
    docs, queries = manifest_rows(spark, rows + rows[:3])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(x) for x in queries.op13_merkle(spark, str(tmp_path)).select(columns).collect()]
    assert Counter(got) == Counter(plain_proofs(rows + rows[:3]))
    if rows:
        import duckdb

        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert Counter(c.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP13_SQL})").fetchall()) == Counter(got)


def test_requested_leaves_and_the_store(spark):
    rows = [(k, f"s{k % 3}", "en", k, f"Text {k}") for k in range(700)]
    docs, _ = manifest_rows(spark, rows)
    manifest = merkle.build(docs)
    asked = manifest.leaves.filter("id in (5, 333)")
    all_ = {r.id: r for r in merkle.proofs(manifest).collect()}
    some = {r.id: r for r in merkle.proofs(manifest, asked).collect()}
    assert set(some) == {5, 333} and len(all_) == 700 and all(some[k] == all_[k] for k in some)
    store = {bytes(r.digest): bytes(r.children) for r in manifest.store().collect()}
    assert all(hashlib.sha256(v.hex().encode()).digest() == k for k, v in store.items())
    held = {v[k : k + 32] for v in store.values() for k in range(0, len(v), 32)}
    assert {bytes(r.leaf) for r in all_.values()} <= held and {bytes(r.root) for r in all_.values()} == set(store) - held
    good = merkle.proofs(manifest).select((merkle.folded(F.col("leaf"), F.col("segments")) == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in good)


def test_new_queries_equal_their_sql(spark):
    from residua.llm import queries

    sf = "/root/testdata/sf0.001"
    for name in ("op11_lexical", "op13_merkle"):
        assert shown(queries.QUERIES[name](spark, sf).toPandas()) == shown(oracle(queries.ORACLES[name], sf)), name
