"""Corpus operators on small fixtures against brute force: nulls, empty and very long texts, ties, repeated rows, empty
tables and clashing column names."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.llm import ann, components, decontaminate, langid, lines, near_dup, pieces, quality, substrings, token_counts, warc
from residua.llm.common import held_out
from residua.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n, vocab=VOCAB):
    r = random.Random(seed)
    return " ".join(r.choice(vocab) + str(r.randrange(40)) for _ in range(n))


def frame(spark, texts, ids=None):
    """With extra columns whose names clash with those of the operators."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "k", 0, "s") for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, key string, n int, source string")


TEXTS = [None, "", "  \t\n", "one", "Ünïcödé ▁ mark  two  blanks ", " lead", "a\nb\r\n\x0b c", prose(1, 3000), prose(1, 3000), "x" * 5000, "日本語 テキスト 🙂\x00"]


def test_sentence_pieces_equal_the_library(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in pieces.digest(frame(spark, TEXTS), path).select("doc_id", "encoded.*").collect()}
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
        assert got[i].span_bytes == len((t or "").encode())
    spans = pieces.encode(frame(spark, TEXTS), path).select("doc_id", "text", "pieces").collect()
    for r in spans:
        data = (r.text or "").encode()
        assert [p.id for p in r.pieces] == sp.encode(r.text or "")
        assert got[r.doc_id].widest_span == max((p.end - p.begin for p in r.pieces), default=0)
        assert "".join(data[p.begin : p.end].decode() for p in r.pieces) == (r.text or "")
    ids = spark.createDataFrame([([int(x) for x in sp.encode("go on")],), (None,)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(ids, path).collect()] == ["go on", ""]
    assert pieces.digest(frame(spark, TEXTS).limit(0), path).count() == 0


def test_character_map_takes_the_longest_prefix():
    """A double array with a, ab -> X, Y, laid out by hand."""
    units = [0] * 1024
    node = lambda label, offset, leaf: label | leaf << 8 | offset << 10
    units[0] = 1 << 10  # the root's children stand at 1 ^ label
    at = 1 ^ ord("a")
    units[at] = node(ord("a"), at ^ 300, 1)
    units[300] = 1 << 31 | 0
    b = 300 ^ ord("b")
    units[b] = node(ord("b"), b ^ 500, 1)
    units[500] = 1 << 31 | 2
    table = pieces.CharMap(np.array([4 * len(units), *units], np.uint32).tobytes() + b"X\0Y\0")
    size, value = table.longest_of(np.frombuffer(b"abcacaba", np.uint8), np.arange(8), np.full(8, 8))
    assert size.tolist() == [2, 0, 0, 1, 0, 2, 0, 1] and [value[k] for k in (0, 3, 5, 7)] == [2, 0, 2, 0]
    assert table.longest(b"abc", 0) == (2, b"Y") and table.longest(b"ac", 0) == (1, b"X") and table.longest(b"ca", 0) is None


def test_many_texts_are_normalised_as_one_by_one():
    """With a map whose replacements have other lengths: a -> X, ab -> YY y."""
    import pyarrow as pa

    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        e = pieces.Encoder(f.read())
    units = [0] * 1024
    node = lambda label, offset, leaf: label | leaf << 8 | offset << 10
    units[0] = 1 << 10
    at = 1 ^ ord("a")
    b = 300 ^ ord("b")
    units[at], units[300], units[b], units[500] = node(ord("a"), at ^ 300, 1), 1 << 31, node(ord("b"), b ^ 500, 1), 1 << 31 | 2
    e.map = pieces.CharMap(np.array([4 * len(units), *units], np.uint32).tobytes() + b"X\0YY y\0")
    texts = ["ab a", "", "b", "a", "cabaé ab", "日a", "", "x  ab"]
    got, origin = e.normalised(pa.array(texts))
    want, base, aligned = [], 0, []
    for t in texts:
        normal, places = e.normalise(t)
        k = 0
        for c in normal.decode():
            aligned += [base + places[k]] if c == "▁" else [base + x for x in places[k : k + len(c.encode())]]
            k += len(c.encode())
        want.append(normal.decode()[1:].replace("▁", " "))
        base += len(t.encode())
    assert got.to_pylist() == want and origin.tolist() == [*aligned, base]


def test_token_counts_equal_greedy_longest_match(spark, tmp_path):
    vocab = [b" a", b" ab", b" abcd", b"b", b"c", b"cd", b"cde", b"d", b"e", b" "]
    path = tmp_path / "v"
    path.write_bytes(b"\n".join(base64.b64encode(v) + b" 0" for v in vocab))

    def greedy(word):
        word, n, i = b" " + word, 0, 0
        while i < len(word):
            size = next((k for k in range(len(word) - i, 0, -1) if word[i : i + k] in vocab), 0)
            if not size:
                return 1
            n, i = n + 1, i + size
        return n

    texts = [*TEXTS[:4], *(" ".join("".join(random.Random(s).choices("abcdez", k=k)) for k in range(1, 9)) for s in range(40))]
    for r in token_counts.count(frame(spark, texts), str(path)).select("text", "tokens.*").collect():
        found = WORD.findall(r.text or "")
        assert (r.n_words, r.n_tokens) == (len(found), sum(greedy(w.encode()) for w in found))


def test_language_hierarchy(spark):
    words = {"en": "the of and that with from this there", "de": "der die und nicht ist auch wenn über", "fr": "le la les des être où déjà pour", "es": "el los que una por más señor año"}
    rows = [(i, prose(i, 60, words[k].split()), k) for i, k in enumerate(list(words) * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs.filter(~held_out()))
    got = langid.identify(docs.filter(held_out()), model).select("lang", "language.*").collect()
    assert got and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = langid.identify(frame(spark, [None, "", "12 34 !", "x" * 300_000]), model).select("doc_id", "language.*").orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score) for r in odd[:3]] == [("und", 0.0)] * 3 and odd[3].lang_pred in words
    blank = langid.train(docs.limit(0))
    assert langid.identify(docs.limit(2), blank).first().language.lang_pred == "und"


def test_quality_separates_and_survives_odd_rows(spark):
    good = [prose(i, 60) for i in range(120)]
    bad = [" ".join(w + "###" for w in prose(i, 60).split()) for i in range(500, 540)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 160, 2)] + [(0, 1), (2, None)], "doc_id bigint, quality int")
    model = quality.train(docs.filter(~held_out()), labels.filter(~held_out()))
    s = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert min(s[i] for i in range(120)) > 0.3 > max(s[i] for i in range(120, 160))
    assert all(0 <= r.score <= 1 for r in quality.score(frame(spark, TEXTS), model).collect())
    none = quality.train(docs, labels.limit(0))
    assert 0 <= quality.score(docs.limit(1), none).first().score <= 1


def test_lines_of_many_sites_go(spark):
    rows = [(i, f"own {i}\nshared by all\n\nagain {i}", f"s{i % 12}") for i in range(30)]
    rows += [(100 + i, "only at nine\nmine\nmine too %d" % i, f"s{i}") for i in range(9)] + [(200, None, "s1"), (201, "", None), (202, "shared by all", "s2"), (0, f"own 0\nshared by all\n\nagain 0", "s0")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, source string, key int")
    got = lines.remove(docs, min_sites=10, counts=True)
    for r in got.collect():
        if r.doc_id < 30:
            assert r.text == f"own {r.doc_id}\n\nagain {r.doc_id}" and (r.n_lines, r.n_removed) == (4, 1)
        else:
            assert r.n_removed == 0 and r.text == dict((x[0], x[1]) for x in rows)[r.doc_id]
    assert got.count() == len(rows) and lines.remove(docs.limit(0)).count() == 0
    assert lines.boilerplate(docs, min_sites=9, lg_k=4).count() >= 2


def test_pages_of_mostly_shared_lines_lose_them(spark):
    import corpus_pipeline

    rows = [(i, f"one\ntwo\n\nown {i}", f"s{i}", 0) for i in range(12)] + [(20, "one\ntwo", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {20: ("one\ntwo", 7), **{i: (f"\nown {i}", len(f"\nown {i}")) for i in range(12)}}
    assert {r.doc_id: r.n_removed for r in lines.remove(docs, counts=True).collect()} == {20: 0, **dict.fromkeys(range(12), 2)}


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a b\r\n", b"same"), (2, None, b"same"), (3, "u", None), (4, "u", b""), (5, "u", b"WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n\n\n"), (6, "u", bytes(range(256)) * 900)]
    df = spark.createDataFrame(rows, "id bigint, url string, payload binary")
    for segment in (1 << 20, 50_000):
        path = str(tmp_path / f"w{segment}")
        warc.write(df.withColumn("size", F.lit(1)), path, segment=segment)
        chunks = warc.read(spark, path, chunk_bytes=10_000)
        got = {r.record_id: r for r in warc.records(chunks).collect()}
        last = {1: 2, 3: 4}
        for i, _, p in rows:
            digest = base64.b32encode(hashlib.sha1(p or b"").digest()).decode()
            assert (got[i].payload_bytes, got[i].payload_digest, got[i].refers_to, got[i].record_type) == (len(p or b""), digest, last.get(i), "revisit" if i in last else "response")
            assert got[i].digest_ok
        whole = chunks.filter("record_id = 6").orderBy("chunk_no").collect()
        assert b"".join(r.chunk for r in whole) == rows[5][2] and max(len(r.chunk) for r in whole) <= 10_000
    odd = spark.createDataFrame([(None, "u", b"same"), (7, "u", b"one"), (7, "u", b"two"), (9, "u", b"one"), (9, "u", b"one"), (None, None, b"alone")], "id bigint, url string, payload binary")
    warc.write(odd, str(tmp_path / "odd"))
    got = warc.records(warc.read(spark, str(tmp_path / "odd"))).select("record_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(None, 4, "response", None), (7, 3, "revisit", 9), (7, 3, "response", None), (9, 3, "response", None), (9, 3, "response", None), (None, 5, "response", None)]))
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_archives_of_others(spark, tmp_path):
    def record(kind, name, block, more=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    long = bytes(65 + i % 26 for i in range(300_000))
    data = record("warcinfo", "urn:uuid:1", b"software: x\r\n") + record("response", "urn:uuid:2", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + long)
    data += record("resource", "urn:uuid:3", b"plain\r\n\r\nrest") + record("response", "urn:uuid:4", long) + record("continuation", "urn:uuid:5", b"tail", "WARC-Segment-Origin-ID: <urn:uuid:9>\r\n")
    (tmp_path / "x.warc").write_bytes(data)
    got = {r.name: r for r in warc.records(warc.read(spark, str(tmp_path / "x.warc"), chunk_bytes=10_000)).collect()}
    sizes = {"urn:uuid:2": (long, "response"), "urn:uuid:3": (b"plain\r\n\r\nrest", "resource"), "urn:uuid:4": (long, "response"), "urn:uuid:5": (b"tail", "continuation")}
    assert {k: (r.payload_bytes, r.payload_digest, r.record_type) for k, r in got.items()} == {k: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), t) for k, (b, t) in sizes.items()}
    assert got["urn:uuid:5"].refers_to_name == "urn:uuid:9" and got["urn:uuid:2"].record_id is None


def jaccard_components(texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    r = random.Random(5)
    base = prose(9, 120).split()

    def edited(k):
        w = list(base)
        for _ in range(k):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        return " ".join(w)

    texts = [*TEXTS[:4], "One", *(edited(k % 9) for k in range(50)), *(prose(k, 40) for k in range(20)), prose(3, 40), " ".join(base[:95]), " ".join(base[:96]), prose(1, 4000)]
    n, root = jaccard_components(texts, width, 80)
    got = sorted((x.id, x.n, x.component) for x in near_dup.components_of(frame(spark, texts), width=width).collect())
    assert got == [(i, n[i], root[i]) for i in range(len(texts))]
    assert sorted(x.doc_id for x in near_dup.kept(frame(spark, texts), width=width).collect()) == sorted(set(root))
    assert near_dup.components_of(frame(spark, texts).limit(0)).count() == 0


def test_near_copies_of_one_text_equal_brute_force(spark):
    """A group whose copies lie around the threshold: most pairs are not linked, some only through a third."""
    r = random.Random(11)
    base = prose(21, 150).split()
    texts = []
    for k in range(150):
        w = list(base)
        for at in r.sample(range(150), r.randrange(2, 22)):
            w[at] = r.choice(base) if k % 3 == 0 else f"new{r.randrange(60)}"
        texts.append(" ".join(w))
    for width in (2, 5):
        n, root = jaccard_components(texts, width, 80)
        got = sorted((x.id, x.n, x.component) for x in near_dup.components_of(frame(spark, texts), width=width).collect())
        assert len(set(root)) > 5 and got == [(i, n[i], root[i]) for i in range(len(texts))]


def test_rows_of_one_id_are_one_document(spark):
    t, u = prose(31, 60), prose(32, 60)
    rows = [(5, t), (5, u), (9, f"{t} more"), (10, f"{u} more"), (11, u), (None, t), (None, None), (12, prose(33, 60))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("gone", F.lit(1)).withColumn("class", F.lit(2))
    got = sorted((x.id is None, x.id or 0, x.component) for x in near_dup.components_of(docs).collect())
    assert got == [(False, 5, 5), (False, 5, 5), (False, 9, 5), (False, 10, 5), (False, 11, 5), (False, 12, 12), (True, 0, None), (True, 0, None)]
    assert sorted(x.doc_id or 0 for x in near_dup.kept(docs).collect()) == [0, 0, 5, 5, 12]


def test_components_of_a_long_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_repeated_windows_equal_brute_force(spark):
    shared, hot = prose(77, 60), " ".join(["same"] * 45)
    texts = [*TEXTS, f"{prose(2, 30)} {shared} {prose(3, 10)}", f"{shared} {prose(4, 5)} {shared}", hot, f"{hot} end", prose(5, 19), prose(5, 19), shared]
    window, seen, want = 20, set(), {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = set()
        for a in range(len(w) - window + 1):
            g = tuple(w[a : a + window])
            if g in seen:
                gone.update(range(a, a + window))
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    # the words decide: with hashes of four bits nearly every span is taken apart
    for bits in (substrings.EDGE_BITS, 4):
        got = substrings.without_repeats(frame(spark, texts).repartition(5), bits=bits)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got.select("doc_id", "cut.*").collect()} == want, bits
    paths = substrings.repeated_paths(frame(spark, [f"{prose(2, 30)} {shared}", f"{shared} {prose(4, 5)}"])).collect()
    assert [(p.doc, p.start, p.n, p.src_doc, p.src_start) for p in paths] == [(1, 0, 41, 0, 30)]
    assert substrings.without_repeats(frame(spark, texts).limit(0)).count() == 0


def test_paths_compact_between_branches(spark):
    a, b, c = prose(11, 400).split(), prose(12, 60).split(), prose(13, 60).split()
    # 1 repeats all of 0 but one word, 2 leaves it half-way for another continuation, which 3 repeats
    changed = [*a[:200], "otherword", *a[201:]]
    texts = [" ".join(x) for x in (a, changed, a[:100] + b, c + a[:100] + b, a)]
    paths = substrings.repeated_paths(frame(spark, texts)).collect()
    covered = {(p.doc, p.start + i, p.src_doc, p.src_start + i) for p in paths for i in range(p.n)}
    assert {x for x in covered if x[0] == 1} == {(1, i, 0, i) for i in [*range(181), *range(201, 381)]}
    assert {x for x in covered if x[0] == 2} == {(2, i, 0, i) for i in range(81)}
    assert {x for x in covered if x[0] == 3} == {(3, 60 + i, 0, i) for i in range(81)} | {(3, 60 + i, 2, i) for i in range(81, 141)}
    assert {x[1] for x in covered if x[0] == 4} == set(range(381))  # 3 and 4 may be of one slice
    assert len(paths) < 25


def test_rows_of_one_id_lose_only_their_own_repeats(spark):
    x, y = prose(21, 40), prose(22, 40)
    got = substrings.without_repeats(frame(spark, [x, x, y, y], ids=[1, 2, 2, 3]))
    assert sorted((r.doc_id, r.kept) for r in got.select("doc_id", "cut.kept").collect()) == [(1, x), (2, ""), (2, y), (3, "")]


def test_nearest_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 16)) + 3 * rng.normal(size=(6, 16))[np.arange(600) % 6]
    v[10] = v[20] = v[30]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(600, None), (601, [0.0] * 16), (602, [1.0] * 15 + [float("nan")]), (603, [1.0] * 15 + [None]), (604, [1.0, 2.0]), (None, [1.0] * 16), (30, [float(x) for x in v[30]])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, id int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    right = 0
    for q in range(0, 600, 10):
        s = u @ u[q]
        s[q] = -9
        want = sorted(range(600), key=lambda k: (-round(s[k], 12), k))[:5]
        right += len(set(want) & {i for i, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(s[i] - x) < 1e-12 for i, x in got[q])
    assert right >= 0.9 * 5 * 60 and set(got) == set(range(0, 600, 10))
    assert [i for i, _ in got[10][:2]] == [20, 30]
    few = ann.search(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2 and ann.search(df.limit(0), F.lit(True)).count() == 0


def test_benchmark_passages_are_found(spark):
    items = [prose(1000 + k, 30) + "." for k in range(12)] + [None, "", "short one"]
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id bigint, text string, key int")
    worn = items[3].split()
    for k in (4, 11, 18, 25):
        worn[k] = "altered"
    texts = [*(prose(k, 150) for k in range(80)), f"{prose(90, 70)} {items[2].upper()} {prose(91, 20)}", f"{prose(92, 20)} {' '.join(worn)} {prose(93, 33)}", None, "", prose(94, 9000) + " " + items[5]]
    got = decontaminate.matches(frame(spark, texts), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(80, 2), (81, 3), (84, 5)}
    assert decontaminate.clean(frame(spark, texts), bench).count() == len(texts) - 3
    assert decontaminate.matches(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.matches(frame(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.subsequence(list("abcde"), list("xaxcxe")) == 3


def test_items_of_a_third_of_the_documents_are_found(spark):
    """A template with a benchmark item makes the item's own words common; another item stands in every document."""
    hot, every = prose(2000, 20, ["hot"]), prose(2001, 9, ["every"])
    bench = spark.createDataFrame([(0, hot), (1, every), (2, "only here")], "item_id bigint, text string")
    texts = [f"{prose(k, 90)} {hot if k % 3 == 0 else ''} {prose(500 + k, 90)} {every} {prose(900 + k, 40)}" for k in range(90)] + ["it is only here now"]
    want = {(k, 0) for k in range(0, 90, 3)} | {(k, 1) for k in range(90)} | {(90, 2)}
    got = decontaminate.matches(frame(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.common == 1 for r in got)


def test_items_of_any_length_are_found_in_dense_text(spark):
    items = [prose(3000 + n, n) for n in (5, 8, 300, 2000)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rare = lambda k, n: " ".join(f"only{k}x{i}" for i in range(n))
    texts = [prose(k, 200) for k in range(60)] + [f"{rare(k, 170 + 9 * k)} {items[k % 4]} {rare(k + 50, 80)}" for k in range(40)]
    got = decontaminate.matches(frame(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(60 + k, k % 4) for k in range(40)} and all(r.common == 1 for r in got)


def test_passages_follow_the_items(spark):
    """No three words in a row: only passages of the item's size tell it."""
    items = [prose(4000 + n, n) for n in (14, 300, 2500)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rare = lambda k, n: " ".join(f"only{k}x{i}" for i in range(n))
    worn = [" ".join(w if i % 3 != 2 else f"{w} new{i}" if n else f"new{i}" for i, w in enumerate(t.split())) for n, t in enumerate(items)]
    texts = [prose(k, 200) for k in range(60)] + [f"{rare(k, 170 + 9 * k)} {worn[k % 3]} {rare(k + 50, 80)}" for k in range(30)]
    got = decontaminate.matches(frame(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(60 + k, k % 3) for k in range(30)}


def test_short_answers_save_paraphrases(spark):
    """Items with 11 of 20 words left: only the answer tells them, and it must be there as a whole."""
    items = [prose(5000 + k, 20) for k in range(3)]
    worn = [" ".join(w if i < 11 else f"new{i}" for i, w in enumerate(t.split())) for t in items]
    bench = spark.createDataFrame([(0, items[0], "Paris"), (1, items[1], "New York"), (2, items[2], "")], "item_id bigint, text string, answer string")
    texts = [prose(k, 150) for k in range(40)] + [f"{prose(60 + i, 40)} {t} {prose(70 + i, 40)}" for i, t in enumerate((f"{worn[0]} paris.", worn[0], f"{worn[1]} New York", f"{worn[1]} york new", f"{worn[2]} paris"))]
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark, texts), bench).collect()} == {(40, 0), (42, 1)}


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage of corpus_pipeline against plain Python on a fixture with clear languages."""
    import sentencepiece

    import corpus_pipeline

    speech = {"en": "the of and that with from this there", "de": "der die und nicht ist auch wenn über", "fr": "le la les des être où déjà pour", "es": "el los que una por más señor año"}
    shared = "the line that every site has below"
    items = [prose(1000 + k, 30, speech["en"].split()) for k in range(6)]
    langs = list(speech)
    rows = [(i, prose(i, 60, speech[langs[i % 4]].split()) + (f"\n{shared}" if i % 4 == 0 else ""), langs[i % 4], f"s{i // 4}") for i in range(64)]
    rows += [(100, rows[0][1], "en", "s1"), (101, rows[5][1] + " wenn", "de", "s2"), (102, rows[5][1] + " wenn", None, None)]
    rows += [(110, f"{prose(110, 50, speech['en'].split())} {items[2]} {prose(111, 9, speech['en'].split())}", "en", "s3"), (111, f"{items[4].upper()}", "en", None)]
    rows += [(120, None, "en", "s1"), (121, "", None, None), (122, "12 34 !?", "de", "s4")]
    docs = spark.createDataFrame([(i, t, k, s, len(t or "")) for i, t, k, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    want = [(i, t) for i, t, *_ in rows if re.search(r"[^\W\d_]", t or "")]  # a language can be told
    sites = {}
    for i, t, _, s in rows:
        for line in (t or "").split("\n"):
            sites.setdefault(line, set()).add(s)
    want = [(i, "\n".join(x for x in t.split("\n") if len(sites[x]) < 10)) for i, t in want]
    root = jaccard_components([t for _, t in want], 5, 80)[1]
    want = [x for k, x in enumerate(want) if root[k] == k]
    want = [(i, t) for i, t in want if not any(x.lower() in t.lower() for x in items)]
    assert {i for i, _ in want} == set(range(64))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    told = [(i, len(e), sha(",".join(map(str, e))), sha(sp.decode(e))) for i, t in want for e in [sp.encode(t)]]
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == told


def test_a_text_of_many_lines_takes_linear_time(spark):
    """Every third line is shared by all sites; the others are the document's own."""
    import time

    n = 100_000
    shared = [f"shared {k}" for k in range(n // 3)]
    long = "\n".join(shared[k // 3] if k % 3 == 0 and k // 3 < len(shared) else f"own {k}" for k in range(n))
    rows = [(i, "\n".join(shared), f"s{i}") for i in range(10)] + [(10, long, "s0"), (11, long + "\nend", "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    docs.count()
    began = time.time()
    got = {r.doc_id: r for r in lines.remove(docs, counts=True).collect()}
    assert time.time() - began < 30
    own = [x for x in long.split("\n") if not x.startswith("shared")]
    assert got[10].text == "\n".join(own) and got[10].n_lines == n and got[10].n_removed == len(shared)
    assert got[11].text == "\n".join([*own, "end"]) and got[0].text == rows[0][1] and got[0].n_removed == 0


def test_boilerplate_lines_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"top\nown {i}\n\nbottom {i % 2}\nrest {i}", f"s{i % 25}") for i in range(100)], "doc_id bigint, text string, source string")
    want = {r.doc_id: r.text for r in lines.remove(docs).collect()}
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert {r.doc_id: r.text for r in lines.remove(docs).collect()} == want == {i: f"own {i}\n\nrest {i}" for i in range(100)}
