"""The ten operators on a small table of awkward rows, against brute force."""

import collections
import hashlib
import pathlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fiscus.llm import bpe, classifier, components, exact_dedup, licenses, ngram_join, packing, pii, quality_rules, queries, substring_dedup, warc
from fiscus.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(120))
NEAR = BASE.replace("w60 ", "changed ")
PASSAGE = " ".join(f"p{i}" for i in range(40))
ROWS = [
    (1, BASE, "a"), (2, BASE, "a"), (3, NEAR, "b"), (4, None, None), (5, "", "a"), (6, " \t\n ", "b"),
    (7, "x " + PASSAGE + " y", "a"), (8, "other words " + PASSAGE, "c"), (9, BASE.upper(), "c"), (9, BASE.upper(), "c"),
    (None, BASE, "a"), (10, "héllo wörld <|endoftext|>　a  b\n\n c", "a"), (11, "z" * 300_000, "b"),
    (12, "mail a@b.c_d@e.f, 1.2.3.4 and 999.1.1.1; +1 (499) 555-6503; 4111 1111 1111 1111 é x@y.zz", "a"),
    (13, "the the the the " * 40, "b"), (14, "one line\n" * 9 + "MIT stuff.\nReleased under the MIT License.", "a"),
    (15, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. "
         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    # columns whose names the operators use inside
    return d.select("doc_id", "text", "source", F.lit(1).alias("id"), F.lit("q").alias("t"), F.lit(2).alias("k1"), F.lit(3).alias("h"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return WORD.findall(text or "")


def test_bpe_round_trip(docs, none):
    ranks = public.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(docs, ranks, public.PATTERN, buckets=3), ranks).collect()
    lib = tiktoken.Encoding("x", pat_str=public.PATTERN, mergeable_ranks=dict(bpe.read_ranks(ranks)), special_tokens={})
    want = collections.Counter((i, np.array(lib.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in ROWS)
    assert collections.Counter((r[0], bytes(r[1]), bytes(r[2])) for r in out) == want
    assert bpe.encode(none, ranks, public.PATTERN).count() == 0
    both = bpe.round_trip(docs, ranks, public.PATTERN, buckets=3).collect()
    assert collections.Counter((r[0], bytes(r[1]), bytes(r[2])) for r in both) == want
    assert bpe.round_trip(none, ranks, public.PATTERN).count() == 0


def test_warc_round_trip(spark):
    body = "é" * 60
    rows = [(5, "http://x/ y\r\nz", body), (2, None, body), (9, "u", body), (1, "u", "short"), (3, "u", "short"), (4, "u", None),
            (None, "u", body), (7, "u", ""), (2, None, body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages, file_bytes=500).collect()}
    assert got == {(5, 120, "revisit", 2), (2, 120, "response", None), (9, 120, "revisit", 2), (1, 5, "response", None),
                   (3, 5, "response", None), (4, 0, "response", None), (None, 120, "revisit", 2), (7, 0, "response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0
    spans = list(warc.coalesce([("a", 0, 10), ("a", 10, 10), ("a", 100, 5), ("b", 0, 5)], 20, 1000))
    assert [len(s) for s in spans] == [2, 1, 1]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, none, weak):
    by = {"hash128": lambda t: F.char_length(t)} if weak else {}  # collisions must not merge
    out = exact_dedup.exact_groups(docs, **by).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    want = []
    for i, t, _ in ROWS:
        ids = groups[t or ""]
        keep = max([x for x in ids if x is not None], default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert collections.Counter(map(tuple, out)) == collections.Counter(want)
    assert exact_dedup.drop_exact_copies(docs).count() == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0


def test_pii_base_spans_and_terms(spark, docs, none):
    got = {r.doc_id: r for r in pii.report(pii.find(docs)).collect()}
    assert got[12].spans == "email:5:10,email:10:16,ip:18:25,phone:41:58,card:60:79,email:82:88"
    assert (got[12].n_email, got[12].n_ip, got[12].n_card, got[12].n_phone) == (3, 1, 1, 1)
    assert got[4].spans == "" and got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.report(pii.find(none)).count() == 0
    rows = [(i, f"note {'abcd'[i] * 3} by zebulon at z@corp.org number {i}") for i in range(4)] + [(i, f"plain words by hand {i}") for i in range(4, 90)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(d)
    spans = {r.doc_id: r.spans for r in pii.report(found).collect()}
    assert "term:12:19" in spans[2] and "email:23:33" in spans[2] and spans[50] == ""
    both = d.join(found.select(F.col("id").alias("doc_id"), "found"), "doc_id")
    clean = {r[0]: r[1] for r in both.select("doc_id", pii.sanitised(F.col("text"), F.col("found"), 0.95)).collect()}
    assert "zebulon" not in clean[2] and "[EMAIL]" in clean[2] and clean[50] == "plain words by hand 50"


def test_ngram_components(docs, none):
    out = ngram_join.near_components(docs).collect()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in out}
    assert len(out) == len(ROWS)
    assert {(1, 118, 1), (2, 118, 1), (3, 118, 1), (9, 118, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (None, 118, None), (11, 1, 11)} <= got
    assert ngram_join.near_components(none).count() == 0


def test_ngram_links_of_repeated_ids(spark):
    """Links are between texts, also where two of them have the same id and number of n-grams."""
    other = " ".join(f"u{i}" for i in range(120))
    rows = [(1, BASE), (5, NEAR), (5, other), (9, other.replace("u60 ", "changed ")), (9, other.replace("u60 ", "changed ")), (5, "few words"), (5, None)]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string").selectExpr("*", "1 AS x", "2 AS label", "3 AS rep")
        got = collections.Counter(tuple(r) for r in ngram_join.near_components(d).collect())
        assert got == {(1, 118, 1): 1, (5, 118, 1): 1, (5, 118, 5): 1, (9, 118, 5): 2, (5, 1, 5): 1, (5, 0, 5): 1}
        gone = d.selectExpr("doc_id AS id", "text", "xxhash64(coalesce(text, '')) AS x").join(ngram_join.near_copies(d).withColumnRenamed("id", "g"), "x")
        assert {(r.g, r.text) for r in gone.collect()} == {(5, NEAR), (9, rows[3][1])}


@pytest.mark.parametrize("num", [80, 90])
def test_join_block_matches_brute_force(num):
    rng, limit = np.random.default_rng(num), ngram_join.Threshold(num, 100)
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = []
        for _ in range(12):
            keep = base[rng.random(60) > 0.08]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, rng.integers(0, 6)).astype(np.uint64)])))
        label = list(range(12))
        for i in range(12):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if limit.linked(inter, len(sets[i]), len(sets[j])):
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        done = ngram_join.join_block(sets, limit).label
        assert [label[i] == label[j] for i in range(12) for j in range(12)] == [done[i] == done[j] for i in range(12) for j in range(12)]
        order = sorted(range(12), key=lambda i: len(sets[i]))
        near = ngram_join.close_sets(np.array([len(sets[i]) for i in order]), [ngram_join.parity_bitmap(sets[i]) for i in order], limit).label
        assert all(near[a] == near[b] for a in range(12) for b in range(12) if label[order[a]] == label[order[b]])


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 30), (41, 40)], "a long, b long")
    assert {tuple(r) for r in components.components(e).collect()} == {(i, 0) for i in range(21)} | {(40, 40), (41, 40)}


@pytest.mark.parametrize("bits", [8, 256, 1 << 24])  # filters that let all, much and little through
def test_substring_repeats(docs, none, bits):
    count = collections.Counter()
    for _, t, _ in ROWS:
        w = words(t)
        count.update(tuple(w[i:i + 35]) for i in range(len(w) - 34))
    want = collections.Counter()
    for i, t, _ in ROWS:
        w = words(t)
        gone = [any(count[tuple(w[s:s + 35])] > 1 for s in range(max(0, j - 34), min(j, len(w) - 35) + 1)) for j in range(len(w))]
        want[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    assert collections.Counter(tuple(r)[:4] for r in substring_dedup.repeats(docs, filter_bits=bits, most_bits=bits).collect()) == want
    assert substring_dedup.repeats(none, filter_bits=bits, most_bits=bits).count() == 0


def test_quality_rules(spark, docs, none):
    got = collections.Counter((r.doc_id, *r.quality[:6]) for r in quality_rules.quality(docs).collect())
    want = collections.Counter()
    for i, t, _ in ROWS:
        w, lines = words(t), [x for x in (t or "").split("\n") if WORD.search(x)]
        g = collections.Counter(zip(w, w[1:], w[2:]))
        hit = [any(g[tuple(w[s:s + 3])] > 1 for s in range(max(0, j - 2), min(j, len(w) - 3) + 1)) for j in range(len(w))]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(hit),
              len(w) < 50 or 100 * sum(hit) > 50 * len(w))] += 1
    assert got == want and quality_rules.quality(none).count() == 0
    rows = [(i, "Shared footer line 7\n" + " ".join(f"u{i}_{j}" for j in range(60)), "s") for i in range(30)]
    rows += [(99, "\n".join(["Shared footer line 8"] * 40), "s")]
    q = {r.doc_id: r.quality for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert q[3].clean_text.startswith("u3_0") and q[3].kept and q[99].depleted and not q[99].kept


def test_packing(docs, none):
    out = packing.best_fit_pack(docs, public.path("byte_bpe_50k.json"), public.PATTERN, sequence_length=64, open_bins=4).collect()
    lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t, _ in ROWS:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for p, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want[(i, p, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert all(o == sum(n for _, n in sorted(b)[:k]) for k, (o, _) in enumerate(sorted(b))) and sum(n for _, n in b) <= 64
    assert packing.best_fit_pack(none, public.path("byte_bpe_50k.json"), public.PATTERN).count() == 0


def test_packing_encodes_added_tokens(spark):
    lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    encoder = packing.PieceEncoder(public.path("byte_bpe_50k.json"), public.PATTERN)
    for t in ("hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|> \n", " <|endoftext|", "x <|endoftext|>  y\n\nz"):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
    assert 50256 in lib.encode("hello <|endoftext|> world", add_special_tokens=False).ids


def plain_best_fit(lengths, size, most_open):
    """(bin, offset) per piece: the fullest open bin that holds it; the fullest open one closes when too many are open.
    Of equally full bins the one used last counts."""
    bins, made, out = [], 0, []
    for n in lengths:
        fits = [i for i, b in enumerate(bins) if size - b[1] >= n]
        if fits:
            at = max(fits, key=lambda i: (bins[i][1], i))
            b = bins.pop(at)
        else:
            b, made = [made, 0], made + 1
            if len(bins) >= most_open and n < size:
                bins.pop(max(range(len(bins)), key=lambda i: (bins[i][1], i)))
        out.append((b[0], b[1]))
        b[1] += n
        if b[1] < size:
            bins.append(b)
    return out


def test_best_fit_places_as_a_plain_one():
    rng = np.random.default_rng(8)
    for most_open in (1, 3, 20):
        lengths = rng.integers(1, 65, 500).tolist()
        fit = packing.BestFit(64, most_open)
        assert [fit.put(n) for n in lengths] == plain_best_fit(lengths, 64, most_open)


def test_classifier_on_held_out_labels(spark, docs, none):
    out = queries.op9(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    n, right = out.where("held_out").agg(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert n > 50 and right / n > 0.95
    labels = spark.createDataFrame([(1, 1), (13, 0), (3, 1), (11, 0), (None, 1), (7, None)], "doc_id long, quality int")
    described = written(classifier.describe(docs), "features")
    scores = classifier.score(described, classifier.fit(described, labels)).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    empty = classifier.describe(none)
    assert classifier.score(empty, classifier.fit(empty, labels)).count() == 0


def test_license_rules(docs, none):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[14].licenses == "MIT" and got[14].n_sentences == 1
    assert got[15].rules == "Apache-2.0/header,Apache-2.0/notice"
    assert got[15].sentence_ids == "apache-2-notice,apache-comply,apache-copy"
    assert got[4].licenses == "" and got[4].n_sentences == 0 and licenses.scan(docs).count() == len(ROWS)
    assert licenses.scan(none).count() == 0


def against_sql(spark, folder, key):
    from compare import canon

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if (folder / (t + '.parquet')).is_dir() else ''}')")
    df = queries.QUERIES[key](spark, str(folder))
    cur = con.execute(queries.ORACLE[key])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_oracles(spark, key):
    against_sql(spark, pathlib.Path("/root/testdata/sf0.001"), key)


@pytest.fixture(scope="module")
def awkward(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("awkward")
    footer = [(100 + i, "Shared footer line 7\n" + " ".join(f"u{i}_{j}" for j in range(60)), "s" if i % 2 else None) for i in range(60)]
    more = spark.createDataFrame(footer, "doc_id long, text string, source string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    docs.selectExpr("doc_id page_id", "'u' url", "text html").where("page_id is not null").write.parquet(f"{folder}/pages.parquet")
    docs.where("doc_id is not null").selectExpr("doc_id % 5 conv_id", "CAST(doc_id AS INT) turn", "IF(doc_id % 2 = 0, 'user', 'assistant') role", "text").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_oracles_on_awkward_rows(spark, awkward, key):
    against_sql(spark, awkward, key)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp

    rows = [(i, " ".join(f"v{i}_{j}" for j in range(60)) + (" mail me@site.org" if i == 2 else ""), "en", "s", 1) for i in range(4)]
    rows += [(10, BASE, "en", "s", 1), (11, BASE, "en", "s", 1), (12, NEAR, "en", "s", 1), (13, None, None, None, None), (14, "few", "en", "s", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = [{0, 1, 2, 3, 10, 11, 12}, {0, 1, 2, 3, 11, 12}, {0, 1, 2, 3, 11}, {0, 1, 2, 3, 11}]
    for (name, stage), ids in zip(cp.STAGES, left):
        columns = d.columns
        d = written(stage(spark, d, ""), name)
        assert {r.doc_id for r in d.collect()} == ids and d.columns == columns, name
    assert [r.text[-7:] for r in d.where("doc_id = 2").collect()] == ["[EMAIL]"]
    last = cp.STAGES[-1][1](spark, d, "").collect()
    assert {r.doc_id for r in last} == ids and len({(r.sequence_id, r.offset) for r in last}) == len(last)


def test_pipeline_stages_of_clashing_names_and_repeated_ids(spark):
    import corpus_pipeline as cp

    mail = " ".join(f"m{i}" for i in range(70)) + " mail me@site.org"
    other = " ".join(f"u{i}" for i in range(120))
    rows = [(1, BASE), (5, NEAR), (5, other), (9, other.replace("u60 ", "changed ")), (9, other), (None, mail), (7, mail + " end"), (7, None), (8, "")]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("quality", "gone_id", "k1", "k2", "found", "t", "row", "id", "x", "label", "hot_host", "b", "a", "kept")
    d = d.selectExpr("*", *[f"'own {n}' AS {n}" for n in names])
    left = [[None, 1, 5, 5, 7, 9, 9], [None, 1, 5, 7, 9, 9], [None, 1, 7, 9], [None, 1, 7, 9]]
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda i: (i is not None, i))
    for (name, stage), want in zip(cp.STAGES, left):
        assert stage(spark, d.limit(0), "").count() == 0, name
        columns = d.columns
        d = written(stage(spark, d, ""), name)
        assert d.columns == columns and [r[0] for r in d.selectExpr("struct(quality, gone_id, k1, k2, found, t, row, x, label)").distinct().collect()] == [
            tuple(f"own {n}" for n in ("quality", "gone_id", "k1", "k2", "found", "t", "row", "x", "label"))], name
        assert ids(d) == want, name
    assert "me@site.org" not in " ".join(r.text for r in d.collect())
    assert cp.STAGES[-1][1](spark, d, "").count() == d.count() and cp.STAGES[-1][1](spark, d.limit(0), "").count() == 0


def test_bpe_over_a_whole_table_in_small_blocks(spark):
    ranks = public.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lib = tiktoken.Encoding("x", pat_str=public.PATTERN, mergeable_ranks=dict(bpe.read_ranks(ranks)), special_tokens={})
    ids = bpe.encode(docs, ranks, public.PATTERN)
    clash = ids.selectExpr("doc_id", "ids", "doc_id AS block", "'x' AS row", "1 AS tokens")
    want = {r.doc_id: (np.array(lib.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect()}
    for out in (bpe.decode(ids, ranks), bpe.decode(clash, ranks, block_bytes=1 << 12), bpe.round_trip(docs, ranks, public.PATTERN)):
        assert {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in out.collect()} == want


def test_bpe_decoding_of_nulls_and_unknown_ids(spark):
    ranks = public.path("byte_bpe_50k.tiktoken")
    odd = spark.createDataFrame([(1, None), (2, b""), (2, b""), (None, (300).to_bytes(4, "little"))], "a int, ids binary")
    got = sorted(((r.a, r.decoded) for r in bpe.decode(odd, ranks).collect()), key=str)
    assert got == [(1, None), (2, b""), (2, b""), (None, bpe.read_ranks(ranks)[300][0])]
    assert bpe.decode(odd.limit(0), ranks).collect() == []
    with pytest.raises(Exception, match="not in the token table"):
        bpe.decode(spark.createDataFrame([(1, (10**6).to_bytes(4, "little"))], "a int, ids binary"), ranks).collect()


def test_vocabularies_of_one_size_have_their_own_ids(spark, tmp_path):
    import base64

    docs = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    for pair, ids in (("ab", [256, 99, 100]), ("cd", [97, 98, 256])):
        tokens = [bytes([i]) for i in range(256)] + [pair.encode()]
        path = tmp_path / f"{pair}.tiktoken"
        path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
        row = bpe.decode(bpe.encode(docs, str(path), r"\w+"), str(path)).first()
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == ids and bytes(row.decoded) == b"abcd"
