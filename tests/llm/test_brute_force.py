"""Whole driver tables against plain Python, where SQL has no form: personal data and the pipeline."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from fiscus.llm import packing, pii, queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    low = [int(c) for c in digits[::-1]]
    return (sum(low[::2]) + sum(sum(divmod(2 * x, 10)) for x in low[1::2])) % 10 == 0


def passes(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(t):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(KINDS.items()) for m in p.finditer(t) if passes(k, m.group())]
    return sorted(found)


def masked(t):
    """The text with labels for its base spans; those that overlap are one."""
    groups = []
    for s, k, e in base_spans(t):
        if groups and s < groups[-1][2]:
            groups[-1][2] = max(groups[-1][2], e)
        else:
            groups.append([s, k, e])
    for s, k, e in reversed(groups):
        t = t[:s] + f"[{list(KINDS)[k].upper()}]" + t[e:]
    return t


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").collect()}


def test_pii_over_the_whole_table(spark, texts):
    got = {r.doc_id: r for r in queries.op4(spark, FOLDER).collect()}
    assert got.keys() == texts.keys() and sum(r.n_email + r.n_phone for r in got.values()) > 0
    names = list(KINDS)
    for i, r in texts.items():
        spans = [f"{names[k]}:{s}:{e}" for s, k, e in base_spans(r.text or "")]
        n = collections.Counter(x.split(":")[0] for x in spans)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k in names), i
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), i
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("term")] == spans, i


def term_spans(texts, limits):
    """Of each text (id to text) its terms' spans, by counting every text's words and those near its entities."""
    placed = {i: [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"[\p{L}\p{N}]+", t)] for i, t in texts.items()}
    base = {i: base_spans(t) for i, t in texts.items()}
    dc, dt, dct = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in texts.items():
        dt.update({w for *_, w in placed[i]})
        near = collections.defaultdict(set)
        for s, k, e in base[i]:
            before = [w for _, b, w in placed[i] if b <= s][-limits.near:]
            near[(k, t[s:e].lower())].update(before, [w for a, _, w in placed[i] if a >= e][:limits.near])
        dc.update(near.keys())
        dct.update((c, w) for c, ws in near.items() for w in ws)
    n, out = len(texts), {}
    told = set()
    for (c, w), x in dct.items():
        rate = dc[c] / n
        if rate < 1 and math.log2((x + rate) / (dt[w] + 1) / rate) / -math.log2(rate) >= limits.generalise:
            told.add(w)
    for i in texts:
        out[i] = [f"term:{a}:{b}" for a, b, w in placed[i] if w in told and not any(s < b and a < e for s, _, e in base[i])]
    return out


def test_pii_terms_over_the_whole_table(spark, texts):
    want = term_spans({i: r.text or "" for i, r in texts.items()}, pii.Disclosure())
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term")] for r in queries.op4(spark, FOLDER).collect()}
    assert got == want and any(want.values())


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")


def after_quality(texts):
    hosts, lines = collections.defaultdict(set), collections.defaultdict(set)
    for r in texts.values():
        t = r.text or ""
        hosts[r.source].add(t)
        for x in {normal(x) for x in t.split("\n")} - {""}:
            lines[r.source, x].add(t)
    hot = {k for k, v in lines.items() if len(v) >= 20 and len(v) > 0.1 * len(hosts[k[0]])}
    out = {}
    for i, r in texts.items():
        t = r.text or ""
        w = WORD.findall(t)
        count = collections.Counter(zip(w, w[1:], w[2:]))
        again = {s + j for s, g in enumerate(zip(w, w[1:], w[2:])) if count[g] > 1 for j in range(3)}
        clean = "\n".join(x for x in t.split("\n") if (r.source, normal(x)) not in hot)
        if len(w) >= 50 and 2 * len(again) <= len(w) and 2 * len(WORD.findall(clean)) >= len(w):
            out[i] = clean
    return out


def after_exact(kept):
    last = {t: i for i, t in sorted(kept.items())}
    return {i: t for t, i in last.items()}


def after_near(kept):
    sets = {}
    for i, t in kept.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets[i] = set(zip(*(w[j:] for j in range(5))))
    label = {i: i for i in kept}
    for a in kept:
        for b in kept:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return {i: t for i, t in kept.items() if label[i] == i}


def test_pipeline_over_the_whole_table(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, want = docs.columns, texts
    for (name, stage), expected in zip(cp.STAGES, (after_quality, after_exact, after_near)):
        docs, want = cp.written(stage(spark, docs, FOLDER), f"test-{name}"), expected(want)
        assert docs.columns == columns and {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} == want, name
    # personal data: whole base spans are replaced; disclosing words only go where the operator reports them
    found = pii.find(docs).select(F.col("id").alias("doc_id"), F.exists(F.coalesce("found", F.array()), lambda x: x["kind"] == 4).alias("terms"))
    terms = {r.doc_id: r.terms for r in found.collect()}
    docs = cp.written(cp.pii_stage(spark, docs, FOLDER), "test-pii")
    clean = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert clean.keys() == want.keys() and any(masked(t) != t for t in want.values())
    for i, t in want.items():
        assert not base_spans(clean[i]) and (clean[i] == masked(t) or terms[i]), i
    lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    pieces = collections.Counter()
    for i, t in clean.items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        for p, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            pieces[i, p, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())] += 1
    out = cp.run(spark, FOLDER).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
