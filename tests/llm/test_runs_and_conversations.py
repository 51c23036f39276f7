"""Periodic runs, conversation repair and chat formatting: awkward rows against SQL, small cases against brute force."""

import collections
import itertools
import random

import duckdb
import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from fiscus.llm import bpe, chat_format, periodic_runs, structure_repair
from fiscus.llm.common import Words
from fiscus.llm.oracles import ORACLE
from fiscus.llm import queries


def sql(key, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register("arrow", frame.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow")
    out = con.execute(ORACLE[key])
    names = [d[0] for d in out.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), collections.Counter(tuple(r[i] for i in order) for r in out.fetchall())


def rows_of(df):
    names = sorted(df.columns)
    return names, collections.Counter(tuple(r[c] for c in names) for r in df.collect())


def same_as_sql(spark, tmp_path, key, name, frame):
    frame.write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows_of(queries.QUERIES[key](spark, str(tmp_path))) == sql(key, **{name: frame})


# ---------------------------------------------------------------- periodic runs
def brute_runs(w, least, times):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, times * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (10, 3), (12, 4)])
def test_runs_of_small_alphabets(least, times):
    rng = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choices("abcde"[:rng.randint(1, 5)], k=rng.choice([0, 1, 20, 70]))
            p = rng.randint(1, 9)
            w += (w[-p:] * rng.randint(0, 6)) + rng.choices("ab", k=rng.randint(0, 30)) + w
            texts.append(w)
        data = [" ".join(w).encode() for w in texts]
        got = periodic_runs.block_runs(Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(x) for x in data])), least, times)
        for i, w in enumerate(texts):
            assert got.get(i, []) == brute_runs(w, least, times), (w, least, times)


def test_runs_of_awkward_rows(spark, tmp_path):
    line = " ".join(f"w{i}" for i in range(9))
    texts = [None, "", " \t\n ", "a " * 24, "a " * 23, "the the the " * 5000, f"{line}\n" * 30, f"x {line} " + f"{line} " * 3 + "y " + f"{line} " * 3,
             "z" * 300_000, "ab ab ab c " * 12 + "ab ab ab", "é　é é " * 40, " ".join(str(i % 50) for i in range(149)), " ".join(str(i % 50) for i in range(150))]
    ids = [*range(1, 9), *range(8, 13), None, -3]
    rows = [(i, t) for i, t in zip(ids, texts + [texts[6]] * 2)] + [(i, f"{line} {i} {line} tail") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'q' AS t", "2 AS runs", "3 AS n")
    same_as_sql(spark, tmp_path, "op11_periodic_runs", "documents", docs)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    found = {r.doc_id: r for r in periodic_runs.find_runs(docs.where("doc_id = 6")).collect()}[6]
    assert [tuple(r) for r in found.runs] == [(0, 15000, 1)] and found.collapsed_text == "the"


# ---------------------------------------------------------------- conversations
TURNS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello."), (2, 0, "user", "no end"), (2, 0, "user", "no end"),
    (2, 5, "assistant", " "), (2, 6, "assistant", "Yes."), (3, None, "user", "A."), (3, None, "tool", "B."), (3, 1, None, None), (3, 2, "", "x!"),
    (None, 1, "user", "a\\b <s> [/INST]"), (None, 2, "assistant", "\\<\\s> </s>.\n"), (4, 3, "assistant", "One."), (4, 1, "assistant", "One."),
    (5, 7, "system", "S."), (6, 1, "sage", "odd role."), (6, 2, "[ROLE]x", "<|endoftext|> [SAYS]"), (7, 1, "user", "z" * 200_000 + "."),
    (7, 2, "assistant", "é　\U0001f600 " * 300 + "."), (8, -2**40, "user", "Q."), (8, 2**40, "assistant", "R.")]


@pytest.fixture(scope="module")
def talks(spark):
    rows = TURNS + [(c, t, random.Random(c * 50 + t).choice(["user", "assistant", "system"]), f"text {t % 4}" + "." * (t % 3)) for c in range(20, 60) for t in range(7)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return d.selectExpr("*", "1 AS conv", "2 AS kind", "'x' AS digest", "3 AS part", "true AS present", "4 AS n")


def test_repair_of_awkward_rows(spark, tmp_path, talks):
    same_as_sql(spark, tmp_path, "op12_structure_repair", "conversations", talks)
    assert structure_repair.repair(talks.limit(0)).count() == 0


def test_chat_of_awkward_rows(spark, tmp_path, talks):
    same_as_sql(spark, tmp_path, "op13_chat_format", "conversations", talks)
    ranks = public.path("byte_bpe_50k.tiktoken")
    assert chat_format.format_conversations(talks.limit(0), ranks, public.PATTERN).count() == 0


def brute_audit(rows):
    """The cheapest, then least audit over all edit strings with at most one insertion before each row and two behind the last."""
    best = None
    keep = {(None, "s"): "s", (None, "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    free = {None: "u", "s": "u", "u": "a", "a": "u"}
    for edits in itertools.product(["D", "K", "R", "ID", "IK", "IR"], repeat=len(rows)):
        for tail in ("", "I", "II"):
            state, cost, ok = None, 0, True
            taken = iter(rows)
            for e in "".join(edits) + tail:
                if e == "I":
                    state, cost = free[state], cost + 2
                    continue
                letter, fault = next(taken)
                if e == "D":
                    cost += 3
                    continue
                cost += (fault == structure_repair.CUT) + 2 * (e == "R")
                state = keep.get((state, letter)) if e == "K" else free[state]
                if fault >= structure_repair.BLANK or state is None:
                    ok = False
                    break
            if ok and state in (None, "a"):
                best = min(best or (99, ""), (cost, "".join(edits) + tail))
    return best


def test_cheapest_audit():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice("suaax"), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 5))]
        audits = structure_repair.Audits()
        best = structure_repair.cheapest(rows, 0, audits)
        assert min((best[s][0], audits.text(best[s][1])) for s in (0, 3) if best[s]) == brute_audit(rows), rows


def test_audits_compare_when_hashes_collide(monkeypatch):
    monkeypatch.setattr(structure_repair, "_BASE", 0)  # the hash is the last letter alone
    rng = random.Random(4)
    audits, nodes = structure_repair.Audits(), [0]
    for _ in range(300):
        nodes.append(audits.add(rng.choice(nodes[-8:]), rng.choice("DIK")))
    for a, b in [rng.choices(nodes, k=2) for _ in range(2000)]:
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_cut_conversations_give_the_same(talks, cut):
    whole, parts = (structure_repair.repair(structure_repair.damaged(talks), present_col="present", part_rows=n) for n in (10_000, cut))
    fields = lambda df: collections.Counter((r.conv_id, r.place, r.role, r.text, r.report and tuple(r.report)) for r in df.collect())
    assert fields(whole) == fields(parts)
    ranks = public.path("byte_bpe_50k.tiktoken")
    whole, parts = (chat_format.read_back(chat_format.format_conversations(talks, ranks, public.PATTERN, part_chars=n)) for n in (1 << 20, cut))
    assert rows_of(whole) == rows_of(parts)


def test_one_long_conversation_is_spread(spark):
    """A conversation with most of the rows, over many tasks, against one program over all of it."""
    n = 6000
    rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "element_at(array('user', 'assistant', 'user', 'system'), cast(pmod(hash(id), 4) + 1 AS int)) AS role",
                                     "concat('t', pmod(hash(id, 7), 4000), if(pmod(hash(id, 9), 5) = 0, '', '.')) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marked = structure_repair.marked(rows, "conv_id", "turn", "role", "text", F.lit(True))
        assert marked.select(F.spark_partition_id().alias("p")).distinct().count() > 3
        got = structure_repair.repair(rows, with_turns=False, part_rows=500).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    seen, light = set(), []
    for r in sorted(rows.collect(), key=lambda r: r.turn):
        light.append((r.role[0], 3 if (r.role, r.text) in seen else 0 if r.text[-1] == "." else 1))
        seen.add((r.role, r.text))
    audits = structure_repair.Audits()
    best = structure_repair.cheapest(light, 0, audits)
    cost, audit = min((best[s][0], audits.text(best[s][1])) for s in (0, 3) if best[s])
    assert len(got) == 1 and (got[0].report.cost, got[0].report.audit) == (cost, audit)


def test_masked_tokens_are_the_answers(spark, talks):
    import tiktoken

    ranks = public.path("byte_bpe_50k.tiktoken")
    template = chat_format.Template()
    ids = {c: 50256 + i for i, c in enumerate(template.controls())}
    lib = tiktoken.Encoding("x", pat_str=public.PATTERN, mergeable_ranks=dict(bpe.read_ranks(ranks)), special_tokens=ids)
    for r in chat_format.format_conversations(talks, ranks, public.PATTERN).collect():
        got = np.frombuffer(r.ids, "<u4")
        assert got.tolist() == lib.encode(r.text, allowed_special="all")
        learnt = got[np.frombuffer(r.mask, np.uint8) == 1].tolist()
        assert lib.decode(learnt) == "".join(template.escape(t) for role, t in template.parse(r.text) if role == "assistant")


def test_templates_must_be_reversible():
    template = chat_format.Template()
    for text in ("", "\\", "</s>[INST] ok [/INST]", "<\\s>", "<<<SYS>>", "[[INST]\\\\", "<|endoftext|>\\<s>"):
        assert template.unescape(template.escape(text)) == text
        assert not any(c in template.escape(text) for c in template.controls())
        assert template.parse(template.render([("user", text), (text, text), ("assistant", text)])[0]) == [("user", text), (text, text), ("assistant", text)]
    for marks in ({"user": ("<a", "a>")}, {"user": ("<a>", "x<a>")}, {"user": ("\\u", "[/U]")}):
        with pytest.raises(ValueError):
            chat_format.Template(marks=marks)
