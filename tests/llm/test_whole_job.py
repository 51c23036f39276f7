"""Cases that a cut would lose: rare and repeated contexts, text beyond a neighbouring match, wrapped licence texts."""

from fiscus.llm import licenses, pii


def spans_of(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.spans.split(",") for r in pii.report(pii.find(d)).collect()}


def at(text, word):
    return f"term:{text.index(word)}:{text.index(word) + len(word)}"


def test_pii_terms_need_no_number_of_contexts(spark):
    once = "written by zebulon at z@corp.org for all of them"
    signed = "Contact Jane Doe at me@site.com, Berlin office"
    rows = [(0, once)] + [(i, f"{signed} page {i}") for i in range(1, 40)] + [(i, f"written for all of them by hand {i}") for i in range(40, 400)]
    got = spans_of(spark, rows)
    assert at(once, "zebulon") in got[0] and at(once, "written") not in got[0]
    assert all(at(signed, w) in got[i] for i in range(1, 40) for w in ("Jane", "Doe", "Berlin"))
    assert got[50] == [""]


def test_pii_context_is_the_whole_text(spark):
    from fiscus.llm.common import keyed

    card = "card 4111 1111 1111 1111 exp 12/25 holder Mary Smith"
    mails = "a@x.com, b@y.com Jane Doe"
    long = f"first {'word' * 80} m@x.com {'-' * 300} second"
    glued = "one two three +49 123 45678901xyz four"
    rows = [(1, card), (2, mails), (3, long), (4, glued), (4, glued), (5, "no data 12 here"), (6, "é x@y.zz")]
    d = keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = {(r.k1, r.v): (r.before, r.after) for r in pii.base_spans(d, 5).collect()}
    assert got == {
        (1, "4111 1111 1111 1111"): (["card"], ["exp", "12", "25", "holder", "mary"]),
        (2, "a@x.com"): ([], ["b", "y", "com", "jane", "doe"]), (2, "b@y.com"): (["a", "x", "com"], ["jane", "doe"]),
        (3, "m@x.com"): (["first", "word" * 80], ["second"]), (4, "+49 123 45678901"): (["one", "two", "three"], ["four"]),
        (6, "x@y.zz"): (["é"], [])}


def test_pii_terms_go_from_all_documents(spark):
    named, bare = "asked zebulon at z@corp.org about it", "Zebulon was asked about it"
    rows = [(i, named) for i in range(20)] + [(i, bare) for i in (20, 21)] + [(i, f"was asked about it by hand {i}") for i in range(22, 400)]
    got = spans_of(spark, rows)
    assert at(named, "zebulon") in got[0] and got[20] == got[21] == [at(bare, "Zebulon")]
    assert got[30] == [""]


def test_pii_terms_of_any_length(spark):
    short, han = "mail from Jo Li to jl@x.org", "王伟 at a0@b.cn"
    rows = [(0, short), (0, short), (1, han), (None, short), (2, ""), (3, None)] + [(i, f"mail from all of them at hand to page {i}") for i in range(4, 400)]
    got = spans_of(spark, rows)
    assert {at(short, "Jo"), at(short, "Li")} <= set(got[0]) == set(got[None]) and at(han, "王伟") in got[1]
    assert not {at(short, "mail"), at(short, "from"), at(short, "to"), at(han, "at")} & {*got[0], *got[1]}
    assert got[2] == got[3] == got[50] == [""]


MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""


def test_licenses_of_wrapped_texts(spark):
    want = {"MIT": ("MIT/text,MIT/grant", "mit-grant,mit-keep,as-is"),
            "Apache-2.0": ("Apache-2.0/header,Apache-2.0/notice", "apache-2-notice,apache-comply,apache-copy"),
            "BSD-3-Clause": ("BSD-3-Clause/grant", "bsd-grant,bsd-endorse,bsd-as-is")}
    rows = []
    for name, text in zip(want, (MIT, APACHE, BSD)):
        for start in ("", "# ", "// ", " * ", ";; ", "dnl "):
            rows.append((name, "\n".join(start + x for x in text.split("\n"))))
        rows.append((name, text.replace("\n", "\r\n")))
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for r in licenses.scan(d).collect():
        name = rows[r.doc_id][0]
        assert (r.licenses, r.rules, r.sentence_ids) == (name, *want[name]), rows[r.doc_id]
    # a sentence does not run over the end of another one, and is whole
    d = spark.createDataFrame([(1, "Released under the. MIT License"), (2, "Not released under the MIT License."), (3, "Title\nReleased under\nthe MIT License */")],
                              "doc_id long, text string")
    assert {r.doc_id: r.n_sentences for r in licenses.scan(d).collect()} == {1: 0, 2: 0, 3: 1}


def test_licenses_of_the_common_kinds(spark):
    want = {"Distributed under the MIT License.": "MIT", "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "/* SPDX-License-Identifier: MIT */": "MIT",
            "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "# SPDX-License-Identifier: CC-BY-4.0": "CC-BY-4.0",
            "This library is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
            "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0", "Released under the ISC License": "ISC",
            "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy": "MPL-2.0",
            "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
            "copyright notice and this permission notice appear in all copies.": "ISC",
            "This project is licensed under the BSD 2-Clause License": "BSD-2-Clause", "This work is released under CC0 1.0 Universal.": "CC0-1.0",
            "This is free and unencumbered software released into the public domain.": "Unlicense", "GPL-2.0 or MIT": ""}
    d = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licenses.scan(d).collect()} == dict(enumerate(want.values()))
    ids = [s for group in licenses.SENTENCES.values() for s in group]
    assert len(ids) == len(set(ids))


def test_filter_loses_no_value(spark):
    from pyspark.sql import functions as F

    from fiscus.llm.common import maybe_in

    x = spark.range(3000).withColumn("h", F.when(F.col("id") % 50 > 0, F.xxhash64("id")))
    got = {bits: {r.id for r in maybe_in(x, F.col("h"), x.where("id % 3 = 0").select("h"), bits).where("maybe").collect()} for bits in (64, 1 << 24)}
    asked = {i for i in range(0, 3000, 3) if i % 50}
    assert asked <= got[1 << 24] <= got[64] and len(got[1 << 24] - asked) < 10
    assert not maybe_in(x, F.col("h"), x.limit(0).select("h")).where("maybe").count()


def test_documents_of_no_span_and_no_copy_are_not_moved(spark):
    """Whatever the spans and the near copies measure, the stages move only documents that may meet them."""
    import corpus_pipeline as P

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} page {i} of it") for i in range(3)] + [(i, f"mail{i} " * 9 + f"from a{i}@b.org") for i in (3, 4)] + [(5, None), (None, text)]
    rows += [(i, " ".join(f"{i}x{j}" for j in range(30))) for i in range(6, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stages = {f: f(spark, docs, "") for f in (P.near_stage, P.pii_stage)}
        for df in stages.values():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Union" in plan and "_mask" in plan
        near, private = ({r.doc_id: r.text for r in df.collect()} for df in stages.values())
        assert set(near) == {0, 3, 4, 5, None, *range(6, 40)}
        assert {i: t for i, t in private.items() if i not in (3, 4)} == {i: t for i, t in rows if i not in (3, 4)}
        assert all("[EMAIL]" in private[i] and "@" not in private[i] for i in (3, 4))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeat_filter_holds_what_comes_twice(spark):
    import numpy as np
    import pyarrow as pa

    from fiscus.llm.common import PACKED, in_bits, packed_hashes, repeat_filter

    bits = 1 << 20
    alone = np.random.default_rng(7).integers(0, 1 << 64, 30_000, dtype=np.uint64)
    edges = np.array([0, 1, 2, bits - 1, bits, 1 << 63, (1 << 64) - 1], np.uint64)
    parts = [np.concatenate([alone[i::4], edges[:4] if i % 2 else edges[4:]]) for i in range(4)]
    parts[2] = np.concatenate([parts[2], parts[2][:50], parts[2][:50], alone[0:200:4]])
    twice = np.concatenate([edges, parts[2][:50], alone[0:200:4]])

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from packed_hashes([parts[i][:100], parts[i][:0], parts[i][100:].view(np.int64)], bits)

    packed = spark.range(4).repartition(4).mapInArrow(run, PACKED)
    got = repeat_filter(packed, bits)
    assert in_bits(got, twice).all() and in_bits(got, twice.view(np.int64)).all()
    false = np.setdiff1d(alone, twice)
    assert in_bits(got, false).mean() < 0.01
    assert not repeat_filter(packed.limit(0), bits).any()
    big = list(packed_hashes([np.random.default_rng(8).integers(0, 1 << 64, 400_000, dtype=np.uint64)], 1 << 27))
    assert sum(pa.compute.binary_length(b.column(1)).to_numpy().sum() for b in big) < 3.2 * 400_000


def test_sets_of_one_row_and_their_ngrams_are_not_moved(spark, monkeypatch):
    """Only sets that share their rows or ids with others are written as heads, and only n-grams of several prefixes are dealt."""
    from fiscus.llm import ngram_join as N

    wide = [" ".join(f"{i}x{j}" for j in range(40)) for i in range(30)]
    rows = list(enumerate(wide)) + [(50, wide[3] + " more"), (51, wide[4]), (6, wide[7] + " end"), (None, wide[8]), (None, wide[8] + " no"), (60, None)]
    held, dealt = {}, []
    monkeypatch.setattr(N, "written", lambda df, name, f=N.written: held.setdefault(name, f(df, name)) if name == "set-heads" else f(df, name))
    monkeypatch.setattr(N, "_pairs_of_blocks", lambda df, *a, f=N._pairs_of_blocks: dealt.append(df) or f(df, *a))
    got = {(r.doc_id, r.n_shingles): r.component_id for r in N.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(i, 38): i for i in range(30)} | {(50, 39): 3, (51, 38): 4, (6, 39): 6, (None, 38): None, (None, 39): None, (60, 0): 60}
    assert got == want | {(7, 38): 6}
    assert {(r.id, r.rep) for r in held["set-heads"].collect() if r.id == r.rep} <= {(4, 4), (6, 6)} and held["set-heads"].count() <= 3
    # 39 and 38 n-grams of near sets: their prefixes of 5 and 4 at most, and those of the filter's errors
    assert {r.id for r in dealt[0].select("id").distinct().collect()} <= {3, 50, 6, 7, *[r.id for r in held["set-heads"].collect()]}


def test_bpe_block_is_rows_of_bounded_size(spark):
    """A block's texts reach their ids in pieces, without one object that holds all its lists and tokens."""
    import public_tokenizers as public
    import tiktoken

    from fiscus.llm import bpe

    ranks, n = public.path("byte_bpe_50k.tiktoken"), 40_000
    texts = [f"t{i} " + "ab cd " * n for i in range(9)] + ["", None, "x" + " y" * (8 * n), "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = bpe.split_blocks(docs, public.PATTERN, 3, "doc_id", "text").where("kind = 1").collect()
    assert len({r.block for r in rows}) == 1 and sorted(i for r in rows for i in r.doc_ids) == list(range(len(texts)))
    assert len(rows) > 1 and max(sum(np_words(r.slots)) for r in rows) <= 1 << 19
    got = bpe.round_trip(docs, ranks, public.PATTERN)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "collect_list" not in plan and "collect_set" not in plan
    lib = tiktoken.Encoding("x", pat_str=public.PATTERN, mergeable_ranks=dict(bpe.read_ranks(ranks)), special_tokens={})
    out = {r.doc_id: (np_words(r.ids), bytes(r.decoded)) for r in got.collect()}
    assert out == {i: (lib.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}
    assert {r.doc_id: np_words(r.ids) for r in bpe.encode(docs, ranks, public.PATTERN).collect()} == {i: x for i, (x, _) in out.items()}


def np_words(raw):
    import numpy as np

    return np.frombuffer(raw, "<u4").tolist()


def test_pii_words_keep_more_partitions_than_a_shuffle(spark):
    """Texts whose words take much room are not merged into few tasks."""
    from fiscus.llm.common import keyed
    from fiscus.llm.pii import base_spans

    rows = [(i, f"mail a{i}@b.org now") for i in range(200)]
    d = keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert base_spans(d, 5).rdd.getNumPartitions() == 2 * n
