import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlens.llm.ann import nearest
from spanlens.llm.license import license_scan, own_licences
from spanlens.llm.mixing import copies, curriculum, source_targets
from spanlens.llm.warc import canonical_url, header_lines, resolve_revisits

from .common import SF, WORD, awkward, empty


def test_licences(spark):
    rows = [
        ("r/LICENSE", "Released under the MIT License."),
        ("r/a/x.py", "code\ncode"),
        ("r/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        ("r/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("r/a/b/c/z.py", None),
        ("q/none.txt", "the license of nothing in particular that anybody has ever heard of before today"),
        ("q/none.txt", ""),
        (None, "Released under the MIT License."),
        ("top.txt", "word " * 50_000),
    ]
    found = {r["path"]: (r["licence"], r["found"], r["licence_dir"]) for r in license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {
        "r/LICENSE": ("MIT", "own", None), "r/a/x.py": ("MIT", "inherited", "r"), "r/a/b/y.py": ("Apache-2.0", "own", None), "r/a/b/COPYING": ("GPL-3.0", "own", None),
        "r/a/b/c/z.py": ("GPL-3.0", "inherited", "r/a/b"), "q/none.txt": (None, "none", None), "top.txt": (None, "none", None),
    }
    none = spark.createDataFrame([], "path string, text string")
    assert license_scan(none).count() == 0 and own_licences(none.withColumnRenamed("path", "file")).count() == 0


GNU = "{title}\n{version}\n\n Copyright (C) Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n\t\t\t    Preamble\n\n  The licenses for most software are designed to take away your\nfreedom to share and change it.  By contrast, the GNU General Public\nLicense is intended to guarantee your freedom to share and change free\nsoftware--to make sure the software is free for all its users.\n\n  TERMS AND CONDITIONS\n\n  0. This License applies to any program or other work which contains a notice.\n" + "\n  Clause of the terms that goes on for many words about copies and changes.\n" * 40
MIT_BODY = '{start}Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED.\n'
BSD_BODY = "Copyright (c) 2019, Some Company\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.\n"
THIRD = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
CASES = {
    "gpl2/COPYING": (GNU.format(title="\t\t    GNU GENERAL PUBLIC LICENSE", version="\t\t       Version 2, June 1991"), "GPL-2.0"),
    "gpl3/COPYING": (GNU.format(title="                    GNU GENERAL PUBLIC LICENSE", version="                       Version 3, 29 June 2007"), "GPL-3.0"),
    "lgpl/COPYING": (GNU.format(title="GNU LESSER GENERAL PUBLIC LICENSE", version="Version 2.1, February 1999"), "LGPL-2.1"),
    "lgpl3/COPYING": (GNU.format(title="GNU LESSER GENERAL PUBLIC LICENSE", version="Version 3, 29 June 2007"), "LGPL-3.0"),
    "agpl/COPYING": (GNU.format(title="GNU AFFERO GENERAL PUBLIC LICENSE", version="Version 3, 19 November 2007"), "AGPL-3.0"),
    "gpl/COPYING": ("GNU GENERAL PUBLIC LICENSE\n", "GPL"),
    "mit/LICENSE": (MIT_BODY.format(start="MIT License\n\nCopyright (c) 2020 Example Ltd.\n\n"), "MIT"),
    "mit2/LICENSE": (MIT_BODY.format(start=""), "MIT"),
    "bsd2/LICENSE": (BSD_BODY.format(third=""), "BSD-2-Clause"),
    "bsd3/LICENSE": (BSD_BODY.format(third=THIRD), "BSD-3-Clause"),
    "isc/LICENSE": ("Copyright (c) 2004 Somebody\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n", "ISC"),
    "apache/LICENSE": ("\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0"),
    "a/wrapped.c": ("/*\n * Licensed under the Apache License, Version 2.0 (the\n * \"License\"); you may not use this file except in compliance with the\n * License.  You may obtain a copy of the License at\n *\n *    http://www.apache.org/licenses/LICENSE-2.0\n */\nint main;\n", "Apache-2.0"),
    "a/gpl2.c": ("// This program is free software; you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation; either version 2 of the License, or\n// (at your option) any later version.\n\nint main;\n", "GPL-2.0"),
    "a/gpl3.py": ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nimport x\n", "GPL-3.0"),
    "a/tag.rs": ("// SPDX-License-Identifier: MIT\nfn main() {}\n", "MIT"),
    "a/tag.c": ("/* SPDX-License-Identifier: GPL-2.0-or-later */\n", "GPL-2.0"),
    "a/tag.h": ("/* SPDX-License-Identifier: LicenseRef-own */\n", None),
    "a/extra.py": ("# Released under the MIT License by Example Ltd.\n", "MIT"),
    "a/extra2.py": ("# This file is licensed under the Apache License, Version 2.0.\n", "Apache-2.0"),
    "a/gpl2line.py": ("# This work is licensed under the GNU General Public License, version 2.\n", "GPL-2.0"),
    "a/talk.md": ("We discuss at length which license would be best for the work of our project and its many users.\n", None),
    "a/free.txt": ("Copyright (c) 2001 Somebody. All rights reserved.\n", None),
}


@pytest.mark.parametrize("more", [0, 300])
def test_whole_licence_files_and_headers(spark, more):
    """Titles with versions, bodies without titles, wrapped comments, tags and extra words, in a small and a larger corpus."""
    rows = [(path, text) for path, (text, _) in CASES.items()] + [(f"z{i}/{i}.txt", f"Released under license {i} by holder{i}, copyright {i}.") for i in range(more)]
    found = {r["file"]: r["licence"] for r in own_licences(spark.createDataFrame(rows, "file string, text string")).collect()}
    assert {p: found.get(p) for p in CASES} == {p: want for p, (_, want) in CASES.items()}
    assert len(found) == sum(want is not None for _, want in CASES.values())
    clash = spark.createDataFrame([(*r, "x", 1.0, "y") for r in rows], "path string, text string, licence string, score double, file string")
    assert license_scan(clash.repartition(3)).columns == ["path", "licence", "score", "found", "licence_dir"] and license_scan(clash).count() == len(rows)


def test_nearest_recall_and_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    out = nearest(vectors, vectors.where("vec_id % 20 = 0")).toPandas()
    ids, data = zip(*[(r[0], r[1]) for r in vectors.orderBy("vec_id").collect()], strict=True)
    ids, data = np.array(ids), np.array(data, dtype=np.float64)
    hits = total = 0
    for q, part in out.groupby("query_id"):
        score = (data * data[np.searchsorted(ids, q)]).sum(axis=1)
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and np.allclose(part["score"], score[np.searchsorted(ids, part["vec_id"])], atol=1e-12, rtol=0)
        hits += len(set(best) & set(part["vec_id"]))
        total += 20
    assert hits >= 0.9 * total


@pytest.mark.parametrize("list_rows", [80, 50])
def test_nearest_recall_over_many_lists(spark, monkeypatch, list_rows):
    from spanlens.llm import ann

    monkeypatch.setattr(ann, "LIST_ROWS", list_rows)  # 25 and 40 lists
    monkeypatch.setattr(ann, "SAMPLE", 400)  # a fifth, so that most neighbours can only come from lists
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    out = nearest(vectors, vectors.where("vec_id % 20 = 0")).toPandas()
    ids, data = zip(*[(r[0], r[1]) for r in vectors.orderBy("vec_id").collect()], strict=True)
    ids, data = np.array(ids), np.array(data, dtype=np.float64)
    hits = total = 0
    for q, part in out.groupby("query_id"):
        score = (data * data[np.searchsorted(ids, q)]).sum(axis=1)
        score[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(part["vec_id"]))
        assert sorted(part["rank"]) == list(range(1, 21)) and part["vec_id"].nunique() == 20
        total += 20
    print(f"recall@20 {hits / total:.4f} with LIST_ROWS {list_rows}")
    assert total == 20 * vectors.where("vec_id % 20 = 0").count() and hits >= 0.9 * total


def test_nearest_leaves_most_lists_alone_where_vectors_cluster(spark, monkeypatch):
    from spanlens.llm import ann

    rng = np.random.default_rng(2)
    data = rng.standard_normal((60, 24))[rng.integers(0, 60, 50_000)] + 0.25 * rng.standard_normal((50_000, 24))
    vectors = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": data.tolist()})).repartition(4)
    seen = []
    probes = ann._probes
    monkeypatch.setattr(ann, "_probes", lambda *x: seen.append((probes(*x), len(x[4]))) or seen[-1][0])
    out = nearest(vectors, vectors.where("vec_id % 1000 = 0")).toPandas()
    hits = 0
    for q, part in out.groupby("query_id"):
        score = data @ data[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(part["vec_id"]))
    (probed, lists), recall = seen[0], hits / 1000
    print(f"recall@20 {recall:.3f}, {probed} of {lists} lists")
    assert lists == 50 and probed < lists / 2 and recall >= 0.9


def test_candidates_are_abandoned_early():
    from spanlens.llm.ann import scan

    rng = np.random.default_rng(3)
    data = rng.standard_normal((20_000, 64))
    data /= np.linalg.norm(data, axis=1)[:, None]
    queries, kept, hits = data[:40], 0, 0
    score = queries @ data.T
    score[np.arange(40), np.arange(40)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    least = np.sort(score[:, :5000], axis=1)[:, -20]  # of a quarter of the vectors
    for q, own, _, measured in scan(np.arange(20_000), data, np.arange(40), queries, least, 1.0, 20):
        kept += measured
        hits += len(set(own) & set(best[q]))
    print(f"measured {kept / 40 / 20_000:.4f}, recall {hits / 800:.3f}")
    assert kept < 0.05 * 40 * 20_000 and hits >= 0.97 * 800


def test_nearest_takes_odd_vectors(spark):
    good = [(i, [float(i % 5 + 1), 2.0]) for i in range(60)]
    odd = [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [None, 1.0]), (180, [1.0]), (200, [math.inf, 1.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    out = nearest(v, v.where("vec_id % 20 = 0"), k=5).collect()
    assert {r["query_id"] for r in out} == {0, 20, 40}
    first = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == 0)
    assert [x[1] for x in first] == [4, 9, 14, 19, 24] and all(x[2] == 9.0 for x in first)  # ties to the smaller id
    few = nearest(v.where("vec_id < 3"), v.where("vec_id = 0"), k=20).collect()
    assert len(few) == 2 and nearest(v.limit(0), v.limit(0)).count() == 0


def test_revisits(spark):
    rec = [
        (1, "http://A.com/x/", 10, "response", '"v1"', None, None, {"date": "d1", "content-type": "text/html"}),
        (2, "https://www.a.com/x#f", 20, "response", '"v2"', "m2", "g", {"date": "d2", "content-length": "9"}),
        (3, "http://a.com/x?utm_source=z", 30, "revisit", 'W/"v2"', None, None, {"date": "d3", "content-length": "0", "vary": "a"}),
        (4, "http://a.com/x", 15, "revisit", '"v9"', None, None, None),
        (5, "http://a.com/x", 10, "revisit", None, None, None, {}),
        (6, "http://b.com/", 99, "revisit", '"v"', None, None, {}),
        (7, None, 99, "revisit", None, None, None, {}),
        (8, "http://a.com/x", 90000, "revisit", None, "m2", None, {"date": "d8"}),
        (9, "http://a.com/x", 25, "revisit", None, None, "other", {}),
        (10, "http://a.com/x", None, "revisit", None, None, None, {}),
        (3, "http://a.com/x?utm_source=z", 30, "revisit", 'W/"v2"', None, None, {"date": "d3", "content-length": "0", "vary": "a"}),
        (11, "http://a.com/x", 21, "metadata", None, None, None, {}),
        (12, "http://a.com/x", 18, "revisit", None, None, None, {}),
    ]
    df = spark.createDataFrame(rec, "record_id long, uri string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    for width in (4096, 7):
        out = resolve_revisits(df, width).withColumn("h", header_lines(F.col("headers"))).collect()
        got = {r["record_id"]: (r["full_id"], r["outcome"]) for r in out}
        assert len(out) == 10 and got == {3: (2, "resolved"), 4: (1, "mismatch"), 5: (None, "orphan"), 6: (None, "orphan"), 7: (None, "orphan"), 8: (2, "resolved"), 9: (2, "mismatch"), 10: (None, "orphan"), 12: (1, "unchecked")}
        assert next(r["h"] for r in out if r["record_id"] == 3) == "content-length: 9\ndate: d3\nvary: a"
    assert resolve_revisits(df.limit(0)).count() == 0
    same = [(1, "http://a.com/", 10, "response", None, None, d, {"server": d}) for d in ("a", "c", "b")] + [(2, "http://a.com/", ts, "revisit", None, None, "c", {}) for ts in (20, 9000)]
    ties = resolve_revisits(spark.createDataFrame(same, df.schema).withColumn("url", F.lit("clash")).repartition(3)).collect()
    assert [(r["full_id"], r["outcome"], r["headers"]) for r in ties] == [(1, "resolved", {"server": "c"})] * 2
    urls = spark.createDataFrame([("http://www.X.com:80/A?b=1&utm_medium=q&c=2#z",)], "u string").select(canonical_url(F.col("u"))).first()[0]
    assert urls == "x.com/A?b=1&c=2"


def fill(sizes, weights, share=1.5, passes=2):
    """Water-filling by rounds, as it is told: share by weight, stop at the cap, share the rest again."""
    target, open_ = dict.fromkeys(sizes, 0.0), {s for s in sizes if sizes[s]}
    left = share * sum(sizes.values())
    while left > 1e-9 and open_:
        whole = sum(weights[s] for s in open_)
        over = {s for s in open_ if target[s] + left * weights[s] / whole > passes * sizes[s]}
        if not over:
            for s in open_:
                target[s] += left * weights[s] / whole
            break
        for s in over:
            left -= passes * sizes[s] - target[s]
            target[s] = passes * sizes[s]
        open_ -= over
    return target


@pytest.mark.parametrize("awkward_rows", [False, True])
def test_curriculum(spark, awkward_rows):
    docs = awkward(spark) if awkward_rows else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text", "source").collect()
    count = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + count(r["text"])
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill(sizes, {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)})
    out = curriculum(docs).collect()
    assert len(out) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"]) and 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == sum(t["words"] for t in r["takes"]) and all(0 <= t["position"] <= 1 for t in r["takes"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted((str(r["doc_id"]), count(r["text"])) for r in rows)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], str(r["position"]))
    assert sorted(map(key, out)) == sorted(map(key, curriculum(docs.repartition(7)).collect()))
    spots = [r["position"] for r in out if r["position"] is not None]
    assert spots == sorted(spots) and curriculum(empty(spark)).count() == 0


def test_schedule_inverts_demand(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s") for i in range(2000)], "doc_id long, text string, source string")
    out = curriculum(docs, share=1.0, passes=1, weights=(1.0,), schedules=((2.0, 0.0),)).collect()
    early = sum(r["position"] < 0.5 for r in out) / len(out)
    assert abs(early - 0.75) < 0.01  # three quarters of a weight falling from 2 to 0 lie before the middle


def test_copies_come_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = copies(docs)
    assert mixed.columns == docs.columns
    from spanlens.llm.mixing import word_count

    got = {r["source"]: r["w"] for r in mixed.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("w")).collect()}
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    most = docs.select(F.max(word_count(F.col("text")))).first()[0]
    for r in source_targets(sizes).collect():
        assert abs(got.get(r["source"], 0) - r["target"]) <= most / 2 + 1
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert copies(awkward(spark)).columns == awkward(spark).columns and copies(empty(spark)).count() == 0
    assert SF


def test_intermediate_tables_can_be_cleared(spark):
    from spanlens.llm import shared

    table = shared.stored(spark.range(3), "some")
    path = shared._tables[-1].removeprefix("file://")
    import os

    assert table.count() == 3 and os.path.isdir(path)
    shared.clear(spark)
    assert not os.path.isdir(path) and not shared._tables
