"""Canonical license texts."""

import textwrap

from pulseweave.llm.licenses import KNOWN, canonical, scan_licenses
from pyspark.sql import functions as F


def test_equivalent_texts_share_a_form(spark):
    mit = KNOWN["MIT"][1]
    texts = [
        mit, mit.upper(), "Copyright (c) 2020 A. Person\nCopyright 2021 B\n\n" + mit.replace(" ", "\n  "), mit.replace(",", " ;"),
        mit.replace("sublicense", "sub-licence"), "© 2019 X\nAll rights reserved.\n" + mit,
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical(F.col("t")).alias("c"))
    assert len({r["c"] for r in frame.collect()}) == 1


def test_whole_texts_and_lines(spark):
    mit = KNOWN["MIT"][1]
    docs = [
        (1, mit), (2, "prose\nReleased under the MIT licence\nLicensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "released under the mit license"),
        (6, "prose " * 30_000), (5, "released under the mit license"), (None, "Licence"), (7, mit + " and more"),
    ]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, license string, row int").repartition(3)
    rows = sorted(scan_licenses(frame).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    got = [(r["doc_id"], r["license"], r["n_lines"], r["n_license_lines"], r["line_licenses"]) for r in rows]
    assert got == [
        (1, "MIT", 3, 0, []), (2, None, 3, 2, ["CC-BY-NC-4.0", "MIT"]), (3, None, 0, 0, []), (4, None, 0, 0, []), (5, "MIT", 1, 1, ["MIT"]),
        (5, "MIT", 1, 1, ["MIT"]), (6, None, 1, 0, []), (7, None, 3, 0, []), (None, None, 1, 0, []),
    ]
    assert scan_licenses(frame.limit(0)).count() == 0


def test_own_table_of_licenses(spark):
    known = spark.createDataFrame([("B", "Some terms"), ("A", "some TERMS!"), (None, "x"), ("C", None), ("D", "")], "license string, text string")
    docs = spark.createDataFrame([(1, "Some, terms"), (2, "x"), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in scan_licenses(docs, known).collect()} == {1: "A", 2: None, 3: None}


def test_titles_bullets_and_hard_wraps(spark):
    """Ordinary license files: title, copyright lines, hard-wrapped body; a title within a sentence stays."""
    titles = {
        "MIT": "The MIT License (MIT)", "ISC": "ISC Licence", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "  New BSD License:",
        "Zlib": "zlib License", "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003", "0BSD": "BSD Zero Clause License",
        "Unlicense": "The Unlicense", "MIT-0": "MIT No Attribution License",
    }
    docs, want = [], {}
    for name, texts in KNOWN.items():
        for text in texts:
            for width in (40, 72):
                body = "\n".join(w for part in text.split("\n") for w in textwrap.wrap(part, width, break_long_words=False))
                file = "\r\n".join((titles.get(name, ""), "", "Copyright (c) 2024 Some One", "All rights reserved.", *body.split("\n")))
                want[len(docs)] = name
                docs.append((len(docs), file))
    own = len(docs)
    docs += [(own, "see the MIT License for more"), (own + 1, "MIT License"), (own + 2, "SPDX-License-Identifier: Zlib\nx\nMIT License\ny")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in scan_licenses(frame).collect()}
    assert {i: rows[i]["license"] for i in want} == want
    got = [(rows[i]["license"], rows[i]["n_lines"], rows[i]["line_licenses"]) for i in range(own, own + 3)]
    assert got == [(None, 1, []), (None, 0, []), (None, 3, ["Zlib"])]


def test_phrases_go_on_over_line_breaks(spark):
    texts = ["ten per cent of the copyright owner", "ten per\ncent of the copyright\n\n- owner", "ten percent of the copyright holder"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical(F.col("t")).alias("c"))
    assert {r["c"] for r in frame.collect()} == {"ten percent of the copyright holder"}
