"""Licence scans: oracle, inheritance from the nearest directory, edge rows, anchors lose nothing."""

import math

from helpers import same_rows

from quire.llm import licenses
from quire.llm.licenses import scan


def test_oracle(spark, sf):
    same_rows(spark, licenses.op8_license_scan, licenses.OP8_SQL, sf)


def test_inheritance_and_edge_rows(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "code"),
        (3, "a/b/COPYING", "text\nThis work is licensed under the GNU General Public License, version 3."),
        (4, "a/z.py", None),
        (5, "q/r.py", ""),
        (6, "a/b/c/own.py", "/* All rights reserved. */"),
        (7, None, "none"),
        (8, "top.py", "x " * 50_000),
        (9, "ab/y.py", "not below a"),
        (9, "ab/y.py", "not below a"),
        (None, "a/b/n.py", "no id"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    got = scan(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.license, r.origin, r.inherited_from) for r in got}
    assert by[1] == ("MIT", "own", None) and by[2] == ("GPL-3.0", "inherited", "a/b") and by[4] == ("MIT", "inherited", "a")
    assert by[6] == ("proprietary", "own", None) and by[None] == ("GPL-3.0", "inherited", "a/b")
    assert all(by[k] == (None, "none", None) for k in (5, 7, 8, 9))
    assert scan(df.limit(0)).collect() == []


def test_a_licence_at_the_root_reaches_all(spark):
    df = spark.createDataFrame([(1, "LICENSE", "Licensed under CC BY-NC 4.0."), (2, "a/b/c", "x")], "doc_id long, path string, text string")
    assert {r.doc_id: (r.license, r.inherited_from) for r in scan(df).collect()} == {1: ("CC-BY-NC-4.0", None), 2: ("CC-BY-NC-4.0", "")}


def test_lines_without_anchors_cannot_reach_the_threshold():
    _, rows, anchors = licenses.notice_weights(1000, {"the": 990, "license": 40, "work": 300, "is": 900, "licensed": 30})
    for k in {r[0] for r in rows}:
        assert math.sqrt(sum(w * w for n, _, t, w in rows if n == k and t not in anchors)) < licenses.THRESHOLD


def test_wrapped_embedded_and_standard_headers(spark):
    bsd = "# Copyright (c) 2020, A. All rights reserved.\n#\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:\n# one"
    gpl = "/* a.c\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version.\n */"
    mit = dict(licenses.PASSAGES)["MIT"].replace(" ", "\n", 40)
    rows = [
        (1, "a/1", bsd, "BSD"), (2, "b/2", gpl.format(2), "GPL-2.0"), (3, "c/3", gpl.format(3), "GPL-3.0"), (4, "d/4", gpl.format(3).replace("General", "Lesser General"), "LGPL-3.0"),
        (5, "e/5", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n text", "GPL-3.0"),
        (6, "f/6", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache-2.0"), (7, "g/7", "MIT License\n\nCopyright (c) A", "MIT"),
        (8, "h/8", "// SPDX-License-Identifier: Zlib\nint a;", "Zlib"), (9, "i/9", "# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), (10, "j/10", "All rights reserved.\n" + mit, "MIT"),
        (11, "k/11", "this long line says that all of the code which it goes with has been released under the MIT License by those who wrote it some years ago", "MIT"),
        (12, "l/12", "one may compare the MIT License and others; the software is free and so is the permission to copy", None),
        (13, "m/13", "A corporation of 2020, all rights reserved, and further words that make this line a long one", "proprietary"),
    ]
    others = [(100 + i, f"z/{i}", "the software is in the public domain of all people and the rights to use it are with you, as a copy of this work " * 3, None) for i in range(20)]
    df = spark.createDataFrame([r[:3] for r in rows + others], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in scan(df).collect()}
    assert got == {k: (w, "own" if w else "none") for k, _, _, w in rows + others}


def test_rows_without_or_with_one_id(spark):
    """Each row has its own text's licence, and a licence file needs no id for its directory."""
    rows = [
        (None, "a/LICENSE", "Released under the MIT License.", "MIT"), (None, "a/x", "code", "MIT"), (None, "b/x", "code", None),
        (7, "c/x", "Licensed under CC BY 4.0.", "CC-BY-4.0"), (7, "d/x", "other text", None), (7, "e/COPYING", "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), (7, "e/y", "other text", "CC-BY-NC-4.0"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")
    assert sorted((r.path, r.license) for r in scan(df).collect()) == sorted((p, w) for _, p, _, w in rows)


def test_a_very_long_licence_file(spark):
    """Whole texts count, and an anchor on every line costs one short passage each."""
    mit = dict(licenses.PASSAGES)["MIT"]
    df = spark.createDataFrame([(1, "a/LICENSE", "word " * 30_000 + mit + " word" * 30_000), (2, "b/x", "license software\n" * 3_000)], "doc_id long, path string, text string")
    assert {r.doc_id: r.license for r in scan(df).collect()} == {1: "MIT", 2: None}


def test_titles_and_tags_of_any_form(spark):
    rows = [
        (1, " " * 90 + "MIT License" + " " * 90, ["MIT"]), (2, "=" * 40 + " The MIT License " + "=" * 40, ["MIT"]), (3, "BSD 3-Clause License\n\nCopyright", ["BSD"]), (4, "# SPDX-License-Identifier: mit", ["MIT"]),
        (5, "SPDX-License-Identifier: NOASSERTION", []), (6, "x SPDX-License-Identifier: (MIT OR apache-2.0)\n", ["Apache-2.0", "MIT"]), (7, "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND bsd-3-clause", ["BSD", "GPL-2.0"]),
        (8, "spdx-license-identifier: NONE", []), (9, "the MIT License and more words in this line", []), (10, "SPDX-License-Identifier: LicenseRef-Own", ["LicenseRef-Own"]),
        (11, "Permission to use, copy, modify, and/or distribute this\nsoftware for any purpose with or without fee is hereby granted,\nprovided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
        (12, "ISC License", ["ISC"]), (13, "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", ["Unlicense"]),
    ]
    df = spark.createDataFrame([(i, f"{i}/x", t) for i, t, _ in rows], "doc_id long, path string, text string")
    keyed = licenses.keyed(df)
    got = {r.doc_id: r.found for r in licenses.own_licenses(keyed).join(keyed.select("r1", "r2", "row.doc_id"), ["r1", "r2"]).collect()}
    assert got == {i: want for i, _, want in rows if want}
