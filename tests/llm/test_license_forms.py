"""Short forms, SPDX expressions and siblings of licenses; all templates against a search without index or bands."""

import numpy as np
import pytest
from fixtures import frame
from opsgraph.llm import licenses


@pytest.mark.parametrize("line, ids", [
    ("MIT", ["MIT"]), (" (MIT OR Apache-2.0)", ["MIT", "Apache-2.0"]), (" EPL-2.0 */", ["EPL-2.0"]), (" GPL-2.0+ AND (BSD-3-Clause OR MIT) see", ["GPL-2.0+", "BSD-3-Clause", "MIT"]),
    (" GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only WITH Classpath-exception-2.0"]), (" ((Zlib))", ["Zlib"]), ("", []), (" OR MIT", []), (" -->", []), (" MIT.", ["MIT"]),
])
def test_expressions(line, ids):
    assert [x for x, _ in licenses.declared_expression(line.encode())] == ids


FORMS = {
    "x The MIT License (MIT) y": "MIT-title", "x Licensed under the Apache License 2.0 y": "Apache-2.0-short", "x\nLicense: GPLv3\ny": "GPL-3-declared", "under the GNU GPL version 3 or later, as": "GPL-3-version-later",
    "x BSD 3-Clause License y": "BSD-3-Clause-title", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software": "Unlicense",
    "// SPDX-License-Identifier: EPL-2.0\ncode": "EPL-2.0-spdx", "see http://www.apache.org/licenses/LICENSE-2.0 for": "Apache-2.0-url", "License: unknown to us": None, "the license: mitigation": None, "SPDX-License-Identifier:": None,
}


def test_short_forms(spark):
    got = {}
    for r in licenses.scan(frame(spark, list(enumerate(FORMS)))).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert {i: got.get(i, set()) for i in range(len(FORMS))} == {i: {v} if v else set() for i, v in enumerate(FORMS.values())}


def test_expression_in_text(spark):
    text = "é /* SPDX-License-Identifier: (MIT OR Apache-2.0) */"
    rows = licenses.scan(frame(spark, [(1, text), (2, None), (3, "")])).collect()
    raw = text.encode()
    assert sorted((r["license"], raw[r["start_byte"] : r["end_byte"]].decode()) for r in rows) == [
        ("Apache-2.0-spdx", "SPDX-License-Identifier: (MIT OR Apache-2.0"), ("MIT-spdx", "SPDX-License-Identifier: (MIT")]


def test_sibling_is_not_named(spark):
    gpl = licenses.all_templates()["GPL-3.0-text"]
    affero = gpl.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", 1).replace("29 June 2007", "19 November 2007", 1)
    got = {r["doc_id"]: r["license"] for r in licenses.scan(frame(spark, [(1, gpl), (2, "Intro\n" + affero)])).collect()}
    assert got == {1: "GPL-3.0-text", 2: "sibling-of-GPL-3.0-text"}


def test_no_template_is_missed(spark):
    """Each template, alone and with every 25th word changed, is found; what is reported agrees with a plain common subsequence."""
    templates = {k: v for k, v in licenses.all_templates().items() if len(v) < 2500}
    hashes = lambda t: licenses.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[3]
    docs = []
    for t in templates.values():
        w = t.split()
        docs += ["before it. " + t + " after it", " ".join("other" if k % 25 == 12 and len(w) >= 40 else x for k, x in enumerate(w))]
    found = {}
    for r in licenses.scan(frame(spark, list(enumerate(docs)))).collect():
        found.setdefault(r["doc_id"], []).append(r)
    for d, text in enumerate(docs):
        h = hashes(text)
        own = list(templates)[d // 2]
        best = max(r["n_matched"] for r in found[d])
        # the best of all templates by an unbounded alignment is reported, if not by name then by one that matches as much
        assert best >= licenses.most_common(hashes(templates[own]), h), own
        for r in found[d]:
            if not r["license"].endswith(("-spdx", "-declared")):
                raw = text.encode()[r["start_byte"] : r["end_byte"]].decode("utf-8", "ignore")
                assert licenses.most_common(hashes(templates[r["license"].removeprefix("sibling-of-")]), hashes(raw)) >= r["n_matched"] > 0
