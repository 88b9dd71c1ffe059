"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts are sequences of lower-cased words without marks.  Hashes of
``GRAM`` consecutive template words are winnowed (the least of every ``WINNOW``
neighbours, the first and the last always) into an inverted index.  Every gram of
a document is looked up; hits of a template on neighbouring diagonals form one
candidate, whose region is aligned to the template inside a band of ``BAND``
words (half the template's length if that is less); a region spans no more diagonals
than the template has words, so the band stays bounded in repetitive texts.  Templates of
fewer than ``SHORT`` words must match whole, as one word may tell licenses apart.  A template of more than
twice ``PIECE`` words is aligned in pieces of about ``PIECE`` words; pieces of
which half matches are chained in order, so that an insertion does not end the
match, and their matched words are added up.  Reported are the matched coverage
of the template and the byte span of the match in the text; of overlapping
matches the one with most matched words, then the largest coverage.

Licenses that are declared by name need no alignment: ``SPDX-License-Identifier:`` is followed by an expression
that is parsed by its grammar (a row for each id, ``-spdx``), ``License:`` by a usual short name (``-declared``).
A whole text is not named after a sibling whose text it holds: where a word near its beginning tells that it is another license
of the same wording (``SIBLINGS``), it is reported as ``sibling-of-...``.

The templates are a fixed list: notices and opening clauses (``TEMPLATES``) and
whole license texts (the files of ``license_texts``, named with ``-text``); what
is sent to the tasks is bounded by ``MAX_TEMPLATE_BYTES``.

Defined cases: null, empty and blank texts match nothing; matches in a row without
doc_id have a null doc_id; very long texts are
scanned whole; repeated rows are scanned one by one; several matches of a
template in a text are reported each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .textops import _WEIGHTS, LOWER, chunks, mix, prefix_sums, span_hash, word_spans

GRAM, WINNOW, BAND = 3, 4, 8
COVERAGE = 0.8
SHORT = 12
PIECE = 200
MAX_TEMPLATE_BYTES = 16 << 20
# Notices and opening clauses of well-known public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
    "all-rights-reserved-notice": "All rights reserved.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-notice": "Released under the BSD License.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
}
_HEADER = "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
for _name, _work, _kind, _version in (("GPL-2.0", "program", "", "2"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("LGPL-3.0", "library", "Lesser ", "3"), ("AGPL-3.0", "program", "Affero ", "3")):
    TEMPLATES[_name] = _HEADER.format(work=_work, kind=_kind, version=_version)
for _code, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    TEMPLATES.setdefault(f"CC-{_code}-4.0-notice", f"Licensed under CC {_code} 4.0.")
    TEMPLATES.setdefault(f"CC-{_code}-4.0", f"This work is licensed under a Creative Commons {_long} 4.0 International License.")
    TEMPLATES.setdefault(f"CC-{_code}-3.0-notice", f"Licensed under CC {_code} 3.0.")
    TEMPLATES.setdefault(f"CC-{_code}-3.0", f"This work is licensed under a Creative Commons {_long} 3.0 Unported License.")
for _id, _long in (("MIT", "MIT"), ("ISC", "ISC"), ("BSD", "BSD"), ("Apache-2.0", "Apache-2.0"), ("Apache-2.0", "Apache 2.0")):
    for _way, _words in (("under", "Licensed under the {} license"), ("terms", "Licensed under the terms of the {} license"), ("released", "Released under the {} license")):
        TEMPLATES.setdefault(f"{_id}-notice-{_way}", _words.format(_long))
for _kind, _short, _version in (("", "GPL", "2"), ("", "GPL", "3"), ("Lesser ", "LGPL", "2.1"), ("Lesser ", "LGPL", "3"), ("Affero ", "AGPL", "3")):
    TEMPLATES[f"{_short}-{_version}-later"] = f"GNU {_kind}General Public License v{_version} or later"
    TEMPLATES[f"{_short}-{_version}-short"] = f"GNU {_kind}General Public License v{_version}"
# Opening sentences and usual short forms.
TEMPLATES |= {
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "MIT-title": "The MIT License",
    "Apache-2.0-short": "Apache License 2.0",
    "Apache-2.0-url": "apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause-title": "BSD 3-Clause License",
    "BSD-2-Clause-title": "BSD 2-Clause License",
}
for _kind, _version in (("", "2"), ("", "3"), ("Lesser ", "2.1"), ("Lesser ", "3"), ("Affero ", "3")):
    _short = {"": "GPL", "Lesser ": "LGPL", "Affero ": "AGPL"}[_kind]
    TEMPLATES[f"{_short}-{_version}-version-later"] = f"GNU {_short} version {_version} or later"
    TEMPLATES[f"{_short}-{_version}-version"] = f"GNU {_short} version {_version}"
# Words near its beginning that tell a text's siblings, whose own texts aren't held, from it.
SIBLINGS = {"GPL-3.0-text": ("affero",), "GPL-2.0-text": ("affero", "lesser", "library"), "GPL-1.0-text": ("affero", "lesser", "library")}
ALIASES = {"mit": "MIT", "isc": "ISC", "bsd": "BSD", "apache 2.0": "Apache-2.0", "apache-2.0": "Apache-2.0", "apache2": "Apache-2.0", "unlicense": "Unlicense", "zlib": "Zlib",
           **{f"{k}v{v}": f"{k.upper()}-{v}" for k, v in (("gpl", "2"), ("gpl", "3"), ("lgpl", "2.1"), ("lgpl", "3"), ("agpl", "3"))}, "mpl 2.0": "MPL-2.0", "mpl-2.0": "MPL-2.0", "epl-2.0": "EPL-2.0"}
FAMILIES = set(("MIT ISC Apache BSD 0BSD GPL LGPL AGPL GFDL MPL EPL CPL CC CC0 Unlicense Zlib BSL Artistic PSF Python OFL NCSA WTFPL X11 PostgreSQL CDDL EUPL OSL AFL MS Ruby PHP "
                "OpenSSL curl JSON LicenseRef DocumentRef LPPL NPL SISSL W3C Vim ECL CECILL ODbL PDDL UPL BlueOak MulanPSL HPND NTP libpng Libpng Beerware SSPL BUSL Elastic").split())
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9]\+?|[A-Za-z0-9]\+?)")
_ALIAS = re.compile(rb"[ \t]*(" + b"|".join(re.escape(a.encode()) for a in sorted(ALIASES, key=len, reverse=True)) + rb")\+?(?![A-Za-z0-9-])", re.IGNORECASE)


def declared_expression(line: bytes) -> list[tuple[str, int]]:
    """The license ids of an SPDX expression at the start of ``line`` with their ends; exceptions stay with their license.

    Ids of known ``FAMILIES`` are joined by OR and AND, in any number of parentheses; what follows the expression is left alone.
    """
    out: list[tuple[str, int]] = []
    at, depth, want = 0, 0, True
    while m := _TOKEN.match(line, at):
        word = m[1].decode()
        if want and word == "(":
            depth += 1
        elif want and word.rstrip("+").split("-")[0] in FAMILIES:
            out.append((word, m.end()))
            want = False
        elif not want and word == ")" and depth:
            depth -= 1
        elif not want and word == "WITH" and (e := _TOKEN.match(line, m.end())) and e[1] not in (b"(", b")"):
            out[-1] = (f"{out[-1][0]} WITH {e[1].decode()}", e.end())
            m = e
        elif not want and word in ("OR", "AND"):
            want = True
        else:
            break
        at = m.end()
    return out


def _declared(buf: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, h: np.ndarray) -> list[tuple]:
    """``doc, license, n_words, start, end`` of what ``SPDX-License-Identifier:`` and ``License:`` lines name."""
    out = []
    after = buf[np.minimum(end, len(buf) - 1)] == 58 if len(end) else np.zeros(0, bool)
    tag = np.flatnonzero((h == _TAG[2]) & after & (end < off[doc + 1]))
    tag = tag[tag >= 2]
    tag = tag[(h[tag - 1] == _TAG[1]) & (h[tag - 2] == _TAG[0]) & (doc[tag - 2] == doc[tag])]
    plain = np.flatnonzero((h == _TAG[1]) & after & (end < off[doc + 1]))
    for places, first, spdx in ((tag, tag - 2, True), (plain, plain, False)):
        for t, f in zip(places.tolist(), first.tolist()):
            stop = int(off[doc[t] + 1])
            line = buf[int(end[t]) + 1 : stop].tobytes().split(b"\n", 1)[0]
            if spdx:
                found = [(f"{x}-spdx", e, 3 + len(re.findall(r"[A-Za-z0-9]+", x))) for x, e in declared_expression(line)]
            else:
                m = _ALIAS.match(line)
                found = [(f"{ALIASES[m[1].decode().lower()]}-declared", m.end(), 2)] if m else []
            out += [(int(doc[t]), name, n, int(start[f] - off[doc[t]]), int(end[t] + 1 + e - off[doc[t]])) for name, e, n in found]
    return out


_MARKS = np.ones(256, dtype=bool)
_MARKS[48:58] = _MARKS[65:91] = _MARKS[97:123] = _MARKS[128:] = False


def words(buf: np.ndarray, off: np.ndarray):
    """``start, end, doc, hash`` of the words in a chunk."""
    start, end, doc = word_spans(buf, off, _MARKS)
    return start, end, doc, span_hash(prefix_sums(LOWER[buf]), start, end)


def _word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))[3]


_TAG = _word_hashes("spdx license identifier")


def gram_hashes(h: np.ndarray, k: int = GRAM) -> np.ndarray:
    n = max(0, len(h) - k + 1)
    total = np.full(n, 3, dtype=np.uint64)
    for i in range(k):
        total += h[i : i + n] * _WEIGHTS[i]
    return mix(total)


def winnow(grams: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Places of the least gram (the last of equals) in every window, the first and the last gram."""
    n = len(grams)
    if n <= window:
        return np.arange(n)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    least = window - 1 - np.argmin(view[:, ::-1], axis=1) + np.arange(len(view))
    return np.unique(np.concatenate([least, [0, n - 1]]))


def all_templates() -> dict[str, str]:
    """``TEMPLATES`` and the whole texts, read where the query is built."""
    folder = resources.files(__package__) / "license_texts"
    texts = {f"{f.name.removesuffix('.txt')}-text": f.read_text("utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
    mit = texts["MIT-text"]
    texts["MIT-body"] = mit[mit.index("The above copyright notice") :]  # under COVERAGE of the whole without the first clause
    return TEMPLATES | texts


def build_index(templates: dict[str, str], gram: int = GRAM) -> dict:
    """Words of each piece of a template, and sorted gram hashes with their ``(piece, place)``."""
    tokens, whole, sizes, entries = [], [], [], []
    for t, text in enumerate(templates.values()):
        raw = np.frombuffer(text.encode(), np.uint8)
        h = words(raw, np.array([0, len(raw)]))[3]
        if len(h) < gram:
            raise ValueError(f"a template needs {gram} words: {text!r}")
        sizes.append(len(h))
        for piece in np.array_split(h, -(-len(h) // PIECE) if len(h) > 2 * PIECE else 1):
            g = gram_hashes(piece, gram)
            entries += [(int(g[p]), len(tokens), int(p)) for p in winnow(g)]
            tokens.append(piece)
            whole.append(t)
    entries.sort()
    return {"names": list(templates), "sizes": sizes, "tokens": tokens, "whole": whole, "grams": np.array([e[0] for e in entries], np.uint64),
            "piece": np.array([e[1] for e in entries]), "place": np.array([e[2] for e in entries])}


def most_common(template: np.ndarray, text: np.ndarray) -> int:
    """Words matched in order without a band: no less than ``banded_alignment`` finds."""
    places: dict[int, int] = {}
    for i, w in enumerate(template.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    left = full
    for w in text.tolist():
        if w in places:
            u = left & places[w]
            left = (left + u | left - u) & full
    return len(template) - left.bit_count()


def chain_pieces(found: list[tuple[int, int, int, int]], lengths: dict[int, int], slack: int, least: float) -> Iterator[tuple[int, int, int]]:
    """Yield ``matched, first, last`` of chains with ``least`` matched words; ``found`` has ``first, last, piece, matched``.

    In a chain pieces and places ascend, and two pieces stand at most ``slack``
    words farther apart than in the template.
    """
    found = sorted(found)
    while found:
        best: list[tuple[int, int]] = []
        for k, (first, _, piece, c) in enumerate(found):
            before = (0, -1)
            for j in range(k):
                _, last, p, _ = found[j]
                shared = max(0, last - first + 1)  # words that both pieces took count once
                if p < piece and shared <= BAND and first - last <= sum(lengths[x] for x in range(p + 1, piece)) + slack:
                    before = max(before, (best[j][0] - shared, j))
            best.append((before[0] + c, before[1]))
        end = max(range(len(found)), key=lambda k: (best[k][0], -k))
        if best[end][0] < least:
            return
        start = end
        while best[start][1] >= 0:
            start = best[start][1]
        i, j = found[start][0], found[end][1]
        yield best[end][0], i, j
        found = [x for x in found if x[1] < i or x[0] > j]


def banded_alignment(template: np.ndarray, text: np.ndarray, band: int) -> tuple[int, int, int]:
    """Most template words matched in order inside the band around the diagonal, and the first and last matched text word.

    Place i of the template may match places i .. i + 2 * band of ``text``; of
    equal matches the shortest, then the first, stretch of text is taken.
    """
    n, m = len(template), len(text)
    none = (0, 0, -1, -1)
    best = [none] * (m + 1)
    for i in range(n):
        lo, hi = i, min(m, i + 2 * band + 1)
        new = best[: lo + 1] + [none] * (m - lo)
        for j in range(lo, hi):
            x = max(best[j + 1], new[j])
            if template[i] == text[j]:
                c, _, first, _ = best[j]
                first = j if first < 0 else first
                x = max(x, (c + 1, first - j - 1, first, j))
            new[j + 1] = x
        for j in range(hi, m):
            new[j + 1] = max(best[j + 1], new[j])
        best = new
    c, _, first, last = best[m]
    return c, first, last


def scan(documents: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """``doc_id, license, n_words, n_matched, coverage, start_byte, end_byte`` of each match of at least ``coverage``."""
    templates = templates or all_templates()
    if sum(len(t) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates are bounded by {MAX_TEMPLATE_BYTES} bytes")
    shared = documents.sparkSession.sparkContext.broadcast(build_index(templates))
    schema = "doc_id long, license string, n_words int, n_matched int, coverage double, start_byte long, end_byte long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        siblings = {index["names"].index(name): _word_hashes(" ".join(marks)) for name, marks in SIBLINGS.items() if name in index["names"]}
        for batch in batches:
            out: list[tuple] = []
            for row, _, buf, off in chunks(batch.column(1)):
                start, end, doc, h = words(buf, off)
                g = gram_hashes(h)
                lo = np.searchsorted(index["grams"], g, side="left")
                hi = np.searchsorted(index["grams"], g, side="right")
                hit = np.flatnonzero((hi > lo) & (doc[: len(g)] == doc[GRAM - 1 :][: len(g)]))
                regions: dict[tuple[int, int], list[int]] = {}
                for at in hit.tolist():
                    for e in range(lo[at], hi[at]):
                        regions.setdefault((int(doc[at]), int(index["piece"][e])), []).append(at - int(index["place"][e]))
                first_word = np.searchsorted(doc, np.arange(len(off)))
                pieces: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
                for (d, p), diagonals in regions.items():
                    template, size = index["tokens"][p], index["sizes"][index["whole"][p]]
                    least = (size if size < SHORT else coverage * size) if len(template) == size else len(template) / 2
                    diagonals = sorted(set(diagonals))
                    near = min(band, len(template) // 2)  # repeats of a short notice stay apart
                    group = [diagonals[0]]
                    for x in [*diagonals[1:], None]:
                        if x is not None and x - group[-1] <= near and x - group[0] <= len(template):
                            group.append(x)
                            continue
                        a = max(int(first_word[d]), group[0] - near)
                        b = min(int(first_word[d + 1]), group[-1] + len(template) + near)
                        wide = near + group[-1] - group[0]
                        if most_common(template, h[a:b]) >= least:
                            # the band lies around the diagonals also where the text begins inside it
                            cut = a - (group[0] - near)
                            c, i, j = banded_alignment(template, np.concatenate([np.zeros(cut, np.uint64), h[a:b]]), wide)
                            if c >= least:
                                pieces.setdefault((d, index["whole"][p]), []).append((a + i - cut, a + j - cut, p, c))
                        group = [x]
                matches: dict[int, list[tuple]] = {}
                for (d, t), found in pieces.items():
                    size = index["sizes"][t]
                    if len(index["tokens"][found[0][2]]) == size:
                        one = [(c, i, j) for i, j, _, c in found]
                    else:
                        one = chain_pieces(found, dict(enumerate(map(len, index["tokens"]))), max(PIECE, size // 10), coverage * size)
                    matches.setdefault(d, []).extend((-c, -c / size, i, j, t) for c, i, j in one)
                for d, found in matches.items():
                    taken: list[tuple[int, int]] = []
                    for c, share, i, j, t in sorted(found):
                        if all(j < x or i > y for x, y in taken):
                            taken.append((i, j))
                            name = index["names"][t]
                            near = slice(max(int(first_word[d]), i - 8), i + 12)
                            if t in siblings and np.isin(h[near], siblings[t]).any():
                                name = f"sibling-of-{name}"
                            out.append((row + d, name, index["sizes"][t], -c, -share, int(start[i] - off[d]), int(end[j] - off[d])))
                out += [(row + d, name, n, n, 1.0, a, b) for d, name, n, a, b in _declared(buf, off, start, end, doc, h)]
            if out:
                rows, *rest = zip(*out)
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, kinds))],
                                                 names=["doc_id", "license", "n_words", "n_matched", "coverage", "start_byte", "end_byte"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
