"""Terms that occur inside texts: one pass of an automaton over each text.

All terms of a tenant stand in one Aho-Corasick automaton, so a text is read once however
many terms there are, and only true hits become rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import materialize

MAX_TERM_BYTES = 16 << 20
BLOCK_BYTES = 32 << 20


def automaton(terms: Iterable[str]) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for term in terms:
        if term:
            found.add_word(term, term)
    if not len(found):
        return None
    found.make_automaton()
    return found


def _hits(anchors: ahocorasick.Automaton | None, text: str | None) -> list[str]:
    return sorted({term for _, term in anchors.iter(text)}) if anchors is not None and text else []


_SCHEMA = "tenant_id string, {key} string, term string"


def _rows(tenants: list[str], ids: list[str], terms: list[str], key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (tenants, ids, terms)], names=["tenant_id", key, "term"])


def _by_broadcast(texts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """The terms, whose bytes are bounded by the caller, travel to all tasks."""
    by_tenant = defaultdict(list)
    for r in terms.collect():
        by_tenant[r["tenant_id"]].append(r["term"])
    sent = texts.sparkSession.sparkContext.broadcast(dict(by_tenant))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict = {}
        for batch in batches:
            out = [], [], []
            for tenant, at, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if tenant not in ready:
                    ready[tenant] = automaton(sent.value.get(tenant, ()))
                for term in _hits(ready[tenant], text):
                    for column, value in zip(out, (tenant, at, term)):
                        column.append(value)
            if out[0]:
                yield _rows(*out, key)

    return texts.mapInArrow(run, _SCHEMA.format(key=key))


def _by_blocks(texts: DataFrame, terms: DataFrame, key: str, term_bytes: int, block_bytes: int) -> DataFrame:
    """Pieces of a tenant's terms meet pieces of its texts, both of bounded size; neither travels through the driver."""
    pieces = lambda df, c, most, name: df.groupBy("tenant_id").agg(F.ceil(F.sum(F.octet_length(c)) / most).alias(name))
    counts = materialize(pieces(texts, "text", block_bytes, "n_texts").join(pieces(terms, "term", term_bytes, "n_terms"), "tenant_id"))
    count = lambda c: F.greatest(F.col(c), F.lit(1)).cast("int")
    counts = counts.select("tenant_id", count("n_texts").alias("n_texts"), count("n_terms").alias("n_terms"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = texts.join(counts, "tenant_id").select("tenant_id", at(key, "n_texts").alias("a"), every("n_terms").alias("b"), key, "text")
    right = terms.join(counts, "tenant_id").select("tenant_id", every("n_texts").alias("a"), at("term", "n_terms").alias("b"), "term")

    def run(some: pa.Table, words: pa.Table) -> pa.Table:
        anchors = automaton(words.column("term").to_pylist())
        found = [(t, i, term) for t, i, text in zip(*(some.column(c).to_pylist() for c in ("tenant_id", key, "text"))) for term in _hits(anchors, text)]
        return pa.Table.from_batches([_rows(*(map(list, zip(*found)) if found else ([], [], [])), key)])

    by = ["tenant_id", "a", "b"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, _SCHEMA.format(key=key))


def mentions(texts: DataFrame, terms: DataFrame, key: str = "id", max_term_bytes: int = MAX_TERM_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``tenant_id, <key>, term`` of each term of ``terms(tenant_id, term)`` that occurs in a text of its tenant, once a text.

    Texts ``(tenant_id, <key>, text)`` and terms are compared as they are; where case shall not count
    both come lower-cased.  An empty term occurs in every text that is not null; a null one nowhere.  Up to ``max_term_bytes``
    of terms are broadcast, beyond that bounded pieces of terms and texts meet in a shuffle.
    """
    terms = materialize(terms.select("tenant_id", "term").filter("term IS NOT NULL").distinct())
    texts = texts.select("tenant_id", F.col(key).cast("string").alias(key), "text").filter("text IS NOT NULL")
    size = terms.agg(F.sum(F.octet_length("term") + F.octet_length("tenant_id") + 16)).first()[0] or 0
    full = terms.filter("term <> ''")
    found = _by_broadcast(texts, full, key) if size <= max_term_bytes else _by_blocks(texts, full, key, max_term_bytes, block_bytes)
    everywhere = texts.join(terms.filter("term = ''"), "tenant_id").select("tenant_id", key, "term")
    return found.unionByName(everywhere)
