"""Benchmark decontamination by canonical templates.

Texts become token sequences in which typed placeholders replace

* numbers: tokens that begin with a digit, with the points, commas and strokes between their
  digits, a sign after white space and a signed exponent, and runs of number words ("twenty-five", "3 million");
* units: a known unit after a number, as a symbol or a full name (``unit_words``);
* names: runs of capitalised tokens, wherever they stand, so that a name that opens a
  sentence is one too (an ordinary word there is a slot like others); apostrophes and hyphens inside a
  name and particles between two parts of it ("O'Brien", "Ludwig van Beethoven") belong to it.

Other tokens are lower-cased, marks and white space fall away.  Windows of ``WINDOW``
template tokens (a shorter item as a whole) are hash-joined between documents and items.
A template window counts if at least ``LITERALS`` of its tokens are not placeholders.

Plain windows, of lower-cased tokens without placeholders, are joined likewise and
apart from the templates, all of them: a verbatim copy is found in any case and
whatever it consists of.  Items of fewer than ``SHORTEST`` tokens have their one
plain window only and match only a document of which they are the share ``COVERAGE`` or more: inside
longer texts so few words ("how are you") stand by chance.

Matching windows of a document and an item on one diagonal (place in the
document less place in the item) form an alignment.  It is consistent if each
slot value of the item stands for one value of the document and the other way
round: a question with other numbers is caught, a chance mixture of values is not.
``CLASHES`` value of either side may have a second partner (one changed repeat, one
chance equality).  An alignment with more clashes is consistent too if it holds
``MIN_WINDOWS`` verbatim windows, or ``RUN`` windows in a row without any clash.
Coverage is the share of the item's countable windows that consistent alignments
hold, templates and plain windows apart; a document is contaminated by an item of which
it covers ``COVERAGE`` or more.

While the items' windows number at most ``MAX_BROADCAST``, their hashes (8 bytes each)
travel to the tasks and thin the documents' windows before the join; beyond that every
window is joined by shuffle.  Both ways give the same rows.

Defined cases: null, empty and blank texts have no windows; rows with a null doc_id or
item_id are judged like others and come out under the null id (``clean`` keeps documents
without id); other values in windows without enough literals are not recognised; repeated
documents are judged as one and so are repeated items; very long texts are read whole;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, table
from .textops import _WEIGHTS, LOWER, chunks, mix, prefix_sums, span_hash, word_spans

WINDOW = 10
SHORTEST = 6
LITERALS = 0.6
MIN_WINDOWS = 1
COVERAGE = 0.5
CLASHES = 1
RUN = 10
MAX_BROADCAST = 4_000_000


def unit_words() -> list[str]:
    """Symbols and full names of units, by rule: prefixes before bases, names in singular and plural."""
    # Fixed values.
    symbols = [p + b for p in ("", "n", "m", "c", "d", "k", "g", "t") for b in ("g", "m", "l", "w", "v", "s", "hz", "pa", "bar", "mol", "b", "wh")]
    symbols += "h hr hrs min sec in ft mi yd lb lbs oz mph kmh rpm psi kn kj mj kcal kv ma usd eur gbp".split()
    metric = [p + b for p in ("", "nano", "micro", "milli", "centi", "deci", "kilo", "mega", "giga", "tera") for b in ("gram", "meter", "metre", "liter", "litre", "watt", "volt", "byte", "bit", "second", "joule", "newton", "pascal", "hertz", "ampere", "ohm", "calorie", "bar")]
    plain = ("minute hour day week month year decade century mile yard foot inch acre hectare pound ounce ton tonne kilo gallon pint quart cup spoon degree mole amp "
             "dollar euro cent pound yen rupee peso franc crown mark percent celsius fahrenheit kelvin").split()
    names = metric + plain
    return sorted(({*symbols, *names, *(n + "s" for n in names), "feet", "inches", "centuries"}) - {"b", "ds", "ts", "gs", "cs", "tv", "cv"})


UNITS = unit_words()
PARTICLES = "de la du le van von der den di da del dos bin al ibn y".split()
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty "
                "forty fifty sixty seventy eighty ninety hundred thousand million billion trillion dozen").split()

_MARKS = np.ones(256, dtype=bool)
_MARKS[48:58] = _MARKS[65:91] = _MARKS[97:123] = _MARKS[128:] = False
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 11, 12, 13]] = True
LITERAL, NUMBER, UNIT, NAME = range(4)
_PLACEHOLDER = mix(np.arange(501, 505, dtype=np.uint64))


def _word_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(r) for r in raw])
    start = np.concatenate([[0], end[:-1]])
    return np.sort(span_hash(prefix_sums(buf), start, end))


_UNITS, _NUMBER_WORDS, _PARTICLES = _word_hashes(UNITS), _word_hashes(NUMBER_WORDS), _word_hashes(PARTICLES)


def _fold(more: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray):
    """Unite each token with the one before it where ``more`` (for all but the first token) says so."""
    return start[np.concatenate([[True], ~more])], end[np.concatenate([~more, [True]])], doc[np.concatenate([[True], ~more])]


def plain_tokens(buf: np.ndarray, off: np.ndarray):
    """``start, end, doc, kind, hash`` of the tokens in a chunk, all literal."""
    start, end, doc = word_spans(buf, off, _MARKS)
    return start, end, doc, np.full(len(start), LITERAL), span_hash(prefix_sums(LOWER[buf]), start, end) if len(start) else np.zeros(0, np.uint64)


def template_tokens(buf: np.ndarray, off: np.ndarray):
    """``start, end, doc, kind, hash`` of the tokens in a chunk; placeholders share one hash per kind."""
    start, end, doc = word_spans(buf, off, _MARKS)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    digit = (buf >= 48) & (buf <= 57)
    if len(start) > 1:
        # digits, one point, comma or stroke, digits: one number; so is a mantissa, a sign and its exponent
        gap = buf[np.minimum(end[:-1], len(buf) - 1)]
        close = (start[1:] - end[:-1] == 1) & digit[start[1:]] & digit[start[:-1]] & (doc[1:] == doc[:-1])
        last, before = buf[end[:-1] - 1], digit[np.maximum(end[:-1] - 2, 0)]
        more = close & (((gap == 44) | (gap == 46) | (gap == 47)) & digit[end[:-1] - 1] | ((gap == 43) | (gap == 45)) & ((last == 69) | (last == 101)) & before)
        start, end, doc = _fold(more, start, end, doc)
    h = span_hash(prefix_sums(LOWER[buf]), start, end)
    spelled = np.isin(h, _NUMBER_WORDS)
    number = digit[start] | spelled
    if len(start) > 1:
        # number words beside numbers: one number
        more = number[1:] & number[:-1] & (spelled[1:] | spelled[:-1]) & (start[1:] - end[:-1] == 1) & (doc[1:] == doc[:-1])
        kept = np.concatenate([[True], ~more])
        start, end, doc = _fold(more, start, end, doc)
        number, h = number[kept], h[kept]
    first = buf[start]
    after_number = np.zeros(len(start), bool)
    after_number[1:] = number[:-1] & (doc[1:] == doc[:-1])
    unit = after_number & np.isin(h, _UNITS)
    name = (first >= 65) & (first <= 90)
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, LITERAL)))
    if len(start) > 1:
        # capitalised tokens with white space, or one apostrophe or hyphen, between them: one name
        filled = np.concatenate([[0], np.cumsum(~_SPACES[buf])])
        white = (filled[start[1:]] == filled[end[:-1]]) & (doc[1:] == doc[:-1])
        gap = buf[np.minimum(end[:-1], len(buf) - 1)]
        marked = (start[1:] - end[:-1] == 1) & ((gap == 39) | (gap == 45)) & (doc[1:] == doc[:-1])
        name = kind == NAME
        more = name[1:] & name[:-1] & (white | marked)
        # one or two particles between two parts of a name belong to it
        between = (kind == LITERAL) & np.isin(h, _PARTICLES)
        one = np.flatnonzero(name[:-2] & between[1:-1] & name[2:] & white[:-1] & white[1:])
        two = np.flatnonzero(name[:-3] & between[1:-2] & between[2:-1] & name[3:] & white[:-2] & white[1:-1] & white[2:])
        for at, n in ((one, 2), (two, 3)):
            for k in range(n):
                more[at + k] = True
        kept = np.concatenate([[True], ~more])
        start, end, doc = _fold(more, start, end, doc)
        kind, h = kind[kept], h[kept]
    # a sign after white space belongs to its number
    before, far = np.maximum(start - 1, 0), np.maximum(start - 2, 0)
    signed = (kind == NUMBER) & digit[start] & (start > off[doc]) & ((buf[before] == 43) | (buf[before] == 45)) & ((start - 1 == off[doc]) | _SPACES[buf[far]] | (buf[far] == 10))
    start = start - signed
    return start, end, doc, kind, np.where(kind == LITERAL, h, _PLACEHOLDER[kind])


def window_hashes(h: np.ndarray, doc: np.ndarray, kind: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of each window of ``size`` tokens with enough literals."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        total += h[i : i + n] * _WEIGHTS[i]
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    ok = (doc[:n] == doc[size - 1 :]) & (literal[size:] - literal[:-size] >= LITERALS * size)
    at = np.flatnonzero(ok)
    return at, mix(total[at])


def _windows(sizes: list[tuple[bool, int]], whole_short: bool, wanted: np.ndarray | None):
    """Emit ``id, plain, size, hash, at, slots`` per window of the ``(plain, size)``; only windows in ``wanted`` if that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = wanted.value if wanted is not None else None
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                ids, plains, lengths, hashes, ats, slots = [], [], [], [], [], []
                for plain in sorted({p for p, _ in sizes}):
                    start, end, doc, kind, h = (plain_tokens if plain else template_tokens)(buf, off)
                    counts = np.bincount(doc, minlength=j - i)
                    first_token = np.concatenate([[0], np.cumsum(counts)])
                    for size in (n for p, n in sizes if p == plain):
                        at, wh = window_hashes(h, doc, kind, size)
                        if size < (WINDOW if whole_short else SHORTEST):
                            keep = counts[doc[at]] == size if whole_short else counts[doc[at]] * COVERAGE <= size
                            at, wh = at[keep], wh[keep]
                        if allowed is not None and len(wh):
                            place = np.minimum(np.searchsorted(allowed, wh), len(allowed) - 1)
                            keep = allowed[place] == wh if len(allowed) else np.zeros(len(wh), bool)
                            at, wh = at[keep], wh[keep]
                        for a, x in zip(at.tolist(), wh.view(np.int64).tolist()):
                            ids.append(i + doc[a])
                            plains.append(plain)
                            lengths.append(size)
                            hashes.append(x)
                            ats.append(int(a - first_token[doc[a]]))
                            slots.append([b" ".join(LOWER[buf[start[t] : end[t]]].tobytes().split()) for t in range(a, a + size) if kind[t] != LITERAL])
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(plains, pa.bool_()), pa.array(lengths, pa.int32()), pa.array(hashes, pa.int64()), pa.array(ats, pa.int32()), pa.array(slots, pa.list_(pa.binary()))],
                        names=["id", "plain", "size", "hash", "at", "slots"])

    return run


_SCHEMA = "id long, plain boolean, size int, hash long, at int, slots array<binary>"


def longest_run(windows: list[list[tuple[bytes, bytes]]]) -> int:
    """Most windows in a row whose slot pairs are one bijection."""
    there: dict[bytes, dict[bytes, int]] = {}
    back: dict[bytes, dict[bytes, int]] = {}
    clashing: set[tuple[bool, bytes]] = set()

    def put(pair: tuple[bytes, bytes], by: int) -> None:
        for side, (a, b), of in ((True, pair, there), (False, pair[::-1], back)):
            partners = of.setdefault(a, {})
            partners[b] = partners.get(b, 0) + by
            if not partners[b]:
                del partners[b]
            (clashing.add if len(partners) > 1 else clashing.discard)((side, a))

    best = first = 0
    for k, window in enumerate(windows):
        for pair in window:
            put(pair, 1)
        while clashing:
            for pair in windows[first]:
                put(pair, -1)
            first += 1
        best = max(best, k + 1 - first)
    return best


def _judge(windows) -> tuple[int, int, bool, bool]:
    """``n_windows, n_slots, consistent, verbatim`` of the windows ``(at, slots, item_slots)`` of one diagonal."""
    rows = [list(zip(w["slots"], w["item_slots"])) for w in sorted(windows, key=lambda w: w["item_at"])]
    pairs = {(bytes(d), bytes(b)) for r in rows for d, b in r}
    same = sum(all(d == b for d, b in r) for r in rows)
    few = all(len(pairs) - len({p[side] for p in pairs}) <= CLASHES for side in (0, 1))
    return len(rows), len(pairs), few or same >= MIN_WINDOWS or longest_run([[(bytes(d), bytes(b)) for d, b in r] for r in rows]) >= RUN, same == len(rows)


def leaks(documents: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``doc_id, item_id, n_windows, coverage, n_slots, consistent, verbatim, contaminated`` per document and item that share a window."""
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text")
    every = [(True, n) for n in range(1, WINDOW + 1)] + [(False, n) for n in range(SHORTEST, WINDOW + 1)]
    own = materialize(items.mapInArrow(_windows(every, True, None), _SCHEMA), "item-windows")
    n = own.count()
    # only lengths that items have are looked for
    sizes = [(r["plain"], r["size"]) for r in own.select("plain", "size").distinct().collect()]
    wanted = None
    if n <= max_broadcast:
        hashes = own.select("hash").distinct().toArrow().column(0).to_numpy().view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(hashes))
    found = documents.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(_windows(sizes, False, wanted), _SCHEMA)
    own = own.select("plain", "size", "hash", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    totals = own.groupBy("item_id", "plain").agg(F.count_distinct("item_at").alias("total"))
    met = found.join(own, ["plain", "size", "hash"]).select(F.col("id").alias("doc_id"), "item_id", "plain", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "slots", "item_slots")
    met = materialize(met, "met")
    key = ["doc_id", "item_id", "plain", "diagonal"]
    judge = F.udf(_judge, "n_windows long, n_slots long, consistent boolean, verbatim boolean")
    # a diagonal has each window of the item once at most, unless documents or items are repeated
    runs = met.groupBy(*key).agg(F.collect_set(F.struct("item_at", "slots", "item_slots")).alias("w"))
    judged = materialize(runs.select(*key, F.transform("w", lambda w: w["item_at"]).alias("ats"), judge("w").alias("j")).select(*key, "ats", "j.*"), "judged")
    side = ["doc_id", "item_id", "plain"]
    best = F.max_by(F.struct("n_slots", "consistent", "verbatim"), F.struct("consistent", "n_windows", "verbatim", -F.col("diagonal"))).alias("b")
    covered = judged.withColumn("at", F.explode("ats")).groupBy(*side).agg(F.count_distinct(F.when(F.col("consistent"), F.col("at"))).alias("n_windows"))
    shares = judged.groupBy(*side).agg(best)
    # null ids meet null ids, as keys of plain joins
    same = lambda a, b, on: reduce(and_, [a[c].eqNullSafe(b[c]) for c in on])
    joined = covered.join(shares, same(covered, shares, side)).join(totals, same(covered, totals, ["item_id", "plain"]))
    both = joined.select(*[covered[x] for x in side], covered["n_windows"], (covered["n_windows"] / totals["total"]).alias("coverage"), shares["b"]["n_slots"].alias("n_slots"), shares["b"]["consistent"].alias("consistent"), shares["b"]["verbatim"].alias("verbatim"))
    both = both.withColumn("contaminated", F.col("consistent") & (F.col("coverage") >= COVERAGE) & (F.col("n_windows") >= MIN_WINDOWS))
    top = F.max_by(F.struct("n_windows", "coverage", "n_slots", "consistent", "verbatim", "contaminated"), F.struct("contaminated", "coverage", "n_windows", "verbatim", ~F.col("plain"))).alias("b")
    return both.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "b.*")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without contaminated rows, unchanged; rows of one doc_id with other texts are judged apart, rows without id stay."""
    bad = leaks(documents.select(row_key().alias("doc_id"), "text"), benchmark).filter("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return documents.join(bad, F.when(F.col("doc_id").isNotNull(), row_key()) == F.col("__bad"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
