"""Benchmark decontamination by template canonicalisation.

A text becomes a template: numbers, names and units turn into typed
placeholders, other words lose their outer punctuation and the case of A-Z.

* number: a word whose core holds digits and no letters;
* name: a capitalised word that doesn't start a sentence or line;
* unit: a word of ``UNITS`` right after a number.

Windows of ``window`` template words of the documents and of the benchmark items are hash-joined.
Hits of one item along neighbouring diagonals (document place less item place, at most ``DRIFT`` apart, so words may
be put in or left out) are one occurrence.  It is reported if its words cover the item as far as ``coverage`` of the
item's windows in one run would, or if it holds ``coverage`` of the item's template windows, and its slots are
consistent: a value of the item (a number or name)
always stands against one value of the document.  So a question with other numbers or
names is caught, and ``reparameterised`` tells it from a verbatim copy.  Windows with fewer than
half plain words say too little as templates.  Such windows, and items of one window, are
joined by their words themselves (case of A-Z aside), so every verbatim copy is found.  An item's first
word counts as a plain word and as a name, because a document may hold it inside a sentence.

The benchmark is the stated query set.  Its window hashes are read in blocks of at most
``BLOCK`` and broadcast, to keep document windows that can't hit from being shuffled; one pass over the
documents is made for each block, and every block is searched.

Items that are too short for a whole window between two edits at the thirds are joined by
shorter windows too, of at least ``MIN_WORDS`` words; pieces shorter than that are not matched.  Shorter windows
with many slots are joined by their words only inside whole windows that are.

Edge cases: NULL texts have no words; items with fewer than ``window`` words are
one window of all their words, items with fewer than ``MIN_WORDS`` words are too
short to tell and are never reported; repeated rows, also of one ``doc_id`` or NULL, are reported each (documents) or once
(items); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import ROW, Rolling, byte_values, lower_ascii, narrow, on_rows, signed, stamped, text_chunks, words

WINDOW, MIN_WORDS, COVERAGE, BLOCK = 8, 5, 0.5, 500_000
DRIFT = 8
UNITS = ("mm cm m km in ft yd mi mg g kg oz lb t ml l gal ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
         "cent cents dollar dollars euro euros pound pounds usd eur percent meter meters metre metres mile miles gram grams liter liters litre litres degree degrees").split()
_DIGIT, _UPPER, _LOWER = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58], _UPPER[65:91], _LOWER[97:123], _LOWER[128:] = True, True, True, True
_CORE = _DIGIT | _UPPER | _LOWER
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 63]] = True
SLOT = {"number": np.uint64(11), "name": np.uint64(12), "unit": np.uint64(13)}
_EXACT = np.uint64(0xC2B2AE3D27D4EB4F)  # sets windows of words apart from windows of templates


def _hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return Rolling(byte_values(raw)).spans(np.array([0]), np.array([len(raw)]))[0]


_UNIT_HASHES = np.sort(np.array([_hash(x) for x in UNITS], np.uint64))


def _among(sorted_set: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)] == h


def template(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, template hash, word hash, is a slot, is capitalised) of each word."""
    s, e, row = words(buf, off)
    if not len(s):
        z = np.zeros(0, np.uint64)
        return row, z, z, np.zeros(0, bool), np.zeros(0, bool)
    core = np.flatnonzero(_CORE[buf])
    core = np.append(core, len(buf))
    first, last = core[np.searchsorted(core, s)], core[np.searchsorted(core, e) - 1] + 1
    some = first < e
    first, last = np.where(some, first, s), np.where(some, last, e)  # a word of marks alone stays as it is

    def count(mask, lo, hi):
        total = np.concatenate([[0], np.cumsum(mask[buf])])
        return total[hi] - total[lo]

    digits, upper, lower = count(_DIGIT, first, last), count(_UPPER, first, last), count(_LOWER, first, last)
    h = Rolling(byte_values(lower_ascii(buf))).spans(first, last)
    newline = np.concatenate([[0], np.cumsum(buf == 10)])
    begins = np.ones(len(s), bool)
    begins[1:] = (row[1:] != row[:-1]) | _STOP[buf[e[:-1] - 1]] | (newline[s[1:]] > newline[e[:-1]])
    number = (digits > 0) & (upper + lower == 0)
    capitalised = _UPPER[buf[first]] & (upper == 1) & (lower > 0)
    name = ~begins & capitalised
    unit = np.zeros(len(s), bool)
    unit[1:] = number[:-1] & (row[1:] == row[:-1]) & _among(_UNIT_HASHES, h[1:])
    t = np.where(number, SLOT["number"], np.where(unit, SLOT["unit"], np.where(name, SLOT["name"], h)))
    return row, t, h, number | name | unit, capitalised


def _windows(frame: DataFrame, sizes: list[int], wanted, window: int = WINDOW) -> DataFrame:
    """(doc_id, p, m, h, exact, slots): windows of m words at word p.  ``wanted`` keeps those hashes only.

    ``wanted`` None: the frame holds items.  Their windows come as templates and, where a template says too
    little, as the words themselves; the first word counts as a plain word and, if it's capitalised, as a name too.
    """

    def run(batches):
        of_items = wanted is None
        keep = None if of_items else wanted.value
        if keep is not None:
            seen = np.zeros(1 << 20, bool)
            seen[(keep & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, buf, off in text_chunks(batch):
                row, t, h, slot, capitalised = template(buf, off)
                woff = np.searchsorted(row, np.arange(hi - lo + 1))
                forms = [(Rolling(t), slot, False), (Rolling(h ^ _EXACT), slot, True)]
                if of_items and len(t):
                    # places whose whole windows say too little, counted: shorter windows of words are taken inside those only
                    n_slots, q = np.concatenate([[0], np.cumsum(slot)]), np.arange(max(0, len(t) - window + 1))
                    heavy = np.zeros(len(t), bool)
                    heavy[q] = (row[q] == row[q + window - 1]) & (2 * (n_slots[q + window] - n_slots[q]) > window)
                    beside = np.concatenate([[0], np.cumsum(heavy)])
                    start = np.unique(woff[:-1][woff[:-1] < woff[1:]])
                    capital = start[capitalised[start]]
                    t2, slot2 = t.copy(), slot.copy()
                    t2[capital], slot2[capital] = SLOT["name"], True
                    forms.append((Rolling(t2), slot2, False))
                for number, (roll, is_slot, exact) in enumerate(forms):
                    n_slots, slot_at = np.concatenate([[0], np.cumsum(is_slot)]), np.flatnonzero(is_slot)
                    for m in sizes:
                        g = roll.grams(m)
                        ok = np.ones(len(g), bool) if of_items else seen[(g & np.uint64((1 << 20) - 1)).astype(np.int64)]
                        if number == 2:  # only the windows that hold a capitalised first word differ
                            ok[:] = False
                            ok[capital[capital < len(g)]] = True
                        p = np.flatnonzero(ok)
                        p = p[row[p] == row[p + m - 1]]
                        light = 2 * (n_slots[p + m] - n_slots[p]) <= m
                        if not exact:
                            p = p[light]
                        elif of_items:
                            p = p[(~light & (beside[p + 1] > beside[np.maximum(p + m - window, 0)])) | (np.diff(woff)[row[p]] <= window)]
                        p = p if of_items else p[_among(keep, g[p])]
                        if not len(p):
                            continue
                        a, b = n_slots[p], n_slots[p + m]
                        flat = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
                        slots = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(b - a)]), pa.int32()), pa.array(signed(h[slot_at[flat]])))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + row[p])), pa.array(p - woff[row[p]]), pa.array(np.full(len(p), m, np.int32)), pa.array(signed(g[p])), pa.array(np.full(len(p), exact)), slots], names=["doc_id", "p", "m", "h", "exact", "slots"])

    return frame.mapInArrow(run, "doc_id long, p long, m int, h long, exact boolean, slots array<long>")


def occurrence(hits: list[dict], n_words: int, least: int, n_light: int, coverage: float) -> tuple | None:
    """(windows hit, coverage, diagonal, reparameterised) of the best occurrence of an item among its hits in one stretch.

    Around each diagonal the hits of all diagonals at most ``DRIFT`` away are taken, nearest first, as long as a
    value of the item stands against one value.
    """

    def share(some):
        words, light = set(), set()
        for x in some:
            words.update(range(x["q"], x["q"] + x["m"]))
            if x["light"]:
                light.add(x["q"])
        return max((len(words) - least + 1) / (n_words - least + 1), len(light) / n_light if n_light else 0.0)

    if share(hits) < coverage:
        return None
    lines: dict = {}
    for x in hits:
        lines.setdefault(x["diagonal"], []).append(x)
    values = {d: {(y["item"], y["doc"]) for x in some for y in x["pairs"]} for d, some in lines.items()}
    values = {d: dict(v) for d, v in values.items() if len({x for x, _ in v}) == len(v)}
    best = None
    for d in sorted(values):
        stands, taken = {}, []
        for near in sorted((x for x in range(d - DRIFT, d + DRIFT + 1) if x in values), key=lambda x: (abs(x - d), x)):
            if all(stands.get(x, y) == y for x, y in values[near].items()):
                stands |= values[near]
                taken += lines[near]
        found = share(taken)
        other = any(x != y for x, y in stands.items())
        if found >= coverage and (best is None or (-found, other) < (-best[1], best[3])):
            best = len({x["q"] for x in taken}), found, d, other
    return best


def _occurrences(met: DataFrame, coverage: float) -> DataFrame:
    """(doc_id, key, item_id, n_windows, n_hits, coverage, diagonal, reparameterised) of the stretches that hold an occurrence."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("n_hits", pa.int64()), ("coverage", pa.float64()), ("diagonal", pa.int64()), ("reparameterised", pa.bool_())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for x in batch.slice(at, 500).to_pylist():
                    found = occurrence(x["hits"], x["n_words"], x["least"], x["n_light"], coverage)
                    if found:
                        out.append({c: x[c] for c in ("doc_id", "key", "item_id", "n_windows")} | dict(zip(("n_hits", "coverage", "diagonal", "reparameterised"), found)))
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return met.mapInArrow(run, "doc_id long, key long, item_id long, n_windows long, n_hits long, coverage double, diagonal long, reparameterised boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_windows, n_hits, coverage, at_word, reparameterised): reported pairs, the best occurrence of each."""
    return on_rows(docs, lambda rows: _contaminated(rows, benchmark, window, coverage, block))


def _contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    items = items.withColumn("key", F.xxhash64("item_id", "text")).withColumn("n_words", F.size(F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')")))
    items = items.filter(F.col("n_words") >= MIN_WORDS).withColumn("m", F.least("n_words", F.lit(window)))
    third = F.greatest(F.lit(min(MIN_WORDS, window)), F.least("m", F.floor((F.col("n_words") - 2) / 3).cast("int")))  # fits between two edits
    items = items.withColumn("least", F.when(F.col("n_words") <= window, F.col("m")).otherwise(third))
    items = items.withColumn("full", F.col("m")).withColumn("m", F.explode(F.array_distinct(F.array("m", "least"))))
    sizes = sorted(r["m"] for r in items.select("m").distinct().collect())  # at most ``window`` numbers
    own = _windows(items.select(F.col("key").alias("doc_id"), "text"), sizes, None, window).withColumnRenamed("doc_id", "key").join(items.select("key", "item_id", "n_words", "least", "full", "m"), ["key", "m"])
    own = own.withColumnRenamed("p", "q").withColumnRenamed("slots", "item_slots").withColumn("light", (F.col("m") == F.col("full")) & ~F.col("exact"))
    counts = own.groupBy("key").agg(F.countDistinct("q").alias("n_windows"), F.countDistinct(F.when(F.col("light"), F.col("q"))).alias("n_light"))
    of_item = ["key", "item_id", "n_words", "least", "n_windows", "n_light"]
    own = own.join(counts, "key").select(*of_item, "m", "h", "exact", "q", "light", "item_slots")
    hashes = own.select("h").distinct()
    n = hashes.count()
    blocks = -(-n // block)
    hits = None
    for i in range(blocks):
        part = hashes.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == i).toPandas()["h"].to_numpy()
        found = _windows(docs, sizes, spark.sparkContext.broadcast(np.sort(part.view(np.uint64))))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], "doc_id long, p long, m int, h long, exact boolean, slots array<long>")
    same = F.transform("item_slots", lambda x: F.struct(x.alias("item"), x.alias("doc")))
    pairs = F.when(F.col("exact"), same).otherwise(F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc")))
    met = hits.join(own, ["m", "h", "exact"])
    # an occurrence lies whole in one of the stretches that begin at a multiple of ``reach`` and are twice as long
    reach = F.floor(F.col("p") / (F.col("n_words") + 2 * DRIFT))
    met = met.select("doc_id", *of_item, F.explode(F.array(reach, reach - 1)).alias("stretch"), F.struct("m", "q", (F.col("p") - F.col("q")).alias("diagonal"), "light", pairs.alias("pairs")).alias("hit"))
    runs = _occurrences(met.groupBy("doc_id", *of_item, "stretch").agg(F.collect_list("hit").alias("hits")), coverage)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("coverage"), "reparameterised", "diagonal", "key")
    return runs.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("doc_id", "item_id", "n_windows", "n_hits", "coverage", F.col("diagonal").alias("at_word"), "reparameterised")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark item."""
    rows, _ = stamped(docs)
    bad = _contaminated(narrow(rows, ROW), benchmark).select(F.col("doc_id").alias("bad_id")).distinct()
    return rows.join(bad, rows[ROW] == F.col("bad_id"), "left_anti").drop(ROW)
