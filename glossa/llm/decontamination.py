"""Benchmark decontamination on templates.

Numbers, units after numbers and names (capitalised words inside a sentence) become typed placeholders, so that a
question and its re-parameterised copy have one template. A second template also takes capitalised words that begin a
sentence, function words aside, as names and number words as numbers; its windows count beside those of the first. A window of
placeholders alone, which any list of names has, keeps its values and so is met verbatim only.

Windows of ``window`` template tokens of the documents pass a fixed-size Bloom filter of the benchmark's windows. Of each item the
windows most frequent in the documents are left aside as long as together they cover less than ``similarity`` of it: an item that is
found has one of the others, its keys. Documents and items are hash-joined by keys alone, so a window that a third of all
documents hold pairs none of them; the places found are then matched by all windows. Matches of a document and an item
gather in overlapping regions of the document, long enough to hold the item; there each value of an item's slot must go
to one value in the document (windows that contradict the commonest one are dropped; verbatim windows are also counted by
themselves), and the item is found if windows that stay cover ``similarity`` of its tokens.

Defined cases: items of fewer tokens than a window are taken as one shorter window, items without tokens never match;
null and empty texts have no windows; an item that occurs twice in a document, or equal rows, give one row per
(doc_id, item_id), null ids too; empty tables give an empty result; further columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import fresh, slices, staged, table

#: Tokens of a window, and the part of an item's tokens that must be covered.
WINDOW, SIMILARITY = 5, 0.8
#: Bits of the Bloom filter (4 MB at every size of benchmark), tokens whose template a worker keeps, and documents read at a time.
BLOOM, CACHE, TOGETHER = 1 << 25, 150_000, 128

# Unit words (fixed values).
UNITS = frozenset(
    "percent % mm cm m km inch inches ft feet mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres s sec second seconds min minute minutes "
    "h hour hours day days week weeks month months year years dollar dollars euro euros cent cents mph kmh degrees celsius fahrenheit".split()
)
# Number words, and words that are no names where they begin a sentence (fixed values).
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend dutzend "
    "deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille douzaine "
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil docena".split()
)
FUNCTION_WORDS = frozenset(
    "a an the this that these those i you he she it we they his her its our their my your who whom whose what which when where why how is are was were be do does "
    "did has have had can could will would shall should may might must if then so but and or not no nor yet for from to of in on at by with without after before "
    "during while until since because as than there here each every both all some any many much more most other another such only also now once let however "
    "der die das ein eine und ist wie was wer le la les un une des et est que qui el los las una y es en de".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:e[+-]?\d+)?([%a-zµ°]*)")
EDGE = re.compile(r"^[^\w$€£+\-%]+|[^\w%]+$")
END = re.compile(r"[.!?:;][\"')\]»”]*$")
IS_NUMBER, IS_UNIT, IS_CAPITAL, IS_END, IS_NOTHING, IS_NUMBER_WORD, IS_FUNCTION_WORD = 1, 2, 4, 8, 16, 32, 64
FLAGS = 7
WORDS = {w: IS_NUMBER_WORD for w in NUMBER_WORDS} | {w: IS_FUNCTION_WORD for w in FUNCTION_WORDS}
MARKS = frozenset(".,!?:;")
SLOT = {IS_NUMBER: 11, IS_UNIT: 13, IS_CAPITAL: 17}
MIX = np.uint64(0x9E3779B97F4A7C15)


def packed_token(raw: str) -> int:
    """A raw token's hash << FLAGS | flags."""
    mark = raw[-1] in MARKS
    if (bare := raw[:-1] if mark else raw).isalpha():  # nearly all tokens
        low = bare.lower()
        flags = (IS_UNIT if low in UNITS else IS_CAPITAL if bare[0].isupper() else 0) | WORDS.get(low, 0) | (IS_END if mark and raw[-1] != "," else 0)
        return xxhash.xxh64_intdigest(low) >> FLAGS << FLAGS | flags
    bare = EDGE.sub("", raw)
    low = bare.lower()
    flags = IS_END if END.search(raw) else 0
    if not bare:
        flags |= IS_NOTHING
    elif (m := NUMBER.fullmatch(low)) and (not m[1] or m[1] in UNITS):
        flags |= IS_NUMBER
    elif low in UNITS:
        flags |= IS_UNIT
    elif bare[0].isupper():
        flags |= IS_CAPITAL
    if low in FUNCTION_WORDS:
        flags |= IS_FUNCTION_WORD
    elif all(part in NUMBER_WORDS for part in low.split("-")):
        flags |= IS_NUMBER_WORD
    return xxhash.xxh64_intdigest(low.encode()) >> FLAGS << FLAGS | flags


class Tokens(dict):
    """Raw token to its place in ``packed``: small numbers, which are read out faster than the hashes themselves."""

    def __init__(self) -> None:
        super().__init__()
        self.packed = np.zeros(1 << 12, np.uint64)

    def __missing__(self, raw: str) -> int:
        at = len(self)
        if at == len(self.packed):
            self.packed = np.concatenate([self.packed, np.zeros_like(self.packed)])
        self.packed[at] = packed_token(raw)
        self[raw] = at
        return at

    def read(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return self.packed[at]


_tokens = Tokens()


def templates_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of texts laid end to end: the text each token is of, value hashes, and token hashes and slot kinds (0: an ordinary word) of two templates."""
    words = [t.split() if t else [] for t in texts]
    packed = _tokens.read(list(chain.from_iterable(words)))
    of = np.repeat(np.arange(len(words)), list(map(len, words)))
    flags = packed.astype(np.uint8) & np.uint8((1 << FLAGS) - 1)
    real = flags & IS_NOTHING == 0
    if not real.all():
        alone = np.flatnonzero(~real & (flags & IS_END > 0))  # punctuation of its own ends the word before it
        alone = alone[(alone > 0) & (of[alone - 1] == of[alone])]
        flags[alone - 1] |= IS_END
        packed, flags, of = packed[real], flags[real], of[real]
    first = np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]
    value = packed >> np.uint64(FLAGS)
    inside = ~first
    inside[1:] &= flags[:-1] & IS_END == 0
    number = flags & IS_NUMBER > 0
    wide = number | (flags & IS_NUMBER_WORD > 0)
    named = inside | (flags & IS_FUNCTION_WORD == 0)
    return of, value, [_template(value, flags, number, inside, first), _template(value, flags, wide, named, first)]


def templates(text: str | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Value hashes of one text, and its templates; the second only if it differs."""
    _, value, made = templates_of([text])
    return value, made[:1] if np.array_equal(made[0][1], made[1][1]) else made


def _template(value: np.ndarray, flags: np.ndarray, number: np.ndarray, named: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counted = np.concatenate([[False], number[:-1]])[: len(number)] & ~first
    slot = np.where((flags & IS_CAPITAL > 0) & named, np.uint8(IS_CAPITAL), np.uint8(0))
    slot[(flags & IS_UNIT > 0) & counted] = IS_UNIT
    slot[number] = IS_NUMBER
    token = value.copy()
    for kind, placeholder in SLOT.items():
        token[slot == kind] = placeholder
    return token, slot


def window_hashes(token: np.ndarray, n: int) -> np.ndarray:
    count = len(token) - n + 1
    h = np.full(max(count, 0), n, np.uint64)
    for j in range(n if count > 0 else 0):
        h = (h ^ token[j : j + count]) * MIX
        h ^= h >> np.uint64(29)
    return h


def _hashed(value: np.ndarray, token: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """Hashes of a template's windows; of those of placeholders alone, hashes of their values."""
    h = window_hashes(token, n)
    if len(h):
        words = np.concatenate([[0], np.cumsum(slot == 0)])
        bare = np.flatnonzero(words[n:] == words[:-n])
        if len(bare):
            h[bare] = ~window_hashes(value, n)[bare]
    return h


def all_windows(value: np.ndarray, made: list[tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, hashes and slot kinds of the first template's windows and of those windows of the second that differ."""
    first = _hashed(value, *made[0], n)
    yield np.arange(len(first)), first, made[0][1]
    for token, slot in made[1:]:
        h = _hashed(value, token, slot, n)
        at = np.flatnonzero(h != first)
        yield at, h[at], slot


def _slots(value: np.ndarray, slot: np.ndarray, at: int, n: int) -> list[int]:
    return [int(v) for v, s in zip(value[at : at + n], slot[at : at + n], strict=True) if s]


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, n_item, h, n, item_slots, places for all different windows of all items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value, made = templates(text)
                n = min(window, len(value))
                places: dict[tuple, list[int]] = {}
                for at, hashes, slot in all_windows(value, made, n) if n else ():
                    for i, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        places.setdefault((h, *_slots(value, slot, i, n)), []).append(i)
                rows += [(item_id, len(value), h, n, slots, at) for (h, *slots), at in places.items()]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
            yield pa.record_batch(columns, names=["item_id", "n_item", "h", "n", "item_slots", "places"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(scan, f"item_id {kind}, n_item int, h long, n int, item_slots array<long>, places array<int>")


def key_windows(known: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """item_id, n_item, h of windows one of which every document that holds ``similarity`` of the item has, the rarest in ``found``."""
    counts = known.select("h").distinct().join(found.groupBy("h").count(), "h")

    def keys(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["count", "h"], ascending=[False, True])
        n_item = int(pdf["n_item"].iloc[0])
        aside, is_key = np.zeros(n_item, bool), []
        for places, n in zip(pdf["places"], pdf["n"], strict=True):
            more = aside.copy()
            for i in places:
                more[i : i + n] = True
            is_key.append(more.sum() >= similarity * n_item)
            if not is_key[-1]:
                aside = more
        return pdf.loc[is_key, ["item_id", "n_item", "h"]].drop_duplicates()

    kind = known.schema["item_id"].dataType.simpleString()
    # texts of one item_id, told apart by their number of tokens at least, have keys together; a window no document has need not be one
    return known.join(counts, "h").groupBy("item_id", "n_item").applyInPandas(keys, f"item_id {kind}, n_item int, h long")


#: Windows that one task puts into a partial filter.
FILTER_ROWS = 1_000_000


def _bloom_bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(BLOOM - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) * MIX & mask).astype(np.int64)


def bloom(windows: DataFrame) -> bytes:
    """Bits of all window hashes, joined from partial filters."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM // 8, np.uint8)
        for batch in batches:
            for at in _bloom_bits(batch.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.record_batch({"bits": pa.array([bits.tobytes()], pa.binary())})

    tasks = max(4, min(64, windows.count() // FILTER_ROWS))  # a partial filter each, which reach the driver one by one
    partials = windows.select("h").distinct().repartition(tasks).mapInArrow(part, "bits binary").toLocalIterator()
    total = np.zeros(BLOOM // 8, np.uint8)
    for row in partials:
        total |= np.frombuffer(row.bits, np.uint8)
    return total.tobytes()


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def document_windows(docs: DataFrame, bits: bytes, sizes: list[int]) -> DataFrame:
    """doc_id, t (a hash of the text), h, doc_pos, doc_slots of the windows that may be a benchmark's."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.frombuffer(shared.value, np.uint8)

        def known(at: np.ndarray) -> np.ndarray:
            return (have[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

        for batch in slices(batches, TOGETHER):
            of, value, made = templates_of(batch.column("text").to_pylist())
            begin = np.searchsorted(of, np.arange(batch.num_rows))
            rows, hs, ps, ss = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
            for n in sizes:
                for places, h, slot in all_windows(value, made, n):
                    first, second = _bloom_bits(h)
                    hit = np.flatnonzero(known(first))
                    hit = hit[known(second[hit])]
                    at = places[hit]
                    whole = of[at] == of[at + n - 1]  # of one text
                    at, hit = at[whole], hit[whole]
                    rows.append(of[at])
                    hs.append(h[hit].view(np.int64))
                    ps.append(at - begin[of[at]])
                    ss += [_slots(value, slot, i, n) for i in at.tolist()]
            of_row = pa.array(np.concatenate(rows))
            ids = [batch.column(c).take(of_row) for c in ("doc_id", "t")]
            yield pa.record_batch([*ids, pa.array(np.concatenate(hs)), pa.array(np.concatenate(ps)), pa.array(ss, pa.list_(pa.int64()))], names=["doc_id", "t", "h", "doc_pos", "doc_slots"])

    return docs.select("doc_id", _text_hash(docs).alias("t"), "text").mapInArrow(scan, f"doc_id {kind}, t long, h long, doc_pos long, doc_slots array<long>")


def _covered(n_item: int, matches: list[dict]) -> float:
    """Part of an item's tokens that windows with one value per slot value cover."""
    votes: dict[int, Counter] = {}
    for m in matches:
        for a, b in zip(m["item_slots"], m["doc_slots"], strict=True):
            votes.setdefault(a, Counter())[b] += len(m["places"])
    says = {a: min(c, key=lambda b: (-c[b], b != a, b)) for a, c in votes.items()}
    hit, verbatim = np.zeros(n_item, bool), np.zeros(n_item, bool)
    for m in matches:
        same = m["item_slots"] == m["doc_slots"]
        agrees = all(says[a] == b for a, b in zip(m["item_slots"], m["doc_slots"], strict=True))
        for i in m["places"] if same or agrees else ():
            verbatim[i : i + m["n"]] |= same
            hit[i : i + m["n"]] |= agrees
    return float(max(hit.mean(), verbatim.mean()))


#: Tokens of a stretch of a document in which its windows meet the candidates there.
STRETCH = 512


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, coverage of every benchmark item found in a document; the best of rows of one doc_id, each judged by its own text."""
    return found_items(docs, items, window, similarity).groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))


def found_items(docs: DataFrame, items: DataFrame, window: int, similarity: float) -> DataFrame:
    """doc_id, t, item_id, coverage of every benchmark item found in a text."""
    known = staged(item_windows(items, window), "benchmark-windows")
    sizes = sorted(r.n for r in known.select("n").distinct().collect())  # at most ``window`` numbers
    found = staged(document_windows(docs, bloom(known), sizes), "document-windows")
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id")))
    # written first, so that both sides of the joins are plain exchanges and a hot window's rows can be dealt to many tasks
    keys = staged(key_windows(known, found, similarity), "benchmark-keys")
    # regions of 2.5 items' length, one starting at every 1.25: wherever an item lies, one region holds it whole
    step = F.ceil(F.col("n_item") * 1.25)
    region = F.floor(F.col("doc_pos") / step)
    met = found.select("doc_id", "t", "h", "doc_pos").join(keys, "h").select("doc_id", "t", "item_id", "n_item", F.explode(F.array(region, region - 1)).alias("region"))
    places = staged(met.distinct(), "benchmark-places")
    first, last = F.col("region") * step, (F.col("region") + 2) * step - 1
    stretches = F.sequence(F.floor(F.greatest(first, F.lit(0)) / STRETCH), F.floor(last / STRETCH))
    asked = places.select(F.col("doc_id").alias("d"), F.col("t").alias("own"), F.col("item_id").alias("i"), F.col("n_item").alias("m"), "region", first.alias("first"), last.alias("last"), F.explode(stretches).alias("s"))
    wanted = asked.join(known, F.col("i").eqNullSafe(F.col("item_id")) & (F.col("m") == F.col("n_item"))).withColumnRenamed("h", "wanted")
    there = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("t")) & (F.col("wanted") == F.col("h")) & (F.col("s") == F.floor(F.col("doc_pos") / STRETCH))
    pairs = wanted.join(found, there & F.col("doc_pos").between(F.col("first"), F.col("last"))).filter(F.size("doc_slots") == F.size("item_slots"))
    match = F.struct("places", "n", "item_slots", "doc_slots")
    groups = pairs.groupBy("doc_id", "t", "item_id", "n_item", "region").agg(F.collect_set(match).alias("matches"))
    most = F.size(F.array_distinct(F.flatten("matches.places"))) * F.element_at("matches.n", 1)
    likely = groups.filter(most >= similarity * F.col("n_item"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [_covered(r["n_item"], r["matches"]) for r in batch.to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "t", "item_id")), pa.array(part, pa.float64())], names=["doc_id", "t", "item_id", "coverage"])

    checked = likely.mapInArrow(verify, f"doc_id {doc_kind}, t long, item_id {item_kind}, coverage double")
    return checked.filter(F.col("coverage") >= similarity).groupBy("doc_id", "t", "item_id").agg(F.max("coverage").alias("coverage"))


def without_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without those that contain a benchmark item; rows of one doc_id are judged by their texts."""
    own, text = fresh(docs, "_gone"), fresh(docs, "_text")
    gone = found_items(docs, items, window, similarity).select(F.col("doc_id").alias(own), F.col("t").alias(text)).distinct()
    # by shuffle at every size: what is found grows with the documents
    return docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(F.col(own)) & (_text_hash(docs) == F.col(text)), "left_anti")


def op3_decontaminate(spark, sf_dir):
    """All pairs of ``documents`` and ``benchmark`` items that they contain, re-parameterised ones too."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE_SQL: dict[str, str] = {}
