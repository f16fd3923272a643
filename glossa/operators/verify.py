"""Verification of quotations and citation markers against sources."""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import seeds
from glossa.tables import few, map_slices, written

#: Ratios from which a quotation counts as verbatim and as altered.
VERBATIM, ALTERED = 0.92, 0.65


#: Numbers that one range of a citation marker may span.
MOST_RANGE = 200


def citation_checks(answer: Column, available: Column) -> Column:
    """Array of (marker, refs, missing, reason) for markers like [3], [P2; 4], [A1, 2-5], in order.

    Lists and ranges are taken apart; a family letter holds until the next one. A marker that cannot be read keeps what came
    before the fault and has a reason: invalid_marker, cross_family_range, invalid_range; else missing_source where a reference
    is not among ``available``; else null.
    """
    found = F.regexp_extract_all(answer, F.lit(r"\[\s*(?:[PA]\s*[0-9]*|[0-9]+)[^\[\]\n]*\]"), F.lit(0))
    pattern = r"^([PA]?)([0-9]{1,9})(?:\s*[-–—]\s*([PA]?)([0-9]{1,9}))?$"
    start = F.struct(F.lit("").alias("family"), F.array().cast("array<string>").alias("refs"), F.lit(None).cast("string").alias("reason"))

    def step(state: Column, part: Column) -> Column:
        groups = F.array(*(F.regexp_extract(part, pattern, i) for i in range(1, 5)))
        return T.let(groups, lambda g: F.when(state["reason"].isNotNull(), state).otherwise(placed(state, part, *(g[i] for i in range(4)))))

    def placed(state: Column, part: Column, own: Column, a: Column, other: Column, b: Column) -> Column:
        number = lambda digits: F.try_to_number(F.nullif(digits, F.lit("")), F.lit("999999999")).cast("long")
        family = F.when(own != "", own).otherwise(state["family"])

        def told(ends: Column) -> Column:
            low, high = ends["low"], F.coalesce(ends["high"], ends["low"])
            reason = (
                F.when(a == "", "invalid_marker")  # the pattern does not fit
                .when((b != "") & (other != "") & (other != family), "cross_family_range")
                .when((high < low) | (high - low >= MOST_RANGE), "invalid_range")
            )
            more = F.when(reason.isNull(), F.transform(F.sequence(low, F.greatest(low, F.least(high, low + MOST_RANGE))), lambda n: F.concat(family, n.cast("string"))))
            return F.struct(family.alias("family"), F.concat(state["refs"], F.coalesce(more, F.array().cast("array<string>"))).alias("refs"), reason.alias("reason"))

        return T.let(F.struct(number(a).alias("low"), number(b).alias("high")), told)

    def check(marker: Column) -> Column:
        parts = F.split(F.btrim(F.substr(marker, F.lit(2), F.length(marker) - 2)), r"\s*[,;]\s*")
        return T.let(F.aggregate(parts, start, step), lambda read: T.let(F.array_distinct(read["refs"]), lambda refs: T.let(F.array_except(refs, available), lambda missing: F.struct(
            marker.alias("marker"), refs.alias("refs"), missing.alias("missing"), F.coalesce(read["reason"], F.when(F.size(missing) > 0, "missing_source")).alias("reason")))))

    return F.transform(found, check)


def markers(answer: Column) -> Column:
    """The references of all citation markers, in order, with their family letter: what can be read of them."""
    return F.flatten(F.transform(citation_checks(answer, F.array().cast("array<string>")), lambda c: c["refs"]))


def exact_quotes(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, item_id of quotations (item_id, text) that a document holds verbatim.

    Quotations meet the documents that hold their rarest inner word (the first and the last may be parts of longer ones), and all other
    inner words; those pairs are compared in full. Quotations of one or two words have no inner word: they meet documents by their first three
    characters or fewer. An empty quotation is in every document that is not null.
    """
    quoted = quotes.select("item_id", F.col("text").alias("quote")).filter("quote IS NOT NULL").distinct()
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    inner = T.let(seeds.tokens(F.col("quote")), lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))))
    keyed = written(quoted.withColumn("words", F.array_distinct(inner)).withColumn("quote_id", F.xxhash64("item_id", "quote")), "quoted")
    asked = keyed.filter(F.size("words") > 0)
    pairs = written(seeds.rare_word_pairs(asked.select("quote_id", "words", F.lit(0).alias("may_lose")), texts), "quote-pairs")
    said = asked.select("quote_id", "item_id", "quote")
    met = pairs.join(F.broadcast(said) if few(said, 10_000) else said, "quote_id").join(seeds.met_only(texts, pairs), "doc_id")
    found = met.filter(F.contains("text", "quote")).select("doc_id", "item_id")
    short = keyed.filter(F.size("words") == 0).select("item_id", "quote")
    for n in sorted(r.n for r in short.select(F.least(F.lit(3), F.length("quote")).alias("n")).distinct().collect()):  # at most four numbers
        those = short.filter(F.length("quote") >= 3 if n == 3 else F.length("quote") == n)
        if n == 0:
            found = found.unionByName(texts.select("doc_id").crossJoin(F.broadcast(those.select("item_id").distinct())))
            continue
        letters = F.split("text", "")
        zipped = F.arrays_zip(*(F.slice(letters, i + 1, F.size(letters)).alias(f"c{i}") for i in range(n)))
        heads = F.array_distinct(F.transform(zipped, lambda z: F.concat_ws("", *(z[f"c{i}"] for i in range(n)))))
        by_head = texts.select("doc_id", F.explode(heads).alias("head")).join(those.withColumn("head", F.left("quote", F.lit(n))), "head")
        found = found.unionByName(texts.join(by_head.select("doc_id", "item_id", "quote").distinct(), "doc_id").filter(F.contains("text", "quote")).select("doc_id", "item_id"))
    return found.distinct()


#: Length from which a sequence ratio leaves common letters of the text out (``difflib``), and cells of a region worth a bound of its own.
POPULAR, REGION = 200, 400


def _subsequences(quote: str, codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Length of the longest common subsequence of ``quote`` and the ``width`` letters of ``codes`` behind each of ``starts``, all at a time by bits."""
    letters, rows = {c: i for i, c in enumerate(dict.fromkeys(quote))}, -(-len(quote) // 32)
    masks = np.zeros((rows, len(letters) + 1), np.uint64)
    for i, c in enumerate(quote):
        masks[i // 32, letters[c]] |= np.uint64(1 << i % 32)
    full, shift = np.uint64(0xFFFFFFFF), np.uint64(32)
    held = [np.full(len(starts), full) for _ in range(rows)]
    for j in range(width):
        at, carry = codes[starts + j], np.uint64(0)
        for k in range(rows):
            met = held[k] & masks[k][at]
            total = held[k] + met + carry
            carry = total >> shift
            held[k] = (total | (held[k] ^ met)) & full
    return sum(np.bitwise_count(~h & full).astype(np.int64) for h in held)


def _subsequence(masks: dict[str, int], start: int, size: int, text: str) -> int:
    """The same of ``size`` letters of a quotation from ``start`` on, given by its letters' bits, and one text."""
    full = (1 << size) - 1
    held = full
    for c in text:
        if met := held & (masks.get(c, 0) >> start):
            held = (held + met | held ^ met) & full
    return size - held.bit_count()


def _dense(quote: str, text: str, starts: np.ndarray, width: int) -> float:
    """The best ratio where all letters count: windows by their bound, each taken apart at its longest common runs until it cannot be the best.

    How long the run is that ends at two letters is worked out once for the quotation and the whole text.
    """
    n, letters = len(quote), {c: i for i, c in enumerate(dict.fromkeys(quote))}
    codes = np.array([letters.get(c, len(letters)) for c in text] + [len(letters)] * width, np.uint8 if len(letters) < 255 else np.int32)
    size = n + np.minimum(len(text) - starts, width)
    bounds = 2.0 * _subsequences(quote, codes, starts, width) / size
    runs = np.zeros((n, len(text)), np.uint8)
    for i, c in enumerate(quote):
        same = codes[: len(text)] == letters[c]
        if i:
            runs[i, 1:] = runs[i - 1, :-1]
        runs[i] += 1
        runs[i] *= same
    corner = np.minimum(np.arange(1, n + 1)[:, None], np.arange(1, width + 1)[None, :]).astype(np.uint8)
    masks = {}
    for i, c in enumerate(quote):
        masks[c] = masks.get(c, 0) | 1 << i
    best = 0.0
    for k in np.argsort(-bounds, kind="stable").tolist():
        if bounds[k] <= best:
            break
        at, long = int(starts[k]), int(size[k])
        most = round(bounds[k] * long / 2)
        found, open_ = 0, [(0, n, at, at + long - n, most)]
        while open_:
            i0, i1, j0, j1, least = open_.pop()
            inside = np.minimum(runs[i0:i1, j0:j1], corner[: i1 - i0, : j1 - j0])
            i, j = divmod(int(inside.argmax()), j1 - j0)
            run = int(inside[i, j])
            most -= least
            if not run:
                continue
            i, j = i0 + i - run + 1, j0 + j - run + 1
            found += run
            for a0, a1, b0, b1 in ((i0, i, j0, j), (i + run, i1, j + run, j1)):
                if a0 < a1 and b0 < b1:
                    room = _subsequence(masks, a0, a1 - a0, text[b0:b1]) if (a1 - a0) * (b1 - b0) > REGION else min(a1 - a0, b1 - b0)
                    if room:
                        most += room
                        open_.append((a0, a1, b0, b1, room))
            if 2.0 * (found + most) / long <= best:
                break
        else:
            best = max(best, 2.0 * found / long)
    return best


def _matched(quote: str, places: dict[str, list[int]], text: str) -> int:
    """Letters in the matching blocks of a text of ``POPULAR`` letters or more: blocks begin at its rarer letters, so only these are walked."""
    rare = {}
    for c in places:
        if 0 < (times := text.count(c)) <= len(text) // 100 + 1:
            rare[c] = at = [text.find(c)]
            for _ in range(times - 1):
                at.append(text.find(c, at[-1] + 1))
    own, total, open_ = sorted(i for c in rare for i in places[c]), 0, [(0, len(quote), 0, len(text))]
    while open_:
        i0, i1, j0, j1 = open_.pop()
        i, j, size, before, ends = i0, j0, 0, -2, {}
        for x in own[bisect_left(own, i0) : bisect_left(own, i1)]:
            now = {}
            if x != before + 1:
                ends = {}
            for y in rare[quote[x]]:
                if j0 <= y < j1:
                    now[y] = run = ends.get(y - 1, 0) + 1
                    if run > size:
                        i, j, size = x - run + 1, y - run + 1, run
            ends, before = now, x
        while i > i0 and j > j0 and quote[i - 1] == text[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < i1 and j + size < j1 and quote[i + size] == text[j + size]:
            size += 1
        if size:
            total += size
            if i0 < i and j0 < j:
                open_.append((i0, i, j0, j))
            if i + size < i1 and j + size < j1:
                open_.append((i + size, i1, j + size, j1))
    return total


def best_window(quote: str, text: str) -> float:
    """The best ratio of ``quote`` with windows of ``text`` a quarter longer than it, taken at every quarter of its length.

    It is that of ``difflib.SequenceMatcher``; windows that a bound keeps below the best so far are left.
    """
    n = len(quote)
    width, starts = n + n // 4, np.arange(0, max(len(text) - n, 0) + 1, max(n // 4, 8))
    if not n or len(text) < n:
        return difflib.SequenceMatcher(None, quote, text[:width]).ratio()
    if width < POPULAR:
        return _dense(quote, text, starts, width)
    best, places = 0.0, {}
    for i, c in enumerate(quote):
        places.setdefault(c, []).append(i)
    for at in starts.tolist():
        window = text[at : at + width]
        best = max(best, 2.0 * _matched(quote, places, window) / (n + len(window)) if len(window) >= POPULAR else difflib.SequenceMatcher(None, quote, window).ratio())
    return best


def similarity(quote: str, text: str) -> float:
    """1 where ``text`` holds ``quote``; else their ratio, or that of the best window where the text is over twice as long."""
    if quote in text:
        return 1.0
    return difflib.SequenceMatcher(None, quote, text).ratio() if len(text) <= 2 * len(quote) else best_window(quote, text)


#: Share of a quotation's distinct words that a source must have to be compared with it.
KEEP = 0.65


def quote_sources(quotes: DataFrame, docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """quote_id, quote, doc_id, source of the (quote_id, quote) and (doc_id, source) where the source has that share of the quotation's distinct words.

    Case and punctuation do not count. No source that has them is lost, and common words pair nothing: quotations meet sources by their rarest words.
    """
    asked = quotes.filter("quote IS NOT NULL").distinct().withColumn("words", F.array_distinct(seeds.tokens(F.col("quote"))))
    lose = F.size("words") - F.ceil(F.size("words") * F.lit(float(keep)) - 1e-9).cast("int")
    asked = written(asked.filter(F.size("words") > 0).withColumn("may_lose", lose), "asked")
    pairs = written(seeds.rare_word_pairs(asked, docs.select("doc_id", F.col("source").alias("text"))).distinct(), "quote-pairs")
    said = asked.select("quote_id", "quote")
    # dealt in a number of its own: pairs are few bytes and much work, so partitions must not be merged by their bytes
    dealt = pairs.repartition(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    met = dealt.join(F.broadcast(said) if few(said, 10_000) else said, "quote_id").join(seeds.met_only(docs, pairs), "doc_id")
    return met.select("quote_id", "quote", "doc_id", "source")


def check_all_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quote_id, doc_id, ratio, status of every quotation in every source that ``quote_sources`` pairs it with; missing, without doc_id, where there is none."""
    pairs = quote_sources(quotes, docs)
    alone = quotes.select("quote_id").distinct().join(pairs.select("quote_id"), "quote_id", "left_anti")
    return check_quotes(pairs).unionByName(alone.select("quote_id", F.lit(None).cast("long").alias("doc_id"), F.lit(0.0).alias("ratio"), F.lit("missing").alias("status")))


def check_quotes(pairs: DataFrame) -> DataFrame:
    """quote_id, ratio, status of (quote_id, quote, source): ok, altered or missing; doc_id too where ``pairs`` has it."""
    ids = [c for c in ("quote_id", "doc_id") if c in pairs.columns]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ratio = [similarity(q, s) for q, s in zip(pdf["quote"], pdf["source"], strict=True)]
            status = ["ok" if r >= VERBATIM else "altered" if r >= ALTERED else "missing" for r in ratio]
            yield pd.DataFrame({c: pdf[c] for c in ids} | {"ratio": [round(r, 4) for r in ratio], "status": status})

    return map_slices(pairs.select(*ids, "quote", "source"), scan, ", ".join(f"{c} long" for c in ids) + ", ratio double, status string")


def near_names(names: DataFrame, least: float = 0.9, back: bool = False) -> DataFrame:
    """a, b, ratio: pairs a < b of the different ``name`` whose sequence ratio is at least ``least``; with ``back``, b's ratio to a beside a's to b, where either is.

    A ratio of r leaves at most (1 - r) times both lengths of unmatched letters, d. Of d + 1 pieces of the shorter name one at least
    is whole in the other, at most d places off; so names meet by piece, and no pair is lost. Only pairs that meet are compared.
    """
    once = names.select("name").filter("name <> ''").distinct().withColumn("n", F.length("name"))
    most = F.floor((1 - least) * (F.col("n") + F.col("m")) + 1e-9).cast("int")
    # lengths that may go together: shorter n, longer m
    lengths = once.select("n").distinct()
    pairs = lengths.join(lengths.withColumnRenamed("n", "m"), F.col("m").between(F.col("n"), F.ceil(F.col("n") * (2 / least - 1)))).withColumn("d", most)
    place = F.transform(F.sequence(F.lit(0), F.col("d")), lambda k: F.struct(k.alias("k"), F.floor(k * F.col("n") / (F.col("d") + 1)).cast("int").alias("at"), F.floor((k + 1) * F.col("n") / (F.col("d") + 1)).cast("int").alias("end")))
    cut = written(pairs.select("n", "m", "d", F.explode(place).alias("p")).select("n", "m", "d", "p.*"), "name-cuts")
    left = once.join(F.broadcast(cut) if few(cut) else cut, "n").select(F.col("name").alias("x"), "n", "m", "k", F.substr("name", F.col("at") + 1, F.col("end") - F.col("at")).alias("piece"))
    offs = F.explode(F.sequence(F.greatest(F.col("at") - F.col("d"), F.lit(0)), F.least(F.col("at") + F.col("d"), F.col("m") - (F.col("end") - F.col("at")))))
    shifted = written(cut.withColumn("off", offs), "name-shifts")  # grows with the square of lengths, not with names
    right = once.withColumnRenamed("n", "m").join(F.broadcast(shifted) if few(shifted) else shifted, "m").select(F.col("name").alias("y"), "n", "m", "k", F.substr("name", F.col("off") + 1, F.col("end") - F.col("at")).alias("piece"))
    met = left.join(right.distinct(), ["n", "m", "k", "piece"]).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            matcher = difflib.SequenceMatcher(autojunk=False)
            ratio, other = [], []
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                matcher.set_seqs(a, b)
                likely = matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least
                ratio.append(matcher.ratio() if likely else 0.0)
                if back:
                    matcher.set_seqs(b, a)
                    other.append(matcher.ratio() if likely else 0.0)
            yield pdf.assign(ratio=ratio, **({"back": other} if back else {}))

    if back:
        return met.mapInPandas(compare, "a string, b string, ratio double, back double").filter((F.col("ratio") >= least) | (F.col("back") >= least))
    return met.mapInPandas(compare, "a string, b string, ratio double").filter(F.col("ratio") >= least)
