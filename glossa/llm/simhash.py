"""SimHash near-dedup with Golay-code keys.

A fingerprint is cut into halves of 32 bits. Two fingerprints at 3 or fewer differing bits have a half with at most one
(pigeonhole). Of such a half, the first 23 bits are a word of the perfect binary Golay code: every word lies within 3
of exactly one of 4096 codewords. The error is either in the other 9 bits, and then the 23 agree; or the 9 agree, and
then the codeword of one word is among the codewords of the other and its 23 neighbours (1 or 6 of them). So a
fingerprint has a few keys of 21 or 23 bits for each half, every linked pair shares one, and each pair that shares one is
verified by counting differing bits.

Equal fingerprints are one node. Rows of a key meet in sorted partitions, where pairs of a key are compared in whole
columns and only links that join two components of the partition leave (a spanning forest has the links' components).
A key with more than ``HOT`` fingerprints is split: by the four bytes of the other half, one of which must agree, and if
that is not enough by pairs of chunks, so that no task gets an unbounded group. Components come from star contraction.

Defined cases: a text with fewer words than a shingle has one shingle, the whole sequence; a null text or one without
words has fingerprint zero, linked like any other; equal texts and equal ids link; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import fresh, slices, small, staged, table

#: Fingerprints of a key beyond which the key is split.
HOT = 4096
#: Shingles hashed at a time in a long text.
BLOCK = 200_000

# The binary Golay code: generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 (fixed value).
GENERATOR, GOLAY_BITS = 0b101011100011, 23


def _remainder(word: np.ndarray) -> np.ndarray:
    word = word.copy()
    for bit in range(GOLAY_BITS - 1, 10, -1):
        word ^= np.where(word >> bit & 1, GENERATOR << (bit - 11), 0)
    return word


class Golay:
    """Indices of codewords: ``decode`` gives the one within 3 of a word."""

    def __init__(self) -> None:
        one = 1 << np.arange(GOLAY_BITS)
        i, j, k = (x.ravel() for x in np.meshgrid(*[np.concatenate([[0], one])] * 3, indexing="ij"))
        errors = np.unique(np.where((i == j) & (i > 0), 0, i | j) | k)
        errors = errors[np.bitwise_count(errors.astype(np.uint64)) <= 3]
        self.error = np.zeros(2048, np.int64)
        self.error[_remainder(errors)] = errors
        low, high = np.arange(4096), np.arange(2048) << 12
        self.low, self.high = _remainder(low), _remainder(high)

    def decode(self, word: np.ndarray) -> np.ndarray:
        syndrome = self.low[word & 4095] ^ self.high[word >> 12]
        return (word ^ self.error[syndrome]) >> 11

    def near(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of the codewords of each word and of its neighbours, each once."""
        ball = np.concatenate([[0], 1 << np.arange(GOLAY_BITS)])
        found = np.sort(self.decode(word[:, None] ^ ball[None, :]), axis=1)
        fresh = np.concatenate([np.ones((len(word), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
        return np.nonzero(fresh)[0], found[fresh]


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def shingles(text: str | None, size: int) -> list[bytes]:
    """Shingles of ASCII-lower-cased words between ASCII white space, repeats included."""
    words = text.encode().lower().split() if text else []
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def hashes(parts: list[bytes] | set[bytes], seed: int = 42) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), "<u8", len(parts))


def widened(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit hashes for every hash, the first being itself."""
    columns = [h]
    for _ in range(words - 1):
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        columns.append(h ^ h >> np.uint64(31))
    return np.stack(columns, axis=1)


def majority(h: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` times 64 bits, each set where over half of the (widened) hashes have it."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), BLOCK):
        octets = widened(h[at : at + BLOCK], words).view(np.uint8)
        if len(octets) < 2_000:
            counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:  # how often each octet has each value tells how often each bit is set
            places = np.arange(octets.shape[1], dtype=np.int64) << 8
            seen = np.bincount((octets + places).ravel(), minlength=len(places) << 8).reshape(-1, 256)
            counts += (seen @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)).ravel()
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([majority(hashes(shingles(t, size), seed))[0] for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, fp long")


def golay_keys(nodes: DataFrame) -> DataFrame:
    """key, fp for every key of every fingerprint; the other half of the bits is the one the key does not look at."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = golay()
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            keys, rows = [], []
            for half in (0, 1):
                bits = fp >> (32 * half) & 0xFFFFFFFF
                word, rest = bits & 0x7FFFFF, bits >> GOLAY_BITS
                row, index = code.near(word)
                keys += [index << 9 | rest[row] | half << 40, word | 1 << 39 | half << 40]
                rows += [row, np.arange(len(fp))]
            rows = np.concatenate(rows)
            yield pa.record_batch({"key": pa.array(np.concatenate(keys)), "fp": pa.array(fp[rows])})

    return nodes.select("fp").mapInArrow(scan, "key long, fp long")


class Forest:
    """Union-find over the values that links touch."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while (up := self.parent[x]) != root:
            self.parent[x], x = root, up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of two columns of longs (as unsigned ones: numpy counts the bits of a signed number's absolute value)."""
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


def _links(key: np.ndarray, fp: np.ndarray, bits: int, forest: Forest) -> list[tuple[int, int]]:
    """Links at ``bits`` or fewer differing bits among rows of equal keys that join components not joined before."""
    found = []
    # position 0 with 1, 2, ... of its key: all pairs, a column at a time
    left = np.arange(len(key))
    step = 1
    while True:
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            return found
        a, b = fp[left], fp[left + step]
        near = differing(a, b) <= bits
        pairs = np.unique(np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near]], axis=1), axis=0)
        found += [(x, y) for x, y in pairs.tolist() if x != y and forest.join(x, y)]
        step += 1


def _by_key(bits: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, keys, fps = Forest(), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys, fps = np.concatenate([keys, batch.column("key").to_numpy()]), np.concatenate([fps, batch.column("fp").to_numpy()])
            end = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if found := _links(keys[:end], fps[:end], bits, forest):
                yield _edges(found)
            keys, fps = keys[end:], fps[end:]
        if found := _links(keys, fps, bits, forest):
            yield _edges(found)

    return scan


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.record_batch({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})


def _hashed(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def split_hot(rows: DataFrame, hot: int) -> DataFrame:
    """``rows`` (key, fp) with keys of over ``hot`` rows replaced by keys of fewer that lose no linked pair."""
    counts = staged(rows.groupBy("key").count().filter(F.col("count") > hot), "simhash-hot")
    if counts.isEmpty():
        return rows
    side = (F.broadcast(counts) if small(counts) else counts).select("key", F.col("count").alias("n"))
    marked = rows.join(side, "key", "left")
    cool = marked.filter("n IS NULL").select("key", "fp")
    # the half that the key does not look at: one of its 4 bytes agrees
    other = F.when(F.shiftright("key", 40) == 1, F.col("fp")).otherwise(F.shiftright("fp", 32))
    octet = F.explode(F.transform(F.array(*map(F.lit, range(4))), lambda i: F.struct(i.alias("i"), F.call_function("shiftright", other, i * 8).bitwiseAND(F.lit(255)).alias("b"))))
    finer = staged(marked.filter("n IS NOT NULL").select("key", "fp", octet.alias("o")).select(_hashed("key", "o.i", "o.b").alias("key"), "fp"), "simhash-finer")
    counts = staged(finer.groupBy("key").count().filter(F.col("count") > hot), "simhash-hot")
    if counts.isEmpty():
        return cool.unionByName(finer)
    side = (F.broadcast(counts) if small(counts) else counts).select("key", F.ceil(F.col("count") / hot).cast("int").alias("n"))
    marked = finer.join(side, "key", "left")
    # a key's rows in n chunks, each pair of chunks a key of its own
    chunk = F.pmod(F.xxhash64("fp"), F.col("n"))
    paired = marked.filter("n IS NOT NULL").withColumn("c", chunk).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    paired = paired.select(_hashed("key", F.least("c", "j"), F.greatest("c", "j")).alias("key"), "fp")
    return cool.unionByName(marked.filter("n IS NULL").select("key", "fp")).unionByName(paired)


def links(nodes: DataFrame, bits: int = 3, hot: int = HOT) -> DataFrame:
    """u, v: links between distinct fingerprints ``nodes`` (fp) that have the components of all links."""
    if bits > 3:
        raise ValueError("halves with at most one error need 3 or fewer differing bits")
    keys = split_hot(staged(golay_keys(nodes), "simhash-keys"), hot)
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_by_key(bits), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (u, v): root is the smallest node of its component.

    Alternates two star steps until nothing changes: each node's larger neighbours go to its smallest, then each node and
    its smaller neighbours. Rounds grow with the logarithm of the longest path.
    """
    edges = staged(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    before = None
    while True:
        # the least neighbours are written before they are joined, so that a node with very many neighbours has two plain sides and is split
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "star")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "star-least")
        small_step = large.join(least, "u").select("v", "m").filter("v != m").toDF("u", "v").unionByName(least.toDF("u", "v"))
        edges = staged(small_step.distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.toDF("node", "root")
        before = now


def near_groups(docs: DataFrame, size: int = 3, bits: int = 3, seed: int = 42, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id: documents linked through fingerprints at ``bits`` or fewer differing bits."""
    found = staged(fingerprints(docs, size, seed), "simhash-fps")
    nodes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    return grouped(found, nodes, components(links(nodes, bits, hot)))


def grouped(found: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


# Near copies by similarity: candidates are linked by Golay keys of their fingerprints, or share one of ``BANDS`` keys, each of ``ROWS`` least
# hashes of the shingles, so a pair at 0.8 is missed once in 4,500 times whatever kind of edit lies between. The latter candidates whose numbers of shingles allow the
# similarity and whose 128-bit fingerprints differ in at most ``LOOSE`` bits (19 are usual at 0.8, with a deviation of 4) gather in
# groups, and inside a group the shingle sets themselves decide.
BANDS, ROWS, SKETCH_WORDS, LOOSE = 16, 4, 2, 40
#: Shingles of a candidate group that are compared at a time.
GROUP = 1_000_000
ODD = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) | 1 for i in range(BANDS * ROWS)], np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(hashes(set(shingles(text, size))))


def set_digest(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes())


def band_keys(h: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 4096):
        np.minimum(least, (h[at : at + 4096, None] * ODD).min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * MIX
        key ^= key >> np.uint64(29)
    return key


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """id, t, node, n, a, b, keys: digest and size of the set of shingles, its fingerprint as two longs, and its keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sketch, keys = np.zeros((len(texts), SKETCH_WORDS), "<u8"), np.zeros((len(texts), BANDS), np.uint64)
            node, n = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int32)
            for i, text in enumerate(texts):
                h = shingle_set(text, size)
                node[i], n[i] = set_digest(h), len(h)
                if len(h):
                    sketch[i], keys[i] = majority(h, SKETCH_WORDS), band_keys(h)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
            columns = [batch.column("id"), batch.column("t"), pa.array(node.view(np.int64)), pa.array(n), *(pa.array(c.copy().view(np.int64)) for c in sketch.T), flat]
            yield pa.record_batch(columns, names=["id", "t", "node", "n", "a", "b", "keys"])

    return docs.select("id", "t", "text").mapInArrow(scan, "id long, t long, node long, n int, a long, b long, keys array<long>")


def in_chunks(rows: DataFrame, hot: int) -> DataFrame:
    """Keys of over ``hot`` rows as keys of pairs of chunks: every two rows of a key still share one."""
    counts = staged(rows.groupBy("key").count().filter(F.col("count") > hot), "simhash-hot")
    if counts.isEmpty():
        return rows
    side = (F.broadcast(counts) if small(counts) else counts).select("key", F.ceil(2 * F.col("count") / hot).cast("int").alias("parts"))
    return chunk_pairs(rows.join(side, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))).select(rows.columns)


def chunk_pairs(rows: DataFrame) -> DataFrame:
    """``rows`` (key, node, parts, ..) once for each pair of chunks of its key that has the row's own chunk, by a key of that pair."""
    spread = rows.withColumn("c", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.withColumn("key", _hashed("key", F.least("c", "j"), F.greatest("c", "j"))).drop("c", "j", "parts")


def _alike(similarity: float):
    """Spanning forests of the pairs in one key that may be as similar as that."""

    def compare(key: np.ndarray, node: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
        found, left, step, root = [], np.arange(len(key)), 1, node
        while True:
            left = left[left + step < len(key)]
            left = left[key[left] == key[left + step]]
            if not len(left):
                return found
            if step & (step - 1) == 0 and step > 1:  # rows joined so far, now and then, so that few pairs are walked one by one
                rows = np.unique(np.concatenate([left, left + step]))
                root = root.copy()
                root[rows] = [forest.find(x) for x in node[rows].tolist()]
            right = left + step
            near = differing(a[left], a[right]) + differing(b[left], b[right]) <= LOOSE
            near &= np.minimum(n[left], n[right]) / np.maximum(n[left], n[right]) >= similarity
            near &= root[left] != root[right]
            found += [(x, y) for x, y in zip(node[left[near]].tolist(), node[right[near]].tolist(), strict=True) if x != y and forest.join(x, y)]
            step += 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), [np.empty(0, np.int64)] * 5
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "node", "n", "a", "b"), strict=True)]
            end = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if found := compare(*(h[:end] for h in held), forest):
                yield _edges(found)
            held = [h[end:] for h in held]
        if found := compare(*held, forest):
            yield _edges(found)

    return scan


def similar_sets(nodes: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is at least ``similarity``, all pairs considered."""
    size = np.array(list(map(len, sets)))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(codes, np.cumsum(size)[:-1])
    mark, is_open = np.zeros(len(codes), np.uint8), np.ones(len(sets), bool)
    held, found, queue = np.arange(len(sets)), [], []
    begin = np.cumsum(size) - size
    while is_open.any():
        if not queue:
            queue.append(int(np.argmax(is_open)))
            is_open[queue[0]] = False
        i = queue.pop()
        if 2 * (now := int(is_open.sum())) < len(held):
            if not now:
                break
            held = np.flatnonzero(is_open)
            codes, begin = np.concatenate([own[k] for k in held]), np.cumsum(size[held]) - size[held]
        mark[own[i]] = 1
        shared = np.add.reduceat(mark[codes], begin, dtype=np.int64)
        mark[own[i]] = 0
        hit = held[(shared / (size[i] + size[held] - shared) >= similarity) & is_open[held]]
        is_open[hit] = False
        queue += hit.tolist()
        found += [(nodes[i], nodes[k]) for k in hit.tolist()]
    return found


def _verified(similarity: float):
    def links_of(nodes: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
        once = dict(zip(nodes, sets, strict=True))
        return similar_sets(list(once), [np.frombuffer(s, np.uint64) for s in once.values()], similarity) if len(once) > 1 else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []
        for batch in batches:
            for k, node, held in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "shingles")), strict=True):
                if k != key:
                    if found := links_of(nodes, sets):
                        yield _edges(found)
                    key, nodes, sets = k, [], []
                nodes.append(node)
                sets.append(held)
        if found := links_of(nodes, sets):
            yield _edges(found)

    return scan


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """key, node, parts, shingles of the ``docs`` (key, node, parts, text) whose set of shingles has the digest ``node``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            held = pa.array([h.tobytes() for h in sets], pa.binary())
            same = pa.array(np.array([set_digest(h) for h in sets], np.uint64).view(np.int64) == batch.column("node").to_numpy())
            yield pa.record_batch([*(batch.column(c) for c in ("key", "node", "parts")), held], names=["key", "node", "parts", "shingles"]).filter(same)

    return docs.select("key", "node", "parts", "text").mapInArrow(scan, "key long, node long, parts int, shingles binary")


def verified_links(read: DataFrame, groups: DataFrame, size: int, similarity: float, partitions: int) -> DataFrame:
    """u, v: links of the pairs in ``groups`` (key, node, id, t, parts) that are as similar as that, with the components of all such pairs.

    A group of several ``parts`` is linked inside each part first. Then one member of each of these linked sets stands for it; the members of
    sets that are still apart are compared in pairs of parts, all of them. So a large group of copies of one text is compared
    once, and only a large group of texts that are not alike takes as many comparisons as it has pairs.
    """

    def compared(rows: DataFrame) -> DataFrame:
        texts = read.join(F.broadcast(rows) if small(rows) else rows, ["id", "t"])
        return chunk_pairs(shingle_sets(texts, size)).repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_verified(similarity), "u long, v long")

    large = groups.filter("parts > 1")
    if large.isEmpty():
        return compared(groups)
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    split = large.select(_hashed("key", part).alias("key"), "node", "id", "t", F.lit(1).alias("parts"))
    edges = staged(compared(staged(groups.filter("parts = 1").select(split.columns).unionByName(split), "sketch-parts")), "part-links")

    def apart(found: DataFrame) -> DataFrame:
        """key, node, id, t, parts, root of the members of large groups that are in several linked sets."""
        placed = large.join(_rooted(found).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node")).drop("_n")
        placed = staged(placed, "group-roots")
        several = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
        return staged(placed.join(several, "key", "left_semi"), "groups-apart")

    left = apart(edges)
    if left.isEmpty():
        return edges
    first = left.groupBy("key", "root").agg(F.min(F.struct("node", "id", "t")).alias("m"), F.first("parts").alias("parts"))
    edges = staged(edges.unionByName(compared(staged(first.select("key", "m.*", "parts"), "group-first"))), "part-links")
    left = apart(edges)
    return edges if left.isEmpty() else edges.unionByName(compared(left.drop("root")))


#: Stands for a null doc_id inside.
NO_ID = -(2**63)


def _rooted(edges: DataFrame) -> DataFrame:
    """``components``, with a row for the roots too."""
    found = components(edges)
    return found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    """What tells rows apart: doc_id, or ``NO_ID`` for null, and a hash of the text."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def golay_candidates(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """u, v: links of ``nodes`` (node, fp) whose fingerprints are equal or, by their Golay keys, differ in at most 3 bits, with the components of all such links."""
    first = staged(nodes.groupBy("fp").agg(F.min("node").alias("first")), "sketch-fps")
    near = staged(links(first.select("fp"), 3, hot), "sketch-links")
    ends = near.join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    equal = nodes.join(first, "fp").filter("node <> first").select("node", "first")
    return equal.unionByName(ends.select(F.col("a").alias("node"), F.col("b").alias("first"))).toDF("u", "v")


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """id, t, component_id, first of documents that are in a group with others; id is doc_id, or ``NO_ID`` for null, t a hash of the text.

    Two documents are linked if the Jaccard similarity of their sets of ``size``-word shingles is at least ``similarity``, which is
    counted; documents without words are alike. Pairs to count come from Golay keys, as in ``near_groups``, and from keys that a pair at 0.8 shares but for once in 4,500.
    ``first`` is true for the group's least (id, t).
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own_id, own_text = _keyed(docs)
    read = docs.select(own_id.alias("id"), own_text.alias("t"), "text")
    found = staged(sketches(read, size), "sketches")
    nodes = found.groupBy("node").agg(F.min(F.struct("id", "t", "n", "a", "b", "keys")).alias("x"), F.count("*").alias("rows"))
    nodes = staged(nodes.select("node", "rows", "x.*"), "sketch-nodes")
    keys = in_chunks(staged(nodes.filter("n > 0").select(F.explode("keys").alias("key"), "node", "n", "a", "b"), "sketch-keys"), hot)
    edges = keys.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_alike(similarity), "u long, v long")
    edges = golay_candidates(nodes.filter("n > 0").select("node", F.col("a").alias("fp")), hot).unionByName(edges)
    # groups of candidates, in pairs of chunks where they hold many shingles
    groups = nodes.join(_rooted(edges).withColumnRenamed("root", "key"), "node").select("key", "node", "id", "t", "n")
    parts = groups.groupBy("key").agg(F.ceil(2 * F.sum("n") / group).cast("int").alias("parts")).withColumn("parts", F.when(F.col("parts") <= 2, 1).otherwise(F.col("parts")))
    groups = staged(groups.join(parts, "key").select("key", "node", "id", "t", "parts"), "sketch-groups")
    roots = _rooted(verified_links(read, groups, size, similarity, partitions))
    placed = nodes.join(roots, "node", "left").filter("root IS NOT NULL OR rows > 1").select("node", F.struct("id", "t").alias("k"), F.coalesce("root", "node").alias("root"))
    placed = staged(placed, "sketch-placed")
    least = placed.groupBy("root").agg(F.min("k").alias("least"))
    named = found.select("id", "t", "node").join(placed.join(least, "root").select("node", "least"), "node")
    return named.select("id", "t", F.col("least.id").alias("component_id"), (F.struct("id", "t") == F.col("least")).alias("first"))


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least doc_id, a null one counting as least.

    Rows of one doc_id with different texts are different documents; rows equal in both are copies, and one stays. Ids are whole numbers or null.
    """
    found = staged(similar_groups(docs, size, similarity), "near-groups")
    own_id, own_text = _keyed(docs)
    same = (own_id == F.col("_gone_id")) & (own_text == F.col("_gone_t"))
    gone = found.filter("NOT first").select(F.col("id").alias("_gone_id"), F.col("t").alias("_gone_t")).distinct()
    # by shuffle at every size: the copies grow with the documents
    kept = docs.join(gone.hint("merge"), same, "left_anti")
    again = staged(found.filter("first").groupBy(F.col("id").alias("_gone_id"), F.col("t").alias("_gone_t")).count().filter("count > 1").drop("count"), "near-repeats")
    if again.isEmpty():
        return kept
    a, b = fresh(docs, "_a"), fresh(docs, "_b")
    once = kept.join(again.hint("merge"), same, "left_semi").withColumns({a: own_id, b: own_text}).dropDuplicates([a, b]).drop(a, b)
    return kept.join(again.hint("merge"), same, "left_anti").unionByName(once)


def op5_simhash(spark, sf_dir):
    """All ``documents`` by 64-bit SimHash of 3-word shingles, linked at 3 or fewer differing bits."""
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE_SQL: dict[str, str] = {}
