"""SimHash near-dedup: fingerprints over word shingles, linked through BK-trees of shards."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import checkpointed, map_batches, read, spare
from corroborate.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Settings of near-duplicate removal at a similarity: words of a shingle, 64-bit words of a
#: fingerprint, the radius in bits, shards of a document and shingle minima that name one, and the
#: minima that cut a hot shard. Two sets with Jaccard similarity 0.8 differ by 78 of 512 bits on
#: average (deviation 8), with 0.7 by 98 and with 0.5 by 137. The radius proposes pairs, which the
#: shingles themselves then decide.
SIMILAR_SHINGLE, SIMILAR_WORDS, SIMILAR_RADIUS, BANDS, BAND, FINER = 5, 8, 104, 8, 2, 4
#: The similarity from which on documents are near duplicates.
SIMILARITY = 0.8
#: Fingerprints that one shard holds on average before more selective keys are taken, and at most
#: before that shard is cut by finer keys.
SHARD_ROWS, HOT_ROWS = 256, 4096
#: Rows and bytes of whole shards that a task gathers before it builds their trees.
FOREST_ROWS, FOREST_BYTES = 100_000, 32 << 20
#: Pairs (query, tree node) that a step of a search holds at once.
FRONTIER_ROWS = 500_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text in UTF-8: a bit is 1 if over half of the shingle hashes set it."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    return int(majority_bits(_steps(hashes[:, None], 65_536))[0])


def _steps(rows: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """rows in blocks of n, so that a very long text never needs more than a block's bits at once."""
    return (rows[at : at + n] for at in range(0, len(rows), n))


def majority_bits(blocks: Iterable[np.ndarray]) -> np.ndarray:
    """The bits that over half of the rows of all blocks set, as words; a block is (rows, words) of 64 bits."""
    ones, n = 0, 0
    for block in blocks:
        bits = np.unpackbits(np.ascontiguousarray(block.astype("<u8")).view(np.uint8), axis=1, bitorder="little")
        ones, n = ones + bits.sum(axis=0, dtype=np.int64), n + len(block)
    return np.packbits(ones * 2 > n, bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint's bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, each, "doc_id long, fp long")


# BK-trees of many shards at once, as arrays: a node's children are keyed by their distance to it.


def distance(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the fingerprints at indices a and b, of one word or a row of words each;
    word by word, so that only one word of each pair is in memory."""
    bits = np.zeros(len(a), np.int64)
    for word in fp.reshape(len(fp), -1).T:
        bits += np.bitwise_count(word[a] ^ word[b])
    return bits


def _bits(fp: np.ndarray) -> int:
    return BITS * (1 if fp.ndim == 1 else fp.shape[1])


def build_forest(fp: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One BK-tree per shard, grown level by level. fp: unsigned, one word or a row of words each;
    shard: 0.. in ascending order.

    Returns the root's index by shard, and the edges as (parent * (bits + 1) + distance, child), sorted.
    The first item of a group becomes the node; the others go to the child at their distance.
    """
    pending, group = np.arange(len(fp)), shard.astype(np.int64)
    roots, keys, children = None, [], []
    while len(pending):
        order = np.argsort(group, kind="stable")
        pending, group = pending[order], group[order]
        first = np.r_[True, group[1:] != group[:-1]]
        if roots is None:
            roots = pending[first]
        else:
            keys.append(group[first])
            children.append(pending[first])
        node = pending[first][np.cumsum(first) - 1]
        pending, node = pending[~first], node[~first]
        group = node * (_bits(fp) + 1) + distance(fp, pending, node)
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    child = np.concatenate(children) if children else np.zeros(0, np.int64)
    order = np.argsort(key)
    return roots if roots is not None else np.zeros(0, np.int64), key[order], child[order]


def search(fp: np.ndarray, queries: np.ndarray, start: np.ndarray, key: np.ndarray, child: np.ndarray, radius: int = RADIUS):
    """Yield (query, match) index arrays; follows only the edges within radius of a node's distance."""
    q, node, bits = queries, start, _bits(fp)
    while len(q):
        d = distance(fp, q, node)
        yield q[d <= radius], node[d <= radius]
        lo = np.searchsorted(key, node * (bits + 1) + np.maximum(d - radius, 0))
        hi = np.searchsorted(key, node * (bits + 1) + np.minimum(d + radius, bits), "right")
        n = hi - lo
        q = np.repeat(q, n)
        node = child[np.repeat(lo, n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]


def matches(fp: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (query, match) index arrays of all items against the trees of their own shards, in blocks
    of queries whose trees hold FRONTIER_ROWS nodes together, so that memory is bounded."""
    root_of, key, child = build_forest(fp, shard)
    block = np.cumsum(np.bincount(shard)[shard]) // FRONTIER_ROWS
    for at in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(block)) + 1):
        found = list(search(fp, at, root_of[shard[at]], key, child, radius))
        yield np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels where the items of each pair (a, b) have the same, smallest label."""
    while True:
        before = label[a] + label[b]
        low = np.minimum(label[a], label[b])
        for x in (a, b):
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, x, low)
        label = label[label]
        if np.array_equal(before, label[a] + label[b]) and np.array_equal(label[a], label[b]):
            return label


def local_roots(fp: np.ndarray, shard: np.ndarray, radius: int = RADIUS, similar: Callable | None = None) -> np.ndarray:
    """For each item the smallest index that it reaches over links inside its shard.

    similar(a, b), if given, says which pairs of indices within the radius are links. Each round asks
    for one pair of each item, then leaves out the pairs that are joined already: a group of near
    copies takes about one question for each item, and no link is lost.
    """
    label = np.arange(len(fp))
    for a, b in matches(fp, shard, radius):
        if similar is None:
            label = _joined(label, a, b)
            continue
        open_pairs = b < a
        while open_pairs.any():
            a, b = a[open_pairs], b[open_pairs]
            first = np.unique(a, return_index=True)[1]
            yes = first[similar(a[first], b[first])]
            label = _joined(label, a[yes], b[yes])
            open_pairs = label[a] != label[b]
            open_pairs[first] = False
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def _bounds(m: int) -> list[int]:
    return [round(BITS * i / m) for i in range(m + 1)]


def _mask(bounds: list[int], blocks: tuple[int, ...]) -> int:
    return sum(((1 << (bounds[b + 1] - bounds[b])) - 1) << bounds[b] for b in blocks)


def _key(t: int, mask: int) -> Column:
    signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
    return F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed)).alias("k"))


def shard_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bits of the shard keys; two fingerprints within the radius share one key at least.

    The 64 bits are cut into m blocks. Differing bits spoil at most `radius` blocks, so the pair
    agrees on some m - radius of them: one key for each choice of that many blocks. More blocks
    make longer, more selective keys and more copies of a row (4, 10, 20 or 35); m follows the
    number of fingerprints, so a shard stays small at any size. Every m finds every link.
    """
    for m in range(radius + 1, radius + 5):
        masks = [_mask(_bounds(m), c) for c in combinations(range(m), m - radius)]
        if n <= SHARD_ROWS << min(x.bit_count() for x in masks):
            break
    return masks


def shard_keys(n: int, radius: int = RADIUS) -> list[Column]:
    """The keys (t, k) of `fp` in the shards of shard_masks."""
    return [_key(t, mask) for t, mask in enumerate(shard_masks(n, radius))]


def finer_keys(n: int, radius: int = RADIUS) -> Column:
    """Keys (t, k) that cut the shard `t` of a row: the bits that its key leaves are cut into
    radius + 1 parts, and a pair that agrees on the key agrees on one part. No link is lost."""
    masks, finer = shard_masks(n, radius), None
    for t, mask in enumerate(masks):
        left = [b for b in range(BITS) if not mask >> b & 1]
        parts = [left[i :: radius + 1] for i in range(radius + 1)]
        mine = F.array(*(_key(len(masks) + t * (radius + 1) + i, mask | sum(1 << b for b in part)) for i, part in enumerate(parts)))
        finer = F.when(F.col("t") == t, mine) if finer is None else finer.when(F.col("t") == t, mine)
    return finer


def cut_hot_shards(keyed: DataFrame, finer: Column) -> DataFrame:
    """(t, k, node, fp) of keyed, where the rows of shards over HOT_ROWS move to finer shards.

    The hot keys are at most one for each HOT_ROWS rows; they are counted after a partial aggregate.
    """
    hot = checkpointed(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("t", "k"))
    plain = ("t", "k", "node", "fp")
    if hot.isEmpty():
        return keyed.select(*plain)
    moved = keyed.join(hot, ["t", "k"]).select(F.explode(finer).alias("s"), "node", "fp").select("s.t", "s.k", "node", "fp")
    return keyed.join(hot, ["t", "k"], "left_anti").select(*plain).union(moved)


def _whole_shards(make: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch]):
    """mapInArrow function: rows (t, k, node, fp, ...), sorted by (t, k) -> make(rows, fp, shard) of
    groups of whole shards. fp: a long, or binary in words of 64 bits; shard: 0.., ascending."""

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).sort_by([("t", "ascending"), ("k", "ascending"), ("node", "ascending")])
        t, k = rows["t"].to_numpy(), rows["k"].to_numpy()
        shard = np.cumsum(np.r_[False, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        if pa.types.is_integer(rows["fp"].type):
            fp = np.ascontiguousarray(rows["fp"].to_numpy()).view(np.uint64)
        else:
            fp = np.frombuffer(b"".join(rows["fp"].to_pylist()), "<u8").reshape(len(rows), -1)
        return make(rows, fp, shard)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= FOREST_ROWS or sum(x.nbytes for x in held) >= FOREST_BYTES:
                # the last shard may go on in the next batch
                t, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "k"))
                last = np.flatnonzero((t != t[-1]) | (k != k[-1]))
                if len(last):
                    cut = int(last[-1]) + 1
                    yield made([*held[:-1], b.slice(0, cut)])
                    held = [b.slice(cut)]
        if held:
            yield made(held)

    return each


def _links(rows: pa.Table, root: np.ndarray) -> pa.RecordBatch:
    """Links (u, v) from a node to the smallest that it reaches inside its shard."""
    node = rows["node"].to_numpy()
    moved = root != np.arange(len(root))
    return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["u", "v"])


def _in_shards(keyed: DataFrame, make: Callable, schema: str) -> DataFrame:
    return keyed.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(_whole_shards(make), schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Whole texts, A-Z in lower case, give a SimHash over 3-word shingles, repeats included. Equal
    fingerprints become one node, named by its smallest id, so a group of copies is one row from
    here on, however large. Nodes are dealt to shards (see shard_keys); the task that holds a shard
    builds its BK-tree and searches it with every node of the shard, following only edges within
    the radius. It passes on a link from each node to the smallest one it reaches there - at most
    one row per node and key, never all pairs - and connected components join them across shards.
    A shard that is hot all the same is cut by finer keys, which keep every link as well.

    Trees are not sent through the driver: that would gather the fingerprints of all documents.
    A shard's tree meets its queries in the task that owns the shard.

    A text without words (null, empty) has fingerprint zero and is linked like any other. Ties do
    not matter: a bit set in exactly half of the hashes is 0. Rows that repeat an id get the answer
    of their own text. A null id is never a component_id: null ids alone in their component have a
    null component_id. Other columns are not read. An empty table gives an empty result.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("node is not null"))
    n = nodes.count()
    keyed = nodes.select(F.explode(F.array(*shard_keys(n))).alias("s"), "node", "fp").select("s.t", "s.k", "node", "fp")
    linked = _in_shards(cut_hot_shards(keyed, finer_keys(n)), lambda rows, fp, shard: _links(rows, local_roots(fp, shard)), "u long, v long")
    roots = components(linked)
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _without(docs: DataFrame, components: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs but for those whose component (id_col, component_id) has a smaller id; null ids stay."""
    name = spare("_gone", docs.columns)
    gone = components.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one document, the smallest id, of each component of near_duplicates.

    Ids name documents here: rows that repeat an id stay or go together.
    """
    return _without(docs, near_duplicates(docs, id_col, text_col), id_col)


# Near duplicates at a similarity of 0.8: longer shingles, longer fingerprints, a wide radius.

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(h: np.ndarray, first: int, n: int) -> np.ndarray:
    """(len(h), n): independent hashes number first.. of each hashed shingle."""
    return _mixed(h[:, None] + np.arange(first + 1, first + n + 1, dtype=np.uint64) * _STEP)


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """The hashed set of a text's shingles; a text without words has one empty shingle."""
    words = (text or b"").translate(_LOWER).split()
    grams = {b" ".join(words[i : i + SIMILAR_SHINGLE]) for i in range(max(1, len(words) - SIMILAR_SHINGLE + 1))}
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))


def sketch(text: bytes | None) -> tuple[bytes, np.ndarray]:
    """(fingerprint, minima) of the set of a text's shingles: SIMILAR_WORDS words of majority bits,
    and the least value of BANDS * BAND + FINER further hashes."""
    h = shingle_hashes(text)
    least = np.min([_hashes(some, SIMILAR_WORDS, BANDS * BAND + FINER).min(axis=0) for some in _steps(h, 8192)], axis=0)
    return majority_bits(_hashes(some, 0, SIMILAR_WORDS) for some in _steps(h, 8192)).tobytes(), least.view(np.int64)


def hash_set(text: bytes | None) -> np.ndarray:
    """A text's hashed shingles in 32 bits, all of them."""
    return np.unique((shingle_hashes(text) >> np.uint64(32)).astype("<u4"))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of the sets behind two hash_sets, at any size (but for shingles with equal hashes:
    of 20,000 shingles one in 20,000)."""
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return 0.0  # sets of such sizes can't reach SIMILARITY, whatever they share
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [sketch(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
        minima = pa.array([m.tolist() for _, m in made], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f for f, _ in made], pa.binary()), minima], ["doc_id", "fp", "m"])


def _hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary()).to_pylist()
        made = ([sketch(t)[0] for t in texts], [hash_set(t).tobytes() for t in texts])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.binary()) for x in made)], ["node", "fp", "hashes"])


def _proposed(rows: pa.Table, fp: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """The rows that have another one within the radius in their shard."""
    found = np.zeros(len(fp), bool)
    for a, b in matches(fp, shard, SIMILAR_RADIUS):
        found[a[a != b]] = True
    kept = rows.select(["t", "k", "node", "fp"]).filter(pa.array(found))
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], schema=kept.schema)


def _decided(rows: pa.Table, fp: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """Links of the rows whose shingles are similar, among those within the radius."""
    sets = [np.frombuffer(x, "<u4") for x in rows["hashes"].to_pylist()]

    def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.fromiter((similarity(sets[i], sets[j]) >= SIMILARITY for i, j in zip(a, b, strict=True)), bool, len(a))

    return _links(rows, local_roots(fp, shard, SIMILAR_RADIUS, similar))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for each row: documents of one component are linked by a Jaccard
    similarity of SIMILARITY or more over their sets of 5-word shingles.

    Fingerprints of 512 bits over the sets of shingles propose pairs at SIMILAR_RADIUS bits or fewer.
    That wide a radius leaves no block of bits to agree on, so shards are named by pairs of shingle
    minima: sets with a Jaccard similarity of 0.8 share one of the BANDS shards with a chance of
    0.9997, and are within the radius with 0.999. The task that holds a shard builds its BK-tree and
    searches it as in near_duplicates. Only the rows that find another one go on: all their hashed
    shingles are fetched, and the shard is searched again with the shingles deciding (see similarity).
    Texts with equal sketches are one node. A shard over HOT_ROWS, which a passage that very many
    texts share can make, is cut by FINER further minima (chance at 0.8: 0.998).

    Null counts as empty; texts without words are copies of each other. The rest is as in
    near_duplicates: repeated rows, null ids, other columns, empty tables.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = checkpointed(map_batches(rows, _sketches, "doc_id long, fp binary, m array<long>"))
    nodes = checkpointed(found.groupBy("fp", "m").agg(F.min("doc_id").alias("node")).where("node is not null"))
    bands = [F.struct(F.lit(t).alias("t"), F.xxhash64(*(F.col("m")[t * BAND + i] for i in range(BAND))).alias("k")) for t in range(BANDS)]
    finer = [F.struct((BANDS + F.col("t") * FINER + j).alias("t"), F.xxhash64("k", F.col("m")[BANDS * BAND + j]).alias("k")) for j in range(FINER)]
    keyed = nodes.select(F.explode(F.array(*bands)).alias("s"), "node", "fp", "m").select("s.t", "s.k", "node", "fp", "m")
    proposed = checkpointed(_in_shards(cut_hot_shards(keyed, F.array(*finer)), _proposed, "t int, k long, node long, fp binary"))
    some = rows.join(proposed.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    hashes = map_batches(some, _hash_sets, "node long, fp binary, hashes binary").dropDuplicates(["node", "fp"])
    roots = components(_in_shards(proposed.join(hashes, ["node", "fp"]), _decided, "u long, v long"))
    named = nodes.join(roots, "node", "left").select("fp", "m", F.coalesce("root", "node").alias("component_id"))
    return found.join(named, ["fp", "m"], "left").select(F.col("doc_id").alias(id_col), "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one document, the smallest id, of each component of similar_documents."""
    return _without(docs, similar_documents(docs, id_col, text_col), id_col)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
