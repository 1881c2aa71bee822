"""SimHash near-duplicates by multi-index hashing.

Fingerprints within ``radius`` bits of each other agree up to ``radius // segments`` bits in one segment at least.
So each different fingerprint is filed under the value of each of its segments, looked up under all values in a small
Hamming ball around them, and the whole distance of what is found there is verified.

Values of a segment under which more than ``FILED`` fingerprints are filed aren't looked up one against all.
Everything filed under or looking there is linked through midpoints instead: two fingerprints are at most two
bits apart exactly if some value is at most one bit from both, so 65 rows for each of them give the same groups.  No value has more
than 65 of them around it, and no fingerprint more than some 2,000 links, however many fingerprints a segment is hot with.

:func:`near_copies` looks for texts of a given Jaccard similarity instead: wide fingerprints, indexed in the same way, find
candidates, and every link between two texts is one of exact similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpointed, release, small_batches, strings, written
from .components import components, contracted_components, starred
from .suffix_dedup import mixed, word_units

#: Fingerprints under one value of a segment that are compared one by one.
FILED = 256
SEED = 42
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; the whole sequence if there are fewer."""
    found = _WORD.findall(text.encode().translate(_LOWER))
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(found), len(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=n) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, n)
    spans = zip(begins[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], seed) for i, j in spans), dtype=np.uint64, count=n - width + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp`` (64 bits as a long).  Null, empty and blank texts have fingerprint zero; each row has its own."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([majority(shingle_hashes(x, words)) for x in strings(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _balls(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def links(prints: DataFrame, *, radius: int = 2, segments: int = 2) -> DataFrame:
    """``a, b``: node numbers of fingerprints that are linked, directly or through rows of the same result.

    ``prints`` has one row for each different fingerprint: ``node`` (a long of its own, not negative or less than the least value) and ``fp``.
    Connectivity is that of all pairs at most ``radius`` bits apart.  A fingerprint of a hot segment has a row for each value within half the radius, rounded
    up: 65 for radius 1 and 2, 2,081 for 3 and 4, too many to be of use from 5 on.
    """
    width = 64 // segments
    ball = F.array(*[F.lit(x).cast("long") for x in _balls(width, radius // segments)])
    value = [F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << width) - 1)) for k in range(segments)]
    filed = prints.select("node", "fp", F.posexplode(F.array(*value)).alias("seg", "value"))
    looked = filed.select("node", "fp", "seg", F.explode(F.transform(ball, lambda x: F.col("value").bitwiseXOR(x))).alias("value"))
    hot = checkpointed(filed.groupBy("seg", "value").count().where(F.col("count") > FILED).select("seg", "value"))
    other = filed.select("seg", "value", F.col("node").alias("b"), F.col("fp").alias("fb"))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("fb")))
    some_hot = not hot.isEmpty()
    if some_hot:
        other = other.join(hot, ["seg", "value"], "left_anti")
    near = looked.join(other, ["seg", "value"]).where((F.col("node") < F.col("b")) & (far <= radius)).select(F.col("node").alias("a"), "b").distinct()
    if not some_hot:
        return near
    crowd = looked.join(hot, ["seg", "value"]).select("node", "fp").distinct()
    # of two fingerprints at most radius bits apart some middle is within half of that, rounded down, from one and rounded up from the other
    middles = F.array(*[F.lit(_signed(x)).cast("long") for x in _balls(64, (radius + 1) // 2)])
    around = crowd.select("node", F.explode(F.transform(middles, lambda x: F.struct(F.col("fp").bitwiseXOR(x).alias("middle"), (F.bit_count(x) <= radius // 2).alias("close")))).alias("m")).select("node", "m.*")
    first = around.groupBy("middle").agg(F.min(F.when(F.col("close"), F.col("node"))).alias("a"), F.count("*").alias("n")).where("a is not null and n > 1").select("middle", "a")
    through = around.join(first, "middle").where("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    return near.unionByName(through)


def near_duplicates(docs: DataFrame, *, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp, component_id`` of every row: the smallest id reachable over links of at most ``radius`` differing bits.

    Equal fingerprints (copies, and all texts without words) are one node of the graph.  Rows with a null id have no
    component (null) and link nothing; repeated ids are rows of their own, but an id that is the smallest of two
    groups joins them.
    """
    prints = checkpointed(fingerprints(docs, words=words, id_col=id_col, text_col=text_col).withColumn(id_col, F.col(id_col).cast("long")))
    nodes = checkpointed(prints.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("node")))
    labels = components(links(nodes, radius=radius))  # an id that stands with two texts joins their groups
    of = nodes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(of, "fp", "left").select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


# ---- near copies: candidates by wide fingerprints, links by exact similarity

#: Words of a shingle in the similarity and in fingerprints (shorter ones, which an edit changes fewer of).
COPY_WORDS, WIDE_WORDS = 5, 2
#: Longs of a wide fingerprint, bits of a segment and segments of a long; bits in which candidates may differ, in all and in the long that travels along.
LANES, SEGMENT, SEGMENTS = 5, 21, 3
WIDE_RADIUS, LANE_RADIUS = 72, 22
#: Fingerprints under one value of a segment that are joined one by one, and rows of a block beyond that.
WIDE_FILED, WIDE_BLOCK = 8, 4_096
#: Texts and bytes of shingles of a part; candidate groups beyond either are compared part against part.
PART_TEXTS, PART_BYTES = 2_048, 4_000_000
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, LANES, dtype=np.uint64) | np.uint64(1)
_LANES = [f"f{k}" for k in range(LANES)]
_SKETCH = [T.StructField(x, T.LongType()) for x in ("s1", "s2", "size", *_LANES)]
_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_MEMBER = T.StructType([T.StructField(x, T.LongType()) for x in ("component", "parts", "node", "s1", "s2")] + [T.StructField("shingles", T.BinaryType())])


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word, A-Z read as a-z."""
    return word_units(text.encode().translate(_LOWER))[0]


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; of the whole sequence if there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = words[:n]
    for k in range(1, size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out


def _name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed longs."""
    whole = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype="<i8")
    return int(whole[0]), int(whole[1])


def wide_print(words: np.ndarray) -> np.ndarray:
    """``LANES`` longs of bits set in over half of the shingles' hashes (a mix of the shingle's hash for each long); zeros without words."""
    shingles = _runs(words, WIDE_WORDS)
    sums = np.zeros(64 * LANES, dtype=np.int64)
    for at in range(0, len(shingles), 255 * 32):
        bits = np.unpackbits(mixed(shingles[at : at + 255 * 32, None] * _FACTORS).view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):  # sums of so many fit in a byte
            sums += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(sums * 2 > len(shingles)).view("<i8")


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Different shingles' hashes in order."""
    return np.unique(_runs(words, COPY_WORDS))


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, s1, s2, size, f0, f1 ...`` of each row: name and size of its shingle set, and its wide fingerprint."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *_SKETCH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros((batch.num_rows, len(_SKETCH)), dtype=np.int64)
            for k, text in enumerate(strings(batch.column(1))):
                words = word_hashes(text)
                shingles = shingle_set(words)
                made[k] = (*_name(shingles), len(shingles), *wide_print(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[:, k]) for k in range(len(_SKETCH)))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _compared(radius: int):
    """Links that connect what lies within ``radius`` of an entry of the block's table: a forest, however many pairs there are.

    Once all rows that haven't been compared and the whole table are in one group, no link is left to be found.
    """

    def run(block: pa.Table) -> pa.Table:
        nodes, filed = block.column("node").to_numpy(), block.column("filed").to_numpy()
        prints = np.column_stack([block.column(f).to_numpy() for f in _LANES]).view(np.uint64)
        order = np.argsort(nodes, kind="stable")  # groups go by their smallest node, so blocks tend to give the same links
        table, asked = order[filed[order]], order[~filed[order]]
        _, at = np.unique(nodes, return_inverse=True)  # a node may be in the table and ask
        least = np.unique(nodes)
        label, out = np.arange(len(least)), []
        columns = np.ascontiguousarray(prints[table].T)
        for done, k in enumerate(asked):
            if not done % 64 and len(table) and (label[at[table]] == label[at[k]]).all() and (label[at[asked[done:]]] == label[at[k]]).all():
                break
            apart = np.zeros(len(table), dtype=np.uint16)
            for lane, own in zip(columns, prints[k], strict=True):
                apart += np.bitwise_count(lane ^ own)
            groups = np.unique(np.append(label[at[table[apart <= radius]]], label[at[k]]))
            for other in groups[1:]:
                out.append((least[other], least[groups[0]]))
                label[label == other] = groups[0]
        made = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": made[:, 0], "b": made[:, 1]})

    return run


def wide_links(prints: DataFrame, *, radius: int = WIDE_RADIUS) -> DataFrame:
    """``a, b``: nodes of wide fingerprints (``node, f0, f1 ...``) that are linked: at most ``radius`` bits apart, and at most one in some segment.

    All pairs up to 22 bits apart are met, and those beyond by chance: with 15 segments a pair that differs in a tenth of the bits is missed once in
    about 1,000 times, in an eighth once in 60.  Of a segment's two values that differ in a bit the one without it looks the other up, so each is met
    once.  Next to the segment travels the long after the segment's own; pairs that differ in more than ``LANE_RADIUS`` of its 64 bits go no further.
    Values with more than ``WIDE_FILED`` fingerprints are compared block by block, table against rows, and give a forest instead of all pairs; so none is left out.
    """
    low = F.lit((1 << SEGMENT) - 1).cast("long")
    key = lambda lane, k: (F.shiftrightunsigned(_LANES[lane], SEGMENT * k).bitwiseAND(low) + F.lit((lane * SEGMENTS + k) << SEGMENT)).cast("int")
    spans = [F.struct(key(lane, k).alias("value"), F.col(_LANES[(lane + 1) % LANES]).alias("check")) for lane in range(LANES) for k in range(SEGMENTS)]
    flips = F.array(*[F.lit(1 << k) for k in range(SEGMENT)])
    around = F.array_insert(F.transform(F.filter(flips, lambda m: F.col("value").bitwiseAND(m) == 0), lambda m: F.col("value").bitwiseOR(m)), 1, F.col("value"))

    def spread(some: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
        """What is filed and what is looked up."""
        filed = some.select(*names, F.explode(F.array(*spans)).alias("s")).select(*names, "s.value", "s.check")
        return filed, filed.select(*names, "check", F.explode(around).alias("value"))

    filed, looked = spread(prints, "node")
    crowded = checkpointed(filed.groupBy("value").count().where(F.col("count") > WIDE_FILED))
    rows = F.ceil(F.col("count") / WIDE_BLOCK).cast("int").alias("rows")
    here = written(looked.join(crowded, "value").select("value", "node", rows), "lookers")
    table = filed.join(crowded, "value").select("value", "node", rows)
    # lookers can be more than what is filed: they are dealt by their own number where they need more than a block
    many = here.groupBy("value").agg(F.ceil(F.count("*") / WIDE_BLOCK).cast("int").alias("cols")).where("cols > 1")
    dealt = lambda df: df.join(many, "value", "left").withColumn("cols", F.coalesce("cols", F.lit(1)))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["value", "i", "j", "filed", "node"]
    entries = dealt(table).withColumn("i", deal("rows")).withColumn("j", every("cols")).withColumn("filed", F.lit(True)).select(*columns)
    asked = dealt(here).withColumn("j", deal("cols")).withColumn("i", every("rows")).withColumn("filed", F.lit(False)).select(*columns)
    whole = entries.unionByName(asked).join(prints.select("node", *_LANES), "node")
    forest = checkpointed(starred(whole.groupBy("value", "i", "j").applyInArrow(_compared(radius), _LINK)))
    release(prints.sparkSession)
    # what crowded values have linked meets no more; a group's number travels along (null, which takes no space, without a group)
    grouped = checkpointed(prints.join(contracted_components(forest).withColumnRenamed("component", "group"), "node", "left"))
    filed, looked = spread(grouped, "node", "group")
    other = filed.select("value", F.col("node").alias("b"), F.col("check").alias("check_b"), F.col("group").alias("group_b")).join(crowded, "value", "left_anti")
    close = F.bit_count(F.col("check").bitwiseXOR(F.col("check_b"))) <= LANE_RADIUS
    strange = F.coalesce(F.col("group") != F.col("group_b"), F.lit(True))
    met = looked.join(other, "value").where((F.col("node") != F.col("b")) & strange & close).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    of = lambda name: prints.select(F.col("node").alias(name), *[F.col(f).alias(f"{name}_{f}") for f in _LANES])
    apart = sum((F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f"b_{f}"))) for f in _LANES[1:]), F.bit_count(F.col("a_f0").bitwiseXOR(F.col("b_f0"))))
    near = met.join(of("a"), "a").join(of("b"), "b").where(apart <= radius).select("a", "b")
    return near.unionByName(forest)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the rows whose text is the one that the names stand for (repeated ids may have others)."""
    for batch in batches:
        rows = []
        for *member, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strings(batch.column(5)), strict=True):
            shingles = shingle_set(word_hashes(text))
            if _name(shingles) == (member[3], member[4]):
                rows.append((*member, shingles.tobytes()))
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(columns)], names=_MEMBER.names)


def _similar(block: pa.Table) -> pa.Table:
    """Links that connect what pairs of Jaccard similarity 0.8 or more connect: a forest, however many pairs there are.

    A text is held against all others by its shingles' postings.  Once all texts that haven't been are in one group, no link between groups is left to be found.
    """
    nodes = block.column("node").to_numpy()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in block.column("shingles").to_pylist()]
    n, sizes = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posted = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    begins, at = (np.concatenate(([0], np.cumsum(x))) for x in (counts, sizes))
    label, waiting = np.arange(n), np.ones(n, dtype=bool)
    while True:
        left = np.flatnonzero(waiting)
        largest = np.bincount(label[left], minlength=n).argmax()
        outside = left[label[left] != largest]
        if not len(outside):
            break
        k = outside[0]
        waiting[k] = False
        shared = np.bincount(np.concatenate([posted[begins[i] : begins[i + 1]] for i in ids[at[k] : at[k + 1]]]), minlength=n)
        groups = np.unique(label[9 * shared >= 4 * (sizes[k] + sizes)])  # shared / union >= 0.8 in whole numbers
        label[np.isin(label, groups)] = groups[0]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    apart = nodes != least[label]
    return pa.table({"a": nodes[apart], "b": least[label][apart]})


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, component_id``: the smallest id reachable over pairs of Jaccard similarity 0.8 or more of their five-word shingles.

    Fingerprints (:func:`wide_links`) only find candidates; every link is one of exact similarity.  Texts of equal shingles are one node, texts without words too.
    Null ids have no component and link nothing.
    """
    key = F.col(id_col).cast("long")
    prints = written(sketches(docs, id_col=id_col, text_col=text_col).withColumn(id_col, key), "sketches")
    first = F.min(F.struct(F.col(id_col).alias("node"), "size", *_LANES)).alias("x")
    nodes = written(prints.where(F.col(id_col).isNotNull()).groupBy("s1", "s2").agg(first).select("s1", "s2", "x.*"), "nodes")
    members = nodes.select("node", "s1", "s2", "size").join(contracted_components(starred(wide_links(nodes.select("node", *_LANES)))), "node")
    parts = F.greatest(F.ceil(F.count("*") / PART_TEXTS), F.ceil(F.sum("size") * 8 / PART_BYTES)).cast("long")
    members = checkpointed(members.join(members.groupBy("component").agg(parts.alias("parts")), "component"))
    texts = docs.where(key.isNotNull()).select(key.alias("node"), F.col(text_col).alias("text"))
    held = members.join(texts, "node").select("component", "parts", "node", "s1", "s2", "text").mapInArrow(_members, _MEMBER).dropDuplicates(["node", "s1", "s2"])
    # a part meets every other one; a group of one part meets itself
    own = F.pmod(F.xxhash64("node", "s1", "s2"), F.col("parts"))
    met = held.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("parts = 1 or i <> j")
    blocks = met.select("component", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "node", "shingles")
    links = blocks.groupBy("component", "lo", "hi").applyInArrow(_similar, _LINK)
    labels = contracted_components(links)
    of = nodes.join(labels, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component_id"))
    return prints.join(of, ["s1", "s2"], "left").select(id_col, F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose group of near copies (:func:`near_copies`) has a smaller id; of rows repeating that id with a copy each stays."""
    marked = near_copies(docs, id_col=id_col, text_col=text_col)
    gone = checkpointed(marked.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct())
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
