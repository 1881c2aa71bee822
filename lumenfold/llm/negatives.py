"""Hard negatives by distributed radix selection.

Anchors meet all rows in blocks: a wave of anchors of bounded size is broadcast, and each task multiplies its blocks of rows with the wave's blocks of
anchors.  First the anchors' positives are found, the rows of their own label with the highest scores.  Each positive opens a window of scores for
negatives.  Of each window a pass counts rows by the leading digit of their distance from its upper end; Spark adds the tasks' counts up, which gives
the digit where the k-th row lies, and the next pass counts the next digit among the rows with that one.  Equal scores are
told apart by the digits of the id in the same way.  Once few enough rows are at or before the digit, a last pass gathers these alone.

No pass sends more than counts, or rows that are chosen, out of a task; passes grow with the digits of scores and ids, not with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, small_batches, written
from ._vectors import binary, matrix, packed

#: Rows of a block, anchors of a block, and anchors of a wave on average; bits of a digit; rows gathered for each one wanted.
BLOCK, ANCHORS, WAVE, DIGIT, SPARE = 4_096, 1_024, 8_192, 8, 4
_L, _I, _B = T.LongType(), T.IntegerType(), T.BinaryType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BLOCKS = _schema(dim=_I, ids=_B, labels=_B, vectors=_B, largest=_L)
POSITIVES = _schema(anchor_id=_L, vec_id=_L, score=_L)
COUNTS = _schema(anchor_id=_L, slot=_I, digit=_I, n=_L)
CHOSEN = _schema(anchor_id=_L, slot=_I, vec_id=_L, score=_L)


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of (dim, id, label, v) with v as bytes, in blocks of up to ``BLOCK`` of one task and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def made(dim: int) -> pa.RecordBatch:
            ids, labels, v = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            largest = int(np.einsum("ij,ij->i", v.astype(float), v.astype(float)).max()) + 1
            columns = [binary(x.reshape(1, -1)) for x in (ids, labels, v)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *columns, pa.array([min(largest, 1 << 62)], pa.int64())], names=BLOCKS.names)

        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in set(dims.tolist()):
                own = batch.filter(pa.array(dims == dim))
                for at in range(0, own.num_rows, BLOCK):
                    part = own.slice(at, BLOCK)
                    held.setdefault(dim, []).append((part.column(1).to_numpy(), part.column(2).to_numpy(), matrix(part.column(3), dim)))
                    if sum(len(x[0]) for x in held[dim]) >= BLOCK:
                        yield made(dim)
        for dim in list(held):
            yield made(dim)

    return rows.mapInArrow(run, BLOCKS)


def products(a: np.ndarray, rows: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products as longs; no partial sum of one passes the geometric mean of the squared lengths."""
    own = float(np.einsum("ij,ij->i", a.astype(float), a.astype(float)).max(initial=0))
    size = np.sqrt(own) * np.sqrt(float(largest)) * (1 + 1e-9)
    # partial sums of up to dim products: by Cauchy and Schwarz those of absolute values stay below the lengths' product too
    for kind, most in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if size < most and max(own, largest) < most * most:
            return (a.astype(kind) @ rows.astype(kind).T).astype(np.int64)
    return a.astype(np.int64) @ rows.astype(np.int64).T


class Best:
    """The first ``k`` (score downwards, id upwards) of each group."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, [], 0

    def add(self, group: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        if len(group):
            self.held.append((group, score, name))
            self.size += len(group)

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return (np.zeros(0, np.int64),) * 3
        group, score, name = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((name, -score, group))
        group, score, name = group[order], score[order], name[order]
        edge = np.concatenate(([True], group[1:] != group[:-1]))
        place = np.arange(len(group)) - np.maximum.accumulate(np.where(edge, np.arange(len(group)), 0))
        keep = place < self.k
        self.held = [(group[keep], score[keep], name[keep])]
        self.size = int(keep.sum())
        return self.held[0]


class _Anchors:
    """A block of anchors with its pairs, read from a row."""

    def __init__(self, column: pa.Array, dim: int):
        rows = column.flatten()
        got = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
        self.ids = got["id"].to_numpy(zero_copy_only=False)
        self.labels = got["label"].to_numpy(zero_copy_only=False)
        self.vectors = matrix(got["v"], dim)
        self.pairs = [(k, x) for k, pairs in enumerate(got["pairs"].to_pylist()) for x in pairs] if "pairs" in got else []
        at = lambda name: np.array([x[name] for _, x in self.pairs], dtype=np.int64)
        self.of = np.array([k for k, _ in self.pairs], dtype=np.int64)
        if self.pairs:
            self.slot, self.low, self.high, self.shift, self.prefix, self.id_shift, self.id_prefix = map(at, ("slot", "low", "high", "shift", "prefix", "id_shift", "id_prefix"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], _Anchors, np.ndarray, np.ndarray, np.ndarray]]:
    """Key and contents of the anchors' block, the rows' ids, labels and scores, of each two blocks that meet."""
    seen: dict[tuple[int, int], _Anchors] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            dim = batch.column(0)[k].as_py()
            number = dim, batch.column(5)[k].as_py()
            if number not in seen:
                seen[number] = _Anchors(batch.column(6).slice(k, 1), dim)
            a = seen[number]
            ids, labels = (np.frombuffer(batch.column(j)[k].as_py(), dtype="<i8") for j in (1, 2))
            rows = np.frombuffer(batch.column(3)[k].as_py(), dtype="<i4").reshape(-1, dim)
            yield number, a, ids, labels, products(a.vectors, rows, batch.column(4)[k].as_py())


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[_Anchors, Best]] = {}
        for number, a, ids, labels, scores in _met(batches):
            _, found = best.setdefault(number, (a, Best(k)))
            limit = np.full(len(a.ids), np.iinfo(np.int64).min)
            if found.size:
                group, score, _ = found.cut()
                full = np.bincount(group, minlength=len(a.ids)) == k
                last = np.full(len(a.ids), np.iinfo(np.int64).max)
                np.minimum.at(last, group, score)
                limit[full] = last[full]
            good = (a.labels[:, None] == labels) & (a.ids[:, None] != ids) & (scores >= limit[:, None])
            at, col = np.nonzero(good)
            found.add(at, scores[at, col], ids[col])
        for a, found in best.values():
            group, score, name = found.cut()
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[group]), pa.array(name), pa.array(score)], names=POSITIVES.names)

    return run


def _inside(a: _Anchors, p: int, labels: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Columns of the rows in a pair's window."""
    own = scores[a.of[p]]
    return np.flatnonzero((own <= a.high[p]) & (own >= a.low[p]) & (labels != a.labels[a.of[p]]))


def _counted(digit: int, least_id: int, by_id: bool):
    """Rows by the digit that each open pair asks for."""
    mask = (1 << digit) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], tuple[_Anchors, np.ndarray]] = {}
        for number, a, ids, labels, scores in _met(batches):
            told = counts.setdefault(number, (a, np.zeros((len(a.pairs), mask + 1), dtype=np.int64)))[1]
            for p in range(len(a.pairs)):
                inside = _inside(a, p, labels, scores)
                key = a.high[p] - scores[a.of[p], inside]
                if by_id:
                    rest = ids[inside[key == a.prefix[p]]] - least_id
                    shift, prefix = a.id_shift[p], a.id_prefix[p]
                else:
                    rest, shift, prefix = key, a.shift[p], a.prefix[p]
                if len(rest):
                    told[p] += np.bincount((rest >> shift)[(rest >> shift >> digit) == prefix >> digit] & mask, minlength=mask + 1)
        for a, told in counts.values():
            p, d = np.nonzero(told)
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(a.ids[a.of[p]]), pa.array(a.slot[p].astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(told[p, d])], names=COUNTS.names)

    return run


def _gathered(k: int, least_id: int):
    """The rows at or before each pair's digit; of rows that agree in score and id at most ``k`` a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[_Anchors, Best]] = {}
        for number, a, ids, labels, scores in _met(batches):
            found = best.setdefault(number, (a, Best(k)))[1]
            for p in range(len(a.pairs)):
                inside = _inside(a, p, labels, scores)
                key = (a.high[p] - scores[a.of[p], inside]) >> a.shift[p]
                here = (key == a.prefix[p]) & (((ids[inside] - least_id) >> a.id_shift[p]) <= a.id_prefix[p])
                inside = inside[(key < a.prefix[p]) | here]
                found.add(np.full(len(inside), p), scores[a.of[p], inside], ids[inside])
            if found.size > 4 * k * max(1, len(a.pairs)):
                found.cut()
        for a, found in best.values():
            p, score, name = found.cut()
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(a.ids[a.of[p]]), pa.array(a.slot[p].astype(np.int32)), pa.array(name), pa.array(score)], names=CHOSEN.names)

    return run


def _mined(held: DataFrame, anchors: DataFrame, wave: int, positives: int, negatives: int, low: int, high: int, ids: tuple[int, int]) -> DataFrame:
    """The negatives of one wave of anchors, as a written table."""
    own = anchors.where(F.col("wave") == wave)
    keys = ["dim", "number"]

    def meeting(pairs: DataFrame | None) -> DataFrame:
        rows = own if pairs is None else own.join(F.broadcast(pairs.groupBy("id").agg(F.collect_list("pair").alias("pairs"))), "id")
        gathered = rows.groupBy(*keys).agg(F.collect_list(F.struct(*["id", "label", "v"], *([] if pairs is None else ["pairs"]))).alias("anchors"))
        # a wave's anchors and pairs: some WAVE rows, by the number of waves
        return held.join(F.broadcast(gathered), "dim").select(*BLOCKS.names, "number", "anchors")

    best = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    near = meeting(None).mapInArrow(_nearest(positives), POSITIVES).withColumn("slot", F.row_number().over(best)).where(F.col("slot") <= positives)
    # least and greatest whole scores within the shares
    floors = near.select("anchor_id", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr(f"-((-{low} * score - pmod(-{low} * score, 100)) div 100)").alias("low"), F.expr(f"({high} * score - pmod({high} * score, 100)) div 100").alias("high"))
    zero = F.lit(0).cast("long")
    pairs = written(floors.where("low <= high").select("*", zero.alias("shift"), zero.alias("prefix"), zero.alias("id_shift"), F.lit(-1).cast("long").alias("id_prefix"), F.lit(negatives).cast("long").alias("need"), F.lit(True).alias("open")), "pairs")
    least, greatest = ids
    widest = pairs.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    if widest is None:
        discard(pairs)
        return None
    levels = [(False, s) for s in reversed(range(0, max(1, widest.bit_length()), DIGIT))] + [(True, s) for s in reversed(range(0, max(1, (greatest - least).bit_length()), DIGIT))]
    fields = ("slot", "low", "high", "shift", "prefix", "id_shift", "id_prefix")
    as_pairs = lambda table: table.select(F.col("anchor_id").alias("id"), F.struct(*fields).alias("pair"))
    for by_id, shift in levels:
        # open pairs go one digit further down
        digit = F.lit(1 << DIGIT)
        if by_id:
            first = F.col("id_prefix") < 0
            asked = pairs.withColumn("id_prefix", F.when(first & F.col("open"), F.lit(0)).otherwise(F.when(F.col("open"), F.col("id_prefix") * digit).otherwise(F.col("id_prefix")))).withColumn("id_shift", F.when(F.col("open"), F.lit(shift)).otherwise(F.col("id_shift")))
        else:
            asked = pairs.withColumn("prefix", F.when(F.col("open"), F.col("prefix") * digit).otherwise(F.col("prefix"))).withColumn("shift", F.when(F.col("open"), F.lit(shift)).otherwise(F.col("shift")))
        asked = asked.withColumns({c: F.col(c).cast("long") for c in ("prefix", "shift", "id_prefix", "id_shift")})
        counts = meeting(as_pairs(asked.where("open"))).mapInArrow(_counted(DIGIT, least, by_id), COUNTS).groupBy("anchor_id", "slot", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("anchor_id", "slot").orderBy("digit"))  # as many rows as a digit has values
        told = counts.withColumn("upto", upto).withColumnRenamed("anchor_id", "a").withColumnRenamed("slot", "s")
        asked_need = asked.where("open").select("anchor_id", "slot", "need")
        at = told.join(F.broadcast(asked_need), (F.col("a") == F.col("anchor_id")) & (F.col("s") == F.col("slot")))
        reached = F.col("upto") >= F.col("need")
        chosen = at.groupBy("a", "s").agg(F.min(F.when(reached, F.struct("digit", "upto", "n"))).alias("hit"))
        seen = asked.join(F.broadcast(chosen), (F.col("a") == F.col("anchor_id")) & (F.col("s") == F.col("slot")), "left")
        hit, name = F.col("hit"), "id_prefix" if by_id else "prefix"
        last = F.lit((1 << DIGIT) - 1)  # too few rows: all that are left
        fresh = F.when(~F.col("open"), F.col(name)).when(hit.isNull(), F.col(name) + last).otherwise(F.col(name) + hit["digit"])
        # rows before the digit are sure; those at it go on if they are many
        left = F.when(F.col("open") & hit.isNotNull(), F.col("need") - (hit["upto"] - hit["n"])).otherwise(F.col("need"))
        many = F.col("open") & hit.isNotNull() & (hit["n"] > SPARE * negatives)
        all_ids = F.lit((1 << 62) - 1)
        after = seen.withColumns({name: fresh, "need": left, "open": F.coalesce(many, F.lit(False))})
        if not by_id:
            after = after.withColumn("id_prefix", F.when(F.col("open"), F.lit(-1)).otherwise(F.when(F.col("id_prefix") < 0, all_ids).otherwise(F.col("id_prefix"))))
        table = written(after.select(*pairs.columns), "pairs")
        discard(pairs)
        pairs = table
        if not pairs.where("open").limit(1).count():
            break
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id"))
    rows = meeting(as_pairs(pairs)).mapInArrow(_gathered(negatives, least), CHOSEN).withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = pairs.select("anchor_id", "slot", "positive_id", "positive_score")
    out = rows.join(F.broadcast(named), ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    table = written(out, "negatives")
    discard(pairs)
    return table


def mine(rows: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "v") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, see the module.

    An anchor's positives are its ``positives`` best other rows of its label, and a positive's negatives the ``negatives`` best rows of other labels
    whose score is ``low`` to ``high`` percent of its own; best by score, ties by smaller id; fewer give all.  Scores are inner products of arrays
    of longs (``_vectors.whole_numbers``), ids and labels are longs.  Rows and anchors with a null id, label, vector or an empty vector take
    no part, and rows of another number of components don't meet.  Anchors that repeat an id count once (the smallest label, then vector); other
    rows that repeat an id count each, but a row of the anchor's own id isn't its positive.  Ids span less than 2**62.  Empty tables give no rows; other columns play no part.
    """
    small_batches(rows.sparkSession, 10_000)
    spark = rows.sparkSession

    def clean(table: DataFrame) -> DataFrame:
        named = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
        return named.where("id is not null and label is not null and size(v) > 0").select(F.size("v").alias("dim"), "id", "label", "v")

    asked = clean(anchors).groupBy("id").agg(F.min(F.struct("label", "v", "dim")).alias("x")).select("x.dim", "id", "x.label", "x.v")
    asked = written(packed(asked, "v"), "anchors")
    count = asked.count()
    waves = -(-count // WAVE)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not waves:
        return empty
    held = written(blocks(packed(clean(rows), "v")), "blocks")
    least, greatest = clean(rows).agg(F.min("id"), F.max("id")).first()
    if least is None:
        return empty
    share = F.xxhash64("id")
    many = -(-count // waves // ANCHORS)
    dealt = asked.withColumn("wave", F.pmod(share, F.lit(waves))).withColumn("number", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(many)).cast("int"))
    out = empty
    for wave in range(waves):
        made = _mined(held, dealt, wave, positives, negatives, low, high, (least, greatest))
        out = out if made is None else out.unionByName(made)
    return out
