"""Removal of passages that an earlier document holds: suffix automata of reference shards.

A suffix automaton of a shard of texts has a state for all strings of words that end at the same places in them.  Here a state
also knows the smallest id of a text with its strings.  A document that streams through the automaton gives at each word the longest string
ending there that the shard has (its matching statistics); with the length capped at the threshold the state is that of
the last ``window`` words, and tells the first document with this window.

A large corpus is its own reference, and its automata don't fit one machine, let alone each; so shards are formed by content.  Every window of a document
belongs to an anchor, the 16-word string of the smallest hash in it, and equal windows have equal anchors.  The stretch of
windows around an anchor whose hash only one text has needs no automaton.  The other stretches, each different one once, are dealt by the anchor's hash; some whole
hashes together are a shard of bounded size, whose automaton one task builds and through which all stretches that can match it stream.
Where a hash has more stretches than a shard takes, its windows get longer anchors, in the end the windows themselves, of which each has one stretch.  Hashes only say which texts meet; what repeats is decided by
the words themselves.

A reference of bounded size (a benchmark, a block list) is broadcast instead: :func:`held_by` sends its automata to all tasks, and whole documents stream through them.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import suffix_dedup
from ._common import checkpointed, discard, raw, release, small_batches, text_column, written
from .suffix_dedup import WORD_GRAM, _joined, _split, keyed, word_units

#: Words of a shard, after which the next anchor's hash starts another, and stretches of one hash beyond which its windows get longer anchors.
SHARD_WORDS, HOT = 50_000, 2_000
#: Words of a reference that may be broadcast; its automata take some 100 bytes a word in each worker.
BROADCAST_WORDS = 2_000_000
_KEY = ["t1", "t2"]
_L, _I, _B = T.LongType(), T.IntegerType(), T.BinaryType()
#: Above every id.
_NONE = (1 << 63) - 1


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ANCHORS = _schema(t1=_L, t2=_L, id=_L, first=_I, last=_I, rank=_L, cover=_L)
STRETCHES = _schema(route=_L, cover=_L, doc=_L, words=_B)
RUNS = _schema(route=_L, cover=_L, begin=_I, end=_I, doc=_L)
CUT = _schema(t1=_L, t2=_L, n_words=_L, n_removed=_L, spans=T.ArrayType(_schema(begin=_I, end=_I)), kept=_B)
WORDS = _schema(n_words=_L, joined_sha256=T.StringType())


class Automaton:
    """A suffix automaton over sequences of hashable words, with the smallest id of the sequences that hold a state's strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [_NONE]

    def _state(self, edges: dict, length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.least.append(_NONE)
        return len(self.length) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of the strings of ``q`` no longer than through ``p``, made anew if ``q`` has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        made = self._state(self.next[q].copy(), self.length[p] + 1, self.link[q])
        self.least[made] = self.least[q]
        self.link[q] = made
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = made
            p = self.link[p]
        return made

    def add(self, words: Iterable, doc: int) -> None:
        """One more sequence; :meth:`close` must follow the last."""
        last = 0
        for word in words:
            found = self.next[last].get(word)
            if found is not None:
                last = self._split(last, word, found)
            else:
                made = self._state({}, self.length[last] + 1, 0)
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = made
                    p = self.link[p]
                if p >= 0:
                    self.link[made] = self._split(p, word, self.next[p][word])
                last = made
            if doc < self.least[last]:
                self.least[last] = doc

    def close(self) -> None:
        """Hand each state's smallest id to the states of its suffixes."""
        link, least = self.link, self.least
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[state]
            if least[state] < least[up]:
                least[up] = least[state]

    def dumped(self) -> bytes:
        self.close()
        return pickle.dumps((self.next, self.link, self.length, self.least), protocol=5)

    @staticmethod
    def loaded(data: bytes) -> Automaton:
        made = Automaton()
        made.next, made.link, made.length, made.least = pickle.loads(data)
        return made

    def statistics(self, words: Iterable, most: int) -> Iterator[tuple[int, int]]:
        """At each word the length, ``most`` at most, of the longest string ending there that the sequences have, and the smallest id of one with it."""
        following, link, length, least = self.next, self.link, self.length, self.least
        state = size = 0
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            found = following[state].get(word)
            if found is None:
                yield 0, _NONE
                continue
            state, size = found, size + 1
            if size > most:
                size = most
            while length[link[state]] >= size and state:
                state = link[state]
            yield size, least[state] if size else _NONE


def _places(units: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window, hash and hash of the stretch of anchors that have all windows between them.

    In a run of repeated words every place ties; of anchors of one hash those go whose windows their neighbours have.
    """
    _, first, last, rank, cover = suffix_dedup.anchors(units, window, gram)
    if not len(first):
        return first, last, rank, cover
    keep, done = np.ones(len(first), dtype=bool), -1
    for k in np.flatnonzero(np.concatenate((rank[1:] == rank[:-1], [False]))).tolist():
        if k and keep[k - 1]:
            done = int(last[k - 1])
        keep[k] = first[k + 1] > max(int(first[k]), done + 1)
        if keep[k]:
            done = int(last[k])
    return first[keep], last[keep], rank[keep], cover[keep]


def _rows(t1: np.ndarray, t2: np.ndarray, names: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    rows = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    first, last, rank, cover = (np.concatenate(x) for x in zip(*found, strict=True))
    columns = (t1[rows], t2[rows], names[rows], first.astype(np.int32), last.astype(np.int32), rank.view(np.int64), cover.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=ANCHORS.names)


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (batch.column(k).to_numpy() for k in range(3))
                yield _rows(*same, [_places(word_units(text)[0], window, gram) for text in raw(batch.column(3))])

    return run


def _refined(window: int, gram: int):
    """Anchors of ``gram`` words of the windows that places of a hot hash stand for (structs of id, first, last), with all else that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(k).to_numpy() for k in (0, 1))
            for k, (text, places) in enumerate(zip(raw(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                units = word_units(text)[0]
                hot = np.zeros(len(units) + 2, dtype=np.int64)
                for x in places:
                    hot[x["first"] + 1] += 1
                    hot[x["last"] + 2] -= 1
                upto = np.cumsum(np.cumsum(hot) > 0)  # hot windows before each
                first, last, rank, cover = _places(units, window, gram)
                own = upto[last + 1] > upto[first]
                yield _rows(t1[k : k + 1], t2[k : k + 1], np.array([places[0]["id"]]), [(first[own], last[own], rank[own], cover[own])])

    return run


def _stretches(window: int):
    """The words of the stretches asked for (structs of route, cover, doc, first, last), joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(raw(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                rows += [(x["route"], x["cover"], x["doc"], b" ".join(words[x["first"] : x["last"] + window])) for x in places]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=STRETCHES.names)

    return run


def _streamed(window: int, shard_words: int):
    """Rows sorted by route: whole routes become a shard's automaton, and its stretches stream through it.

    A run of windows that have the same first document is a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, list[bytes]]] = []

        def shard() -> pa.RecordBatch:
            automaton, rows = Automaton(), []
            for _, _, doc, words in held:
                automaton.add(words, doc)
            automaton.close()
            for route, cover, _, words in held:
                for at, (size, doc) in enumerate(automaton.statistics(words, window)):
                    if size == window:
                        begin = at - window + 1
                        if rows and rows[-1][:2] == [route, cover] and rows[-1][3:] == [begin, doc]:
                            rows[-1][3] = begin + 1
                        else:
                            rows.append([route, cover, begin, begin + 1, doc])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RUNS.names)

        size, last = 0, None
        for batch in batches:
            for route, cover, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if route != last and size > shard_words:
                    yield shard()
                    held, size = [], 0
                words = text.split()
                held.append((route, cover, doc, words))
                size, last = size + len(words), route
        if held:
            yield shard()

    return run


def _without(words: list[bytes], spans: list[dict]) -> list[bytes]:
    edges = [0, *(x for span in spans for x in (span["begin"], span["end"])), len(words)]
    return [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]


def _cut(window: int):
    spans_type = CUT["spans"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t1, t2, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                spans = _joined([(x["begin"], x["end"] - 1 + window) for x in found])
                kept = _without(words, spans)
                rows.append((t1, t2, len(words), len(words) - len(kept), spans, b" ".join(kept)))
            if rows:
                spans_arrow = pa.list_(pa.struct([(f.name, pa.int32()) for f in spans_type.elementType.fields]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), spans_arrow, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=CUT.names)

    return run


def _first_of_copies(texts: DataFrame) -> DataFrame:
    return texts.groupBy(*_KEY).agg(F.min("id").alias("one"))


def _texts(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """``id, text, t1, t2`` of the rows whose text can have a window."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), text_column(text_col).alias("text"))
    return keyed(named).where(F.col("id").isNotNull() & (F.octet_length("text") >= 2 * window - 1))


def passages(docs: DataFrame, window: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``t1, t2, one, n_words, n_removed, spans, kept`` of the first document, that of the smallest id ``one``, of each text that loses words.

    A word goes if a window of ``window`` words that covers it also starts in a document of a smaller id; windows are judged on the input.
    ``t1, t2`` are the text's hash (:func:`suffix_dedup.keyed`), ``spans`` the maximal runs of words removed, and ``kept`` the others, joined by blanks.  Words are
    runs of bytes other than 9 to 13 and 32.  Rows with a null id neither lose words nor have other rows lose them; null texts have no words; rows of one id don't count for each other.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = _texts(docs, window, id_col, text_col)
    one = checkpointed(_first_of_copies(texts)).withColumnRenamed("one", "id")
    text = F.xxhash64(*_KEY)
    gram, levels, involved = min(WORD_GRAM, window), [], None
    source = texts.select(*_KEY, "id", "text").mapInArrow(_anchor_rows(window, gram), ANCHORS)
    while True:
        # anchors whose hash only one text has are done with
        anchored = written(source, "anchors")
        several = written(anchored.groupBy("rank").agg(F.min(text).alias("a"), F.max(text).alias("b"), F.count("*").alias("rows")).where("a <> b").select("rank", "rows"), "ranks")
        crowd, rest = _split(several, anchored.count())
        met = anchored.join(crowd, "rank", "left_semi").unionByName(anchored.join(crowd, "rank", "left_anti").join(rest, "rank", "left_semi"))
        places = written(met if involved else met.join(one, [*_KEY, "id"], "left_semi"), "places")
        discard(anchored)
        discard(several)
        release(spark)
        # each different stretch once, by the first place that has it
        place = F.struct("id", *_KEY, "first", "last")
        covers = checkpointed(places.groupBy("rank", "cover").agg(F.min(place).alias("at"), F.max("id").alias("top"), F.count("*").alias("rows")))
        if involved is None:
            listed = places.select(*_KEY, "id").distinct()
            involved = written(texts.join(listed, [*_KEY, "id"], "left_semi").select(*_KEY, "text"), "involved")
        hot = checkpointed(covers.groupBy("rank").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).where(F.col("n") > HOT).select("rank", "rows"))
        levels.append((places, covers.drop("rows"), hot.select("rank")))
        if gram == window or not hot.limit(1).count():
            break
        # a hash with too many stretches for a shard: longer strings tell its windows apart, the longest is the window itself
        gram += -(-(window - gram) // 2)
        crowd, rest = _split(hot, places.count())
        of_hot = places.join(crowd, "rank", "left_semi").unionByName(places.join(crowd, "rank", "left_anti").join(rest, "rank", "left_semi"))
        asked = of_hot.groupBy(*_KEY).agg(F.collect_set(F.struct("id", "first", "last")).alias("places"))
        source = involved.join(asked, _KEY).select(*_KEY, "text", "places").mapInArrow(_refined(window, gram), ANCHORS)
    stretches = places = None
    for k, (own, some, hot) in enumerate(levels):
        if k < len(levels) - 1:  # the others go on to the next level
            own, some = own.join(hot, "rank", "left_anti"), some.join(hot, "rank", "left_anti")
        stretches, places = (some, own) if k == 0 else (stretches.unionByName(some), places.unionByName(own))
    stretches, places = stretches.withColumnRenamed("rank", "route"), places.withColumnRenamed("rank", "route")
    asked = stretches.groupBy(F.col("at.t1").alias("t1"), F.col("at.t2").alias("t2")).agg(F.collect_set(F.struct("route", "cover", F.col("at.id").alias("doc"), F.col("at.first").alias("first"), F.col("at.last").alias("last"))).alias("places"))
    told = involved.join(asked, _KEY).select("text", "places").mapInArrow(_stretches(window), STRETCHES)
    runs = written(told.repartition("route").sortWithinPartitions("route").mapInArrow(_streamed(window, SHARD_WORDS), RUNS), "runs")
    release(spark)
    # a run counts for the places in documents after the first one with its windows
    both = ["route", "cover"]
    listed = runs.groupBy(*both).agg(F.collect_list(F.struct("begin", "end", "doc")).alias("runs"), F.min("doc").alias("least"))
    tops = stretches.groupBy(*both).agg(F.max("top").alias("top"))
    useful = listed.join(tops, both).where("least < top").select(*both, "runs")
    useful = written(useful.join(places.groupBy(*both).agg(F.count("*").alias("rows")), both), "useful")
    crowd, rest = _split(useful, places.count())
    hit = places.join(crowd, both).unionByName(places.join(crowd.select(*both), both, "left_anti").join(rest, both))
    spans = hit.select(*_KEY, "id", "first", F.explode("runs").alias("run")).where("run.doc < id").select(*_KEY, "id", F.struct((F.col("first") + F.col("run.begin")).alias("begin"), (F.col("first") + F.col("run.end")).alias("end")).alias("span"))
    found = checkpointed(spans.groupBy(*_KEY, F.col("id").alias("one")).agg(F.collect_set("span").alias("found")))
    cut = involved.dropDuplicates(_KEY).join(found, _KEY)
    return cut.select(*_KEY, "text", "found").mapInArrow(_cut(window), CUT).join(found.select(*_KEY, "one"), _KEY)


def remove_passages(docs: DataFrame, window: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, n_removed, kept``: the words that stay, joined by blanks (see :func:`passages`); such columns are replaced.

    All rows stay, those with a null id as they are.  A document whose text has come before keeps nothing if it has a window at all.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    told = passages(docs, window, id_col=id_col, text_col=text_col)
    firsts = _first_of_copies(_texts(docs, window, id_col, text_col))
    by = firsts.join(told.drop("one", "n_words"), _KEY, "left").select(F.col("t1").alias("__v1"), F.col("t2").alias("__v2"), F.col("one").alias("__one"), F.col("n_removed").alias("__n"), F.col("kept").alias("__kept"))
    text = text_column(text_col)
    keys = docs.withColumn("__t1", F.xxhash64(text, F.lit(1))).withColumn("__t2", F.xxhash64(F.lit(2), text))
    counted = _with_words(keys, text_col)
    joined = counted.join(by, (F.col("__t1") == F.col("__v1")) & (F.col("__t2") == F.col("__v2")), "left")
    own = F.col(id_col).cast("long")
    later = F.coalesce(own > F.col("__one"), F.lit(False)) & (F.col("__words") >= window)
    cut = F.coalesce(own == F.col("__one"), F.lit(False)) & F.col("__n").isNotNull()
    removed = F.when(later, F.col("__words")).when(cut, F.col("__n")).otherwise(F.lit(0).cast("long"))
    kept = F.when(later, F.lit("")).when(cut, F.col("__kept").cast("string")).otherwise(F.col("__joined"))
    return joined.select(*docs.columns, F.col("__words").alias("n_words"), removed.alias("n_removed"), kept.alias("kept"))


def _with_words(rows: DataFrame, text_col: str, digest: bool = False) -> DataFrame:
    """Adds ``__words``, the number of words, and ``__joined``, the words joined by blanks or their SHA-256."""
    place, width = rows.columns.index(text_col), len(rows.columns)
    schema = T.StructType([*rows.schema.fields, T.StructField("__words", T.LongType()), T.StructField("__joined", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [x.split() for x in raw(batch.column(place))]
            joined = (b" ".join(w) for w in words)
            told = [hashlib.sha256(x).hexdigest() if digest else x.decode() for x in joined]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(width)), pa.array([len(w) for w in words], pa.int64()), pa.array(told, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, window: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` of every row, as of :func:`remove_passages`; texts stay where they are, only digests are joined."""
    told = passages(docs, window, id_col=id_col, text_col=text_col)
    cut = checkpointed(told.select(*_KEY, F.col("n_removed").alias("cut_words"), F.sha2("kept", 256).alias("cut_sha256")))
    texts = _texts(docs, window, id_col, text_col)
    counted = texts.groupBy(*_KEY).agg(F.min("id").alias("one"), F.max("id").alias("top"))
    by = counted.join(cut, _KEY, "left").where("cut_sha256 is not null or top > one").drop("top")
    text = text_column(text_col)
    rows = _with_words(keyed(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))), "text", digest=True).drop("text")
    joined = rows.join(by, _KEY, "left")
    later = F.coalesce(F.col("id") > F.col("one"), F.lit(False)) & (F.col("__words") >= window)
    first = F.coalesce(F.col("id") == F.col("one"), F.lit(False)) & F.col("cut_sha256").isNotNull()
    return joined.select(
        "id",
        F.col("__words").alias("n_words"),
        F.when(later, F.col("__words")).when(first, F.col("cut_words")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(later, F.sha2(F.lit("").cast("binary"), 256)).when(first, F.col("cut_sha256")).otherwise(F.col("__joined")).alias("kept_sha256"),
    )


def _built(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, size = Automaton(), 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                words = text.split()
                if size and size + len(words) > shard_words:
                    yield pa.RecordBatch.from_arrays([pa.array([automaton.dumped()], pa.binary())], names=["automaton"])
                    automaton, size = Automaton(), 0
                automaton.add(words, name)
                size += len(words)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([automaton.dumped()], pa.binary())], names=["automaton"])

    return run


def held_by(docs: DataFrame, references: DataFrame, window: int = 50, *, text_col: str = "text", reference_text_col: str = "text") -> DataFrame:
    """``docs`` with ``longest`` (words of the longest string that a reference holds, ``window`` at most) and ``spans`` of words under windows that one holds.

    The references may have ``BROADCAST_WORDS`` words in all; more is an error, and calls for :func:`passages`.  Their automata are built by tasks over
    shards of whole texts and broadcast; documents stream whole through each and aren't shuffled.  Null texts have no words; columns ``longest`` and ``spans`` are replaced.
    """
    small_batches(docs.sparkSession)
    given = references.select(text_column(reference_text_col).alias("text")).distinct()
    n_words = given.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))).first()[0] or 0
    if n_words > BROADCAST_WORDS:
        raise ValueError(f"references have {n_words} words; {BROADCAST_WORDS} may be broadcast")
    built = given.select(F.monotonically_increasing_id().alias("id"), "text").mapInArrow(_built(SHARD_WORDS), "automaton binary")
    shards = docs.sparkSession.sparkContext.broadcast([bytes(x.automaton) for x in built.collect()])  # of bounded size, see above
    docs = docs.drop("longest", "spans")
    place, width = docs.columns.index(text_col), len(docs.columns)
    spans_type = CUT["spans"].dataType
    schema = T.StructType([*docs.schema.fields, T.StructField("longest", T.IntegerType()), T.StructField("spans", spans_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton.loaded(x) for x in shards.value]
        for batch in batches:
            longest, spans = [], []
            for text in raw(batch.column(place)):
                words = text.split()
                each = [[size for size, _ in automaton.statistics(words, window)] for automaton in automata]
                sizes = [max(x) for x in zip(*each, strict=True)]
                longest.append(max(sizes, default=0))
                spans.append(_joined([(at - window + 1, at + 1) for at, size in enumerate(sizes) if size == window]))
            kind = pa.list_(pa.struct([(f.name, pa.int32()) for f in spans_type.elementType.fields]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(width)), pa.array(longest, pa.int32()), pa.array(spans, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)
