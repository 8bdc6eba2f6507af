"""Removal of repeated runs of lines: a suffix array over sequences of line ids, by distributed prefix doubling.

A document is the sequence of its lines that hold anything; a line's id is 128 bits of hash. Lines that are there once
end every run, so only the others are sorted.

1. ``suffixes``: the rank of a position is where its class begins in the order of the suffixes' first w lines. A round
   sorts positions by their rank and the rank w lines on, which gives ranks by 2w lines. Positions whose class has no
   other member, or ends with its documents, are settled and leave the rounds (doubling with discarding), so late rounds
   sort the long repeats only; they end when no class splits any more. A sort is by ranges, with ties dealt over many
   tasks; tasks number their rows, and one row a task settles what they start from.
2. ``common_prefixes``: in the order of the array, how many lines a suffix shares with the one before it. The round in
   which the two parted bounds that number by a factor of two. It is worked out only where it is not the number of the line
   before less one (an irreducible value), by comparing lines between the bounds.
3. ``intervals``: stretches of the array in which that number never falls under d are the runs of d lines that stand in
   several places. The first place in order of document and line stays, later ones go.

A run goes if it is ``min_lines`` long or more, or has ``min_words`` words in all: short lines alone, such as list marks
and headings, say nothing about copying. Every line of a maximal repeated run that qualifies is in a run of at most
``min_lines`` lines that does, so intervals of few depths find all of them, however long they are. Lines of white space
are no part of sequences and always stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import discard, release, salt_count, slices, stored

_WHITE = "\\t\\n\\x0B\\f\\r "
_PLACE = ["doc_id", "th", "i"]


def line_table(docs: DataFrame, most_words: int = 5) -> DataFrame:
    """doc_id, th, i, n, a, b, words: the lines that hold anything; th tells apart rows that share a doc_id.

    i counts such lines from 0, n is their number in the document, (a, b) is the line's id. words are counted up to
    ``most_words``: sums of them reach that number where those of all words do. Rows with a null doc_id are left out.
    """
    held = F.filter(F.split("text", "\n", -1), lambda x: F.ltrim(x, F.lit("\t\n\x0b\f\r ")) != "")
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), held.alias("lines"))
    rows = rows.select("doc_id", "th", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    # most lines show enough words in their first characters
    enough = f"^[{_WHITE}]*+(?:[^{_WHITE}]++[{_WHITE}]++){{{most_words - 1}}}[^{_WHITE}]"
    counted = F.least(F.regexp_count("line", F.lit(f"[^{_WHITE}]+")), F.lit(most_words))
    words = F.when(F.substring("line", 1, 24 * most_words).rlike(enough), F.lit(most_words)).otherwise(counted)
    return rows.select(*_PLACE, "n", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"), words.alias("words"))


def with_first(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose class (``keys``) has several places, with ``later``: theirs is not the first of them.

    Counting is a partial aggregate; the classes that remain are joined in salts, so that a line which a third of the
    documents have is not one task's. Rows equal in document and text are one document.
    """
    first = F.min(F.struct(*_PLACE)).alias("first")
    classes = rows.groupBy(*keys).agg(first, F.max(F.struct(*_PLACE)).alias("last")).where("first <> last").drop("last")
    return _met(rows, classes, keys).withColumn("later", F.struct(*_PLACE) != F.col("first")).drop("first")


def several(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose class (``keys``) has several places; counted by hashing, as no order of places is asked for."""
    apart = reduce(or_, [F.min(c) != F.max(c) for c in _PLACE]).alias("apart")
    return _met(rows, rows.groupBy(*keys).agg(apart).where("apart").drop("apart"), keys)


def _met(rows: DataFrame, classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    salts = salt_count(rows.sparkSession)
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("doc_id", "i"), F.lit(salts))).join(salted, [*keys, "salt"]).drop("salt")


def _sorted_parts(rows: DataFrame, order: Sequence[str], levels: Sequence[Sequence[str]], deal: Sequence, before: Sequence[str] = ()) -> DataFrame:
    """The rows in parts that follow each other in ``order``, stored, with part, at (place in the part) and ending (its last row).

    For each of ``levels``, a list of keys, start<k> is the place of the first row of the part with the same keys. alone
    tells rows whose keys of the first level no other row has; of a part's first and last rows it is never said.
    before_<c> is what the row before in the part has in the column c of ``before``.
    """
    numbers = [[rows.columns.index(k) for k in keys] for keys in levels]
    asked = [rows.columns.index(c) for c in before]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, start, held = TaskContext.get().partitionId(), 0, [None] * len(levels), [0] * len(levels), None
        prior = [None] * len(asked)

        def told(batch, places, starts, new, after: bool | None) -> pa.RecordBatch:
            alone, ending = new & np.append(new[1:], bool(after)), np.zeros(len(places), bool)
            ending[-1] = after is None
            extra = [pa.array(np.full(len(places), part, np.int32)), pa.array(places), *map(pa.array, starts), pa.array(alone), pa.array(ending)]
            for k, c in enumerate(asked):
                column = batch.column(c)
                extra.append(pa.concat_arrays([pa.array([prior[k]], column.type), column.slice(0, len(column) - 1)]))
                prior[k] = column[-1].as_py()
            names = ["part", "at", *[f"start{k}" for k in range(len(levels))], "alone", "ending", *[f"before_{c}" for c in before]]
            return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            place, starts, fine = np.arange(at, at + n), [], None
            for k, number in enumerate(numbers):
                key = np.column_stack([batch.column(c).to_numpy() for c in number])
                new = np.ones(n, bool)
                new[1:] = (key[1:] != key[:-1]).any(1)
                new[0] = last[k] is None or (key[0] != last[k]).any()
                begun = np.maximum.accumulate(np.where(new, place, -1))
                starts.append(np.where(begun < 0, start[k], begun))
                start[k], last[k] = starts[-1][-1], key[-1]
                fine = new if k == 0 else fine
            if held:
                yield told(*held, bool(fine[0]))
            if at == 0:
                fine[0] = False  # it may go on with the part before
            held, at = (batch, place, starts, fine), at + n
        if held:
            yield told(*held, None)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    kinds = "".join(f", before_{c} {rows.schema[c].dataType.simpleString()}" for c in before)
    dealt = rows.repartitionByRange(*order, *deal).sortWithinPartitions(*order)
    starts = "".join(f"start{k} long, " for k in range(len(levels)))
    return stored(dealt.mapInArrow(run, f"{schema}, part int, at long, {starts}alone boolean, ending boolean{kinds}"))


def numbered(rows: DataFrame, levels: Sequence[Sequence[str]]) -> tuple[DataFrame, list[int], DataFrame]:
    """Adds place<k> for each of ``levels``, lists of long columns that begin the first of them: how many rows have smaller
    keys; and alone (see ``_sorted_parts``). Also returns how many different keys each level has, and the stored table.

    Rows of one key may fill several parts; a part whose first key is the last of the part before goes on with its place.
    The tables of parts have one row each.
    """
    parts = _sorted_parts(rows, levels[0], levels, [F.hash("doc_id", "i")])
    found = [F.count("*").alias("n")]
    for c in levels[0]:  # rows are in this order, so the first and the last have the part's bounds
        found += [F.max(F.when(F.col("at") == 0, F.col(c))).alias(f"low_{c}"), F.max(F.when(F.col("ending"), F.col(c))).alias(f"high_{c}")]
    for k in range(len(levels)):
        start = F.col(f"start{k}")
        found += [F.max(start).alias(f"last{k}"), F.count_if(F.col("at") == start).alias(f"kinds{k}")]
    over = W.orderBy("part")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    ends = parts.groupBy("part").agg(*found).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    for k, keys in enumerate(levels):
        on = reduce(and_, [F.col(f"low_{c}") == F.lag(f"high_{c}").over(over) for c in keys])
        ends = ends.withColumn(f"on{k}", F.coalesce(on, F.lit(False)))
        begun = F.when(~F.col(f"on{k}") | (F.col(f"kinds{k}") > 1), F.col("offset") + F.col(f"last{k}"))
        ends = ends.withColumn(f"carry{k}", F.last(begun, True).over(before))
    several = range(len(levels))
    ends = stored(ends.select("part", "offset", *[f"{c}{k}" for k in several for c in ("on", "carry", "kinds")]))
    kinds = ends.agg(*[F.sum(F.col(f"kinds{k}") - F.col(f"on{k}").cast("int")) for k in several]).first()
    placed = parts.join(F.broadcast(ends.drop(*[f"kinds{k}" for k in several])), "part")
    place = [F.when((F.col(f"start{k}") == 0) & F.col(f"on{k}"), F.col(f"carry{k}")).otherwise(F.col("offset") + F.col(f"start{k}")).alias(f"place{k}") for k in several]
    return placed.select(*rows.columns, *place, "alone"), [n or 0 for n in kinds], parts


#: Documents whose ids are sent to all tasks, to leave the lines of others out of a round.
BROADCAST_DOCS = 500_000


def suffixes(lines: DataFrame) -> DataFrame:
    """Repeated lines (doc_id, th, i, n, a, b, words, ...) with line (a number for each line id), rank and since; stored.

    rank is the place of the first suffix that is equal to the end, since the width of the round in which the suffix at
    that place was first told from the one before it.
    """
    live, _, parts = numbered(lines, [["a", "b"]])
    live = live.withColumns({"rank": F.col("place0"), "line": F.col("place0"), "since": F.lit(1).cast("long")}).drop("a", "b", "place0", "alone")
    columns, width, settled, used, behind = live.columns, 1, [], [parts], None
    while True:
        pool = live.withColumn("_live", F.lit(True))
        if settled:  # of lines that are settled only the ranks are asked for, and only a width or more after one that is not
            docs = stored(live.groupBy("doc_id", "th").agg(F.min("i").alias("_least")))
            old, behind = behind, settled[-1].select(*_PLACE, "rank")
            behind = old.union(behind) if old is not None else behind
            behind = behind.join(F.broadcast(docs) if docs.count() <= BROADCAST_DOCS else docs, ["doc_id", "th"])
            behind = stored(behind.where(F.col("i") - F.col("_least") >= width).select(*_PLACE, "rank"))
            discard(docs, *([old] if old is not None else []))
            named = [F.col(c) if c in (*_PLACE, "rank") else F.lit(None).cast(live.schema[c].dataType).alias(c) for c in columns]
            pool = pool.union(behind.select(*named, F.lit(False)))
        on = F.first("rank").over(W.partitionBy("doc_id", "th").orderBy("i").rangeBetween(width, width))
        # after the end of a document nothing follows; a line that is there once is like no other
        once = -2 - F.xxhash64("doc_id", "th", F.col("i") + width).bitwiseAND(F.lit((1 << 62) - 1))
        after = F.coalesce(on, F.when(F.col("i") + width >= F.col("n"), F.lit(-1).cast("long")).otherwise(once))
        asked = pool.withColumn("after", after).where("_live").drop("_live")
        rows, (fine, coarse), parts = numbered(asked, [["rank", "after"], ["rank"]])
        used.append(parts)
        release(lines.sparkSession)
        width *= 2
        rows = rows.withColumn("since", F.when(F.col("place0") > F.col("place1"), F.lit(width).cast("long")).otherwise(F.col("since")))
        rows = rows.withColumn("rank", F.col("rank") + F.col("place0") - F.col("place1"))
        ended = F.col("alone") | (F.col("after") == -1)
        if fine == coarse:  # no class has split
            settled.append(rows.select(*columns))
            break
        settled.append(rows.where(ended).select(*columns))
        live = rows.where(~ended).select(*columns)
        if live.isEmpty():
            break
    out = settled[0]
    for done in settled[1:]:
        out = out.union(done)
    out = stored(out)
    discard(*used, *([behind] if behind is not None else []))
    return out


def common_prefixes(array: DataFrame) -> DataFrame:
    """The suffixes with at, their place in the array, and common: how many lines they share with the suffix before.

    Of equal suffixes the one of the smaller place comes first.
    """
    parts = _sorted_parts(array, ["rank", *_PLACE], [_PLACE], [], before=_PLACE)
    ends = parts.groupBy("part").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("ending"), F.col(c))).alias(c) for c in _PLACE])
    over = W.orderBy("part")
    offset = F.coalesce(F.sum("n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("part", offset.alias("offset"), *[F.lag(c).over(over).alias(f"end_{c}") for c in _PLACE])
    # the suffix before; that of a part's first is the last of the part before
    place = [F.coalesce(f"before_{c}", f"end_{c}").alias(c) for c in _PLACE]
    before = F.when(F.coalesce("before_doc_id", "end_doc_id").isNotNull(), F.struct(*place))
    rows = parts.join(F.broadcast(ends), "part").select(*array.columns, (F.col("offset") + F.col("at")).alias("at"), before.alias("before"))
    same = F.col("at") > F.col("rank")
    left = (F.col("n") - F.col("i")).cast("long")
    known = F.when(same, left).when(F.col("since") <= 2, F.col("since") - 1)
    of_doc = W.partitionBy("doc_id", "th").orderBy("i")
    rows = rows.withColumn("common", F.when(F.col("before").isNull(), F.lit(0).cast("long")).otherwise(known))
    previous = F.lag(F.struct("i", "before", F.coalesce("common", F.lit(1)).alias("some"))).over(of_doc)
    step = (
        (F.col("previous.i") == F.col("i") - 1) & (F.col("previous.some") > 0) & (F.col("previous.before.doc_id") == F.col("before.doc_id"))
        & (F.col("previous.before.th") == F.col("before.th")) & (F.col("previous.before.i") == F.col("before.i") - 1)
    )
    rows = stored(rows.withColumn("previous", previous).withColumn("open", F.col("common").isNull() & ~F.coalesce(step, F.lit(False))).drop("previous"))
    discard(parts)
    release(array.sparkSession)
    # irreducible ones: lines between the bounds are compared; few in all (Kaerkkaeinen et al. 2009)
    steps = F.explode(F.sequence(F.expr("since div 2"), F.col("since") - 1)).alias("o")
    asked = rows.where("open").select("at", *_PLACE, "before", steps)
    lines = array.select(*_PLACE, "line")
    here = asked.withColumn("i", F.col("i") + F.col("o").cast("int")).join(lines, _PLACE, "left").select("at", "o", "before", F.col("line").alias("mine"))
    there = here.select("at", "o", "mine", "before.doc_id", "before.th", (F.col("before.i") + F.col("o").cast("int")).alias("i")).join(lines, _PLACE, "left")
    apart = there.where("mine is null or line is null or mine <> line").groupBy("at").agg(F.min("o").alias("found"))
    rows = rows.join(apart, "at", "left").withColumn("common", F.coalesce("common", "found"))
    last = F.last(F.when(F.col("common").isNotNull(), F.struct("i", "common")), True).over(of_doc)
    filled = F.coalesce(F.col("common"), F.col("base.common") - (F.col("i") - F.col("base.i")))
    return rows.withColumn("base", last).withColumn("common", filled).drop("base", "found", "open", "before", "line", "rank", "since")


def intervals(array: DataFrame, depths: Sequence[int]) -> DataFrame:
    """Adds in<d> for each depth: the place of the first suffix of the stretch that shares d lines or more."""
    at, common = array.columns.index("at"), array.columns.index("common")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), [-1] * len(depths)
        for batch in batches:
            if not batch.num_rows:
                continue
            place, shared, out = batch.column(at).to_numpy(), batch.column(common).to_numpy(), []
            for k, d in enumerate(depths):
                starts = np.maximum.accumulate(np.where(shared < d, place, -1))
                out.append(np.where(starts < 0, last[k], starts))
                last[k] = out[-1][-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), *map(pa.array, out)], names=[*batch.schema.names, "part", *[f"in{d}" for d in depths]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in array.schema)
    names = [f"in{d}" for d in depths]
    parts = stored(array.repartitionByRange("at").sortWithinPartitions("at").mapInArrow(run, f"{schema}, part int, " + ", ".join(f"{c} long" for c in names)))
    ends = parts.groupBy("part").agg(*[F.max(c).alias(c) for c in names])
    over = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("part", *[F.last(F.when(F.col(c) >= 0, F.col(c)), True).over(over).alias(f"_{c}") for c in names])
    rows = parts.join(F.broadcast(carried), "part")  # a row a part
    return rows.withColumns({c: F.when(F.col(c) >= 0, F.col(c)).otherwise(F.col(f"_{c}")) for c in names}).drop("part", *[f"_{c}" for c in names])


def repeated_lines(docs: DataFrame, min_lines: int = 3, min_words: int = 5) -> DataFrame:
    """(doc_id, th, gone): the numbers of the lines to delete, for the documents that have any.

    Rows equal in doc_id and text are one document. See the module's text for the rule.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be positive")
    lines = stored(line_table(docs, max(min_words, 1)))
    array = suffixes(several(lines, ["a", "b"]).dropDuplicates(_PLACE))
    depths = sorted({*range(1, min(min_lines - 1, max(min_words, 1)) + 1), min_lines})
    of_doc = W.partitionBy("doc_id", "th").orderBy("i")
    array = common_prefixes(array)
    array = array.withColumns({f"words{d}": F.sum("words").over(of_doc.rowsBetween(0, d - 1)) for d in depths})
    array = stored(intervals(array, depths))
    gone = None
    for d in depths:
        enough = array if d >= min_lines else array.where(F.col(f"words{d}") >= min_words)
        # all members of an interval have the same lines, so the rule holds for all or for none
        later = with_first(enough.select(*_PLACE, f"in{d}"), [f"in{d}"]).where("later")
        found = later.select("doc_id", "th", F.explode(F.sequence("i", F.col("i") + (d - 1))).alias("i"))
        gone = found if gone is None else gone.union(found)
    return gone.distinct().groupBy("doc_id", "th").agg(F.collect_list("i").alias("gone"))


def _cut(text: str, gone: list[int] | None) -> tuple[str, int, int, int]:
    """(text without the lines ``gone``, lines that hold anything, lines deleted, runs of deleted lines)"""
    out, number, runs, inside, drop = [], 0, 0, False, set(gone or ())
    for line in text.split("\n"):
        if not line.strip("\t\n\x0b\f\r "):
            out.append(line)
            continue
        if number in drop:
            runs += not inside
            inside = True
        else:
            out.append(line)
            inside = False
        number += 1
    return "\n".join(out) if drop else text, number, len(drop), runs


def without_repeats(docs: DataFrame, min_lines: int = 3, min_words: int = 5, digest: bool = False) -> DataFrame:
    """``docs`` with ``text`` cut, and n_lines, n_removed, n_runs (all long) added; with ``digest`` text is its SHA-256.

    Null texts stay null and have no lines (their digest is that of an empty text); rows with a null doc_id are kept as
    they are. Clashing columns of those names, and th and gone, are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "n_runs", "th", "gone")
    marked = docs.withColumn("th", F.xxhash64("text")).join(repeated_lines(docs, min_lines, min_words), ["doc_id", "th"], "left")
    marked = marked.select(*docs.columns, "gone")
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, found = [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                cut, *counts = _cut(text or "", gone)
                texts.append(hashlib.sha256(cut.encode()).hexdigest() if digest else None if text is None else cut)
                found.append(counts)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            counts = [pa.array(c, pa.int64()) for c in (zip(*found) if found else [[], [], []])]
            yield pa.RecordBatch.from_arrays([*columns, *counts], names=[*batch.schema.names[:-1], "n_lines", "n_removed", "n_runs"])

    return marked.mapInArrow(run, f"{schema}, n_lines long, n_removed long, n_runs long")


def cut_lines(docs: DataFrame, min_lines: int = 3, min_words: int = 5) -> DataFrame:
    """The documents with repeated runs of lines cut, ``n_chars`` renewed where it is there; own columns only.

    A document of which nothing but white space is left after a cut is itself a copy and goes.
    """
    cut = without_repeats(docs, min_lines, min_words)
    kept = cut.where(f"n_removed = 0 or text rlike '[^{_WHITE}]'".replace("\\", "\\\\"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
