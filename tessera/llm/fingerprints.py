"""SpotSigs fingerprints (Theobald et al. 2008) in DataFrame operations only.

A signature is a very common word (the anchor) with the next two words that are not common; the start of a text is an
anchor too, so a text with any word has a signature. Which words are common is measured on the table (``common_words``):
the words that most documents have, whatever their languages. Texts in rarer languages, code and lists may have few of
them, so anchors are added: of any ``SPAN`` words in a row (common ones not counted) that hold no anchor, the one with
the least hash becomes one (winnowing, Schleimer et al. 2003). Anchors thus stand in every part of every text, and
whether a word is one depends only on the words near it. In scripts without spaces every character is a word. The
fingerprint of a text is the sorted set of its signatures' 32-bit hashes. A text without words, such as one of symbols,
gets the hash of itself; an empty text has an empty one.

Two fingerprints are as alike as their sets' Jaccard similarity; two empty ones are alike (1). The sizes of two sets
bound it from above, so candidates are only looked for between sets of near length (``near_classes``), and a
comparison whose bound is under the threshold is not made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import components, discard, release, salt_count, stored

#: There is an anchor among any so many words in a row.
SPAN = 8  # a power of two
#: How many of the words that most documents have are anchors, and how many after them are passed over by chains.
ANCHORS, PASSED_OVER = 24, 96
#: Thai, Lao, Myanmar, Khmer, kana and Han: ranges of code points, which a pattern tests faster than names of scripts.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"


@dataclass(frozen=True)
class Common:
    """The common words of a table: anchors, and further words that chains pass over."""

    anchors: tuple[str, ...] = ()
    passed: tuple[str, ...] = ()


def words_of(text: Column) -> Column:
    """The words of a text in lower case, with single spaces between them: stretches of letters, marks and digits."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")
    apart = F.regexp_replace(F.regexp_replace(plain, rf"[{UNSPACED}]\p{{M}}*", " $0 "), " {2,}", " ")
    return F.trim(F.when(plain.rlike(f"[{UNSPACED}]"), apart).otherwise(plain))


def common_words(docs: DataFrame, anchors: int = ANCHORS, passed: int = PASSED_OVER) -> Common:
    """The words that most documents of the whole table have; of words that as many have, the smaller first.

    Words of one document only are not common. At most ``anchors + passed`` words come to the driver.
    """
    each = docs.where("text is not null").select(F.explode(F.array_distinct(F.split(words_of(F.col("text")), " "))).alias("word"))
    often = each.where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    top = [r["word"] for r in often.orderBy(F.desc("n"), "word").limit(anchors + passed).collect()]
    return Common(tuple(top[:anchors]), tuple(top[anchors:]))


def any_of(words: tuple[str, ...]) -> str:
    """A pattern for any of the words, branching by characters, so that a word is tried once and not for each of them."""
    branches: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        branches.setdefault(w[:1], []).append(w[1:])
    tails = [first + (any_of(tuple(rest)) if len(rest) > 1 else rest[0]) for first, rest in branches.items() if first]
    whole = f"(?:{'|'.join(tails)})" if len(tails) > 1 else "".join(tails)
    return f"(?:{whole})?" if "" in branches and tails else whole


def with_signatures(df: DataFrame, text: str, out: str, common: Common) -> DataFrame:
    """Adds ``out`` array<int>, the sorted distinct signatures of column ``text``, which has no nulls.

    In steps, as each is used more than once and Spark would otherwise work it out again for every use.
    """
    kept = F.concat(F.lit(" "), F.col("_words"), F.lit(" "))
    if common.passed:
        kept = F.regexp_replace(kept, f"(?<= ){any_of(common.passed)} ", "")
    tied = F.trim(F.regexp_replace(kept, f"(?<= )({any_of(common.anchors)}) ", "$1_") if common.anchors else kept)
    marks = F.split(F.concat(F.lit("^_"), tied), " ")
    # tied marks come before all others, so that words are only taken where there are none
    order = F.transform("_marks", lambda m: F.when(m.contains("_"), -1).otherwise(F.hash(m).bitwiseAND(0x7FFFFFFF)))

    def over(frame: DataFrame, column: str, pick) -> DataFrame:
        """Every place of a column becomes ``pick`` of it and the SPAN - 1 that follow, by doubling."""
        step = 1
        while step < SPAN:
            shifted = F.slice(column, step + 1, F.greatest(F.size(column), F.lit(1)))
            frame = frame.withColumn(column, F.zip_with(column, shifted, lambda a, b: pick(a, b)))
            step *= 2
        return frame

    spans = F.greatest(F.size("_order") - (SPAN - 1), F.lit(1))
    least = F.concat(F.array_repeat(F.lit(-2), SPAN - 1), F.slice(F.col("_least"), 1, spans))
    word = lambda i: F.substring_index(F.coalesce(F.get("_marks", i), F.lit("")), "_", -1)
    chain = F.transform(
        F.arrays_zip("_marks", "_order", "_chosen"),
        lambda z, i: F.when(z["_order"] < 0, F.hash(z["_marks"], word(i + 1))).when(z["_order"] == z["_chosen"], F.hash(z["_marks"], word(i + 1), word(i + 2))),
    )
    none = F.when(F.col(text) == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(F.lit("whole"), F.col(text))))
    df = df.withColumn("_words", words_of(F.col(text))).withColumn("_marks", marks).withColumn("_order", order)
    df = over(df.withColumn("_least", F.col("_order")), "_least", F.least).withColumn("_chosen", least)
    df = over(df, "_chosen", F.greatest).withColumn("_chosen", F.slice("_chosen", 1, F.size("_order")))
    df = df.withColumn(out, F.array_sort(F.array_distinct(F.array_compact(chain))))
    return df.withColumn(out, F.when(F.col("_words") == "", none).otherwise(F.col(out))).drop("_words", "_marks", "_order", "_least", "_chosen")


def as_text(sigs: Column) -> Column:
    """The fingerprint as one string: eight hexadecimal digits for each signature."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity; 0 without comparing where the sizes alone keep it under ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    jaccard = common / (small + large - common).cast("double")
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * F.lit(least)), F.lit(0.0)).otherwise(jaccard)


#: Names of classes that are sent to all tasks; more are joined by a shuffle.
BROADCAST_NAMES = 500_000


def _digests(sigs: str) -> list[Column]:
    return [F.size(sigs).alias("n"), F.xxhash64(sigs).alias("d1"), F.xxhash64(F.lit(7), sigs).alias("d2")]


def _parity(sigs: str) -> Column:
    """256 parities, a bit for each signature modulo 256: two sets differ by at least as many members as bits."""
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(63))
    quarter = lambda i: F.filter(sigs, lambda s: F.shiftright(s, 6).bitwiseAND(3) == i)
    return F.array(*[F.aggregate(quarter(i), F.lit(0).cast("long"), lambda acc, s: acc.bitwiseXOR(bit(s))) for i in range(4)])


def _apart(a: str, b: str) -> Column:
    """The least number of members that two sets with these parities do not share."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)


def class_names(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """n, d1, d2, class_id: the class of a fingerprint, known by its size and two digests; a stored table.

    A class is what is reachable by likeness of ``threshold`` or more, and its name the smallest id in it.

    prints: id long, sigs array<int>; the threshold counts in whole millionths, so that bounds are exact. Equal fingerprints
    count once. Sets are put in length bands a factor 1/threshold wide or a little more, so partners stand in one band or
    the next; two such sets share one of the size - ceil(threshold * size) + 1 rarest signatures of either, which are the
    keys. A signature of one set only is no key, but it is the rarest, so a set with that many of them has no partner.
    Under a key all first meet its smallest id; then only members of different classes meet, so a key that very many near
    copies share makes no square of pairs. Two that meet are a pair only where three exact bounds allow it: their sizes;
    their places in the order of rarity, as no signature before the first they share is common (Xiao et al. 2008); and
    their parities (``_parity``). Only such pairs are sent on and compared in full. Empty fingerprints and those of rows
    without an id are left out. Where an id is repeated, the row with the smallest digest stands for it, and the others'
    fingerprints are left out.
    """
    spark = prints.sparkSession
    parts, whole = round(threshold * 1_000_000), 1_000_000
    some = prints.where("id is not null and size(sigs) > 0").select("id", "sigs", *_digests("sigs"))
    # equal sets: a partial aggregate; of each the smallest id
    sets = all_sets = stored(some.groupBy("n", "d1", "d2").agg(F.min("id").alias("id"), F.first("sigs").alias("sigs"), (F.count("*") > 1).alias("several")))
    spent = [all_sets]
    release(spark)
    names = sets.select("n", "d1", "d2", "id", "several")
    if not sets.groupBy("id").count().where("count > 1").isEmpty():
        own = F.row_number().over(W.partitionBy("id").orderBy("d1", "d2"))
        sets = stored(sets.withColumn("_r", own).where("_r = 1").drop("_r"))
        spent.append(sets)
    sets = sets.select("id", "sigs", "n")
    spread = sets.select("id", "n", F.explode("sigs").alias("sig"))
    often = spread.groupBy("sig").agg(F.count("*").alias("freq")).where("freq > 1")
    # places in the order of rarity: those that only this set has come first
    of_set = W.partitionBy("id")
    known = spread.join(often, "sig").withColumn("r", F.row_number().over(of_set.orderBy("freq", "sig")) + F.col("n") - F.count("*").over(of_set))
    rare = known.where(F.col("r") <= F.col("n") + F.expr(f"-(n * {parts}L + {whole - 1}L) div {whole}L") + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-1.0) / F.log(F.lit(threshold)) / F.lit(1 + 1e-9))
    keyed = raw = stored(rare.select("id", "sig", F.col("n").cast("int"), F.col("r").cast("int"), F.explode(F.array(band.cast("int"), band.cast("int") - 1)).alias("band")))
    release(spark)
    centre = F.min_by(F.struct("id", "n", "r"), "id").alias("centre")
    groups = keyed.groupBy("sig", "band").agg(centre, F.count("*").alias("c")).where("c > 1").drop("c")
    keyed = stored(_beside(keyed, groups, ["sig", "band"], F.hash("id"), "inner"))
    discard(raw)
    release(spark)

    def may_meet(na: Column, ra: Column, nb: Column, rb: Column) -> Column:
        """Whether sizes and places allow the likeness, for a signature that is the first of those shared."""
        na, ra, nb, rb = (c.cast("long") for c in (na, ra, nb, rb))
        near = F.least(na, nb) * whole >= F.greatest(na, nb) * parts
        return near & ((F.least(na - ra, nb - rb) + 1) * (whole + parts) >= (na + nb) * parts)

    sketches = sets.select("id", _parity("sigs").alias("p"))
    of = lambda table, side: table.withColumnsRenamed({c: f"{c}{side}" for c in table.columns if c != "id"} | {"id": side})

    def may_be_alike() -> Column:
        return _apart("pa", "pb").cast("long") * (whole + parts) <= (F.col("na") + F.col("nb")).cast("long") * (whole - parts)

    def linked(pairs: DataFrame) -> DataFrame:
        met = pairs.join(of(sets.drop("n"), "a"), "a").join(of(sets.drop("n"), "b"), "b")
        common = F.size(F.array_intersect("sigsa", "sigsb")).cast("long")
        return met.where(common * whole >= (F.col("na") + F.col("nb") - common) * parts).select("a", "b")

    c = F.col("centre")
    with_centre = keyed.where(F.col("id") != c["id"]).where(may_meet(c["n"], c["r"], F.col("n"), F.col("r")))
    with_centre = with_centre.select(c["id"].alias("a"), c["n"].alias("na"), F.col("id").alias("b"), F.col("n").alias("nb")).distinct()
    hopeful = with_centre.join(of(sketches, "a"), "a").join(of(sketches, "b"), "b").where(may_be_alike())
    first = stored(hopeful.select("a", "na", "b", "nb"))
    links = stored(linked(first))
    found = components(links).withColumnRenamed("node", "id")
    placed = keyed.join(found, "id", "left").select("sig", "band", "id", "n", "r", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("sig", "band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("sig", "band")
    placed = stored(placed.join(mixed, ["sig", "band"]))
    discard(keyed)
    release(spark)
    sketched = placed.join(sketches, "id")
    meet = may_meet(F.col("na"), F.col("ra"), F.col("nb"), F.col("rb")) & may_be_alike()
    rest = of(sketched, "a").withColumnsRenamed({"siga": "sig", "banda": "band"}).join(of(sketched, "b").withColumnsRenamed({"sigb": "sig", "bandb": "band"}), ["sig", "band"])
    rest = rest.where("a < b and ca <> cb").where(meet).select("a", "na", "b", "nb").distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    found = components(links.union(linked(rest)))
    joined = names.join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    # a fingerprint that neither another row nor a near one has needs no name: its class is its row's id
    out = stored(joined.where("several or component is not null").select("n", "d1", "d2", F.coalesce("component", "id").alias("class_id")))
    discard(placed, first, links, *spent)
    return out


def with_classes(rows: DataFrame, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``class_id`` to rows with ``key`` and ``sigs``: that of their fingerprint, or their own id where it has none."""
    few = names.count() <= BROADCAST_NAMES
    told = rows.select("*", *_digests("sigs"))
    keys = ["n", "d1", "d2"]
    told = told.join(F.broadcast(names), keys, "left") if few else _beside(told, names, keys, F.hash(key), "left")
    return told.withColumn("class_id", F.coalesce("class_id", key)).drop(*keys)


def near_classes(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, class_id), a row per row of prints (id long, sigs array<int>); see ``class_names``.

    Rows without an id have the class of an equal fingerprint, or none.
    """
    return with_classes(prints.select("id", "sigs"), class_names(prints, threshold), "id").select("id", "class_id")


def _beside(rows: DataFrame, few: DataFrame, keys: list[str], by: Column, how: str) -> DataFrame:
    """Rows with the columns of the one row of ``few`` that has their keys, in salts, so that a hot key is many tasks."""
    salts = salt_count(rows.sparkSession)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(by, F.lit(salts))).join(salted, [*keys, "_salt"], how).drop("_salt")


def _successors(texts: DataFrame) -> DataFrame:
    """doc_id, prev_id, prev_len for every distinct doc_id, in a ring in ascending order, a null last; prev_len: its longest text.

    Only ids and lengths are sorted; the texts stay where they are. The ends of the sorted parts, one row a part, meet
    in one task.
    """
    last = F.col("doc_id").asc_nulls_last()
    ids = texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("len"))
    parted = stored(ids.repartitionByRange(last).select("doc_id", "len", F.spark_partition_id().alias("part")))
    ends = parted.groupBy("part").agg(F.max(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "len")).alias("last"))
    over = W.orderBy("part")
    total = ends.agg(F.max_by("last", "part").alias("wrap"))
    edge = ends.select("part", F.lag("last").over(over).alias("edge"))
    lagged = parted.withColumn("p", F.lag(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "len")).over(W.partitionBy("part").orderBy(last)))
    joined = lagged.join(F.broadcast(edge), "part").join(F.broadcast(total))  # a row a part, and one row
    prev = F.coalesce("p", "edge", "wrap")
    return joined.select("doc_id", prev["doc_id"].alias("prev_id"), prev["len"].alias("prev_len"))


def _keyed(name: str, prefix: str = "") -> list[Column]:
    """A key that is never null, so that joins, windows and shuffles on it can share a partitioning."""
    return [F.coalesce(name, F.lit(0).cast("long")).alias(f"{prefix}k"), F.isnull(name).alias(f"{prefix}none")]


def fingerprint_documents(docs: DataFrame, common: Common | None = None, threshold: float = 0.8) -> DataFrame:
    """Fingerprints of every text and of its edited text, how alike they and the next document's are, and classes.

    Edited: the last quarter of the code points is replaced by as many from the start of the next document. Null texts
    are empty. Rows with a null doc_id are one document, that after all others. Where a doc_id is repeated, every row
    has its fingerprint, and the document that comes next is the row of the next doc_id with the smallest text hash. Two
    empty fingerprints are 1 alike. class_id is the smallest doc_id that a text's fingerprint reaches by likeness of
    ``threshold`` or more (``class_names``). Common words are those of the table where ``common`` gives none.

    A text and its signatures go through one shuffle, by doc_id; both joins start from it, and what moves on to the
    document before is no more than the start of the text.
    """
    spark = docs.sparkSession
    common = common or common_words(docs)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = _successors(texts).select(*_keyed("doc_id"), *_keyed("prev_id", "p"), "prev_len")
    signed = with_signatures(texts.select(*_keyed("doc_id"), "text"), "text", "sigs", common)
    heads = signed.hint("merge").join(near.hint("merge"), ["k", "none"])
    heads = heads.select(F.col("pk").alias("k"), F.col("pnone").alias("none"), F.xxhash64("text").alias("th"), F.expr("left(text, int(prev_len div 4))").alias("head"), F.col("sigs").alias("next_sigs"))
    # of several rows of the next document the one with the smallest text hash
    heads = heads.withColumn("_r", F.row_number().over(W.partitionBy("k", "none").orderBy("th"))).where("_r = 1").drop("_r", "th")
    n = F.length("text")
    cut = F.expr("int(length(text) div 4)")
    both = (
        signed.hint("merge").join(heads.hint("merge"), ["k", "none"])
        .withColumn("n_chars", n.cast("long"))
        .withColumn("edited", F.concat(F.left("text", n - cut), F.left("head", cut)))
    )
    both = with_signatures(both, "edited", "edited_sigs", common)
    rows = stored(
        both.select(
            F.when(~F.col("none"), F.col("k")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sigs",
            F.array_except("sigs", "edited_sigs").alias("gone"), F.array_except("edited_sigs", "sigs").alias("come"),
            likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        )
    )
    release(spark)
    told = with_classes(rows, class_names(rows.select(F.col("doc_id").alias("id"), "sigs"), threshold))
    release(spark)
    # most signatures outlive the edit, so only the differences are stored
    edited = F.array_sort(F.array_union(F.array_except("sigs", "gone"), "come"))
    prints = [as_text(F.col("sigs")).alias("fingerprint"), as_text(edited).alias("edited_fingerprint")]
    return told.select("doc_id", "n_chars", "edited_sha256", *prints, "near_edited", "near_next", "class_id")
