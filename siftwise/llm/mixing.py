"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1, given by its values at equally
spaced knots and linear between them. The integral of the schedule, scaled to the source's
target, is the source's cumulative token demand. A document holds a span of its source's
tokens; the inverse of the cumulative demand at the span's start is the document's training
position. Documents are range-sorted by position.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwise.llm.ordering import field, in_order, unpacked, with_ranks
from siftwise.llm.scratch import Scratch

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix over words of all documents, and the most that a source gives over its own.
SHARE, MOST = 1.5, 2.0
#: Schedules that go with WEIGHTS: early, level, late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: White space is fixed: the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shuffle_hash() -> Column:
    """A document's place in its source: a hash of its id and text, in hexadecimal digits."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))


def source_targets(sizes: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From stored source and source_size: weight_no and target.

    A target is least(most * source_size, level * weight), with the one level at which the
    targets sum up to share times all sizes. Sources are numbered and summed up by range sorts, so there
    may be as many as there are documents.
    """
    named = with_ranks(in_order(sizes, scratch, F.col("source").isNull(), "source"), [], "weight_no")
    named = (
        named.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("weight_no") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
    )
    named = scratch.save(named)
    words, open_ = named.agg(F.sum("source_size"), F.sum("weight")).first()
    # the first source in order of ratio that its share does not fill sets the level
    rows = with_ranks(in_order(named, scratch, "_ratio", "weight_no"), [], "_turn", _capped="_cap", _closed="weight")
    level = (F.lit(float(words or 0)) * F.lit(float(share)) - F.col("_capped")) / (F.lit(float(open_ or 0)) - F.col("_closed"))
    rows = rows.select(level.alias("level"), "_turn", "_ratio").filter("level <= _ratio")
    found = rows.agg(F.min_by("level", "_turn")).first()[0]
    target = F.col("_cap") if found is None else F.least("_cap", F.lit(found) * F.col("weight"))
    return named.select("source", "source_size", "weight_no", target.alias("target"))


def demand_inverse(done: Column, schedule: Sequence[float]) -> Column:
    """The time at which the integral of the schedule reaches a share `done` of its whole."""
    steps = len(schedule) - 1
    areas = [(a + b) / 2 / steps for a, b in zip(schedule, schedule[1:], strict=False)]
    total, at, found = sum(areas), 0.0, None
    for k, area in enumerate(areas):
        a, slope = schedule[k], (schedule[k + 1] - schedule[k]) * steps
        need = F.greatest(done * F.lit(total) - F.lit(at), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(a * a) + need * F.lit(2 * slope), F.lit(0.0)))
        here = F.least(F.lit(k / steps) + need * 2 / (F.lit(a) + root), F.lit((k + 1) / steps))
        at += area
        found = F.when(done * F.lit(total) <= F.lit(at), here) if found is None else found.when(done * F.lit(total) <= F.lit(at), here)
    return found.otherwise(F.lit(1.0))


def mix_documents(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """Returns doc_id, source, size, source_size, target, taken, position, repeat_position.

    taken counts words, repeats included: a source's documents lie one after another in hash
    order, pass after pass, until its target is reached; the last one taken is taken in part.
    position and repeat_position (null: no such turn) are training times from 0 to 1 of the first and
    the second turn; with most above 2 there are later ones, which taken_documents() gives. A null text or
    one without words has size 0 and is never taken; a null source is a
    source; ties in hash order are rows with equal doc_id and text, which may change places; a text of any length is
    counted as a whole; an empty table gives no rows; columns of docs besides doc_id, text and source are not read.
    Rows are sorted by position, those without one last.
    """
    mixed = _mixed(docs, Scratch(docs.sparkSession, "mix"), weights, schedules, share, most)
    at = F.col("positions")
    mixed = mixed.select("doc_id", "source", "size", "source_size", "target", "taken", at[0].alias("position"), (at[1] if most > 1 else F.lit(None).cast("double")).alias("repeat_position"))
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _mixed(docs: DataFrame, scratch: Scratch, weights: Sequence[float], schedules: Sequence[Sequence[float]], share: float, most: float) -> DataFrame:
    """A row for each document, in any order: what mix_documents() tells, _hash, and, for each of the ceil(most) turns, the words
    taken (pieces) and the training time (positions; null: no such turn)."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_hash().alias("_hash"))
    slim = scratch.save(slim)
    sizes = scratch.save(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = scratch.save(source_targets(sizes, scratch, weights, share, most).withColumnRenamed("source", "_source"))
    placed = with_ranks(in_order(slim, scratch, "source", "_hash", "doc_id"), ["source"], "_turn", _at="size")
    whole = F.least(F.round("target").cast("long"), (F.col("source_size") * F.lit(most)).cast("long"))
    turns = range(math.ceil(most))
    pieces = [F.greatest(F.least(F.col("_whole") - F.col("source_size") * e - F.col("_at"), F.col("size")), F.lit(0)) for e in turns]

    def position(turn: int) -> Column:
        done = (F.col("_at") + F.col("source_size") * turn) / F.greatest(F.col("_whole"), F.lit(1)).cast("double")
        case = None
        for k, schedule in enumerate(schedules):
            here = F.col("weight_no") % len(schedules) == k
            case = F.when(here, demand_inverse(done, schedule)) if case is None else case.when(here, demand_inverse(done, schedule))
        return F.when(pieces[turn] > 0, case)

    return (
        placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_whole", whole)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            sum(pieces[1:], pieces[0]).cast("long").alias("taken"),
            F.array(*pieces).alias("pieces"),
            F.array(*[position(e) for e in turns]).alias("positions"),
            "_hash",
        )
    )


def taken_documents(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """The mix as documents: a row for each of the ceil(most) turns of a document, in the order of training.

    A turn taken in part has the first words of the text, white space between them kept, and
    n_chars accordingly. Columns are those of docs, whatever their names. Null and empty texts are never taken; null doc_ids and null
    sources are mixed like any other; repeated rows have their turns each; an empty table gives no rows; a very long text is cut only
    where its last turn ends.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    mixed = _mixed(docs, scratch, weights, schedules, share, most).filter("taken > 0")
    each = mixed.select("_hash", "size", F.explode(F.arrays_zip("pieces", "positions")).alias("t"))
    turns = each.filter("t.pieces > 0").select(F.col("_hash").alias("_of"), F.col("t.positions").alias("_at"), F.col("t.pieces").alias("_words"), (F.col("t.pieces") < F.col("size")).alias("_cut"))
    turns = scratch.save(turns)
    named = docs.select(F.struct("*").alias("_row"), shuffle_hash().alias("_doc"))
    # rows equal in doc_id and text have one hash and pool their turns: one of them serves all
    repeated = scratch.save(named.groupBy("_doc").count().filter("count > 1").select("_doc"))
    if repeated.limit(1).count():
        one = named.join(repeated, "_doc", "left_semi").dropDuplicates(["_doc"])
        named = named.join(repeated, "_doc", "left_anti").unionByName(one)
    joined = named.join(turns, F.col("_doc") == F.col("_of"))
    ordered = joined.repartitionByRange("_at", "_of").sortWithinPartitions("_at", "_of")
    pieces = F.regexp_extract_all(field("text"), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), 1)
    head = F.array_join(F.slice(pieces, 1, F.col("_words").cast("int")), "")
    cut = ordered.withColumn("_text", F.when(F.col("_cut"), head).otherwise(field("text")))
    values = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return unpacked(cut, docs.columns, **values)
