"""Document fingerprints: a Merkle tree over slices, paragraphs and sections.

A text's lines are its paragraphs, cut into leaves of a few characters; runs of paragraphs are
sections. A node's hash covers its children's, and the root is the fingerprint: equal roots mean equal
texts, and where roots differ, only differing branches are descended to find the edit. The share
of leaves in common is how alike two texts are. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwise.llm.ordering import in_order, with_ranks
from siftwise.llm.scratch import Scratch

#: Code points of a leaf, paragraphs of a section.
LEAF_CHARS, SECTION_PARAGRAPHS = 16, 16
#: Rows of one window partition, for tables up to SCALE_ROWS; beyond, its square root's share more.
BUCKET_ROWS, SCALE_ROWS = 2_000, 10_000_000


def leaf_hashes(text: Column) -> Column:
    """An array of leaf hashes for each paragraph."""
    cut = rf"([\s\S]{{1,{LEAF_CHARS}}})"
    return F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(cut), 1), lambda s: F.xxhash64(s)))


def _node_hash(children: Column) -> Column:
    """128 bits over the children's hashes in order, so equal nodes mean equal branches."""
    return F.md5(F.array_join(children, ",").cast("binary"))


def paragraph_hashes(leaves: Column) -> Column:
    return F.transform(leaves, lambda p: _node_hash(F.transform(p, lambda h: h.cast("string"))))


def section_hashes(paragraphs: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(paragraphs), F.lit(SECTION_PARAGRAPHS))
    return F.transform(starts, lambda i: _node_hash(F.slice(paragraphs, i, SECTION_PARAGRAPHS)))


def root_hash(sections: Column, paragraphs: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.size(paragraphs).cast("string"), F.array_join(sections, ",")), 256)


def with_tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds <prefix>leaves, <prefix>paragraphs, <prefix>sections and <prefix>root of a text that is not null."""
    return (
        df.withColumn(f"{prefix}leaves", leaf_hashes(F.col(text)))
        .withColumn(f"{prefix}paragraphs", paragraph_hashes(F.col(f"{prefix}leaves")))
        .withColumn(f"{prefix}sections", section_hashes(F.col(f"{prefix}paragraphs")))
        .withColumn(f"{prefix}root", root_hash(F.col(f"{prefix}sections"), F.col(f"{prefix}paragraphs")))
    )


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 for equal roots, else the share of common leaves among the larger tree's, below 1."""
    most = F.greatest(F.size(F.array_distinct(leaves_a)), F.size(F.array_distinct(leaves_b)))
    common = F.size(F.array_intersect(leaves_a, leaves_b))
    share = F.when(most > 0, F.least(common / most, 1 - F.lit(0.5) / most)).otherwise(F.lit(0.0))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(share)


def differing_paragraphs(a: str = "", b: str = "edited_") -> Column:
    """Numbers of paragraphs that differ between two trees of a row: equal roots end it, and only
    differing sections are descended."""

    def within(section: Column) -> Column:
        first = (section * SECTION_PARAGRAPHS + 1).cast("int")
        most = F.greatest(F.size(f"{a}paragraphs"), F.size(f"{b}paragraphs"))
        numbers = F.sequence(first, F.least(first + SECTION_PARAGRAPHS - 1, most))
        return F.filter(numbers, lambda i: ~F.try_element_at(F.col(f"{a}paragraphs"), i).eqNullSafe(F.try_element_at(F.col(f"{b}paragraphs"), i)))

    sections = F.sequence(F.lit(0), F.greatest(F.size(f"{a}sections"), F.size(f"{b}sections")) - 1)
    unequal = F.filter(sections, lambda i: ~F.try_element_at(F.col(f"{a}sections"), i + 1).eqNullSafe(F.try_element_at(F.col(f"{b}sections"), i + 1)))
    none = F.array().cast("array<int>")
    return F.when(F.col(f"{a}root") == F.col(f"{b}root"), none).otherwise(
        F.transform(F.flatten(F.transform(unequal, within)), lambda i: i - 1)
    )


def _count_below(every: Column, coarse: Column, step: int, value: Column) -> Column:
    """How many of the sorted bounds are at most value, in two steps of about the square root of their number; coarse has each step-th bound."""
    whole = F.size(F.filter(coarse, lambda c: c <= value)) * step
    return whole + F.size(F.filter(F.sequence(whole, whole + step - 1), lambda i: F.coalesce(F.get(every, i) <= value, F.lit(False))))


def with_next(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """doc_id, text (null: empty), copies, its tree, and text, leaves and root of the next document: one row for all those equal in doc_id and text. Then, whether any were.

    Documents are in order of doc_id, null first, then a hash of the text; after the last comes the first. Ranges of
    equal numbers of documents are windows of their own, whatever their doc_ids; a range's first document is also put at the end
    of the range before it, so texts are shuffled once. The ranges' bounds are read by a subquery: the plan's text does not grow with them.
    """
    key = ["doc_id", "_hash"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_hash"))
    slim = scratch.save(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")))
    repeated = scratch.save(slim.filter("copies > 1").select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_of"), "copies"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of"))
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    repeats = bool(repeated.limit(1).count())
    if repeats:
        # equal rows are brought together by a map-side combined aggregate and treated once
        one = rows.drop("copies").join(repeated, same).drop("_id", "_of").dropDuplicates(key)
        rows = rows.join(repeated, same, "left_anti").unionByName(one)
    count = slim.count()
    per = int(BUCKET_ROWS * max(1.0, math.sqrt(count / SCALE_ROWS)))
    n = max(1, -(-count // per))
    step = max(1, math.isqrt(n))
    ranked = with_ranks(in_order(slim, scratch, *key), [], "_rank").filter(F.col("_rank") % per == 0)
    bounds = ranked.agg(F.array_sort(F.collect_list(F.struct(*key))).alias("every"))  # as many as there are ranges
    bounds = bounds.select("every", F.filter("every", lambda _, i: i % step == step - 1).alias("coarse"))
    bounds = scratch.save(bounds)
    dealt = rows.withColumn("_every", bounds.select("every").scalar()).withColumn("_coarse", bounds.select("coarse").scalar())
    # no document is below the first bound, which is the first of all
    own = _count_below(F.col("_every"), F.col("_coarse"), step, F.struct(*key)) - 1
    dealt = dealt.withColumn("_bucket", own.cast("int"))
    first = F.get("_every", F.col("_bucket")) == F.struct(*key)
    here = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("late")))
    back = F.array(F.struct(((F.col("_bucket") + n - 1) % n).cast("int").alias("b"), F.lit(1).alias("late")))
    dealt = (
        dealt.withColumn("_to", F.explode(F.when(first, F.concat(here, back)).otherwise(here)))
        .select("doc_id", "_hash", "text", "copies", F.col("_to.b").alias("_bucket"), F.col("_to.late").alias("_late"))
        .repartition("_bucket")
    )
    treed = with_tree(dealt, "text").withColumn("leaves", F.flatten("leaves"))
    order = Window.partitionBy("_bucket").orderBy("_late", "doc_id", "_hash")
    placed = (
        treed.select("doc_id", "_hash", "text", "copies", "_bucket", "_late", "leaves", "paragraphs", "sections", "root")
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_leaves", F.lead("leaves").over(order))
        .withColumn("next_root", F.lead("root").over(order))
        .filter("_late = 0")
        .drop("_bucket", "_late", "_hash")
    )
    return placed, repeats


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_edited_paragraphs.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones, or all, of the
    next document's. A null text counts as empty; null doc_ids come first in order; equal doc_ids
    are ordered by a hash of their texts, and of rows equal in both each but the last is followed by its like; of one document alone, it is its own
    next; a very long text is one tree; an empty table gives no rows; other columns are not read.
    """
    rows, repeats = with_next(docs, Scratch(docs.sparkSession, "merkle"))
    if not repeats:
        return _fingerprints(rows)
    alike = rows.filter("copies > 1")
    alike = alike.select(*[c for c in rows.columns if c not in ("copies", "next_text", "next_leaves", "next_root")], (F.col("copies") - 1).alias("copies"), F.col("text").alias("next_text"), F.col("leaves").alias("next_leaves"), F.col("root").alias("next_root"))
    alike = _fingerprints(alike, "copies").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("_copy", "copies")
    return _fingerprints(rows).unionByName(alike)


def _fingerprints(rows: DataFrame, *also: str) -> DataFrame:
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    return with_tree(rows, "edited", "edited_").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("leaves"), F.col("edited_root"), F.flatten("edited_leaves")).alias("near_edited"),
        likeness(F.col("root"), F.col("leaves"), F.col("next_root"), F.col("next_leaves")).alias("near_next"),
        F.size(differing_paragraphs()).alias("n_edited_paragraphs"),
        *also,
    )
