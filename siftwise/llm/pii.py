"""Information-theoretic sanitisation of personal data.

Personal data is found by pattern. The values found are the protected entities; words
near them are terms. Over the whole corpus, the documents in which a term stands near an entity
against all documents with the term estimate P(entity | term), how strongly the term reveals the
entity. Terms above a disclosure threshold are generalised, above a second one removed,
wherever they stand. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwise.llm.ordering import field, packed, unpacked
from siftwise.llm.scratch import Scratch

# The kinds in order, with their patterns. Quantifiers are possessive and a look-behind
# bars starts inside a run, which changes no match: it keeps long runs linear.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text has if it holds a kind; cheap, and asked first.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: A term is any word, of whatever length: letters, digits and marks.
IN_WORD = r"[\p{L}\p{M}\p{N}]"
TERM = rf"({IN_WORD}++)"
#: Words on either side of an entity, and code points looked at for them; words cut by that bound are left out.
NEAR_WORDS, NEAR_CHARS = 5, 80
#: Code points of the parts in which a text with findings is looked at.
CHUNK = 128
#: Distinct surroundings in which a term must stand near one entity; shares of its documents.
MIN_SUPPORT, GENERALISE, REMOVE = 3, 0.5, 0.9
#: Terms up to which a list of them is broadcast; a longer list is joined by shuffle.
BROADCAST_TERMS = 20_000

SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


def _octet_range() -> str:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return rf"^{part}(?:\.{part}){{3}}$"


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        return value.rlike(_octet_range())
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _doubled(values: Column, both) -> Column:
    """Running totals of an array under an associative function, by doubling: log n passes over n elements."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda step: step < F.size(values))

    def add(state: Column, step: Column) -> Column:
        earlier = lambda i: F.get(state, F.when(i >= step, i - step))
        return F.transform(state, lambda x, i: F.coalesce(both(x, earlier(i)), x))

    return F.aggregate(steps, values, add)


def _located(text: Column, pattern: Column | str, number: int) -> Column:
    """All matches with their places: what stands between matches tells where each begins."""
    regex = pattern if isinstance(pattern, Column) else F.lit(pattern)
    gaps = F.transform(F.split(text, regex, -1), lambda g: F.length(g))
    values = F.regexp_extract_all(text, regex, 0)
    # gaps has one more element than values; the last pair has no value and is left out
    pairs = lambda v: F.zip_with(F.slice(gaps, F.lit(1), F.size(v)), v, lambda g, x: F.struct((g + F.length(x)).alias("step"), x.alias("v")))
    span = lambda p, end: F.struct(F.lit(number).alias("kind"), (end - F.length(p["v"])).alias("start"), end.alias("end"), p["v"].alias("value"))
    ends = lambda ps: _let(F.transform(ps, lambda p: p["step"]), lambda n: _doubled(n, lambda x, y: x + y))
    return _let(_let(values, pairs), lambda ps: F.zip_with(ps, ends(ps), span))


def _chunks(text: Column) -> Column:
    """The text in parts of CHUNK code points, so that a place deep in it is reached at once."""
    return F.regexp_extract_all(text, F.lit(rf"([\s\S]{{1,{CHUNK}}})"), 1)


def _cut(chunks: Column, begin: Column, end: Column) -> Column:
    """Code points begin to end of a text given by its chunks; at a cost of what is cut, wherever that stands."""
    first = F.floor(begin / CHUNK).cast("int")
    last = F.floor((end - 1) / CHUNK).cast("int")
    # not slice(), which copies the whole array
    whole = F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(chunks, i)), "")
    return F.when(end > begin, F.substring(whole, begin - first * CHUNK + 1, end - begin)).otherwise("")


def _of_kind(text: Column, number: int) -> Column:
    kind = KINDS[number]
    return F.filter(_located(text, PATTERNS[kind], number), lambda s: _passes(kind, s))


def base_spans(text: Column) -> Column:
    """Spans of all kinds in order of kind, then start, of a text that is not null."""
    found = []
    for i, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
        found.append(F.when(hint, _of_kind(text, i)).otherwise(F.array().cast(SPANS)))
    return F.concat(*found)


def _terms_near(chunks: Column, length: Column, span: Column) -> Column:
    """Terms among the words next to a span, in order."""
    whole = rf"^{IN_WORD}++"
    # one code point more tells whether the bound cuts a word
    left = _cut(chunks, F.greatest(span["start"] - NEAR_CHARS - 1, F.lit(0)), span["start"])
    right = _cut(chunks, span["end"], F.least(span["end"] + NEAR_CHARS + 1, length))
    left = F.when(span["start"] > NEAR_CHARS, F.regexp_replace(F.regexp_replace(left, whole, ""), rf"^[^\p{{L}}\p{{M}}\p{{N}}]", "")).otherwise(left)
    right = F.when(span["end"] + NEAR_CHARS < length, F.regexp_replace(right, rf"(?<!{IN_WORD}){IN_WORD}++$", "")).otherwise(right)
    before = F.regexp_extract_all(F.lower(left), F.lit(TERM), 1)
    after = F.regexp_extract_all(F.lower(right), F.lit(TERM), 1)
    before = _let(before, lambda b: F.slice(b, F.greatest(F.size(b) - NEAR_WORDS, F.lit(0)) + 1, F.lit(NEAR_WORDS)))
    return F.concat(before, F.slice(after, 1, NEAR_WORDS))


def _listed(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows (with column term) joined with a table of distinct terms."""
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return rows.join(F.broadcast(terms) if few else terms, "term")


def disclosing_terms(found: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """From stored spans and their surroundings, and all documents: term, share and action.

    A term counts once for each document (row) that has it near an entity, in however many surroundings. Copies
    of a text are one surrounding each, so copying alone supports no term.
    """
    # no entity and no term holds a line break
    met = lambda n: F.transform(F.array_distinct(n["terms"]), lambda t: F.concat(n["entity"], F.lit("\n"), t))
    once = found.select(F.explode(F.array_distinct(F.flatten(F.transform("near", met)))).alias("pair"))
    each = found.select(F.explode("near").alias("n")).select(F.explode(met(F.col("n"))).alias("pair"), F.xxhash64("n.terms").alias("around"))
    # first by surroundings: a map-side combined count, however often a passage was copied
    support = each.groupBy("pair", "around").count().groupBy("pair").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= MIN_SUPPORT)
    with_entity = once.groupBy("pair").agg(F.count(F.lit(1)).alias("with_entity")).join(support, "pair")
    with_entity = with_entity.withColumn("term", F.substring_index("pair", "\n", -1))
    with_entity = scratch.save(with_entity.groupBy("term").agg(F.max("with_entity").alias("with_entity")))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), 1))).alias("term"))
    # counted before the join, so that what is joined is a vocabulary and not all its occurrences
    counts = _listed(words.groupBy("term").agg(F.count(F.lit(1)).alias("documents")), with_entity)
    share = F.col("with_entity") / F.col("documents")
    action = F.when(share >= REMOVE, "remove").otherwise("generalise")
    return scratch.save(counts.filter(share >= GENERALISE).select("term", share.alias("share"), action.alias("action")))


def _with_spans(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash and base spans of all rows; doc_id, text_hash and term spans where there are any."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    entity = lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"]))
    # the text's chunks and its length
    near = lambda t: F.transform("spans", lambda s: F.struct(entity(s).alias("entity"), _terms_near(t["chunks"], t["size"], s).alias("terms")))
    told = F.struct(_chunks(F.col("text")).alias("chunks"), F.length("text").alias("size"))
    none = F.array().cast("array<struct<entity:string,terms:array<string>>>")
    slim = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = (
        text.withColumn("spans", base_spans(F.col("text")))
        .withColumn("near", F.when(F.size("spans") > 0, _let(told, near)).otherwise(none))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), slim.alias("spans"), "near")
    )
    found = scratch.save(found)
    terms = disclosing_terms(found, text, scratch)
    sizes = lambda ls: _let(F.transform(ls, lambda x: F.length(x) + 1), lambda n: _doubled(n, lambda x, y: x + y))
    offset = _let(F.split("text", "\n"), lambda ls: F.zip_with(ls, sizes(ls), lambda x, end: F.struct((end - F.length(x) - 1).alias("at"), x.alias("line"))))
    lines = text.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(offset).alias("x"))
    words = lines.select("doc_id", "text_hash", "x", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("x.line"), F.lit(TERM), 1))).alias("term"))
    hit = _listed(words, terms)
    pattern = F.concat(F.lit(rf"(?iu)(?<!{IN_WORD})"), F.col("term"), F.lit(rf"(?!{IN_WORD})"))
    places = hit.select("doc_id", "text_hash", "action", F.col("x.at").alias("at"), F.explode(_located(F.col("x.line"), pattern, len(KINDS))).alias("s"))
    span = F.struct(F.lit(len(KINDS)).alias("kind"), (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"), "action")
    hits = places.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(span)).alias("term_spans"))
    return found.drop("near"), hits


def _joined(found: DataFrame, hits: DataFrame) -> DataFrame:
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "term_spans")
    return found.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")


def _listing(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_found (spans of all kinds).

    Places count code points, ends exclusive. A null text counts as empty, with no spans (an empty list,
    whose hash is that of the empty string); null doc_ids and repeated rows are rows like any other; a very long text, or
    one of very many spans, is searched as a whole, in time n log n; an empty table gives no rows; columns besides doc_id and text are not read.
    """
    found, hits = _with_spans(docs, Scratch(docs.sparkSession, "pii"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    terms = F.transform(F.coalesce("term_spans", F.array().cast("array<struct<kind:int,start:int,end:int,action:string>>")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return _joined(found, hits).select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listing(F.col("spans")), 256).alias("base_sha256"),
        _listing(F.concat("spans", terms)).alias("spans"),
        F.size(terms).cast("long").alias("n_term"),
        (F.size("spans") + F.size(terms)).cast("long").alias("n_found"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """Documents without what was found: personal data gives way to its kind in brackets, terms to [TERM] or
    to nothing. n_chars follows the text. Columns are those of docs, whatever their names.

    Of overlapping spans the first is replaced and the rest of the others dropped. A null text stays null; null doc_ids and repeated rows are
    rows like any other; a very long text is rewritten as a whole, in time n log n; an empty table gives no rows.
    """
    found, hits = _with_spans(docs, Scratch(docs.sparkSession, "sanitise"))
    name = lambda s: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"] + 1)
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), name(s).alias("to")))
    other = F.transform(
        F.coalesce("term_spans", F.array().cast("array<struct<kind:int,start:int,end:int,action:string>>")),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("to")),
    )
    edits = _joined(found, hits).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), F.sort_array(F.concat(base, other)).alias("_edits"))
    edits = edits.filter(F.size("_edits") > 0).dropDuplicates(["_doc", "_text"])
    text = field("text")

    def rewritten(chunks: Column) -> Column:
        covered = _let(F.transform("_edits", lambda e: e["end"]), lambda ends: _doubled(ends, lambda x, y: F.greatest(x, y)))

        def kept(done: Column) -> Column:
            at = lambda i: F.coalesce(F.get(done, F.when(i > 0, i - 1)), F.lit(0))
            # an edit inside an earlier one has nothing left to replace
            pieces = F.transform("_edits", lambda e, i: F.concat(_cut(chunks, at(i), F.greatest(e["start"], at(i))), F.when(e["start"] >= at(i), e["to"]).otherwise("")))
            return F.concat(F.array_join(pieces, ""), _cut(chunks, F.element_at(done, -1), F.length(text)))

        return _let(covered, kept)

    clean = F.when(F.col("_edits").isNull(), text).otherwise(_let(_chunks(text), rewritten))
    same = field("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_text"))
    joined = packed(docs).join(edits, same, "left").withColumn("_clean", clean)
    values = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length("_clean").cast(docs.schema["n_chars"].dataType)
    return unpacked(joined, docs.columns, **values)


def no_personal_data(text: Column) -> Column:
    """Whether no base kind is left in a text; for audits."""
    return reduce(lambda a, b: a & b, [F.size(_of_kind(text, i)) == 0 for i in range(len(KINDS))])
