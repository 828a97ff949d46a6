"""Personal data, and terms that give it away, found with DataFrame functions only.

Base spans are e-mail and IP addresses, card and phone numbers. What they name is protected. How much a term near such a
span reveals of it is estimated from the corpus: the pointwise mutual information of term and entity, as a share of the
information the entity itself has,

    log2(N * n_both / (n_term * n_entity)) / log2(N / n_entity)

which is 1 for a term that occurs nowhere without the entity. In documents that hold the entity, terms from
``GENERALISE`` on become a general word, from ``REMOVE`` on they go. Counts are over all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmnet.llm.common import whole
from firmnet.storage import materialize

KINDS = ("email", "ip", "card", "phone")
TERMS = ("general", "removed")
NEAR = 60  # code points on either side of a span whose whole words count as near
SUPPORT = 3  # documents that hold the entity, and entity and term, at least
GENERALISE, REMOVE = 0.8, 0.95
TERM_LETTERS = 3
GENERAL_WORD = "[TERM]"

# The contract's patterns, written so that no start inside a run is tried again: linear on any text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SPAN = "array<struct<start:int,end:int,value:string>>"
_KINDED = "array<struct<kind:int,start:int,end:int>>"


BLOCK = 2048  # code points of a block of text that pieces are cut from
_RUN = 256  # numbers summed up at a time


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ahead(values: Column, add) -> Column:
    """For each of an array of numbers (0 and more), all before it put together by ``add``, 0 for the first.

    Arrays that grow number by number would be copied each time; runs of bounded length make that cheap: a run at a time, then
    over the runs, then within each run from there on.
    """
    none = F.array().cast("array<int>")
    step = lambda acc, v: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), add(acc["at"], v).alias("at"))
    walk = lambda own, first: F.aggregate(own, F.struct(none.alias("out"), first.cast("int").alias("at")), step, lambda acc: acc["out"])

    def within(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int")), lambda r: F.slice(v, r * _RUN + 1, _RUN))
        return _let(runs, lambda all_: F.flatten(F.zip_with(
            all_, walk(F.transform(all_, lambda own: F.aggregate(own, F.lit(0), add)), F.lit(0)), walk)))

    return F.when(F.size(values) > 0, _let(values, within)).otherwise(none)


def _placed(text: Column, pattern: Column, matches: Column) -> Column:
    """Matches with their place in code points: what stands between them comes from splitting at the same pattern."""
    sizes = lambda a: F.transform(a, lambda x: F.length(x))
    between = F.slice(sizes(F.split(text, pattern, -1)), 1, F.size(matches))
    both = F.struct(between.alias("gap"), sizes(matches).alias("own"))
    starts = _let(both, lambda b: F.zip_with(_ahead(F.zip_with(b["gap"], b["own"], lambda g, o: g + o), lambda x, y: x + y), b["gap"],
                                             lambda p, g: p + g))
    spans = F.zip_with(starts, matches, lambda at, m: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("value")))
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(_SPAN))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in blocks; only blocks that hold them are looked at."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    at = start - first * BLOCK
    joined = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substr(joined, at + 1, end - start)).otherwise(F.lit(""))


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    one = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, one(i)).otherwise(one(i) * 2 - F.when(one(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _holder(kind: str):
    return lambda span: _holds(kind, span["value"])


def base_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, spans_email, ..., near): spans of each kind, the key of the text, and the terms near each entity."""
    quick = {"email": F.col("_text").contains("@"), "phone": F.col("_text").contains("+")}
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("_text"))
    found = rows.select("doc_id", "_text", *(
        F.when(quick.get(k, F.lit(True)), F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"_{k}")
        for k, p in PATTERNS.items()))
    placed = found.select("doc_id", "_text", *(
        F.filter(_placed(F.col("_text"), F.lit(p), F.col(f"_{k}")), _holder(k)).alias(k) for k, p in PATTERNS.items()))
    entity = lambda k, parts: lambda s: F.struct(F.concat(F.lit(f"{k}:"), s["value"]).alias("entity"), _near(parts, s).alias("terms"))
    entities = F.when(F.size(F.concat(*KINDS)) > 0, _let(_blocks(F.col("_text")), lambda parts: F.concat(*(
        F.transform(k, entity(k, parts)) for k in KINDS)))).otherwise(F.array().cast("array<struct<entity:string,terms:array<string>>>"))
    told = placed.select("doc_id", F.md5(F.col("_text").cast("binary")).alias("key"), *KINDS, entities.alias("near"))
    return told.select("doc_id", "key", *(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS), "near")


def _near(blocks: Column, span: Column) -> Column:
    """Distinct words, lower-cased, that lie wholly within ``NEAR`` code points of a span of a text in blocks."""
    first = F.greatest(span["start"] - NEAR, F.lit(0))
    left = _piece(blocks, first, span["start"])
    left = F.when(first > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = _piece(blocks, span["end"], span["end"] + NEAR)
    right = F.when(F.length(right) == NEAR, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", left, right)), r"[^\p{L}]+"), lambda w: F.length(w) >= TERM_LETTERS))


def revealing_terms(docs: DataFrame, scanned: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, share): terms that reveal an entity of at least ``SUPPORT`` documents by ``GENERALISE`` or more.

    Only terms seen near an entity often enough are candidates; how often those occur is counted over the words of all
    documents, summed by a hash of the word before anything is shuffled.
    """
    near = scanned.where(F.size("near") > 0).select(F.posexplode("near").alias("_i", "n"), F.monotonically_increasing_id().alias("doc"))
    near = near.select("doc", F.col("n.entity").alias("entity"), F.col("n.terms").alias("terms"))
    entities = near.select("doc", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= SUPPORT)
    pairs = near.select("doc", "entity", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    pairs = materialize(pairs.where(F.col("n_both") >= SUPPORT).join(entities, "entity"), "pairs")
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(whole(text)), r"[^\p{L}]+"))).alias("w"))
    counted = words.select(F.xxhash64("w").alias("h")).groupBy("h").agg(F.count("*").alias("n_term"))
    terms = pairs.select("term").distinct().withColumn("h", F.xxhash64("term"))
    known = materialize(counted.join(terms, "h").select("term", "n_term"), "terms")
    n = docs.count()
    share = F.log2(F.lit(float(n)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / F.log2(F.lit(float(n)) / F.col("n_entity"))
    scored = pairs.join(known, "term").where(F.col("n_entity") < n).withColumn("share", share)
    return scored.where(F.col("share") >= GENERALISE).select("entity", "term", "share")


def term_spans(docs: DataFrame, scanned: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(key, general, removed): spans of revealing terms, in texts that hold the entity; one row for each such text."""
    held = scanned.where(F.size("near") > 0).select("key", F.explode("near.entity").alias("entity")).distinct()
    own = held.join(terms, "entity").groupBy("key", "term").agg(F.max("share").alias("share"))
    word = lambda low: F.array_sort(F.collect_set(F.when((F.col("share") >= REMOVE) == low, F.col("term"))))
    own = materialize(own.groupBy("key").agg(word(False).alias("general"), word(True).alias("removed")), "revealing")
    rows = docs.select(F.md5(whole(text).cast("binary")).alias("key"), whole(text).alias("_text")).join(own, "key")
    pattern = lambda k: F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(k, "|"), F.lit(r")(?!\p{L})"))
    some = lambda k: F.size(k) > 0
    none = F.array().cast("array<string>")
    rows = rows.select("key", "_text", *(pattern(k).alias(f"p_{k}") for k in TERMS), *(
        F.when(some(k), F.regexp_extract_all("_text", pattern(k), F.lit(0))).otherwise(none).alias(f"m_{k}") for k in TERMS))
    spans = rows.select("key", *(F.transform(_placed(F.col("_text"), F.col(f"p_{k}"), F.col(f"m_{k}")), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in TERMS))
    return spans.groupBy("key").agg(*(F.first(k).alias(k) for k in TERMS))  # equal texts have equal spans


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, email, ip, card, phone, general, removed): all spans of every document, by start.

    NULL text counts as empty; NULL and repeated ids are kept as they are, as all is keyed by the text.
    """
    scanned = materialize(base_spans(docs, doc_id, text), "spans")
    extra = materialize(term_spans(docs, scanned, revealing_terms(docs, scanned, text), text), "term-spans")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return scanned.join(extra, "key", "left").select("doc_id", "key", *KINDS, *(F.coalesce(k, empty).alias(k) for k in TERMS))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, comma-joined."""
    one = lambda k: lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"])
    return F.array_join(F.concat(*(F.transform(k, one(k)) for k in kinds)), ",")


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced: base ones by their kind in brackets, revealing terms by a general word or nothing.

    Where spans of several kinds overlap, the one that begins first (at one start the longer one, then the kind listed
    first) is replaced, and what of another sticks out behind it goes too. NULL text stays NULL.
    """
    word = {k: f"[{k.upper()}]" for k in KINDS} | {"general": GENERAL_WORD, "removed": ""}
    spans = find(docs, doc_id, text)
    one = lambda w: lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(w).alias("word"))
    every = F.array_sort(F.concat(*(F.transform(k, one(word[k])) for k in (*KINDS, *TERMS))))
    spans = spans.select("key", every.alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["key"])
    spans = materialize(spans.withColumnRenamed("key", "_key"), "replacements")
    packed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.md5(whole(text).cast("binary")).alias("_key"))
    both = packed.join(spans, "_key", "left")
    body = F.col("_row").getField(text)

    def replaced(parts: Column, of: Column) -> Column:
        """Text up to each span that begins behind all before it, and the span's word; then the text behind all spans."""
        until = _let(of, lambda all_: _ahead(F.transform(all_, lambda x: -x["back"]), lambda x, y: F.greatest(x, y)))
        end = F.array_max(F.transform(of, lambda x: -x["back"]))
        pieces = F.zip_with(until, of, lambda at, x: F.when(x["start"] >= at, F.concat(_piece(parts, at, x["start"]), x["word"])).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), _piece(parts, end, F.size(parts) * BLOCK))

    done = _let(_blocks(body), lambda parts: replaced(parts, F.col("_spans")))
    both = both.withColumn("_new", F.when(F.col("_spans").isNull() | body.isNull(), body).otherwise(done))
    new = {text: F.col("_new")} | ({n_chars: F.length("_new").cast("long")} if n_chars in docs.columns else {})
    return both.select(*(new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))
