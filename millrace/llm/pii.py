"""Personal data, found and sanitised in DataFrame functions alone.

Base spans are e-mail addresses, IPv4 addresses, card numbers and telephone numbers, by pattern and check.
To these the method adds terms that disclose a protected entity. An entity is a base span's kind and
value; the terms of the documents it stands in (outside base spans) are counted over all documents, and
pointwise mutual information says how much of the entity's information a term gives away:

    disclosure(e, t) = log(N co(e, t) / (df(e) df(t))) / log(N / df(e))

with N documents, df over all of them and co the documents in which t stands together with e. It is 1 if t
never stands elsewhere. Terms with an entity in `SUPPORT` documents or more whose disclosure reaches `THRESHOLD`
are generalised wherever they stand, in any document; those that reach `REMOVED` are removed. The highest
disclosure of a term, over all entities, decides.

Defined cases: null texts are empty and have no spans; each row is a document, so repeated rows count each
in the statistics and get a row each; spans of different kinds may overlap (a sanitised text merges them); positions are code
points; without an entity in `SUPPORT` documents nothing is added; other columns are left alone.

Patterns: possessive quantifiers, look-behinds and bounded groups keep them linear and off the stack on very long
texts; tests hold them against the plain patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?<=[A-Za-z0-9-])(?![A-Za-z0-9-]|\.[A-Za-z0-9-])",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
TERM = r"[\p{L}\p{N}_]{3,}+"
APART = r"[^\p{L}\p{N}_]+"
SUPPORT = 3
THRESHOLD, REMOVED = 0.9, 0.999
#: Candidate terms that are broadcast at most (about 40 MB); beyond, all words are counted first and joined then.
BROADCAST_TERMS = 500_000
BLOCK = 64
#: Characters of a text that are cut out of it at once; spans that each word is held against one by one at most (more are put in order).
CUT, FEW = 4096, 8
FAR = (1 << 31) - 1
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _larger(a: Column, x: Column) -> Column:
    return F.greatest(a, x)


def _running(d: Column, add: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """Sums (or the like, of integers from 0 on) of the first 1, 2, ... elements, in blocks, so that long arrays cost no quadratic time."""
    zero = F.lit(0)
    whole = lambda k: F.floor(k / BLOCK).cast("int")
    blocks = lambda d: F.transform(F.sequence(zero, whole(F.size(d))), lambda b: F.aggregate(F.slice(d, b * BLOCK + 1, F.lit(BLOCK)), zero, add))
    before = lambda sums: F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), zero, add))
    sums = lambda d: let(let(blocks(d), before), lambda base: F.transform(d, lambda _, k: add(F.get(base, whole(k)), F.aggregate(F.slice(d, whole(k) * BLOCK + 1, k % BLOCK + 1), zero, add))))
    return let(d, sums)


def found(text: Column, pattern: str, kind: str) -> Column:
    """The matches of a pattern, leftmost and apart: kind, start, end, value."""
    none = F.array().cast(SPAN)

    def spans(m: Column) -> Column:
        between = F.split(text, pattern, -1)
        steps = lambda p: F.transform(p, lambda x, j: F.length(x) + F.coalesce(F.length(F.get(m, j - 1)), F.lit(0)))
        return let(let(let(between, steps), lambda d: _running(d)), lambda at: F.transform(m, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.get(at, i).alias("start"), (F.get(at, i) + F.length(x)).alias("end"), x.alias("value"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none))


def _luhn(value: Column) -> Column:
    def good(s: Column) -> Column:
        n = F.length(s)

        def digit(i: Column) -> Column:
            v = F.substr(s, n - i, F.lit(1)).cast("int") * (i % 2 + 1)
            return F.when(v > 9, v - 9).otherwise(v)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0

    return let(F.regexp_replace(value, "[^0-9]", ""), good)


def _valid(kind: str, s: Column) -> Column:
    value = s["value"]
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed, then by start."""

    def of(kind: str) -> Column:
        good = F.filter(found(text, PATTERNS[kind], kind), lambda s: _valid(kind, s))
        return F.when(F.contains(text, F.lit(NEEDS[kind])), good).otherwise(F.array().cast(SPAN)) if NEEDS[kind] else good

    return F.concat(*map(of, KINDS))


def _apart(words: Column, spans: Column) -> Column:
    """The words that no span touches. Words and many spans are put in one order, where the furthest end before a word and the nearest start behind it decide."""
    few = F.filter(words, lambda w: ~F.exists(spans, lambda o: (w["start"] < o["end"]) & (w["end"] > o["start"])))
    event = lambda x, kind, i: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), i.alias("i"))
    events = F.array_sort(F.concat(F.transform(spans, lambda s: event(s, 0, F.lit(-1))), F.transform(words, lambda w, i: event(w, 1, i))))

    def many(e: Column) -> Column:
        ends = _running(F.transform(e, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(0)), _larger)
        back = _running(F.reverse(F.transform(e, lambda x: F.when(x["kind"] == 0, FAR - x["start"]).otherwise(0))), _larger)  # starts, the nearest as the largest

        def untouched(before: Column, behind: Column) -> Column:
            good = F.filter(F.transform(e, lambda x, k: F.when((x["kind"] == 1) & (F.get(before, k) <= x["start"]) & (FAR - F.get(behind, k) >= x["end"]), x["i"])), lambda i: i.isNotNull())
            return F.transform(good, lambda i: F.get(words, i))

        return let(ends, lambda before: let(F.reverse(back), lambda behind: untouched(before, behind)))

    return F.when(F.size(spans) <= FEW, few).otherwise(let(events, many))


def _terms(text: Column, spans: Column) -> Column:
    """The distinct terms of a text outside its spans."""
    return F.array_distinct(F.transform(let(found(text, TERM, "term"), lambda words: _apart(words, spans)), lambda w: F.lower(w["value"])))


def _documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("tid", F.xxhash64("text"))


def detect(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, tid (hash of the text), base (spans), added (start, end, how), a row for each row; texts are read twice and never shuffled."""
    rows = _documents(docs)
    with_spans = rows.select("doc_id", "tid", "text", base_spans(F.col("text")).alias("base"))
    base = scratch.table(with_spans.select("doc_id", "tid", "base", F.when(F.size("base") > 0, _terms(F.col("text"), F.col("base"))).alias("terms")), "base")
    some = base.where(F.size("base") > 0)
    named = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    entities = some.select(F.explode_outer(named).alias("entity")).groupBy("entity").agg(F.count("*").alias("dfe")).where(F.col("dfe") >= SUPPORT)
    entities = scratch.table(entities, "entities")
    n = base.count()
    # Only entities of enough documents can have telling terms; their documents' terms are counted, each once.
    held = some.select(F.explode_outer(named).alias("entity"), "terms").join(entities, "entity")
    pairs = held.select("entity", "dfe", F.explode_outer("terms").alias("term")).groupBy("entity", "term", "dfe").agg(F.count("*").alias("co")).where(F.col("co") >= SUPPORT)
    # A term is in as many documents at least as hold it beside any entity; that alone rules out the common ones, exactly.
    least = some.select(F.explode_outer("terms").alias("term")).groupBy("term").agg(F.count("*").alias("least"))
    most = F.col("co") * F.pow(F.lit(float(n)) / F.col("dfe"), 1 - THRESHOLD) * (1 + 1e-9)
    pairs = scratch.table(pairs.join(least, "term").where(F.col("least") <= most).drop("least"), "pairs")
    terms = scratch.table(pairs.select("term").distinct(), "terms")
    # outer: the plain form would have the optimizer split each text once more, to test that the list is not empty
    words = rows.select(F.explode_outer(F.array_distinct(F.split(F.lower("text"), APART))).alias("term"))
    if terms.count() <= BROADCAST_TERMS:
        counted = words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("dft"))
    else:
        counted = words.groupBy("term").agg(F.count("*").alias("dft")).join(terms, "term", "left_semi")
    disclosure = F.log(F.lit(float(n)) * F.col("co") / (F.col("dfe") * F.col("dft"))) / F.log(F.lit(float(n)) / F.col("dfe"))
    telling = pairs.join(counted, "term").where(F.col("dfe") < n).withColumn("disclosure", disclosure).where(F.col("disclosure") >= THRESHOLD)
    how = F.when(F.max("disclosure") >= REMOVED, "removed").otherwise("general")
    telling = scratch.table(telling.groupBy("term").agg(how.alias("how")), "telling")
    spread = F.broadcast(telling) if telling.count() <= BROADCAST_TERMS else telling
    spans = rows.select("doc_id", "tid", F.explode_outer(found(F.col("text"), TERM, "term")).alias("w")).select("doc_id", "tid", F.lower("w.value").alias("term"), "w.start", "w.end")
    marked = spans.join(spread, "term").select("doc_id", "tid", "start", "end", "how").distinct()
    added = marked.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "how"))).alias("added"))
    added = scratch.table(added, "added")
    held = base.select("doc_id", "tid", "base").join(added.withColumnRenamed("doc_id", "d").withColumnRenamed("tid", "t"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")), "left")
    apart = _apart(F.coalesce("added", F.array().cast("array<struct<start:int,end:int,how:string>>")), F.col("base"))
    return held.select("doc_id", "tid", "base", apart.alias("added"))


def _merged(spans: Column) -> Column:
    """Sorted spans (start, end, label) as spans apart: overlapping ones become one, with the first label."""
    n = F.size(spans)

    def by(ends: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(ends, i - 1)))
        last = lambda heads, j: F.get(ends, F.coalesce(F.get(heads, j + 1), n) - 1)
        return let(heads, lambda hs: F.transform(hs, lambda h, j: F.struct(F.get(spans, h)["start"].alias("start"), last(hs, j).alias("end"), F.get(spans, h)["label"].alias("label"))))

    return let(_running(F.transform(spans, lambda s: s["end"]), _larger), by)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, label), sorted by start, replaced by its label; overlapping spans count as one, with the first label.

    Pieces between spans are put together from blocks of the text, as a place in a long text is found only by walking to it.
    """

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
        within = F.substr(F.get(blocks, first), a % CUT + 1, b - a)
        ahead = F.substr(F.get(blocks, first), a % CUT + 1, F.lit(CUT))
        tail = F.coalesce(F.substr(F.get(blocks, last), F.lit(1), b % CUT), F.lit(""))
        return F.when(a >= b, "").when(first == last, within).otherwise(F.concat(ahead, F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), tail))

    def build(m: Column, blocks: Column) -> Column:
        piece = lambda s, i: let(F.coalesce(F.get(m, i - 1)["end"], F.lit(0)), lambda a: F.concat(cut(blocks, a, s["start"]), s["label"]))
        return F.concat(F.array_join(F.transform(m, piece), ""), let(F.element_at(m, -1)["end"], lambda a: let(F.length(text), lambda b: cut(blocks, a, b))))

    whole = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(_merged(spans), lambda m: let(whole, lambda blocks: build(m, blocks))))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with sanitised texts (null stays null) and n_chars, if there, to match."""
    scratch = Scratch(docs.sparkSession, "pii")
    marks = detect(docs, scratch).where(F.size("added") > 0).select("doc_id", "tid", "added").dropDuplicates(["doc_id", "tid"])
    marks = scratch.table(marks, "marks")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    held = docs.join(marks, docs["doc_id"].cast("long").eqNullSafe(marks["doc_id"]) & (F.xxhash64(text) == marks["tid"]), "left")
    label = "array<struct<start:int,end:int,label:string>>"
    base = F.transform(base_spans(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
    extra = F.transform(marks["added"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["how"] == "removed", "").otherwise("[TERM]").alias("label")))
    spans = F.array_sort(F.concat(base, F.coalesce(extra, F.array().cast(label))))
    clean = F.when(docs["text"].isNotNull(), let(spans, lambda s: sanitised(text, s)))
    out = held.select(*(clean.alias("text") if c == "text" else docs[c] for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pii"))
    said = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("base", lambda s: said(s["kind"], s))
    added = F.transform("added", lambda s: said(F.lit("term"), s))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, added), ",").alias("spans"), F.size("added").cast("long").alias("n_term"))
