"""PII by information-theoretic sanitisation, in DataFrame and SQL functions only.

Base patterns find protected entities (mail and IP addresses, card and phone numbers); secrets that a text assigns to a
name (token = "...") are protected too. The corpus then tells how strongly
words reveal an entity: for a term t and an entity e, counts of documents in which t stands near e, of all documents
with t, and of all documents with e give the disclosure P(e near t | t) and the information log2 P(e | t) / P(e). Terms beyond both
thresholds, seen in enough documents and in more than one context, are disclosing wherever they stand: they are spans
too, and sanitise() removes them and generalises the base entities to their kind.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import if_small, materialised, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that Java's matcher needs no recursion and no second scan of a run: a match may
#: begin only where a run begins (or where the last match ended), and runs are possessive. A card's pattern has its
#: 16 to 19 digits and ends where the run of digits ends; shorter and longer runs fail the contract's count anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests without which a pattern cannot match.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{14}", "phone": r"\+[0-9]"}
#: An assigned secret: 16 characters at least, one a digit.
SECRET = r"(?i)(?<![\p{L}\p{N}])(?:token|secret|password|passwd|api[_-]?key)[\x20]?[:=][\x20]?[\"']?(?=[A-Za-z+/_.=-]*+[0-9])[A-Za-z0-9+/_.=-]{16,}+[\"']?"
SECRET_HINT = r"(?i)(?:token|secret|passw|api[_-]?key)"
TERM = r"\p{L}[\p{L}\p{N}]{2,}"
#: Code points on either side of an entity whose words count as near it.
NEAR = 80
#: A term is disclosing from these values on.
LEAST_DISCLOSURE, LEAST_BITS, LEAST_DOCUMENTS, LEAST_CONTEXTS = 0.8, 3.0, 3, 2
BLOCK = 256


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return luhn(digits)
    return F.length(digits).between(8, 15)


def positions(text: Column, pattern: Column, keep) -> Column:
    """array<struct<start, end, match>> of a pattern's matches for which keep(match) holds, in code points.

    What stands between the matches (split) and the matches themselves give the offsets as running sums of lengths,
    summed block by block so that a text with very many matches costs no square of their number.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    count = F.size(steps)
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(count / BLOCK).cast("int") - 1), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    lengths = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, s: a + s.gap + F.length(s.match)))
    empty = F.array().cast("array<int>")
    offsets = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda a, n: F.struct((a.at + n).alias("at"), F.array_append(a.out, a.at).alias("out")), lambda a: a.out)
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def step(a: Column, s: Column) -> Column:
        start = a.at + s.gap
        end = start + F.length(s.match)
        span = F.struct(start.alias("start"), end.alias("end"), s.match.alias("match"))
        return F.struct(end.alias("at"), F.array_append(a.out, span).alias("out"))

    spans = F.flatten(F.zip_with(blocks, offsets, lambda x, o: F.aggregate(x, F.struct(o.alias("at"), none.alias("out")), step, lambda a: a.out)))
    return F.when(count > 0, F.filter(spans, lambda s: keep(s.match))).otherwise(none)


def of_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.match.alias("match")))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, match>>: by kind as listed, then by start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
    by_kind = []
    for kind in KINDS:
        found = positions(text, F.lit(PATTERNS[kind]), lambda m, kind=kind: passes(kind, m))
        by_kind.append(F.when(text.rlike(HINTS[kind]), of_kind(found, kind)).otherwise(none))
    return F.concat(*by_kind)


def contexts(documents: DataFrame) -> DataFrame:
    """(document, entity, context, term): the distinct words near each mention of an entity, lower-cased.

    Entities are a kind and the match without its punctuation and case; contexts a hash of the words around. Words that
    the window cuts are left out.
    """
    text = F.col("text")
    spans = documents.select("row", "text", F.explode(base_spans(text)).alias("span"))
    start, end = F.col("span.start"), F.col("span.end")
    first = F.greatest(start - NEAR, F.lit(0))
    before = F.regexp_replace(F.substring(text, first + 1, start - first), r"^[\p{L}\p{N}]++", "")
    before = F.when(first > 0, before).otherwise(F.substring(text, F.lit(1), start))
    after = F.substring(text, end + 1, F.lit(NEAR))
    after = F.when(F.length(after) == NEAR, F.regexp_replace(after, r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++$", "")).otherwise(after)
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat(before, F.lit(" \n "), after)), F.lit(TERM), F.lit(0)))
    entity = F.xxhash64(F.col("span.kind"), F.lower(F.regexp_replace(F.col("span.match"), r"[\x20()-]", "")))
    return spans.select("row", entity.alias("entity"), words.alias("words")).select("row", "entity", F.xxhash64("words").alias("context"), F.explode("words").alias("term"))


def row_key() -> Column:
    """One number for rows of equal doc_id and text: rows that only share an id, or have none, stay apart."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def disclosing_terms(documents: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(terms with their figures, (row, term) of all documents that hold one); None where no term can qualify.

    Counts run over all documents, rows of equal doc_id and text being one document. Of a term's entities that with the
    most documents near it counts, then the rarest. Candidates are terms near one entity in enough documents and
    contexts and, by the mentions alone, not too often near others; only they are counted in all texts. Their table is
    broadcast while it is small and joined by shuffling beyond.
    """
    rows = documents.select(row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    near = contexts(rows)
    together = near.groupBy("term", "entity").agg(F.count_distinct("row").alias("near"), F.count_distinct("context").alias("contexts"))
    entities = near.groupBy("entity", "row").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count("*").alias("mentions"))
    strong = together.where((F.col("near") >= LEAST_DOCUMENTS) & (F.col("contexts") >= LEAST_CONTEXTS))
    best = strong.join(entities, "entity").groupBy("term").agg(F.max(F.struct("near", (-F.col("mentions")).alias("back"), "contexts", "entity")).alias("best"))
    # a term's documents are at least those in which it is near any entity, which bounds its disclosure from above
    anywhere = near.groupBy("term", "row").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("*").alias("anywhere"))
    candidates = materialised(best.join(anywhere, "term").where(F.col("best.near") >= LEAST_DISCLOSURE * F.col("anywhere")).drop("anywhere"))
    n = candidates.count()
    if not n:
        return None
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    names = candidates.select("term")
    held = materialised(rows.select("row", F.explode(words).alias("term")).join(if_small(names, F.octet_length("term")), "term").select("row", "term").distinct())
    everywhere = held.groupBy("term").agg(F.count("*").alias("documents"))
    total = rows.select("row").distinct().count()
    disclosure = F.least(F.lit(1.0), F.col("best.near") / F.col("documents"))
    bits = F.log2(disclosure * F.lit(float(total)) / -F.col("best.back"))
    terms = candidates.join(everywhere, "term").select("term", disclosure.alias("disclosure"), bits.alias("bits"), F.col("best.near").alias("near"), "documents")
    terms = materialised(terms.where((F.col("disclosure") >= LEAST_DISCLOSURE) & (F.col("bits") >= LEAST_BITS)))
    k = terms.count()
    return (terms, held.join(if_small(terms.select("term"), F.octet_length("term")), "term")) if k else None


def find_pii(documents: DataFrame, base: str = "base", spans: str = "spans") -> DataFrame:
    """documents plus base (the contract's spans) and spans (these, secrets and disclosing terms), by kind and start.

    Null texts have no spans. Rows keep all their columns; repeated rows keep theirs. Offsets are code points, ends
    exclusive. Long texts are read whole. An empty table gives no rows. The two columns' names can be chosen; columns of those names are replaced.
    """
    documents = documents.drop(base, spans)
    text, own = F.coalesce("text", F.lit("")), uuid4().hex[:8]
    key, terms_of, row = f"__key_{own}", f"__terms_{own}", f"__row_{own}"
    found = disclosing_terms(documents)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
    secrets = F.when(text.rlike(SECRET_HINT), of_kind(positions(text, F.lit(SECRET), lambda m: F.lit(True)), "secret")).otherwise(none)
    out = documents.withColumn(base, base_spans(text))
    if found is None:
        return out.withColumn(spans, F.concat(F.col(base), secrets))
    by_row = materialised(found[1].groupBy(F.col("row").alias(key)).agg(F.array_join(F.sort_array(F.collect_set("term")), "|").alias(terms_of)))
    joined = out.withColumn(row, row_key()).join(if_small(by_row, F.octet_length(terms_of)), F.col(row) == F.col(key), "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.col(terms_of), F.lit(r")(?![\p{L}\p{N}])"))
    terms = F.when(F.col(terms_of).isNotNull(), of_kind(positions(text, pattern, lambda m: F.lit(True)), "term")).otherwise(none)
    return joined.withColumn(spans, F.concat(F.col(base), secrets, terms)).drop(key, terms_of, row)


def named(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def sanitise(documents: DataFrame) -> DataFrame:
    """documents with their texts' protected entities generalised to [KIND] and disclosing terms to [TERM].

    Overlapping spans are replaced as one, by the kind of the first. Null texts stay null; long ones are read whole. All columns stay, whatever
    their names, and so do repeated rows; an empty table gives no rows.
    """
    own = uuid4().hex[:8]
    base, spans, merged_spans = f"__base_{own}", f"__spans_{own}", f"__merged_{own}"
    found = find_pii(documents, base, spans)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), s.kind.alias("kind"))))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last.start.alias("start"), F.greatest(last.end, -s.back).alias("end"), last.kind.alias("kind"))
        added = F.struct(s.start.alias("start"), (-s.back).alias("end"), s.kind.alias("kind"))
        return F.when((F.size(done) > 0) & (s.start < F.get(done, F.size(done) - 1).end), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.array_append(done, added))

    merged = F.aggregate(ordered, none, lambda done, s: F.when(F.size(done) == 0, F.array(F.struct(s.start.alias("start"), (-s.back).alias("end"), s.kind.alias("kind")))).otherwise(merge(done, s)))
    with_merged = found.withColumn(merged_spans, merged)
    m = F.col(merged_spans)

    def piece(s: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1).end)
        return F.concat(F.substring(F.col("text"), start + 1, s.start - start), F.lit("["), F.upper(s.kind), F.lit("]"))

    tail = F.substring(F.col("text"), F.element_at(m, -1).end + 1, F.lit(2_147_483_647))
    clean = F.when(F.size(m) > 0, F.concat(F.array_join(F.transform(m, piece), ""), tail)).otherwise(F.col("text"))
    return with_merged.withColumn("text", clean).drop(merged_spans, base, spans)


def op4_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, as spans."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s.kind)
    every = F.transform("spans", lambda s: s.kind)
    of = lambda kind: (F.size(every) - F.size(F.array_remove(every, kind))).cast("bigint")
    more = [F.size(every).cast("bigint").alias("n_spans"), of("secret").alias("n_secrets"), of("term").alias("n_terms")]
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), *more)
