"""Personal data (operator 1): patterns and information-theoretic sanitisation, in DataFrame functions only.

Patterns find the protected entities (email, ip, card, phone). Then the corpus
tells which words give an entity away: for an entity c and a word t near it,
p(c | t) is the share of the word's documents in which it stands near c, and the
disclosure of c by t is its pointwise mutual information as a share of the
information content of c, PMI(c; t) / IC(c) = 1 + log p(c | t) / IC(c). Words
whose disclosure exceeds a threshold, with enough independent support, become
spans of the kind `term` at all their places, to be generalised or removed like
the entities. Entities are protected one by one and by class (an owner's mail
domain, a network, a card's issuer, a telephone area), as many members of a
class are given away by the same words; those must also do better than words
dealt out to documents by chance. Documents are counted by their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.llm.tables import id_and_text, stored, with_ids

#: Fixed patterns. Groups repeat possessively, and a run of characters is tried
#: from its first one (or where the last match ended), so that long runs take
#: linear time and no deep recursion; the matches are those of the plain forms.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth a search.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}[0-9]", "phone": r"\+[0-9]"}
KINDS = (*PATTERNS, "term")
#: Context: so many words within so many code points of either side of a span.
NEAR_WORDS, NEAR_CHARS = 5, 120
#: A term needs this share of the entity's information, in so many different contexts.
DISCLOSURE, SUPPORT, MIN_TERM = 0.9, 3, 3
#: Chance that any class at all would have a term if words stood in random documents.
CHANCE = 0.01
#: Names of classes; no entity is spelt like them.
CLASS = r"^email:@|\*$"
WORD = r"[\p{L}][\p{L}\p{Mn}'’-]*"
GENERALISED = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn checksum that is a multiple of ten."""
    at = F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0)))

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(at, F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    parts = F.split(match, r"\.")
    small = F.forall(parts, lambda p: (F.length(F.ltrim(F.lit("0"), p)) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    return F.when(kind == "ip", small).when(kind == "card", n.between(14, 19) & F.when(n.between(14, 19), luhn(digits)).otherwise(False)).when(kind == "phone", n.between(10, 15)).otherwise(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, kind, rank, start, end, match, left, right) of valid pattern matches in rows (doc_id, th, text).

    Matches and the gaps between them come from the same pattern; a running sum
    of their lengths gives the positions, in code points. left and right are
    the texts beside the match, NEAR_CHARS at most.
    """
    searched = docs.select("doc_id", "th", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(i).alias("rank"),
                 F.when(F.col("text").rlike(HINTS[k]), F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("m"),
                 F.when(F.col("text").rlike(HINTS[k]), F.split("text", p, -1)).alias("g"))
        for i, (k, p) in enumerate(PATTERNS.items())])).alias("s")).filter(F.size("s.m") > 0)
    trimmed = F.transform("s.g", lambda g: F.struct(F.length(g).alias("n"), F.left(g, F.lit(NEAR_CHARS)).alias("head"), F.right(g, F.lit(NEAR_CHARS)).alias("tail")))
    zipped = searched.select("doc_id", "th", "s.kind", "s.rank", F.col("s.m").alias("m"), trimmed.alias("g")).select(
        "doc_id", "th", "kind", "rank", F.posexplode(F.arrays_zip("m", "g", F.slice("g", F.lit(2), F.greatest(F.size("g") - 1, F.lit(0))).alias("h"))).alias("i", "z")).filter("z.m is not null")
    so_far = Window.partitionBy("doc_id", "th", "kind").orderBy("i")
    one = zipped.select("doc_id", "th", "kind", "rank", "i", F.col("z.m").alias("match"), F.col("z.g.n").alias("gap"), F.col("z.g.tail").alias("left"), F.col("z.h.head").alias("right"))
    one = one.dropDuplicates(["doc_id", "th", "kind", "i"])  # repeated rows
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    placed = one.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    return placed.filter(valid(F.col("kind"), F.col("match"))).select("doc_id", "th", "kind", "rank", "start", "end", "match", "left", "right")


def context_terms(spans: DataFrame) -> DataFrame:
    """(doc_id, th, entity, term, start, end, context) of the words whole within the context of each span, for its entity and its entity's class."""
    side = lambda text, far: F.struct(F.split(text, WORD, -1).alias("g"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("m"), F.lit(far).alias("left"))
    clean_left = F.when(F.length("left") < NEAR_CHARS, F.col("left")).otherwise(F.concat(F.repeat(F.lit(" "), F.length(F.regexp_extract("left", r"\A\S*", 0))), F.regexp_replace("left", r"\A\S+", "")))
    clean_right = F.when(F.length("right") < NEAR_CHARS, F.col("right")).otherwise(F.regexp_replace("right", r"\S+\z", ""))
    mail, digits = F.lower("match"), F.regexp_replace("match", "[^0-9]", "")
    same = F.when(F.col("kind") == "email", mail).when(F.col("kind") == "ip", F.col("match")).otherwise(digits)
    group = F.when(F.col("kind") == "email", F.concat(F.lit("@"), F.substring_index(mail, "@", -1))).when(F.col("kind") == "ip", F.concat(F.substring_index("match", ".", 3), F.lit(".*"))).otherwise(F.concat(F.left(digits, F.lit(6)), F.lit("*")))
    entity = F.explode(F.array(F.concat_ws(":", "kind", same), F.concat_ws(":", "kind", group)))
    rows = spans.select("doc_id", "th", entity.alias("entity"), "start", "end", F.xxhash64(clean_left, clean_right).alias("context"), F.explode(F.array(side(clean_left, True), side(clean_right, False))).alias("s"), F.length("left").alias("nl"))
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    rows = rows.select("doc_id", "th", "entity", "context", "start", "end", "nl", "s.left", F.col("s.m").alias("m"), F.size("s.m").alias("n"), lengths(F.col("s.g")).alias("gl"), lengths(F.col("s.m")).alias("ml"))
    before = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda t, x: t + x)
    rows = rows.select("*", F.posexplode("m").alias("i", "term")).filter(F.when(F.col("left"), F.col("i") >= F.col("n") - NEAR_WORDS).otherwise(F.col("i") < NEAR_WORDS))
    at = before(F.col("gl"), F.col("i") + 1) + before(F.col("ml"), F.col("i"))
    origin = F.when(F.col("left"), F.col("start") - F.col("nl")).otherwise(F.col("end"))
    rows = rows.select("doc_id", "th", "entity", "context", F.lower("term").alias("term"), (origin + at).alias("start"), (origin + at + F.length("term")).alias("end"))
    return rows.filter(F.length("term") >= MIN_TERM)


def revealing_terms(docs: DataFrame, near: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, chance: float | None = None) -> DataFrame:
    """(entity, term) pairs of near whose disclosure over all of docs exceeds the threshold.

    Copies are no evidence: contexts are counted once however often they are
    repeated, and documents once for each id, on both sides of every share.
    Given a chance, a pair of a word and a class, which by its size meets many
    words, must also beat the null of words dealt out to documents at random: the bound exp(-n KL(share || share of the entity)) on
    the binomial tail, times the number of pairs, stays below it.
    """
    pairs = stored(near.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("doc_id").alias("both")).filter(F.col("contexts") >= support))
    entities = near.groupBy("entity").agg(F.countDistinct("doc_id").alias("with_entity"))
    nearby = near.groupBy("term").agg(F.countDistinct("doc_id").alias("with_term"))
    total = docs.agg(F.countDistinct("doc_id").alias("total")).crossJoin(pairs.agg(F.count("*").alias("tried")))

    def disclosing(rows: DataFrame) -> DataFrame:
        n = F.greatest("with_term", "both")
        share = F.least(F.col("both") / n, F.lit(1.0))
        usual = F.col("with_entity") / F.greatest("total", "with_entity")
        kept = rows.filter(F.when(usual < 1, 1 + F.log2(share) / -F.log2(usual)).otherwise(0.0) >= disclosure)
        if chance is None:
            return kept
        rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - usual))).otherwise(0.0)
        beats = (share > usual) & (n * (share * F.log(share / usual) + rest) >= F.log(F.col("tried") / chance))
        return kept.filter(~F.col("entity").rlike(CLASS) | beats)

    # a word has at least the documents in which it stands near some entity: what fails with these fails with all
    known = pairs.join(entities, "entity").join(F.broadcast(total))  # total is one row
    doubtful = stored(disclosing(known.join(nearby, "term")).drop("with_term"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{Mn}'’-]+"))).alias("term"))
    words = with_ids(words, stored(doubtful.select("term").distinct()), "term").groupBy("term").agg(F.countDistinct("doc_id").alias("with_term"))
    return disclosing(doubtful.join(words, "term")).select("entity", "term")


def term_places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, th, start, end) of every word of rows (doc_id, th, text) that is among the stored terms, wherever it stands.

    Only texts that hold a term are taken apart into placed words.
    """
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    words = docs.select("doc_id", "th", F.explode(F.array_distinct(F.transform(found, lambda m: F.lower(m)))).alias("term"))
    holders = with_ids(words, terms, "term").select(F.col("doc_id").alias("i"), F.col("th").alias("t")).distinct()
    held = docs.join(holders, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left_semi")
    gaps = F.transform(F.split("text", WORD, -1), lambda g: F.length(g))
    zipped = held.select("doc_id", "th", found.alias("m"), gaps.alias("g")).select("doc_id", "th", F.posexplode(F.arrays_zip("m", "g")).alias("n", "z")).filter("z.m is not null")
    one = zipped.select("doc_id", "th", "n", F.lower("z.m").alias("term"), F.length("z.m").alias("size"), F.col("z.g").alias("gap")).dropDuplicates(["doc_id", "th", "n"])  # repeated rows
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("doc_id", "th").orderBy("n"))
    placed = one.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    return with_ids(placed, terms, "term").select("doc_id", "th", "start", "end")


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(docs, spans): docs (doc_id, th, text) and one row (doc_id, th, kind, rank, start, end) for each span."""
    docs = id_and_text(df, id_col, text_col).withColumn("th", F.xxhash64("text"))
    base = stored(base_spans(docs))
    near = stored(context_terms(base))
    revealing = stored(revealing_terms(docs, near, disclosure, support, CHANCE))
    beside = near.join(revealing, ["entity", "term"]).select("doc_id", "th", "start", "end")
    places = beside.unionByName(term_places(docs, stored(revealing.select("term").distinct())))
    terms = places.select("doc_id", "th", F.lit("term").alias("kind"), F.lit(len(PATTERNS)).alias("rank"), "start", "end").distinct()
    return docs, base.select("doc_id", "th", "kind", "rank", "start", "end").unionByName(terms)


def _listed(found: DataFrame) -> DataFrame:
    order = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.struct("start", "rank", "end", "kind"))))
    text = lambda column: F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.col("rank") < len(PATTERNS)
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
    return found.groupBy("doc_id", "th").agg(*counts, order(base).alias("b"), order(F.lit(True)).alias("a")).select("doc_id", "th", *[f"n_{k}" for k in KINDS], text(F.col("b")).alias("base"), text(F.col("a")).alias("spans"))


def private_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Positions are code points, ends exclusive. A null or empty text has no spans,
    the empty string and its digest. Repeated rows each come back with the spans
    of their text, null ids likewise; other columns are ignored; an empty table
    gives an empty result. One text's matches are exploded into rows, so a very
    long text costs rows and not one large array per match.
    """
    docs, found = spans(df, id_col, text_col, disclosure, support)
    listed = _listed(found).select(F.col("doc_id").alias("i"), F.col("th").alias("t"), *[f"n_{k}" for k in KINDS], "base", "spans")
    out = docs.select("doc_id", "th").join(listed, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    count = lambda k: F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}")
    base, every = F.coalesce("base", F.lit("")), F.coalesce("spans", F.lit(""))
    return out.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"), count("term"))


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, text) with every span generalised to its kind; overlapping spans merge under the kind of the first.

    Null and empty texts come back empty; the other cases are those of private_spans.
    """
    docs, found = spans(df, id_col, text_col, disclosure, support)
    order = Window.partitionBy("doc_id", "th").orderBy("start", "rank", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("run", F.sum(F.when(F.col("start") < reach, 0).otherwise(1)).over(order))
    runs = runs.groupBy("doc_id", "th", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "rank")).alias("kind"))
    lists = runs.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("runs")).select(F.col("doc_id").alias("i"), F.col("th").alias("t"), "runs")
    out = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    name = F.create_map(*[F.lit(x) for pair in GENERALISED.items() for x in pair])
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("runs", lambda r: r["end"]))
    part = F.zip_with("runs", starts, lambda r, s: F.when(r.isNotNull(), F.concat(F.substring(F.col("text"), s.cast("int") + 1, (r["start"] - s).cast("int")), name[r["kind"]])).otherwise(F.substring(F.col("text"), s.cast("int") + 1, F.length("text"))))
    return out.select("doc_id", F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(part, "")).alias("text"))
