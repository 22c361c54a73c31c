"""Personal data: patterns of four kinds, and bootstrapped contextual extraction of what they miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bind, materialize

KINDS = ("email", "ip", "card", "phone")
#: A match starts where its first run of characters starts, or where the last match ended; with possessive runs no text is scanned twice.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<!\S)[^\s0-9]*+[0-9]\S*+(?:\x20[^\s0-9]{0,2}+[0-9]\S*+)*+",
    "name": r"(?<!\S)[(\[<]*+(?=[^\s.(\[@]++[.(\[@]\S*[A-Za-z])\S++",
}
#: What the patterns of a kind may discover: numbers are runs of tokens with a digit (4 digits at least), names are tokens with a full stop, bracket or @ inside.
CANDIDATES = ("number", "name")
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: A pattern counts from MIN_SEEDS different instances of a kind on; it discovers from CONFIDENCE on. ROUNDS at most.
MIN_SEEDS, CONFIDENCE, ROUNDS = 5, 0.7, 4
#: Weight of an instance of which nothing is known yet, against a pattern.
UNKNOWN = 0.25


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    n = F.length(digits(match))
    return (
        F.when(kind == "ip", match.rlike(IP))
        .when(kind == "card", F.when(n.between(13, 19), luhn(digits(match))).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def marks(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, kind, start, end, match, left, right): all matches of PATTERNS, in code points; those that are not valid have no kind, and a document without matches has one row without a kind.

    A text split at the matches gives the lengths between them; running sums by document and kind give the places. left and
    right are up to 60 and 30 characters around a match, which may reach over the match before or after.
    """
    text = F.col("_text")
    names = F.contains(text, F.lit("@")) | F.contains(text, F.lit("(")) | F.contains(text, F.lit("[")) | text.rlike(r"\S\.\S")
    has = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "name": names}
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,match:string,left:string,right:string>>")

    def found(kind: str) -> Column:
        def spans(both: Column) -> Column:
            gaps, matches = both["gaps"], both["matches"]
            near = lambda x: F.coalesce(x, F.lit(""))
            before = lambda i: F.right(F.concat(F.right(near(F.get(gaps, i - 1)), F.lit(60)), near(F.get(matches, i - 1)), F.get(gaps, i)), F.lit(60))
            after = lambda i: F.left(F.concat(F.get(gaps, i + 1), near(F.get(matches, i + 1)), F.left(near(F.get(gaps, i + 2)), F.lit(30))), F.lit(30))
            each = F.transform(matches, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), m.alias("match"), before(i).alias("left"), after(i).alias("right")))
            return F.when(F.size(matches) == 0, none).otherwise(each)

        pattern = PATTERNS[kind]
        pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
        return F.when(has.get(kind, F.col("_digits")), bind(pieces, spans)).otherwise(none)

    texts = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("rid", F.monotonically_increasing_id()).withColumn("_digits", text.rlike("[0-9]"))
    rows = texts.select("rid", "doc_id", F.explode_outer(F.concat(*[found(k) for k in PATTERNS])).alias("m")).select("rid", "doc_id", "m.*")
    before = Window.partitionBy("rid", "kind").orderBy("i")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(before).cast("long")).withColumn("start", F.col("end") - F.length("match"))
    candidate = F.col("kind").isin(*CANDIDATES)
    some = F.when(F.col("kind") == "number", F.length(digits(F.col("match"))) >= 4).otherwise(True)
    good = F.when(candidate, some).otherwise(valid(F.col("kind"), F.col("match")))
    return placed.select("rid", "doc_id", F.when(good, F.col("kind")).alias("kind"), "start", "end", "match", "left", "right")


def contexts(spans: DataFrame) -> DataFrame:
    """spans with their lexical patterns: the two words before, and the words before and after (lower case, digits as 0)."""
    words = lambda c: F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(c)), r"\s+", " "), "[0-9]", "0")), " ")
    before, after = words("left"), words("right")
    last = F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), F.lit(2))
    two = F.when(F.size(last) == 2, F.concat(F.lit("L:"), F.array_join(last, " ")))
    around = F.when((F.length(F.element_at(before, -1)) > 0) & (F.length(after[0]) > 0), F.concat(F.lit("C:"), F.element_at(before, -1), F.lit(" _ "), after[0]))
    return spans.withColumn("pattern", F.explode(F.array_compact(F.array(two, around))))


def candidates(near: DataFrame) -> DataFrame:
    """The rows of near that may be discovered: those of CANDIDATES that no base span overlaps, without punctuation at their ends."""
    base = ~F.col("kind").isin(*CANDIDATES)
    by_start = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    placed = near.withColumn("_reach", reach).withColumn("_ahead", ahead).where(~base)
    free = placed.where((F.coalesce("_reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("_ahead", F.col("end")) >= F.col("end")))
    core = F.regexp_extract("match", r"(?s)[0-9A-Za-z+](?:.*[0-9A-Za-z])?", 0)
    cut = free.withColumn("_core", core).withColumn("start", F.col("start") + F.instr("match", F.col("_core")) - 1)
    return cut.withColumn("end", F.col("start") + F.length("_core")).withColumn("match", F.col("_core")).where(F.length("match") > 0)


def discover(found: DataFrame) -> DataFrame:
    """(rid, kind, start, end) of candidates that high-confidence patterns reach and no base span overlaps.

    Patterns and instances (different strings) form a bipartite graph, with one edge for a pattern and an instance, so
    copies add nothing. Seeds have score 1 for their kind. In each round the instances known so far induce patterns from all
    their contexts: a pattern's confidence in a kind is the sum of the scores of its instances of the kind over the number
    of all its instances plus 2. Patterns with MIN_SEEDS such instances and a confidence of CONFIDENCE discover the
    candidates of their type (names for e-mail, numbers for the others); a discovered instance has its best pattern's
    confidence as score and is known in the next round, at all its places. It ends when a round discovers nothing new,
    after ROUNDS rounds at the latest.
    """
    near = found.where("kind is not null")
    seeds = contexts(near.where(~F.col("kind").isin(*CANDIDATES))).select("pattern", "kind", F.col("match").alias("instance")).distinct()
    seeds = materialize(seeds, "seeds")
    reached = contexts(candidates(near)).select("rid", "start", "end", "pattern", F.col("match").alias("instance"), F.col("kind").alias("type"))
    reached = materialize(reached, "candidates")
    edges = materialize(reached.select("pattern", "instance", "type").distinct(), "edges")
    total = seeds.select("pattern", "instance").unionByName(edges.select("pattern", "instance")).distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    total = materialize(total, "patterns")
    fits = (F.col("kind") == "email") == (F.col("type") == "name")
    known, n_known, sure = None, 0, None
    for _ in range(ROUNDS):
        support = seeds.select("pattern", "kind", F.lit(1.0).alias("score"))
        if known is not None:
            support = support.unionByName(edges.select("pattern", "instance").distinct().join(known, "instance").select("pattern", "kind", "score"))
        by_kind = support.groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("_k"))
        all_kinds = by_kind.groupBy("pattern").agg(F.sum("score").alias("_all"), F.sum("_k").alias("_known"), F.max("_k").alias("_most")).where(F.col("_most") >= MIN_SEEDS)
        strong = by_kind.where(F.col("_k") >= MIN_SEEDS).join(all_kinds, "pattern").join(total, "pattern")
        unknown = F.greatest(F.col("n") - F.col("_known"), F.lit(0)) * UNKNOWN
        strong = strong.withColumn("confidence", F.col("score") / (F.col("_all") + unknown + 2)).where(F.col("confidence") >= CONFIDENCE)
        sure = materialize(strong.select("pattern", "kind", "confidence"), "sure")
        best = edges.join(sure, "pattern").where(fits).groupBy("instance").agg(F.max(F.struct("confidence", "kind")).alias("best"))
        known = materialize(best.select("instance", F.col("best.kind").alias("kind"), F.col("best.confidence").alias("score")), "known")
        n = known.count()
        if n <= n_known:
            break
        n_known = n
    hits = reached.join(sure, "pattern").where(fits).groupBy("rid", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    return hits.select("rid", F.col("best.kind").alias("kind"), "start", "end")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans and spans of each document.

    base_spans and spans are arrays of (order, start, end, kind), by kind as in KINDS and then start; base_spans are the
    valid leftmost matches of each kind, which the counts are of; spans also has what discover() adds, under the kind of the
    pattern that found it.

    Null or empty text: no spans. Very long texts: read whole, each pattern in one pass. Repeated rows: each one its own.
    Null doc_id stays null. Empty table: no rows. Other columns of the input are not read.
    """
    found = materialize(marks(docs), "marks")
    added = materialize(discover(found), "added")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct(rank.alias("order"), "start", "end", "kind")
    seen = F.col("kind").isNotNull() & ~F.col("kind").isin(*CANDIDATES)
    base = found.select("rid", "doc_id", F.when(seen, span).alias("base"), F.lit(None).cast("struct<order:int,start:bigint,end:bigint,kind:string>").alias("more"))
    extra = added.select("rid", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("struct<order:int,start:bigint,end:bigint,kind:string>").alias("base"), span.alias("more"))
    count = [F.count(F.when(F.col("base.kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
    rows = base.unionByName(extra).groupBy("rid").agg(F.max("doc_id").alias("doc_id"), *count, F.array_sort(F.collect_list("base")).alias("base_spans"), F.collect_list("more").alias("_more"))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], "base_spans", F.array_sort(F.concat("base_spans", "_more")).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with each span of detect() replaced by its kind in brackets, for documents with unique doc_id. Overlapping spans become one, under the first kind."""
    spans = detect(docs).where(F.size("spans") > 0).select("doc_id", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))
    text = F.coalesce(F.col("text"), F.lit(""))
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        piece = F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]"))
        return F.when(x["start"] < s["at"], F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at"))).otherwise(F.struct(piece.alias("out"), x["end"].alias("at")))

    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    done = F.aggregate("spans", state, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done).alias("text"))
