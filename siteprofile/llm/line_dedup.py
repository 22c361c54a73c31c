"""Fuzzy line deduplication: candidates by rare words or by SimHash, edit similarity, connected groups."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bind, components, materialize, small

#: Lines link if their edit similarity is at least SIMILARITY and, where the caller asks for SimHashes, these differ in at most MAX_BITS of 64 bits.
MAX_BITS, SIMILARITY = 3, 0.8
#: Lines with fewer words link only if they are equal: one word less is too much.
LEAST_WORDS = 5
#: 64 bits in 5 blocks: two lines that differ in at most 3 bits agree in 2 whole blocks at least, so each pair of blocks is a key.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Words are ranked by counts of hash buckets in one of SAMPLE lines. The ranks decide how many candidates there are, not which pairs are found.
BUCKETS, SAMPLE = 1 << 16, 8
#: Places of lines, of 20 bytes each, that are broadcast to where the documents are: 10 MB. Beyond, the documents are dealt to them.
PLACES = 500_000
#: A line in HOT places or more is compared once.
HOT = 16
#: Lines from here on have a parity of 256 bits, shorter ones of 128.
LONG = 80
#: Words that one row of counters sums up: each of its 64 counters has 14 bits and two to spare.
CHUNK = 16_000


def normal(line: Column) -> Column:
    """A line in lower case, its words parted by one space each. Letters are looked at one by one only where a search finds other white space than spaces."""
    other = F.lit(False)
    for c in "\t\x0b\x0c\r":
        other = other | F.contains(line, F.lit(c))
    plain = F.trim(F.when(other, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line))
    return F.lower(F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain))


def word_letters(line: Column) -> Column:
    """A normalised line as a string with a letter per word: one of 20,000 code points from U+4E00 on, by hash."""
    codes = F.transform(F.split(line, " "), lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(20_000)) + 0x4E00))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64(F.struct("*")).alias("_rid"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))


def simhashes(docs: DataFrame) -> DataFrame:
    """(id, rid, pos, part, line, n_words, sim) for each line with a word: where it stands, the hash of the normalised line, the number of its different words and their SimHash.

    Each word's 64-bit hash is split over 16 counters of four 16-bit lanes, so one aggregation sums the bits of all words of
    a line; a bit of the SimHash is set if more than half of the words have it. A line of more than CHUNK different words
    has a row, and a SimHash, for each part of CHUNK.
    """
    lines = _documents(docs).select("_id", "_rid", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "_line"))
    # Asked of the line as it is, else Spark would normalise it once for the filter and once more for its words.
    worded = lines.where(F.ltrim("_line", F.lit(" \t\x0b\x0c\r")) != "")
    norm = worded.select("_id", "_rid", "pos", normal(F.col("_line")).alias("_line"))
    split = norm.select("_id", "_rid", "pos", F.xxhash64("_line").alias("line"), F.posexplode(F.array_distinct(F.split("_line", " "))).alias("_i", "_word"))
    words = split.select("_id", "_rid", "pos", "line", F.floor(F.col("_i") / CHUNK).cast("int").alias("part"), F.xxhash64("_word").alias("_x"))
    lane = F.lit(0x0001000100010001)
    sums = [F.sum(F.shiftrightunsigned("_x", j).bitwiseAND(lane)).alias(f"_s{j}") for j in range(16)]
    counted = words.groupBy("_id", "_rid", "pos", "line", "part").agg(*sums, F.count(F.lit(1)).alias("_n"))
    # In each lane, 2^14 less the least majority is added: bit 14 is then set where the majority is reached.
    majority = F.floor(F.col("_n") / 2) + 1
    counted = counted.withColumn("_add", (F.lit(1 << 14) - majority) * lane)
    sim = F.lit(0).cast("long")
    for j in range(16):
        reached = (F.col(f"_s{j}") + F.col("_add")).bitwiseAND(F.lit(0x4000400040004000))
        sim = sim.bitwiseOR(F.shiftrightunsigned(reached, 14 - j) if j < 15 else F.shiftleft(reached, 1))
    return counted.select(F.col("_id").alias("id"), F.col("_rid").alias("rid"), "pos", "part", "line", F.col("_n").alias("n_words"), sim.alias("sim"))


def block_keys(sim: Column) -> Column:
    parts = [F.shiftrightunsigned(sim, low).bitwiseAND(F.lit((1 << n) - 1)) for low, n in BLOCKS]
    return F.array(*[F.shiftleft(F.lit(t).cast("long"), 26).bitwiseOR(F.shiftleft(parts[i], 13)).bitwiseOR(parts[j]) for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))])


def verified(pairs: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of line hashes those whose normalised lines have the edit similarity asked for (the words being the letters). Texts are fetched for the lines of a pair only, at the first place of each."""
    pairs = materialize(pairs.distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("line")).union(pairs.select(F.col("b").alias("line"))).distinct()
    places = lines.join(small(ends), "line", "left_semi").groupBy("line").agg(F.min(F.struct("id", "rid", "pos")).alias("p"))
    places = materialize(places.select(F.col("p.rid").alias("rid"), F.col("p.pos").alias("pos"), "line"), "places")
    wanted = places.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("pos", "line")).alias("_want"))
    few = places.limit(PLACES + 1).count() <= PLACES  # of places, so the arrays are bounded too
    rows = _documents(docs).join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "_rid").select("_want", F.split("_text", "\n", -1).alias("_lines"))
    letters = rows.select(F.explode(F.transform("_want", lambda w: F.struct(w["line"].alias("line"), word_letters(normal(F.get(F.col("_lines"), w["pos"]))).alias("t")))).alias("e"))
    letters = materialize(letters.select("e.*").dropDuplicates(["line"]), "letters")
    both = pairs.join(letters.toDF("a", "ta"), "a").join(letters.toDF("b", "tb"), "b")
    longest = F.greatest(F.length("ta"), F.length("tb"))
    most = most_edits(longest)
    near = (F.abs(F.length("ta") - F.length("tb")) <= most) & (F.call_function("levenshtein", "ta", "tb", most) >= 0)
    return materialize(both.where(near).select("a", "b"), "line-edges")


def groups(hashed: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) for the lines, by hash, that link to a line with another hash, of the pairs whose SimHashes are within MAX_BITS."""
    distinct = hashed.where(F.col("n_words") >= LEAST_WORDS).select("line", "sim").distinct()
    keyed = distinct.select("line", F.struct("sim").alias("sign"), F.explode(block_keys(F.col("sim"))).alias("key"))
    return linked(keyed, lambda a, b: F.bit_count(a["sim"].bitwiseXOR(b["sim"])) <= MAX_BITS, lambda a, b: F.lit(1), lines, docs)


def linked(keyed: DataFrame, near, shared, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) for the lines, by hash, that link to a line with another hash.

    keyed has key, line and sign. Pairs whose signs are near, and that have as many keys in common as shared asks for, are
    verified: first each line with the first of its bucket, which joins a group of near copies by one pair a line; then
    those lines of one bucket that are not in one component yet.
    """
    by_key = Window.partitionBy("key")
    bucketed = keyed.withColumn("lead", F.min(F.struct("line", "sign")).over(by_key)).withColumn("last", F.max("line").over(by_key)).where("lead.line < last")
    bucketed = materialize(bucketed.drop("last"), "line-buckets")
    stars = bucketed.where(F.col("line") != F.col("lead.line")).where(near(F.col("sign"), F.col("lead.sign")))
    stars = verified(stars.select(F.col("line").alias("a"), F.col("lead.line").alias("b")), lines, docs)
    known = materialize(components(stars), "line-components")
    labelled = bucketed.join(small(known), bucketed["line"] == known["node"], "left").select("key", "line", "sign", F.col("lead.line").alias("lead"), F.coalesce("component", "line").alias("c"))
    left, right = labelled.alias("x"), labelled.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.line") > F.col("y.line")) & (F.col("y.line") != F.col("x.lead")) & (F.col("x.c") != F.col("y.c"))
    rest = left.join(right, apart & near(F.col("x.sign"), F.col("y.sign"))).select(F.col("x.line").alias("a"), F.col("y.line").alias("b"), shared(F.col("x.sign"), F.col("y.sign")).alias("need"))
    rest = rest.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n >= need")
    return components(stars.unionByName(verified(rest.select("a", "b"), lines, docs)))


def most_edits(n: Column) -> Column:
    """Edits that two lines may be apart, the longer one having n words."""
    return F.floor(n * F.lit(round(1 - SIMILARITY, 9))).cast("int")


def _normal_lines(docs: DataFrame) -> DataFrame:
    lines = _documents(docs).select("_id", "_rid", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "_line"))
    norm = lines.where(F.length(F.translate("_line", " \t\x0b\x0c\r", "")) > 0).withColumn("_line", normal(F.col("_line")))
    return norm.select(F.col("_id").alias("id"), F.col("_rid").alias("rid"), "pos", F.xxhash64("_line").alias("line"), "_line")


def word_ranks(texts: DataFrame) -> list[int]:
    """Rank of each bucket of word hashes, by its count in a sample of the lines."""
    words = texts.where(F.pmod("line", F.lit(SAMPLE)) == 0).select(F.explode(F.split("_line", " ")).alias("w"))
    counts = [0] * BUCKETS
    for r in words.groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():  # BUCKETS rows at most
        counts[r.b] = r.n
    return [int(2 * math.log2(n + 1)) for n in counts]


def _coded(texts: DataFrame, ranks: list[int]) -> DataFrame:
    """line, n and _codes (rank and hash of each word) of the lines of LEAST_WORDS - 1 words or more."""
    table = F.split(F.lit(" ".join(map(str, ranks))), " ").cast("array<bigint>")
    code = lambda w: bind(F.xxhash64(w), lambda h: F.shiftleft(F.get(table, F.pmod(h, F.lit(BUCKETS)).cast("int")), 56).bitwiseOR(F.shiftrightunsigned(h, 8)))
    rows = texts.select("line", F.split("_line", " ").alias("_words")).withColumn("n", F.size("_words")).where(F.col("n") >= LEAST_WORDS - 1)
    return rows.select("line", "n", F.transform("_words", code).alias("_codes"))


def lost_pairs(n: Column) -> Column:
    """Different pairs of neighbours that a line of n words may lack in a line that it links to.

    An edit of a word, or the loss of one, takes two pairs and a new word one. If the other line is longer by k, k edits
    are new words: 2 * most_edits(n + k) - k, which is largest for k = 0 or for the first k that allows one edit more.
    """
    more = F.lit(5) - n % 5  # SIMILARITY allows one edit in 5 words
    return F.greatest(2 * most_edits(n), 2 * most_edits(n + more) - more)


def _pairs(codes: Column, n: Column) -> Column:
    """The different pairs of neighbours, as sum of the ranks and hash."""
    fold = lambda a, b: F.shiftleft(F.shiftrightunsigned(a, 56) + F.shiftrightunsigned(b, 56), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(a, b), 8))
    return F.array_distinct(F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), fold))


def rare_pair_keys(texts: DataFrame, ranks: list[int]) -> DataFrame:
    """(key, line): two lines of edit similarity SIMILARITY or more have two keys in common, or one if they have hardly any different pairs.

    The rarest pair of neighbours that two lines share is among the lost_pairs() + 1 rarest of each, the second among
    lost_pairs() + 2. The rank of a pair is the sum of its words' ranks.
    """
    coded = _coded(texts, ranks)
    rarest = F.slice(F.sort_array(_pairs(F.col("_codes"), F.col("n"))), F.lit(1), lost_pairs(F.col("n")) + 2)
    # A plain explode would let Spark push a filter on the keys, with all of their work, below the columns they are made of.
    return coded.select(F.explode_outer(rarest).alias("key"), "line").where("key is not null")


def signs(texts: DataFrame, ranks: list[int]) -> DataFrame:
    """(line, sign): the number of words, whether two shared keys are sure, and the parity of the words of each hash."""

    def parity(part: int, parts: int) -> Column:
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
        one = lambda c: F.when(F.shiftright(c, 6).bitwiseAND(F.lit(parts - 1)) == part, bit(c)).otherwise(F.lit(0).cast("long"))
        return F.aggregate("_codes", F.lit(0).cast("long"), lambda s, c: s.bitwiseXOR(one(c)))

    rows = _coded(texts, ranks)
    sure = F.size(_pairs(F.col("_codes"), F.col("n"))) >= lost_pairs(F.col("n")) + 2
    long = F.col("n") >= LONG
    first = [F.when(long, parity(i, 4)).otherwise(parity(i, 2)).alias(f"p{i}") for i in (0, 1)]
    return rows.select("line", F.struct("n", sure.alias("sure"), *first, *[F.when(long, parity(i, 4)).alias(f"p{i}") for i in (2, 3)]).alias("sign"))


def maybe_similar(a: Column, b: Column) -> Column:
    """Whether the signs leave an edit similarity of SIMILARITY possible: an edit changes two parities at most, an added or lost word one."""
    apart, most = F.abs(a["n"] - b["n"]), most_edits(F.greatest(a["n"], b["n"]))
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    half = lambda s, i: s[f"p{i}"].bitwiseXOR(F.coalesce(s[f"p{i + 2}"], F.lit(0).cast("long")))  # noqa: E731  a long line's parities as a short line has them
    both = a["p2"].isNotNull() & b["p2"].isNotNull()
    changed = F.when(both, sum((differ(a[f"p{i}"], b[f"p{i}"]) for i in range(1, 4)), differ(a["p0"], b["p0"]))).otherwise(differ(half(a, 0), half(b, 0)) + differ(half(a, 1), half(b, 1)))
    return (apart <= most) & (changed <= 2 * most - apart)


def once(norm: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, _line) of norm, those that stand in HOT places or more at their first place only: no line brings its keys more than HOT times."""
    hot = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "rid", "pos")).alias("first")).where(F.col("n") >= HOT)
    hot = small(materialize(hot.select("line", "first"), "hot-lines"))
    marked = norm.join(hot, "line", "left").where(F.col("first").isNull() | (F.struct("id", "rid", "pos") == F.col("first")))
    return marked.select("line", "_line")


def similar(norm: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) for the lines, by hash, that link to a line with another hash: all pairs of edit similarity SIMILARITY or more count."""
    texts = once(norm, lines)
    ranks = word_ranks(texts)
    by_key = Window.partitionBy("key")
    live = rare_pair_keys(texts, ranks).withColumn("_a", F.min("line").over(by_key)).withColumn("_b", F.max("line").over(by_key)).where("_a < _b").select("key", "line").distinct()
    live = materialize(live, "line-keys")
    keyed = live.join(signs(texts, ranks).dropDuplicates(["line"]), "line")
    return linked(keyed, maybe_similar, lambda a, b: F.when(a["sure"] | b["sure"], 2).otherwise(1), lines, docs)


def deduplicate(docs: DataFrame, by_simhash: bool = True) -> DataFrame:
    """row (all columns of the input), text (without the lines that go), n_lines and n_removed of each document.

    Lines that are equal when normalised, and lines linked directly or over others, form a group; of each group the first
    occurrence stays, by doc_id (null first), row hash and place. Lines without a word stay. Two lines of LEAST_WORDS
    different words or more link if their SimHashes over the different words differ in at most MAX_BITS bits and their edit
    similarity, word by word (1 - distance / longer length), is at least SIMILARITY; all such pairs are found. Without
    by_simhash all pairs of that edit similarity are, which on whole tables costs several times as much.

    Null or empty text: stays as it is, no lines or one without a word. Very long texts and lines: a line is summed in parts
    of CHUNK words. Rows alike in every column count as one document and lose the same lines. Empty
    table: no rows. Columns named like those of the result stay apart, inside row.
    """
    if by_simhash:
        hashed = materialize(simhashes(docs), "lines")
        lines = hashed.where("part = 0")
        found = groups(hashed, lines, docs)
    else:
        norm = _normal_lines(docs)
        lines = materialize(norm.drop("_line"), "lines")
        found = similar(norm, lines, docs)
    known = materialize(found, "line-groups")
    labelled = lines.join(small(known), lines["line"] == known["node"], "left").select(F.struct("id", "rid", "pos").alias("at"), F.coalesce("component", "line").alias("group"))
    first = labelled.groupBy("group").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = labelled.join(first, "group").where("at <> first").groupBy(F.col("at.rid").alias("_rid")).agg(F.collect_set("at.pos").alias("_gone"))
    rows = _documents(docs).join(gone.hint("shuffle_hash"), "_rid", "left").withColumn("_lines", F.split("_text", "\n", -1)).withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.size("_gone") == 0, F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n"))
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    return rows.select("row", text.alias("text"), n_lines.alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"))


def rewrite(docs: DataFrame, by_simhash: bool = True) -> DataFrame:
    """The documents with their remaining lines; documents that lose their last word go, as all of it stands elsewhere. Columns as in the input."""
    done = deduplicate(docs, by_simhash)
    bare = F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "")) == 0
    kept = done.where((F.col("n_removed") == 0) | ~bare)
    return kept.select(*[(F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
