"""Quality rules with host-level verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, materialize, small, words

#: Rates of the soft rules, and the shrunk failure rate from which a host counts as bad.
MAX_SYMBOLS, MAX_DUP_LINES, BAD_HOST = 0.1, 0.3, 0.5
#: Weight of the prior, in documents, where the host rates do not spread enough to fit one.
DEFAULT_STRENGTH = 20.0
RULES = ("short", "repeats", "symbols", "dup_lines")


def repeated_words(hashes: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more, from the word hashes of one text.

    The windows' hashes with their places are sorted; equal neighbours are repeats. Each repeated window adds the words that
    the next repeated one does not start with.
    """
    windows = F.when(F.size(hashes) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2))))

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda x, i: F.coalesce(F.least(F.get(starts, i + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda total, x: total + x)

    def repeats(sorted_windows: Column) -> Column:
        same = F.filter(sorted_windows, lambda x, i: (F.get(sorted_windows, i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)) | F.get(sorted_windows, i + 1)["h"].eqNullSafe(x["h"]))
        return bind(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(bind(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeats)))


def features(docs: DataFrame) -> DataFrame:
    """row (all columns of the input), host and the counts n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of the whole text; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    found = docs.select(
        F.struct("*").alias("row"),
        F.col("source").alias("host"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_lines"),
        bind(hashes, lambda h: F.struct(F.size(h).alias("n"), repeated_words(h).alias("rep"))).alias("_words"),
    )
    return found.select("row", "host", F.col("_words.n").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("_lines.n").cast("long").alias("n_lines"), F.col("_lines.dup").cast("long").alias("n_dup_lines"), F.col("_words.rep").cast("long").alias("n_repeat_words"))


def failures(counts: DataFrame) -> DataFrame:
    n = F.col("n_words")
    short, repeats = n < 50, 100 * F.col("n_repeat_words") > 50 * n
    return counts.withColumns({
        "fail_short": short,
        "fail_repeats": repeats,
        "fail_symbols": F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"),
        "fail_dup_lines": F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
        "base_failed": short | repeats,
    })


def host_verdicts(failed: DataFrame) -> DataFrame:
    """host, n_docs, rate_<rule> (shrunk) and bad_host.

    The rates of all hosts give each rule a beta prior by moments: mean m and variance v give the strength m(1-m)/v - 1. A
    host's rate becomes (failures + m * strength) / (documents + strength), so a host of few documents stays near the mean.
    """
    hosts = failed.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"n_{r}") for r in RULES])
    hosts = materialize(hosts, "hosts")
    prior = hosts.agg(*[f(F.col(f"n_{r}") / F.col("n_docs")).alias(f"_{k}_{r}") for r in RULES for k, f in (("m", F.avg), ("v", F.var_samp))])
    out = hosts.crossJoin(F.broadcast(prior))  # one row
    for r in RULES:
        m, v = F.col(f"_m_{r}"), F.col(f"_v_{r}")
        strength = F.when((v > 0) & (v < m * (1 - m)), m * (1 - m) / v - 1).otherwise(DEFAULT_STRENGTH)
        out = out.withColumn(f"rate_{r}", (F.col(f"n_{r}") + m * strength) / (F.col("n_docs") + strength))
    return out.select("host", "n_docs", *[f"rate_{r}" for r in RULES], F.greatest(*[F.col(f"rate_{r}") for r in RULES]).__gt__(BAD_HOST).alias("bad_host"))


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All documents with their counts, base_failed, bad_host and kept.

    A document that fails a base rule goes. Of a bad host go the documents that fail a soft rule too (symbols, repeated
    lines); its clean documents stay. keep: the columns of the input to carry (all, if None); counts are written once and
    both the host totals and the verdicts read them.

    Null text: no words, so it fails. Null host: a host of its own. Repeated rows are judged one by one, very long texts
    whole. Empty table: no rows. Clashing columns stay apart, inside row.
    """
    counts = features(docs)
    if keep is not None:
        counts = counts.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in keep]))
    failed = failures(materialize(counts, "quality"))
    hosts = host_verdicts(failed).select(F.struct("host").alias("_h"), "bad_host")
    soft = F.col("fail_symbols") | F.col("fail_dup_lines")
    joined = failed.withColumn("_h", F.struct("host")).join(small(hosts), "_h").drop("_h")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("bad_host") & soft))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that judge() keeps, with the columns of the input."""
    return judge(docs).where("kept").select("row.*")
