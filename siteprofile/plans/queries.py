"""The registered queries and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import adapters, contexts, intervals, levels, profiles, reads, smoothing, spectral, statistics, structures, tracks
from ..sources import readers
from . import pipelines, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Replicates of the null models, as in the reference.
N_RANDOM = 1000


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {tables.SQL.strip()}{sql}" if not sql.startswith("WITH") else sql
        return f

    return add


def r9(c: str | Column, places: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def significant(spark: SparkSession, d: str) -> DataFrame:
    return tables.sites(spark, d).where("pvalue < 0.05")


def signature3(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.enrichment(tables.sites(spark, d), tables.genome(spark, d))


def pairs(spark: SparkSession, d: str, left: int = 73, right: int = 74) -> DataFrame:
    return pipelines.region_pairs(tables.sites(spark, d), tables.regions(spark, d), left, right)


def nucleosomes(spark: SparkSession, d: str, left: int = 73, right: int = 74) -> DataFrame:
    return intervals.windows(tables.regions(spark, d), F.col("center"), left, right)


@query("kmer_background_genome", " SELECT kmer, n FROM bg3")
def kmer_background_genome(spark, d):
    return contexts.genome_kmer_counts(tables.genome(spark, d), 3)


@query(
    "kmer_background_joined",
    ", h AS (SELECT chrom, seq[greatest(length(seq) - 1, 1):length(seq)] AS tail, seq[1:2] AS head FROM genome WHERE length(seq) > 0), j AS (SELECT length(tail) AS t, concat(tail, concat(lead(head) OVER o, lead(head, 2) OVER o)[1:2]) AS s FROM h WINDOW o AS (ORDER BY chrom)), "
    "e AS (SELECT s[i:i + 2] AS kmer FROM (SELECT s, unnest(range(1, least(t, length(s) - 2) + 1)) AS i FROM j)) SELECT kmer, count(*) AS n FROM (SELECT kmer FROM k3 UNION ALL SELECT kmer FROM e) GROUP BY 1",
)
def kmer_background_joined(spark, d):
    return contexts.genome_kmer_counts(tables.genome(spark, d), 3, span_chromosomes=True)


@query("kmer_background_segment", ", seqs AS (SELECT class, seq[\"start\":\"end\" - 1] AS s FROM nuc JOIN genome USING (chrom)) SELECT class, s[i:i + 4] AS kmer, count(*) AS n FROM (SELECT class, s, unnest(range(1, length(s) - 3)) AS i FROM seqs) GROUP BY 1, 2")
def kmer_background_segment(spark, d):
    return tracks.kmers_in(nucleosomes(spark, d), tables.genome(spark, d), F.col("start"), F.col("end") - F.col("start"), 5, ["class"])


@query("base_composition", ", c AS (SELECT lang, b AS base, count(*) AS n FROM (SELECT lang, unnest(string_split(seq, '')) AS b FROM genome) WHERE b <> '' GROUP BY 1, 2) SELECT lang, base, round_even(n / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE), 4) AS share FROM c")
def base_composition(spark, d):
    return contexts.base_composition(tables.genome(spark, d), ["lang"])


def _signature_sql(k: int) -> str:
    return f", o AS (SELECT c{k} AS context, count(*) AS o FROM contexts WHERE pvalue < 0.05 AND c{k} <> '-' GROUP BY 1), r AS (SELECT context, coalesce(o / CAST(n AS DOUBLE), 0) AS ref_norm FROM o LEFT JOIN bg{k} ON kmer = context) SELECT context, round(ref_norm, 9) AS ref_norm, round(ref_norm / sum(ref_norm) OVER (), 9) AS total_norm FROM r"


@query("enrichment_triplet", _signature_sql(3))
def enrichment_triplet(spark, d):
    return signature3(spark, d).select("context", r9("ref_norm"), r9("total_norm")).toDF("context", "ref_norm", "total_norm")


@query("enrichment_pentamer", _signature_sql(5))
def enrichment_pentamer(spark, d):
    return pipelines.enrichment(tables.sites(spark, d), tables.genome(spark, d), k=5).select("context", r9("ref_norm").alias("ref_norm"), r9("total_norm").alias("total_norm"))


@query("site_contexts", " SELECT site_id, chrom, pos, strand, base, c3 AS context_3, c5 AS context_5 FROM contexts")
def site_contexts(spark, d):
    return contexts.annotate(tables.sites(spark, d), tables.genome(spark, d)).select("site_id", "chrom", "pos", "strand", "base", "context_3", "context_5")


@query("region_contexts", ", e AS (SELECT \"end\" AS p, seq FROM nuc JOIN genome USING (chrom)), w AS (SELECT seq[p - 1:p + 1] AS c FROM e) SELECT CASE WHEN length(c) < 3 THEN '-' ELSE c END AS context, count(*) AS n FROM w GROUP BY 1")
def region_contexts(spark, d):
    rows = contexts.with_sequence(nucleosomes(spark, d), tables.genome(spark, d), F.col("end") - 1, 3, "w")
    return contexts.context_counts(rows.withColumn("c", F.when(F.length("w") < 3, S.NO_CONTEXT).otherwise(F.col("w"))), "c")


@query("embedded_contexts", ", m AS (SELECT site_id, seq[pos - 10:pos + 10] AS mer FROM sites JOIN genome USING (chrom) WHERE pos > 10) SELECT site_id, mer[9:13] AS c5, mer[10:12] AS c3, mer[11:12] AS m_right, mer[10:11] AS m_left, mer[10:12] AS m_odd FROM m WHERE length(mer) = 21")
def embedded_contexts(spark, d):
    rows = contexts.with_sequence(tables.sites(spark, d).where("pos > 10"), tables.genome(spark, d), F.col("pos") - 10, 21, "mer").where(F.length("mer") == 21)
    mer = F.col("mer")
    return rows.select("site_id", S.mer_context(mer, 5).alias("c5"), S.mer_context(mer, 3).alias("c3"), S.motif_window(mer, 2, "right").alias("m_right"), S.motif_window(mer, 2, "left").alias("m_left"), S.motif_window(mer, 3).alias("m_odd"))


@query("bases_before", " SELECT site_id, lpad(CASE WHEN pos > 1 THEN seq[greatest(pos - 3, 1):pos - 1] ELSE '' END, 3, 'N') AS before FROM sites JOIN genome USING (chrom)")
def bases_before(spark, d):
    first = F.greatest(F.col("pos") - 3, F.lit(1))
    rows = contexts.with_sequence(tables.sites(spark, d), tables.genome(spark, d), first, F.col("pos") - first, "w")
    return rows.select("site_id", F.lpad("w", 3, "N").alias("before"))


@query("context_domain", "WITH b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x, unnest([0, 1, 2, 3]) AS i) SELECT concat(f.x, c.x, l.x) AS context, CAST(c.i * 16 + f.i * 4 + l.i AS BIGINT) AS ordinal FROM b c, b f, b l")
def context_domain(spark, d):
    return S.contexts(spark, 3)


@query("complete_signature", ", b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x) SELECT concat(f.x, c.x, l.x) AS context, round(coalesce(total_norm, 0), 9) AS total_norm FROM b c CROSS JOIN b f CROSS JOIN b l LEFT JOIN sig3 ON context = concat(f.x, c.x, l.x)")
def complete_signature(spark, d):
    return contexts.complete(signature3(spark, d), S.contexts(spark, 3)).select("context", r9("total_norm").alias("total_norm"))


@query("overlap_join", " SELECT site_id, id, least(pos, r_end) - greatest(pos - 1, r_start) AS overlap FROM pairs")
def overlap_join(spark, d):
    return pairs(spark, d).select("site_id", "id", "overlap")


@query("overlap_left", " SELECT site_id, count(n.id) AS n FROM sites s LEFT JOIN nuc n ON s.chrom = n.chrom AND s.pos - 1 < n.\"end\" AND n.\"start\" < s.pos GROUP BY 1")
def overlap_left(spark, d):
    joined = intervals.overlap_join(intervals.site_intervals(tables.sites(spark, d)), nucleosomes(spark, d).select("id", "chrom", "start", "end"), how="left", left_longest=1, right_longest=147)
    return joined.groupBy("site_id").agg(F.count_if(F.col("overlap") > 0).alias("n"))


@query("overlap_intervals", " SELECT a.id AS a, b.id AS b, least(a.\"end\", b.\"end\") - greatest(a.\"start\", b.\"start\") AS overlap FROM nuc a JOIN nuc b ON a.chrom = b.chrom AND a.id < b.id AND a.\"start\" < b.\"end\" AND b.\"start\" < a.\"end\"")
def overlap_intervals(spark, d):
    n = nucleosomes(spark, d).select("id", "chrom", "start", "end")
    joined = intervals.overlap_join(n.withColumnRenamed("id", "a"), n.withColumnRenamed("id", "b"), bin_size=256, broadcast=False, left_longest=147, right_longest=147)
    return joined.where("a < b").select("a", "b", "overlap")


_PARTS = ", p AS (SELECT chrom, lang, 1 AS \"start\", 301 AS \"end\", 'end' AS part FROM sizes UNION ALL SELECT chrom, lang, len - 300, len, 'end' FROM sizes UNION ALL SELECT chrom, lang, 302, len - 301, 'middle' FROM sizes)"


@query("telomere_partition", _PARTS + " SELECT part, count(*) AS n FROM sites s JOIN p ON s.chrom = p.chrom AND s.pos - 1 < p.\"end\" AND p.\"start\" < s.pos GROUP BY 1")
def telomere_partition(spark, d):
    parts = intervals.chromosome_ends(tables.sizes(spark, d), 300)
    return intervals.overlap_join(intervals.site_intervals(tables.sites(spark, d)), parts, left_longest=1).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "region_comparison",
    ", seqs AS (SELECT class, seq[\"start\":\"end\" - 1] AS s FROM nuc JOIN genome USING (chrom)), b AS (SELECT class, s[i:i + 2] AS context, count(*) AS ref FROM (SELECT class, s, unnest(range(1, length(s) - 1)) AS i FROM seqs) GROUP BY 1, 2), o AS (SELECT n.class, c3 AS context, count(*) AS n FROM contexts s JOIN nuc n ON s.chrom = n.chrom AND s.pos - 1 < n.\"end\" AND n.\"start\" < s.pos WHERE c3 <> '-' GROUP BY 1, 2), v AS (SELECT o.class, o.context, coalesce(n / CAST(ref AS DOUBLE), 0) AS v FROM o LEFT JOIN b USING (class, context)) SELECT class, round(sum(v * coalesce(total_norm, 0)) / (sqrt(sum(v * v)) * (SELECT sqrt(sum(total_norm * total_norm)) FROM sig3)), 9) AS cosine FROM v LEFT JOIN sig3 USING (context) GROUP BY 1",
)
def region_comparison(spark, d):
    return pipelines.region_comparison(tables.sites(spark, d), tables.genome(spark, d), nucleosomes(spark, d), signature3(spark, d)).select("class", r9("cosine").alias("cosine"))


@query(
    "expected_observed_g",
    ", seqs AS (SELECT seq[\"start\":\"end\" - 1] AS s FROM nuc JOIN genome USING (chrom)), c AS (SELECT s[i:i + 2] AS context, count(*) AS c FROM (SELECT s, unnest(range(1, length(s) - 1)) AS i FROM seqs) GROUP BY 1), e AS (SELECT round_even(sum(round_even(ref_norm * coalesce(c, 0), 2)), 0) AS expected FROM sig3 LEFT JOIN c USING (context)), o AS (SELECT count(*) AS observed FROM pairs WHERE pvalue < 0.05) SELECT observed, expected, round(2 * (observed * ln(2.0 * observed / (observed + expected)) + expected * ln(2.0 * expected / (observed + expected))), 6) AS g FROM o, e",
)
def expected_observed_g(spark, d):
    counts = tracks.kmers_in(nucleosomes(spark, d), tables.genome(spark, d), F.col("start"), F.col("end") - F.col("start"), 3)
    expected = contexts.expected_total(signature3(spark, d), counts)
    met = tracks.observed_in(significant(spark, d), nucleosomes(spark, d), 147)
    observed = met.agg(F.coalesce(F.sum("observed"), F.lit(0)).alias("observed"))
    return statistics.g_test(observed.crossJoin(expected)).select("observed", "expected", r9("g", 6).alias("g"))  # one row each


@query("g_test_p")
def g_test_p(spark, d):
    by = pairs(spark, d).groupBy("class").agg(F.count_if(F.col("strand") == "+").alias("observed"), F.count_if(F.col("strand") == "-").alias("expected"))
    return statistics.g_test(by)


@query("observed_profile", " SELECT pos - r_start AS position, count(*) AS observed FROM pairs GROUP BY 1")
def observed_profile(spark, d):
    return profiles.observed(pairs(spark, d), F.col("pos") - F.col("r_start"))


def _profile_sql(left: int, right: int) -> str:
    width = left + right
    return (
        f", w AS (SELECT id, chrom, center - {left} AS ws, center + {right} AS we FROM regions WHERE center - {left} > 0), pr AS (SELECT s.*, w.id, w.ws FROM sites s JOIN w ON s.chrom = w.chrom AND s.pos - 1 < w.we AND w.ws < s.pos), "
        f"g AS (SELECT id, strand, min(chrom) AS chrom, min(ws) AS ws, count(*) AS n FROM pr GROUP BY 1, 2), q AS (SELECT id, strand, n, CASE WHEN strand = '-' THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS s FROM (SELECT g.*, CASE WHEN ws > 1 THEN seq[ws - 1:ws + {width}] END AS s FROM g JOIN genome USING (chrom)) WHERE length(s) = {width + 2}), "
        "l AS (SELECT id, strand, n, i AS position, s[i:i + 2] AS context FROM (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM q)), p AS (SELECT id, strand, n, position, coalesce(total_norm, 0) AS p FROM l LEFT JOIN sig3 USING (context)), t AS (SELECT *, sum(p) OVER (PARTITION BY id, strand) AS tot FROM p), "
        "e AS (SELECT position, sum(p / tot * n) AS expected FROM t WHERE tot > 0 GROUP BY 1), o AS (SELECT pos - ws AS position, count(*) AS observed FROM pr GROUP BY 1) SELECT position, observed, round(expected, 6) AS expected, round((observed - expected) / expected, 6) AS rel_inc FROM o JOIN e USING (position)"
    )


def _profile(spark, d, left, right):
    out = pipelines.nucleosome_profile(tables.sites(spark, d), tables.regions(spark, d), tables.genome(spark, d), signature3(spark, d), left, right)
    return out.select("position", "observed", r9("expected", 6).alias("expected"), r9("rel_inc", 6).alias("rel_inc"))


@query("relative_increase", _profile_sql(73, 74))
def relative_increase(spark, d):
    return _profile(spark, d, 73, 74)


@query("zoom_out_profile", _profile_sql(500, 501))
def zoom_out_profile(spark, d):
    return _profile(spark, d, 500, 501)


_SEQS = ", ws AS (SELECT id, seq[\"start\":\"end\" - 1] AS s FROM nuc JOIN genome USING (chrom)), ok AS (SELECT * FROM ws WHERE length(s) = 147), comp AS (SELECT i - 1 AS \"offset\", s[i:i] AS kmer, count(*) AS n FROM (SELECT s, unnest(range(1, 148)) AS i FROM ok) GROUP BY 1, 2)"


def window_seqs(spark, d):
    return profiles.window_sequences(nucleosomes(spark, d), tables.genome(spark, d), 147)


@query("position_composition", _SEQS + " SELECT \"offset\", kmer, n FROM comp")
def position_composition(spark, d):
    return profiles.composition(window_seqs(spark, d))


@query("pair_composition", _SEQS + ", two AS (SELECT i - 1 AS \"offset\", s[i:i + 1] AS kmer, count(*) AS n FROM (SELECT s, unnest(range(1, 147)) AS i FROM ok) GROUP BY 1, 2) SELECT \"offset\", kmer, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM two UNION ALL SELECT \"offset\" + 1, kmer, n FROM two) GROUP BY 1, 2")
def pair_composition(spark, d):
    return profiles.pair_composition(window_seqs(spark, d))


@query("chunk_triplets", _SEQS + " SELECT s[i:i + 2] AS kmer, count(*) AS n FROM (SELECT s, unnest(range(1, 148, 3)) AS i FROM ok) GROUP BY 1")
def chunk_triplets(spark, d):
    return profiles.chunk_counts(window_seqs(spark, d))


@query("per_base_enrichment", _SEQS + ", o AS (SELECT pos - r_start AS position, count(*) AS observed FROM pairs GROUP BY 1), v AS (SELECT position, observed / CAST(n AS DOUBLE) AS norm FROM o JOIN comp ON position = \"offset\" + 1 AND kmer = 'G') SELECT position, round(norm, 9) AS norm, round(norm / sum(norm) OVER (), 9) AS norm_2 FROM v")
def per_base_enrichment(spark, d):
    out = profiles.per_base_enrichment(observed_profile(spark, d), position_composition(spark, d), "G", 1)
    return out.select("position", r9("norm").alias("norm"), r9("norm_2").alias("norm_2"))


@query("random_model", _SEQS + ", c AS (SELECT \"offset\" AS position, sum(CASE WHEN kmer = 'G' THEN n ELSE 0 END) AS n FROM comp GROUP BY 1) SELECT position, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS model FROM c")
def random_model(spark, d):
    return profiles.random_model(position_composition(spark, d), "G").select("position", r9("model").alias("model"))


@query("enrichment_in_windows", _SEQS + ", o AS (SELECT c3 AS context, count(*) AS o FROM contexts WHERE c3 <> '-' GROUP BY 1), b AS (SELECT s[i:i + 2] AS kmer, count(*) AS n FROM (SELECT s, unnest(range(1, 148, 3)) AS i FROM ok) GROUP BY 1), r AS (SELECT context, coalesce(o / CAST(n AS DOUBLE), 0) AS v FROM o LEFT JOIN b ON kmer = context) SELECT context, round(v / sum(v) OVER (), 9) AS total_norm FROM r")
def enrichment_in_windows(spark, d):
    observed = contexts.context_counts(contexts.annotate(tables.sites(spark, d), tables.genome(spark, d), (3,)), "context_3")
    return contexts.signature(observed, chunk_triplets(spark, d)).select("context", r9("total_norm").alias("total_norm"))


def _tss_sql(anchor: str) -> str:
    return (
        f", w AS (SELECT id, chrom, {anchor} AS a, {anchor} - 650 AS ws, {anchor} + 650 AS we FROM regions WHERE {anchor} - 650 >= 0), o AS (SELECT pos - a AS rel_pos, count(*) AS count FROM sites s JOIN w ON s.chrom = w.chrom AND s.pos - 1 < w.we AND w.ws < s.pos GROUP BY 1), "
        "q AS (SELECT CASE WHEN ws >= 1 THEN seq[ws:we - 1] ELSE '' END AS s FROM w JOIN genome USING (chrom)), b AS (SELECT i - 650 AS rel_pos, count(*) AS norm_count FROM (SELECT s, unnest(range(1, 1301)) AS i FROM q WHERE length(s) = 1300) WHERE s[i:i] = 'G' GROUP BY 1) "
        "SELECT rel_pos, coalesce(count, 0) AS count, coalesce(norm_count, 0) AS norm_count, round(CASE WHEN norm_count > 0 THEN coalesce(count, 0) / CAST(norm_count AS DOUBLE) END, 9) AS normalized FROM o FULL JOIN b USING (rel_pos)"
    )


def _transcripts(spark, d):
    return tables.regions(spark, d).select("id", "chrom", F.col("center").alias("tss"), (F.col("center") - 20).alias("start"), (F.col("center") + 30).alias("end"), F.col("sign").alias("strand"))


@query("tss_profile", _tss_sql("center"))
def tss_profile(spark, d):
    out = pipelines.transcript_profile(tables.sites(spark, d), _transcripts(spark, d), tables.genome(spark, d))
    return out.withColumn("normalized", r9("normalized"))


@query("tts_profile", _tss_sql("(CASE WHEN sign = 1 THEN center + 30 ELSE center - 20 END)"))
def tts_profile(spark, d):
    out = pipelines.transcript_profile(tables.sites(spark, d), _transcripts(spark, d), tables.genome(spark, d), site="tts")
    return out.withColumn("normalized", r9("normalized"))


@query("bh_adjust", ", c AS (SELECT pvalue, count(*) AS c FROM sites GROUP BY 1), r AS (SELECT pvalue, c, pvalue * sum(c) OVER () / sum(c) OVER (ORDER BY pvalue) AS raw FROM c), q AS (SELECT pvalue, least(1, min(raw) OVER (ORDER BY pvalue ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r) SELECT site_id, round(q, 9) AS q FROM sites JOIN q USING (pvalue)")
def bh_adjust(spark, d):
    return statistics.benjamini_hochberg(tables.sites(spark, d)).select("site_id", r9("q").alias("q"))


@query("top_sites", " SELECT site_id, chrom, pos, strand FROM sites ORDER BY pvalue, chrom, pos, strand, site_id LIMIT 1000")
def top_sites(spark, d):
    return statistics.top_sites(tables.sites(spark, d), 1000, ties=("chrom", "pos", "strand", "site_id")).select("site_id", "chrom", "pos", "strand")


@query("quantile_filter", ", q AS (SELECT quantile_cont(reads, 0.9) AS q FROM sites WHERE reads <> 0) SELECT site_id, reads FROM sites, q WHERE reads <> 0 AND reads > q")
def quantile_filter(spark, d):
    return statistics.above_quantile(tables.sites(spark, d), "reads", 0.9).select("site_id", "reads")


_REPLICATES = ", k AS (SELECT *, concat(chrom, '_', pos) AS k FROM sites), a AS (SELECT * FROM k WHERE replicate = 0), b AS (SELECT * FROM k WHERE replicate = 1)"


def replicate_pair(spark, d):
    rows = tables.sites(spark, d).withColumn("k", F.concat_ws("_", "chrom", "pos"))
    return rows.where("replicate = 0"), rows.where("replicate = 1")


@query("replicate_merge", _REPLICATES + " SELECT a.k, round((a.pvalue + b.pvalue) / 2, 9) AS pvalue, concat(a.strand, '/', b.strand) AS strand FROM a JOIN b USING (k)")
def replicate_merge(spark, d):
    a, b = replicate_pair(spark, d)
    return statistics.replicate_mean(a, b, "k", ["pvalue"], ["strand"]).withColumn("pvalue", r9("pvalue"))


@query("symmetric_difference", _REPLICATES + " SELECT k, site_id FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, site_id FROM b WHERE k NOT IN (SELECT k FROM a)")
def symmetric_difference(spark, d):
    a, b = replicate_pair(spark, d)
    return statistics.symmetric_difference(a, b, "k").select("k", "site_id")


@query("replicate_union", _REPLICATES + " SELECT chrom, pos, strand FROM a UNION SELECT chrom, pos, strand FROM b")
def replicate_union(spark, d):
    a, b = (x.select("chrom", "pos", "strand") for x in replicate_pair(spark, d))
    return a.union(b).distinct()


@query("replicate_intersect", _REPLICATES + " SELECT chrom, pos, strand FROM a INTERSECT SELECT chrom, pos, strand FROM b")
def replicate_intersect(spark, d):
    a, b = (x.select("chrom", "pos", "strand") for x in replicate_pair(spark, d))
    return a.intersect(b)


@query("mask_join", " SELECT flag, strand, count(*) AS n, sum(reads) AS reads FROM sites JOIN mask USING (chrom) GROUP BY 1, 2")
def mask_join(spark, d):
    return intervals.equi_join(tables.sites(spark, d), tables.mask(spark, d), ["chrom"]).groupBy("flag", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("reads").alias("reads"))


@query("open_closed_signature", ", m AS (SELECT c3, CASE WHEN flag > 0 THEN 'open' ELSE 'closed' END AS state FROM contexts JOIN mask USING (chrom)), o AS (SELECT state, c3 AS context, count(*) AS o FROM m WHERE c3 <> '-' GROUP BY 1, 2), r AS (SELECT state, context, o / CAST(n AS DOUBLE) AS v FROM o JOIN bg3 ON kmer = context) SELECT state, context, round(v / sum(v) OVER (PARTITION BY state), 9) AS total_norm FROM r")
def open_closed_signature(spark, d):
    rows = contexts.annotate(tables.sites(spark, d), tables.genome(spark, d), (3,)).join(tables.mask(spark, d), "chrom").withColumn("state", F.when(F.col("flag") > 0, "open").otherwise("closed"))
    sig = contexts.signature(contexts.context_counts(rows, "context_3", ["state"]), contexts.genome_kmer_counts(tables.genome(spark, d), 3), ["state"])
    return sig.select("state", "context", r9("total_norm").alias("total_norm"))


@query("padded_kmers", ", w AS (SELECT class, CASE WHEN \"start\" > 1 THEN seq[\"start\" - 1:\"end\" + 2] ELSE '' END AS s FROM nuc JOIN genome USING (chrom)) SELECT class, s[i:i + 4] AS kmer, count(*) AS n FROM (SELECT class, s, unnest(range(1, length(s) - 3)) AS i FROM w) GROUP BY 1, 2")
def padded_kmers(spark, d):
    return tracks.kmers_in(nucleosomes(spark, d), tables.genome(spark, d), F.col("start") - 1, F.col("end") - F.col("start") + 4, 5, ["class"])


def wide(spark, d):
    return intervals.windows(tables.regions(spark, d), F.col("center"), 200, 200).select("id", "chrom", "center", "start", "end")


_WIDE = ", w AS (SELECT id, chrom, center, center - 200 AS \"start\", center + 200 AS \"end\" FROM regions WHERE center - 200 > 0)"


@query("clean_overlaps", _WIDE + ", n AS (SELECT *, lead(\"start\") OVER p AS ns, lag(\"end\") OVER p AS pe FROM w WINDOW p AS (PARTITION BY chrom ORDER BY \"start\", id)) SELECT id, CASE WHEN pe >= \"start\" THEN \"start\" + (pe - \"start\") // 2 ELSE \"start\" END AS \"start\", CASE WHEN \"end\" >= ns THEN \"end\" - (\"end\" - ns) // 2 ELSE \"end\" END AS \"end\" FROM n")
def clean_overlaps(spark, d):
    return intervals.clean_overlaps(wide(spark, d), ["start", "id"]).select("id", "start", "end")


@query("neighbour_signal", _WIDE + ", n AS (SELECT *, lead(\"start\") OVER p AS ns, lag(\"end\") OVER p AS pe FROM w WINDOW p AS (PARTITION BY chrom ORDER BY id)), f AS (SELECT * FROM n WHERE id < (SELECT max(id) FROM w)), x AS (SELECT unnest(range(0, center + 74 - ns)) AS \"offset\" FROM f WHERE center + 74 > ns UNION ALL SELECT unnest(range(400 - pe + center - 73, 400)) FROM f WHERE center - 73 <= pe) SELECT \"offset\", count(*) AS n FROM x GROUP BY 1")
def neighbour_signal(spark, d):
    return intervals.neighbour_signal(wide(spark, d), order="id")


@query("islands", ", v AS (SELECT DISTINCT chrom, pos FROM sites), g AS (SELECT chrom, pos, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS g FROM v) SELECT chrom, min(pos) AS \"first\", max(pos) AS \"last\", count(*) AS n FROM g GROUP BY chrom, g")
def islands(spark, d):
    return intervals.islands(tables.sites(spark, d), ["chrom"], "pos")


_LANG = ", o AS (SELECT lang, c3 AS context, count(*) AS o FROM contexts JOIN (SELECT chrom, lang FROM sizes) USING (chrom) WHERE c3 <> '-' GROUP BY 1, 2), r AS (SELECT lang, context, o / CAST(n AS DOUBLE) AS v FROM o JOIN bg3 ON kmer = context), s AS (SELECT lang, context, v / sum(v) OVER (PARTITION BY lang) AS t FROM r)"


def by_language(spark, d):
    genome = tables.genome(spark, d)
    return contexts.signature(tracks.contexts_of(tables.sites(spark, d), genome, 3, ["lang"]), contexts.genome_kmer_counts(genome, 3), ["lang"])


@query("cosine_matrix", _LANG + " SELECT a.lang AS \"left\", b.lang AS \"right\", round(sum(a.t * b.t) / (SELECT sqrt(sum(t * t)) FROM s WHERE lang = a.lang) / (SELECT sqrt(sum(t * t)) FROM s WHERE lang = b.lang), 9) AS cosine FROM s a JOIN s b USING (context) GROUP BY 1, 2")
def cosine_matrix(spark, d):
    return statistics.cosine_matrix(by_language(spark, d), "lang").withColumn("cosine", r9("cosine"))


@query("signature_difference", _LANG + ", a AS (SELECT context, t / sum(t) OVER () AS t FROM s WHERE lang = 'en' AND context NOT LIKE '%N%'), b AS (SELECT context, t / sum(t) OVER () AS t FROM s WHERE lang = 'de' AND context NOT LIKE '%N%') SELECT context, round(coalesce(a.t, 0) - coalesce(b.t, 0), 9) + 0.0 AS diff FROM a FULL JOIN b USING (context)")
def signature_difference(spark, d):
    sig = by_language(spark, d)
    out = statistics.difference(sig.where("lang = 'en'"), sig.where("lang = 'de'"), renormalize=True)
    return out.select("context", (r9("diff") + F.lit(0.0)).alias("diff"))


@query("cosine_pair", _LANG + ", x AS (SELECT coalesce(a.t, 0) AS p, coalesce(b.t, 0) AS q FROM (SELECT * FROM s WHERE lang = 'en') a FULL JOIN (SELECT * FROM s WHERE lang = 'fr') b USING (context)) SELECT round(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 9) AS cosine FROM x")
def cosine_pair(spark, d):
    sig = by_language(spark, d)
    return statistics.cosine(sig.where("lang = 'en'"), sig.where("lang = 'fr'")).withColumn("cosine", r9("cosine"))


@query("centre_shares", ", s AS (SELECT context[2:2] AS base, sum(total_norm) AS s FROM sig3 WHERE context NOT LIKE '%N%' GROUP BY 1) SELECT base, round(s / sum(s) OVER (), 2) AS share FROM s")
def centre_shares(spark, d):
    return contexts.centre_shares(signature3(spark, d))


@query("mean_and_spread", " SELECT strand, round(avg(reads), 6) AS mean, round(stddev_samp(reads), 6) AS std FROM sites GROUP BY 1")
def mean_and_spread(spark, d):
    return statistics.mean_and_spread(tables.sites(spark, d), "strand", "reads").select("strand", r9("mean", 6).alias("mean"), r9("std", 6).alias("std"))


#: Chromosomes that the query below leaves out.
_LEFT_OUT = ("3", "17", "40")


@query(
    "enrichment_filters",
    """, top AS (SELECT * FROM contexts ORDER BY pvalue, chrom, pos, strand, site_id LIMIT 9000),
f AS (SELECT * FROM top WHERE CAST(chrom AS VARCHAR) NOT IN ('3', '17', '40') AND base IN ('G', 'A') AND pvalue < 0.03),
r AS (SELECT *, CAST(count(*) OVER (ORDER BY pvalue) AS DOUBLE) AS rank, count(*) OVER () AS n FROM f),
q AS (SELECT *, least(1.0, min(pvalue * n / rank) OVER (ORDER BY pvalue DESC)) AS q FROM r)
SELECT site_id, chrom, pos, strand, round(pvalue, 9) AS pvalue, round(q, 9) AS q FROM q WHERE q <= 0.02""",
)
def enrichment_filters(spark, d):
    """The sites left by top, excluded chromosomes, bases, threshold and multiple testing together, in that order."""
    ties = ("chrom", "pos", "strand", "site_id")
    rows = pipelines.selected(tables.sites(spark, d), tables.genome(spark, d), 0.03, ["G", "A"], 9000, 0.02, _LEFT_OUT, ties)
    return rows.select("site_id", "chrom", "pos", "strand", r9("pvalue").alias("pvalue"), r9("q").alias("q"))


@query(
    "groove_profile",
    """, o AS (SELECT pos - r_start - 74 AS position, count(*) AS observed FROM pairs GROUP BY 1), k AS (SELECT i, 10.3 * i AS w FROM range(1, 8) t(i)),
f AS (SELECT position, observed, min(i * 2 + CASE WHEN abs(position) BETWEEN w - 2.575 AND w + 2.575 THEN 0 ELSE 1 END) AS m
  FROM o LEFT JOIN k ON abs(position) >= w - 2.575 AND abs(position) <= w + 7.725 GROUP BY 1, 2)
SELECT CASE WHEN m IS NULL THEN 'other' WHEN m % 2 = 0 THEN 'out' ELSE 'in' END AS face, count(*) AS positions, CAST(sum(observed) AS BIGINT) AS observed FROM f GROUP BY 1""",
)
def groove_profile(spark, d):
    """Sites by the face of the helix that their place in the window has."""
    rows = observed_profile(spark, d).select((F.col("position") - 74).alias("position"), "observed")
    return rows.groupBy(spectral.groove(F.col("position")).alias("face")).agg(F.count(F.lit(1)).alias("positions"), F.sum("observed").alias("observed"))


@query(
    "zone_profile",
    """, w AS (SELECT id, chrom, center - 500 AS ws, center + 501 AS we FROM regions WHERE center - 500 > 0),
o AS (SELECT s.pos - w.ws - 501 AS position, count(*) AS observed FROM sites s JOIN w ON s.chrom = w.chrom AND s.pos - 1 < we AND ws < s.pos GROUP BY 1),
z AS (SELECT *, CASE WHEN position BETWEEN -127 AND -73 OR position BETWEEN 73 AND 127 THEN 'linker' WHEN position BETWEEN -273 AND 273 THEN 'nucleosome' ELSE 'other' END AS zone FROM o)
SELECT zone, count(*) AS positions, CAST(sum(observed) AS BIGINT) AS observed FROM z GROUP BY 1""",
)
def zone_profile(spark, d):
    """Sites of the wide windows by nucleosome and linker zones around the centre."""
    rows = profiles.observed(pairs(spark, d, 500, 501), F.col("pos") - F.col("r_start") - 501)
    zone = spectral.zone(F.col("position"), [-200.0, 0.0, 200.0]).alias("zone")
    return rows.groupBy(zone).agg(F.count(F.lit(1)).alias("positions"), F.sum("observed").alias("observed"))


@query("significant_sites", " SELECT site_id, chrom, pos, strand, base, c3, c5 FROM contexts WHERE pvalue < 0.05 AND value > 0 AND base IN ('G', 'A') AND c3 NOT LIKE '%N%'")
def significant_sites(spark, d):
    rows = contexts.annotate(significant(spark, d).where("value > 0"), tables.genome(spark, d)).where(F.col("base").isin("G", "A") & ~F.col("context_3").contains("N"))
    return rows.select("site_id", "chrom", "pos", "strand", "base", F.col("context_3").alias("c3"), F.col("context_5").alias("c5"))


_SMOOTH = ", m AS (SELECT i, avg(x) OVER w AS x, count(*) OVER w AS c FROM hourly WINDOW w AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), sm AS (SELECT i, x FROM m WHERE c = 3)"
_DETREND = _SMOOTH + """, z AS (SELECT i, x, i - (SELECT avg(i) FROM sm) AS z FROM sm), q AS (SELECT count(*) AS s0, sum(z) AS s1, sum(z * z) AS s2, sum(z ** 3) AS s3, sum(z ** 4) AS s4, sum(x) AS t0, sum(x * z) AS t1, sum(x * z * z) AS t2 FROM z),
d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM q),
f AS (SELECT (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det AS a0, (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - t1 * s2)) / det AS a1, (s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det AS a2 FROM d),
flat AS (SELECT i, x - a0 - a1 * z - a2 * z * z AS x FROM z, f)"""
_POWER = _DETREND + """, cen AS (SELECT i, x - avg(x) OVER () AS x FROM flat), grid AS (SELECT j, 5 + j * ((50.0 - 5) / 99) AS period FROM range(100) t(j) UNION ALL SELECT -p, p FROM range(5, 50) t(p)),
pw AS (SELECT j, CAST(period AS DOUBLE) AS period, (sum(x * cos(i * 2 * pi() / period)) ** 2 + sum(x * sin(i * 2 * pi() / period)) ** 2) / 400 AS power FROM cen, grid WHERE i BETWEEN 0 AND 399 GROUP BY 1, 2),
spec AS (SELECT j, period, 45 * power / (SELECT sum(power) FROM pw WHERE j < 0) AS power FROM pw WHERE j >= 0)"""


@query("smooth3", _SMOOTH + " SELECT i, round(x, 6) AS x FROM sm")
def smooth3(spark, d):
    return spectral.smooth3(tables.hourly(spark, d)).withColumn("x", r9("x", 6))


@query("detrend", _DETREND + " SELECT i, round(x, 5) AS x FROM flat")
def detrend(spark, d):
    return spectral.detrend(spectral.smooth3(tables.hourly(spark, d))).withColumn("x", r9("x", 5))


@query("spectrum", _POWER + " SELECT j, round(period, 6) AS period, round(power, 6) AS power FROM spec")
def spectrum(spark, d):
    """Over the first 400 hours, as a profile's spectrum is taken over part of its positions; smoothing and detrending use all of them."""
    return spectral.spectrum(tables.hourly(spark, d), 0, 400, 5, 50).select("j", r9("period", 6).alias("period"), r9("power", 6).alias("power"))


_SNR = ", pk AS (SELECT arg_max(period, power) AS peak FROM spec), fg AS (SELECT j, period, power, period BETWEEN peak - 0.25 AND peak + 0.25 AS fore, abs(period - peak) AS d FROM spec, pk), b AS (SELECT median(power) FILTER (NOT fore) AS noise, arg_max(j, power) FILTER (fore) AS bj, max(power) FILTER (fore) AS best, min(j) FILTER (fore) AS f, max(j) FILTER (fore) AS l FROM fg), near AS (SELECT power, period FROM fg WHERE fore ORDER BY d, j LIMIT 1) SELECT round(CASE WHEN bj IN (f, l) THEN near.power ELSE best END / noise, 5) AS snr, round(CASE WHEN bj IN (f, l) THEN near.period ELSE (SELECT period FROM fg WHERE j = bj) END, 6) AS peak FROM b, near"


@query("signal_to_noise", _POWER + _SNR)
def signal_to_noise(spark, d):
    """Of the same spectrum over 400 hours."""
    return spectral.signal_to_noise(spectral.spectrum(tables.hourly(spark, d), 0, 400, 5, 50)).select(r9("snr", 5).alias("snr"), r9("peak", 6).alias("peak"))


@query("ewma", ", s AS (SELECT i, x, row_number() OVER (ORDER BY i) AS r FROM hourly), v AS (SELECT a.i, sum(0.2 * b.x * 0.8 ** (a.r - b.r)) + 0.8 ** (a.r + 1) * (SELECT x FROM s WHERE r = 1) AS x FROM s a JOIN s b ON b.r <= a.r GROUP BY a.i, a.r) SELECT i, round(x, 6) AS x FROM v")
def ewma(spark, d):
    return spectral.ewma(tables.hourly(spark, d)).withColumn("x", r9("x", 6))


_W9 = spectral.savgol_weights(9)


@query("savgol_interior", ", s AS (SELECT i, x, row_number() OVER (ORDER BY i) AS r, count(*) OVER () AS n FROM hourly) SELECT a.i, round(sum(b.x * ([" + ", ".join(f"{w!r}" for w in _W9) + "])[CAST(b.r - a.r + 5 AS INTEGER)]), 5) AS x FROM s a JOIN s b ON b.r BETWEEN a.r - 4 AND a.r + 4 WHERE a.r > 4 AND a.r <= a.n - 4 GROUP BY a.i")
def savgol_interior(spark, d):
    ends = tables.hourly(spark, d)
    inner = ends.withColumn("_r", F.row_number().over(spectral.Window.orderBy("i"))).withColumn("_n", F.count(F.lit(1)).over(spectral.Window.partitionBy())).where("_r > 4 and _r <= _n - 4").select("i")
    return spectral.savgol(ends, 9).join(inner, "i").select("i", r9("x", 5).alias("x"))


_ENDS9 = "[" + ", ".join(f"[{', '.join(f'{w!r}' for w in spectral.savgol_weights(9, 3, at))}]" for at in range(9)) + "]"


@query(
    "savgol",
    f""", s AS (SELECT i, x, CAST(row_number() OVER (ORDER BY i) AS INTEGER) AS r, CAST(count(*) OVER () AS INTEGER) AS n FROM hourly),
p AS (SELECT i, r, least(greatest(r, 5), n - 4) AS mid FROM s)
SELECT p.i, round(sum(s.x * ({_ENDS9})[p.r - mid + 5][s.r - mid + 5]), 5) AS x FROM p JOIN s ON s.r BETWEEN mid - 4 AND mid + 4 GROUP BY p.i""",
)
def savgol(spark, d):
    """The whole signal, both ends by the polynomials of the first and the last window."""
    return spectral.savgol(tables.hourly(spark, d), 9).select("i", r9("x", 5).alias("x"))


@query("groove_phase", "WITH p AS (SELECT CAST(x AS BIGINT) AS position, abs(x) AS a FROM range(-80, 81) t(x)), k AS (SELECT i, 10.3 * i AS w FROM range(1, 8) t(i)), f AS (SELECT position, min(i * 2 + CASE WHEN a BETWEEN w - 2.575 AND w + 2.575 THEN 0 ELSE 1 END) AS m FROM p JOIN k ON a >= w - 2.575 AND a <= w + 7.725 GROUP BY 1) SELECT position, CASE WHEN m IS NULL THEN 'other' WHEN m % 2 = 0 THEN 'out' ELSE 'in' END AS face FROM p LEFT JOIN f USING (position)")
def groove_phase(spark, d):
    return spark.range(-80, 81).select(F.col("id").alias("position"), spectral.groove(F.col("id")).alias("face"))


@query("linker_zone", "WITH p AS (SELECT CAST(x AS BIGINT) AS position FROM range(-400, 401) t(x)) SELECT position, CASE WHEN position BETWEEN -127 AND -73 OR position BETWEEN 73 AND 127 THEN 'linker' WHEN position BETWEEN -273 AND 273 THEN 'nucleosome' ELSE 'other' END AS zone FROM p")
def linker_zone(spark, d):
    return spark.range(-400, 401).select(F.col("id").alias("position"), spectral.zone(F.col("id"), [-200.0, 0.0, 200.0]).alias("zone"))


@query("dense_profile", ", o AS (SELECT pos - r_start AS position, count(*) AS observed FROM pairs GROUP BY 1) SELECT x AS position, coalesce(observed, 0) AS observed FROM range(-10, 160) t(x) LEFT JOIN o ON position = x")
def dense_profile(spark, d):
    return profiles.densify(observed_profile(spark, d), -10, 159, "observed")


@query("multinomial_null")
def multinomial_null(spark, d):
    p = profiles.window_probabilities(profiles.window_groups(pairs(spark, d)), tables.genome(spark, d), signature3(spark, d), 147, arrays=True)
    return statistics.multinomial_null(p, N_RANDOM)


@query("randomised_peak")
def randomised_peak(spark, d):
    found, p = pipelines.randomised_peak(tables.sites(spark, d), tables.regions(spark, d), tables.genome(spark, d), signature3(spark, d), N_RANDOM)
    return found.crossJoin(p)  # one row each


@query("dirichlet_null")
def dirichlet_null(spark, d):
    channels = contexts.complete(signature3(spark, d), S.contexts(spark, 3)).orderBy("ordinal").select("total_norm").collect()  # 64 rows
    return statistics.null_score(statistics.dirichlet_null(spark, [r[0] for r in channels], 10_000), 0.7)


@query("random_subset")
def random_subset(spark, d):
    return statistics.random_subset(tables.sites(spark, d), 500, ["site_id"])


_TRACK = ", tr AS (SELECT id, chrom, center - 10 AS \"start\", center + 10 AS \"end\", CAST(id % 3 - 1 AS DOUBLE) AS occupancy FROM regions WHERE center > 20), st AS (SELECT chrom, \"start\" + 1 AS \"start\", \"end\" + 1 AS \"end\", CASE WHEN occupancy > 0 THEN 'transcribed' ELSE 'silent' END AS state FROM tr WHERE occupancy >= 0)"


@query("transcription_signature", _TRACK + ", w AS (SELECT state, seq[\"start\":\"end\" + 1] AS s FROM st JOIN genome USING (chrom) WHERE \"start\" <= length(seq)), b AS (SELECT state, s[i:i + 2] AS context, count(*) AS ref FROM (SELECT state, s, unnest(range(1, length(s) - 1)) AS i FROM w) GROUP BY 1, 2), o AS (SELECT st.state, c3 AS context, count(*) AS n FROM contexts s JOIN st ON s.chrom = st.chrom AND s.pos - 1 < st.\"end\" AND st.\"start\" < s.pos WHERE c3 <> '-' GROUP BY 1, 2), v AS (SELECT o.state, o.context, coalesce(n / CAST(ref AS DOUBLE), 0) AS v FROM o LEFT JOIN b USING (state, context)) SELECT state, context, round(v / sum(v) OVER (PARTITION BY state), 9) AS total_norm FROM v")
def transcription_signature(spark, d):
    track = tables.regions(spark, d).where("center > 20").select("chrom", (F.col("center") - 10).alias("start"), (F.col("center") + 10).alias("end"), (F.col("id") % 3 - 1).cast("double").alias("occupancy"))
    return pipelines.transcription_signature(tables.sites(spark, d), track, tables.genome(spark, d)).withColumn("total_norm", r9("total_norm"))


@query("pipeline_schema", " SELECT chrom, pos, base, strand, c5 AS mer, CAST(0 AS BIGINT) AS min_coverage, CAST(0 AS DOUBLE) AS untreated_freq, CAST(0 AS DOUBLE) AS treated_freq, pvalue AS value, c5 AS context_5, c3 AS context_3 FROM contexts WHERE pvalue < 0.05")
def pipeline_schema(spark, d):
    return pipelines.pipeline_schema(contexts.annotate(significant(spark, d), tables.genome(spark, d)))


@query("detector_sites", "WITH x AS (SELECT concat(l_orderkey, '_', l_linenumber) AS id, l_returnflag AS chrm, l_suppkey AS p, CAST(l_linenumber AS INTEGER) AS e FROM lineitem) SELECT id, CASE WHEN chrm = 'N' THEN 'chrM' ELSE concat('chr', chrm) END AS chrom, p AS pos, round(10.0::DOUBLE ** -e, 9) AS pvalue FROM x")
def detector_sites(spark, d):
    rows = tables.load(spark, d, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("strand"), F.when(F.col("l_returnflag") == "N", "Mito").otherwise(F.col("l_returnflag")).alias("chrm"), F.col("l_suppkey").alias("end"), F.concat(F.lit("site: "), F.col("l_linenumber").cast("string")).alias("reg_text")
    )
    return readers.detector(rows).select(F.col("strand").alias("id"), "chrom", "pos", r9("pvalue").alias("pvalue"))


_READS = "WITH r AS (SELECT l_orderkey, l_partkey AS chrom, l_suppkey AS s, l_suppkey + CAST(l_quantity AS BIGINT) AS e, l_linenumber AS n, (l_orderkey * 37 + l_linenumber * 101) % 2048 AS flag, l_partkey % 60 AS mapq FROM lineitem)"


def _alignments(spark, d):
    rows = tables.load(spark, d, "lineitem")
    return rows.select("l_orderkey", F.col("l_partkey").alias("chrom"), F.col("l_suppkey").alias("start"), (F.col("l_suppkey") + F.col("l_quantity").cast("long")).alias("end"), F.col("l_linenumber").alias("n"), ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101) % 2048).alias("flag"), (F.col("l_partkey") % 60).alias("mapq"))


@query("read_statistics", _READS + " SELECT count(*) AS n, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 2 = 2) AS proper, count(*) FILTER (flag & 12 = 12) AS pair_unmapped, count(*) FILTER (flag & 1024 = 1024) AS duplicates, count(*) FILTER (flag & 256 = 256) AS secondary, count(*) FILTER (mapq >= 30) AS good FROM r")
def read_statistics(spark, d):
    return reads.statistics(_alignments(spark, d))


@query("read_sites", _READS + ", p AS (SELECT chrom, CASE WHEN flag & 16 = 16 THEN CASE WHEN e <> 60 THEN e + 1 END ELSE CASE WHEN s <> 0 THEN s - 1 END END AS pos, CASE WHEN flag & 16 = 16 THEN '-' ELSE '+' END AS strand FROM r WHERE flag & 64 = 64 AND flag & 256 = 0) SELECT chrom, pos, strand, count(*) AS n FROM p WHERE pos IS NOT NULL GROUP BY 1, 2, 3")
def read_sites(spark, d):
    a = _alignments(spark, d)
    flags = a.select("chrom", "start", "end", reads.has("flag", reads.REVERSE).alias("is_reverse"), reads.has("flag", reads.FIRST).alias("is_read1"), reads.has("flag", reads.SECONDARY).alias("is_secondary"), F.lit(60).cast("long").alias("chrom_len"))
    return readers.read_sites(flags).groupBy("chrom", "pos", "strand").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_read_pairs", _READS + " SELECT count(*) AS n FROM (SELECT DISTINCT s, e FROM r WHERE flag & 2 = 2)")
def distinct_read_pairs(spark, d):
    return reads.distinct_pairs(reads.proper_pairs(_alignments(spark, d)), "start", "end").agg(F.count(F.lit(1)).alias("n"))


@query("read_subset", _READS + " SELECT l_orderkey, n FROM r WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def read_subset(spark, d):
    ids = tables.load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return reads.subset(_alignments(spark, d), ids, "l_orderkey").select("l_orderkey", "n")


@query("adapter_filter", "SELECT c_custkey FROM customer WHERE NOT starts_with(c_mktsegment, 'AUTOMOBILE')")
def adapter_filter(spark, d):
    return reads.without_adapter(tables.load(spark, d, "customer"), "xAUTOMOBILE", 9, ("c_mktsegment",)).select("c_custkey")


@query(
    "adapter_names",
    """WITH n AS (SELECT DISTINCT p_name AS t FROM part), a AS (SELECT 'greet widget' AS a, 12 AS m),
whole AS (SELECT DISTINCT t FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM n), (SELECT unnest(range(10, 15)) AS l), a WHERE levenshtein(a, substr(t, i, l)) <= 2),
part_ AS (SELECT DISTINCT t FROM n, (SELECT unnest(range(4, 12)) AS k), (SELECT unnest(range(0, 15)) AS j), a WHERE levenshtein(right(a, k), left(t, j)) <= CAST(floor(0.2 * k) AS INTEGER)),
o AS (SELECT t FROM n WHERE t NOT IN (SELECT t FROM whole) AND t NOT IN (SELECT t FROM part_))
SELECT p_partkey FROM part JOIN o ON p_name = t""",
)
def adapter_names(spark, d):
    """Parts whose name has no match of an adapter, with errors, as a whole anywhere or with a suffix at the start."""
    return adapters.without_adapter(tables.load(spark, d, "part").select("p_partkey", "p_name"), "greet widget", ("p_name",), 0.2, 4).select("p_partkey")


@query("adapter_alignment")
def adapter_alignment(spark, d):
    """An adapter cut off the whole texts, up to five times, with an error in ten letters; tests compare with alignments by brute force."""
    rows = tables.load(spark, d, "documents").select("doc_id", "text")
    cut = adapters.trimmed(rows, "the and of th", ("text",), 0.16, 9)
    return cut.select("doc_id", F.col("rounds_text").alias("rounds"), F.length("trimmed_text").alias("left"))


_TWO_SAMPLE = """WITH r AS (SELECT l_returnflag AS chrom, l_linestatus AS strand, l_suppkey AS pos, l_linenumber % 2 = 1 AS treated, l_quantity AS level FROM lineitem),
c AS (SELECT chrom, strand, pos, level, CAST(count(*) FILTER (treated) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT treated) AS DOUBLE) AS b FROM r GROUP BY ALL),
p AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER s AS na, sum(b) OVER s AS nb FROM c
  WINDOW w AS (PARTITION BY chrom, strand, pos ORDER BY level), s AS (PARTITION BY chrom, strand, pos)),
t AS (SELECT chrom, strand, pos, max(na) AS n, max(nb) AS m, sum(a * (cb - b) + a * b / 2) AS u, max(abs(ca / na - cb / nb)) AS ks, sum((a + b) ** 3 - (a + b)) AS ties
  FROM p WHERE na >= 20 AND nb >= 20 GROUP BY ALL),
z AS (SELECT *, (u - n * m / 2) / sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1)))) AS z, ks * sqrt(n * m / (n + m)) AS x FROM t),
k AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 51), lambda i: (CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * i * i * x * x))))) END AS p_ks FROM z),
f AS (SELECT chrom, strand, pos + o AS pos, sum(-ln(greatest(p_ks, 2.3e-308))) AS h, count(*) AS nc FROM k, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) GROUP BY ALL)
SELECT k.chrom, k.strand, k.pos, CAST(n AS BIGINT) AS n_treated, CAST(m AS BIGINT) AS n_control, u, round(z, 9) AS z, round(ks, 9) AS ks, round(p_ks, 9) AS p_ks, nc AS n_combined,
  round(least(1.0, exp(-h) * list_sum(list_transform(range(0, 5), lambda i: CASE WHEN nc > i THEN h ** i / [1, 1, 2, 6, 24][i + 1] ELSE 0.0 END))), 9) AS p_combined
FROM k JOIN f ON k.chrom = f.chrom AND k.strand = f.strand AND k.pos = f.pos"""


@query("two_sample_sites", _TWO_SAMPLE)
def two_sample_sites(spark, d):
    """Two samples of reads at each site: rank sums, distances of their distributions, and these combined over five neighbouring sites."""
    rows = tables.load(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("chrom"), F.col("l_linestatus").alias("strand"), F.col("l_suppkey").alias("pos"), (F.col("l_linenumber") % 2 == 1).alias("treated"), F.col("l_quantity").alias("level")
    )
    tested = levels.fisher(levels.two_sample(rows))
    return tested.select("chrom", "strand", "pos", "n_treated", "n_control", "u", *[r9(c).alias(c) for c in ("z", "ks", "p_ks")], "n_combined", r9("p_combined").alias("p_combined"))


@query("spline_profile")
def spline_profile(spark, d):
    """A smoothing spline through the relative increase, its penalty by cross-validation; tests compare with a dense solve."""
    rows = pipelines.nucleosome_profile(tables.sites(spark, d), tables.regions(spark, d), tables.genome(spark, d), signature3(spark, d))
    return smoothing.spline(rows.select(F.col("position").alias("i"), F.col("rel_inc").alias("x"))).select("i", r9("x", 6).alias("x"), r9("penalty", 3).alias("penalty"))


@query(
    "value_density",
    """WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) * CAST(count(*) AS DOUBLE) ** -0.2 AS h, min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL GROUP BY 1),
g AS (SELECT *, lo - 3 * h AS a, (hi + 3 * h - (lo - 3 * h)) / 199 AS step FROM s), p AS (SELECT *, unnest(range(200)) AS j FROM g)
SELECT p.event_type, j, round(a + j * step, 6) AS at, round(sum(CASE WHEN abs(a + j * step - value) <= 5 * h THEN exp(-0.5 * power((a + j * step - value) / h, 2)) ELSE 0 END) / (max(n) * max(h) * sqrt(2 * pi())), 9) AS density
FROM p JOIN events e ON e.event_type = p.event_type AND value IS NOT NULL GROUP BY p.event_type, j, a, step""",
)
def value_density(spark, d):
    """The density of the values of each type of event."""
    rows = smoothing.density(tables.load(spark, d, "events"), "value", ["event_type"])
    return rows.select("event_type", "j", r9("at", 6).alias("at"), r9("density").alias("density"))


#: Bases of a chromosome's ends in the telomere queries, as in the analyses they repeat.
END = 30_000


def region_sets(spark, d):
    """(region_set, chrom, start, end): both ends of 30,000 bases of each chromosome and what lies between, and the nucleosomes by class."""
    ends = structures.clipped(intervals.chromosome_ends(tables.sizes(spark, d), END).join(tables.sizes(spark, d).select("chrom", "len"), "chrom"))
    names = F.when(F.col("part") == "end", "Subtelomeric").otherwise("Non subtelomeric")
    named = nucleosomes(spark, d).select(F.col("class").alias("region_set"), "chrom", "start", "end")
    return ends.select(names.alias("region_set"), "chrom", "start", "end").unionByName(named)


_SETS = f"""
, ends AS (SELECT chrom, len, 1 AS s, {END + 1} AS e, 'Subtelomeric' AS region_set FROM sizes UNION ALL SELECT chrom, len, len - {END}, len, 'Subtelomeric' FROM sizes
  UNION ALL SELECT chrom, len, {END + 2}, len - {END + 1}, 'Non subtelomeric' FROM sizes),
rs AS (SELECT region_set, chrom, greatest(s, 1) AS s, least(e, len + 1) AS e FROM ends WHERE greatest(s, 1) < least(e, len + 1) UNION ALL SELECT class, chrom, "start", "end" FROM nuc),
rseq AS (SELECT region_set, seq[s:e - 1] AS q FROM rs JOIN genome USING (chrom))"""


def _set_signature_sql(k: int) -> str:
    return f"""
, rb{k} AS (SELECT region_set, q[i:i + {k - 1}] AS context, count(*) AS ref FROM (SELECT region_set, q, unnest(range(1, length(q) - {k - 2})) AS i FROM rseq) GROUP BY 1, 2),
ro{k} AS (SELECT region_set, c{k} AS context, count(*) AS n FROM contexts x JOIN rs ON x.chrom = rs.chrom AND x.pos - 1 < rs.e AND rs.s < x.pos WHERE c{k} <> '-' GROUP BY 1, 2),
rv{k} AS (SELECT region_set, context, coalesce(n / CAST(ref AS DOUBLE), 0) AS v FROM ro{k} LEFT JOIN rb{k} USING (region_set, context)),
w{k} AS (SELECT c{k} AS context, count(*) / CAST(any_value(b.n) AS DOUBLE) AS v FROM contexts JOIN bg{k} b ON b.kmer = c{k} WHERE c{k} <> '-' GROUP BY 1),
rc{k} AS (SELECT region_set, sum(rv{k}.v * coalesce(w{k}.v, 0)) / (sqrt(sum(rv{k}.v * rv{k}.v)) * (SELECT sqrt(sum(v * v)) FROM w{k})) AS cosine FROM rv{k} LEFT JOIN w{k} USING (context) GROUP BY 1)"""


@query("structure_signatures", _SETS + _set_signature_sql(3) + " SELECT region_set, context, round(v / sum(v) OVER (PARTITION BY region_set), 9) AS total_norm FROM rv3")
def structure_signatures(spark, d):
    sig = structures.region_signatures(tables.sites(spark, d), tables.genome(spark, d), region_sets(spark, d))
    return sig.select("region_set", "context", r9("total_norm").alias("total_norm"))


@query("structure_similarity", _SETS + _set_signature_sql(3) + _set_signature_sql(5) + " SELECT region_set, 'Triplet' AS context, round(cosine, 9) AS cosine FROM rc3 UNION ALL SELECT region_set, 'Pentamer', round(cosine, 9) FROM rc5")
def structure_similarity(spark, d):
    out = structures.structure_similarity(tables.sites(spark, d), tables.genome(spark, d), region_sets(spark, d))
    return out.withColumn("cosine", r9("cosine"))


@query(
    "structure_observed",
    _SETS + ", rb AS (SELECT region_set, q[i:i + 2] AS kmer, count(*) AS n FROM (SELECT region_set, q, unnest(range(1, length(q) - 1)) AS i FROM rseq) GROUP BY 1, 2), "
    "e AS (SELECT region_set, round_even(sum(round_even(ref_norm * n, 2)), 0) AS expected FROM rb JOIN sig3 ON context = kmer GROUP BY 1), "
    "o AS (SELECT region_set, count(*) AS observed FROM sites x JOIN rs ON x.chrom = rs.chrom AND x.pos - 1 < rs.e AND rs.s < x.pos WHERE pvalue < 0.05 GROUP BY 1) "
    "SELECT region_set, observed, expected, round(2 * (observed * ln(2.0 * observed / (observed + expected)) + expected * ln(2.0 * expected / (observed + expected))), 5) AS g FROM o JOIN e USING (region_set)",
)
def structure_observed(spark, d):
    out = structures.observed_expected(significant(spark, d), tables.genome(spark, d), region_sets(spark, d), signature3(spark, d))
    return out.select("region_set", "observed", "expected", r9("g", 5).alias("g"))


@query(
    "linker_model",
    ", w AS (SELECT id, chrom, center - 200 AS ws, center + 200 AS we FROM regions WHERE center - 200 > 0), q AS (SELECT seq[ws:we - 1] AS s FROM w JOIN genome USING (chrom)), "
    "c AS (SELECT i - 1 AS position, count(*) FILTER (s[i:i] = 'G') AS g, count(*) AS n FROM (SELECT s, unnest(range(1, 401)) AS i FROM q WHERE length(s) = 400) GROUP BY 1), "
    "o AS (SELECT we - pos AS position, count(*) AS observed FROM contexts x JOIN w ON x.chrom = w.chrom AND x.pos - 1 < w.we AND w.ws < x.pos WHERE base = 'G' GROUP BY 1), "
    "v AS (SELECT position, observed / CAST(g AS DOUBLE) AS norm FROM o JOIN c USING (position) WHERE g > 0), m AS (SELECT position, g / CAST(sum(g) OVER () AS DOUBLE) AS model FROM c) "
    "SELECT position, round(norm, 9) AS norm, round(norm_2, 9) AS norm_2, round(model, 9) AS model FROM (SELECT position, norm, norm / sum(norm) OVER () AS norm_2 FROM v) JOIN m USING (position)",
)
def linker_model(spark, d):
    around, genome = wide(spark, d), tables.genome(spark, d)
    comp = tracks.composition_in(around, genome, 400)
    observed = tracks.observed_in(tables.sites(spark, d), around, 400, genome, "G").withColumn("position", 400 - F.col("position"))
    enriched = profiles.per_base_enrichment(observed, comp, "G")
    out = profiles.with_model(enriched, profiles.random_model(comp, "G"))
    return out.select("position", *[r9(c).alias(c) for c in ("norm", "norm_2", "model")])


@query("motif_sites", ", m AS (SELECT site_id, seq[pos - 10:pos + 10] AS mer FROM sites JOIN genome USING (chrom) WHERE pos > 10) SELECT site_id, mer FROM m WHERE length(mer) = 21 AND (mer[11:12] = 'GA' OR mer[10:11] = 'GA')")
def motif_sites(spark, d):
    rows = contexts.with_sequence(tables.sites(spark, d).where("pos > 10"), tables.genome(spark, d), F.col("pos") - 10, 21, "mer").where(F.length("mer") == 21)
    return profiles.of_study(rows, "GA").select("site_id", "mer")


@query("restricted_cosine", _LANG + ", k AS (SELECT context FROM s WHERE lang = 'fr' AND t >= 0), x AS (SELECT coalesce(a.t, 0) AS p, coalesce(b.t, 0) AS q FROM (SELECT * FROM s WHERE lang = 'en' AND context IN (FROM k)) a FULL JOIN (SELECT * FROM s WHERE lang = 'de' AND context IN (FROM k)) b USING (context)) SELECT round(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 9) AS cosine FROM x")
def restricted_cosine(spark, d):
    sig = by_language(spark, d)
    keys = statistics.with_background(sig.where("lang = 'fr'"), "total_norm")
    one, two = (statistics.restricted(sig.where(F.col("lang") == x), keys) for x in ("en", "de"))
    return statistics.cosine(one, two).withColumn("cosine", r9("cosine"))


@query("strand_transcription", _TRACK + ", w AS (SELECT state, seq[\"start\":\"end\" + 1] AS s FROM st JOIN genome USING (chrom) WHERE \"start\" <= length(seq)), b AS (SELECT state, s[i:i + 2] AS context, count(*) AS ref FROM (SELECT state, s, unnest(range(1, length(s) - 1)) AS i FROM w) GROUP BY 1, 2), o AS (SELECT st.state, c3 AS context, count(*) AS n FROM contexts s JOIN st ON s.chrom = st.chrom AND s.pos - 1 < st.\"end\" AND st.\"start\" < s.pos WHERE c3 <> '-' AND s.strand = '+' GROUP BY 1, 2), v AS (SELECT o.state, o.context, coalesce(n / CAST(ref AS DOUBLE), 0) AS v FROM o LEFT JOIN b USING (state, context)) SELECT state, context, round(v / sum(v) OVER (PARTITION BY state), 9) AS total_norm FROM v")
def strand_transcription(spark, d):
    track = tables.regions(spark, d).where("center > 20").select("chrom", (F.col("center") - 10).alias("start"), (F.col("center") + 10).alias("end"), (F.col("id") % 3 - 1).cast("double").alias("occupancy"))
    return pipelines.transcription_signature(structures.on_strand(tables.sites(spark, d), "plus"), track, tables.genome(spark, d)).withColumn("total_norm", r9("total_norm"))


@query("recentred_profile", ", w AS (SELECT id, chrom, center - 500 AS ws, center + 501 AS we FROM regions WHERE center - 500 > 0) SELECT pos - ws - 501 AS position, count(*) AS observed FROM sites s JOIN w ON s.chrom = w.chrom AND s.pos - 1 < w.we AND w.ws < s.pos GROUP BY 1")
def recentred_profile(spark, d):
    return profiles.recentred(profiles.observed(pairs(spark, d, 500, 501), F.col("pos") - F.col("r_start")), 501)


@query(
    "coverage_signal",
    _WIDE + ', n AS (SELECT *, lead("start") OVER p AS ns, lag("end") OVER p AS pe FROM w WINDOW p AS (PARTITION BY chrom ORDER BY id)), f AS (SELECT * FROM n WHERE id < (SELECT max(id) FROM w)), '
    'x AS (SELECT unnest(range(0, center + 74 - ns)) AS "offset" FROM f WHERE center + 74 > ns UNION ALL SELECT unnest(range(400 - pe + center - 73, 400)) FROM f WHERE center - 73 <= pe), c AS (SELECT "offset", count(*) AS n FROM x GROUP BY 1) '
    'SELECT i AS "offset", coalesce(n / CAST((SELECT count(*) FROM w) AS DOUBLE), 1.0) AS signal FROM range(400) t(i) LEFT JOIN c ON "offset" = i',
)
def coverage_signal(spark, d):
    return intervals.coverage_signal(wide(spark, d), order="id")


@query(
    "read_bases",
    _READS + ", p AS (SELECT chrom, CASE WHEN flag & 16 = 16 THEN CASE WHEN e <> 60 THEN e + 1 END ELSE CASE WHEN s <> 0 THEN s - 1 END END AS pos, CASE WHEN flag & 16 = 16 THEN '-' ELSE '+' END AS strand FROM r WHERE flag & 64 = 64 AND flag & 256 = 0), "
    "g AS (SELECT doc_id AS chrom, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAN') AS seq FROM documents), "
    "b AS (SELECT strand, CASE WHEN pos >= 1 AND length(seq[pos:pos]) = 1 THEN seq[pos:pos] ELSE 'N' END AS base FROM p LEFT JOIN g USING (chrom) WHERE pos IS NOT NULL) "
    "SELECT strand, CASE WHEN strand = '-' THEN translate(base, 'ACGT', 'TGCA') ELSE base END AS base, count(*) AS n FROM b GROUP BY 1, 2",
)
def read_bases(spark, d):
    a = _alignments(spark, d)
    flags = a.select("chrom", "start", "end", reads.has("flag", reads.REVERSE).alias("is_reverse"), reads.has("flag", reads.FIRST).alias("is_read1"), reads.has("flag", reads.SECONDARY).alias("is_secondary"), F.lit(60).cast("long").alias("chrom_len"))
    return pipelines.read_bases(readers.read_sites(flags), tables.genome(spark, d)).groupBy("strand", "base").agg(F.count(F.lit(1)).alias("n"))
