"""Queries of scoring, comparison and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibrate as C
from ..operators import compare as P
from ..operators import metrics as M
from ..operators import resample as B
from .fixtures import manifest, results, with_eval
from .registry import register

_Q = """, f AS (SELECT query_id, min(CASE WHEN r0.predicted_ref_id = m.ref_id THEN rank END) first_rank, max(CASE WHEN rank = 1 THEN ref_start - query_start END) spot
  FROM r0 JOIN manifest m USING (query_id) GROUP BY 1),
 pq AS (SELECT m.*, first_rank, f.query_id IS NOT NULL answered, CASE WHEN first_rank = 1 THEN abs(spot - offset_sec) END err FROM manifest m LEFT JOIN f USING (query_id)) """
_E = with_eval() + _Q


def _pq(spark, d):
    return M.per_query(results(spark, d), manifest(spark, d))


def _wilson(k, n):
    s = f"greatest({n}, 1)::DOUBLE"
    p = f"({k} / {s})"
    c = f"(({p} + 1.96::DOUBLE * 1.96 / (2 * {s})) / (1 + 1.96::DOUBLE * 1.96 / {s}))"
    h = f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {s} + 1.96::DOUBLE * 1.96 / (4 * {s} * {s})) / (1 + 1.96::DOUBLE * 1.96 / {s}))"
    return f"CASE WHEN {n} > 0 THEN greatest(0, {c} - {h})::DOUBLE ELSE 0::DOUBLE END", f"CASE WHEN {n} > 0 THEN least(1, {c} + {h})::DOUBLE ELSE 0::DOUBLE END"


_MC = "round(CASE WHEN b + c = 0 THEN 1::DOUBLE ELSE least(1::DOUBLE, 2 * list_sum(list_transform(range(0, least(b, c)::BIGINT + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2::DOUBLE))))) END, 8)"


@register("AGG-1 FLT-1 FLT-2 JOIN-1 JOIN-5", _E + "SELECT query_id, first_rank, answered FROM pq")
def first_ranks(spark, d):
    return _pq(spark, d).select("query_id", "first_rank", "answered")


@register("AGG-2", _E + "SELECT count(*) n, count_if(first_rank <= 10) contributing, round(sum(CASE WHEN first_rank <= 10 THEN 1.0 / first_rank ELSE 0 END)::DOUBLE / count(*), 6) mrr FROM pq")
def mrr(spark, d):
    return _pq(spark, d).agg(F.count("*").alias("n"), F.count_if(M.hit(10)).alias("contributing"), F.round(F.sum(F.when(M.hit(10), 1 / F.col("first_rank")).otherwise(0.0)) / F.count("*"), 6).alias("mrr"))


@register("AGG-3 EVAL-2 JOIN-14 QRK-6 QRK-9", _E + "SELECT corpus, count(*) n, count_if(first_rank <= 1) / count(*) hr_1, count_if(first_rank <= 5) / count(*) hr_5, count_if(first_rank <= 10) / count(*) hr_10 FROM pq GROUP BY 1")
def hit_rates(spark, d):
    n = F.count("*")
    return _pq(spark, d).groupBy("corpus").agg(n.alias("n"), *[(F.count_if(M.hit(k)) / n).alias(f"hr_{k}") for k in (1, 5, 10)])


@register("AGG-4", with_eval() + "SELECT query_id, string_agg(predicted_ref_id::VARCHAR, ',' ORDER BY rank) preds FROM r0 WHERE rank BETWEEN 1 AND 10 GROUP BY 1")
def prediction_lists(spark, d):
    return M.top_predictions(results(spark, d))


@register("EVAL-1 AGG-5 AGG-6 AGG-7 AGG-8 JOIN-13 MTH-1", _E + f"""SELECT grouping, value, count(*) n, count_if(first_rank = 1) hits, count_if(first_rank <= 1) / count(*) hr_1, count_if(first_rank <= 5) / count(*) hr_5, count_if(first_rank <= 10) / count(*) hr_10,
 round(sum(CASE WHEN first_rank <= 10 THEN 1.0::DOUBLE / first_rank ELSE 0 END) / count(*), 9) mrr_10, count_if(NOT answered) no_match,
 round({_wilson('count_if(first_rank = 1)', 'count(*)')[0]}, 9) ci_low, round({_wilson('count_if(first_rank = 1)', 'count(*)')[1]}, 9) ci_high, count_if(NOT answered) / count(*) frac_no_match
 FROM (SELECT 'all' grouping, 'all' AS value, * FROM pq UNION ALL SELECT 'corpus', corpus, * FROM pq UNION ALL SELECT 'has_twin', has_twin::VARCHAR, * FROM pq UNION ALL SELECT 'section_type', section_type, * FROM pq) GROUP BY 1, 2""")  # fmt: skip
def scorecard(spark, d):
    card = M.scorecard(results(spark, d), manifest(spark, d), "corpus", "has_twin", "section_type")
    return card.withColumns({c: F.round(c, 9) for c in ("mrr_10", "ci_low", "ci_high")})


@register("AGG-9 AGG-10 MTH-9 JOIN-2 MTH-11", _E + """SELECT count(err) n_aligned, round(quantile_cont(err, 0.5), 6) median, round(quantile_cont(err, 0.95), 6) p95, round(max(err), 6) max, count_if(err <= 0.05) within_0_05, count_if(err <= 0.5) within_0_5, count_if(err <= 1.0) within_1_0,
 count_if(err <= 0.05) / count(*) rate_within_0_05, count_if(err <= 0.5) / count(*) rate_within_0_5, count_if(err <= 1.0) / count(*) rate_within_1_0 FROM pq""")  # fmt: skip
def alignment(spark, d):
    return M.alignment(results(spark, d), manifest(spark, d)).withColumns({c: F.round(c, 6) for c in ("median", "p95", "max")})


@register("AGG-11", with_eval() + "SELECT round(quantile_cont(latency_ms, 0.5), 6) p50, round(quantile_cont(latency_ms, 0.95), 6) p95, round(quantile_cont(latency_ms, 0.99), 6) p99, round(max(latency_ms), 6) max FROM (SELECT query_id, max(latency_ms) latency_ms FROM r0 GROUP BY 1)")
def latency(spark, d):
    per = results(spark, d).groupBy("query_id").agg(F.max("latency_ms").alias("latency_ms"))
    return M.percentiles(per, "latency_ms", 0.5, 0.95, 0.99).select(*[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "max")])


@register("QRK-12", with_eval() + "SELECT round(quantile_cont(latency_ms, 0.5), 6) p50, round(quantile_cont(latency_ms, 0.95), 6) p95, round(max(latency_ms), 6) max FROM r0")
def row_weighted_latency(spark, d):
    return M.percentiles(results(spark, d), "latency_ms", 0.5, 0.95).select(*[F.round(c, 6).alias(c) for c in ("p50", "p95", "max")])


@register("AGG-35", with_eval() + "SELECT quantile_cont(n, 0.5)::DOUBLE p50, quantile_cont(n, 0.95)::DOUBLE p95, max(n) max FROM (SELECT count(*) n FROM r0 GROUP BY query_id)")
def candidate_counts(spark, d):
    return M.percentiles(results(spark, d).groupBy("query_id").agg(F.count("*").alias("n")), "n", 0.5, 0.95)


_H = "SELECT m.query_id, m.split, m.length_s, coalesce(r.predicted_ref_id = m.ref_id, false) hit FROM manifest m LEFT JOIN (SELECT * FROM {r} WHERE rank = 1) r USING (query_id)"
_PAIR = with_eval(0, 1, 2) + ", " + ", ".join(f"h{s} AS ({_H.format(r=f'r{s}')})" for s in (0, 1, 2)) + ", " + ", ".join(
    f"t{s} AS (SELECT split, length_s, count(*) n, count_if(h0.hit) base_hits, count_if(h{s}.hit) hits, count_if(h0.hit AND NOT h{s}.hit) b, count_if(NOT h0.hit AND h{s}.hit) c FROM h0 JOIN h{s} USING (query_id, split, length_s) GROUP BY 1, 2)" for s in (1, 2)
) + " "


def _hits(spark, d, system):
    return P.hits_at_1(results(spark, d, system), manifest(spark, d))


@register("EVAL-3 JOIN-15 AGG-26 MTH-2 MTH-3", _PAIR + f""", k AS (SELECT split, length_s, count_if(NOT hit) n_miss, count_if(NOT hit AND coalesce(predicted_ref_id % 10 = ref_id % 10, false)) n_miss_same
  FROM (SELECT m.*, r.predicted_ref_id, coalesce(r.predicted_ref_id = m.ref_id, false) hit FROM manifest m LEFT JOIN (SELECT * FROM r1 WHERE rank = 1) r USING (query_id)) GROUP BY 1, 2)
 SELECT split, length_s, n, base_hits, hits, hits / n hr_1, n_miss, n_miss_same, b, c, c - b delta, round({_wilson('hits', 'n')[0]}, 9) ci_low, round({_wilson('hits', 'n')[1]}, 9) ci_high, {_MC} p, {_MC} < 0.05 / 8 significant FROM t1 JOIN k USING (split, length_s)""")  # fmt: skip
def cells(spark, d):
    """One row for each cell; artists are the last digit of a recording."""
    answers = results(spark, d, 1).where("rank = 1").select("query_id", F.col("predicted_ref_id").alias("answer"))
    out = P.miss_table(_hits(spark, d, 0), _hits(spark, d, 1), answers, F.col("answer") % 10 == F.col("ref_id") % 10, "split", "length_s")
    return out.withColumns({"hr_1": F.col("hits") / F.col("n"), "ci_low": F.round("ci_low", 9), "ci_high": F.round("ci_high", 9), "p": F.round("p", 8)})


@register("AGG-27", _PAIR + f", p AS (SELECT split, length_s, sum(n)::BIGINT n, sum(b)::BIGINT b, sum(c)::BIGINT c FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) GROUP BY 1, 2) SELECT *, {_MC} p, {_MC} < 0.05 / 8 significant FROM p")
def pooled(spark, d):
    base = _hits(spark, d, 0)
    one, two = (P.discordant(base, _hits(spark, d, s), "split", "length_s") for s in (1, 2))
    return P.pool(one.union(two), "split", "length_s").withColumn("p", F.round("p", 8))


def _seeds(spark, d):
    return _hits(spark, d, 1).withColumn("seed", F.lit(1)).unionByName(_hits(spark, d, 2).withColumn("seed", F.lit(2)))


@register("EVAL-8", _PAIR + f""", u AS (SELECT *, 1 seed FROM t1 UNION ALL SELECT *, 2 FROM t2),
 p AS (SELECT split, length_s, max(n) n, count(*) seeds, max(base_hits) base_hits, avg(hits) mean_hits, sum(b)::BIGINT b, sum(c)::BIGINT c, string_agg(seed || ':' || hits || ':' || b || ':' || c, ' ' ORDER BY seed) per_seed FROM u GROUP BY 1, 2)
 SELECT split, length_s, n, seeds, base_hits, mean_hits, b, c, per_seed, base_hits / n base_hr, mean_hits / n mean_hr, round((mean_hits / n - base_hits / n) * 100, 9) delta_pp, {_MC} p, {_MC} < 0.05 significant, {_MC} < 0.05 / 8 bonferroni FROM p""")  # fmt: skip
def pooled_table(spark, d):
    out = P.pooled_table(_hits(spark, d, 0), _seeds(spark, d), "split", "length_s")
    each = F.array_join(F.transform("per_seed", lambda s: F.concat_ws(":", s["seed"], s["hits"], s["b"], s["c"])), " ")
    return out.withColumns({"per_seed": each, "p": F.round("p", 8), "delta_pp": F.round("delta_pp", 9)})


@register("EVAL-7", _PAIR + """, s AS (SELECT query_id, bool_and(hit) every, bool_or(hit) some_hit FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1)
 SELECT h0.split, h0.length_s, count(*) n, count_if(hit) base_hits, count_if(NOT hit) base_misses, count_if(NOT hit AND has_twin) base_twin_misses, count_if(NOT some_hit) persistent_misses, count_if(NOT every) any_miss, count_if(every) unanimous_hits,
 count_if(NOT hit AND every) fixed, count_if(hit AND NOT every) broken, count_if(hit AND NOT some_hit) broken_by_all FROM s JOIN h0 USING (query_id) JOIN manifest USING (query_id) GROUP BY 1, 2""")  # fmt: skip
def post_mortem(spark, d):
    return P.post_mortem(_hits(spark, d, 0), _seeds(spark, d), "split", "length_s")


@register("AGG-29 SET-4 SET-5", _PAIR + """, s AS (SELECT query_id, bool_and(hit) every, bool_or(hit) any_hit FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1)
 SELECT count_if(NOT any_hit) persistent_misses, count_if(every) unanimous_hits, count_if(every AND NOT hit) fixed, count_if(NOT any_hit AND hit) broken, count_if(NOT every) any_miss FROM s JOIN h0 USING (query_id)""")  # fmt: skip
def seeds(spark, d):
    return P.across_seeds(_hits(spark, d, 1).union(_hits(spark, d, 2)), _hits(spark, d, 0))


@register("EVAL-6 SET-3", _PAIR + "SELECT CASE WHEN h0.hit AND h1.hit THEN 'common_hit' WHEN h0.hit THEN 'broken' WHEN h1.hit THEN 'fixed' ELSE 'common_miss' END kind, count(*) n FROM h0 JOIN h1 USING (query_id) GROUP BY 1")
def flipped(spark, d):
    return P.flips(_hits(spark, d, 0), _hits(spark, d, 1))


_VAR = _PAIR + """, v AS (SELECT split, length_s, 'alpha_0.00' variant, base_hits / n hr FROM t1 UNION ALL SELECT split, length_s, 'alpha_0.10', hits / n FROM t1 UNION ALL SELECT split, length_s, 'alpha_0.50', hits / n FROM t2) """


def _variants(spark, d):
    parts = [_hits(spark, d, s).groupBy("split", "length_s").agg((F.count_if("hit") / F.count("*")).alias("hr")).withColumn("variant", F.lit(v)) for s, v in ((0, "alpha_0.00"), (1, "alpha_0.10"), (2, "alpha_0.50"))]
    return parts[0].union(parts[1]).union(parts[2])


@register("AGG-30 FLT-9", _VAR + "SELECT split, length_s, hr, variant FROM v WHERE variant LIKE 'alpha%' QUALIFY row_number() OVER (PARTITION BY split, length_s ORDER BY hr DESC, variant) = 1")
def best_alpha(spark, d):
    return P.best_variant(_variants(spark, d).where(F.col("variant").startswith("alpha_")), "split", "length_s")


@register("EVAL-4", _VAR + """SELECT split, length_s, max(CASE WHEN variant = 'alpha_0.00' THEN hr END) "alpha_0.00", max(CASE WHEN variant = 'alpha_0.10' THEN hr END) "alpha_0.10", max(CASE WHEN variant = 'alpha_0.50' THEN hr END) "alpha_0.50" FROM v GROUP BY 1, 2""")
def headline(spark, d):
    return _variants(spark, d).groupBy("split", "length_s").pivot("variant", ["alpha_0.00", "alpha_0.10", "alpha_0.50"]).agg(F.first("hr"))


@register("EVAL-5 AGG-33", _PAIR + f""", g AS (SELECT c - b delta, {_MC} < 0.05 / 8 sig FROM t1 WHERE split = 'main')
 SELECT count_if(delta >= 0) n_not_worse, count_if(sig) n_significant, count_if(sig AND delta < 0) n_regressions, CASE WHEN count_if(delta >= 0) >= 4 AND count_if(sig) >= 2 AND count_if(sig AND delta < 0) = 0 THEN 'PASS' ELSE 'FAIL' END verdict FROM g""")  # fmt: skip
def adoption(spark, d):
    return P.verdict(P.discordant(_hits(spark, d, 0), _hits(spark, d, 1), "split", "length_s").where("split = 'main'"))


@register("EVAL-10", _PAIR + "SELECT split, round(1 - (1 - sum(hits) / sum(n)) / (1 - sum(base_hits) / sum(n)), 9) error_reduction FROM t1 GROUP BY 1")
def error_reduction(spark, d):
    t = P.discordant(_hits(spark, d, 0), _hits(spark, d, 1), "split", "length_s")
    miss = lambda c: 1 - F.sum(c) / F.sum("n")
    return t.groupBy("split").agg(F.round(1 - miss("hits") / miss("base_hits"), 9).alias("error_reduction"))


@register("AGG-28", with_eval() + """, x AS (SELECT m.query_id, m.corpus, m.section_type, m.ref_id t, r.predicted_ref_id p, n.corpus other FROM manifest m JOIN (SELECT * FROM r0 WHERE rank = 1) r USING (query_id)
  LEFT JOIN (SELECT ref_id, min(corpus) corpus FROM manifest GROUP BY 1) n ON n.ref_id = r.predicted_ref_id WHERE r.predicted_ref_id <> m.ref_id)
 SELECT corpus, count(*) n_miss, count_if(t % 10 = p % 10) same_artist, count_if(t % 3 = p % 3) same_raaga, count_if(coalesce(corpus = other, false)) same_corpus, count_if(coalesce(corpus <> other, true)) cross_corpus,
 count_if(section_type = 'alaap') alaap, count_if(section_type = 'composed') composed, count_if(section_type IS NULL) no_section, array_to_string(list_sort(list(query_id))[1:5], ',') examples FROM x GROUP BY 1""")  # fmt: skip
def misses(spark, d):
    top = results(spark, d).where("rank = 1").select("query_id", F.col("predicted_ref_id").alias("p"))
    known = manifest(spark, d).groupBy(F.col("ref_id").alias("p")).agg(F.min("corpus").alias("other"))
    x = manifest(spark, d).join(top, "query_id").where("p <> ref_id").join(known, "p", "left")
    # five examples: the smallest ids, ranked before they are gathered
    few = x.withColumn("n", F.row_number().over(Window.partitionBy("corpus").orderBy("query_id"))).where("n <= 5").groupBy("corpus").agg(F.array_join(F.array_sort(F.collect_list("query_id")).cast("array<string>"), ",").alias("examples"))
    same = F.coalesce(F.col("corpus") == F.col("other"), F.lit(False))
    out = x.groupBy("corpus").agg(
        F.count("*").alias("n_miss"), F.count_if(F.col("ref_id") % 10 == F.col("p") % 10).alias("same_artist"), F.count_if(F.col("ref_id") % 3 == F.col("p") % 3).alias("same_raaga"),
        F.count_if(same).alias("same_corpus"), F.count_if(~same).alias("cross_corpus"),
        F.count_if(F.col("section_type") == "alaap").alias("alaap"), F.count_if(F.col("section_type") == "composed").alias("composed"), F.count_if(F.col("section_type").isNull()).alias("no_section"),
    )
    return out.join(few, "corpus")


_S = with_eval() + ", pos AS (SELECT score FROM r0 JOIN manifest USING (query_id) WHERE rank = 1 AND predicted_ref_id = ref_id), neg AS (SELECT score FROM r0 WHERE rank >= 3) "


def _scores(spark, d):
    r = results(spark, d)
    pos = r.where("rank = 1").join(manifest(spark, d).select("query_id", "ref_id"), "query_id").where("predicted_ref_id = ref_id").select("score")
    return pos, r.where("rank >= 3").select("score")


@register("CAL-1", _S + "SELECT count(*) n, round(avg(score), 6) mean, min(score) low, max(score) high FROM pos")
def in_library(spark, d):
    return _scores(spark, d)[0].agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))


_T = _S + ", t AS (SELECT min(score) + 1e-6 threshold FROM (SELECT score, row_number() OVER (ORDER BY score DESC) n FROM neg) WHERE n <= greatest(1, floor(0.05 * (SELECT count(*) FROM neg)))) "


@register("CAL-2 CAL-4 SORT-4", _T + f""", k AS (SELECT threshold, (SELECT count(*) FROM pos) n_in, (SELECT count(*) FROM pos WHERE score >= threshold) k_in, (SELECT count(*) FROM neg) n_out, (SELECT count(*) FROM neg WHERE score >= threshold) k_out FROM t)
 SELECT round(threshold, 8) threshold, n_in, k_in, n_out, k_out, k_in / n_in tpr, k_out / n_out fpr, round({_wilson('k_in', 'n_in')[0]}, 9) low_in, round({_wilson('k_in', 'n_in')[1]}, 9) high_in, round({_wilson('k_out', 'n_out')[0]}, 9) low_out, round({_wilson('k_out', 'n_out')[1]}, 9) high_out,
 k_in / n_in >= 0.95 AND k_out / n_out <= 0.05 feasible FROM k""")  # fmt: skip
def calibrated(spark, d):
    pos, neg = _scores(spark, d)
    out = C.rates(pos, neg, C.threshold(neg))
    return out.withColumns({c: F.round(c, 9) for c in ("low_in", "high_in", "low_out", "high_out")} | {"threshold": F.round("threshold", 8)})


@register("CAL-3", _S + ", g AS (SELECT i, i / 1000 threshold FROM range(1001) t(i)) SELECT threshold, (SELECT count(*) FROM pos WHERE score >= threshold - 1e-9) / (SELECT count(*) FROM pos) tpr, (SELECT count(*) FROM neg WHERE score >= threshold - 1e-9) / (SELECT count(*) FROM neg) fpr FROM g")
def roc(spark, d):
    return C.roc(*_scores(spark, d))


@register("AGG-19 SNK-13", _S + ", h AS (SELECT least(60, floor(round(score * 60, 6)) + 1)::INT AS bin, count(*) n FROM pos WHERE score BETWEEN 0 AND 1 GROUP BY 1) SELECT bin, n, round(n / ((SELECT sum(n) FROM h) / 60), 9) density FROM h")
def score_histogram(spark, d):
    rounded = _scores(spark, d)[0].select(F.round(F.col("score") + 1e-9, 10).alias("score"))
    return C.histogram(rounded, "score", 0.0, 1.0, 60).withColumn("density", F.round("density", 9))


@register("STR-14", "SELECT event_id, CASE WHEN lower(event_type) LIKE '%click%' THEN 'HIGH' WHEN lower(event_type) LIKE '%view%' THEN 'NO_MATCH' WHEN lower(event_type) LIKE '%error%' THEN 'REJECTED' ELSE 'OTHER' END kind FROM events")
def verdict_text(spark, d):
    from .registry import table

    low = F.lower("event_type")
    kind = F.when(low.contains("click"), "HIGH").when(low.contains("view"), "NO_MATCH").when(low.contains("error"), "REJECTED").otherwise("OTHER")
    return table(spark, d, "events").select("event_id", kind.alias("kind"))


@register("JSN-6", _E + """SELECT corpus, '{"n":' || count(*) || ',"hits":' || count_if(first_rank = 1) || '}' doc FROM pq GROUP BY 1""")
def as_json(spark, d):
    return _pq(spark, d).groupBy("corpus").agg(F.count("*").alias("n"), F.count_if(M.hit(1)).alias("hits")).select("corpus", F.to_json(F.struct("n", "hits")).alias("doc"))


@register("MTH-4", _E + "SELECT corpus, round(count_if(first_rank = 1) / count(*), 4) hr FROM pq GROUP BY 1")
def rounded(spark, d):
    return _pq(spark, d).groupBy("corpus").agg(F.round(F.count_if(M.hit(1)) / F.count("*"), 4).alias("hr"))


@register("SRC-3 FLT-4", with_eval() + "SELECT query_id, rank, score FROM r0 WHERE query_id IN (SELECT query_id FROM manifest WHERE split = 'main' AND length_s = 10)")
def one_cell(spark, d):
    cell = manifest(spark, d).where("split = 'main' and length_s = 10").select("query_id")
    return results(spark, d).join(cell, "query_id", "left_semi").select("query_id", "rank", "score")


@register("QRK-14", with_eval() + "SELECT count(*) n, count(DISTINCT query_id) n_distinct, count_if(query_id IS NULL) n_null FROM manifest")
def uniqueness(spark, d):
    return manifest(spark, d).agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("n_distinct"), F.count_if(F.col("query_id").isNull()).alias("n_null"))




@register("QRK-18", _PAIR + """, r AS (SELECT h0.query_id, h0.hit base_hit, score, h1.hit FROM h0 JOIN h1 USING (query_id) LEFT JOIN (SELECT query_id, score FROM r1 WHERE rank = 1) USING (query_id)),
 g AS (SELECT i, i / 100 threshold FROM range(101) t(i)),
 c AS (SELECT threshold, (SELECT count(*) FROM r WHERE score >= threshold - 1e-9) answered, (SELECT count(*) FROM r WHERE score >= threshold - 1e-9 AND NOT hit) wrong FROM g)
 SELECT threshold, answered, answered / (SELECT count(*) FROM r) coverage, CASE WHEN answered > 0 THEN wrong / answered END risk FROM c""")  # fmt: skip
def risk_and_coverage(spark, d):
    """Share of queries answered, and of wrong ones among them, at each threshold of the first answer's score."""
    top = results(spark, d, 1).where("rank = 1").select("query_id", "score")
    return B.risk_coverage(_hits(spark, d, 1).join(top, "query_id", "left").select("score", "hit"))


_DRAWS = f"""{_PAIR}, w AS (SELECT ('0x' || substr(sha256('20260511:' || query_id), 1, 13))::BIGINT % {B.PRIME} h, h0.hit::INT x, h1.hit::INT y FROM h0 JOIN h1 USING (query_id)),
 m AS (SELECT i, (('0x' || substr(s, 1, 16))::UBIGINT % {B.PRIME - 1})::BIGINT + 1 a, (('0x' || substr(s, 17, 16))::UBIGINT % {B.PRIME})::BIGINT b FROM (SELECT i, sha256('20260511:' || i) s FROM range({B.REPLICATES}) t(i))),
 k AS (SELECT i, x, y, {' + '.join(f'(u >= {s})::INT' for s in B.poisson_steps())} n FROM (SELECT i, x, y, (h * a + b) % {B.PRIME} u FROM w, m)),
 r AS (SELECT i, (sum(n * y) - sum(n * x)) / sum(n) d FROM k GROUP BY 1 HAVING sum(n) > 0)"""


@register("QRK-18.bootstrap", _DRAWS + " SELECT (SELECT count(*) FROM w) n, (SELECT round(avg(y) - avg(x), 9) FROM w) delta, round(quantile_cont(d, 0.025), 9) low, round(quantile_cont(d, 0.975), 9) high, count(*) replicates FROM r")
def bootstrapped(spark, d):
    """The difference of two systems' hit rates, with a paired bootstrap interval of 5,000 replicates."""
    pairs = _hits(spark, d, 0).select("query_id", F.col("hit").alias("base_hit")).join(_hits(spark, d, 1).select("query_id", "hit"), "query_id")
    return B.paired_bootstrap(pairs).withColumns({c: F.round(c, 9) for c in ("delta", "low", "high")})
