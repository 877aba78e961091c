"""Queries over news, event records and scoring runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import corpus, percentiles, runs, selection, stats, timeline
from tidemark.plans.demo import NEWS, RECORDS, RUNS, SCORED, event_records, news, run, scored
from tidemark.plans.registry import query, rounded
from tidemark.sources.readers import table

TYPES = [f"t{i}" for i in range(10)]


@query(f"WITH {NEWS} SELECT doc_id, CASE WHEN date_only THEN published // 86400 * 86400 + 86400 ELSE published END AS available FROM n")
def prj02_available(spark, d):
    return news(spark, d).select("doc_id", corpus.available(F.col("published"), F.col("date_only")).alias("available"))


@query(f"""WITH {NEWS}, k AS (SELECT *, CASE WHEN length(headline) < 5 THEN 'short' WHEN NOT url LIKE '%/src1%' AND NOT url LIKE '%.src%' AND n_chars > 5000 THEN 'host' WHEN published % 86400 < 3600 THEN 'time' END AS reason FROM n)
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM k GROUP BY 1""")
def prj03_admission(spark, d):
    rules = [("short", F.length("headline") >= 5), ("host", F.col("url").like("%/src1%") | F.col("url").like("%.src%") | (F.col("n_chars") <= 5000)), ("time", F.col("published") % 86400 >= 3600)]
    return news(spark, d).select(F.coalesce(corpus.first_reason(rules), F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RECORDS}, k AS (SELECT unnest(list_filter([CASE WHEN severity < 0.1::DOUBLE THEN 'weak' END, CASE WHEN confidence < 0.6::DOUBLE THEN 'unsure' END, CASE WHEN status <> 'success' THEN 'failed' END], lambda x: x IS NOT NULL)) AS reason FROM r)
SELECT reason, count(*) AS n FROM k GROUP BY 1""")
def prj04_all_reasons(spark, d):
    rules = [("weak", F.col("severity") >= 0.1), ("unsure", F.col("confidence") >= 0.6), ("failed", F.col("status") == "success")]
    return event_records(spark, d).select(F.explode(corpus.all_reasons(rules)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RECORDS} SELECT doc_id FROM r WHERE NOT (event_type IN ('t1', 't2', 't3', 't4') AND severity BETWEEN 0 AND 1 AND len(assets) <= 12 AND direction < 3)")
def prj05_contract(spark, d):
    ok = F.col("event_type").isin("t1", "t2", "t3", "t4") & F.col("severity").between(0, 1) & (F.size("assets") <= 12) & (F.size(F.array_distinct("assets")) == F.size("assets")) & (F.col("direction") < 3)
    return event_records(spark, d).where(~ok).select("doc_id")


@query(f"WITH {RECORDS} SELECT doc_id, published FROM r WHERE severity >= 0.7::DOUBLE AND confidence >= 0.8::DOUBLE AND event_type IN ('t1', 't3', 't5') AND list_contains(assets, 'S1')")
def prj11_trigger_on_asset(spark, d):
    """Trigger predicate on records that name an asset (also PRJ-09)."""
    return event_records(spark, d).where((F.col("severity") >= 0.7) & (F.col("confidence") >= 0.8) & F.col("event_type").isin("t1", "t3", "t5") & F.array_contains("assets", "S1")).select("doc_id", "published")


TITLE = r"lower(trim(regexp_replace(headline, '[\x20\x09-\x0D]+', ' ', 'g')))"


@query(f"""WITH {NEWS}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {TITLE} ORDER BY published, doc_id) AS i FROM n) WHERE i = 1)
SELECT doc_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY published, doc_id) AS j FROM a) WHERE j = 1""")
def wn23_first_seen(spark, d):
    """First by title, then first by URL among those."""
    a = corpus.keep_first(news(spark, d), [corpus.normal_title("headline")], ["published", "doc_id"])
    return corpus.keep_first(a, [F.col("url")], ["published", "doc_id"]).select("doc_id", "url")


@query(f"""WITH {NEWS}, a AS (SELECT doc_id, domain, published // 86400 AS day, row_number() OVER (PARTITION BY published // 86400, domain ORDER BY published, doc_id) AS nth FROM n)
SELECT * FROM (SELECT day, doc_id, domain, row_number() OVER (PARTITION BY day ORDER BY nth, domain) AS place FROM a) WHERE place <= 12""")
def wn24_round_robin(spark, d):
    n = news(spark, d).withColumn("day", F.expr("published div 86400"))
    return corpus.round_robin(n, "day", "domain", ["published", "doc_id"], 12).select("day", "doc_id", "domain", "place")


@query(f"""WITH {NEWS}, a AS (SELECT *, published // 86400 AS day, CASE WHEN row_number() OVER (PARTITION BY published // 86400, domain ORDER BY n_chars DESC, doc_id) > 1 THEN 1 ELSE 0 END AS b FROM n)
SELECT day, doc_id, domain, place FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY b, n_chars DESC, doc_id) AS place FROM a) WHERE place <= 8""")
def wn25_source_diverse(spark, d):
    n = news(spark, d).withColumn("day", F.expr("published div 86400")).withColumn("minus", -F.col("n_chars"))
    return corpus.diverse(n, "day", "domain", ["minus", "doc_id"], 8).select("day", "doc_id", "domain", "place")


@query(r"""WITH n AS (SELECT (1704067200 + doc_id * 37 % 43200 * 60) // 86400 AS day, unnest(list_distinct(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]{2,}'))) AS token FROM documents),
o AS (SELECT DISTINCT day, token FROM n), l AS (SELECT day, token, lag(day) OVER (PARTITION BY token ORDER BY day) AS p FROM o)
SELECT day, count(*) AS tokens, sum(CASE WHEN p IS NULL OR day - p > 30 THEN 1 ELSE 0 END)::BIGINT AS new FROM l GROUP BY 1""")
def wn22_novelty(spark, d):
    t = news(spark, d).select(F.expr("published div 86400").alias("day"), F.explode(X.tokens(F.col("headline"))).alias("token"))
    return corpus.novelty(t, "token", "day", 30)


TEXTS = r"""w AS (SELECT doc_id, 1704067200 + doc_id * 37 % 43200 * 60 AS published, 'https://www.' || source || '.example.com/' || (doc_id % 900) || '/' AS url, text,
  lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM documents)"""


def whole_texts(spark, d):
    """The publications with a hash of their whole normalised text, and the text itself."""
    published, url = F.lit(1704067200) + F.col("doc_id") * 37 % 43200 * 60, F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), F.col("doc_id") % 900, F.lit("/"))
    return table(spark, d, "documents").select("doc_id", "text", published.alias("published"), url.alias("url"), F.sha2(corpus.normal_title("text"), 256).alias("hash"))


@query(f"""WITH {TEXTS}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY published, doc_id) AS i FROM w) WHERE i = 1)
SELECT doc_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY published, doc_id) AS j FROM a) WHERE j = 1""")
def wn23_first_seen_text(spark, d):
    """First by the whole normalised text, then first by URL among those."""
    a = corpus.first_of(whole_texts(spark, d).select("published", "doc_id", "url", "hash"), F.col("hash"), ["published", "doc_id"])
    return corpus.first_of(a.drop("hash"), F.col("url"), ["published", "doc_id"]).select("doc_id", "url")


@query(f"""WITH {TEXTS}, x AS (SELECT published // 86400 AS day, norm, text FROM w), n AS (SELECT day, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'))) AS token FROM x),
o AS (SELECT DISTINCT day, token FROM n), l AS (SELECT day, token, lag(day) OVER (PARTITION BY token ORDER BY day) AS p FROM o), t AS (SELECT day, count(*) AS tokens, sum(CASE WHEN p IS NULL OR day - p > 30 THEN 1 ELSE 0 END)::BIGINT AS new FROM l GROUP BY 1),
c AS (SELECT day, norm, count(*) AS n, lag(day) OVER (PARTITION BY norm ORDER BY day) AS p FROM x GROUP BY 1, 2), r AS (SELECT day, sum(n)::BIGINT AS texts, sum(CASE WHEN day - p <= 30 THEN n ELSE 0 END)::BIGINT AS recurring FROM c GROUP BY 1)
SELECT day, coalesce(tokens, 0) AS tokens, coalesce(new, 0) AS new, texts, recurring, round(recurring / texts, 6) AS recurrence FROM r LEFT JOIN t USING (day)""")
def wn22_novelty_of_texts(spark, d):
    """Per day the tokens of whole texts and how many are new, and the share of texts that the 30 days before had."""
    x = whole_texts(spark, d).withColumn("day", F.expr("published div 86400"))
    t = corpus.novelty(x.select("day", F.explode(X.tokens(F.col("text"))).alias("token")), "token", "day", 30)
    both = corpus.recurrence(x, "hash", "day", 30).join(t, "day", "left").fillna(0, ["tokens", "new"])
    return rounded(both.withColumn("recurrence", F.col("recurring") / F.col("texts")).select("day", "tokens", "new", "texts", "recurring", "recurrence"), "recurrence")


@query(f"WITH {RECORDS} SELECT day, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS digest, count(*) AS n FROM r GROUP BY 1")
def ag06_digest(spark, d):
    return event_records(spark, d).withColumn("id", F.col("doc_id").cast("string")).groupBy("day").agg(corpus.digest("id").alias("digest"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RECORDS}, g AS (SELECT day, doc_id // 256 AS k, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id)) AS d, count(*) AS n FROM r GROUP BY 1, 2) SELECT day, sha256(string_agg(d, chr(10) ORDER BY k)) AS digest, sum(n)::BIGINT AS n FROM g GROUP BY 1""")
def ag06_digest_of_ranges(spark, d):
    """A day's ids digested in ranges of 256, then the ranges' digests: no task holds a day."""
    return corpus.digest_of_ranges(event_records(spark, d), "day", "doc_id", 256)


@query(f"""WITH {RECORDS}, f AS (SELECT day, count(*) AS n, {", ".join(f"avg(CASE WHEN event_type = '{t}' THEN 1.0::DOUBLE ELSE 0 END) AS share_{t}" for t in TYPES)}, avg(severity) AS mean_severity, max(severity) AS max_severity,
  avg(severity * CASE direction WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END) AS signed FROM r WHERE status = 'success' GROUP BY 1),
s AS (SELECT unnest(range((SELECT min(day) FROM f), (SELECT max(day) FROM f) + 1)) AS day)
SELECT day, coalesce(n, 0) AS n, {", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in [f"share_{t}" for t in TYPES] + ["mean_severity", "max_severity", "signed"])} FROM s LEFT JOIN f USING (day)""")
def ag01_event_features(spark, d):
    f = corpus.on_spine(corpus.event_features(event_records(spark, d).where("status = 'success'"), ["day"], TYPES), "day")
    return rounded(f, *[c for c in f.columns if c not in ("day", "n")])


@query(f"""WITH {RECORDS} SELECT day, round(coalesce(max(CASE WHEN direction = 2 THEN severity * confidence * (0.5::DOUBLE + 0.5::DOUBLE * surprise) END), 0), 6) AS adverse,
  round(coalesce(max(CASE WHEN direction = 1 THEN severity * confidence * (0.5::DOUBLE + 0.5::DOUBLE * surprise) END), 0), 6) AS beneficial FROM r GROUP BY 1""")
def ag03_strength(spark, d):
    best = lambda k: F.coalesce(F.max(F.when(F.col("direction") == k, corpus.strength())), F.lit(0.0))
    return rounded(event_records(spark, d).groupBy("day").agg(best(2).alias("adverse"), best(1).alias("beneficial")), "adverse", "beneficial")


@query(f"""WITH {RECORDS}, x AS (SELECT day, unnest(assets) AS symbol, direction, severity * confidence AS s FROM r)
SELECT day, symbol, count(*) AS n, round(coalesce(max(CASE WHEN direction = 1 THEN s END), 0) - coalesce(max(CASE WHEN direction = 2 THEN s END), 0), 6) AS score FROM x GROUP BY 1, 2""")
def ag04_asset_score(spark, d):
    x = event_records(spark, d).select("day", F.explode("assets").alias("symbol"), "direction", (F.col("severity") * F.col("confidence")).alias("s"))
    best = lambda k: F.coalesce(F.max(F.when(F.col("direction") == k, F.col("s"))), F.lit(0.0))
    return rounded(x.groupBy("day", "symbol").agg(F.count(F.lit(1)).alias("n"), (best(1) - best(2)).alias("score")), "score")


@query(f"""WITH {RECORDS}, f AS (SELECT event_type, domain, min(published) AS first FROM r GROUP BY 1, 2) SELECT event_type, first AS confirmed FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first, domain) AS i FROM f) WHERE i = 2""")
def ag05_second_source(spark, d):
    return corpus.kth_source(event_records(spark, d), "event_type", "domain", "published", 2)


@query(r"""SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(DISTINCT text) AS texts, count(DISTINCT source) AS sources, quantile_cont(w, 0.5) AS p50, quantile_cont(w, 0.95) AS p95, sum((w >= 300)::INT)::BIGINT AS long
FROM (SELECT *, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS w FROM documents)""")
def ag07_profile(spark, d):
    return corpus.profile(table(spark, d, "documents"), "doc_id", "text", "source")


@query("SELECT source, quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90 FROM documents GROUP BY 1")
def ag08_percentiles(spark, d):
    """Exact, by brackets and a second pass: a source may hold a third of all rows."""
    return percentiles.exact_percentiles(table(spark, d, "documents"), ["source"], "n_chars", {f"p{q}": q / 100 for q in (10, 50, 90)}).drop("n")


@query(f"WITH {RECORDS} SELECT day, CASE WHEN count(*) >= 20 THEN round(quantile_cont(severity, 0.5), 6) END AS score, CASE WHEN count(*) >= 20 THEN 'success' ELSE 'insufficient' END AS status FROM r GROUP BY 1")
def ag10_supported_median(spark, d):
    enough = F.count(F.lit(1)) >= 20
    return rounded(event_records(spark, d).groupBy("day").agg(F.when(enough, F.percentile("severity", 0.5)).alias("score"), F.when(enough, "success").otherwise("insufficient").alias("status")), "score")


@query(f"""WITH {RUNS}, u AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN score END AS s, 0.6::DOUBLE AS w FROM ra UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN score END, 0.4::DOUBLE FROM rb)
SELECT doc_id, round(sum(s * w) / sum(CASE WHEN s IS NOT NULL THEN w END), 6) AS ensemble FROM u GROUP BY 1""")
def ag11_ensemble(spark, d):
    a = run(spark, d).select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("score")).alias("s"), F.lit(0.6).alias("w"))
    b = run(spark, d, True).select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("score")).alias("s"), F.lit(0.4).alias("w"))
    return rounded(runs.weighted_ensemble(a.union(b), "doc_id", "s", "w"), "ensemble")


@query(f"""WITH {RUNS} SELECT doc_id, round(CASE WHEN b.score IS NOT NULL THEN least(a.score, b.score) END, 6) AS score, round(CASE WHEN b.score IS NOT NULL THEN least(a.confidence, b.confidence) END, 6) AS confidence,
  CASE WHEN b.score IS NULL THEN 'error' ELSE 'success' END AS status FROM ra a LEFT JOIN (SELECT * FROM rb WHERE doc_id % 13 <> 0) b USING (doc_id)""")
def ag12_consensus(spark, d):
    """Two-run consensus over a full outer pairing (also JN-17)."""
    return rounded(runs.consensus(runs.paired(run(spark, d), run(spark, d, True).where("doc_id % 13 <> 0"), "doc_id"), "doc_id"), "score", "confidence")


@query(f"""WITH {RUNS} SELECT count(*) AS n, sum((abs(a.score - b.score) = 0)::INT)::BIGINT AS exact, round(avg(abs(a.score - b.score)), 6) AS mean_diff, round(max(abs(a.score - b.score)), 6) AS max_diff,
  sum((a.action = b.action)::INT)::BIGINT AS same_action, 0::BIGINT AS unmatched FROM ra a JOIN rb b USING (doc_id)""")
def ag13_agreement(spark, d):
    return rounded(runs.agreement(runs.paired(run(spark, d), run(spark, d, True), "doc_id")), "mean_diff", "max_diff")


@query(f"WITH {SCORED} SELECT round(corr(label, p), 6) AS pearson FROM sc")
def ag15_pearson(spark, d):
    return scored(spark, d).agg(F.round(F.corr(F.col("label").cast("double"), "p"), 6).alias("pearson"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS a, rank() OVER (ORDER BY length(source)) + (count(*) OVER (PARTITION BY length(source)) - 1) / 2 AS b FROM documents) SELECT round(corr(a, b), 6) AS spearman FROM r""")
def ag16_spearman(spark, d):
    return rounded(stats.spearman(table(spark, d, "documents").select("n_chars", F.length("source").alias("l")), "n_chars", "l"), "spearman")


@query(f"""WITH {SCORED}, x AS (SELECT *, row_number() OVER (ORDER BY p, doc_id) AS i, count(*) OVER () AS n FROM sc)
SELECT round(avg(CASE WHEN i > n - n // 3 THEN label END) - avg(CASE WHEN i <= n // 3 THEN label END), 6) AS spread FROM x""")
def ag18_tercile_spread(spark, d):
    return rounded(stats.tercile_spread(scored(spark, d), "p", "label", "doc_id"), "spread")


@query(f"""WITH {SCORED} SELECT round(avg((label - p) ** 2), 6) AS mse, round(sqrt(avg((label - p) ** 2)), 6) AS rmse, round(avg(abs(label - p)), 6) AS mae, round(corr(label, p), 6) AS pearson, round(stddev_pop(p), 6) AS spread,
  round(regr_slope(label, p), 6) AS slope, round(regr_intercept(label, p), 6) AS intercept FROM sc""")
def ag19_regression(spark, d):
    m = stats.regression_metrics(scored(spark, d).withColumn("label", F.col("label").cast("double")), "label", "p")
    return rounded(m, *m.columns)


@query(f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS k, least(greatest(p, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS q FROM sc)
SELECT round((sum(k * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auc, round(avg((p - label) ** 2), 6) AS brier, round(-avg(label * ln(q) + (1 - label) * ln(1 - q)), 6) AS log_loss,
  round(avg(CASE WHEN label = 1 THEN p END) - avg(CASE WHEN label = 0 THEN p END), 6) AS separation FROM r""")
def ag20_binary(spark, d):
    m = stats.binary_metrics(scored(spark, d), "label", "p")
    return rounded(m, *m.columns)


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s1:' || doc_id::VARCHAR), doc_id) AS i FROM documents) WHERE i <= 3""")
def tk05_hash_sample(spark, d):
    return selection.hash_sample(table(spark, d, "documents"), ["source"], "doc_id", "s1", 3).select("doc_id", "source")


@query("""WITH x AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source FROM x WHERE n <= 5 OR p IN (0, floor((n - 1) / 4 + 0.5), floor(2 * (n - 1) / 4 + 0.5), floor(3 * (n - 1) / 4 + 0.5), n - 1)""")
def tk06_even_sample(spark, d):
    return selection.even_sample(table(spark, d, "documents"), ["source"], ["doc_id"], 5).select("doc_id", "source")


@query("""WITH h AS (SELECT doc_id, lang, sha256('s2:' || doc_id::VARCHAR) AS h FROM documents), f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) = 1 THEN 1 ELSE 0 END AS f FROM h)
SELECT doc_id, lang FROM f ORDER BY f DESC, h, doc_id LIMIT 40""")
def tk07_minimum_then_fill(spark, d):
    return selection.stratum_minimum_then_fill(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", "s2", 40)


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def tk09_frequent(spark, d):
    return selection.frequent(table(spark, d, "documents"), "source", 10)


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS only_a, 0::BIGINT AS only_b, count(*) FILTER (WHERE l.doc_id IS NULL) = 0 AS equal FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def st01_same_ids(spark, d):
    return runs.same_ids(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query(f"""WITH {RECORDS}, t AS (SELECT * FROM r WHERE severity >= 0.9::DOUBLE), c AS (SELECT r.doc_id, r.domain, row_number() OVER (PARTITION BY r.domain ORDER BY sha256('c:' || r.doc_id::VARCHAR), r.doc_id) AS i FROM r ANTI JOIN t ON r.doc_id = t.doc_id),
k AS (SELECT domain, count(*) AS n FROM t GROUP BY 1) SELECT c.doc_id, c.domain FROM c JOIN k USING (domain) WHERE c.i <= k.n""")
def jn12_controls(spark, d):
    """As many untriggered rows per domain as triggered ones, by hash order."""
    r = event_records(spark, d)
    t = r.where("severity >= 0.9")
    per = t.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    h = F.sha2(F.concat(F.lit("c:"), F.col("doc_id").cast("string")), 256)
    c = r.join(t.select("doc_id"), "doc_id", "left_anti").select("doc_id", "domain", h.alias("h"))
    c = stats.ranked(c, ["domain"], stats.hash_number(F.col("h")), ["h", "doc_id"], "i")
    return c.join(per, "domain").where("i <= n").select("doc_id", "domain")


@query("SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1), '^www\\.', '')) AS domain, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS canonical FROM pages")
def sc02_urls(spark, d):
    return table(spark, d, "pages").select("page_id", X.domain(F.col("url")).alias("domain"), X.canonical_url(F.col("url")).alias("canonical"))


@query(f"WITH {NEWS} SELECT doc_id, (published // 14400 + 1) * 14400 AS next_open, CEIL(published / 14400)::BIGINT * 14400 AS ceiling FROM n")
def jn07_next_boundary(spark, d):
    return news(spark, d).select("doc_id", timeline.next_boundary(F.col("published"), 14400).alias("next_open"), timeline.next_boundary(F.col("published"), 14400, False).alias("ceiling"))
