"""Queries over splits, models by fold, resampling and selection tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import models, trials
from tidemark.plans.demo import BARS_1D, TRADES, bars_1d, trades
from tidemark.plans.market import OVER, W
from tidemark.plans.registry import query, rounded
from tidemark.sources.readers import table

LCG = "* 1103515245 + {seed}) % 2147483648"


@query(f"""WITH {BARS_1D}, d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM b)) SELECT day, CASE WHEN i < floor(n * 0.3::DOUBLE) THEN 0 ELSE floor((i - floor(n * 0.3::DOUBLE)) * 5 / (n - floor(n * 0.3::DOUBLE)))::BIGINT + 1 END AS block FROM d""")
def ml02_date_blocks(spark, d):
    return trials.date_blocks(bars_1d(spark, d), "day", 0.3, 5)


@query(f"""WITH {TRADES}, c AS (SELECT symbol || reason AS cluster, min(entry * 100000000 + o_orderkey) AS first FROM t GROUP BY 1), k AS (SELECT cluster, (row_number() OVER (ORDER BY first) - 1) * 4 // count(*) OVER () AS block FROM c)
SELECT split, CASE WHEN block < split THEN 'train' ELSE 'valid' END AS role, count(*) AS clusters FROM k JOIN (SELECT unnest([1, 2, 3])::BIGINT AS split) ON block <= split GROUP BY 1, 2""")
def ml03_cluster_splits(spark, d):
    """Clusters in order of first appearance, in four blocks; each split trains on the blocks before it."""
    first = trades(spark, d).groupBy(F.concat("symbol", "reason").alias("cluster")).agg(F.min(F.struct("entry", "o_orderkey")).alias("f"))
    all_ = Window.partitionBy(F.lit(0))
    k = first.withColumn("block", ((F.row_number().over(all_.orderBy("f")) - 1) * 4 / F.count(F.lit(1)).over(all_)).cast("long"))
    k = k.withColumn("split", F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3))))).where("block <= split")
    return k.groupBy("split", F.when(F.col("block") < F.col("split"), "train").otherwise("valid").alias("role")).agg(F.count(F.lit(1)).alias("clusters"))


STARTS = [8800, 9200, 9600]
DESIGN = f"""x AS (SELECT symbol, day, close / open - 1 AS x1, volume / 1000 AS x2, lead(close) {OVER}) / close - 1 AS y FROM b),
f AS (SELECT start AS fold, CASE WHEN day < start - 5 THEN 'train' ELSE 'valid' END AS role, x1, x2, y FROM x JOIN (SELECT unnest({STARTS})::BIGINT AS start) ON day < start - 5 OR (day >= start AND day < start + 400) WHERE y IS NOT NULL),
m AS (SELECT fold, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, x2) / (stddev_pop(x1) * stddev_pop(x2)) AS r, covar_pop(x1, y) / stddev_pop(x1) AS c1, covar_pop(x2, y) / stddev_pop(x2) AS c2 FROM f WHERE role = 'train' GROUP BY 1)"""


def design(spark, d):
    x = bars_1d(spark, d).select("symbol", "day", (F.col("close") / F.col("open") - 1).alias("x1"), (F.col("volume") / 1000).alias("x2"), (F.lead("close").over(W()) / F.col("close") - 1).alias("y")).where("y is not null")
    x = x.withColumn("fold", F.explode(F.array(*(F.lit(s).cast("long") for s in STARTS))))
    role = F.when(F.col("day") < F.col("fold") - 5, "train").when((F.col("day") >= F.col("fold")) & (F.col("day") < F.col("fold") + 400), "valid")
    return x.withColumn("role", role).where("role is not null")


@query(f"""WITH {BARS_1D}, {DESIGN}, k AS (SELECT fold, my, m1, m2, s1, s2, n * (c1 * (n + 10) - n * r * c2) / ((n + 10) ** 2 - (n * r) ** 2) AS b1, n * (c2 * (n + 10) - n * r * c1) / ((n + 10) ** 2 - (n * r) ** 2) AS b2 FROM m)
SELECT fold, 10::DOUBLE AS alpha, round(avg((y - my - b1 * (x1 - m1) / s1 - b2 * (x2 - m2) / s2) ** 2), 6) AS mse FROM f JOIN k USING (fold) WHERE role = 'valid' GROUP BY 1""")
def ml04_ridge(spark, d):
    return rounded(trials.ridge_by_fold(design(spark, d), "fold", "role", ["x1", "x2"], "y", [10.0]), "mse")


@query(f"""WITH {BARS_1D}, {DESIGN}, g AS (SELECT unnest([0.001, 0.1, 10, 1000]::DOUBLE[]) AS alpha), e AS (SELECT alpha, fold, avg((y - my - n * c1 / (n + alpha) * (x1 - m1) / s1) ** 2) AS mse FROM f JOIN m USING (fold), g WHERE role = 'valid' GROUP BY 1, 2)
SELECT alpha, round(avg(mse), 6) AS mse, row_number() OVER (ORDER BY round(avg(mse), 9), alpha) = 1 AS chosen FROM e GROUP BY 1""")
def ml05_penalty(spark, d):
    """Mean error of each penalty over the folds; the first best is chosen."""
    e = trials.ridge_by_fold(design(spark, d), "fold", "role", ["x1"], "y", [0.001, 0.1, 10.0, 1000.0]).groupBy("alpha").agg(F.avg("mse").alias("m"))
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("m", 9), "alpha"))
    return e.select("alpha", F.round("m", 6).alias("mse"), (first == 1).alias("chosen"))


@query(f"""WITH {BARS_1D}, {DESIGN}, e AS (SELECT fold, avg((y - my) ** 2) AS prior, avg((y - my - n * c1 / (n + 10) * (x1 - m1) / s1) ** 2) AS one FROM f JOIN m USING (fold) WHERE role = 'valid' GROUP BY 1)
SELECT fold, round(prior, 6) AS prior, round(one, 6) AS one, round(one - prior, 6) AS delta, one < prior AS wins FROM e""")
def ml07_arms(spark, d):
    """A model against the training mean on the same folds."""
    x = design(spark, d)
    prior = trials.ridge_by_fold(x.withColumn("zero", F.lit(0.0)), "fold", "role", ["zero"], "y", [10.0]).select("fold", F.col("mse").alias("prior"))
    one = trials.ridge_by_fold(x, "fold", "role", ["x1"], "y", [10.0]).select("fold", F.col("mse").alias("one"))
    both = prior.join(one, "fold").select("fold", "prior", "one", (F.col("one") - F.col("prior")).alias("delta"), (F.col("one") < F.col("prior")).alias("wins"))
    return rounded(both, "prior", "one", "delta")


CLUSTERS = "c AS (SELECT row_number() OVER (ORDER BY symbol, q) - 1 AS i, s, n FROM (SELECT symbol, entry // 90 AS q, sum(net) AS s, count(*) AS n FROM t GROUP BY 1, 2))"


@query(f"""WITH {TRADES}, {CLUSTERS}, k AS (SELECT count(*) AS k FROM c), dr AS (SELECT draw, (((draw * k + j) {LCG.format(seed=11)}) % k AS i FROM (SELECT unnest(range(200)) AS draw) d, k, (SELECT unnest(range((SELECT k FROM k))) AS j) j)
SELECT draw, round(sum(s) / sum(n), 4) AS mean FROM dr JOIN c USING (i) GROUP BY 1""")
def ml09_cluster_bootstrap(spark, d):
    """Quarters of symbols drawn with replacement."""
    c = trades(spark, d).groupBy("symbol", F.expr("entry div 90").alias("q")).agg(F.sum("net").alias("s"), F.count(F.lit(1)).alias("n"))
    return trials.cluster_bootstrap(c, ["symbol", "q"], "s", "n", 200, 11).select("draw", F.round("mean", 4).alias("mean"))


def path_sql(block: int, seed: int) -> str:
    return f"""WITH {TRADES}, r AS (SELECT exit AS day, sum(net) / 1e9::DOUBLE AS x FROM t GROUP BY 1), p AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, x FROM r), n AS (SELECT count(*) AS n, (count(*) + {block - 1}) // {block} AS k FROM p),
dr AS (SELECT draw, j, (((draw * k + j) {LCG.format(seed=seed)}) % n AS start FROM n, (SELECT unnest(range(50)) AS draw) d, (SELECT unnest(range((SELECT k FROM n))) AS j) j),
w AS (SELECT draw, j * {block} + o AS step, x FROM dr, n, (SELECT unnest(range(0, {block})) AS o) o, p WHERE p.i = (start + o) % n AND j * {block} + o < n),
l AS (SELECT draw, step, x, sum(ln(1 + x)) OVER (PARTITION BY draw ORDER BY step) AS log FROM w), f AS (SELECT *, 1 - exp(log - greatest(max(log) OVER (PARTITION BY draw ORDER BY step), 0)) AS fall FROM l)
SELECT draw, round(avg(x), 6) AS mean, round(avg(x) / stddev_samp(x), 6) AS sharpe, round(sum(ln(1 + x)), 6) AS growth, round(max(fall), 6) AS drawdown FROM f GROUP BY 1"""


def daily(spark, d):
    return trades(spark, d).groupBy(F.col("exit").alias("day")).agg((F.sum("net") / 1e9).alias("r"))


@query(path_sql(1, 5))
def ml10_iid_bootstrap(spark, d):
    """Days drawn one by one: mean, Sharpe ratio, growth (the log of the total) and drawdown of each draw."""
    return rounded(trials.path_bootstrap(daily(spark, d), "day", "r", 1, 50, 5).drop("total"), "mean", "sharpe", "growth", "drawdown")


@query(path_sql(14, 7))
def ml11_path_bootstrap(spark, d):
    """The same over circular blocks of 14 days."""
    return rounded(trials.path_bootstrap(daily(spark, d), "day", "r", 14, 50, 7).drop("total"), "mean", "sharpe", "growth", "drawdown")


@query(f"""WITH {TRADES}, {CLUSTERS}, k AS (SELECT count(*) AS k FROM c), dr AS (SELECT draw, (((draw * k + j) {LCG.format(seed=13)}) % k AS i FROM (SELECT unnest(range(200)) AS draw) d, k, (SELECT unnest(range((SELECT k FROM k))) AS j) j),
m AS (SELECT draw, sum(s) / sum(n) AS mean FROM dr JOIN c USING (i) GROUP BY 1) SELECT round((1 + sum((mean <= 0)::INT)) / (1 + count(*)), 6) AS p FROM m""")
def ml14_one_sided(spark, d):
    c = trades(spark, d).groupBy("symbol", F.expr("entry div 90").alias("q")).agg(F.sum("net").alias("s"), F.count(F.lit(1)).alias("n"))
    return rounded(trials.one_sided_p(trials.cluster_bootstrap(c, ["symbol", "q"], "s", "n", 200, 13), "mean"), "p")


RETURNS = "rr AS (SELECT user_id % 8 AS config, epoch_us(ts) // 86400000000 AS day, avg(value) / 1000 - 0.02::DOUBLE AS r FROM events GROUP BY 1, 2)"


def run_returns(spark, d):
    day = F.expr("unix_micros(cast(ts as timestamp)) div 86400000000")
    return table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("config"), day.alias("day")).agg((F.avg("value") / 1000 - 0.02).alias("r"))


@query(f"""WITH {RETURNS}, b AS (SELECT config, day % 8 AS block, sum(r) AS t, sum(r * r) AS q, count(*) AS c FROM rr GROUP BY 1, 2), s AS (SELECT m AS split, block, (m >> block) & 1 AS inside FROM (SELECT unnest(range(256)) AS m), (SELECT unnest(range(8)) AS block) WHERE bit_count(m) = 4),
g AS (SELECT split, inside, config, round((sum(t) / sum(c)) / sqrt(sum(q) / sum(c) - (sum(t) / sum(c)) ** 2), 9) AS sharpe FROM s JOIN b USING (block) GROUP BY 1, 2, 3),
w AS (SELECT split, config AS winner FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sharpe DESC, config) AS i FROM g WHERE inside = 1) WHERE i = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sharpe, config) AS place, count(*) OVER (PARTITION BY split) AS n FROM g WHERE inside = 0)
SELECT split, winner, place, round(ln((place / (n + 1)) / (1 - place / (n + 1))), 6) AS logit FROM o JOIN w USING (split) WHERE config = winner""")
def ml15_overfit(spark, d):
    b = run_returns(spark, d).groupBy("config", (F.col("day") % 8).alias("block")).agg(F.sum("r").alias("t"), F.sum(F.col("r") * F.col("r")).alias("q"), F.count(F.lit(1)).alias("c"))
    return rounded(trials.overfit(b, "config", "block", 8, "t", "q", "c"), "logit")


@query(f"""WITH {RETURNS}, m AS (SELECT config, count(*) AS n, avg(r) AS a, stddev_samp(r) AS sd, stddev_pop(r) AS sp FROM rr GROUP BY 1),
k AS (SELECT config, n, a / sd AS sharpe, avg(((r - a) / sp) ** 3) AS skew, avg(((r - a) / sp) ** 4) AS kurtosis FROM rr JOIN m USING (config) GROUP BY 1, 2, 3)
SELECT config, n, round(sharpe, 6) AS sharpe, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round((sharpe - 0.05::DOUBLE) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe ** 2), 6) AS z FROM k""")
def ml16_deflated_sharpe(spark, d):
    g = trials.deflated_sharpe(run_returns(spark, d), "config", "r", 0.05)
    return rounded(g.select("config", "n", "sharpe", "skew", "kurtosis", "z"), "sharpe", "skew", "kurtosis", "z")


@query(f"""WITH {BARS_1D}, x AS (SELECT symbol, day, (CASE WHEN close > open THEN 1 ELSE 0 END)::DOUBLE AS weight, lead(close) {OVER}) / close - 1 AS r FROM b), y AS (SELECT * FROM x WHERE r IS NOT NULL),
o AS (SELECT *, row_number() {OVER}) AS t, row_number() OVER (PARTITION BY symbol ORDER BY sha256('p:' || day::VARCHAR), day) AS h, coalesce(lag(weight) {OVER}), 0) AS late, avg(weight) OVER (PARTITION BY symbol) AS mean FROM y),
j AS (SELECT o.*, q.weight AS other FROM o JOIN o q ON o.symbol = q.symbol AND o.t = q.h)
SELECT symbol, arm, round(avg(w * r), 6) AS mean FROM (SELECT symbol, r, unnest(['real', 'delayed', 'opposite', 'constant', 'shuffled']) AS arm, unnest([weight, late, -weight, mean, other]) AS w FROM j) GROUP BY 1, 2""")
def ml17_placebos(spark, d):
    x = bars_1d(spark, d).select("symbol", "day", (F.col("close") > F.col("open")).cast("double").alias("weight"), (F.lead("close").over(W()) / F.col("close") - 1).alias("r")).where("r is not null")
    return rounded(trials.placebo_arms(x, "symbol", "day", "weight", "p:").groupBy("symbol", "arm").agg(F.avg(F.col("w") * F.col("r")).alias("mean")), "mean")


@query(f"""WITH {BARS_1D}, e AS (SELECT symbol, day, close, open, high, (close - open) ** 2 AS ea, (close - high) ** 2 AS eb FROM b), m AS (SELECT *, avg(ea) {OVER} RANGE BETWEEN 30 PRECEDING AND 2 PRECEDING) AS ma, avg(eb) {OVER} RANGE BETWEEN 30 PRECEDING AND 2 PRECEDING) AS mb FROM e)
SELECT symbol, day, round((1 / ma) / (1 / ma + 1 / mb), 6) AS weight, round((open / ma + high / mb) / (1 / ma + 1 / mb), 6) AS fused FROM m WHERE ma > 0 AND mb > 0""")
def ml18_inverse_error(spark, d):
    """Two forecasts fused by the inverse of their mean squared errors over rows that had matured (two days old, 30 at most)."""
    w = W().rangeBetween(-30, -2)
    sq = lambda c: F.avg((F.col("close") - F.col(c)) * (F.col("close") - F.col(c))).over(w)
    m = bars_1d(spark, d).withColumn("a", F.try_divide(F.lit(1.0), sq("open"))).withColumn("b", F.try_divide(F.lit(1.0), sq("high"))).where("a is not null and b is not null")
    total = F.col("a") + F.col("b")
    return rounded(m.select("symbol", "day", (F.col("a") / total).alias("weight"), ((F.col("open") * F.col("a") + F.col("high") * F.col("b")) / total).alias("fused")), "weight", "fused")


@query(" UNION ALL ".join(f"""(WITH {BARS_1D}, x AS (SELECT day, (CASE WHEN close > avg(close) {OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) THEN 1 ELSE {low} END) * (lead(close) {OVER}) / close - 1) AS r FROM b)
SELECT {n}::BIGINT AS length, {low}::BIGINT AS low, CASE WHEN day < 9500 THEN 'train' ELSE 'holdout' END AS part, count(*) AS n, round(avg(r), 6) AS mean FROM x WHERE r IS NOT NULL GROUP BY 3)""" for n in (10, 20, 40) for low in (0, -1)))
def ml19_sweep(spark, d):
    """Average rules by length and by their position below it: every bar meets each configuration once, indicators are one window per length."""
    b = bars_1d(spark, d)
    means = {f"m{n}": F.avg("close").over(W().rowsBetween(-(n - 1), 0)) for n in (10, 20, 40)}
    x = b.withColumns({**means, "next": F.lead("close").over(W()) / F.col("close") - 1}).where("next is not null")
    grid = F.array(*(F.struct(F.lit(n).cast("long").alias("length"), F.lit(low).cast("long").alias("low"), F.when(F.col("close") > F.col(f"m{n}"), 1).otherwise(low).alias("side")) for n in (10, 20, 40) for low in (0, -1)))
    each = x.select("day", "next", F.explode(grid).alias("g")).groupBy(F.col("g.length").alias("length"), F.col("g.low").alias("low"), F.when(F.col("day") < 9500, "train").otherwise("holdout").alias("part"))
    return rounded(each.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("g.side") * F.col("next")).alias("mean")), "mean")


LENGTHS, LOWS, BANDS, CONFIRMS = (10, 20, 40), (0, -1), (0.0, 0.02, 0.05), (1, 60, 120)
#: Of each configuration: position, by the close against its mean and a band above it, and the mean against a longer one.
SIDES = {(n, low, band, slow): (f"m{n}", low, 1 + band, f"m{slow}") for n in LENGTHS for low in LOWS for band in BANDS for slow in CONFIRMS}


@query(f"""WITH {BARS_1D}, m AS (SELECT symbol, day, close, lead(close) {OVER}) / close - 1 AS nxt, close AS m1, {", ".join(f"avg(close) {OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m{n}" for n in (*LENGTHS, 60, 120))} FROM b),
g AS (SELECT day, nxt, unnest([{", ".join(f"{{'length': {n}::BIGINT, 'low': {low}::BIGINT, 'band': {band}::DOUBLE, 'slow': {slow}::BIGINT, 'side': CASE WHEN close > {m} * {up}::DOUBLE AND {'true' if slow == 1 else f'{m} > {s}'} THEN 1 ELSE {low} END}}" for (n, low, band, slow), (m, _, up, s) in SIDES.items())}]) AS c FROM m WHERE nxt IS NOT NULL),
f AS (SELECT c.length AS length, c.low AS low, c.band AS band, c.slow AS slow, (day - 8000) // 360 AS fold, count(*) AS n, avg(c.side * nxt) AS mean, sum(ln(greatest(1 + c.side * nxt * 0.1::DOUBLE, 0.01::DOUBLE))) AS growth FROM g GROUP BY ALL)
SELECT length, low, band, slow, sum(n)::BIGINT AS n, round(sum(CASE WHEN fold < 5 THEN growth ELSE 0 END), 6) AS train_growth, (count(*) FILTER (WHERE fold < 5 AND growth > 0))::BIGINT AS train_positive, round(sum(CASE WHEN fold >= 5 THEN growth ELSE 0 END), 6) AS held_growth,
  (count(*) FILTER (WHERE fold >= 5 AND growth > 0))::BIGINT AS held_positive, round(min(growth), 6) AS worst_fold FROM f GROUP BY ALL""")
def ml19_sweep_of_54(spark, d):
    """54 average rules (length, position below, band, longer mean): growth (log, a tenth at stake) and folds gained in training and after it, and the worst fold. Bars meet every configuration where they are."""
    b = bars_1d(spark, d)
    means = {f"m{n}": F.avg("close").over(W().rowsBetween(-(n - 1), 0)) for n in (*LENGTHS, 60, 120)}
    x = b.withColumns({**means, "m1": F.col("close"), "next": F.lead("close").over(W()) / F.col("close") - 1}).where("next is not null")
    side = lambda m, low, up, s: F.when((F.col("close") > F.col(m) * up) & (F.lit(True) if s == "m1" else F.col(m) > F.col(s)), 1).otherwise(low)
    grid = F.array(*(F.struct(F.lit(n).cast("long").alias("length"), F.lit(low).cast("long").alias("low"), F.lit(band).alias("band"), F.lit(slow).cast("long").alias("slow"), side(*rule).alias("side")) for (n, low, band, slow), rule in SIDES.items()))
    each = x.select(F.expr("(day - 8000) div 360").alias("fold"), "next", F.explode(grid).alias("g")).select("fold", "next", "g.*")
    growth = F.sum(F.log(F.greatest(1 + F.col("side") * F.col("next") * 0.1, F.lit(0.01))))
    by_fold = each.groupBy("length", "low", "band", "slow", "fold").agg(F.count(F.lit(1)).alias("n"), growth.alias("growth"))
    train = F.col("fold") < 5
    out = by_fold.groupBy("length", "low", "band", "slow").agg(
        F.sum("n").alias("n"), F.sum(F.when(train, F.col("growth")).otherwise(0.0)).alias("train_growth"), F.count_if(train & (F.col("growth") > 0)).alias("train_positive"),
        F.sum(F.when(~train, F.col("growth")).otherwise(0.0)).alias("held_growth"), F.count_if(~train & (F.col("growth") > 0)).alias("held_positive"), F.min("growth").alias("worst_fold"),
    )
    return rounded(out, "train_growth", "held_growth", "worst_fold")


@query(r"""WITH k AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\b(good|new|free|open)\b')) AS p, len(regexp_extract_all(lower(text), '\b(bad|old|lost|closed)\b')) AS n FROM documents)
SELECT doc_id, round(CASE WHEN p + n = 0 THEN 0 ELSE (p - n) / (p + n) END, 6) AS score FROM k""")
def ml21_score_batches(spark, d):
    """A pluggable scorer over batches of texts; the one given counts words of two lists."""
    return rounded(models.score_batches(table(spark, d, "documents"), lexicon), "score")


def lexicon():
    """A scorer that needs no weights: the share of good words among good and bad ones, -1 to 1."""
    import re

    up, down = re.compile(r"\b(?:good|new|free|open)\b", re.ASCII), re.compile(r"\b(?:bad|old|lost|closed)\b", re.ASCII)

    def score(texts: list[str]) -> list[float]:
        counts = [(len(up.findall(t)), len(down.findall(t))) for t in map(str.lower, texts)]
        return [(p - n) / (p + n) if p + n else 0.0 for p, n in counts]

    return score
