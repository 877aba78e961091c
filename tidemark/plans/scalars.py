"""Queries over column functions and admission rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import quotes, terms
from tidemark.functions import text as X
from tidemark.operators import corpus
from tidemark.plans.demo import BARS_1D, NEWS, RECORDS, TICKS, TRADES, bars_1d, event_records, news, ticks, trades
from tidemark.plans.registry import query, rounded
from tidemark.sources.readers import table

SPACE = r"'[\x20\x09-\x0D]+'"
PLAIN = "html"
for _reference, _character in X.ENTITIES.items():
    PLAIN = "replace({}, '{}', '{}')".format(PLAIN, _reference, _character.replace("'", "''"))


@query(f"SELECT page_id, sha256(lower(trim(regexp_replace({PLAIN}, {SPACE}, ' ', 'g')))) AS sha FROM pages")
def sc01_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(X.plain(F.col("html")), 256).alias("sha"))


@query(f"SELECT doc_id, sha256(trim(regexp_replace(text, {SPACE}, ' ', 'g'))) AS text_sha, sha256(to_json({{'doc_id': doc_id, 'lang': lang, 'source': source}})) AS record_sha FROM documents")
def sc03_hashes(spark, d):
    """SHA-256 of the normalised text, and of the record as JSON with sorted keys."""
    record = F.to_json(F.struct("doc_id", "lang", "source"), {"ignoreNullFields": "false"})
    return table(spark, d, "documents").select("doc_id", F.sha2(X.normal_space(F.col("text")), 256).alias("text_sha"), F.sha2(record, 256).alias("record_sha"))


@query(r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')))::BIGINT AS tokens, len(regexp_extract_all(text, '[^ \t\n\r]+'))::BIGINT AS words FROM documents")
def sc04_tokens(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"([^ \t\n\r]+)"))
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("tokens"), F.size(words).cast("long").alias("words"))


CHOSEN = f"""{NEWS}, a AS (SELECT *, published // 86400 AS day, row_number() OVER (PARTITION BY published // 86400, domain ORDER BY published, doc_id) AS nth FROM n),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY nth, domain) AS place FROM a) WHERE place <= 12)"""
LINE = "'- [' || lpad(((published % 86400) // 3600)::VARCHAR, 2, '0') || ':' || lpad(((published % 3600) // 60)::VARCHAR, 2, '0') || ' UTC | ' || domain || ' | ' || coin || '] ' || headline"


def day_texts(spark, d):
    """day, text: the twelve items chosen for a day, a line each."""
    n = news(spark, d).withColumn("day", F.expr("published div 86400"))
    chosen = corpus.round_robin(n, "day", "domain", ["published", "doc_id"], 12)
    line = F.format_string("- [%02d:%02d UTC | %s | %s] %s", F.expr("published % 86400 div 3600"), F.expr("published % 3600 div 60"), "domain", "coin", "headline")
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return chosen.groupBy("day").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


@query(f"""WITH {CHOSEN} SELECT day, place - 1 AS position, lpad(((published % 86400) // 3600)::VARCHAR, 2, '0') || ':' || lpad(((published % 3600) // 60)::VARCHAR, 2, '0') AS clock, domain, coin, headline FROM c""")
def sc05_parse_lines(spark, d):
    """Lines of the rendered days parsed back into fields."""
    line = day_texts(spark, d).select("day", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    field = lambda i: F.regexp_extract("line", r"^- \[(\d\d:\d\d) UTC \| ([^|]*) \| ([^\]]*)\] (.*)$", i)
    return line.select("day", F.col("position").cast("long").alias("position"), field(1).alias("clock"), field(2).alias("domain"), field(3).alias("coin"), field(4).alias("headline"))


@query(f"""WITH {CHOSEN} SELECT day, string_agg({LINE}, chr(10) ORDER BY place) AS text FROM c GROUP BY 1""")
def sc06_render_days(spark, d):
    return day_texts(spark, d)


@query("""WITH k AS (SELECT doc_id, 'doc-' || doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'dc-' || doc_id WHEN 1 THEN 'dok-' || doc_id WHEN 2 THEN 'dokk-' || doc_id ELSE 'doc-' || doc_id END AS damaged FROM documents)
SELECT doc_id, CASE WHEN levenshtein(id, damaged) <= 1 THEN id END AS repaired FROM k""")
def sc07_repair_ids(spark, d):
    i = F.col("doc_id")
    head = F.when(i % 4 == 0, "dc-").when(i % 4 == 1, "dok-").when(i % 4 == 2, "dokk-").otherwise("doc-")
    k = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc-"), i).alias("id"), F.concat(head, i).alias("damaged"))
    return k.select("doc_id", F.when(X.one_edit(F.col("id"), F.col("damaged")), F.col("id")).alias("repaired"))


@query(f"""WITH {NEWS}, k AS (SELECT doc_id, headline, replace(replace(substr(headline, 3 + doc_id % 10, 24), '-', chr(8211)), chr(39), chr(8217)) AS evidence FROM n),
p AS (SELECT doc_id, evidence, CASE WHEN evidence <> '' THEN instr(translate(headline, '‘’“”–—', '''''""--'), translate(evidence, '‘’“”–—', '''''""--')) ELSE 0 END AS pos, headline FROM k)
SELECT doc_id, pos::BIGINT AS pos, CASE WHEN pos > 0 THEN substr(headline, pos, length(evidence)) END AS span FROM p""")
def sc08_evidence_span(spark, d):
    """Where a quote that differs in quotation marks and dashes stands in its headline."""
    quoted = F.translate(F.substring("headline", 3 + F.col("doc_id") % 10, F.lit(24)), "-'", "\u2013\u2019")
    k = news(spark, d).select("doc_id", "headline", quoted.alias("evidence"))
    at = F.when(F.col("evidence") != "", F.instr(X.without_style(F.col("headline")), X.without_style(F.col("evidence")))).otherwise(0)
    return k.withColumn("pos", at).select("doc_id", F.col("pos").cast("long").alias("pos"), F.when(F.col("pos") > 0, F.substring("headline", F.col("pos"), F.length("evidence"))).alias("span"))


UNSTYLED = """translate({}, '‘’“”–—' || chr(160), '''''""-- ')"""


@query(f"""WITH {NEWS}, t AS (SELECT doc_id, headline AS h, substr(headline, 3 + doc_id % 10, 24) AS s FROM n),
k AS (SELECT doc_id, h, CASE doc_id % 4 WHEN 0 THEN replace(replace(s, '-', chr(8211)), chr(39), chr(8217)) WHEN 1 THEN substr(s, 1, 8) || '...' || substr(s, 17, 8) WHEN 2 THEN substr(s, 1, 8) || ' … ' || substr(s, 17, 8)
  ELSE replace(substr(s, 1, 5) || '!;' || substr(s, 6), ' ', chr(160)) END AS e FROM t), m AS (SELECT *, {UNSTYLED.format("h")} AS nh, {UNSTYLED.format("e")} AS ne FROM k),
f AS (SELECT *, list_filter(list_transform(string_split(replace(ne, '…', '...'), '...'), lambda x: trim(x)), lambda x: x <> '') AS fr, list_filter(range(1, length(nh) + 1), lambda i: NOT contains(',.;:!?', substr(nh, i, 1))) AS ix, regexp_replace(ne, '[,.;:!?]', '', 'g') AS se FROM m),
g AS (SELECT *, CASE WHEN len(fr) = 2 THEN instr(nh, fr[1]) ELSE 0 END AS p1, instr(regexp_replace(nh, '[,.;:!?]', '', 'g'), se) AS p3 FROM f),
q AS (SELECT *, CASE WHEN p1 > 0 THEN instr(substr(nh, p1 + length(fr[1])), fr[2]) ELSE 0 END AS p2 FROM g),
p AS (SELECT doc_id, h, CASE WHEN e = '' OR h = '' THEN 0 WHEN instr(h, e) > 0 THEN instr(h, e) WHEN instr(nh, ne) > 0 THEN instr(nh, ne) WHEN p2 > 0 THEN p1 WHEN se <> '' AND p3 > 0 THEN ix[p3] ELSE 0 END AS pos,
  CASE WHEN instr(h, e) > 0 OR instr(nh, ne) > 0 THEN length(e) WHEN p2 > 0 THEN length(fr[1]) + p2 - 1 + length(fr[2]) WHEN se <> '' AND p3 > 0 THEN ix[p3 + length(se) - 1] - ix[p3] + 1 END AS size FROM q)
SELECT doc_id, pos::BIGINT AS pos, CASE WHEN pos > 0 THEN substr(h, pos, size) END AS span FROM p""")
def sc08_damaged_evidence(spark, d):
    """Where a quote stands in its headline whose quotation marks and dashes differ, or that has an ellipsis, or other punctuation and no-break spaces."""
    s = F.substring("headline", 3 + F.col("doc_id") % 10, F.lit(24))
    short = lambda mark: F.concat(F.substring(s, 1, 8), F.lit(mark), F.substring(s, 17, 8))
    i = F.col("doc_id") % 4
    quoted = F.when(i == 0, F.translate(s, "-'", "\u2013\u2019")).when(i == 1, short("...")).when(i == 2, short(" \u2026 "))
    quoted = quoted.otherwise(F.translate(F.concat(F.substring(s, 1, 5), F.lit("!;"), F.substring(s, 6, 24)), " ", "\u00a0"))
    k = news(spark, d).select("doc_id", X.evidence_span(F.col("headline"), quoted).alias("x"))
    return k.select("doc_id", "x.pos", "x.span")


@query()
def sc08_damaged_passages(spark, d):
    """Sixty characters from anywhere in a whole document, one changed and one dropped, and the span of the document that they stand for."""
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") * 7919 % F.greatest(F.length("text") - 60, F.lit(1)) + 1).cast("int").alias("lo"))
    part = lambda lo, n: F.substring(F.col("text"), F.col("lo") + lo, F.lit(n))
    quote = F.concat(part(0, 19), F.lit("\u2042"), part(20, 19), part(40, 20))
    return docs.select("doc_id", quotes.quote_span(F.col("text"), quote, 2).alias("s")).select("doc_id", "s.*")


@query(f"""WITH {RECORDS}, k AS (SELECT doc_id, [CASE a WHEN 'S3' THEN 'S0' WHEN 'S4' THEN 'S1' ELSE a END for a in assets] AS l FROM r)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS names FROM k""")
def sc09_aliases(spark, d):
    return event_records(spark, d).select("doc_id", F.array_join(X.canonical_names(F.col("assets"), {"S3": "S0", "S4": "S1"}), ",").alias("names"))


@query("""WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS sec, epoch_us(ts) AS us FROM events)
SELECT event_id, sec AS parsed, year(make_timestamp(us)) || 'Q' || quarter(make_timestamp(us)) AS quarter, (sec // 86400 + 1) * 86400 AS midnight, sec // 14400 * 14400 AS slot FROM e""")
def sc10_times(spark, d):
    """Event times written in three forms (ISO, RFC 822, 14 digits) and parsed again; quarter, next midnight and four-hour slot."""
    ts, i = F.col("ts"), F.col("event_id") % 3
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rfc = F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss Z")
    form = F.when(i == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")).when(i == 1, rfc).otherwise(F.date_format(ts, "yyyyMMddHHmmss"))
    p = e.select("event_id", X.parsed_time(form).alias("t")).withColumn("parsed", F.unix_seconds("t"))
    return p.select("event_id", "parsed", X.quarter_key(F.col("t")).alias("quarter"), F.expr("(parsed div 86400 + 1) * 86400").alias("midnight"), F.expr("parsed div 14400 * 14400").alias("slot"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def sc11_units(spark, d):
    """Stamps in microseconds (even ids) or milliseconds, told apart by size."""
    us = F.expr("unix_micros(cast(ts as timestamp))")
    mixed = F.when(F.col("event_id") % 2 == 0, us).otherwise(F.floor(us / 1000))
    return table(spark, d, "events").select("event_id", X.epoch_ms(mixed).cast("long").alias("ms"))


@query(f"""WITH {TICKS}, f AS (SELECT symbol, us // 14400000000 AS slot, coalesce(sum(CASE WHEN side = 'buy' THEN price * qty END), 0) AS b, coalesce(sum(CASE WHEN side = 'sell' THEN price * qty END), 0) AS s, sum(price * price) AS q FROM ticks GROUP BY 1, 2)
SELECT symbol, slot, round(CASE WHEN b > 0 AND s > 0 THEN ln(b / s) END, 6) AS log_ratio, round(CASE WHEN b > 0 AND s > 0 THEN tanh(least(greatest(ln(b / s), -2), 2)) END, 6) AS squashed, round(ln(1 + b), 6) AS log_buys, round(sqrt(q), 6) AS norm FROM f""")
def sc12_flow_math(spark, d):
    """Log ratio of buying to selling (null where one is missing), clamped and squashed."""
    traded = F.col("price") * F.col("qty")
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, traded)), F.lit(0.0))
    f = ticks(spark, d).groupBy("symbol", F.expr("us div 14400000000").alias("slot")).agg(side("buy").alias("b"), side("sell").alias("s"), F.sum(F.col("price") * F.col("price")).alias("q"))
    ratio = F.when((F.col("b") > 0) & (F.col("s") > 0), F.log(F.col("b") / F.col("s")))
    g = f.select("symbol", "slot", ratio.alias("log_ratio"), F.when(ratio.isNotNull(), F.tanh(F.least(F.greatest(ratio, F.lit(-2.0)), F.lit(2.0)))).alias("squashed"), F.log1p("b").alias("log_buys"), F.sqrt("q").alias("norm"))
    return rounded(g, "log_ratio", "squashed", "log_buys", "norm")


@query(f"""WITH {RECORDS}, k AS (SELECT doc_id, assets, ['S1', 'S2'] AS held FROM r)
SELECT doc_id, len(list_intersect(assets, held)) > 0 AS touches, list_position(assets, 'S1')::BIGINT AS place, round(len(list_intersect(assets, held)) / len(list_distinct(list_concat(assets, held))), 6) AS jaccard FROM
(SELECT doc_id, assets, held FROM k)""".replace("list_position(assets, 'S1')", "coalesce(list_position(assets, 'S1'), 0)"))
def sc13_arrays(spark, d):
    held, assets = F.array(F.lit("S1"), F.lit("S2")), F.col("assets")
    return event_records(spark, d).select("doc_id", F.arrays_overlap(assets, held).alias("touches"), F.array_position(assets, "S1").cast("long").alias("place"), F.round(X.jaccard(assets, held), 6).alias("jaccard"))


@query(f"""WITH {RECORDS} SELECT doc_id, round((doc_id % 7) / 10, 6) AS h24, round((doc_id % 3) / 10 + (doc_id % 7) / 10, 6) AS within_day, abs((doc_id % 3) / 10 + (doc_id % 7) / 10 + (1 - (doc_id % 5) / 10) - 1) <= 0.001 AS whole FROM r""")
def sc14_horizon_mass(spark, d):
    """Mass by horizon as a map: one entry, a sum over some keys, and whether all masses sum to one."""
    i = F.col("doc_id")
    mass = F.create_map(F.lit("h4"), i % 3 / 10, F.lit("h24"), i % 7 / 10, F.lit("h72"), 1 - i % 5 / 10)
    m = event_records(spark, d).select("doc_id", mass.alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x)
    day = F.aggregate(F.map_values(F.map_filter("m", lambda k, _: k.isin("h4", "h24"))), F.lit(0.0), lambda a, x: a + x)
    return m.select("doc_id", F.round(F.element_at("m", F.lit("h24")), 6).alias("h24"), F.round(day, 6).alias("within_day"), (F.abs(total - 1) <= 0.001).alias("whole"))


@query(f"""WITH {RECORDS} SELECT doc_id, CASE WHEN doc_id % 89 = 0 THEN 'broken' WHEN doc_id % 83 = 0 THEN 'keys' WHEN doc_id % 79 = 0 THEN 'count' ELSE 'ok' END AS verdict,
  CASE WHEN doc_id % 89 <> 0 AND doc_id % 83 <> 0 AND doc_id % 79 <> 0 THEN round(severity, 6) END AS score FROM r""")
def sc15_batch_reply(spark, d):
    """Replies of the form {"results": [...]}: broken JSON, other keys, or another number of results than asked for are told apart."""
    r, i = event_records(spark, d), F.col("doc_id")
    one = F.struct(i.alias("id"), F.col("severity").alias("score"))
    good = F.to_json(F.struct(F.when(i % 79 == 0, F.array(one, one)).otherwise(F.array(one)).alias("results")))
    reply = F.when(i % 89 == 0, F.substring(good, 1, 12)).when(i % 83 == 0, F.concat(F.lit('{"note": 1, '), F.expr("'\"results\": []}'"))).otherwise(good)
    k = r.select("doc_id", reply.alias("reply")).withColumn("keys", F.json_object_keys("reply")).withColumn("list", F.get_json_object("reply", "$.results"))
    verdict = F.when(F.col("keys").isNull() | F.col("list").isNull(), "broken").when(F.array_sort("keys") != F.array(F.lit("results")), "keys").when(F.json_array_length("list") != 1, "count").otherwise("ok")
    k = k.withColumn("verdict", verdict).withColumn("parsed", F.from_json("list", "array<struct<id: bigint, score: double>>"))
    return k.select("doc_id", "verdict", F.round(F.when(F.col("verdict") == "ok", F.col("parsed")[0]["score"]), 6).alias("score"))


@query(r"""WITH k AS (SELECT doc_id, nullif(regexp_extract(text, '([+-]?[0-9]+)', 1), '')::DOUBLE AS x FROM documents) SELECT doc_id, CASE WHEN x IS NOT NULL THEN least(greatest(x, -20), 20) END AS number FROM k""")
def sc16_first_number(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clamped_number(F.col("text"), 20).alias("number"))


@query(f"""WITH {RECORDS} SELECT doc_id, CASE WHEN doc_id % 89 = 0 THEN 'keys' WHEN doc_id % 71 = 0 THEN 'range' ELSE 'ok' END AS verdict FROM r""")
def prj06_model_reply(spark, d):
    """A reply holds exactly score, confidence and reason_code, in their ranges, with a reason."""
    r, i = event_records(spark, d), F.col("doc_id")
    good = F.to_json(F.struct(F.when(i % 71 == 0, 2.0).otherwise(F.col("severity")).alias("score"), F.col("confidence"), F.col("event_type").alias("reason_code")))
    k = r.select("doc_id", F.when(i % 89 == 0, F.replace(good, F.lit("reason_code"), F.lit("why"))).otherwise(good).alias("reply"))
    k = k.withColumn("keys", F.array_sort(F.json_object_keys("reply"))).withColumn("x", F.from_json("reply", "score double, confidence double, reason_code string"))
    exact = F.coalesce(F.col("keys") == F.array(*map(F.lit, ["confidence", "reason_code", "score"])), F.lit(False))
    held = F.coalesce(F.col("x.score").between(-1, 1) & F.col("x.confidence").between(0, 1) & (F.trim("x.reason_code") != ""), F.lit(False))
    return k.select("doc_id", F.when(~exact, "keys").when(~held, "range").otherwise("ok").alias("verdict"))


@query(f"""WITH {TICKS} SELECT event_id, us // 1000 AS ts_ms, price AS open, qty::DOUBLE AS volume FROM ticks WHERE us >= 1704672000000000 AND us < 1705276800000000 AND us + 14400000000 <= 1705000000000000""")
def prj01_07_08_bars(spark, d):
    """Typed projection, a time range, and only rows whose four hours have passed at the time of asking (PRJ-01, 07, 08)."""
    us = F.col("us")
    t = ticks(spark, d).where((us >= 1704672000000000) & (us < 1705276800000000) & (us <= 1705000000000000 - 14400000000))
    return t.select("event_id", F.expr("us div 1000").alias("ts_ms"), F.col("price").cast("double").alias("open"), F.col("qty").cast("double").alias("volume"))


TERMS = ["license", "rights", "the", "und"]


@query(f"""SELECT doc_id, array_to_string(list_filter(['{"', '".join(TERMS)}'], lambda t: contains(lower(text), t)), ',') AS terms FROM documents""")
def prj10_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.matched_terms(F.col("text"), TERMS), ",").alias("terms"))


@query("""WITH t AS (SELECT DISTINCT regexp_extract(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[^ ]+ [^ ]+ [^ ]+ [^ ]+') AS term FROM benchmark), d AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
SELECT doc_id, term, ((length(text) - length(replace(text, term, ''))) // length(term))::BIGINT AS n, min(instr(text, term) - 1)::BIGINT AS first_start FROM d JOIN t ON term <> '' AND contains(text, term) GROUP BY doc_id, text, term""")
def prj10_benchmark_openings(spark, d):
    """Where the first four words of every benchmark item stand in whole documents, by one automaton. The benchmark is a table of a fixed size; more terms than the automaton takes are an error."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    opening = F.regexp_extract(lower(F.col("text")), "^[^ ]+ [^ ]+ [^ ]+ [^ ]+", 0)
    known = [r.term for r in table(spark, d, "benchmark").select(opening.alias("term")).where("term <> ''").distinct().limit(terms.MOST + 1).collect()]
    hits = table(spark, d, "documents").select("doc_id", F.explode(terms.term_hits(F.col("text"), known)).alias("hit"))
    return hits.groupBy("doc_id", F.col("hit.term").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.min("hit.start").alias("first_start"))


@query(f"""WITH {NEWS} SELECT published // 86400 AS day, count(*) FILTER (WHERE doc_id % 28 + 1 = (published // 86400 - 19722)) AS admitted, count(*) FILTER (WHERE doc_id % 28 + 1 <> (published // 86400 - 19722)) AS quarantined FROM n GROUP BY 1""")
def prj12_quarantine(spark, d):
    """Items whose stated day of the month differs from that of their publication are set apart."""
    agrees = F.col("doc_id") % 28 + 1 == F.expr("published div 86400 - 19722")
    return news(spark, d).groupBy(F.expr("published div 86400").alias("day")).agg(F.count_if(agrees).alias("admitted"), F.count_if(~agrees).alias("quarantined"))


@query(r"SELECT doc_id, n_chars FROM documents WHERE length(text) >= 400 AND NOT regexp_matches(lower(text), 'all rights reserved|licensed under') AND len(regexp_extract_all(text, '[^ \t\n\r]+')) >= 50")
def prj13_length_and_rights(spark, d):
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^ \t\n\r]+)")))
    return table(spark, d, "documents").where((F.length("text") >= 400) & ~F.lower("text").rlike("all rights reserved|licensed under") & (words >= 50)).select("doc_id", "n_chars")


@query(f"""WITH {RECORDS} SELECT day, round(avg(severity), 6) AS event_severity, round(avg(surprise), 6) AS event_surprise FROM r GROUP BY 1""")
def prj14_guarded_features(spark, d):
    """Only feature names with the agreed prefix pass; market-derived ones are refused."""
    f = event_records(spark, d).groupBy("day").agg(F.avg("severity").alias("event_severity"), F.avg("surprise").alias("event_surprise"))
    return rounded(corpus.guarded(f, "event_", ["price", "return", "volume"], ["day"]), "event_severity", "event_surprise")


@query(f"""WITH {TRADES}, k AS (SELECT o_orderkey, entry, exit, entry - o_orderkey % 3 AS cutoff FROM t) SELECT o_orderkey, CASE WHEN entry <= cutoff THEN 'fill' WHEN exit - entry > 18 THEN 'length' END AS reason FROM k WHERE entry <= cutoff OR exit - entry > 18""")
def prj15_decision_contract(spark, d):
    """Decisions that break a rule: filled at or before their cutoff, or held too long."""
    k = trades(spark, d).withColumn("cutoff", F.col("entry") - F.col("o_orderkey") % 3)
    reason = corpus.first_reason([("fill", F.col("entry") > F.col("cutoff")), ("length", F.col("exit") - F.col("entry") <= 18)])
    return k.select("o_orderkey", reason.alias("reason")).where("reason is not null")


@query(f"""WITH {BARS_1D}, w AS (SELECT symbol, min(day) FILTER (WHERE day < 9500) AS a, max(day) FILTER (WHERE day < 9500) AS train_end, min(day) FILTER (WHERE day >= 9505) AS test_start, max(day) FILTER (WHERE day >= 9505) AS z FROM b GROUP BY 1)
SELECT symbol, test_start - train_end AS gap, train_end < test_start AS apart, test_start - train_end >= 5 AS embargo, z - test_start + 1 >= 180 AS long FROM w""")
def prj16_holdout(spark, d):
    """Training and holdout windows of each symbol: no overlap, an embargo, a least length."""
    day = F.col("day")
    w = bars_1d(spark, d).groupBy("symbol").agg(F.max(F.when(day < 9500, day)).alias("train_end"), F.min(F.when(day >= 9505, day)).alias("test_start"), F.max(F.when(day >= 9505, day)).alias("z"))
    gap = F.col("test_start") - F.col("train_end")
    return w.select("symbol", gap.alias("gap"), (gap > 0).alias("apart"), (gap >= 5).alias("embargo"), (F.col("z") - F.col("test_start") + 1 >= 180).alias("long"))


@query(f"""WITH {RECORDS} SELECT domain, count(DISTINCT day) AS days, count(DISTINCT day) >= 20 AS enough FROM r WHERE direction IN (1, 2) AND event_type NOT IN ('t0', 't9') GROUP BY 1""")
def prj17_eligible_events(spark, d):
    e = event_records(spark, d).where(F.col("direction").isin(1, 2) & ~F.col("event_type").isin("t0", "t9"))
    return e.groupBy("domain").agg(F.countDistinct("day").alias("days")).withColumn("enough", F.col("days") >= 20)


@query(f"""WITH {RECORDS} SELECT doc_id, (event_type = 't1')::BIGINT AS is_t1, (event_type = 't2')::BIGINT AS is_t2, (event_type = 't3')::BIGINT AS is_t3, (event_type NOT IN ('t1', 't2', 't3'))::BIGINT AS is_other FROM r""")
def prj18_one_hot(spark, d):
    """Levels of the training rows as indicator columns; a level not seen there is `other`."""
    r = event_records(spark, d)
    return corpus.one_hot(r, "event_type", ["t1", "t2", "t3"]).select("doc_id", "is_t1", "is_t2", "is_t3", "is_other")
