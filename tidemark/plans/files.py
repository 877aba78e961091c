"""Queries over readers and sinks: tables derived from the given ones are written in a format, in the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import pages
from tidemark.functions import text as X
from tidemark.plans.demo import BARS_1D, BARS_4H, NEWS, SETTLEMENTS, bars_1d, bars_4h, news, settlements
from tidemark.plans.registry import query, rounded
from tidemark.sources import batches, readers
from tidemark.sources.readers import shared_folder, table

FIELDS = ["open", "high", "low", "close", "volume", "turnover"]


@query(f"WITH {BARS_4H} SELECT symbol, slot * 14400000 AS ts_ms, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in FIELDS)} FROM b4")
def src01_bars(spark, d):
    """Files of bar arrays, 180 bars each, the symbol in the path."""
    folder = shared_folder(spark, "bars")
    b = bars_4h(spark, d).withColumn("part", F.expr("slot div 180"))
    bar = F.array((F.col("slot") * 14400000).cast("double"), *(F.col(c).cast("double") for c in FIELDS))
    b.groupBy("symbol", "part").agg(F.to_json(F.collect_list(bar)).alias("value")).select("symbol", "value").write.partitionBy("symbol").text(folder)
    # several arrays of a symbol may share a file, one a line, so lines are read, not whole files
    return rounded(readers.read_bars(spark, folder, r"symbol=([^/]+)/", whole=False).select("symbol", "ts_ms", *FIELDS), *FIELDS)


@query(r"""WITH k AS (SELECT page_id, url, lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1), '^www\.', '')) AS domain FROM pages) SELECT domain, page_id, url AS path FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id // 10 DESC, url DESC) AS i FROM k) WHERE i = 1""")
def src02_newest(spark, d):
    """The newest capture of each host; ties to the path that sorts last."""
    p = table(spark, d, "pages").select("page_id", F.col("url").alias("path"), X.domain(F.col("url")).alias("domain"))
    return readers.newest_files(p, F.col("domain"), F.expr("page_id div 10")).select("domain", "page_id", "path")


@query(f"WITH {SETTLEMENTS} SELECT symbol AS key, sec AS ts, round(max(rate), 6) AS value FROM s GROUP BY 1, 2")
def src03_series_maps(spark, d):
    """JSON objects of time and value, one for each symbol and day."""
    folder = shared_folder(spark, "maps")
    s = settlements(spark, d).groupBy("symbol", "sec").agg(F.max("rate").alias("rate"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("sec").cast("string"), F.col("rate"))))
    s.groupBy("symbol", F.expr("sec div 86400").alias("day")).agg(F.to_json(entries).alias("value")).select("symbol", "value").write.partitionBy("symbol").text(folder)
    return rounded(readers.read_series_map(spark, folder, r"symbol=([^/]+)/", whole=False), "value")


@query("SELECT doc_id, source, sha256(text) AS sha FROM documents")
def src04_json_lines(spark, d):
    """Compressed JSON lines with whole texts."""
    folder = shared_folder(spark, "lines")
    table(spark, d, "documents").select("doc_id", "source", "text").write.json(folder, compression="gzip")
    return readers.read_json_lines(spark, folder, "doc_id long, source string, text string").select("doc_id", "source", F.sha2("text", 256).alias("sha"))


def separated(spark, d, sep: str):
    folder = shared_folder(spark, "csv")
    news(spark, d).select("doc_id", "headline", "domain", "n_chars", F.lit(1).alias("outcome")).write.csv(folder, header=True, escape='"', quoteAll=True, sep=sep)
    return readers.read_csv(spark, folder, ["doc_id", "headline", "domain"], ("outcome",), sep)


@query(f"WITH {NEWS} SELECT doc_id, nullif(headline, '') AS headline, domain FROM n")
def src05_strict_csv(spark, d):
    """Quoted CSV: required columns only, outcomes never."""
    return separated(spark, d, ",").withColumn("doc_id", F.col("doc_id").cast("long"))


@query(f"WITH {NEWS} SELECT doc_id, nullif(headline, '') AS headline, domain FROM n")
def src06_strict_tsv(spark, d):
    return separated(spark, d, "\t").withColumn("doc_id", F.col("doc_id").cast("long"))


@query(f"WITH {NEWS} SELECT DISTINCT domain || '-' || doc_id AS guid, url AS link, coin AS title FROM n")
def src08_feeds(spark, d):
    """Feed items written as XML and read by element."""
    folder = shared_folder(spark, "feeds")
    items = news(spark, d).select(F.col("coin").alias("title"), F.col("url").alias("link"), F.col("published").cast("string").alias("pubDate"), F.concat_ws("-", "domain", "doc_id").alias("guid"))
    items.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(folder)
    return readers.read_feed_items(spark, folder).select("guid", "link", "title")


PAGE = r"regexp_replace(regexp_replace(html, '(?is)<(script|style|nav)\b.*?</(script|style|nav)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _reference, _character in X.ENTITIES.items():
    PAGE = "replace({}, '{}', '{}')".format(PAGE, _reference, _character.replace("'", "''"))


@query(rf"SELECT page_id, sha256(trim(regexp_replace({PAGE}, '[\x20\x09-\x0D]+', ' ', 'g'))) AS sha FROM pages")
def src09_page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(X.html_text(F.col("html")), 256).alias("sha"))


@query()
def src09_paragraphs(spark, d):
    """Title and paragraphs of every page in order, with the number of links outside the navigation."""
    p = table(spark, d, "pages").select("page_id", pages.page(F.col("html")).alias("page"))
    each = p.select("page_id", "page.title", F.size("page.links").alias("n_links"), F.posexplode_outer("page.paragraphs").alias("place", "text"))
    return each.select("page_id", "title", "n_links", F.col("place").cast("long").alias("place"), "text")


@query()
def sc01_folded(spark, d):
    """Texts with references resolved and case folded, as keys: how many documents share each, by hash."""
    return table(spark, d, "documents").groupBy(F.sha2(F.coalesce(pages.folded(F.col("text")), F.lit("")), 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(f"WITH {BARS_1D} SELECT day, symbol FROM b WHERE close > open")
def src10_membership(spark, d):
    """JSON objects of day and symbols, one for 90 days."""
    folder = shared_folder(spark, "members")
    m = bars_1d(spark, d).where("close > open").groupBy("day").agg(F.collect_set("symbol").alias("symbols"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("string"), F.col("symbols"))))
    m.groupBy(F.expr("day div 90").alias("part")).agg(F.to_json(entries).alias("value")).select("value").write.text(folder)
    return readers.read_membership(spark, folder, whole=False)


@query("SELECT source AS run, lang AS fold, count(*) AS n, sum(n_chars)::BIGINT AS total FROM documents GROUP BY 1, 2")
def src11_nested_results(spark, d):
    """Run results with nested folds, as JSON, unnested."""
    folder = shared_folder(spark, "runs")
    f = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"))
    f.groupBy(F.col("source").alias("run")).agg(F.collect_list(F.struct(F.col("lang").alias("fold"), "n", "total")).alias("folds")).write.json(folder)
    return readers.read_nested(spark, folder, "run", "folds", "fold string, n long, total long")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def src12_14_tables_and_reports(spark, d):
    """An atomic table, and a status report of it as one CSV file (SRC-12, SRC-14)."""
    folder = shared_folder(spark, "report")
    readers.write_table(table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), folder + "/table")
    readers.write_report(spark.read.parquet(folder + "/table"), folder + "/report")
    return readers.read_csv(spark, folder + "/report", ["source", "n"]).withColumn("n", F.col("n").cast("long"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def src13_pending(spark, d):
    """Rows that a batch sink has left to do after a crash."""
    docs = table(spark, d, "documents").select("doc_id")
    return readers.pending(docs, docs.where("doc_id % 3 = 0"), "doc_id")


@query("""WITH n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i, (count(*) OVER () + 5) // 6 AS per FROM documents)
SELECT doc_id, i // per AS batch, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::BIGINT AS words FROM n""")
def src13_resumed_batches(spark, d):
    """Six contiguous batches under one header, stopped after two and resumed."""
    docs, folder = table(spark, d, "documents").select("doc_id", "text"), shared_folder(spark, "batches")
    per = -(-docs.count() // 6)
    make = lambda rows: rows.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"([^ \t\n\r]+)"))).cast("long").alias("words"))
    for most in (2, None):
        found = batches.run(docs, "doc_id", make, folder, {"scorer": "words", "rows": per}, max(1, per), most)
    return found


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'size' WHEN doc_id % 10 = 2 THEN 'hash' ELSE 'extra' END AS reason FROM documents WHERE doc_id % 10 < 4""")
def src15_manifest(spark, d):
    """A manifest of the texts held against one that differs in known places."""
    i = F.col("doc_id")
    m = table(spark, d, "documents").select("doc_id", i.cast("string").alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    found = m.where("doc_id % 10 <> 0").select("path", "bytes", "sha256")
    expected = m.where("doc_id % 10 <> 3").select("path", F.when(i % 10 == 1, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(i % 10 == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return readers.verify_manifest(found, expected)


@query(f"WITH {NEWS} SELECT doc_id, url, domain FROM n")
def src06_exact_tsv(spark, d):
    """A tab-separated table read only under the exact header."""
    folder = shared_folder(spark, "tsv")
    news(spark, d).select("doc_id", "url", "domain").write.csv(folder, header=True, escape='"', quoteAll=True, sep="\t")
    return readers.read_exact(spark, folder, ["doc_id", "url", "domain"]).withColumn("doc_id", F.col("doc_id").cast("long"))


@query(f"""WITH {BARS_4H}, k AS (SELECT symbol || '-' || (slot // 30) AS name, slot, close, slot // 30 % 5 AS p FROM b4) SELECT name, slot * 14400000 AS ts_ms, round(close, 6) AS close, NULL AS reason FROM k WHERE p < 3
UNION ALL SELECT DISTINCT name, NULL, NULL, CASE p WHEN 3 THEN 'checksum' ELSE 'columns' END FROM k WHERE p >= 3""")
def src07_archives(spark, d):
    """Zip archives of 30 bars each with their checksums, some wrong and some of another width: the rows of the good ones, the reasons of the others."""
    folder = shared_folder(spark, "archives")
    b = bars_4h(spark, d).withColumn("part", F.expr("slot div 30")).select("symbol", "part", "slot", "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), "turnover")
    listed = b.groupBy("symbol", "part").applyInPandas(archiver(folder), "name string, part long, sha256 string")
    sums = readers.written(listed, "checksums").select("name", F.when(F.col("part") % 5 == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    good, bad = readers.read_archives(spark, folder, sums, 12)
    rows = good.select("name", F.col("fields")[0].cast("long").alias("ts_ms"), F.round(F.col("fields")[4].cast("double"), 6).alias("close"), F.lit(None).cast("string").alias("reason"))
    return rows.unionByName(bad, allowMissingColumns=True)


def archiver(folder: str):
    """Writes one archive a group; every fifth part has a column too few."""

    def write(g):
        import hashlib
        import io
        import zipfile

        import pandas as pd
        import pyarrow.fs as pafs

        name = f"{g['symbol'].iloc[0]}-{g['part'].iloc[0]}"
        width = 11 if g["part"].iloc[0] % 5 == 4 else 12
        g = g.sort_values("slot")
        lines = [",".join(map(repr, (int(r.slot) * 14_400_000, r.open, r.high, r.low, r.close, r.volume, r.turnover, *[0] * (width - 7)))) for r in g.itertuples()]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(zipfile.ZipInfo(name + ".csv", (2024, 1, 1, 0, 0, 0)), "\n".join(lines) + "\n")
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/{name}.zip") as f:
            f.write(out.getvalue())
        return pd.DataFrame({"name": [name], "part": [int(g["part"].iloc[0])], "sha256": [hashlib.sha256(out.getvalue()).hexdigest()]})

    return write


@query("""WITH s AS (SELECT source, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1) SELECT '| source | n | longest |' AS line UNION ALL SELECT '| - | - | - |' UNION ALL SELECT '| ' || source || ' | ' || n || ' | ' || longest || ' |' FROM s""")
def src14_status_table(spark, d):
    """A status table as Markdown."""
    folder = shared_folder(spark, "status")
    s = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))
    readers.write_status(s, folder, "source")
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query("""SELECT 'part=' || (doc_id // 500) AS name, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS bytes, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10)) AS sha256, true AS as_expected FROM documents GROUP BY 1""")
def src15_files(spark, d):
    """A manifest of files that were written, one for 500 ids each, held against itself and against the files."""
    folder = shared_folder(spark, "files")
    ids = table(spark, d, "documents").select("doc_id", F.expr("doc_id div 500").alias("part"))
    ids.repartition("part").sortWithinPartitions("part", "doc_id").select("part", F.col("doc_id").cast("string").alias("value")).write.partitionBy("part").text(folder)
    found = readers.file_manifest(spark, folder).where(F.col("path").contains("/part-"))
    expected = readers.written(found, "manifest")
    failed = readers.verify_manifest(found, expected).select("path", F.lit(False).alias("ok"))
    return expected.join(failed, "path", "left").select(F.regexp_extract("path", "(part=[0-9]+)/", 1).alias("name"), "bytes", "sha256", F.coalesce("ok", F.lit(True)).alias("as_expected"))
