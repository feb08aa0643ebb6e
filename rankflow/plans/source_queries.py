"""Queries on scans, writes, audits of tables, joins of metadata, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..functions.scalars import count_rows
from ..operators import canonical, gates, history, sketches
from ..registry import query
from ..sources import readers
from ..sources.readers import scratch, stored
from ..sources.bindings import CONTESTS, ENTRANTS, RUNNERS, WORKOUTS, contests, entrants, runners, table, tasks, workouts

R = F.round


@query(f"WITH {CONTESTS} SELECT race_id, trim(venue) AS venue, CAST(day AS VARCHAR) AS day FROM c WHERE venue = 'F' AND day BETWEEN DATE '1995-01-01' AND DATE '1995-03-31'")
def s03_filtered_projection(spark, sf_dir):
    c = contests(spark, sf_dir)
    return c.where((F.col("venue") == "F") & F.col("day").between(F.lit("1995-01-01").cast("date"), F.lit("1995-03-31").cast("date"))).select("race_id", F.trim("venue").alias("venue"), F.col("day").cast("string").alias("day"))


@query(f"WITH {CONTESTS} SELECT CAST(year(day) AS INTEGER) AS year, count(*) FILTER (race_id % 71 <> 2) AS rows, count(*) FILTER (race_id % 71 = 2) AS misplaced FROM c GROUP BY 1")
def s04_year_snapshot(spark, sf_dir):
    """All years by year and month, some rows filed under another month: those are counted and rejected."""
    path = scratch(spark, "years")
    filed = F.when(F.col("race_id") % 71 == 2, F.month("day") % 12 + 1).otherwise(F.month("day"))
    contests(spark, sf_dir).withColumns({"year": F.year("day"), "month": filed}).write.partitionBy("year", "month").parquet(path)
    wrong = (F.year("day") != F.col("year")) | (F.month("day") != F.col("month"))
    return spark.read.parquet(path).groupBy("year").agg(F.count_if(~wrong).alias("rows"), F.count_if(wrong).alias("misplaced"))


@query(f"WITH {ENTRANTS} SELECT CAST(year(day) AS INTEGER) AS year, count(*) AS rows, round(sum(1.0 / n), 4) AS strength FROM e GROUP BY 1")
def s05_score_stream_files(spark, sf_dir):
    """Scores as gzipped JSON lines by year, read back with a declared schema."""
    path = scratch(spark, "scores")
    e = entrants(spark, sf_dir).select(F.year("day").alias("year"), "race_id", "horse_id", "finish", (1 / F.col("n")).alias("strength"))
    e.write.partitionBy("year").option("compression", "gzip").json(path)
    back = spark.read.schema("race_id long, horse_id long, finish int, strength double, year int").json(path)
    return back.groupBy("year").agg(count_rows().alias("rows"), R(F.sum("strength"), 4).alias("strength"))


@query("SELECT p_brand, count(*) AS rows, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1")
def s06_csv_and_parquet(spark, sf_dir):
    """One relation by suffix: written as CSV with a header, read with its schema."""
    path = scratch(spark, "part") + ".csv"
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    p.write.option("header", True).csv(path)
    return readers.relation(spark, path, p.schema).groupBy("p_brand").agg(count_rows().alias("rows"), R(F.sum("p_retailprice"), 2).alias("price"))


@query("SELECT c_mktsegment, count(*) AS rows FROM customer GROUP BY 1")
def s07_csv_to_parquet(spark, sf_dir):
    source, dest = scratch(spark, "customer") + ".csv", scratch(spark, "customer") + ".parquet"
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    c.write.option("header", True).csv(source)
    readers.csv_to_parquet(spark, source, c.schema, dest)
    return spark.read.parquet(dest).groupBy("c_mktsegment").agg(count_rows().alias("rows"))


STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
WANTED = {"orders": ["o_orderkey", "o_finish"], "events": ["event_id", "ts"], "lineitem": ["l_orderkey", "l_clock", "l_agent"]}
COUNTED = "k AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in STAR) + ")"


@query(f"""WITH {COUNTED}, dc AS (SELECT table_name, column_index, column_name, count(*) OVER (PARTITION BY column_name) AS tables FROM duckdb_columns() WHERE table_name IN ({", ".join(f"'{t}'" for t in STAR)})),
wa AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{c}')" for t, cs in WANTED.items() for c in cs)}) AS t(table_name, column_name)), mi AS (SELECT table_name, string_agg(column_name, ',' ORDER BY column_name) AS missing FROM wa ANTI JOIN dc USING (table_name, column_name) GROUP BY 1)
SELECT table_name, string_agg(column_name, ',' ORDER BY column_index) AS columns, md5(string_agg(column_name, ',' ORDER BY column_index)) AS digest, any_value(rows) AS rows, coalesce(any_value(missing), '') AS missing, count(*) FILTER (tables > 1) AS shared_names, regexp_matches(table_name, 'order|line|event') AS relevant
FROM dc JOIN k USING (table_name) LEFT JOIN mi USING (table_name) GROUP BY table_name""")
def s09_catalog_discovery(spark, sf_dir):
    """All tables: ordered columns and their digest, rows, wanted columns that lack, names that other tables have too, and whether the table's name fits the keywords."""
    frames = {n: table(spark, sf_dir, n) for n in STAR}
    return readers.discovered(spark, frames, WANTED, ["order", "line", "event"])


@query("""WITH m AS (SELECT (min(o_orderkey) + max(o_orderkey)) // 2 AS half FROM orders) SELECT CASE WHEN o_orderkey <= half THEN 'first' ELSE 'resumed' END AS run, count(*) AS rows, min(o_orderkey) AS low, max(o_orderkey) AS watermark, TRUE AS chunked, TRUE AS ordered FROM orders, m GROUP BY 1""")
def s10_keyset_export(spark, sf_dir):
    """Staging resumes behind the stored high-water mark; chunks hold at most 10,000 rows and follow each other in key order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path = scratch(spark, "staged")
    half = o.agg(F.floor((F.min("o_orderkey") + F.max("o_orderkey")) / 2)).first()[0]
    readers.stage_after(o.where(F.col("o_orderkey") <= half), "o_orderkey", path, 10_000)
    readers.stage_after(o, "o_orderkey", path, 10_000)
    readers.stage_after(o, "o_orderkey", path, 10_000)
    run = F.when(F.col("o_orderkey") <= int(half), "first").otherwise("resumed").alias("run")
    files = spark.read.parquet(path).select(run, "o_orderkey", F.input_file_name().alias("file")).groupBy("run", "file").agg(count_rows().alias("n"), F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("z"))
    files = files.withColumn("before", F.lag("z").over(Window.partitionBy("run").orderBy("a")))  # one row per file
    return files.groupBy("run").agg(F.sum("n").alias("rows"), F.min("a").alias("low"), F.max("z").alias("watermark"), F.bool_and(F.col("n") <= 10_000).alias("chunked"), F.bool_and(F.coalesce(F.col("before") < F.col("a"), F.lit(True))).alias("ordered"))


@query(f"WITH {CONTESTS} SELECT CASE WHEN race_id % 50 = 0 THEN 'UNKNOWN' ELSE CAST(year(day) AS VARCHAR) END AS year, CASE WHEN domain = 1 THEN 'JRA' ELSE 'NAR' END AS domain, count(*) AS rows FROM c GROUP BY 1, 2")
def s11_partitioned_write(spark, sf_dir):
    path = scratch(spark, "parts")
    c = contests(spark, sf_dir).withColumn("race_date", F.when(F.col("race_id") % 50 == 0, None).otherwise(F.date_format("day", "yyyy-MM-dd")))
    c.select("race_id", scalars.year_partition(F.col("race_date")).alias("year"), scalars.domain_partition(F.col("domain")).alias("domain")).write.partitionBy("year", "domain").parquet(path)
    return spark.read.schema("race_id long, year string, domain string").parquet(path).groupBy("year", "domain").agg(count_rows().alias("rows"))


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 2 = 0) AS with_price, count(*) FILTER (o_orderkey % 2 = 1) AS with_status FROM orders")
def s12_union_by_name(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice"), o.where("o_orderkey % 2 = 1").select("o_orderstatus", "o_orderkey")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.agg(count_rows().alias("rows"), F.count("o_totalprice").alias("with_price"), F.count("o_orderstatus").alias("with_status"))


@query("""SELECT CAST(o_orderkey % 8 AS INTEGER) AS part, CASE WHEN o_orderkey % 4 = 1 THEN 'ALTERED' WHEN o_orderkey % 8 = 3 THEN 'UNLISTED' ELSE 'OK' END AS status, count(*) AS rows FROM orders GROUP BY ALL UNION ALL SELECT 8, 'MISSING', 0""")
def s13_part_manifest(spark, sf_dir):
    """Parts on disk against a manifest of SHA-256 sums: some altered since, one lost, one unlisted; rows of each part.

    Altered parts are written over the first ones; the bytes of the others stay, since a
    part that is written twice need not hold its rows in the same order.
    """
    path = scratch(spark, "manifest")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 8).cast("int").alias("part"))
    write = lambda rows: rows.repartition("part").write.partitionBy("part").option("maxRecordsPerFile", 1_000_000)
    write(o).parquet(path)
    sums = lambda name: readers.part_hashes(spark, path).groupBy(F.substring_index("folder", "=", -1).cast("int").alias("part")).agg(F.sort_array(F.collect_list("sha256")).alias(name))
    listed = stored(sums("want").where("part <> 3").union(spark.createDataFrame([(8, ["0"])], "part int, want array<string>")), "listed")
    write(o.where("o_orderkey % 4 = 1").withColumn("o_totalprice", F.col("o_totalprice") + 1)).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    found = sums("have").join(listed, "part", "full_outer")
    status = F.when(F.col("have").isNull(), "MISSING").when(F.col("want").isNull(), "UNLISTED").when(F.col("have") != F.col("want"), "ALTERED").otherwise("OK")
    rows = spark.read.parquet(path).groupBy("part").agg(count_rows().alias("rows"))
    return found.select("part", status.alias("status")).join(rows, "part", "left").fillna(0, ["rows"])


@query("SELECT count(*) + count(*) FILTER (o_orderkey % 10 = 0) AS event_rows, count(*) AS first_append, count(*) FILTER (o_orderkey % 10 = 0) AS second_append, 0::BIGINT AS third_append FROM orders")
def s15_append_only_ledger(spark, sf_dir):
    """Events appended, a tenth of them changed and all appended again, and once more."""
    path = scratch(spark, "ledger")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "changed").otherwise(F.col("o_orderstatus")))
    added = [canonical.append_ledger(spark, rows, path, ["o_orderkey", "o_orderstatus"]) for rows in (o, changed, changed)]
    return spark.read.parquet(path).agg(count_rows().alias("event_rows")).withColumns({f"{k}_append": F.lit(n).cast("long") for k, n in zip(("first", "second", "third"), added, strict=True)})


@query("SELECT count(*) AS rows, TRUE AS same FROM orders")
def s16_content_addressed_snapshot(spark, sf_dir):
    """A snapshot under its digest; reading it again gives the same digest."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    d = canonical.table_digest(o, o.columns).first()
    path = scratch(spark, f"snapshot-{d['high'] % (1 << 32):08x}{d['low'] % (1 << 32):08x}")
    o.write.mode("errorifexists").parquet(path)
    again = canonical.table_digest(spark.read.parquet(path), o.columns)
    return again.select("rows", ((F.col("high") == d["high"]) & (F.col("low") == d["low"])).alias("same"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS rows FROM events GROUP BY 1")
def s17_json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(count_rows().alias("rows"))


@query(f"WITH {CONTESTS} SELECT count(*) AS rows FROM c WHERE day BETWEEN DATE '1994-11-10' AND DATE '1996-02-20'")
def s18_date_range_pieces(spark, sf_dir):
    """A date range as an OR of year pieces, so that partitions by year are pruned."""
    c = contests(spark, sf_dir).withColumns({"year": F.year("day"), "mmdd": F.date_format("day", "MMdd")})
    return c.where(scalars.date_pieces("19941110", "19960220")).agg(count_rows().alias("rows"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS rows, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 16")
def s19_source_availability(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(count_rows().alias("rows"), F.count_distinct("user_id").alias("users")).orderBy(F.desc("day")).limit(16)


@query("SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1")
def s20_report_sinks(spark, sf_dir):
    """A report as CSV and as JSON; both read back alike."""
    a, b = scratch(spark, "report"), scratch(spark, "report")
    r = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(count_rows().alias("nations"))
    r.write.option("header", True).csv(a)
    r.write.json(b)
    one, two = spark.read.schema(r.schema).option("header", True).csv(a), spark.read.schema(r.schema).json(b)
    return one.intersectAll(two)


@query("""SELECT unnest(['v1', 'v2', 'v2', 'v2', 'v1']) AS current, unnest(['publish', 'publish', 'shrunk', 'invalid', 'rollback']) AS step, unnest([1, 2, 2, 2, 3])::BIGINT AS seq,
unnest([h, n, n, n, h]) AS rows FROM (SELECT count(*) FILTER (s_suppkey % 2 = 0) AS h, count(*) AS n FROM supplier)""")
def s21_versioned_table(spark, sf_dir):
    """Two versions published, one refused as it shrinks, one as it has a key twice, then a rollback; what readers see after each step."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")

    def unique(new):
        if new.groupBy("s_suppkey").agg(count_rows().alias("k")).where("k > 1").limit(1).count():
            raise ValueError("a key is there twice")

    v = canonical.VersionedTable(spark, scratch(spark, "canonical"), unique)
    steps = {"publish": lambda: v.publish(s.where("s_suppkey % 2 = 0"), "v1"), "publish again": lambda: v.publish(s, "v2"), "shrunk": lambda: v.publish(s.where("s_suppkey % 3 = 0"), "v3"), "invalid": lambda: v.publish(s.union(s), "v4"), "rollback": lambda: v.point("v1")}
    seen = None
    for name, step in steps.items():
        try:
            step()
        except ValueError:
            if name not in ("shrunk", "invalid"):
                raise
        seq, current = v.pointer()
        own = v.read().agg(F.lit(current).alias("current"), F.lit(name.split()[0]).alias("step"), F.lit(seq).cast("long").alias("seq"), count_rows().alias("rows"))
        seen = own if seen is None else seen.union(own)
    return seen


@query(f"WITH {ENTRANTS} SELECT count(*) AS rows, count(DISTINCT race_id) AS races, count(DISTINCT horse_id) AS competitors, count(*) FILTER (domain = 1) AS jra, count(*) FILTER (domain = 2) AS nar, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM e")
def a08_dataset_stats(spark, sf_dir):
    return entrants(spark, sf_dir).agg(count_rows().alias("rows"), F.count_distinct("race_id").alias("races"), F.count_distinct("horse_id").alias("competitors"), F.count_if(F.col("domain") == 1).alias("jra"), F.count_if(F.col("domain") == 2).alias("nar"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


@query("SELECT count(DISTINCT l_orderkey) AS l_orderkey, count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_suppkey) AS l_suppkey, count(DISTINCT l_shipdate) AS l_shipdate FROM lineitem")
def a09_distinct_counts(spark, sf_dir):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]
    return table(spark, sf_dir, "lineitem").agg(*[F.count_distinct(c).alias(c) for c in columns])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS exact, TRUE AS within_bound, TRUE AS parts_make_the_whole FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")))
def a09_distinct_sketches(spark, sf_dir):
    """Sketches kept per status and merged, against exact counts and against sketches of the whole table."""
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.unix_date(F.to_date("o_orderdate")).alias("o_orderdate"))
    kept = readers.stored(sketches.sketched(o.withColumn("part", F.col("o_orderstatus")), names, ["part"]), "sketches")
    parts = sketches.estimates(sketches.merged(kept, names), names).unpivot([], names, "column", "parts")
    whole = sketches.estimates(sketches.sketched(o, names), names).unpivot([], names, "column", "whole")
    exact = o.agg(*[F.count_distinct(c).alias(c) for c in names]).unpivot([], names, "column", "exact")
    met = exact.join(parts, "column").join(whole, "column")
    near = F.abs(F.col("parts") - F.col("exact")) <= F.greatest(F.lit(1.0), sketches.bound() * F.col("exact"))
    return met.select("column", "exact", near.alias("within_bound"), (F.abs(F.col("parts") - F.col("whole")) <= 0.02 * F.col("whole")).alias("parts_make_the_whole"))


@query(f"WITH {CONTESTS}, {RUNNERS} SELECT CASE domain WHEN 1 THEN 'JRA' ELSE 'NAR' END AS domain, count(*) AS rows, count(DISTINCT race_id) AS races, count(agent_id) AS with_agent FROM r JOIN c USING (race_id) GROUP BY 1")
def a10_inventory_by_domain(spark, sf_dir):
    j = runners(spark, sf_dir).join(contests(spark, sf_dir).select("race_id", "domain"), "race_id")
    optional = [F.count(c).alias(f"with_{c[:5]}") for c in ("agent_id",) if c in j.columns]
    return j.groupBy(gates.domain(F.col("domain")).alias("domain")).agg(count_rows().alias("rows"), F.count_distinct("race_id").alias("races"), *optional)


@query(f"WITH {ENTRANTS} SELECT CAST(year(day) AS INTEGER) AS year, count(*) AS rows, count(DISTINCT race_id) AS races, count(DISTINCT horse_id) AS entrants, count(label_win) AS labelled FROM e GROUP BY 1")
def a11_year_coverage(spark, sf_dir):
    return entrants(spark, sf_dir).groupBy(F.year("day").alias("year")).agg(count_rows().alias("rows"), F.count_distinct("race_id").alias("races"), F.count_distinct("horse_id").alias("entrants"), F.count("label_win").alias("labelled"))


@query(f"WITH {CONTESTS}, {RUNNERS} SELECT domain, count(*) AS rows, count(*) FILTER (abnormal = '4') AS dnf, count(*) FILTER (abnormal = '1') AS unresolved, count(*) FILTER (agent_id IS NULL) AS missing_id FROM r JOIN c USING (race_id) GROUP BY 1")
def a22_sample_quality(spark, sf_dir):
    j = runners(spark, sf_dir).join(contests(spark, sf_dir).select("race_id", "domain"), "race_id")
    return j.groupBy("domain").agg(count_rows().alias("rows"), F.count_if(F.col("abnormal") == "4").alias("dnf"), F.count_if(F.col("abnormal") == "1").alias("unresolved"), F.count_if(F.col("agent_id").isNull()).alias("missing_id"))


@query(f"WITH {CONTESTS}, {RUNNERS}, b AS (SELECT race_id, unnest(list_filter([CASE WHEN max(price) > 100000 THEN 'dear' END, CASE WHEN count(*) = 1 THEN 'alone' END, CASE WHEN bool_or(abnormal <> '0') THEN 'status' END], lambda x: x IS NOT NULL)) AS reason FROM r GROUP BY 1) SELECT reason, count(*) AS races FROM b GROUP BY 1")
def a23_reason_counters(spark, sf_dir):
    g = runners(spark, sf_dir).groupBy("race_id").agg(F.max("price").alias("p"), count_rows().alias("n"), F.bool_or(F.col("abnormal") != "0").alias("s"))
    b = gates.issues(g, {"dear": F.col("p") > 100000, "alone": F.col("n") == 1, "status": F.col("s")})
    return b.select(F.explode("issues").alias("reason")).groupBy("reason").agg(count_rows().alias("races"))


@query("""WITH ev AS (SELECT 'user' || user_id AS source, CASE WHEN event_type = 'purchase' THEN 'session' || (event_id // 10) END AS parent, 'event' || event_id AS output, event_type AS step FROM events)
SELECT (SELECT count(*) FROM (SELECT source FROM ev UNION SELECT parent FROM ev WHERE parent IS NOT NULL UNION SELECT output FROM ev)) AS nodes, (SELECT count(*) FROM (SELECT source, output, step FROM ev UNION SELECT parent, output, step FROM ev WHERE parent IS NOT NULL)) AS edges""")
def a24_lineage_graph(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ev = e.select(F.concat(F.lit("user"), "user_id").alias("source"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("session"), F.floor(F.col("event_id") / 10).cast("string"))).alias("parent"), F.concat(F.lit("event"), "event_id").alias("output"), F.col("event_type").alias("step"))
    nodes, edges = canonical.lineage(ev)
    return nodes.agg(count_rows().alias("nodes")).join(edges.agg(count_rows().alias("edges")))


@query(f"WITH {CONTESTS}, {RUNNERS}, b AS (SELECT race_id, 1 + CAST(race_id % 61 = 3 AS INTEGER) AS k FROM c WHERE venue <> 'P') SELECT count(*) AS rows, count(k) AS with_conditions, count(*) FILTER (k > 1) AS repeated, (SELECT count(*) FROM b WHERE k > 1) AS repeated_contests FROM r LEFT JOIN b USING (race_id)")
def j01_entrants_conditions(spark, sf_dir):
    """Left join whose build side, which holds some contests twice, is checked for repeats first and joined once."""
    c = contests(spark, sf_dir).where("venue <> 'P'").select("race_id")
    b = c.union(c.where("race_id % 61 = 3")).groupBy("race_id").agg(count_rows().alias("k"))
    met = runners(spark, sf_dir).join(b, "race_id", "left").agg(count_rows().alias("rows"), F.count("k").alias("with_conditions"), F.count_if(F.coalesce(F.col("k") > 1, F.lit(False))).alias("repeated"))
    return met.join(b.agg(F.count_if(F.col("k") > 1).alias("repeated_contests")))


@query(f"WITH {CONTESTS}, {RUNNERS}, x AS (SELECT race_id, horse_id FROM r), y AS (SELECT DISTINCT l_orderkey AS race_id, l_suppkey AS horse_id FROM lineitem) SELECT count(*) AS pairs, count(*) FILTER (x.race_id IS NULL) AS no_entrant, count(*) FILTER (y.race_id IS NULL) AS no_agent FROM x FULL JOIN y ON x.race_id = y.race_id AND x.horse_id = y.horse_id")
def j02_complete_join(spark, sf_dir):
    x = runners(spark, sf_dir).select("race_id", "horse_id", F.lit(1).alias("a"))
    y = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("race_id"), F.col("l_suppkey").alias("horse_id")).distinct().withColumn("b", F.lit(1))
    return x.join(y, ["race_id", "horse_id"], "full_outer").agg(count_rows().alias("pairs"), F.count_if(F.col("a").isNull()).alias("no_entrant"), F.count_if(F.col("b").isNull()).alias("no_agent"))


@query(f"WITH {CONTESTS}, {RUNNERS} SELECT race_id, horse_id, coalesce(s_name, '') AS name FROM r LEFT JOIN supplier ON s_suppkey = horse_id AND s_suppkey % 7 <> 0")
def j12_display_metadata(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("horse_id"), "s_name")
    return runners(spark, sf_dir).join(names, "horse_id", "left").select("race_id", "horse_id", F.coalesce("s_name", F.lit("")).alias("name"))


@query(f"""WITH {ENTRANTS}, a AS (SELECT race_id, count(*) AS n FROM e WHERE race_id % 73 <> 1 AND NOT (race_id % 67 = 2 AND finish = 1) GROUP BY 1), b AS (SELECT race_id, count(*) AS n FROM e WHERE race_id % 79 <> 4 GROUP BY 1)
SELECT count(*) AS races, count(*) FILTER (a.n IS NULL OR b.n IS NULL) AS unpaired, count(*) FILTER (a.n <> b.n) AS other_counts, count(*) FILTER (a.n = b.n) AS paired FROM a FULL JOIN b USING (race_id)""")
def j13_benchmark_pairing(spark, sf_dir):
    """Candidate and benchmark per contest, each without some: contests on one side, unequal row counts, and the pairs that count."""
    e = entrants(spark, sf_dir).select("race_id", "finish")
    a = e.where("race_id % 73 <> 1 and not (race_id % 67 = 2 and finish = 1)").groupBy("race_id").agg(count_rows().alias("na"))
    b = e.where("race_id % 79 <> 4").groupBy("race_id").agg(count_rows().alias("nb"))
    met, na, nb = a.join(b, "race_id", "full_outer"), F.col("na"), F.col("nb")
    return met.agg(count_rows().alias("races"), F.count_if(na.isNull() | nb.isNull()).alias("unpaired"), F.count_if(na != nb).alias("other_counts"), F.count_if(na == nb).alias("paired"))


@query(f"WITH {WORKOUTS} SELECT count(*) AS rows, count(DISTINCT horse_id) AS competitors FROM w WHERE horse_id IN (SELECT horse_id FROM o WHERE dn >= 19730)")
def j14_semi_join(spark, sf_dir):
    rows, seen = workouts(spark, sf_dir)
    return seen.join(rows.where("dn >= 19730"), "horse_id", "left_semi").agg(count_rows().alias("rows"), F.count_distinct("horse_id").alias("competitors"))


@query(f"""WITH {COUNTED} SELECT table_name, count(*) AS columns, any_value(rows) AS rows FROM duckdb_columns() LEFT JOIN (SELECT * FROM k WHERE table_name <> 'part') USING (table_name) WHERE table_name IN ({", ".join(f"'{t}'" for t in STAR)}) GROUP BY 1""")
def j15_table_statistics(spark, sf_dir):
    """Columns of all tables with the statistics there are: one table has none."""
    frames = {n: table(spark, sf_dir, n) for n in STAR}
    stats = readers.row_counts({n: df for n, df in frames.items() if n != "part"})
    return readers.catalog(spark, frames).groupBy("table_name").agg(count_rows().alias("columns")).join(stats, "table_name", "left").select("table_name", "columns", "rows")


@query(f"WITH {ENTRANTS}, u AS (SELECT domain, count(*) AS used FROM e WHERE day >= DATE '1996-01-01' GROUP BY 1), h AS (SELECT domain, count(*) AS held FROM e GROUP BY 1) SELECT domain, held, used, round(used / held, 6) AS rate, used < 0.9 * held AS alert FROM h FULL JOIN u USING (domain)")
def j19_usage_gap(spark, sf_dir):
    e = entrants(spark, sf_dir)
    h, u = e.groupBy("domain").agg(count_rows().alias("held")), e.where("day >= date '1996-01-01'").groupBy("domain").agg(count_rows().alias("used"))
    return h.join(u, "domain", "full_outer").select("domain", "held", "used", R(F.col("used") / F.col("held"), 6).alias("rate"), (F.col("used") < 0.9 * F.col("held")).alias("alert"))


_MODEL = "SELECT race_id, horse_id, (coalesce(sum(label_win) OVER w, 0) + 1) / (count(*) OVER w + 12.0) AS base FROM e WINDOW w AS (PARTITION BY {keys} ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {ENTRANTS}, a AS ({_MODEL.format(keys="horse_id")}), b AS ({_MODEL.format(keys="horse_id, domain")}),
x AS (SELECT a.race_id, a.horse_id, a.base / sum(a.base) OVER (PARTITION BY a.race_id) AS p, b.base / sum(b.base) OVER (PARTITION BY a.race_id) AS q FROM a JOIN b USING (race_id, horse_id)) SELECT race_id, horse_id, round(p, 6) AS champion, round(q, 6) AS specialist, round(0.7 * p + 0.3 * q, 6) AS score FROM x""")
def j21_score_alignment(spark, sf_dir):
    """The champion's rate model and the domain's own one score the same rows; scores need no join."""
    e = entrants(spark, sf_dir).select("race_id", "horse_id", "domain", "dn", "label_win")
    return aligned(history.contexts(e, "horse_id", {"a_": [], "b_": ["domain"]}, {"wins": F.col("label_win")}, tasks=tasks(spark, sf_dir)))


def aligned(c):
    """Both shares and their blend, of twelve digits before they get six, so that a tie of the sixth does not hang on the order in which a contest is summed."""
    x = c.withColumns({"p": history.share(history.smoothed(F.col("a_wins"), F.col("a_n")), "race_id"), "q": history.share(history.smoothed(F.col("b_wins"), F.col("b_n")), "race_id")})
    told = {"champion": F.col("p"), "specialist": F.col("q"), "score": 0.7 * F.col("p") + 0.3 * F.col("q")}
    return x.select("race_id", "horse_id", *[R(R(v, 12), 6).alias(k) for k, v in told.items()])


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 103 = 9 OR o_orderkey % 107 = 8) AS only_left, count(*) FILTER (o_orderkey % 103 = 9 AND o_orderkey % 107 <> 8) AS only_right, count(*) FILTER (o_orderkey % 103 = 9 OR o_orderkey % 107 = 8) = 0 AS same FROM orders")
def j22_source_change(spark, sf_dir):
    """The source read again after some rows changed and some went: the difference stops publication."""
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = scratch(spark, "reread")
    a.where("o_orderkey % 107 <> 8").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 103 == 9, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).write.parquet(path)
    return a.agg(count_rows().alias("rows")).join(gates.same_sets(a, spark.read.parquet(path), ["o_orderkey", "o_totalprice", "o_orderstatus"]))


@query("SELECT source, count(*) AS rows FROM (SELECT 'even' AS source FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'odd' FROM part WHERE p_partkey % 2 = 1) GROUP BY 1")
def u02_tagged_files(spark, sf_dir):
    """Several files in one read, each row tagged with its file."""
    root = scratch(spark, "tagged")
    p = table(spark, sf_dir, "part").select("p_partkey")
    p.where("p_partkey % 2 = 0").write.parquet(f"{root}/even")
    p.where("p_partkey % 2 = 1").write.parquet(f"{root}/odd")
    both = spark.read.parquet(f"{root}/even", f"{root}/odd").withColumn("source", F.regexp_extract(F.input_file_name(), "/(even|odd)/", 1))
    return both.groupBy("source").agg(count_rows().alias("rows"))


@query("WITH c AS (SELECT o_custkey % 50 AS a, o_orderstatus AS b, 0 AS p, o_orderkey AS i FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey % 50, o_orderstatus, 1, o_orderkey FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY p, i) AS rn FROM c) SELECT a, b, p AS priority, i AS first_id FROM k WHERE rn = 1")
def u04_candidate_dedup(spark, sf_dir):
    """Adaptive candidates before base ones; the first of a composite key stays."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("a"), F.col("o_orderstatus").alias("b"), F.col("o_orderkey").alias("first_id"))
    both = o.where("first_id % 3 = 0").withColumn("priority", F.lit(0)).unionByName(o.withColumn("priority", F.lit(1)))
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("a", "b").orderBy("priority", "first_id"))).where("rn = 1").drop("rn")


@query("SELECT count(*) AS unseen FROM orders WHERE md5(CAST(o_orderkey AS VARCHAR)) NOT IN (SELECT md5(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderkey % 4 = 1)")
def u06_seen_hashes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("h"), "o_orderkey")
    return o.join(o.where("o_orderkey % 4 = 1"), "h", "left_anti").agg(count_rows().alias("unseen"))


@query("""SELECT o_orderkey, trim('  ' || o_orderstatus || ' ') AS f01, substr(lpad(CAST(o_orderkey AS VARCHAR), 16, '0'), 9, 2) AS f02, CASE WHEN regexp_matches(CAST(o_custkey AS VARCHAR), '^[0-9]+$') AND o_custkey > 0 THEN CAST(o_custkey AS INTEGER) END AS f03,
 date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719163 AS f04, strftime(o_orderdate, '%Y-%m-%d') AS f06, substr(regexp_replace(strftime(o_orderdate, '%Y/%m/%d'), '[^0-9]', '', 'g'), 1, 4) AS f07, CAST(o_custkey // 400 AS BIGINT) AS f08, coalesce(nullif(CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'g' END, ''), '0') AS f09 FROM orders""")
def f01_f09_text_and_dates(spark, sf_dir):
    """Trim, substrings, digit tests, ordinals, ISO dates, digits-only years, bands, defaults."""
    o = table(spark, sf_dir, "orders")
    on = F.to_date("o_orderdate")
    return o.select(
        "o_orderkey",
        F.trim(F.concat(F.lit("  "), "o_orderstatus", F.lit(" "))).alias("f01"),
        F.substring(F.lpad(F.col("o_orderkey").cast("string"), 16, "0"), 9, 2).alias("f02"),
        scalars.positive_int(F.col("o_custkey").cast("string")).alias("f03"),
        scalars.ordinal(on).cast("long").alias("f04"),
        F.date_format(on, "yyyy-MM-dd").alias("f06"),
        scalars.digits_year(F.date_format(on, "yyyy/MM/dd")).alias("f07"),
        F.floor(F.col("o_custkey") / 400).alias("f08"),
        scalars.blank_default(F.when(F.col("o_custkey") % 3 == 0, "").otherwise("g"), "0").alias("f09"),
    )


@query("""SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) IS NULL AS f05, round(greatest(least(o_totalprice / 100000, 1.5), 0.5), 9) AS f10, round(ln(1 + o_totalprice), 6) AS f11,
 round(o_totalprice / nullif(o_custkey % 4, 0), 4) AS f12, CAST(o_custkey % 100 BETWEEN 14 AND 70 AS DOUBLE) AS f28 FROM orders""")
def f05_f12_numbers(spark, sf_dir):
    """Coercion, clipping, logarithms, null-safe division, band flags."""
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.col("o_totalprice").cast("string"))
    return o.select(
        "o_orderkey",
        text.try_cast("double").isNull().alias("f05"),
        R(F.greatest(F.least(F.col("o_totalprice") / 100000, F.lit(1.5)), F.lit(0.5)), 9).alias("f10"),
        R(F.log1p("o_totalprice"), 6).alias("f11"),
        R(scalars.safe_ratio(F.col("o_totalprice"), F.col("o_custkey") % 4), 4).alias("f12"),
        (F.col("o_custkey") % 100).between(14, 70).cast("double").alias("f28"),
    )


@query("""SELECT o_orderkey, md5(o_orderkey || '¦' || coalesce(CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END, '∅')) AS f14, substr(sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 1, 16) AS f15,
 sha256('{"a":' || o_custkey || ',"b":"' || o_orderstatus || '"}') AS f16, least(o_custkey, o_orderkey) || '-' || greatest(o_custkey, o_orderkey) AS f17 FROM orders""")
def f14_f17_hashes_and_keys(spark, sf_dir):
    """Row signature, split id, stable JSON digest, unordered key."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.md5(F.concat_ws("¦", F.col("o_orderkey").cast("string"), F.coalesce(F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")), F.lit("∅")))).alias("f14"),
        scalars.short_id(16, F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("f15"),
        F.sha2(F.to_json(F.struct(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b"))), 256).alias("f16"),
        F.concat_ws("-", F.least("o_custkey", "o_orderkey"), F.greatest("o_custkey", "o_orderkey")).alias("f17"),
    )


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_discount END AS a, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a, 0) + coalesce(b, 0)) / (CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER)) END, 6) AS mean, CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER) AS components,
 round(coalesce(a, 0), 6) AS w, round(greatest(coalesce(a, 0), coalesce(b, 0)), 6) AS t2, round(greatest(coalesce(a, 0), coalesce(b, 0), 0.05), 6) AS t3 FROM z""")
def f18_f19_row_means(spark, sf_dir):
    """Mean over available parts and their number; row-wise running maximum."""
    from ..operators.features import row_mean

    a, b = F.when(F.col("l_partkey") % 3 != 0, F.col("l_discount")), F.when(F.col("l_partkey") % 5 != 0, F.col("l_tax"))
    mean, n = row_mean([a, b])
    w, t2, t3 = scalars.monotone(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)), F.lit(0.05))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", R(mean, 6).alias("mean"), n.alias("components"), R(w, 6).alias("w"), R(t2, 6).alias("t2"), R(t3, 6).alias("t3"))


@query("""SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS f25, array_to_string(list_sort(list_distinct([event_type, 'b', event_type])), ',') AS f26, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS f27 FROM events""")
def f25_f27_clock_and_json(spark, sf_dir):
    """UTC+9 clock, sorted distinct arrays, values of nested JSON."""
    e = table(spark, sf_dir, "events")
    props = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.date_format(F.col("ts") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd HH:mm:ss").alias("f25"), F.array_join(F.array_sort(F.array_distinct(F.array("event_type", F.lit("b"), "event_type"))), ",").alias("f26"), F.element_at(props, "k").alias("f27"))


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_discount * 10 AS p, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_tax AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(-CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 1e-9), 1e-9)) ELSE ln(1 - greatest(least(p, 1 - 1e-9), 1e-9)) END, 4) AS loss, round((greatest(least(p, 1 - 1e-12), 1e-12) - y) ** 2, 6) AS brier, round(q * 20 - 1, 6) + 0.0 AS ev FROM z""")
def f13_f20_losses_and_value(spark, sf_dir):
    """Losses with their own clipping, and expected value."""
    from ..operators import metrics, strategy

    p, y = F.col("l_discount") * 10, (F.col("l_returnflag") == "R").cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", R(metrics.log_loss(p, y, 1e-9), 4).alias("loss"), R(metrics.brier(p, y, 1e-12), 6).alias("brier"), (R(strategy.value(F.col("l_tax"), F.lit(20.0)), 6) + 0.0).alias("ev"))
