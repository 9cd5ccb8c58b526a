"""Queries over series, catalogues, registries and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import arrays
from tessella.functions.fixed import VARIANTS
from tessella.operators import catalog, runs, series
from tessella.plans import bindings as B
from tessella.plans.registry import query
from tessella.sources import readers
from tessella.sources.shared import cut

U = ["user_id"]
WITH = f"WITH {B.SERIES}, "
WINDOW = 7
NOISE = [r"(^|\s)of\s+the(\s|$)", r"^\s*$", "[#*$%&]{3}", "!!"]


@query("win_03", f"{WITH} x AS (SELECT 1) SELECT user_id, i, fitness FROM ser")
def win_03(s, d):
    """Events numbered by time within a user."""
    e = B.table(s, d, "events").select("user_id", "ts", "event_id", F.col("value").alias("fitness"))
    return series.ordinal(e, U, ["ts", "event_id"]).select("user_id", "i", "fitness")


KERNEL = ", ".join(f"({k - WINDOW // 2}, {w!r}::DOUBLE)" for k, w in enumerate(series.kernel(WINDOW)))
SMOOTH = f"""kn(o, w) AS (VALUES {KERNEL}), sz AS (SELECT user_id, count(*) AS n, avg(fitness) AS m FROM ser GROUP BY ALL),
p1 AS (SELECT s.user_id, s.i, CASE WHEN any_value(sz.n) < {WINDOW} THEN any_value(sz.m) ELSE sum(t.fitness * kn.w) END AS v FROM ser s JOIN sz USING (user_id) CROSS JOIN kn JOIN ser t ON t.user_id = s.user_id AND t.i = least(greatest(s.i + kn.o, 1), sz.n) GROUP BY s.user_id, s.i),
p2 AS (SELECT s.user_id, s.i, CASE WHEN any_value(sz.n) < {WINDOW} THEN any_value(sz.m) ELSE sum(t.v * kn.w) END AS v FROM p1 s JOIN sz USING (user_id) CROSS JOIN kn JOIN p1 t ON t.user_id = s.user_id AND t.i = least(greatest(s.i + kn.o, 1), sz.n) GROUP BY s.user_id, s.i)"""


@query("win_01", f"{WITH} {SMOOTH} SELECT user_id, i, round(v, 6) AS smooth FROM p2")
def win_01(s, d):
    """Fitness smoothed twice by a Gaussian over seven events."""
    return series.smooth(B.series(s, d), U, ["i"], "fitness", WINDOW).select("user_id", "i", F.round("smooth", 6).alias("smooth"))


@query("win_04", f"{WITH} g AS (SELECT user_id, i, click, CASE WHEN click IS DISTINCT FROM lag(click) OVER (PARTITION BY user_id ORDER BY i) AND i > 1 THEN 1 ELSE 0 END AS ch FROM ser), h AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY i) AS isl FROM g), k AS (SELECT user_id, isl, count(*) AS n, any_value(click) AS f FROM h GROUP BY ALL) SELECT user_id, CASE WHEN bool_or(f AND isl = 0) THEN '0,' ELSE '' END || string_agg(n::VARCHAR, ',' ORDER BY isl) AS counts FROM k GROUP BY ALL")
def win_04(s, d):
    """A user's clicks as run lengths."""
    r = runs.rle(B.series(s, d), U, ["i"], "click")
    return r.select("user_id", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"))


@query("win_08", f"{WITH} b AS (SELECT *, min(fitness) OVER (PARTITION BY user_id ORDER BY i) AS best, min(fitness) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre FROM ser), c AS (SELECT *, max(CASE WHEN pre IS NULL OR fitness < pre THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS up FROM b) SELECT user_id, i, best AS best_so_far, i - up AS waited FROM c")
def win_08(s, d):
    """Rows since the last improvement."""
    return series.patience(B.series(s, d), U, "i", "fitness").select("user_id", "i", "best_so_far", "waited")


@query("win_07", "SELECT l_orderkey, l_linenumber, (l_orderkey // 13)::BIGINT AS epoch FROM lineitem")
def win_07(s, d):
    """The epoch to go on with: steps done by steps of an epoch."""
    return B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_orderkey div 13").alias("epoch"))


@query("agg_13", f"{WITH} x AS (SELECT 1) SELECT round(quantile_cont(fitness, 0.05), 6) AS p05, round(quantile_cont(fitness, 0.95), 6) AS p95 FROM ser")
def agg_13(s, d):
    """The range of the fitness axis over all users."""
    return series.limits(B.series(s, d), "fitness").select(F.round("p05", 6).alias("p05"), F.round("p95", 6).alias("p95"))


@query("lim_01_series", f"{WITH} x AS (SELECT 1) SELECT user_id, arg_max(i, (fitness, -i)) AS best_i, max(fitness) AS best FROM ser GROUP BY ALL")
def lim_01_series(s, d):
    return series.best(B.series(s, d), U, "fitness", "i")


@query("lim_02", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def lim_02(s, d):
    """The first samples; the limit is the feature."""
    return B.table(s, d, "documents").select("doc_id", "lang").orderBy("doc_id").limit(25)


@query("lim_04", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919) % 10007, doc_id) AS r FROM documents) WHERE r <= 10")
def lim_04(s, d):
    """Ten samples of each language in a fixed shuffled order."""
    return catalog.sample_per_group(B.table(s, d, "documents").select("lang", "doc_id"), "lang", (F.col("doc_id") * 7919) % 10007, "doc_id", 10)


@query("lim_05")
def lim_05(s, d):
    """Each sample is drawn with a probability; random by nature, so no SQL."""
    return B.table(s, d, "documents").select("doc_id").sample(0.1, seed=7)


@query("lim_11")
def lim_11(s, d):
    """Samples in random order."""
    return B.table(s, d, "documents").select("doc_id").orderBy(F.rand(7))


@query("flt_15", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND value >= 10")
def flt_15(s, d):
    """Rows without NaN or null; values below ten are made NaN, so that there are some."""
    e = B.table(s, d, "events").select("event_id", F.when(F.col("value") < 10, float("nan")).otherwise(F.col("value")).alias("value"))
    return e.where(~F.isnan("value")).dropna()


LOG = "lg AS (SELECT event_id, 'step - accuracy: 0.' || lpad((event_id % 1000)::VARCHAR, 3, '0') || ' - loss: ' || (event_id % 7)::VARCHAR || '.25' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' - val_accuracy: 0.5 - val_loss: 0.' || (event_id % 10)::VARCHAR END AS line FROM events)"


def _log(s, d):
    e = B.table(s, d, "events").select("event_id")
    i = F.col("event_id")
    tail = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(" - val_accuracy: 0.5 - val_loss: 0."), (i % 10).cast("string")))
    return e.select("event_id", F.concat(F.lit("step - accuracy: 0."), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit(" - loss: "), (i % 7).cast("string"), F.lit(".25"), tail).alias("value"))


@query("src_21", f"WITH {LOG} SELECT event_id, row_number() OVER (ORDER BY event_id) AS epoch, ('0.' || lpad((event_id % 1000)::VARCHAR, 3, '0'))::DOUBLE AS accuracy, ((event_id % 7)::VARCHAR || '.25')::DOUBLE AS loss, 0.5::DOUBLE AS val_accuracy, ('0.' || (event_id % 10)::VARCHAR)::DOUBLE AS val_loss FROM lg WHERE event_id % 3 <> 0")
def src_21(s, d):
    """Measures of log lines; the epoch is the match's place in the log."""
    found = series.parse_log(_log(s, d)).drop("value")
    # a log is one file with one order; its places are offsets by range plus ranks inside, so no task holds it all.
    # The ranges are drawn once and kept, as offsets and ranks have to speak of the same ones.
    part = cut(found.repartitionByRange("event_id").withColumn("_p", F.spark_partition_id()))
    sizes = part.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("_p").orderBy("event_id"))
    return part.withColumn("_r", place).join(F.broadcast(before), "_p").select("event_id", (F.col("_r") + F.col("before")).alias("epoch"), *series.LOG_FIELDS)


@query("src_15", "SELECT p_partkey, (p_size % 3)::INTEGER AS cls, 3 AS n, round(p_size / 50.0::DOUBLE * 100, 6) AS x0, round(0.25::DOUBLE * 80, 6) AS y0 FROM part")
def src_15(s, d):
    """Label lines as classes and points in pixels."""
    p = B.table(s, d, "part").select("p_partkey", F.concat_ws(" ", F.col("p_size") % 3, F.format_string("%.6f", F.col("p_size") / F.lit(50.0)), F.lit("0.25 0.5 0.5 0.1 0.9")).alias("value"))
    r = readers.yolo_labels(p, 100, 80)
    return r.select("p_partkey", "cls", F.size("points").alias("n"), F.round(F.get("points", F.lit(0))["x"], 6).alias("x0"), F.round(F.get("points", F.lit(0))["y"], 6).alias("y0"))


@query("src_18", "SELECT event_id, 'k' AS metric, json_extract_string(props, '$.k')::DOUBLE AS value FROM events")
def src_18(s, d):
    """Documents of metrics as tall rows; the mean entry is left out."""
    e = B.table(s, d, "events").select("event_id", F.from_json("props", "map<string,double>").alias("m"))
    return e.select("event_id", F.explode("m").alias("metric", "value")).where("metric <> 'mean'")


@query("src_22", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS min_distance FROM events")
def src_22(s, d):
    """Best settings from JSON."""
    e = B.table(s, d, "events").select("event_id", F.from_json("props", "k int").alias("b"))
    return e.select("event_id", F.col("b.k").alias("min_distance"))


@query("snk_11", "WITH e AS (SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events), t AS (SELECT event_id, list_concat(['--min-distance', k::VARCHAR], CASE WHEN k % 2 = 0 THEN ['--exclude-border'] ELSE [] END, CASE WHEN k % 3 = 0 THEN [] ELSE ['--ridge-level', (k % 3)::VARCHAR || '.0'] END) AS l FROM e) SELECT event_id, (p - 1)::INTEGER AS pos, l[p] AS token FROM t, range(1, 6) r(p) WHERE p <= len(l)")
def snk_11(s, d):
    """Settings as command-line tokens."""
    e = B.table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    p = e.select("event_id", F.col("k").alias("min_distance"), (F.col("k") % 2 == 0).alias("exclude_border"), F.when(F.col("k") % 3 != 0, (F.col("k") % 3).cast("double")).alias("ridge_level"))
    return catalog.settings_tokens(p, ["min_distance", "exclude_border", "ridge_level"]).select("event_id", "pos", "token")


@query("prj_23", r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^0-9A-Za-z+\-_]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'model') AS label FROM pages")
def prj_23(s, d):
    return B.table(s, d, "pages").select("page_id", arrays.clean_label(F.col("url")).alias("label"))


@query("prj_24", "SELECT page_id, regexp_replace(url, '[^0-9A-Za-z_]+', '_', 'g') AS key FROM pages")
def prj_24(s, d):
    return B.table(s, d, "pages").select("page_id", arrays.clean_key(F.col("url")).alias("key"))


_VARIANT = "CASE page_id % 4 WHEN 0 THEN 'PPL' WHEN 1 THEN 'PPLPPXblend' WHEN 2 THEN 'PPL+PPXblend' ELSE 'PPL+AllPPX' END"


@query("prj_25", f"SELECT page_id, replace(replace(replace(split_part({_VARIANT} || '/' || url, '/', 1), 'PPL+AllPPX', 'PPL+XPL-Stack'), 'PPL+PPXblend', 'PPL+XPL-Comp'), 'PPLPPXblend', 'Full-Comp') AS run FROM pages")
def prj_25(s, d):
    """Run names: the first part of a path, with ordered replacements."""
    return B.table(s, d, "pages").select("page_id", catalog.run_name(F.concat(F.expr(_VARIANT), F.lit("/"), "url")).alias("run"))


@query("prj_26", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'cpu' WHEN p_size % 3 = 1 THEN 'cuda:0' ELSE 'cuda:' || (p_size % 8)::VARCHAR END AS device FROM part")
def prj_26(s, d):
    """Device settings: none is the processor, a list is its first device."""
    p = B.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "cpu").when(F.col("p_size") % 3 == 1, "0,1").otherwise((F.col("p_size") % 8).cast("string")).alias("raw"))
    return p.select("p_partkey", F.when(F.col("raw") == "cpu", "cpu").otherwise(F.concat(F.lit("cuda:"), F.split_part("raw", F.lit(","), F.lit(1)))).alias("device"))


DROP = " OR ".join(f"regexp_matches(text, '{p}')" for p in NOISE)


@query("flt_12", f"SELECT doc_id FROM documents WHERE NOT coalesce({DROP}, false)")
@query("stm_01", f"SELECT doc_id FROM documents WHERE NOT coalesce({DROP}, false)")
def flt_12(s, d):
    """Texts that match none of the noise patterns; the same plan serves the stream."""
    return catalog.drop_noise(B.table(s, d, "documents").select("doc_id", F.col("text").alias("value")), NOISE).select("doc_id")


@query("join_02", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join_02(s, d):
    """Images that have a label file."""
    return catalog.having_labels(B.table(s, d, "documents").select("doc_id"), B.table(s, d, "labels"), "doc_id")


@query("join_05", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
@query("set_04", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_05(s, d):
    """Samples without a cached prediction."""
    return catalog.cache_misses(B.table(s, d, "documents").select("doc_id"), B.table(s, d, "labels"), "doc_id")


@query("join_01", "SELECT c.conv_id, max(text) FILTER (role = 'user') AS a, max(text) FILTER (role = 'assistant') AS b FROM (SELECT conv_id, role, min(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL GROUP BY ALL) c GROUP BY ALL HAVING count(*) = 2")
def join_01(s, d):
    """One file for each suffix of a stem; stems are those that have all, so that none raises."""
    c = B.table(s, d, "conversations").where("role in ('user', 'assistant') and text is not null").select("conv_id", "role", "text")
    whole = c.groupBy("conv_id").agg(F.count_distinct("role").alias("n")).where("n = 2").select("conv_id")
    p = catalog.pair_files(c.join(whole, "conv_id", "left_semi"), ["user", "assistant"], "conv_id", "role", "text")
    return p.select("conv_id", F.get("images", F.lit(0)).alias("a"), F.get("images", F.lit(1)).alias("b"))


@query("join_12", "SELECT n_nationkey, (p - 1)::INTEGER AS pos, string_split(n_name, 'A')[p] AS name, string_split(upper(n_name), 'A')[p] AS label FROM nation, range(1, 30) r(p) WHERE p <= len(string_split(n_name, 'A'))")
def join_12(s, d):
    """Two lists of one length, joined by position."""
    n = B.table(s, d, "nation").select("n_nationkey", F.split("n_name", "A").alias("name"), F.split(F.upper("n_name"), "A").alias("label"))
    same = catalog.require(F.size("name") == F.size("label"), F.arrays_zip("name", "label"), "both lists have one length")
    return n.select("n_nationkey", F.posexplode(same).alias("pos", "z")).select("n_nationkey", "pos", "z.name", "z.label")


@query("join_13", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 0")
def join_13(s, d):
    """Pieces that a line hits: an equality on the piece with a condition on the side."""
    c = B.table(s, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey")
    n = B.table(s, d, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name")


@query("prj_28", "SELECT doc_id, substr(sha256(concat_ws(chr(31), doc_id::VARCHAR, lang, source)), 1, 16) AS key FROM documents")
def prj_28(s, d):
    """Cache keys from a sample's description."""
    return B.table(s, d, "documents").select("doc_id", catalog.cache_key(F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("key"))


@query("prj_30", "SELECT n_nationkey, n_name, 'runs/' || r_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def prj_30(s, d):
    """Paths from a registry; what isn't registered is an error."""
    n = B.table(s, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("key"))
    r = B.table(s, d, "region").select(F.col("r_regionkey").alias("key"), F.concat(F.lit("runs/"), "r_name").alias("path"))
    return catalog.lookup(n, r, "key", "path").select("n_nationkey", "n_name", "path")


_PICK = "CASE p_size % 5 WHEN 0 THEN 'PPL' WHEN 1 THEN 'PPLPPXblend' WHEN 2 THEN 'PPL+PPXblend' WHEN 3 THEN 'PPL+AllPPX' ELSE 'other' END"


@query("src_27", f"WITH m AS (SELECT p_partkey, 'unet_' || {_PICK} || '.keras' AS f FROM part) SELECT p_partkey, CASE WHEN contains(f, 'PPL+AllPPX') THEN 7 WHEN contains(f, 'PPL+PPXblend') THEN 2 WHEN contains(f, 'PPL') THEN 1 END AS num_inputs, CASE WHEN contains(f, 'PPL+AllPPX') THEN '_PPL,_PPX1,_PPX2,_PPX3,_PPX4,_PPX5,_PPX6' WHEN contains(f, 'PPL+PPXblend') THEN '_PPL,_PPXblend' WHEN contains(f, 'PPLPPXblend') THEN '_PPLPPXblend' WHEN contains(f, 'PPL') THEN '_PPL' END AS suffixes FROM m")
def src_27(s, d):
    """How many images a model takes, and which, by its file name."""
    m = B.table(s, d, "part").select("p_partkey", F.concat(F.lit("unet_"), F.expr(_PICK), F.lit(".keras")).alias("f"))
    return m.select("p_partkey", catalog.infer_inputs(F.col("f")).alias("i")).select("p_partkey", "i.num_inputs", "i.suffixes")


_KNOWN = "CASE p_size % 4 WHEN 0 THEN 'PPL' WHEN 1 THEN 'PPLPPXblend' WHEN 2 THEN 'PPL+PPXblend' ELSE 'PPL+AllPPX' END"


@query("join_14", f"SELECT p_partkey, {_KNOWN} AS variant, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 6 ELSE 32 END AS channels FROM part")
def join_14(s, d):
    """Settings of a variant, from the registry of fixed variants."""
    m = B.table(s, d, "part").select("p_partkey", F.expr(_KNOWN).alias("variant"))
    registry = s.createDataFrame([(v[0], v[3]) for v in VARIANTS], "variant string, channels int")
    return catalog.lookup(m, registry, "variant", "channels")


@query("src_28", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL")
def src_28(s, d):
    """The newest file of each folder."""
    return catalog.newest(B.table(s, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate")


@query("agg_16", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_pos FROM orders GROUP BY ALL")
def agg_16(s, d):
    """Regions of each source and where it was first seen."""
    return catalog.sources_summary(B.table(s, d, "orders"), ["o_custkey"], "o_orderkey")
