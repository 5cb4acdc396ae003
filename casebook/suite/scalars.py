"""Column functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, labels, text, vectors
from ..operators import corpus, places
from ..sources import catalog
from .registry import query
from .roles import sql_clean, table


@query(f"SELECT doc_id, {sql_clean('text')} AS clean FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_text("text").alias("clean"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(' ' || p_name || ' (' || p_brand || ')--' || p_type || '! '),
  '[^\p{L}\p{N}]+', '_', 'g'), '_') AS name FROM part""")
def normalize_names(spark, sf):
    raw = F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(")--"), "p_type", F.lit("! "))
    return table(spark, sf, "part").select("p_partkey", text.snake_name(raw).alias("name"))


@query(r"""SELECT conv_id, turn, coalesce(nullif(lower(trim(regexp_replace(text, '[^a-zA-Z0-9]+', '_', 'g'), '_')), ''),
  'target') AS slug FROM conversations""")
def slugify(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.slug("text").alias("slug"))


# Lists are written in a different way for each return flag.
_LISTS = """CASE l_returnflag WHEN 'A' THEN '[' || l_partkey || ', ' || l_suppkey || ']'
  WHEN 'R' THEN '[''p' || l_partkey || ''', "s' || l_suppkey || '"]'
  ELSE l_partkey || ', ,' || l_suppkey END"""


def _list_text():
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("["), p, F.lit(", "), s, F.lit("]")))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("['p"), p, F.lit("', \"s"), s, F.lit('"]')))
        .otherwise(F.concat(p, F.lit(", ,"), s))
    )


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter(list_transform(
    string_split(trim({_LISTS}, '[]'), ','), lambda v: trim(trim(trim(v), '"'), '''')), lambda v: v <> ''), '|') AS items
  FROM lineitem""")
def parse_list(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_join(text.parse_list(_list_text()), "|").alias("items")
    )


@query("""SELECT l_returnflag, sum(CASE WHEN l_returnflag IN ('A', 'R') THEN 2 ELSE 0 END)::BIGINT AS n_items,
  count(*) AS n_rows FROM lineitem GROUP BY 1""")
def parse_list_strict(spark, sf):
    sizes = F.size(text.parse_list_strict(_list_text()))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.sum(sizes).alias("n_items"), F.count(F.lit(1)).alias("n_rows")
    )


@query("""SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '') AS host,
  coalesce(nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ''), 'Unknown') AS source FROM pages""")
def url_domain(spark, sf):
    host = text.url_host("url")
    return table(spark, sf, "pages").select("page_id", host.alias("host"), text.fill_domain(host).alias("source"))


@query("""SELECT page_id, regexp_replace(regexp_extract(lower(replace(url, 'http://', '')), '^(https://)?([^/?#]*)', 2), '^www\\.', '')
  AS domain FROM pages""")
def url_registered_domain(spark, sf):
    bare = F.replace("url", F.lit("http://"), F.lit(""))
    return table(spark, sf, "pages").select("page_id", text.url_domain(bare).alias("domain"))


def _date_text():
    d = F.col("o_orderdate")
    return (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "MM/dd/yyyy"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(d, "dd.MM.yyyy"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise("unknown")
    )


_DATE_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN '2-HIGH' THEN strftime(o_orderdate, '%m/%d/%Y') WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%d.%m.%Y')
  WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE 'unknown' END"""


@query(f"""SELECT o_orderkey, strftime(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%m/%d/%Y'),
  try_strptime(d, '%d.%m.%Y'), try_strptime(d, '%Y-%m-%dT%H:%M:%S')), '%Y-%m-%d') AS day
  FROM (SELECT o_orderkey, {_DATE_SQL} AS d FROM orders)""")
def parse_dates(spark, sf):
    day = F.date_format(dates.parse_timestamp(_date_text()), "yyyy-MM-dd")
    return table(spark, sf, "orders").select("o_orderkey", day.alias("day"))


@query("""SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN CASE WHEN y > 1997 THEN y ELSE NULL END ELSE y END AS INTEGER)
  AS year FROM (SELECT *, year(o_orderdate) AS y FROM orders)""")
def extract_year(spark, sf):
    number = F.when(F.year("o_orderdate") > 1997, F.year("o_orderdate").cast("string")).otherwise("1850")
    value = F.when(F.col("o_orderpriority") == "5-LOW", number).otherwise(_date_text())
    return table(spark, sf, "orders").select("o_orderkey", dates.extract_year(value).alias("year"))


@query("""SELECT CAST(y AS INTEGER) AS year, count(*) AS n FROM (SELECT floor(l_extendedprice / 10) AS y FROM lineitem)
  WHERE y BETWEEN 1900 AND 2100 GROUP BY 1""")
def valid_years(spark, sf):
    year = dates.valid_year(F.floor(F.col("l_extendedprice") / 10).cast("string"))
    return (
        table(spark, sf, "lineitem").select(year.alias("year")).filter("year IS NOT NULL")
        .groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    )


@query("""SELECT p_partkey, trim(coalesce(CASE WHEN p_size > 25 THEN trim(p_name) END || ' ', '') || p_type) AS search_text FROM part""")
def search_text(spark, sf):
    title = F.when(F.col("p_size") > 25, F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return table(spark, sf, "part").select("p_partkey", text.join_text(title, F.lit("  "), "p_type").alias("search_text"))


@query("""SELECT p_partkey, 'Report title: ' || p_name || CASE WHEN p_size > 25 THEN ' Incident title: ' || p_brand ELSE '' END
  || ' Source domain: ' || p_type AS input_text FROM part""")
def combine_text(spark, sf):
    title = F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.upper("p_name"))
    fields = [("Report title", "p_name"), ("Incident title", title), ("Report text", F.lit(" ")), ("Source domain", "p_type")]
    return table(spark, sf, "part").select("p_partkey", text.labelled_text(fields).alias("input_text"))


@query("""SELECT CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN '' ELSE event_type || ' x' END AS label, count(*) AS n
  FROM events GROUP BY 1""")
def clean_label(spark, sf):
    raw = (
        F.when(F.col("event_type") == "error", F.lit(" N/A")).when(F.col("event_type") == "view", F.lit("None"))
        .otherwise(F.concat("event_type", F.lit("  x ")))
    )
    return table(spark, sf, "events").groupBy(labels.clean_label(raw).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT value, count(*) AS n FROM (SELECT unnest([lang, source]) AS value FROM documents) GROUP BY 1""")
def explode_labels(spark, sf):
    df = table(spark, sf, "documents").withColumn("labels", F.concat("lang", F.lit("  | "), "source", F.lit(" ")))
    return corpus.label_values(df, "labels").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT failure, count(*) AS n FROM (SELECT unnest([p_type, p_brand]) AS failure FROM part) GROUP BY 1""")
def explode_failures(spark, sf):
    joined = F.concat("p_type", F.lit(" , "), "p_brand", F.lit(",,"))
    return (
        table(spark, sf, "part").select(F.explode(labels.split_commas(joined)).alias("failure"))
        .groupBy("failure").agg(F.count(F.lit(1)).alias("n"))
    )


@query("""SELECT CASE WHEN p_size > 25 THEN p_type WHEN p_size > 10 THEN p_brand END AS label, count(*) AS n FROM part GROUP BY 1""")
def primary_label(spark, sf):
    raw = (
        F.when(F.col("p_size") > 25, F.concat(F.lit(", "), "p_type", F.lit("| "), "p_brand"))
        .when(F.col("p_size") > 10, F.concat("p_brand", F.lit(","), "p_type")).otherwise("nan")
    )
    return table(spark, sf, "part").groupBy(labels.primary_label(raw).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN p_size > 25 THEN p_brand || ' | ' || p_type WHEN p_size > 10 THEN p_brand ELSE '' END AS as_label,
  CASE WHEN p_size > 10 THEN p_brand ELSE '' END AS first_label,
  CASE WHEN p_size > 10 AND p_size <= 25 THEN p_brand ELSE '' END AS drop_label, count(*) AS n FROM part GROUP BY 1, 2, 3""")
def target_label_policy(spark, sf):
    raw = (
        F.when(F.col("p_size") > 25, F.concat("p_brand", F.lit(" | "), "p_type"))
        .when(F.col("p_size") > 10, F.col("p_brand")).otherwise("N/A")
    )
    policies = [labels.target_label(raw, s).alias(f"{n}_label") for s, n in (("as_label", "as"), ("first", "first"), ("drop", "drop"))]
    return table(spark, sf, "part").groupBy(*policies).agg(F.count(F.lit(1)).alias("n"))


_RISK_OF = """CASE o_orderpriority WHEN '1-URGENT' THEN '1. Discrimination and Toxicity' WHEN '2-HIGH' THEN '2. Privacy & Security'
  WHEN '3-MEDIUM' THEN '3. Misinformation' WHEN '4-NOT SPECIFIED' THEN '4. Malicious Actors & Misuse'
  ELSE '7. AI system safety, failures, and limitations' END"""
_FOUND = "CASE o_orderstatus WHEN 'F' THEN 'Unsafe Exposure (12) | Distributional Bias (3) | Hardware Failure (1)' ELSE 'Hardware Failure (12) | Unsafe Exposure (3)' END"


@query(f"""WITH base AS (
    SELECT o_orderkey, list_transform(string_split({_FOUND}, '|'), lambda s: trim(s)) AS segs,
      CASE o_orderpriority WHEN '1-URGENT' THEN ['bias', 'toxicity', 'discrimination'] WHEN '2-HIGH' THEN ['privacy', 'security', 'exposure']
        WHEN '3-MEDIUM' THEN ['misinformation', 'hallucination', 'fabrication']
        WHEN '4-NOT SPECIFIED' THEN ['misuse', 'unsafe', 'security', 'privacy', 'exposure']
        ELSE ['failure', 'bug', 'capability', 'generalization', 'hardware', 'latency'] END AS terms FROM orders)
  SELECT o_orderkey, regexp_replace(coalesce(flatten(list_transform(terms, lambda t: list_filter(segs, lambda s: contains(lower(s), t))))[1],
    segs[1]), ' \\([0-9]+\\)$', '') AS label FROM base""")
def summary_label(spark, sf):
    found, risk = F.expr(_FOUND), F.expr(_RISK_OF)
    return table(spark, sf, "orders").select("o_orderkey", labels.summary_label(found, risk).alias("label"))


@query(f"""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'D&T' WHEN '2-HIGH' THEN 'Privacy' WHEN '3-MEDIUM' THEN 'Misinfo'
    WHEN '4-NOT SPECIFIED' THEN 'Misuse' ELSE 'Safety' END AS risk_short,
  CASE WHEN length(t) <= 24 THEN t ELSE rtrim(substr(t, 1, 23)) || '…' END AS title_short
  FROM (SELECT *, o_orderpriority || ' order ' || o_orderkey AS t FROM orders)""")
def short_label(spark, sf):
    title = F.concat("o_orderpriority", F.lit(" order "), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey", labels.short_label(F.expr(_RISK_OF)).alias("risk_short"), labels.short_label(title, 24).alias("title_short")
    )


@query("""SELECT iso_alpha, count(*) AS n FROM (SELECT CASE c_mktsegment WHEN 'HOUSEHOLD' THEN NULL
    ELSE 'NA' || chr(65 + c_nationkey) END AS iso_alpha FROM customer) GROUP BY 1""")
def country_iso(spark, sf):
    letter = F.char(F.lit(65) + F.col("n_nationkey"))
    countries = table(spark, sf, "nation").select(
        F.concat(F.lit("N"), letter).alias("code2"), F.concat(F.lit("NA"), letter).alias("code3"), F.col("n_name").alias("name")
    )
    written = (
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("Global"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit(" n"), F.lower(F.char(F.lit(65) + F.col("c_nationkey")))))
        .otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    )
    df = table(spark, sf, "customer").select(written.alias("country_label"))
    return places.country_iso(df, countries).groupBy("iso_alpha").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey FROM part WHERE p_brand IN ('Brand#3', 'Brand#7') OR p_type = 'SMALL'""")
def filter_multivalue(spark, sf):
    df = table(spark, sf, "part").withColumn("v", F.concat("p_brand", F.lit(" | "), "p_type"))
    return df.filter(labels.contains_any("v", ["Brand#3", "Brand#7", "SMALL"])).select("p_partkey")


@query("""WITH logits AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS z FROM embeddings),
  probs AS (SELECT vec_id, pos, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM logits),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, pos) AS r FROM probs)
  SELECT vec_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY r) AS top_labels, round(max(p), 6) AS confidence FROM ranked WHERE r <= 3 GROUP BY 1""")
def softmax_topk(spark, sf):
    ranked = vectors.top_scores(vectors.softmax("embedding"), 3)
    return table(spark, sf, "embeddings").select("vec_id", ranked.alias("t")).select(
        "vec_id",
        F.array_join(F.transform("t", lambda e: e["label"].cast("string")), ",").alias("top_labels"),
        F.round(F.get("t", F.lit(0))["score"], 6).alias("confidence"),
    )


@query("""WITH z AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v FROM embeddings),
  p AS (SELECT vec_id, pos, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM z),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, pos) AS r FROM p)
  SELECT vec_id, string_agg('c' || pos || ': ' || printf('%.4f', p), ' | ' ORDER BY r) AS top_3 FROM r WHERE r <= 3 GROUP BY 1""")
def top3_text(spark, sf):
    ranked = vectors.top_scores(vectors.softmax("embedding"), 3, [f"c{i}" for i in range(64)])
    return table(spark, sf, "embeddings").select("vec_id", vectors.scores_text(ranked).alias("top_3"))


@query("""WITH v AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3)) AS v FROM embeddings)
  SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS v FROM v""")
def l2_normalize(spark, sf):
    unit = vectors.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("""SELECT CAST(user_id AS INTEGER) AS cluster_label, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1""")
def cast_cluster_label(spark, sf):
    raw = F.when(F.col("event_type") == "error", F.lit("noise")).otherwise(F.col("user_id").cast("string"))
    df = table(spark, sf, "events").select(raw.alias("cluster_label"))
    return catalog.cast_cluster_label(df).groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n"))
