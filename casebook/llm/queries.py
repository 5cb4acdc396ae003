"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, contamination, fixity, language, near, negatives, packing, passages, quality, repeats, toxicity, wrappers
from .tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


_WORD_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@query(f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORD_SQL} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS MATERIALIZED (SELECT s, count(*) AS df FROM s GROUP BY 1),
o AS MATERIALIZED (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS r FROM s JOIN f USING (s) JOIN n USING (doc_id)),
p AS MATERIALIZED (SELECT doc_id, s, n FROM o WHERE r <= n - (80 * n + 99) // 100 + 1),
c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
e AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.s = x.s
    GROUP BY c.a, c.b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
g AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, least(a, b) AS m FROM g UNION SELECT g.b, r.m FROM r JOIN g ON g.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.m, d.doc_id) AS component_id, coalesce(k.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY 1) k USING (doc_id)
""")
def op5_minhash_near_dedup(spark, sf):
    """Near-duplicate classes over two-word shingles at 0.8."""
    return near.near_classes(read(spark, sf, "documents"), near.NearSettings(width=2, percent=80))


@query()
def op10_suffix_array_dedup(spark, sf):
    """Bytes left after the removal of repeated strings of 100 bytes."""
    out = repeats.remove_repeats(read(spark, sf, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op3_quality_rules(spark, sf):
    """Counts, rules and the verdict of the line field for every document."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf, "labels"))
    return quality.judge(docs, model).drop("text")


@query()
def op2_benchmark_decontamination(spark, sf):
    """Documents that hold a copy, edited or not, of a benchmark item."""
    return contamination.matches(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query()
def op6_best_fit_packing(spark, sf):
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return packing.pack(read(spark, sf, "documents"))


_CONTROL_SQL = r"<\|(?:turn|text|end|im_start|im_end|startoftext|endoftext)\||</?s>|\[/?INST\]|<</?SYS>>"


def _added_sql(column: str) -> str:
    """Characters that escaping adds: one for each backslash and each control string."""
    return rf"length({column}) - length(replace({column}, '\', '')) + len(regexp_extract_all({column}, '{_CONTROL_SQL}'))"


@query(f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + length(text) + {len(chat.TURN + chat.TEXT + chat.END)} + {_added_sql("role")} + {_added_sql("text")} AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op1_chat_formatting(spark, sf):
    """Every conversation as one string, and what reading it back gives."""
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    out = chat.formatted(chat.conversation_messages(rows.unionByName(probe)))
    out = out.withColumn("turns", chat.read_turns(F.col("text"))).withColumn("learned", chat.read_loss(F.col("text"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("text").cast("bigint").alias("formatted_chars"),
    )


@query()
def op4_toxicity(spark, sf):
    """Score of every document; labels of held-out documents are not seen."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    docs = read(spark, sf, "documents").select("doc_id", "text")
    lexicon = toxicity.train(docs, read(spark, sf, "labels").filter(remainder != 0))
    return toxicity.score(docs.withColumn("held_out", remainder == 0), lexicon)


@query()
def op8_lm_scoring(spark, sf):
    """Log probability of every document under the recurrent model and under add-one counts."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    docs = read(spark, sf, "documents").select("doc_id", "text").withColumn("held_out", held_out)
    return language.score(docs, ~F.col("held_out"))


@query()
def op7_html_extraction(spark, sf):
    """Main text of every page."""
    return wrappers.extract(read(spark, sf, "pages").select("page_id", "url", "html"))


@query("""
WITH r AS (SELECT page_id, page_id // 512 AS file, octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10))) AS length FROM pages),
i AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page_id) - 1 AS ordinal,
    coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM r)
SELECT file, ordinal, page_id, "offset", length, CASE page_id % 50 WHEN 7 THEN 'altered' WHEN 23 THEN 'missing' ELSE 'altered' END AS state
FROM i WHERE page_id % 50 IN (7, 23, 41)
""")
def op9_warc_fixity(spark, sf):
    """Records in which a damaged replica of the archive of all pages differs from the sound one.

    The replica has a byte changed, lacks records, or has them cut short, by page id.
    """
    archive = fixity.records(read(spark, sf, "pages"))
    kind = F.col("page_id") % 50
    return fixity.audit(*fixity.damaged_pair(archive, kind == 7, kind == 23, kind == 41))


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) AS r FROM i),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r WHERE r > 1),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM t),
l AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM k ANTI JOIN g USING (doc_id, k) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
""")
def op13_substring_dedup(spark, sf):
    """Words left after the removal of repeated windows of 20 words."""
    out = passages.remove_passages(read(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("""
WITH e AS MATERIALIZED (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
""")
def op11_hard_negative_mining(spark, sf):
    """The first ten rows of another label with 30 to 90 percent of the score of each of an anchor's first five positives."""
    rows = read(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    label = F.col("label").cast("bigint")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query()
def op12_tokenizer_alignment(spark, sf):
    """Groups and links between the tokens of two tokenizers for every document."""
    return alignment.align_documents(read(spark, sf, "documents").select("doc_id", "text"))
