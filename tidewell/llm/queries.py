"""One query per operator over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import (
    chat,
    conversation_repair,
    decontamination,
    jaccard,
    language,
    licences,
    line_dedup,
    packing,
    runs,
    sharding,
    token_counts,
    topk,
    warc,
)
from tidewell.llm.common import UPPER, table
from tidewell.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = f"'{UPPER}', '{UPPER.lower()}'"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


@query(
    "op4_line_dedup",
    f"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    keyed AS (SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM lines),
    shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
               GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first AS gone
               FROM keyed k LEFT JOIN shared s ON k.key = s.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


@query(
    "op10_decontamination",
    f"""
    WITH i AS (SELECT item_id, regexp_extract_all(translate(text, {_LOWER}), {_WORDS}) AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, size, list_slice(w, s, s + size - 1) AS win FROM (
        SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s
        FROM i WHERE len(w) > 0)),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORDS}) AS w FROM documents),
    places AS (
      SELECT doc_id, w, s, size FROM (SELECT DISTINCT size FROM windows) z,
        LATERAL (SELECT doc_id, w, unnest(range(1, len(w) - size + 2)) AS s FROM d WHERE len(w) >= size) p),
    hits AS (SELECT p.doc_id, p.s, p.size, x.item_id FROM places p
             JOIN windows x ON x.size = p.size AND x.win = list_slice(p.w, p.s, p.s + p.size - 1)),
    words AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (
        SELECT doc_id, unnest(range(s, s + size)) AS pos FROM hits) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (
        SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
           sha256(coalesce(found.ids, '')) AS items_sha256,
           coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated
    FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN found ON d.doc_id = found.doc_id""",
)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    "op7_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
    SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END
             AS record_type,
           CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
    FROM g""",
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = work_path(spark, "archives")
    warc.write_warc(pages, path)
    return warc.read_warc(spark, path).drop("intact")


@query("op2_license_scan", licences.licence_sql(_WORDS, _LOWER))
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("op8_sharding", sharding.shard_sql())
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query(
    "op3_chat_formatting",
    """
    WITH g AS (SELECT conv_id, turn, role, text, count(*) AS n FROM conversations GROUP BY ALL),
    t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1)
            // 512 AS block FROM g),
    s AS (SELECT DISTINCT conv_id, CASE WHEN role <> 'system' THEN role END AS perspective FROM t),
    p AS (SELECT conv_id, perspective FROM s
          QUALIFY perspective IS NOT NULL OR max(perspective) OVER (PARTITION BY conv_id) IS NULL),
    e AS (SELECT t.*, perspective, role IS NOT DISTINCT FROM perspective AND role IS NOT NULL AS own,
            '<|im_start|>' || CASE WHEN role IS NOT NULL AND role = perspective THEN 'assistant'
              WHEN role = 'system' THEN 'system' WHEN role IS NULL THEN 'user'
              ELSE 'user name=' || regexp_replace(replace(role, '<|', '< |'), '[ \\t\\n\\x0B\\f\\r]', '_', 'g') END || chr(10) AS head,
            replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' AS body
          FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER w, 0) + length(head) AS start FROM e
          WINDOW w AS (PARTITION BY conv_id, perspective, block
            ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id, perspective, block, count(*) AS n_turns, CAST(sum(n) AS BIGINT) AS n_rows,
           string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text,
           coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT), ',' ORDER BY start)
             FILTER (own), '') AS mask
    FROM o GROUP BY conv_id, perspective, block""",
)
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_languages(docs)
    out = language.identify_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query(
    "op6_exact_top_k",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
               FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1),
                 lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
    FROM s QUALIFY rank <= 20""",
)
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query(
    "op5_ngram_jaccard",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w
                         FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS sh
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y
                USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
              JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id
    FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a""",
)
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.withColumnRenamed("doc", "doc_id")


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def _made_periodic(docs: DataFrame) -> DataFrame:
    """Every tenth text, by a hash of its id, repeats a stretch of its words to the end; no id: unchanged."""
    hashed = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = hashed.withColumns({"words": F.when(F.col("h") % 10 == 0, words), "g": F.floor(F.col("h") / 10)})
    some = F.size("words") > 0
    n = F.greatest(F.size("words"), F.lit(1)).cast("long")
    placed = chosen.withColumn("a", F.col("g") % n).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(
        F.sequence(F.lit(0).cast("long"), n - F.col("a") - 1),
        lambda i: F.get("words", (F.col("a") + i % F.col("p")).cast("int")),
    )
    made = F.array_join(F.concat(F.slice("words", 1, F.col("a").cast("int")), again), " ")
    return placed.select("doc_id", F.when(some, made).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.find_runs(_made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    out = out.withColumn("top", runs.best_run())
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: CRC-32 of ASCII text by a table of 256 entries, which the rule of its polynomial gives
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])))"""
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t"""


@query(
    "op11_conversation_repair",
    f"""
    WITH RECURSIVE crc_table AS ({_CRC_TABLE}),
    f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(
        text="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f
      FROM conversations, crc_table),
    damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
        CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE f <> 0),
    numbered AS (SELECT conv_id, turn, role, text, left(role, 1) AS c, trim(text, {_BLANKS}) AS inner_text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
    placed AS (SELECT *, i > min(i) OVER (PARTITION BY conv_id, role, text) AS again FROM numbered),
    faults AS (SELECT *, inner_text = '' AS blank, inner_text <> '' AND again AS dup,
        inner_text <> '' AND NOT again AND right(inner_text, 1) NOT IN ('.', '!', '?') AS cut,
        lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au') AS odd FROM placed),
    counts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS dup, count(*) FILTER (cut) AS cut,
        count(*) FILTER (odd) AS odd FROM faults GROUP BY conv_id),
    inserts AS (SELECT * FROM (VALUES (0, 0, []), (0, 2, ['user:']), (0, 3, ['user:', 'assistant:']),
        (1, 1, []), (1, 2, ['user:']), (1, 3, ['user:', 'assistant:']), (2, 2, []), (2, 3, ['assistant:']),
        (3, 3, []), (3, 2, ['user:'])) v(p, q, made)),
    edits AS (SELECT * FROM (VALUES ('D', NULL, 0, 0), ('D', NULL, 1, 1), ('D', NULL, 2, 2), ('D', NULL, 3, 3),
        ('K', 's', 0, 1), ('K', 'u', 0, 2), ('K', 'u', 1, 2), ('K', 'a', 2, 3), ('K', 'u', 3, 2),
        ('R', 'user', 0, 2), ('R', 'user', 1, 2), ('R', 'assistant', 2, 3), ('R', 'user', 3, 2)) v(e, x, p, q)),
    steps AS (SELECT a.p, b.q, b.e, b.x, a.made, repeat('I', len(a.made)) || b.e AS audit,
        3 * len(a.made) + CASE b.e WHEN 'R' THEN 3 WHEN 'D' THEN 4 ELSE 0 END AS cost
        FROM inserts a JOIN edits b ON b.p = a.q),
    ways AS (
      SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS made
      FROM counts
      UNION ALL
      SELECT conv_id, i, state, cost, audit, made FROM (
        SELECT w.conv_id, w.i + 1 AS i, s.q AS state,
          w.cost + s.cost + CASE WHEN r.cut AND s.e <> 'D' THEN 3 ELSE 0 END AS cost, w.audit || s.audit AS audit,
          w.made || CAST(s.made AS VARCHAR[]) || CASE s.e WHEN 'K' THEN [r.role || ':' || r.text] WHEN 'R' THEN [s.x || ':' || r.text]
            ELSE CAST([] AS VARCHAR[]) END AS made
        FROM ways w JOIN faults r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
          JOIN steps s ON s.p = w.state AND (s.e = 'D' OR (NOT r.blank AND NOT r.dup AND (s.e = 'R' OR s.x = r.c))))
      QUALIFY row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) = 1),
    ends AS (SELECT * FROM (VALUES (0, []), (1, ['user:', 'assistant:']), (2, ['assistant:']), (3, [])) v(state, made)),
    best AS (SELECT w.conv_id, w.cost + 3 * len(e.made) AS cost, w.audit || repeat('I', len(e.made)) AS audit,
        sha256(coalesce(array_to_string(w.made || CAST(e.made AS VARCHAR[]), chr(10)), '')) AS repaired
      FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN ends e ON e.state = w.state
      QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * len(e.made), w.audit || repeat('I', len(e.made))) = 1)
    SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.dup, 0) AS duplicate,
      coalesce(c.cut, 0) AS truncated, coalesce(c.odd, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost,
      coalesce(b.audit, '') AS audit, coalesce(b.repaired, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
      LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id""",
)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    edits, summary = conversation_repair.repair_conversations(conversation_repair.damaged(turns))
    counts = [c for c in summary.columns if c != "conv_id"]
    # all conversations, figures and digests meet in one grouping, where a null id is a key like others
    all_of = turns.select("conv_id").unionByName(summary, allowMissingColumns=True).groupBy("conv_id")
    figures = all_of.agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts])
    texts = conversation_repair.digests(edits).withColumnRenamed("name", "_name")
    out = figures.join(texts, F.col("conv_id").cast("string").eqNullSafe(F.col("_name")), "left")
    return out.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
