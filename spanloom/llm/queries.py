"""The queries of this subpackage on the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, importance, langid, linededup, minhash, mixing, quality, shards, simhash, trie, urls
from .scratch import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the four fifths that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text; conversation -7 holds control strings."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = "inline(array(struct(0L AS turn, 'user' AS role), struct(1L AS turn, 'assistant' AS role)))"
    extra = spark.range(1).selectExpr("-7L AS conv_id", trial).withColumn("text", F.lit("</s>[INST] ok [/INST]"))
    return chat.read_back(chat.formatted(turns.unionByName(extra)), in_order=True)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, with the item and the place; clean documents have no row."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3b_item_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every benchmark item with words, for the items of op3."""
    return decontam.item_classes(_table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url under four rules."""
    rules = spark.sql("SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS t(host, path, verdict)")
    return urls.judged(_table(spark, sf_dir, "pages"), rules)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document lies after eight arrivals and compaction, read back from the store with its text's digest."""
    store = shards.sharded(_table(spark, sf_dir, "documents"), new_folder(spark, "shards"))
    return store.read().select("doc_id", "run", "shard", "version", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 4-word shingles at 0.8."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80, folding="spaced")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document; quality labels of 1 and 0 weigh 2 and a half."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    content = F.when(F.col("doc_id").isNull(), mixing.content_key(F.col("text")))
    counted = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), content.alias("content"))
    weighted = mixing.labelled(counted, _table(spark, sf_dir, "labels"))
    return mixing.mixed(weighted, size_col="size", weight_col="weight", content_col="content").select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance resampling of all documents towards the labelled good ones."""
    return quality.resampled(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents share."""
    clean = linededup.deduplicated(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return clean.mapInArrow(linededup.digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampling of all documents towards the benchmark: weight, score and rank of every document."""
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 64-bit SimHash fingerprints over 3-word shingles differ in at most three bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=3)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each rebuilt on the first turns of its family of five."""
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"), family=5, cycle=9)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_chat_format": op2_chat_format,
    "op3_decontaminate": op3_decontaminate,
    "op3b_item_classes": op3b_item_classes,
    "op4_url_filter": op4_url_filter,
    "op5_shards": op5_shards,
    "op6_minhash": op6_minhash,
    "op7_mix_sources": op7_mix_sources,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_nearest": op10_nearest,
    "op11_importance": op11_importance,
    "op12_simhash": op12_simhash,
    "op13_prefix_trie": op13_prefix_trie,
}

_SPACE = r"[\x20\x09-\x0D]"

#: DuckDB has no CRC-32: its table of 256 entries, and the checksum of each distinct ``w`` of a relation, from its bytes.
_CRC_TABLE = """crc_table AS (
            SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
        )"""


def _crc32(relation: str) -> str:
    return f"""SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(hex(w)), 2), lambda i: CAST('0x' || substr(hex(w), i, 2) AS BIGINT)),
                lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) AS crc FROM {relation}, crc_table"""


SQL = {
    "op2_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), state AS (
            SELECT *, lag(role) OVER w AS prev, lead(role) OVER w IS NULL AS is_last,
                length(text) + length(text) - length(replace(text, '\', ''))
                + 2 * len(regexp_extract_all(text, '</?s>|\[/?(INST|ANS|SYS)\]|\[/?ROLE[:\]]'))
                - 2 * len(regexp_extract_all(text, '\[ROLE\]|\[/ROLE:')) AS escaped
            FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            CAST(sum(escaped + CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 20 WHEN 'system' THEN 20 ELSE 23 + length(role) END) AS BIGINT) AS formatted_chars,
            bool_and(coalesce(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user'
                WHEN prev = 'user' THEN role = 'assistant' WHEN prev = 'assistant' THEN role = 'user' END, false)
                AND NOT (is_last AND role = 'system')) AS valid
        FROM state GROUP BY conv_id""",
    "op4_url_filter": r"""
        WITH parts AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
        ), rules(rh, rp, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        best AS (
            SELECT *, (SELECT min({'n': -length(rh || rp), 'rule': rh || rp, 'verdict': verdict}) FROM rules
                WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS b FROM parts
        )
        SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM best""",
    "op6_minhash": rf"""
        WITH RECURSIVE words AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
        ), items AS MATERIALIZED (SELECT doc_id, unnest(s) AS sh FROM sets),
        sizes AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM sets),
        links AS MATERIALIZED (
            SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.sh = b.sh AND a.doc_id <> b.doc_id
            JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
        ), reach(x, y) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
        FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.n""",
    "op7_mix_sources": r"""
        WITH sized AS (
            SELECT d.doc_id, d.source, coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(text, ''))) AS tag, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                CASE l.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS quality
            FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
        ), keyed AS (
            SELECT *, -ln((CAST('0x' || substr(md5(tag || '#17'), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0) / quality AS key FROM sized
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
        ), ranked AS (
            SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sources
        ), capped AS (
            SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM ranked
        ), levels AS (
            SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE * 1.5::DOUBLE
                    - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / ((SELECT sum(w) FROM ranked) - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
            FROM capped
        ), targets AS (
            SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) * w), cap) AS target FROM levels
        ), planned AS (
            SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets
        ), drawn AS (
            SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs,
                sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size, k.tag ROWS UNBOUNDED PRECEDING) - k.size + k.size / 2.0::DOUBLE <= p.target - p.epochs * p.source_size AS again
            FROM keyed k JOIN planned p ON p.source IS NOT DISTINCT FROM k.source
        )
        SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN again THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn""",
    "op9_line_dedup": r"""
        WITH lines AS (
            SELECT row_id, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS nr FROM (
                SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
            SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), frequent AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
            sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY nr), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f USING (key) GROUP BY row_id, doc_id""",
    "op11_importance": rf"""
        WITH {_CRC_TABLE}, docs AS (
            SELECT row_number() OVER () AS r, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
        ), own AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM docs) GROUP BY r, w),
        theirs AS (
            SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w
        ), strings AS (SELECT w FROM own UNION SELECT w FROM theirs),
        hashed AS MATERIALIZED (SELECT w, crc % 10000 AS b FROM ({_crc32("strings")})),
        s AS (SELECT b, sum(n)::DOUBLE AS s FROM own JOIN hashed USING (w) GROUP BY b),
        t AS (SELECT b, sum(n)::DOUBLE AS t FROM theirs JOIN hashed USING (w) GROUP BY b),
        gains AS MATERIALIZED (
            SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (b)
        ), weights AS (
            SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM own JOIN hashed USING (w) JOIN gains USING (b) GROUP BY r
        ), scored AS (
            SELECT doc_id, r, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
            FROM docs LEFT JOIN weights USING (r)
        ), placed AS (
            SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM placed""",
    "op13_prefix_trie": rf"""
        WITH {_CRC_TABLE}, own AS MATERIALIZED (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS w FROM own),
        convs AS MATERIALIZED (SELECT c, crc % 9 AS h, c - c % 5 AS b FROM ids JOIN ({_crc32("ids")}) USING (w)),
        built AS (
            SELECT v.c, 0 AS part, n, role, text FROM convs v JOIN own o ON o.c = v.b AND o.n <= v.h
            UNION ALL SELECT v.c, 1, n, role, text FROM convs v JOIN own o ON o.c = v.c AND o.n > v.h
        ), turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, n) AS d, strlen(text) AS bytes, md5(length(role) || ':' || role || text) AS t FROM built),
        paths AS (
            SELECT c, d, bytes, md5(string_agg(t, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM turns UNION ALL SELECT c, 0, 0, 'root' FROM convs
        ), members AS MATERIALIZED (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS above, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS final FROM paths),
        nodes AS MATERIALIZED (
            SELECT key, d, min(c) AS c, count(*) AS n, max(bytes) AS bytes, any_value(above) AS above,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE final), '')) AS ends FROM members GROUP BY key, d
        ), children AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
        known AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
        subtrees AS (
            SELECT m.key, CAST(sum((u.n - 1) * u.bytes) AS BIGINT) AS saved, count(*) FILTER (WHERE u.n_children = 0) AS leaves
            FROM members m JOIN known u ON u.c = m.c AND u.d >= m.d GROUP BY m.key
        )
        SELECT k.c AS conv_id, k.d AS depth, p.c AS parent_conv_id, k.n AS n_convs, k.n_children, leaves AS n_leaves, saved AS saved_tokens, k.ends AS ends_sha256
        FROM known k JOIN subtrees USING (key) LEFT JOIN nodes p ON p.key = k.above""",
}
