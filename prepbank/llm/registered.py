"""Queries of this subpackage over the given tables, and the SQL that checks them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepbank.llm import ctw, jaccard, langid, lines, mixing, packing, quality, shard, simhash, topk, trie, warc, whitening
from prepbank.llm.common import table
from prepbank.session import materialize

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


SHARDS = 24


def _scores_sql(n):
    rows = ", ".join(f"({s}, {shard.shard_constants(s)[0]}, {shard.shard_constants(s)[1]})" for s in range(n))
    return f"(VALUES {rows}) AS s(shard, a, b)"


def _best_sql(n):
    # All weights are 1, so the highest score is the largest residue.
    return f"""SELECT h, CAST(arg_max(shard, (h * a + b) % {shard.PRIME} * 100 - shard) AS INTEGER) AS shard
      FROM (SELECT DISTINCT h FROM d), {_scores_sql(n)} GROUP BY h"""


SQL_SHARD = f"""WITH d AS (
    SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size, text,
           ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {shard.PRIME} AS h FROM documents),
  now AS ({_best_sql(SHARDS)}), grown AS ({_best_sql(SHARDS + 1)}),
  n AS (SELECT greatest(1, CAST(ceil(count(*) / {shard.BUCKET_ROWS}) AS BIGINT)) AS buckets FROM documents)
SELECT doc_id, CAST(size AS BIGINT) AS size, 'key' AS law, now.shard AS shard, grown.shard AS grown_shard,
  CAST(row_number() OVER (PARTITION BY now.shard ORDER BY d.h % buckets, doc_id) - 1 AS BIGINT) AS slot
FROM d JOIN now ON d.h = now.h JOIN grown ON d.h = grown.h, n"""


@query("op10_rendezvous_shards")
def rendezvous_shards(spark, folder) -> DataFrame:
    """All documents over 24 equal shards by the key law."""
    placed = shard.assign_shards(table(spark, folder, "documents"), [1.0] * SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op10_rendezvous_shards_law", SQL_SHARD)
def rendezvous_shards_law(spark, folder) -> DataFrame:
    """The same rows without the text's crc32, which the checking SQL has no function for."""
    return rendezvous_shards(spark, folder).drop("text_crc32")


@query("op7_mix_sources")
def mix_sources(spark, folder) -> DataFrame:
    """Copies of all documents for the target weights 5, 2, 1."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


SQL_LINES = f"""WITH pages AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
  texts AS (SELECT DISTINCT source, text FROM pages WHERE text IS NOT NULL),
  totals AS (SELECT source, count(*) AS n_pages FROM texts GROUP BY source),
  named AS (SELECT source, unnest(list_distinct([trim(x, chr(32) || chr(9) || chr(13)) FOR x IN string_split(text, chr(10))])) AS line
            FROM texts),
  bad AS (SELECT source, line FROM named JOIN totals USING (source) WHERE line <> ''
          GROUP BY source, line, n_pages HAVING count(*) >= {lines.LEAST} AND count(*) > {lines.RATIO} * n_pages),
  pieces AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages),
  kept AS (SELECT p.rid, count(b.line) AS n_dropped, count(*) AS n_lines,
             coalesce(string_agg(s.line, chr(10) ORDER BY s.i) FILTER (WHERE b.line IS NULL), '') AS text
           FROM pieces s JOIN pages p USING (rid)
           LEFT JOIN bad b ON b.source = p.source AND b.line = trim(s.line, chr(32) || chr(9) || chr(13)) GROUP BY p.rid)
SELECT doc_id, source, kept.text AS text, CAST(n_dropped AS BIGINT) AS n_dropped FROM pages JOIN kept USING (rid)"""


@query("op6_line_dedup", SQL_LINES)
def line_dedup(spark, folder) -> DataFrame:
    """All documents without the boilerplate lines of their source."""
    cleaned = lines.drop_boilerplate(table(spark, folder, "documents"), dropped_col="n_dropped")
    return cleaned.select("doc_id", "source", "text", "n_dropped")


def tokenizer_path(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_best_fit_packing")
def best_fit_packing(spark, folder) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


@query("op8_compression_rules")
def compression_rules(spark, folder) -> DataFrame:
    """Counts and verdicts on all documents."""
    return quality.compression_rules(table(spark, folder, "documents"))


SQL_WARC = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
  f AS (SELECT *, CASE WHEN n >= {warc.MIN_SHARED_BYTES} THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


@query("op9_warc_round_trip", SQL_WARC)
def warc_round_trip(spark, folder) -> DataFrame:
    """All pages written as WARC records, indexed and read back through the index."""
    return warc.archive_round_trip(spark, table(spark, folder, "pages")).drop("url")


@query("op1_simhash_near_duplicates")
def simhash_near_duplicates(spark, folder) -> DataFrame:
    """Fingerprint and component of all documents."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def fold(modulus):
    """Remainder of the crc32 of doc_id as text; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


@query("op2_context_tree_score")
def context_tree_score(spark, folder) -> DataFrame:
    """Scores of all documents, learned from those outside the held-out tenth."""
    return ctw.score_texts(table(spark, folder, "documents"), fold(10) == 0)


SQL_TOP = f"""WITH v AS (SELECT vec_id, [CAST(floor({topk.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {topk.K}"""


@query("op3_inner_product_top_k", SQL_TOP)
def inner_product_top_k(spark, folder) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return topk.top_k(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


@query("op4_language_id")
def language_id(spark, folder) -> DataFrame:
    """Language of all documents, learned from three folds of four."""
    found = langid.identify(table(spark, folder, "documents"), fold(4) != 2)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op11_whiten_embeddings")
def whiten_embeddings(spark, folder) -> DataFrame:
    """Whitened coordinates of all embeddings on their four strongest components."""
    return whitening.whiten(table(spark, folder, "embeddings"))


# Conversations start with turns of the one at their five's beginning: as many as the crc32 of their id, modulo nine.
FIVE, GRAFTS = 5, 9

SQL_TRIE = f"""WITH RECURSIVE bits(i, k, v) AS (
    SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) t(i) UNION ALL
    SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
  codes AS (SELECT i, v FROM bits WHERE k = 8),
  turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no,
      struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS e FROM conversations WHERE conv_id IS NOT NULL),
  sizes AS (SELECT c, max(no) AS size FROM turns GROUP BY c),
  crc(c, s, no, v) AS (SELECT c, CAST(c AS VARCHAR), 1, CAST(4294967295 AS BIGINT) FROM sizes UNION ALL
    SELECT c, s, no + 1, xor(crc.v >> 8, codes.v) FROM crc JOIN codes ON codes.i = xor(crc.v & 255, ascii(substr(s, no, 1)))
    WHERE no <= length(s)),
  plans AS (SELECT crc.c, xor(v, 4294967295) % {GRAFTS} AS h, crc.c - crc.c % {FIVE} AS base, coalesce(b.size, 0) AS base_size
    FROM crc LEFT JOIN sizes b ON b.c = crc.c - crc.c % {FIVE} WHERE no = length(s) + 1),
  rebuilt AS (SELECT p.c, least(h, base_size) + no - h AS d, e FROM plans p JOIN turns t ON t.c = p.c AND no > h
    UNION ALL SELECT p.c, no, e FROM plans p JOIN turns t ON t.c = p.base AND no <= h
    UNION ALL SELECT c, 0, struct_pack(r := '', t := '') FROM plans),
  paths AS (SELECT c, d, e, list(e) OVER (PARTITION BY c ORDER BY d) AS p, max(d) OVER (PARTITION BY c) AS size FROM rebuilt),
  nodes AS (SELECT min(c) AS owner, d, p, count(*) AS n, any_value(octet_length(encode(e.t))) AS bytes, max(size) = d AS leaf,
      sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE size = d), '')) AS ends FROM paths GROUP BY d, p),
  spots AS (SELECT x.c, x.d, n.owner FROM paths x JOIN nodes n ON n.d = x.d AND n.p = x.p),
  totals AS (SELECT spots.owner, spots.d, sum(CAST(leaf AS BIGINT)) AS n_leaves, sum((n - 1) * CASE WHEN u.d = 0 THEN 0 ELSE bytes END) AS saved
    FROM nodes u JOIN spots ON spots.c = u.owner AND spots.d <= u.d GROUP BY spots.owner, spots.d),
  edges AS (SELECT u.owner, u.d, spots.owner AS parent FROM nodes u JOIN spots ON spots.c = u.owner AND spots.d = u.d - 1),
  children AS (SELECT parent, d - 1 AS d, count(*) AS k FROM edges GROUP BY parent, d)
SELECT u.owner AS conv_id, CAST(u.d AS BIGINT) AS depth, e.parent AS parent_conv_id, CAST(n AS BIGINT) AS n_convs,
  CAST(coalesce(k, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM nodes u JOIN totals t ON t.owner = u.owner AND t.d = u.d LEFT JOIN edges e ON e.owner = u.owner AND e.d = u.d
  LEFT JOIN children c ON c.parent = u.owner AND c.d = u.d"""


@query("op13_conversation_trie", SQL_TRIE)
def conversation_trie(spark, folder) -> DataFrame:
    """All nodes of the prefix trie of all rebuilt conversations."""
    turns = materialize(trie.ordered_turns(table(spark, folder, "conversations")), "turns")
    conv = F.col("conv")
    taken = F.crc32(conv.cast("string").cast("binary")) % GRAFTS
    return trie.trie_report(*trie.graft(turns, conv - conv % FIVE, taken, GRAFTS - 1))


_GRAM = " || ' ' || ".join(["word", *[f"lead(word, {i}) OVER o" for i in range(1, jaccard.WORDS)]])
SQL_JACCARD = f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
  runs AS (SELECT rid, {_GRAM} AS g FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
  shingles AS (SELECT DISTINCT rid, hash(g) AS g FROM runs WHERE g IS NOT NULL
    UNION ALL SELECT rid, hash(array_to_string(w, ' ')) FROM docs WHERE len(w) BETWEEN 1 AND {jaccard.WORDS - 1}),
  listed AS (SELECT rid, list(g ORDER BY g) AS s FROM shingles GROUP BY rid),
  sets AS MATERIALIZED (SELECT d.rid, doc_id, coalesce(s, []) AS s FROM docs d LEFT JOIN listed l ON l.rid = d.rid),
  classes AS (SELECT s, min(rid) AS cid, min(doc_id) AS first, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
  grams AS (SELECT cid, n, unnest(s) AS g FROM classes),
  pairs AS (SELECT a.cid AS a, b.cid AS b, a.n + b.n AS total, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.cid < b.cid
    AND 100 * least(a.n, b.n) >= {jaccard.PERCENT} * greatest(a.n, b.n) GROUP BY a.cid, b.cid, a.n, b.n),
  links AS (SELECT a, b FROM pairs WHERE 100 * shared >= {jaccard.PERCENT} * (total - shared)),
  both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach(a, b) AS (SELECT cid, cid FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
  heads AS (SELECT r.a AS cid, min(c.first) AS best FROM reach r JOIN classes c ON c.cid = r.b GROUP BY r.a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN len(sets.s) > 0 THEN best ELSE sets.doc_id END AS component_id
FROM sets LEFT JOIN classes c ON c.s = sets.s LEFT JOIN heads h ON h.cid = c.cid"""


@query("op12_ngram_jaccard", SQL_JACCARD)
def ngram_jaccard(spark, folder) -> DataFrame:
    """All documents with the component of their 4-word shingles at a similarity of 0.85 or more."""
    return jaccard.jaccard_components(table(spark, folder, "documents"))
