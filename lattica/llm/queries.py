"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import chat, media, minhash, mixing, packing, quality, resampling, sharding, simhash, spelling, token_store, toxicity, url_filter
from .common import literal_table, load, shared_dir
from .tokens import tokenizer_path


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(load(spark, sf_dir, "documents"), (1, 2, 3), cap=3.0)
    return mixing.taken_words(mix)


#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_table(spark, [dict(zip(("verdict", "host", "path"), r)) for r in URL_RULES], "verdict string, host string, path string")
    judged = url_filter.judge_urls(load(spark, sf_dir, "pages").select("page_id", "url"), rules, default="allow")
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM u),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM h),
rules(v, rh, rp) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
hit AS (SELECT page_id, host, path, max_by(struct_pack(rule := rh || rp, v := v), length(rh || rp)) AS b
        FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, hit.b.rule AS rule, coalesce(hit.b.v, 'allow') AS verdict
FROM p LEFT JOIN hit USING (page_id)
"""

def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    store = token_store.write_tokens(docs, f"{shared_dir(spark)}/tokens", tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.crc_of_ids(token_store.read_tokens(token_store.lookup(docs, store), store))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, learn_from=~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score_texts(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=4, budget=4)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    rules = quality.learn_rules(docs, labels)
    stats = quality.text_statistics(docs.select("doc_id", "text"), keep_text=False).withColumn("base_failed", quality.base_failed())
    kept = ~F.col("base_failed") & quality.verdict(rules)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return media.digest(media.describe_media(media.mux_texts(docs), "media"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


#: The tools whose calls op9 reads from conversations.
TOOLS = [("reply", "text", "string", True), ("reply", "turn", "integer", True), ("configure", "text", "string", True), ("configure", "turn", "integer", False)]


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool calls.

    A user's turn calls ``reply``, or ``retract``, which no schema knows; a system's calls
    ``configure``; the assistant's next turn is the result. By conv_id mod 3, a call needs the
    one two turns before it, or the ones one, two and four turns after it, or the former with turns
    2 and 3 needing the latter as well, which makes a cycle. Some calls lack an argument, give
    a number as text or add an unknown one.
    """
    turns = load(spark, sf_dir, "conversations")
    t = F.col("turn")
    name = F.when(F.col("role") == "user", F.when(t % 8 == 5, "retract").otherwise("reply")).when(F.col("role") == "system", "configure")
    call_id = lambda n: F.concat(F.lit("c"), n.cast("string"))
    fields = F.concat_ws(
        ",",
        F.when(t % 6 != 4, F.concat(F.lit('"turn" : '), F.when(t % 5 == 3, F.concat(F.lit('"'), t.cast("string"), F.lit('"'))).otherwise(t.cast("string")))),
        F.when(t % 7 != 2, F.concat(F.lit('"text": '), F.coalesce(F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1), F.lit("null")))),
        F.when(t % 7 == 6, F.lit('"note":true')),
    )
    arguments = F.concat(F.lit("{"), fields, F.lit("}"))
    before = F.array(call_id(t - 2))
    depends = F.when(F.col("conv_id") % 3 == 1, F.array(call_id(t + 4), call_id(t + 2), call_id(t + 1))).when((F.col("conv_id") % 3 == 2) & t.isin(2, 3), F.array(call_id(t - 2), call_id(t + 2))).otherwise(before)
    calls = turns.where(name.isNotNull()).select("conv_id", call_id(t).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", call_id(t - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    tools = literal_table(spark, [dict(zip(("name", "param", "kind", "required"), r)) for r in TOOLS], "name string, param string, kind string, required boolean")
    linked = chat.link_calls(calls, results, tools)
    return linked.select("conv_id", "call_id", "turn", "name", "n_calls", "n_results", "ready", "depth", F.array_join("errors", ",").alias("errors"), "status", "record")


#: A place is the largest (turn, steps) over all paths from a call to what it depends on.
OP9_SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, 'c' || turn AS call_id, turn, CASE WHEN role = 'system' THEN 'configure' WHEN turn % 8 = 5 THEN 'retract' ELSE 'reply' END AS name, text, count(*) AS n_calls
  FROM conversations WHERE role IN ('user', 'system') GROUP BY ALL),
e AS (SELECT DISTINCT a.conv_id, a.turn AS f, b.turn AS t FROM c a JOIN c b ON a.conv_id = b.conv_id AND CASE a.conv_id % 3 WHEN 1 THEN b.turn IN (a.turn + 1, a.turn + 2, a.turn + 4) WHEN 2 THEN b.turn = a.turn - 2 OR (a.turn IN (2, 3) AND b.turn = a.turn + 2) ELSE b.turn = a.turn - 2 END),
reach(conv_id, f, t) AS (SELECT * FROM e UNION SELECT r.conv_id, r.f, e.t FROM reach r JOIN e ON e.conv_id = r.conv_id AND e.f = r.t),
stuck AS (SELECT DISTINCT conv_id, f FROM reach WHERE f = t UNION SELECT r.conv_id, r.f FROM reach r JOIN reach s ON s.conv_id = r.conv_id AND s.f = r.t AND s.t = r.t),
path(conv_id, f, t, steps) AS (
  SELECT DISTINCT conv_id, turn, turn, 0::BIGINT FROM c WHERE NOT EXISTS (FROM stuck s WHERE s.conv_id = c.conv_id AND s.f = c.turn)
  UNION SELECT p.conv_id, p.f, e.t, p.steps + 1 FROM path p JOIN e ON e.conv_id = p.conv_id AND e.f = p.t),
place AS (SELECT conv_id, f, max(struct_pack(ready := t, depth := steps)) AS p FROM path GROUP BY ALL),
r AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, min(struct_pack(turn := turn, text := text)).text AS result, count(*) AS n_results
      FROM conversations WHERE role = 'assistant' GROUP BY ALL),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, c.name, c.text, c.n_calls, r.n_results, r.result, r.call_id IS NOT NULL AS has,
        CASE WHEN name = 'retract' THEN 'no_such_tool' ELSE array_to_string(list_sort(list_filter([
          CASE WHEN turn % 7 = 2 THEN 'missing:text' WHEN text IS NULL THEN 'kind:text' END,
          CASE WHEN turn % 6 = 4 THEN CASE WHEN name = 'reply' THEN 'missing:turn' END WHEN turn % 5 = 3 THEN 'kind:turn' END,
          CASE WHEN turn % 7 = 6 THEN 'unknown:note' END], lambda x: x IS NOT NULL)), ',') END AS errors
      FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT j.conv_id, j.call_id, j.turn, j.name, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, place.p.ready AS ready, place.p.depth AS depth,
       CASE WHEN j.name IS NOT NULL THEN errors END AS errors,
       CASE WHEN j.name IS NULL THEN 'orphan_result' WHEN place.p IS NULL AND j.conv_id IS NOT NULL THEN 'cycle' WHEN errors <> '' THEN 'invalid' WHEN has THEN 'linked' ELSE 'no_result' END AS status,
       '{"arguments":' || CASE WHEN j.name IS NULL THEN 'null' ELSE '{' || array_to_string(list_filter([
          CASE WHEN j.turn % 7 = 6 THEN '"note":true' END, CASE WHEN j.turn % 7 <> 2 THEN '"text":' || coalesce(to_json(text), 'null') END,
          CASE WHEN j.turn % 6 <> 4 THEN '"turn":' || CASE WHEN j.turn % 5 = 3 THEN '"' || j.turn || '"' ELSE j.turn::VARCHAR END END], lambda x: x IS NOT NULL), ',') || '}' END
       || ',"call_id":' || to_json(j.call_id) || ',"conv_id":' || j.conv_id || ',"name":' || coalesce(to_json(j.name), 'null') || ',"result":' || coalesce(to_json(result), 'null') || '}' AS record
FROM j LEFT JOIN place ON place.conv_id = j.conv_id AND place.f = j.turn
"""

SHARD_BYTES = 1 << 20


def op10_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = load(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards"
    sharding.write_shards(docs, sharding.shard_rows(docs, SHARD_BYTES), path)
    found = sharding.written_sizes(sharding.read_shards(docs, path))
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "shard", F.col("depth").cast("long").alias("depth"), "page", "shard_bytes")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS b,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 10) || substr(md5(coalesce(text, '')), 1, 5))::BIGINT AS h FROM documents),
n AS (SELECT k AS depth, h >> (60 - k) AS prefix, sum(b) AS bytes, count(*) AS n FROM d, range(0, 31) t(k) GROUP BY ALL),
leaf AS (SELECT c.depth, c.prefix, c.bytes FROM n c LEFT JOIN n p ON p.depth = c.depth - 1 AND p.prefix = c.prefix >> 1
         WHERE (c.bytes <= {SHARD_BYTES} OR c.n <= 1) AND (c.depth = 0 OR (p.bytes > {SHARD_BYTES} AND p.n > 1)))
SELECT doc_id, b AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard, depth::BIGINT AS depth, 0::BIGINT AS page, bytes::BIGINT AS shard_bytes
FROM d JOIN leaf ON leaf.prefix = d.h >> (60 - leaf.depth)
"""

def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=4, similarity=0.8)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), share=0.25, least_words=20, seed=7)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(load(spark, sf_dir, "documents"), least=7, occurrences=2, every=31), ratio=10)


UPPER_TO_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: doc_ids are distinct here.
OP11_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({UPPER_TO_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE len(w) WHEN 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - 2)), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
pairs AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c, min(a.n) AS an, min(b.n) AS bn FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT i, j FROM pairs WHERE 100 * c >= 80 * (an + bn - c)),
both_ways AS (FROM e UNION ALL SELECT j, i FROM e),
reach(i, j) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.i, b.j FROM reach r JOIN both_ways b ON b.i = r.j)
SELECT doc_id, len(sh) AS n_shingles, min(j) AS component_id, doc_id = min(j) AS kept FROM s JOIN reach ON i = doc_id GROUP BY doc_id, sh
"""

#: crc(w) of texts: the table of a byte's remainders, then a step for each byte of the text in UTF-8.
CRC_TABLE = "tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({w}))), lambda k: ('0x' || substr(hex(encode({w})), 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

OP12_SQL = rf"""
WITH {CRC_TABLE},
texts AS (SELECT 0 AS own, doc_id AS id, {UPPER_TO_LOWER} AS text FROM documents UNION ALL SELECT 1, item_id, {UPPER_TO_LOWER} FROM benchmark),
w AS (SELECT own, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT own, id, len(w) AS n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
b AS (SELECT f, {CRC.format(w="f")} % 10000 AS b FROM (SELECT DISTINCT f FROM f), tab),
c AS (SELECT own, id, b, count(*) AS c FROM f JOIN b USING (f) GROUP BY ALL),
sums AS (SELECT b, coalesce(sum(c) FILTER (own = 0), 0) AS s, coalesce(sum(c) FILTER (own = 1), 0) AS t FROM c GROUP BY b),
every AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums),
gain AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g FROM sums, every),
m AS (SELECT id, sum(c)::BIGINT AS n, floor(sum(c * g) / sum(c))::BIGINT AS weight FROM c JOIN gain USING (b) WHERE own = 0 GROUP BY id),
scored AS (SELECT w.id, len(w) AS words, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN m USING (id) WHERE own = 0),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r, count(*) OVER () AS n FROM scored WHERE words >= 20)
SELECT id AS doc_id, scored.n AS n_features, weight, score, CASE WHEN r <= 25 * r.n // 100 THEN r END AS rank FROM scored LEFT JOIN r USING (id)
"""

OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
occ AS (SELECT doc_id, unnest(regexp_extract_all({UPPER_TO_LOWER}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
o AS (SELECT doc_id, w, count(*) AS n FROM occ WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, {CRC.format(w="(doc_id || ':' || w)")} AS h FROM o, tab),
x AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h),
c AS (SELECT w, sum(n)::BIGINT AS n FROM x WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
cut AS (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS r FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM c)),
pairs AS (SELECT a.w AS v, b.w AS w FROM cut a JOIN cut b ON a.r = b.r AND a.i = b.i AND a.w <> b.w UNION SELECT cut.w, c.w FROM cut JOIN c ON c.w = cut.r UNION SELECT c.w, cut.w FROM cut JOIN c ON c.w = cut.r),
near AS (SELECT v AS w, count(*) AS n_near, min(struct_pack(m := -c.n, w := c.w)) AS best FROM pairs JOIN c ON c.w = pairs.w GROUP BY v),
formed AS (SELECT c.w, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * c.n THEN best.w END AS form, CASE WHEN -best.m >= 10 * c.n THEN -best.m END AS form_n FROM c LEFT JOIN near ON near.w = c.w),
up(w, head) AS (SELECT w, w FROM formed UNION SELECT up.w, f.form FROM up JOIN formed f ON f.w = up.head WHERE f.form IS NOT NULL)
SELECT formed.w AS word, formed.form AS form, head AS root, formed.n AS n, formed.n_near AS n_near, formed.form_n AS form_n FROM formed JOIN up ON up.w = formed.w JOIN formed top ON top.w = up.head AND top.form IS NULL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_url_filter": op2_url_filter,
    "op3_token_store": op3_token_store,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_media_columns": op7_media_columns,
    "op8_packing": op8_packing,
    "op9_tool_calls": op9_tool_calls,
    "op10_extendible_sharding": op10_extendible_sharding,
    "op11_circulant_minhash": op11_circulant_minhash,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": OP2_SQL,
    "op9_tool_calls": OP9_SQL,
    "op10_extendible_sharding": OP10_SQL,
    "op11_circulant_minhash": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
