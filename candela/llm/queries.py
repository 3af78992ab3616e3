"""The registered queries of this subpackage: ``queries()`` and, where SQL can express one, ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import chat, decontaminate, fill_middle, ngram_quality, packing, quality_rules, resample, secrets, sharding, simhash, substrings, tiers, tokens


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return d.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), sha(F.array_join("hit_items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return d.select("doc_id", "n_assign", "n_access", "n_hex", sha(secrets.listed(F.col("spans"), base_only=True)).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", sha(F.col("kept")).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ngram_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "lang", "n_units", "perplexity", "low", "high", "kept")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"])


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_middle.transform(table(spark, sf_dir, "documents"), keep=["doc_id"])
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def op12_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_shards": op1_shards,
        "op2_perspectives": op2_perspectives,
        "op3_decontaminate": op3_decontaminate,
        "op4_secrets": op4_secrets,
        "op5_simhash": op5_simhash,
        "op6_quality": op6_quality,
        "op7_pack": op7_pack,
        "op8_token_counts": op8_token_counts,
        "op9_substrings": op9_substrings,
        "op10_quality_rules": op10_quality_rules,
        "op11_fill_middle": op11_fill_middle,
        "op12_tiers": op12_tiers,
        "op13_resample": op13_resample,
    }


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP2_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
j AS (SELECT t.conv_id, p.perspective, t.turn, t.text, t.speaker = p.perspective AS mine,
             CASE WHEN t.speaker = p.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system' ELSE 'user' END AS role,
             CASE WHEN t.speaker <> p.perspective AND t.speaker <> 'system' THEN t.speaker END AS name
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|' || role || coalesce(' name=' || replace(replace(name, '<|', '< |'), '|>', '| >'), '') || '|>' || chr(10) AS head FROM j)
SELECT conv_id, perspective, turn, role, name, head || text || '<|end|>' || chr(10) AS rendered,
       CASE WHEN mine THEN CAST(length(head) AS BIGINT) ELSE 0 END AS loss_start,
       CASE WHEN mine THEN CAST(length(head) + length(text) + 7 AS BIGINT) ELSE 0 END AS loss_end
FROM h
"""


_SPACE = r"[^\x20\x09-\x0D]+"

OP9_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least_of AS (SELECT t, min(doc_id) AS first FROM win GROUP BY t),
gone AS (SELECT DISTINCT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least_of USING (t) WHERE first < win.doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS s FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


def _op10_sql() -> str:
    words = quality_rules.WORDS
    quoted = ", ".join(f"'{w}'" for w in words)
    chain, last = [], "t"
    for k, (_, pattern) in enumerate(quality_rules.CLASSES):
        sql_pattern = pattern.replace(r"\s", r"\x20\x09-\x0D") if pattern != r"\s+" else r"[\x20\x09-\x0D]+"
        chain.append(f"regexp_replace({last}, '{sql_pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS r{k}")
        last = f"r{k}"
    steps = "".join(f", c{k} AS (SELECT *, {c} FROM {'d' if k == 0 else f'c{k - 1}'})" for k, c in enumerate(chain))
    n = len(chain)
    classes = ", ".join([f"length({'t' if k == 0 else f'r{k - 1}'}) - length(r{k})" for k in range(n)] + [f"length(r{n - 1})"])
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents){steps},
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM tri) WHERE k > 1) GROUP BY doc_id),
f AS (SELECT c{n - 1}.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS ls, coalesce(rep.n, 0) AS n_repeat_words, [{classes}] AS ch,
        list_filter(string_split_regex(lower(t), '[^\\p{{L}}]+'), lambda x: x IN ({quoted})) AS cw
      FROM c{n - 1} LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        list_append(list_transform([{quoted}], lambda v: len(list_filter(cw, lambda x: x = v))), greatest(n_words - len(cw), 0)) AS hw FROM f),
b AS (SELECT doc_id, lang, base_failed, unnest([1, 2]) AS kind, unnest([ch, hw]) AS h FROM g),
e AS (SELECT doc_id, lang, base_failed, kind, unnest(h) AS c, unnest(range(len(h))) AS bin, list_sum(h) AS s FROM b),
ref AS (SELECT lang, kind, bin, sum(c) AS c FROM e WHERE NOT base_failed GROUP BY ALL),
rt AS (SELECT *, c / sum(c) OVER (PARTITION BY lang, kind) AS q FROM ref),
js AS (SELECT doc_id, kind, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS dist
       FROM (SELECT e.doc_id, e.kind, e.c / nullif(e.s, 0)::DOUBLE AS p, rt.q::DOUBLE AS q FROM e JOIN rt USING (lang, kind, bin)) GROUP BY doc_id, kind)
SELECT g.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND (list_sum(ch) < {quality_rules.MIN_CHARS} OR coalesce(a.dist, 0) <= {quality_rules.MAX_CHAR_DISTANCE}) AND (n_words < {quality_rules.MIN_COMPARED} OR coalesce(z.dist, 0) <= {quality_rules.MAX_WORD_DISTANCE}) AS kept
FROM g LEFT JOIN js AS a ON a.doc_id = g.doc_id AND a.kind = 1 LEFT JOIN js AS z ON z.doc_id = g.doc_id AND z.kind = 2
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, t, w, len(w) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, w, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""

#: The CRC-32 of all distinct features is worked out byte by byte, a join of the byte table a step.
OP13_SQL = f"""
WITH RECURSIVE x AS (SELECT 'd' AS side, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents UNION ALL SELECT 'b', NULL, regexp_extract_all({_LOWER}, '{_ALNUM}') FROM benchmark),
f AS (SELECT side, doc_id, unnest(w) AS g FROM x UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM x WHERE len(w) > 1),
crc AS (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM (SELECT unnest(range(256)) AS b)),
u AS (SELECT g, hex(encode(g)) AS hx FROM (SELECT DISTINCT g FROM f)),
r AS (SELECT g, hx, 0::BIGINT AS k, 4294967295::BIGINT AS c FROM u
      UNION ALL SELECT g, hx, k + 1, xor(r.c >> 8, crc.c) FROM r JOIN crc ON crc.b = xor(r.c & 255, ('0x' || hx[2 * k + 1 : 2 * k + 2])::BIGINT) WHERE 2 * k < length(hx)),
bucket AS MATERIALIZED (SELECT g, xor(c, 4294967295) % 10000 AS n FROM r WHERE 2 * k = length(hx)),
fb AS MATERIALIZED (SELECT side, doc_id, n FROM f JOIN bucket USING (g)),
s AS (SELECT n, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM fb GROUP BY n),
gain AS (SELECT n, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM s) + 10000)::DOUBLE)))::BIGINT AS g FROM s),
wt AS (SELECT doc_id, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM fb JOIN gain USING (n) WHERE side = 'd' GROUP BY doc_id),
sc AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
       FROM documents AS d LEFT JOIN wt USING (doc_id)),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM sc WHERE n_features >= 39)
SELECT sc.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN k <= 25 * n // 100 THEN k END AS rank FROM sc LEFT JOIN rk USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_middle": OP11_SQL, "op13_resample": OP13_SQL, "op9_substrings": OP9_SQL, "op10_quality_rules": _op10_sql(), "op2_perspectives": OP2_SQL, "op3_decontaminate": OP3_SQL}
