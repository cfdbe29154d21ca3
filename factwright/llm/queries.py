"""The numbered queries: each a thin use of its operator."""

from pyspark.sql import functions as F

from factwright.llm import archive, language, minhash, mixing, negatives, packed, quality, repair, resample, sharding, suffixtree, tokens, winnow
from factwright.llm.common import ORACLES, QUERIES, new_folder, query, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op1_hash_threshold_mix", r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
w AS (SELECT source, s, 3.0::DOUBLE * s AS most, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
o AS (SELECT *, most / w AS edge, (sum(s) OVER ())::DOUBLE AS total, coalesce(sum(most) OVER before, 0) AS held, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS free
    FROM w WINDOW before AS (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((total - held) / free, edge) FILTER (WHERE (total - held) / free <= edge) AS l FROM o),
t AS (SELECT source, s, round(least(most, l * w), 6) AS target FROM o, level),
p AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT d.source, h, sum(size) AS words FROM d GROUP BY d.source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
x AS (SELECT c.source, h, p.s > 0 AND target - whole * s > 0 AND upto - words / 2.0 <= target - whole * s AS extra FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.s AS source_size, p.target, d.size * (p.whole + x.extra::BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
""")
def op1(spark, sf):
    docs = table(spark, sf, "documents")
    rows = mixing.cut(docs.select("doc_id", "source", mixing.size().alias("size"), mixing.mix_hash().alias("hash")))
    plan = mixing.thresholds(rows, mixing.targets(rows))
    return mixing.copies(rows, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op2_risk_controlled_rules", r"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, array_to_string(w, '') AS j, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT doc_id, coalesce(lang, '') AS stratum, n_words, len(j)::BIGINT AS word_chars, len(regexp_replace(j, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(regexp_replace(j, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals, len(regexp_replace(j, '[^!]+', '', 'g'))::BIGINT AS n_exclamations,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words FROM m),
r AS (SELECT doc_id, stratum, unnest(['symbols', 'capitals', 'exclamations', 'repeats', 'dup_lines']) AS rule,
    unnest([n_symbols / nullif(word_chars, 0), n_capitals / nullif(word_chars, 0), n_exclamations / nullif(word_chars, 0), n_repeat_words / nullif(n_words, 0), n_dup_lines / nullif(n_lines, 0)]) AS rate FROM f),
st AS (SELECT doc_id, stratum, rule, coalesce(least(ceil(rate * 200), 200), 0)::INTEGER AS step FROM r),
h AS (SELECT stratum, rule, step, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad FROM st JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL),
g AS (SELECT stratum, rule, unnest(range(0, 201)) AS step FROM (SELECT DISTINCT stratum, rule FROM h)),
t AS (SELECT stratum, rule, step, sum(coalesce(good, 0)) OVER one AS n, sum(coalesce(bad, 0)) OVER one AS n_bad, coalesce(sum(good) OVER above, 0) AS lost, coalesce(sum(bad) OVER above, 0) AS caught
    FROM g LEFT JOIN h USING (stratum, rule, step) WINDOW one AS (PARTITION BY stratum, rule), above AS (PARTITION BY stratum, rule ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, CASE WHEN lost >= n * 0.01 THEN 1 ELSE list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)) FOR i IN range(lost::BIGINT + 1)]) END AS p FROM t),
c AS (SELECT stratum, rule, max({'worth': caught / greatest(n_bad, 1) - 5.0 * lost / n, 'step': step}).step AS cutoff FROM p WHERE p <= 0.05 / (SELECT count(*) FROM (SELECT DISTINCT stratum, rule FROM h)) GROUP BY ALL),
v AS (SELECT doc_id, bool_or(coalesce(step > cutoff, false)) AS failed FROM st LEFT JOIN c USING (stratum, rule) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT failed AS kept FROM f JOIN v USING (doc_id)
""")
def op2(spark, sf):
    found = quality.rules(table(spark, sf, "documents").select("doc_id", "lang", "text"), table(spark, sf, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_sampled_splitters")
def op3(spark, sf):
    keyed = sharding.keyed(table(spark, sf, "documents")).select("_size", "_key", "_tie", "row")
    narrow = F.struct("row.doc_id", F.col("_size").alias("size"), F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"))
    placed = sharding.place(sharding.cut(keyed.withColumn("row", narrow)), 8)
    return placed.select("row.*", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_pretoken_counts")
def op4(spark, sf):
    import public_tokenizers

    found = tokens.counts(table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op5_importance_resampling")
def op5(spark, sf):
    found = resample.classify(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    return found.select("doc_id", "n_words", "log_weight", "draw", "kept")


@query("op6_mixture_language_id")
def op6(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", language.held_out())
    model = language.learn(docs.where("not held_out").select("text", "lang"))
    found = language.predict(docs.select("doc_id", "text"), *model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op7_minhash_near_dedup")
def op7(spark, sf):
    found = minhash.groups(table(spark, sf, "documents").select("doc_id", "text"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


@query("op8_content_addressed_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS newest FROM p),
x AS (SELECT *, [('0x' || substr(h, 1 + 10 * i, 10))::BIGINT FOR i IN [0, 1, 2, 3]] AS v FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[1 + k // 8] >> (35 - 5 * (k % 8))) & 31)::INTEGER, 1) FOR k IN range(32)], '') AS payload_digest,
    CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to FROM x
""")
def op8(spark, sf):
    path = new_folder(spark, "warc")
    archive.write(archive.records(table(spark, sf, "pages")), path)
    archive.export(archive.read(spark, path), f"{path}/files", "gzip")
    found = archive.resolve(archive.load(spark, f"{path}/files"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_suffix_tree_scores")
def op9(spark, sf):
    return suffixtree.fit_and_score(table(spark, sf, "documents").select("doc_id", "text"))[0]


@query("op10_winnowing", rf"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (s) WHERE dw.n = bw.n),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
""")
def op10(spark, sf):
    found = winnow.report(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op11_patched_frames")
def op11(spark, sf):
    import public_tokenizers

    path = new_folder(spark, "ids")
    packed.write(table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    return packed.read(spark, path)


def _edit(k: str, cost: str, edit: str) -> str:
    """SQL for a weight, its cost as nine digits and then its audit, after one more edit."""
    return f"lpad((substr({k}, 1, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr({k}, 10) || '{edit}'"


def _step(k0: str, k1: str, k2: str, k3: str) -> str:
    """SQL for the weights of the states after row r, insertions aside."""
    before_user = f"least({k0}, {k1}, {k3})"
    one = lambda initial, k: f"CASE WHEN NOT dead AND initial = '{initial}' THEN {_edit(k, 'more', 'K')} END"
    new = lambda k: f"CASE WHEN NOT dead THEN {_edit(k, '3 + more', 'R')} END"
    gone = lambda k: _edit(k, "4", "D")
    return (f"{gone(k0)} AS a0, least({gone(k1)}, {one('s', k0)}) AS a1, least({gone(k2)}, {one('u', before_user)}, {new(before_user)}) AS a2, "
            f"least({gone(k3)}, {one('a', k2)}, {new(k2)}) AS a3")


@query("op12_lightest_repairs", rf"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM (SELECT unnest(range(256)) AS i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h),
o AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, *, substr(role, 1, 1) AS initial,
    NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut FROM d),
f AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS dup, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM o),
g AS (SELECT *, blank OR dup AS dead, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM f),
s AS (SELECT c, 0::BIGINT AS i, '000000000' AS k0, NULL::VARCHAR AS k1, '000000003I' AS k2, '000000006II' AS k3 FROM (SELECT DISTINCT c FROM g)
    UNION ALL
    SELECT c, i, a0, a1, b2, least(a3, {_edit('b2', '3', 'I')}) FROM (SELECT *, least(a2, {_edit('a0', '3', 'I')}, {_edit('a1', '3', 'I')}, {_edit('a3', '3', 'I')}) AS b2
        FROM (SELECT g.c, g.i, {_step('k0', 'k1', 'k2', 'k3')} FROM s JOIN g ON g.c = s.c AND g.i = s.i + 1))),
w AS (SELECT c, arg_max(least(k0, k3), i) AS w FROM s GROUP BY c),
e AS (SELECT c, unnest(range(1, len(w) - 8)) AS p, substr(w, 9 + p, 1) AS e FROM w WHERE len(w) > 9),
n AS (SELECT *, sum((e <> 'I')::INTEGER) OVER one AS i, sum((e <> 'D')::INTEGER) OVER one AS n FROM e WINDOW one AS (PARTITION BY c ORDER BY p)),
x AS (SELECT n.c, n.p, n.e, n.n, g.role, CASE WHEN n.e <> 'I' THEN g.text ELSE '' END AS text, max((n.n = 1 AND n.e = 'K' AND g.initial = 's')::INTEGER) OVER (PARTITION BY n.c) AS off
    FROM n LEFT JOIN g ON g.c = n.c AND g.i = n.i),
y AS (SELECT c, string_agg(CASE WHEN e = 'K' THEN role WHEN (n - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS lines FROM x WHERE e <> 'D' GROUP BY c),
z AS (SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
    count(*) FILTER (cut AND NOT dead) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY c)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(substr(w, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(w, 10), '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN z ON q.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN w USING (c) LEFT JOIN y USING (c)
""")
def op12(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.damage(rows), rows).drop("n_repaired")


@query("op13_cluster_lists", """
WITH e AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, b.r, CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, b.v) END::BIGINT AS score
    FROM e a JOIN e b ON a.r <> b.r AND a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) <= 5),
n AS (SELECT p.anchor, p.r, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, s.r AS nr
    FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score),
x AS (SELECT *, row_number() OVER (PARTITION BY anchor, r ORDER BY negative_score DESC, negative_id NULLS LAST, nr) AS rank FROM n)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM x WHERE rank <= 5
""")
def op13(spark, sf):
    rows = negatives.usable(table(spark, sf, "embeddings")).withColumn("label", negatives.label_noise(F.col("label"), F.col("id")))
    rows = negatives.keyed(negatives.scaled(rows))
    return negatives.mine(rows, rows.where("id % 100 = 0"))


def load():
    return QUERIES, ORACLES
